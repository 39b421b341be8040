"""Streams: trace events to spans, and rebuilding a served graph as its sources change."""
