"""Scalar functions and their column forms."""
