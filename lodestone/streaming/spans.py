"""Folding trace events into spans, over a table or a stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

START, ENDS = "runtime:start", ("runtime:end", "runtime:error")
#: Events that a span records, with a failing tool's only if it has a cause.
RECORDED = ("tool:start", "tool:end", "guardrail:blocked")
SPAN = "runId string, name string, start_ms long, end_ms long, status string, error string, events array<string>, tool string"


def _name(tool):
    return F.when(tool.isNull() | (tool == ""), F.lit("execute_tool")).otherwise(F.concat(F.lit("execute_tool "), tool))


def fold_spans(events: DataFrame) -> DataFrame:
    """Spans (SPAN) of ``events(type, timestamp, runId, data, ord)``; ord settles the order of equal times.

    A start opens a span and replaces one still open, the first end or error after it closes it, and only closed spans
    come out. Events of a run without an open span are ignored. Windows over one run's events, then one aggregation:
    no run is gathered in memory but for the names of its recorded events.
    """
    run = W.partitionBy("runId").orderBy("timestamp", "ord")
    so_far = run.rowsBetween(W.unboundedPreceding, 0)
    rows = events.withColumn("span_no", F.sum(F.when(F.col("type") == START, 1).otherwise(0)).over(so_far)).where("span_no > 0")
    own = W.partitionBy("runId", "span_no").orderBy("timestamp", "ord")
    ended = F.sum(F.when(F.col("type").isin(*ENDS), 1).otherwise(0))
    rows = rows.withColumn("ended", F.coalesce(ended.over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).where("ended = 0")
    at = F.struct("timestamp", "ord")
    is_end, cause = F.col("type").isin(*ENDS), F.element_at("data", "cause")
    recorded = F.col("type").isin(*RECORDED) | (F.col("type") == "tool:error") & cause.isNotNull()
    tool = F.first(F.when(F.col("type") == START, F.element_at("data", "toolId")), True)
    kind = F.when(F.col("type") == "tool:error", "exception").otherwise(F.col("type"))
    spans = rows.groupBy("runId", "span_no").agg(
        tool.alias("tool"),
        F.min(F.when(F.col("type") == START, F.col("timestamp"))).alias("start_ms"),
        F.max(F.when(is_end, F.col("timestamp"))).alias("end_ms"),
        F.max(F.when(is_end, F.when(F.col("type") == "runtime:end", "OK").otherwise("ERROR"))).alias("status"),
        F.max(F.when(F.col("type") == "runtime:error", F.element_at("data", "code"))).alias("error"),
        F.array_sort(F.collect_list(F.when(recorded, F.struct(at.alias("at"), kind.alias("type"))))).alias("recorded"),
    )
    return spans.where("end_ms is not null").select("runId", _name(F.col("tool")).alias("name"), "start_ms", "end_ms", "status", "error", F.col("recorded.type").alias("events"), "tool")


class SpanFold(StatefulProcessor):
    """The same fold with the open span of each run as state; state goes when the span closes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "start_ms long, tool string, events array<string>")

    def handleInputRows(self, key, rows, timerValues):
        run = key[0]
        now = self.open.get() if self.open.exists() else None
        events = sorted((r for batch in rows for r in batch.itertuples(index=False)), key=lambda r: (r.timestamp, r.ord))
        out = []
        for e in events:
            data = dict(e.data) if e.data is not None else {}
            if e.type == START:
                now = (e.timestamp, data.get("toolId"), [])
            elif now is None:
                continue
            elif e.type in RECORDED or e.type == "tool:error" and data.get("cause") is not None:
                now = (now[0], now[1], [*now[2], "exception" if e.type == "tool:error" else e.type])
            elif e.type in ENDS:
                ok = e.type == "runtime:end"
                out.append((run, f"execute_tool {now[1]}" if now[1] else "execute_tool", now[0], e.timestamp, "OK" if ok else "ERROR", None if ok else data.get("code"), now[2], now[1]))
                now = None
        if now is None:
            self.open.clear()
        else:
            self.open.update((int(now[0]), now[1], list(now[2])))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SPAN.split(", ")])

    def close(self) -> None:
        pass


def stream_spans(events: DataFrame) -> DataFrame:
    """Spans of a stream of events, each as its run's end arrives. Needs the RocksDB state store provider."""
    return events.groupBy("runId").transformWithStateInPandas(statefulProcessor=SpanFold(), outputStructType=SPAN, outputMode="append", timeMode="none")
