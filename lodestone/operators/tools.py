"""The ten graph queries as tools over JSON inputs, each giving a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.graph import TEST_FILE, CodeGraph, first_rows
from lodestone.runtime import Capability, Tool
from lodestone.schema import EDGE_KINDS, SYMBOL_KINDS

LIMIT = 25
_TEXT, _COUNT = {"type": "string"}, {"type": "integer"}


def described(nodes: DataFrame, *more) -> DataFrame:
    """Node rows as callers see them: symbols with file and lines, files with path and language."""
    symbol = F.col("kind") == "symbol"
    return nodes.select("id", "kind", "name", F.col("symbol_kind").alias("symbolKind"), F.when(symbol, F.col("path")).alias("file"), F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"), F.when(~symbol, F.col("path")).alias("path"), F.when(~symbol, F.col("language")).alias("language"), *more)


def reached(rows: DataFrame) -> DataFrame:
    """Rows of an impact walk as callers see them; confidence has two digits."""
    symbol = F.col("kind") == "symbol"
    return rows.select("id", "name", F.col("symbol_kind").alias("symbolKind"), F.when(symbol, F.col("path")).alias("file"), F.col("start_line").alias("line"), F.when(~symbol, F.col("path")).alias("path"), "depth", F.round("confidence", 2).alias("confidence"))


def graph_capability(graph: CodeGraph | Callable[[], CodeGraph], prefix: str = "codegraph", default_limit: int = LIMIT) -> Capability:
    """The tools; a callable is asked for the graph at each call, so that a served graph can be replaced."""
    current = graph if callable(graph) else lambda: graph

    def tool(name: str, description: str, properties: dict, required: list[str], run) -> Tool:
        schema = {"type": "object", "properties": properties, "required": required, "additionalProperties": False}
        return Tool(f"{prefix}_{name}", lambda given, _context: run(current(), given or {}), description, schema)

    def limit(given: dict) -> int:
        return given.get("limit", default_limit)

    def one_hop(direction: str):
        def run(g: CodeGraph, given: dict) -> DataFrame:
            found = g.impact(given["symbol"], direction, 1, min_confidence=given.get("minConfidence", 0.0)).rows
            return reached(first_rows(found, limit(given), F.desc("confidence"), F.collate("id", "UNICODE")))

        return run

    def impact(g: CodeGraph, given: dict) -> DataFrame:
        found = g.impact(given["symbol"], max_depth=given.get("maxDepth", 5), max_nodes=given.get("maxNodes", 200), min_confidence=given.get("minConfidence", 0.0))
        rows = reached(found.rows)
        item = F.struct((-F.col("confidence")).alias("k"), F.collate("id", "UNICODE").alias("c"), F.struct(*[c for c in rows.columns if c != "depth"]).alias("node"))
        return rows.groupBy("depth").agg(F.array_sort(F.collect_list(item)).alias("s")).select("depth", F.col("s.node").alias("nodes"), F.lit(found.truncated).alias("truncated"))

    def affected(g: CodeGraph, given: dict) -> DataFrame:
        found = g.impact(given["symbol"], max_depth=given.get("maxDepth", 5), max_nodes=given.get("maxNodes", 200), min_confidence=given.get("minConfidence", 0.0)).rows
        return reached(found.where(F.col("path").rlike(TEST_FILE)))

    symbol, ceiling = {"symbol": _TEXT}, {"minConfidence": {"type": "number"}}
    walk = symbol | ceiling | {"maxDepth": _COUNT, "maxNodes": _COUNT}
    return Capability(
        prefix,
        (
            tool("search_symbols", "Symbols by part of their name and by kind.", {"name": _TEXT, "kind": {"type": "string", "enum": list(SYMBOL_KINDS)}, "limit": _COUNT}, [], lambda g, x: described(g.search_symbols(x.get("name"), x.get("kind"), limit(x)))),
            tool("find_definition", "Where a name is declared.", {"name": _TEXT}, ["name"], lambda g, x: described(g.find_definition(x["name"]))),
            tool("find_references", "What refers to a symbol.", symbol | {"limit": _COUNT}, ["symbol"], lambda g, x: described(first_rows(g.find_references(x["symbol"]), limit(x), "position"))),
            tool("neighbors", "Nodes one edge away.", {"id": _TEXT, "direction": {"type": "string", "enum": ["outgoing", "incoming", "both"]}, "edgeKinds": {"type": "array", "items": {"type": "string", "enum": list(EDGE_KINDS)}}, "limit": _COUNT}, ["id"], lambda g, x: described(first_rows(g.neighbors(x["id"], x.get("direction", "both") != "incoming", x.get("direction", "both") != "outgoing", x.get("edgeKinds")), limit(x), "position"))),
            tool("file_summary", "What a file declares and imports.", {"path": _TEXT}, ["path"], lambda g, x: g.file_summary(x["path"])),
            tool("relevant_context", "The nodes that matter most, to given seeds or at all.", {"seeds": {"type": "array", "items": _TEXT}, "kind": {"type": "string", "enum": ["file", "symbol"]}, "limit": _COUNT}, [], lambda g, x: described(g.ranked_context(seeds=x.get("seeds"), kind=x.get("kind"), limit=limit(x)), "score")),
            tool("callers", "Who calls a symbol.", symbol | ceiling | {"limit": _COUNT}, ["symbol"], one_hop("callers")),
            tool("callees", "What a symbol calls.", symbol | ceiling | {"limit": _COUNT}, ["symbol"], one_hop("callees")),
            tool("impact", "Who is affected by a change, by depth.", walk, ["symbol"], impact),
            tool("affected", "Test files affected by a change.", walk, ["symbol"], affected),
        ),
        "Questions to a code graph.",
    )
