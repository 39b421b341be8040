"""Queries over a property graph held as two DataFrames."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.schema import EDGES, NODES
from lodestone.staging import staged

DEFAULT_DEPTH, DEFAULT_NODES = 5, 200
#: Fixed value: paths of test files, matched anywhere and in any case.
TEST_FILE = r"(?i)(\.test\.|\.spec\.|_test\.|_spec\.|/tests?/|/__tests__/)"


def first_rows(df: DataFrame, limit: int | None, *order) -> DataFrame:
    """The first ``limit`` rows in ``order``, all where it is None. A negative limit leaves out so many of the last rows,
    for which they are counted."""
    if limit is None:
        return df
    return df.orderBy(*order).limit(limit if limit >= 0 else max(0, df.count() + limit))


@dataclass(frozen=True)
class Impact:
    """``rows``: node columns, depth and confidence; ``truncated``: whether the node cap cut the walk."""

    rows: DataFrame
    truncated: bool

    def groups(self) -> DataFrame:
        """One row a depth, its nodes as an array in order of confidence, then id by locale."""
        item = F.struct((-F.col("confidence")).alias("k"), F.collate("id", "UNICODE").alias("c"), F.struct("id", "confidence").alias("node"))
        return self.rows.groupBy("depth").agg(F.array_sort(F.collect_list(item)).alias("s")).select("depth", F.col("s.node").alias("nodes"))


class CodeGraph:
    """A graph of ``nodes`` and ``edges`` (lodestone.schema). Nothing is collected; every query is a DataFrame.

    Ids may collide in ``nodes``: a lookup by id sees the last of them at the place of the first, and a lookup by name
    sees all. ``unique_ids`` says that they don't and saves the shuffle that settles it.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, unique_ids: bool = False):
        self.raw_nodes, self._edges, self.unique_ids = nodes, edges, unique_ids

    @property
    def spark(self):
        return self.raw_nodes.sparkSession

    @cached_property
    def _by_id(self) -> DataFrame:
        if self.unique_ids:
            return self.raw_nodes
        names = self.raw_nodes.columns
        last = F.max_by(F.struct(*names), "ord").alias("n")
        return self.raw_nodes.groupBy("id").agg(last, F.min("ord").alias("o")).select(*[F.col("o").alias("ord") if c == "ord" else F.col(f"n.{c}") for c in names])

    def nodes(self) -> DataFrame:
        return self._by_id

    def edges(self) -> DataFrame:
        return self._edges

    def staged(self, edge_kinds: list[str] | None = None) -> CodeGraph:
        """The graph (or its edges of some kinds) written once, for walks that go over its edges again and again."""
        edges = self._edges if edge_kinds is None else self._edges.where(F.col("kind").isin(list(edge_kinds)))
        return CodeGraph(staged(self.raw_nodes, "nodes"), staged(edges, "edges"), self.unique_ids)

    def files(self) -> DataFrame:
        return self._by_id.where("kind = 'file'")

    def symbols(self) -> DataFrame:
        return self._by_id.where("kind = 'symbol'")

    def get_node(self, node_id: str) -> DataFrame:
        return self._by_id.where(F.col("id") == node_id)

    def find_definition(self, name: str) -> DataFrame:
        """Symbols of exactly this name, duplicates kept."""
        return self.raw_nodes.where((F.col("kind") == "symbol") & (F.col("name") == name))

    def search_symbols(self, name: str | None = None, kind: str | None = None, limit: int | None = 25) -> DataFrame:
        """Symbols whose name contains ``name`` in any case (empty or none: all) and whose symbol kind is ``kind``."""
        found = self.symbols()
        if name:
            found = found.where(F.contains(F.lower("name"), F.lit(name.lower())))
        if kind:
            found = found.where(F.col("symbol_kind") == kind)
        return first_rows(found, limit, "ord")

    def ids_for(self, id_or_name: str) -> DataFrame:
        """Column id: the node of this id, else all symbols of this name. Nothing runs while it is planned; what says
        whether the id exists is one row, and sent as such."""
        own = self.raw_nodes.where(F.col("id") == id_or_name).select("id").limit(1)
        named = self.find_definition(id_or_name).select("id").distinct()
        there = F.broadcast(own.select(F.lit(id_or_name).alias("asked")))
        return own.unionByName(named.withColumn("asked", F.lit(id_or_name)).join(there, "asked", "left_anti").select("id"))

    def _ends(self, edges: DataFrame, at: str, to: str, ids: DataFrame) -> DataFrame:
        """The nodes at ``to`` of edges whose ``at`` is among ``ids``, each once, ``position`` its first edge's ord."""
        reached = edges.join(ids.withColumnRenamed("id", at), at, "left_semi")
        first = reached.groupBy(F.col(to).alias("id")).agg(F.min("ord").alias("position"))
        return self._by_id.join(first, "id")

    def find_references(self, id_or_name: str) -> DataFrame:
        """Nodes with a references edge to the symbol, or to any symbol of that name."""
        return self._ends(self._edges.where("kind = 'references'"), "dst", "src", self.ids_for(id_or_name))

    def callers(self, id_or_name: str) -> DataFrame:
        return self._ends(self._edges.where("kind = 'calls'"), "dst", "src", self.ids_for(id_or_name))

    def callees(self, id_or_name: str) -> DataFrame:
        return self._ends(self._edges.where("kind = 'calls'"), "src", "dst", self.ids_for(id_or_name))

    def neighbors(self, node_id: str, outgoing: bool = True, incoming: bool = True, edge_kinds: list[str] | None = None) -> DataFrame:
        """Distinct nodes one edge away; ``position`` (side, ord) has outgoing first."""
        edges = self._edges if edge_kinds is None else self._edges.where(F.col("kind").isin(list(edge_kinds)))
        sides = [edges.where(F.col(at) == node_id).select(F.col(to).alias("id"), F.lit(k).alias("side"), "ord") for k, (on, at, to) in enumerate([(outgoing, "src", "dst"), (incoming, "dst", "src")]) if on]
        if not sides:
            return self._by_id.limit(0).withColumn("position", F.lit(None).cast("struct<side:int,ord:long>"))
        both = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
        return self._by_id.join(both.groupBy("id").agg(F.min(F.struct("side", "ord")).alias("position")), "id")

    def edges_from(self, node_id: str) -> DataFrame:
        return self._edges.where(F.col("src") == node_id)

    def edges_to(self, node_id: str) -> DataFrame:
        return self._edges.where(F.col("dst") == node_id)

    def file_summary(self, path: str) -> DataFrame:
        """No row for an unknown path; else the file, its symbols and the files it imports, as arrays of ids in order."""
        file = self.files().where(F.col("path") == path).select(F.col("id").alias("file_id"), "path", "language")
        out = self._edges.where("kind in ('contains', 'imports')").select(F.col("src").alias("file_id"), "dst", F.col("kind").alias("edge_kind"), F.col("ord").alias("edge_ord"))
        out = file.select("file_id").join(out, "file_id").join(self._by_id.select(F.col("id").alias("dst"), "kind"), "dst")
        item = F.struct("edge_ord", "dst")
        symbols = F.collect_list(F.when((F.col("edge_kind") == "contains") & (F.col("kind") == "symbol"), item))
        imports = F.collect_list(F.when((F.col("edge_kind") == "imports") & (F.col("kind") == "file"), item))
        parts = out.groupBy("file_id").agg(F.array_sort(symbols).alias("s"), F.array_sort(imports).alias("i"))
        none = F.array().cast("array<string>")
        return file.join(parts, "file_id", "left").select("file_id", "path", "language", F.coalesce("s.dst", none).alias("symbols"), F.coalesce("i.dst", none).alias("imports"))

    def impact(self, id_or_name: str, direction: str = "callers", max_depth: int = DEFAULT_DEPTH, max_nodes: int = DEFAULT_NODES, min_confidence: float = 0.0) -> Impact:
        """Blast radius over calls: who is reached at which depth, with the weakest confidence along the best way there.

        Level by level: a level's confidence is the largest over the level before of the smaller of its confidence and
        the edge's. Edges under ``min_confidence`` (none: 0) are ignored, the start is never returned, ids without a
        node neither. At ``max_nodes`` the level is cut, best confidence first, then id by locale. Each level is one
        join, one aggregation and one anti-join, and is written before the next.
        """
        at, to = ("dst", "src") if direction == "callers" else ("src", "dst")
        confidence = F.coalesce("confidence", F.lit(0.0))
        calls = self._edges.where("kind = 'calls'").where(confidence >= min_confidence).select(F.col(at).alias("id"), F.col(to).alias("next"), confidence.alias("edge"))
        known = self._by_id.select("id")
        frontier = staged(self.ids_for(id_or_name).withColumn("confidence", F.lit(1.0)), "level")
        seen, levels, reached, truncated = frontier.select("id"), [], 0, False
        for depth in range(1, max_depth + 1):
            way = frontier.join(calls, "id").select(F.col("next").alias("id"), F.least("confidence", "edge").alias("confidence"))
            best = way.groupBy("id").agg(F.max("confidence").alias("confidence")).join(seen, "id", "left_anti").join(known, "id", "left_semi")
            level = staged(best, "level")
            size = level.count()
            if reached + size > max_nodes:
                truncated, size = True, max_nodes - reached
                level = level.orderBy(F.desc("confidence"), F.collate("id", "UNICODE")).limit(size)
            if size:
                levels.append(level.withColumn("depth", F.lit(depth)))
            reached += size
            if truncated or not size:
                break
            frontier, seen = level, seen.unionByName(level.select("id"))
        rows = levels[0] if levels else frontier.limit(0).withColumn("depth", F.lit(0))
        for level in levels[1:]:
            rows = rows.unionByName(level)
        return Impact(self._by_id.join(rows, "id"), truncated)

    def affected(self, id_or_name: str, **options) -> DataFrame:
        """Rows of ``impact`` that lie in test files."""
        return self.impact(id_or_name, **options).rows.where(F.col("path").rlike(TEST_FILE))

    def ranked_context(self, **options) -> DataFrame:
        from lodestone.operators.rank import pagerank

        return pagerank(self, **options)

    def name_index(self) -> DataFrame:
        """name -> its rows and their ids in order."""
        item = F.array_sort(F.collect_list(F.struct("ord", "id")))["id"]
        return self.raw_nodes.where("kind = 'symbol'").groupBy("name").agg(F.count("*").alias("n"), item.alias("ids"))

    def dangling(self) -> DataFrame:
        """Edges with an end that is no node."""
        ids = self._by_id.select("id")
        ok = self._edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return self._edges.join(ok.select("ord"), "ord", "left_anti")

    def language_histogram(self) -> DataFrame:
        return self.files().groupBy("language").agg(F.count("*").alias("n"))

    def write_json(self, path: str) -> None:
        """One JSON object a line: nodes and edges in two folders, absent fields left out. For graphs of any size."""
        self.raw_nodes.write.mode("overwrite").json(f"{path}/nodes")
        self._edges.write.mode("overwrite").json(f"{path}/edges")

    def to_json(self, most: int = 1_000_000) -> str:
        """One document ``{"nodes": [...], "edges": [...]}`` in order, each as a caller of the tools sees it. A string lives on the
        driver, so a graph of more than ``most`` nodes or edges is refused; ``write_json`` takes any."""
        symbol = F.col("kind") == "symbol"
        node = F.struct("id", "kind", "name", F.col("symbol_kind").alias("symbolKind"), F.when(symbol, F.col("path")).alias("file"), F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"), F.when(~symbol, F.col("path")).alias("path"), "language")
        meta = F.when(F.col("kind") == "calls", F.struct("confidence", F.col("call_kind").alias("kind"), F.col("receiver_type").alias("receiverType"), F.col("call_count").alias("callCount"), "line"))
        edge = F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "kind", meta.alias("meta"))
        parts = []
        for name, table, row in (("nodes", self.nodes(), node), ("edges", self.edges(), edge)):
            if table.limit(most + 1).count() > most:
                raise ValueError(f"more than {most} {name}: write_json takes them")
            parts.append(f'"{name}":[{",".join(r[0] for r in table.orderBy("ord").select(F.to_json(row)).toLocalIterator())}]')
        return "{" + ",".join(parts) + "}"

    @classmethod
    def from_json(cls, spark, text: str) -> CodeGraph:
        """The graph of a ``to_json`` document."""
        found = json.loads(text)
        nodes = [(n["id"], n["kind"], n.get("name"), n.get("symbolKind"), n.get("file", n.get("path")), n.get("language"), n.get("startLine"), n.get("endLine"), k) for k, n in enumerate(found["nodes"])]
        edges = [(e["from"], e["to"], e["kind"], *((e.get("meta") or {}).get(m) for m in ("confidence", "kind", "receiverType", "callCount", "line")), k) for k, e in enumerate(found["edges"])]
        return cls(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))

    @classmethod
    def read_json(cls, spark, path: str, unique_ids: bool = False) -> CodeGraph:
        return cls(spark.read.schema(NODES).json(f"{path}/nodes"), spark.read.schema(EDGES).json(f"{path}/edges"), unique_ids)


def distinct_edges(edges: DataFrame) -> DataFrame:
    """The first of the edges of one (kind, src, dst), without self-loops."""
    nth = F.row_number().over(W.partitionBy("kind", "src", "dst").orderBy("ord"))
    return edges.where("src <> dst").withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def aggregate_calls(sites: DataFrame) -> DataFrame:
    """Call sites (src, dst, confidence, is_new, line, receiver_type, ord) to one edge a pair; self-calls go.

    Confidence is the largest, line the smallest, kind ``new`` if any site is, receiver type that of the first site.
    """
    return (
        sites.where("src <> dst")
        .groupBy("src", "dst")
        .agg(
            F.max("confidence").alias("confidence"),
            F.when(F.max("is_new"), "new").otherwise("call").alias("call_kind"),
            F.min_by("receiver_type", "ord").alias("receiver_type"),
            F.count("*").alias("call_count"),
            F.min("line").alias("line"),
            F.min("ord").alias("ord"),
        )
    )


def innermost(points: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """``points(*keys, point_id, at)`` with range_id: that of ``ranges(*keys, range_id, start, end, ord)`` that holds
    ``at``, both ends included, and starts last; of equal starts the first by ord. Null where none does.

    The join is by keys, with the bounds as a residual; the winner is an aggregate, not a sort.
    """
    hits = points.join(ranges.select(*keys, "range_id", "start", "end", F.col("ord").alias("__ord")), keys).where("start <= at and at <= end")
    best = hits.groupBy("point_id").agg(F.max_by("range_id", F.struct("start", -F.col("__ord"))).alias("range_id"))
    return points.join(best, "point_id", "left")


def unique_or_skip(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """``refs(ref_id, file, name)`` with target: the first definition (file, name, id, ord) of its name in its own file,
    else the only one anywhere (rows are counted, not ids); refs without either go."""
    here = defs.groupBy("file", "name").agg(F.min_by("id", "ord").alias("here"))
    anywhere = defs.groupBy("name").agg(F.count("*").alias("n"), F.first("id").alias("only")).where("n = 1").select("name", "only")
    found = refs.join(here, ["file", "name"], "left").join(anywhere, "name", "left")
    return found.withColumn("target", F.coalesce("here", "only")).where("target is not null").drop("here", "only")
