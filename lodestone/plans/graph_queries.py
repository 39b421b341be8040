"""Queries of the graph operators over the foreign-key graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators.graph import distinct_edges, innermost, unique_or_skip
from lodestone.operators.rank import DAMPING, ITERATIONS
from lodestone.plans import register
from lodestone.plans.fkgraph import GRAPH_SQL, SITES_SQL, call_sites, edges, graph, nodes, table

NODE_COLUMNS = "id, kind, name, symbol_kind, path, language, start_line, end_line, ord"
_NODES = [c.strip() for c in NODE_COLUMNS.split(",")]


@register("nodes", f"{GRAPH_SQL} SELECT {NODE_COLUMNS} FROM nodes")
def _nodes(spark, sf_dir):
    return graph(spark, sf_dir).nodes()


@register("edges", f"{GRAPH_SQL} SELECT * FROM edges")
def _edges(spark, sf_dir):
    return graph(spark, sf_dir).edges()


@register("files", f"{GRAPH_SQL} SELECT {NODE_COLUMNS} FROM nodes WHERE kind = 'file'")
def _files(spark, sf_dir):
    return graph(spark, sf_dir).files()


@register("symbols", f"{GRAPH_SQL} SELECT symbol_kind, count(*) AS n FROM nodes WHERE kind = 'symbol' GROUP BY symbol_kind")
def _symbols(spark, sf_dir):
    return graph(spark, sf_dir).symbols().groupBy("symbol_kind").agg(F.count("*").alias("n"))


@register("get_node", f"{GRAPH_SQL} SELECT {NODE_COLUMNS} FROM nodes WHERE id = 's:7'")
def _get_node(spark, sf_dir):
    return graph(spark, sf_dir).get_node("s:7")


@register("find_definition", f"{GRAPH_SQL} SELECT {NODE_COLUMNS} FROM nodes WHERE kind = 'symbol' AND name = 'small ring'")
def _find_definition(spark, sf_dir):
    return graph(spark, sf_dir).find_definition("small ring")


@register("search_symbols", f"{GRAPH_SQL} SELECT {NODE_COLUMNS} FROM nodes WHERE symbol_kind = 'type' AND contains(lower(name), 'widg') ORDER BY ord LIMIT 25")
def _search_symbols(spark, sf_dir):
    return graph(spark, sf_dir).search_symbols("WidG", "type")


def _ends_sql(kind: str, at: str, to: str, ids: str) -> str:
    return f"{GRAPH_SQL} SELECT n.id, n.name, n.path, min(e.ord) AS position FROM edges e JOIN nodes n ON n.id = e.{to} WHERE e.kind = '{kind}' AND e.{at} IN ({ids}) GROUP BY n.id, n.name, n.path"


_NAMED = "SELECT id FROM nodes WHERE kind = 'symbol' AND name = 'red widget'"


@register("find_references", _ends_sql("references", "dst", "src", "'p:5'"))
def _find_references(spark, sf_dir):
    return graph(spark, sf_dir).find_references("p:5").select("id", "name", "path", "position")


@register("find_references_by_name", _ends_sql("references", "dst", "src", _NAMED))
def _find_references_by_name(spark, sf_dir):
    return graph(spark, sf_dir).find_references("red widget").select("id", "name", "path", "position")


@register("callers", _ends_sql("calls", "dst", "src", "'s:3'"))
def _callers(spark, sf_dir):
    return graph(spark, sf_dir).callers("s:3").select("id", "name", "path", "position")


@register("callees", _ends_sql("calls", "src", "dst", "'o:42'"))
def _callees(spark, sf_dir):
    return graph(spark, sf_dir).callees("o:42").select("id", "name", "path", "position")


def _neighbors_sql(sides: dict[str, tuple[str, str]], node: str, kinds: str = "") -> str:
    parts = " UNION ALL ".join(f"SELECT {to} AS id, {side} AS side, ord FROM edges WHERE {at} = '{node}'{kinds}" for side, (at, to) in sides.items())
    return f"{GRAPH_SQL}, both_sides AS ({parts}), best AS (SELECT id, min(side * CAST(1000000000000000000 AS BIGINT) + ord) AS place FROM both_sides GROUP BY id) SELECT n.id, n.kind, CAST(place // 1000000000000000000 AS INTEGER) AS side, place % 1000000000000000000 AS position FROM best JOIN nodes n USING (id)"


def _placed(df):
    return df.select("id", "kind", F.col("position.side").alias("side"), F.col("position.ord").alias("position"))


@register("neighbors_both", _neighbors_sql({"0": ("src", "dst"), "1": ("dst", "src")}, "n:4"))
def _neighbors_both(spark, sf_dir):
    return _placed(graph(spark, sf_dir).neighbors("n:4"))


@register("neighbors_out", _neighbors_sql({"0": ("src", "dst")}, "o:11"))
def _neighbors_out(spark, sf_dir):
    return _placed(graph(spark, sf_dir).neighbors("o:11", incoming=False))


@register("neighbors_in", _neighbors_sql({"1": ("dst", "src")}, "n:4", " AND kind IN ('calls', 'imports')"))
def _neighbors_in(spark, sf_dir):
    return _placed(graph(spark, sf_dir).neighbors("n:4", outgoing=False, edge_kinds=["calls", "imports"]))


@register("edges_from", f"{GRAPH_SQL} SELECT * FROM edges WHERE src = 'o:11'")
def _edges_from(spark, sf_dir):
    return graph(spark, sf_dir).edges_from("o:11")


@register("edges_to", f"{GRAPH_SQL} SELECT * FROM edges WHERE dst = 's:3'")
def _edges_to(spark, sf_dir):
    return graph(spark, sf_dir).edges_to("s:3")


def impact_sql(start: str, at: str, to: str, depth: int, least: float = 0.0) -> str:
    """Levels unrolled: each takes the best of the smaller confidences over the level before."""
    levels = [f"l0 AS MATERIALIZED (SELECT '{start}' AS id, CAST(1 AS DOUBLE) AS confidence)"]
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM l{k}" for k in range(d))
        levels.append(f"l{d} AS MATERIALIZED (SELECT e.{to} AS id, max(least(f.confidence, coalesce(e.confidence, 0))) AS confidence FROM l{d - 1} f JOIN edges e ON e.{at} = f.id AND e.kind = 'calls' AND coalesce(e.confidence, 0) >= {least} WHERE e.{to} NOT IN ({seen}) GROUP BY e.{to})")
    rows = " UNION ALL ".join(f"SELECT id, CAST({d} AS INTEGER) AS depth, confidence FROM l{d}" for d in range(1, depth + 1))
    return f"{GRAPH_SQL}, {', '.join(levels)}, reached AS ({rows})"


_ALL = 10**9


@register("impact_callers", f"{impact_sql('r:0', 'dst', 'src', 5)} SELECT id, depth, confidence FROM reached")
def _impact_callers(spark, sf_dir):
    return graph(spark, sf_dir).staged(["calls"]).impact("r:0", max_nodes=_ALL).rows.select("id", "depth", "confidence")


@register("impact_callees", f"{impact_sql('o:42', 'src', 'dst', 5)} SELECT id, depth, confidence FROM reached")
def _impact_callees(spark, sf_dir):
    return graph(spark, sf_dir).staged(["calls"]).impact("o:42", "callees", max_nodes=_ALL).rows.select("id", "depth", "confidence")


@register("impact_min_confidence", f"{impact_sql('n:2', 'dst', 'src', 5, 0.8)} SELECT id, depth, confidence FROM reached")
def _impact_min_confidence(spark, sf_dir):
    return graph(spark, sf_dir).staged(["calls"]).impact("n:2", max_nodes=_ALL, min_confidence=0.8).rows.select("id", "depth", "confidence")


@register("impact_truncated", f"{impact_sql('r:0', 'dst', 'src', 5)} SELECT id, depth, confidence FROM reached ORDER BY depth, confidence DESC, id LIMIT 200")
def _impact_truncated(spark, sf_dir):
    return graph(spark, sf_dir).staged(["calls"]).impact("r:0").rows.select("id", "depth", "confidence")


@register("impact_grouped", f"{impact_sql('o:42', 'src', 'dst', 5)} SELECT depth, string_agg(id || '=' || confidence, ',' ORDER BY confidence DESC, id) AS nodes FROM reached GROUP BY depth")
def _impact_grouped(spark, sf_dir):
    groups = graph(spark, sf_dir).staged(["calls"]).impact("o:42", "callees").groups()
    return groups.select("depth", F.array_join(F.transform("nodes", lambda n: F.concat(n["id"], F.lit("="), n["confidence"].cast("string"))), ",").alias("nodes"))


@register("affected", f"{impact_sql('n:2', 'dst', 'src', 5)} SELECT r.id, depth, round(confidence, 2) AS confidence, n.path FROM reached r JOIN nodes n USING (id) WHERE regexp_matches(lower(n.path), '(\\.test\\.|\\.spec\\.|_test\\.|_spec\\.|/tests?/|/__tests__/)')")
def _affected(spark, sf_dir):
    found = graph(spark, sf_dir).staged(["calls"]).affected("n:2", max_nodes=_ALL)
    return found.select("id", "depth", F.round("confidence", 2).alias("confidence"), "path")


@register("file_summary", f"""{GRAPH_SQL}, own AS (SELECT f.id AS file_id, f.path, f.language, e.kind AS edge_kind, e.ord, n.id, n.kind FROM nodes f LEFT JOIN edges e ON e.src = f.id LEFT JOIN nodes n ON n.id = e.dst WHERE f.kind = 'file' AND f.path = 'geo/NATION_3')
SELECT file_id, path, language, coalesce(string_agg(id, ',' ORDER BY ord) FILTER (WHERE edge_kind = 'contains' AND kind = 'symbol'), '') AS symbols, coalesce(string_agg(id, ',' ORDER BY ord) FILTER (WHERE edge_kind = 'imports' AND kind = 'file'), '') AS imports FROM own GROUP BY file_id, path, language""")
def _file_summary(spark, sf_dir):
    found = graph(spark, sf_dir).file_summary("geo/NATION_3")
    return found.withColumn("symbols", F.array_join("symbols", ",")).withColumn("imports", F.array_join("imports", ","))


def pagerank_sql(seeds: str, rounds: int) -> str:
    """Rounds unrolled, as many as the query runs."""
    steps = [
        "links AS MATERIALIZED (SELECT e.src, e.dst FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst)",
        "degree AS MATERIALIZED (SELECT src AS id, count(*) AS degree FROM links GROUP BY src)",
        f"seeds AS (SELECT id FROM nodes WHERE {seeds})",
        "base AS MATERIALIZED (SELECT n.id, degree, CASE WHEN s.id IS NULL THEN 0.0 ELSE 1.0 / (SELECT count(*) FROM seeds) END::DOUBLE AS teleport FROM nodes n LEFT JOIN degree USING (id) LEFT JOIN seeds s USING (id))",
        "k0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS score FROM nodes)",
    ]
    for k in range(1, rounds + 1):
        steps.append(
            f"k{k} AS MATERIALIZED (SELECT b.id, {1 - DAMPING!r}::DOUBLE * teleport + {DAMPING!r}::DOUBLE * (coalesce(flow, 0) + (SELECT coalesce(sum(score), 0) FROM k{k - 1} JOIN base USING (id) WHERE degree IS NULL) * teleport) AS score "
            f"FROM base b LEFT JOIN (SELECT dst AS id, sum(score / degree) AS flow FROM links JOIN k{k - 1} r ON r.id = links.src JOIN degree d ON d.id = links.src GROUP BY dst) USING (id))"
        )
    return f"{GRAPH_SQL}, {', '.join(steps)}"


_ROUNDS = 12


@register("pagerank_global", f"{pagerank_sql('TRUE', _ROUNDS)} SELECT id, round(score, 10) AS score FROM k{_ROUNDS}")
def _pagerank_global(spark, sf_dir):
    found = graph(spark, sf_dir).ranked_context(limit=None, iterations=_ROUNDS, tolerance=0.0)
    return found.select("id", F.round("score", 10).alias("score"))


SEEDS = ["o:7", "Supplier#000000003", "geo/NATION_1"]
SEEDS_SQL = "id = 'o:7' OR name = 'Supplier#000000003' OR path = 'geo/NATION_1'"


@register("pagerank_personalized", f"{pagerank_sql(SEEDS_SQL, _ROUNDS)} SELECT id, name, path, round(score, 10) AS score FROM k{_ROUNDS} JOIN nodes USING (id) ORDER BY k{_ROUNDS}.score DESC, id LIMIT 20")
def _pagerank_personalized(spark, sf_dir):
    found = graph(spark, sf_dir).ranked_context(seeds=SEEDS, iterations=_ROUNDS, tolerance=0.0)
    return found.select("id", "name", "path", F.round("score", 10).alias("score"))


@register("ranked_context_files", f"{pagerank_sql(SEEDS_SQL, _ROUNDS)} SELECT id, path, round(score, 10) AS score FROM k{_ROUNDS} JOIN nodes USING (id) WHERE kind = 'file' ORDER BY k{_ROUNDS}.score DESC, id LIMIT 6")
def _ranked_context_files(spark, sf_dir):
    found = graph(spark, sf_dir).ranked_context(seeds=SEEDS, kind="file", limit=6, iterations=_ROUNDS, tolerance=0.0)
    return found.select("id", "path", F.round("score", 10).alias("score"))


@register("pagerank_distributed", f"{pagerank_sql(SEEDS_SQL, 4)} SELECT id, round(score, 10) AS score FROM k4")
def _pagerank_distributed(spark, sf_dir):
    """Rounds as joins and aggregations, as beyond the kernel's size."""
    found = graph(spark, sf_dir).ranked_context(seeds=SEEDS, limit=None, iterations=4, tolerance=0.0, kernel_links=0)
    return found.select("id", F.round("score", 10).alias("score"))


# The same three at the operator's own rounds and tolerance; on these tables the tolerance ends no run before the last round.
@register("pagerank_global_full", f"{pagerank_sql('TRUE', ITERATIONS)} SELECT id, round(score, 10) AS score FROM k{ITERATIONS}")
def _pagerank_global_full(spark, sf_dir):
    return graph(spark, sf_dir).ranked_context(limit=None).select("id", F.round("score", 10).alias("score"))


@register("pagerank_personalized_full", f"{pagerank_sql(SEEDS_SQL, ITERATIONS)} SELECT id, name, path, round(score, 10) AS score FROM k{ITERATIONS} JOIN nodes USING (id) ORDER BY k{ITERATIONS}.score DESC, id LIMIT 20")
def _pagerank_personalized_full(spark, sf_dir):
    found = graph(spark, sf_dir).ranked_context(seeds=SEEDS)
    return found.select("id", "name", "path", F.round("score", 10).alias("score"))


@register("ranked_context_files_full", f"{pagerank_sql(SEEDS_SQL, ITERATIONS)} SELECT id, path, round(score, 10) AS score FROM k{ITERATIONS} JOIN nodes USING (id) WHERE kind = 'file' ORDER BY k{ITERATIONS}.score DESC, id LIMIT 6")
def _ranked_context_files_full(spark, sf_dir):
    found = graph(spark, sf_dir).ranked_context(seeds=SEEDS, kind="file", limit=6)
    return found.select("id", "path", F.round("score", 10).alias("score"))


@register("name_index", f"{GRAPH_SQL} SELECT name, count(*) AS n, string_agg(id, ',' ORDER BY ord) AS ids FROM nodes WHERE symbol_kind = 'type' GROUP BY name")
def _name_index(spark, sf_dir):
    from lodestone.operators.graph import CodeGraph

    typed = nodes(spark, sf_dir).where("symbol_kind = 'type'")
    return CodeGraph(typed, edges(spark, sf_dir), unique_ids=True).name_index().withColumn("ids", F.array_join("ids", ","))


@register("ambiguous_names", f"{GRAPH_SQL} SELECT name, count(*) AS n FROM nodes WHERE kind = 'symbol' GROUP BY name HAVING count(*) > 1")
def _ambiguous_names(spark, sf_dir):
    return graph(spark, sf_dir).symbols().groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


_DEFS_SQL = "defs AS (SELECT p_brand AS file, p_name || ' ' || (p_partkey % 40) AS name, 'p:' || p_partkey AS id, p_partkey AS ord FROM part)"


@register("unique_or_skip", f"""WITH {_DEFS_SQL}, refs AS (SELECT 'x:' || p_partkey AS ref_id, 'Brand#' || (p_partkey % 25 + 1) AS file, p_name || ' ' || (p_size % 40) AS name FROM part),
here AS (SELECT file, name, arg_min(id, ord) AS target FROM defs GROUP BY file, name), single AS (SELECT name, min(id) AS target FROM defs GROUP BY name HAVING count(*) = 1)
SELECT ref_id, file, name, coalesce(here.target, single.target) AS target FROM refs LEFT JOIN here USING (file, name) LEFT JOIN single USING (name) WHERE coalesce(here.target, single.target) IS NOT NULL""")
def _unique_or_skip(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    named = lambda key: F.concat("p_name", F.lit(" "), (F.col(key) % 40).cast("string")).alias("name")
    defs = part.select(F.col("p_brand").alias("file"), named("p_partkey"), F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_partkey").alias("ord"))
    refs = part.select(F.concat(F.lit("x:"), F.col("p_partkey").cast("string")).alias("ref_id"), F.concat(F.lit("Brand#"), (F.col("p_partkey") % 25 + 1).cast("string")).alias("file"), named("p_size"))
    return unique_or_skip(refs, defs)


@register("innermost_range", """WITH ranges AS (SELECT o_custkey AS file, 'o:' || o_orderkey AS range_id, o_orderkey AS start, o_orderkey + (o_orderkey % 7) * 300 AS "end", o_orderkey AS ord FROM orders),
points AS (SELECT o_custkey AS file, o_orderkey AS point_id, o_orderkey + 5 AS at FROM orders)
SELECT p.file, p.point_id, p.at, (SELECT arg_max(range_id, start) FROM ranges r WHERE r.file = p.file AND r.start <= p.at AND p.at <= r."end") AS range_id FROM points p""")
def _innermost_range(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    ranges = orders.select(F.col("o_custkey").alias("file"), F.concat(F.lit("o:"), key.cast("string")).alias("range_id"), key.alias("start"), (key + key % 7 * 300).alias("end"), key.alias("ord"))
    points = orders.select(F.col("o_custkey").alias("file"), key.alias("point_id"), (key + 5).alias("at"))
    return innermost(points, ranges, ["file"]).select("file", "point_id", "at", "range_id")


@register("edge_aggregation", f"SELECT src, dst, max(confidence) AS confidence, CASE WHEN bool_or(is_new) THEN 'new' ELSE 'call' END AS call_kind, count(*) AS call_count, min(line) AS line FROM ({SITES_SQL}) GROUP BY src, dst")
def _edge_aggregation(spark, sf_dir):
    from lodestone.operators.graph import aggregate_calls

    return aggregate_calls(call_sites(spark, sf_dir)).select("src", "dst", "confidence", "call_kind", "call_count", "line")


_STEPS_SQL = "SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst, event_id AS ord FROM events"


@register("edge_dedup", f"SELECT src, dst, 'references' AS kind, min(ord) AS ord FROM ({_STEPS_SQL}) WHERE src <> dst GROUP BY src, dst")
def _edge_dedup(spark, sf_dir):
    from pyspark.sql import Window as W

    after = F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    steps = table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), after.alias("dst"), F.lit("references").alias("kind"), F.col("event_id").alias("ord"))
    return distinct_edges(steps.where("dst is not null"))


@register("dangling_edges", f"{GRAPH_SQL}, few AS (SELECT * FROM nodes WHERE symbol_kind IS NULL OR symbol_kind <> 'class') SELECT src, dst, kind FROM edges WHERE src NOT IN (SELECT id FROM few) OR dst NOT IN (SELECT id FROM few)")
def _dangling_edges(spark, sf_dir):
    from lodestone.operators.graph import CodeGraph

    few = nodes(spark, sf_dir).where("symbol_kind is null or symbol_kind <> 'class'")
    return CodeGraph(few, edges(spark, sf_dir), unique_ids=True).dangling().select("src", "dst", "kind")


@register("language_histogram", f"{GRAPH_SQL} SELECT language, count(*) AS n FROM nodes WHERE kind = 'file' GROUP BY language")
def _language_histogram(spark, sf_dir):
    return graph(spark, sf_dir).language_histogram()
