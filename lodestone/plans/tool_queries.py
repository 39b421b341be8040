"""Queries of the tool, trace, store and retrieval operators over the driver tables."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from lodestone.functions.messages import bearer_column, block_text, missing_scopes, scopes_column
from lodestone.functions.validate import flat_checks, validate_column
from lodestone.operators.retrieval import line_slice, match_names, question_words
from lodestone.operators.tools import graph_capability
from lodestone.plans import register
from lodestone.plans.fkgraph import GRAPH_SQL, graph, table
from lodestone.operators.rank import ITERATIONS
from lodestone.plans.graph_queries import SEEDS, SEEDS_SQL, impact_sql, pagerank_sql
from lodestone.runtime import Runtime, collect_tools, replay_cache
from lodestone.staging import new_path
from lodestone.streaming.spans import fold_spans, stream_spans

@register("scope_missing", "SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda x: NOT list_contains(string_split('small red ' || lower(p_type), ' '), x)), ' ') AS missing FROM part")
def _scope_missing(spark, sf_dir):
    have = F.split(F.concat(F.lit("small red "), F.lower("p_type")), " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(missing_scopes(F.split("p_name", " "), have), " ").alias("missing"))


@register("bearer_scopes", """WITH h AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'bearer ' || c_name ELSE 'Basic ' || c_name END AS header, c_mktsegment || '  read ' AS scope FROM customer)
SELECT c_custkey, nullif(regexp_extract(header, '(?i)^Bearer (.+)$', 1), '') AS token, array_to_string(list_filter(string_split(scope, ' '), lambda s: s <> ''), ',') AS scopes FROM h""")
def _bearer_scopes(spark, sf_dir):
    key = F.col("c_custkey")
    header = F.when(key % 3 == 0, None).when(key % 2 == 0, F.concat(F.lit("bearer "), "c_name")).otherwise(F.concat(F.lit("Basic "), "c_name"))
    scope = F.concat("c_mktsegment", F.lit("  read "))
    return table(spark, sf_dir, "customer").select("c_custkey", bearer_column(header).alias("token"), F.array_join(scopes_column(scope), ",").alias("scopes"))


@register("block_text", "SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS text FROM conversations GROUP BY conv_id")
def _block_text(spark, sf_dir):
    kind = F.when(F.col("role") == "assistant", "text").otherwise("other")
    block = F.struct("turn", kind.alias("type"), "text")
    blocks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    return blocks.select("conv_id", block_text(F.col("blocks")).alias("text"))


_SCHEMA = {"type": "object", "required": ["k"], "additionalProperties": False, "properties": {"k": {"type": "integer", "enum": list(range(50))}}}
_VALID_SQL = "CAST(json_extract(props, '$.k') AS INTEGER) BETWEEN 0 AND 49"


@register("json_validate", f"SELECT event_id, {_VALID_SQL} AS valid, CASE WHEN {_VALID_SQL} THEN '' ELSE '/k: value is not one of the allowed enum values' END AS errors FROM events")
def _json_validate(spark, sf_dir):
    found = table(spark, sf_dir, "events").select("event_id", validate_column(F.col("props"), _SCHEMA).alias("r"))
    return found.select("event_id", "r.valid", F.array_join(F.transform("r.errors", lambda e: F.concat(e["path"], F.lit(": "), e["message"])), "; ").alias("errors"))


@register("json_validate_native", f"SELECT event_id, {_VALID_SQL} AS valid FROM events")
def _json_validate_native(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", flat_checks(F.parse_json("props"), _SCHEMA).alias("valid"))


#: event_type -> type of the trace event that stands for it.
_TRACE = {"signup": "runtime:start", "view": "tool:start", "click": "tool:end", "purchase": "runtime:end", "error": "runtime:error"}


def _trace_events(events):
    kind = F.create_map(*[F.lit(x) for pair in _TRACE.items() for x in pair])[F.col("event_type")]
    data = F.create_map(F.lit("toolId"), F.concat(F.lit("tool"), (F.col("event_id") % 3).cast("string")), F.lit("code"), F.concat(F.lit("E"), (F.col("event_id") % 5).cast("string")))
    return events.select(kind.alias("type"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.col("user_id").cast("string").alias("runId"), data.alias("data"), F.col("event_id").alias("ord"))


_SPANS_SQL = """WITH e AS (SELECT CASE event_type WHEN 'signup' THEN 's' WHEN 'view' THEN 'tool:start' WHEN 'click' THEN 'tool:end' WHEN 'purchase' THEN 'ok' ELSE 'bad' END AS type, epoch_us(ts) // 1000 AS t, CAST(user_id AS VARCHAR) AS run, event_id FROM events),
g AS (SELECT *, sum(CASE WHEN type = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY t, event_id) AS no FROM e),
f AS (SELECT *, coalesce(sum(CASE WHEN type IN ('ok', 'bad') THEN 1 ELSE 0 END) OVER (PARTITION BY run, no ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM g WHERE no > 0)
SELECT run AS "runId", 'execute_tool tool' || min(event_id % 3) FILTER (WHERE type = 's') AS name, min(t) FILTER (WHERE type = 's') AS start_ms, max(t) FILTER (WHERE type IN ('ok', 'bad')) AS end_ms,
    CASE max(type) FILTER (WHERE type IN ('ok', 'bad')) WHEN 'ok' THEN 'OK' ELSE 'ERROR' END AS status, 'E' || max(event_id % 5) FILTER (WHERE type = 'bad') AS error,
    coalesce(string_agg(type, ',' ORDER BY t, event_id) FILTER (WHERE type LIKE 'tool:%'), '') AS events
FROM f WHERE ended = 0 GROUP BY run, no HAVING count(*) FILTER (WHERE type IN ('ok', 'bad')) > 0"""


@register("trace_to_span", _SPANS_SQL)
def _trace_to_span(spark, sf_dir):
    return fold_spans(_trace_events(table(spark, sf_dir, "events"))).drop("tool").withColumn("events", F.array_join("events", ","))


@contextmanager
def _state_provider(spark):
    """The state store that the span stream needs, for as long as the query runs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@register("trace_stream", _SPANS_SQL)
def _trace_stream(spark, sf_dir):
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    out, marks = new_path(spark, "spans"), new_path(spark, "spans-state")
    with _state_provider(spark):
        stream = stream_spans(_trace_events(rows)).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
        stream.awaitTermination()
    return spark.read.parquet(out).drop("tool").withColumn("events", F.array_join("events", ","))


#: The log of one cache in order, its entries as a list from least to most recently used, one step a row.
_REPLAY_SQL = """WITH RECURSIVE ops AS (SELECT CAST(user_id AS VARCHAR) AS cache, event_id AS seq, CASE event_type WHEN 'view' THEN 'get' WHEN 'click' THEN 'set' WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'has' ELSE 'set' END AS op,
    CAST(event_id % 5 AS VARCHAR) AS key, CAST(value AS VARCHAR) AS value, epoch_us(ts) // 1000 AS moment, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events),
steps AS (
    SELECT cache, 0::BIGINT AS nth, NULL::BIGINT AS seq, '' AS op, '' AS key, CAST(NULL AS VARCHAR) AS result, CAST([] AS STRUCT(k VARCHAR, v VARCHAR, e BIGINT)[]) AS held FROM (SELECT DISTINCT cache FROM ops)
    UNION ALL
    SELECT cache, nth, seq, op, key,
        CASE op WHEN 'get' THEN hit[1].v WHEN 'has' THEN CASE WHEN len(hit) > 0 THEN 'true' ELSE 'false' END END,
        CASE op WHEN 'get' THEN others || hit WHEN 'has' THEN CASE WHEN len(hit) > 0 THEN held ELSE others END WHEN 'delete' THEN others
            ELSE list_slice(others || [{'k': key, 'v': value, 'e': moment + 3600000}], greatest(1, len(others) - 1), len(others) + 1) END
    FROM (SELECT o.*, s.held, list_filter(s.held, lambda x: x.k <> o.key) AS others, list_filter(s.held, lambda x: x.k = o.key AND x.e > o.moment) AS hit FROM steps s JOIN ops o ON o.cache = s.cache AND o.nth = s.nth + 1)
)
SELECT cache, seq, op, key, result FROM steps WHERE nth > 0"""


@register("cache_replay", _REPLAY_SQL)
def _cache_replay(spark, sf_dir):
    op = F.when(F.col("event_type") == "view", "get").when(F.col("event_type") == "click", "set").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "has").otherwise("set")
    ops = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("cache"), F.col("event_id").alias("seq"), op.alias("op"), (F.col("event_id") % 5).cast("string").alias("key"), F.col("value").cast("string").alias("value"), F.unix_millis(F.col("ts").cast("timestamp")).cast("double").alias("at_ms"))
    return replay_cache(ops, max_size=3, ttl_ms=3_600_000)


_QUESTION = "Which small rings and RED things matter?"


@register("seed_match", "SELECT DISTINCT p_name AS name FROM part WHERE " + " OR ".join(f"contains(lower(p_name), '{w}') OR contains('{w}', lower(p_name))" for w in ("which", "small", "rings", "things", "matter")))
def _seed_match(spark, sf_dir):
    return match_names(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")), question_words(_QUESTION))


@register("context_slice", "SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS snippet FROM documents")
def _context_slice(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", line_slice(F.col("text"), F.lit(2), F.lit(4)).alias("snippet"))


def _runtime(spark, sf_dir) -> Runtime:
    return Runtime(collect_tools([graph_capability(lambda: graph(spark, sf_dir))]), spark=spark)


@register("tool_callers", f"{impact_sql('s:3', 'dst', 'src', 1)} SELECT id, name, path AS file, depth, round(confidence, 2) AS confidence FROM reached JOIN nodes USING (id) ORDER BY reached.confidence DESC, id LIMIT 25")
def _tool_callers(spark, sf_dir):
    return _runtime(spark, sf_dir).execute_tool("codegraph_callers", {"symbol": "s:3"}).select("id", "name", "file", "depth", "confidence")


@register("tool_callees", f"{impact_sql('o:42', 'src', 'dst', 1)} SELECT id, name, path AS file, depth, round(confidence, 2) AS confidence FROM reached JOIN nodes USING (id) ORDER BY reached.confidence DESC, id LIMIT 3")
def _tool_callees(spark, sf_dir):
    return _runtime(spark, sf_dir).execute_tool("codegraph_callees", {"symbol": "o:42", "limit": 3}).select("id", "name", "file", "depth", "confidence")


#: A walk from a region over everything that calls into it, and one that the cap cuts.
def _impact_rows(found):
    nodes = F.transform("nodes", lambda n: F.concat_ws(":", n["id"], n["confidence"].cast("string"), F.coalesce(n["file"], n["path"])))
    return found.select("depth", F.array_join(nodes, ",").alias("nodes"), "truncated")


_IMPACT_ROWS = "SELECT depth, string_agg(id || ':' || round(r.confidence, 2) || ':' || path, ',' ORDER BY round(r.confidence, 2) DESC, id) AS nodes"


@register("tool_impact", f"{impact_sql('n:2', 'dst', 'src', 5, 0.6)} {_IMPACT_ROWS}, FALSE AS truncated FROM reached r JOIN nodes USING (id) GROUP BY depth")
def _tool_impact(spark, sf_dir):
    return _impact_rows(_runtime(spark, sf_dir).execute_tool("codegraph_impact", {"symbol": "n:2", "maxNodes": 10**9, "minConfidence": 0.6}))


@register("tool_impact_truncated", f"{impact_sql('r:0', 'dst', 'src', 3)}, few AS (SELECT * FROM reached ORDER BY depth, confidence DESC, id LIMIT 40) {_IMPACT_ROWS}, TRUE AS truncated FROM few r JOIN nodes USING (id) GROUP BY depth")
def _tool_impact_truncated(spark, sf_dir):
    return _impact_rows(_runtime(spark, sf_dir).execute_tool("codegraph_impact", {"symbol": "r:0", "maxNodes": 40, "maxDepth": 3}))


@register("tool_affected", f"{impact_sql('n:2', 'dst', 'src', 2)} SELECT r.id, name, path AS file, depth, round(r.confidence, 2) AS confidence FROM reached r JOIN nodes n USING (id) WHERE regexp_matches(lower(n.path), '(\\.test\\.|\\.spec\\.|_test\\.|_spec\\.|/tests?/|/__tests__/)')")
def _tool_affected(spark, sf_dir):
    return _runtime(spark, sf_dir).execute_tool("codegraph_affected", {"symbol": "n:2", "maxDepth": 2, "maxNodes": 10**9}).select("id", "name", "file", "depth", "confidence")


@register("tool_find_definition", f"{GRAPH_SQL} SELECT id, kind, name, symbol_kind AS \"symbolKind\", path AS file, start_line AS \"startLine\", end_line AS \"endLine\" FROM nodes WHERE kind = 'symbol' AND name = 'small ring'")
def _tool_find_definition(spark, sf_dir):
    return _runtime(spark, sf_dir).execute_tool("codegraph_find_definition", {"name": "small ring"}).drop("path", "language")


_FIRST = "SELECT n.id, name, path AS file, min(e.ord) AS place FROM edges e JOIN nodes n ON n.id = e.src WHERE e.kind = 'references' AND e.dst IN (SELECT id FROM nodes WHERE kind = 'symbol' AND name = 'red widget') GROUP BY n.id, name, path ORDER BY place"


@register("tool_find_references", f"{GRAPH_SQL}, found AS ({_FIRST} LIMIT 25) SELECT id, name, file FROM found")
def _tool_find_references(spark, sf_dir):
    return _runtime(spark, sf_dir).execute_tool("codegraph_find_references", {"symbol": "red widget"}).select("id", "name", "file")


@register("tool_negative_limit", f"{GRAPH_SQL}, found AS ({_FIRST}) SELECT id, name, file FROM found ORDER BY place LIMIT (SELECT greatest(0, count(*) - 5) FROM found)")
def _tool_negative_limit(spark, sf_dir):
    return _runtime(spark, sf_dir).execute_tool("codegraph_find_references", {"symbol": "red widget", "limit": -5}).select("id", "name", "file")


@register("tool_neighbors", f"{GRAPH_SQL} SELECT id, n.kind, CASE WHEN n.kind = 'symbol' THEN path END AS file, CASE WHEN n.kind = 'file' THEN path END AS path, language FROM (SELECT src AS id, min(ord) AS place FROM edges WHERE dst = 'n:4' AND kind IN ('calls', 'imports') GROUP BY src ORDER BY place LIMIT 4) JOIN nodes n USING (id)")
def _tool_neighbors(spark, sf_dir):
    found = _runtime(spark, sf_dir).execute_tool("codegraph_neighbors", {"id": "n:4", "direction": "incoming", "edgeKinds": ["calls", "imports"], "limit": 4})
    return found.select("id", "kind", "file", "path", "language")


@register("tool_file_summary", f"{GRAPH_SQL} SELECT 'n:3' AS file_id, 'geo/NATION_3' AS path, count(*) FILTER (WHERE kind = 'contains') AS symbols, count(*) FILTER (WHERE kind = 'imports') AS imports FROM edges WHERE src = 'n:3'")
def _tool_file_summary(spark, sf_dir):
    found = _runtime(spark, sf_dir).execute_tool("codegraph_file_summary", {"path": "geo/NATION_3"})
    return found.select("file_id", "path", F.size("symbols").cast("long").alias("symbols"), F.size("imports").cast("long").alias("imports"))


@register("tool_relevant_context", f"{pagerank_sql(SEEDS_SQL, ITERATIONS)} SELECT id, name, round(score, 10) AS score FROM k{ITERATIONS} JOIN nodes USING (id) WHERE kind = 'symbol' ORDER BY k{ITERATIONS}.score DESC, id LIMIT 7")
def _tool_relevant_context(spark, sf_dir):
    found = _runtime(spark, sf_dir).execute_tool("codegraph_relevant_context", {"seeds": SEEDS, "kind": "symbol", "limit": 7})
    return found.select("id", "name", F.round("score", 10).alias("score"))


@register("tool_search_symbols", f"{GRAPH_SQL} SELECT id, name, symbol_kind AS \"symbolKind\", path AS file, start_line AS \"startLine\" FROM nodes WHERE symbol_kind = 'interface' AND contains(lower(name), '00') ORDER BY ord LIMIT 7")
def _tool_search_symbols(spark, sf_dir):
    found = _runtime(spark, sf_dir).execute_tool("codegraph_search_symbols", {"name": "00", "kind": "interface", "limit": 7})
    return found.select("id", "name", "symbolKind", "file", "startLine")
