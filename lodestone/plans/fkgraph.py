"""The property graph in the foreign keys of the relational tables, and the same graph in SQL.

Regions and nations are files, customers, suppliers, parts and orders symbols. An order calls its suppliers with the
best confidence of its lines; suppliers call their nation and nations their region, so impact walks from a region reach
most orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.graph import CodeGraph

#: Distance between the ord of one group of rows and the next, and between rows of one order.
GROUP, PAIR = 10**15, 10**6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(prefix: str, key: str, kind: str, name, symbol_kind: str | None, path, language: str | None, group: int):
    text = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x
    line = (F.col(key) % 1000 + 1).cast("int") if kind == "symbol" else F.lit(None).cast("int")
    return [
        F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), text(name).alias("name"), text(symbol_kind).alias("symbol_kind"),
        text(path).alias("path"), text(language).alias("language"), line.alias("start_line"), (line + 9).alias("end_line"), (F.lit(group * GROUP) + F.col(key)).cast("long").alias("ord"),
    ]


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    order_path = F.when(F.col("o_orderstatus") == "F", "src/tests/orders.py").when(F.col("o_orderstatus") == "O", "src/orders.spec.ts").otherwise("src/orders.py")
    parts = [
        table(spark, sf_dir, "region").select(_node("r:", "r_regionkey", "file", None, None, F.concat(F.lit("geo/"), "r_name"), "region", 0)),
        table(spark, sf_dir, "nation").select(_node("n:", "n_nationkey", "file", None, None, F.concat(F.lit("geo/"), "n_name"), "nation", 1)),
        table(spark, sf_dir, "customer").select(_node("c:", "c_custkey", "symbol", F.col("c_name"), "class", "src/customers.py", None, 2)),
        table(spark, sf_dir, "supplier").select(_node("s:", "s_suppkey", "symbol", F.col("s_name"), "interface", "src/suppliers.py", None, 3)),
        table(spark, sf_dir, "part").select(_node("p:", "p_partkey", "symbol", F.col("p_name"), "type", "lib/parts.test.py", None, 4)),
        table(spark, sf_dir, "orders").select(_node("o:", "o_orderkey", "symbol", F.concat(F.lit("order "), "o_orderpriority"), "function", order_path, None, 5)),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _edge(src: tuple[str, str], dst: tuple[str, str], kind: str, ord_, confidence: float | None = None):
    end = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))
    call = confidence is not None
    return [
        end(*src).alias("src"), end(*dst).alias("dst"), F.lit(kind).alias("kind"), F.lit(confidence).cast("double").alias("confidence"), F.lit("call" if call else None).cast("string").alias("call_kind"),
        F.lit(None).cast("string").alias("receiver_type"), F.lit(1 if call else None).cast("long").alias("call_count"), F.lit(1 if call else None).cast("int").alias("line"), ord_.cast("long").alias("ord"),
    ]


def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line item: which supplier its order calls, how surely, and where."""
    confidence = F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "N", 0.8).otherwise(0.5)
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("dst"), confidence.alias("confidence"),
        "l_orderkey", "l_suppkey", (F.col("l_linestatus") == "O").alias("is_new"), F.col("l_linenumber").alias("line"), F.lit(None).cast("string").alias("receiver_type"), (F.lit(6 * GROUP) + F.col("l_orderkey") * PAIR + F.col("l_suppkey")).cast("long").alias("ord"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda group, *keys: F.lit(group * GROUP) + sum((F.col(k) * PAIR ** (len(keys) - 1 - i) for i, k in enumerate(keys)), F.lit(0))
    references = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    # aggregated by the numeric keys, which hash aggregation takes; ids are spelt out afterwards
    sites = call_sites(spark, sf_dir).groupBy("l_orderkey", "l_suppkey").agg(F.max("confidence").alias("confidence"), F.max("is_new").alias("is_new"), F.count("*").alias("call_count"), F.min("line").alias("line"), F.min("ord").alias("ord"))
    calls = sites.select(
        F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("dst"), F.lit("calls").alias("kind"), "confidence",
        F.when(F.col("is_new"), "new").otherwise("call").alias("call_kind"), F.lit(None).cast("string").alias("receiver_type"), "call_count", "line", "ord",
    )
    parts = [
        table(spark, sf_dir, "nation").select(_edge(("r:", "n_regionkey"), ("n:", "n_nationkey"), "contains", at(0, "n_nationkey"))),
        table(spark, sf_dir, "customer").select(_edge(("n:", "c_nationkey"), ("c:", "c_custkey"), "contains", at(1, "c_custkey"))),
        table(spark, sf_dir, "supplier").select(_edge(("n:", "s_nationkey"), ("s:", "s_suppkey"), "contains", at(2, "s_suppkey"))),
        table(spark, sf_dir, "nation").select(_edge(("n:", "n_nationkey"), ("r:", "n_regionkey"), "imports", at(3, "n_nationkey"))),
        table(spark, sf_dir, "orders").select(_edge(("c:", "o_custkey"), ("o:", "o_orderkey"), "imports", at(4, "o_orderkey"))),
        references.select(_edge(("o:", "l_orderkey"), ("p:", "l_partkey"), "references", at(5, "l_orderkey", "l_partkey"))),
        table(spark, sf_dir, "supplier").select(_edge(("s:", "s_suppkey"), ("n:", "s_nationkey"), "calls", at(7, "s_suppkey"), 1.0)),
        table(spark, sf_dir, "nation").select(_edge(("n:", "n_nationkey"), ("r:", "n_regionkey"), "calls", at(8, "n_nationkey"), 0.8)),
    ]
    out = calls
    for more in parts:
        out = out.unionByName(more)
    return out


def graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    return CodeGraph(nodes(spark, sf_dir), edges(spark, sf_dir), unique_ids=True)


def _node_sql(name: str, prefix: str, key: str, kind: str, label: str, symbol_kind: str, path: str, language: str, group: int) -> str:
    line = f"CAST({key} % 1000 + 1 AS INTEGER)" if kind == "symbol" else "CAST(NULL AS INTEGER)"
    return f"SELECT '{prefix}' || {key} AS id, '{kind}' AS kind, {label} AS name, {symbol_kind} AS symbol_kind, {path} AS path, {language} AS language, {line} AS start_line, {line} + 9 AS end_line, CAST({group * GROUP} + {key} AS BIGINT) AS ord FROM {name}"


def _edge_sql(name: str, src: str, dst: str, kind: str, ord_: str, confidence: str = "NULL") -> str:
    one = "NULL" if confidence == "NULL" else "1"
    call = "NULL" if confidence == "NULL" else "'call'"
    return f"SELECT {src} AS src, {dst} AS dst, '{kind}' AS kind, CAST({confidence} AS DOUBLE) AS confidence, CAST({call} AS VARCHAR) AS call_kind, CAST(NULL AS VARCHAR) AS receiver_type, CAST({one} AS BIGINT) AS call_count, CAST({one} AS INTEGER) AS line, CAST({ord_} AS BIGINT) AS ord FROM {name}"


NODES_SQL = "\nUNION ALL ".join(
    [
        _node_sql("region", "r:", "r_regionkey", "file", "NULL", "NULL", "'geo/' || r_name", "'region'", 0),
        _node_sql("nation", "n:", "n_nationkey", "file", "NULL", "NULL", "'geo/' || n_name", "'nation'", 1),
        _node_sql("customer", "c:", "c_custkey", "symbol", "c_name", "'class'", "'src/customers.py'", "NULL", 2),
        _node_sql("supplier", "s:", "s_suppkey", "symbol", "s_name", "'interface'", "'src/suppliers.py'", "NULL", 3),
        _node_sql("part", "p:", "p_partkey", "symbol", "p_name", "'type'", "'lib/parts.test.py'", "NULL", 4),
        _node_sql("orders", "o:", "o_orderkey", "symbol", "'order ' || o_orderpriority", "'function'", "CASE o_orderstatus WHEN 'F' THEN 'src/tests/orders.py' WHEN 'O' THEN 'src/orders.spec.ts' ELSE 'src/orders.py' END", "NULL", 5),
    ]
)
SITES_SQL = f"""SELECT 'o:' || l_orderkey AS src, 's:' || l_suppkey AS dst, CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence,
    l_linestatus = 'O' AS is_new, l_linenumber AS line, CAST({6 * GROUP} + l_orderkey * {PAIR} + l_suppkey AS BIGINT) AS ord FROM lineitem"""
EDGES_SQL = "\nUNION ALL ".join(
    [
        f"""SELECT src, dst, 'calls' AS kind, max(confidence) AS confidence, CASE WHEN bool_or(is_new) THEN 'new' ELSE 'call' END AS call_kind, CAST(NULL AS VARCHAR) AS receiver_type,
    count(*) AS call_count, min(line) AS line, min(ord) AS ord FROM ({SITES_SQL}) GROUP BY src, dst""",
        _edge_sql("nation", "'r:' || n_regionkey", "'n:' || n_nationkey", "contains", "n_nationkey"),
        _edge_sql("customer", "'n:' || c_nationkey", "'c:' || c_custkey", "contains", f"{GROUP} + c_custkey"),
        _edge_sql("supplier", "'n:' || s_nationkey", "'s:' || s_suppkey", "contains", f"{2 * GROUP} + s_suppkey"),
        _edge_sql("nation", "'n:' || n_nationkey", "'r:' || n_regionkey", "imports", f"{3 * GROUP} + n_nationkey"),
        _edge_sql("orders", "'c:' || o_custkey", "'o:' || o_orderkey", "imports", f"{4 * GROUP} + o_orderkey"),
        _edge_sql("(SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)", "'o:' || l_orderkey", "'p:' || l_partkey", "references", f"{5 * GROUP} + l_orderkey * {PAIR} + l_partkey"),
        _edge_sql("supplier", "'s:' || s_suppkey", "'n:' || s_nationkey", "calls", f"{7 * GROUP} + s_suppkey", "1.0"),
        _edge_sql("nation", "'n:' || n_nationkey", "'r:' || n_regionkey", "calls", f"{8 * GROUP} + n_nationkey", "0.8"),
    ]
)
#: The graph as two common table expressions, for queries that go on with SELECT or further ones after a comma.
GRAPH_SQL = f"WITH nodes AS MATERIALIZED (\n{NODES_SQL}\n), edges AS MATERIALIZED (\n{EDGES_SQL}\n)"
