import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodestone.operators.graph import CodeGraph, aggregate_calls, distinct_edges, innermost, unique_or_skip
from lodestone.operators.rank import pagerank
from lodestone.schema import EDGES, NODES
from lodestone.streaming.spans import fold_spans

QUIET = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
IDS = st.sampled_from("abcdefgh")
EDGE = st.tuples(IDS, IDS, st.sampled_from(["calls", "references", "imports"]), st.sampled_from([None, 0.5, 0.8, 1.0]))


def make(spark, nodes, edges):
    rows = [(i, "symbol", f"n{i}", "function", f"{i}.py", None, 1, 2, k) for k, i in enumerate(nodes)]
    links = [(a, b, kind, c, None, None, None, None, k) for k, (a, b, kind, c) in enumerate(edges)]
    return CodeGraph(spark.createDataFrame(rows, NODES), spark.createDataFrame(links, EDGES))


def brute_impact(nodes, edges, start, depth, cap, least):
    seen, frontier, out = {start}, {start: 1.0}, {}
    for d in range(1, depth + 1):
        level = {}
        for a, b, kind, c in edges:
            c = c or 0
            if kind == "calls" and c >= least and b in frontier and a not in seen and a in nodes:
                level[a] = max(level.get(a, 0), min(frontier[b], c))
        kept = sorted(level.items(), key=lambda x: (-x[1], x[0]))[: cap - len(out)]
        out |= {i: (d, c) for i, c in kept}
        if len(kept) < len(level) or not level:
            break
        seen |= set(level)
        frontier = level
    return out


@QUIET
@given(nodes=st.sets(IDS, min_size=1), edges=st.lists(EDGE, max_size=25), cap=st.sampled_from([2, 200]), least=st.sampled_from([0, 0.6]))
def test_impact_on_any_graph(spark, nodes, edges, cap, least):
    start = min(nodes)
    found = make(spark, sorted(nodes), edges).impact(start, max_depth=3, max_nodes=cap, min_confidence=least)
    assert {r.id: (r.depth, r.confidence) for r in found.rows.collect()} == brute_impact(nodes, edges, start, 3, cap, least)


def brute_rank(nodes, edges, seeds, rounds):
    at = {x: k for k, x in enumerate(nodes)}
    links = [(at[a], at[b]) for a, b, *_ in edges if a in at and b in at]
    n, out = len(nodes), [sum(a == k for a, _ in links) for k in range(len(nodes))]
    jump = np.array([1.0 if x in seeds else 0.0 for x in nodes])
    jump = jump / jump.sum() if jump.any() else np.full(n, 1 / n)
    rank = np.full(n, 1 / n)
    for _ in range(rounds):
        new = 0.15 * jump + 0.85 * sum(rank[k] for k in range(n) if not out[k]) * jump
        for a, b in links:
            new[b] += 0.85 * rank[a] / out[a]
        done = abs(new - rank).sum() < 1e-6
        rank = new
        if done:
            break
    return dict(zip(nodes, rank))


def test_both_pageranks_agree_with_plain_python(spark):
    nodes = list("abcdefg")
    edges = [("a", "b", "calls", 1.0), ("a", "b", "references", None), ("b", "c", "calls", 1.0), ("c", "a", "imports", None), ("d", "a", "calls", 0.5), ("e", "zz", "calls", 1.0), ("f", "f", "references", None)]
    graph = make(spark, nodes, edges)
    for seeds in ([], ["a", "nd"]):
        expected = brute_rank(nodes, edges, {"a", "d"} if seeds else set(), 5)
        for limit in (10**6, 0):
            found = pagerank(graph, seeds=seeds, limit=None, iterations=5, kernel_links=limit)
            assert {r.id: round(r.score, 12) for r in found.collect()} == {k: round(v, 12) for k, v in expected.items()}
    best = [r.id for r in pagerank(graph, seeds=["a"], limit=2).collect()]
    assert best == sorted(brute_rank(nodes, edges, {"a"}, 50), key=lambda k: -brute_rank(nodes, edges, {"a"}, 50)[k])[:2]
    assert pagerank(graph, limit=-3).count() == 0 and pagerank(make(spark, [], []), limit=3).count() == 0


def test_colliding_ids(spark):
    rows = [("x", "symbol", "one", "function", "a", None, 1, 1, 0), ("y", "symbol", "n", "class", "a", None, 1, 1, 1), ("x", "symbol", "two", "method", "a", None, 1, 1, 2)]
    graph = CodeGraph(spark.createDataFrame(rows, NODES), spark.createDataFrame([], EDGES))
    assert [(r.id, r.name, r.ord) for r in graph.nodes().orderBy("ord").collect()] == [("x", "two", 0), ("y", "n", 1)]
    assert graph.find_definition("one").count() == 1 and {r.name: r.n for r in graph.name_index().collect()} == {"one": 1, "two": 1, "n": 1}


def test_json_round_trip(spark, tmp_path):
    graph = make(spark, "abc", [("a", "b", "calls", 0.8), ("b", "c", "imports", None)])
    graph.write_json(str(tmp_path))
    back = CodeGraph.read_json(spark, str(tmp_path))
    assert sorted(back.nodes().collect()) == sorted(graph.nodes().collect()) and sorted(map(str, back.edges().collect())) == sorted(map(str, graph.edges().collect()))


def test_small_operators(spark):
    ranges = spark.createDataFrame([("f", "outer", 0, 100, 0), ("f", "inner", 10, 20, 1), ("f", "twin", 10, 30, 2), ("g", "other", 0, 5, 3)], "file string, range_id string, start int, end int, ord int")
    points = spark.createDataFrame([(1, "f", 10), (2, "f", 20), (3, "f", 25), (4, "f", 31), (5, "g", 6), (6, "h", 1)], "point_id int, file string, at int")
    assert {r.point_id: r.range_id for r in innermost(points, ranges, ["file"]).collect()} == {1: "inner", 2: "inner", 3: "twin", 4: "outer", 5: None, 6: None}
    defs = spark.createDataFrame([("a", "x", "ax", 1), ("a", "x", "ax2", 0), ("b", "x", "bx", 2), ("b", "y", "by", 3)], "file string, name string, id string, ord int")
    refs = spark.createDataFrame([("r1", "a", "x"), ("r2", "c", "x"), ("r3", "c", "y"), ("r4", "c", "z")], "ref_id string, file string, name string")
    assert {r.ref_id: r.target for r in unique_or_skip(refs, defs).collect()} == {"r1": "ax2", "r3": "by"}
    sites = spark.createDataFrame([("a", "b", 0.5, False, 9, "T", 2), ("a", "b", 1.0, True, 7, "U", 3), ("a", "a", 1.0, False, 1, None, 1)], "src string, dst string, confidence double, is_new boolean, line int, receiver_type string, ord long")
    row = aggregate_calls(sites).collect()
    assert [(r.confidence, r.call_kind, r.call_count, r.line, r.receiver_type) for r in row] == [(1.0, "new", 2, 7, "T")]
    edges = spark.createDataFrame([("a", "b", "k", 2), ("a", "b", "k", 1), ("a", "a", "k", 0), ("a", "b", "j", 3)], "src string, dst string, kind string, ord long")
    assert sorted(r.ord for r in distinct_edges(edges).collect()) == [1, 3]


def test_spans(spark):
    e = lambda kind, t, run, **data: (kind, t, run, data, t)
    events = [
        e("tool:start", 1, "lost"), e("runtime:end", 2, "lost"), e("runtime:start", 3, "a", toolId="x"), e("tool:start", 4, "a"), e("guardrail:blocked", 5, "a"), e("tool:error", 6, "a"), e("tool:error", 7, "a", cause="c"),
        e("runtime:error", 8, "a", code="C"), e("tool:end", 9, "a"), e("runtime:start", 10, "a"), e("runtime:start", 11, "a"), e("runtime:end", 12, "a"), e("runtime:start", 13, "open", toolId="y"),
    ]
    frame = spark.createDataFrame(events, "type string, timestamp long, runId string, data map<string,string>, ord long")
    found = sorted(tuple(r) for r in fold_spans(frame).drop("tool").collect())
    assert found == [("a", "execute_tool", 11, 12, "OK", None, []), ("a", "execute_tool x", 3, 8, "ERROR", "C", ["tool:start", "guardrail:blocked", "exception"])]
