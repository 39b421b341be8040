import __spark_entry__

DIR = "/root/testdata/sf0.001"
SEEDS = ("o:7", "Supplier#000000003", "geo/NATION_1")


def plain(nodes, edges, seeds):
    """Fifty rounds, or until one moves less than 1e-6."""
    ids = [r.id for r in nodes]
    chosen = {r.id for r in nodes if r.id in seeds or (r.kind == "symbol" and r.name in seeds) or (r.kind == "file" and r.path in seeds)} or set(ids)
    out = {i: [] for i in ids}
    for r in edges:
        if r.src in out and r.dst in out:
            out[r.src].append(r.dst)
    score, rounds = dict.fromkeys(ids, 1 / len(ids)), 0
    for rounds in range(1, 51):
        idle, new = sum(score[i] for i in ids if not out[i]), dict.fromkeys(ids, 0.0)
        for i in ids:
            for k in out[i]:
                new[k] += 0.85 * score[i] / len(out[i])
        for i in chosen:
            new[i] += (0.15 + 0.85 * idle) / len(chosen)
        delta, score = sum(abs(new[i] - score[i]) for i in ids), new
        if delta < 1e-6:
            break
    return score


def test_full_rankings_run_the_operators_rounds(spark):
    queries = __spark_entry__.queries()
    nodes, edges = queries["nodes"](spark, DIR).collect(), queries["edges"](spark, DIR).collect()
    whole, seeded = plain(nodes, edges, ()), plain(nodes, edges, SEEDS)
    found = {r.id: r.score for r in queries["pagerank_global_full"](spark, DIR).collect()}
    assert found.keys() == whole.keys() and all(abs(found[i] - s) < 2e-10 for i, s in whole.items())
    files = {r.id for r in nodes if r.kind == "file"}
    for name, limit, among in (("pagerank_personalized_full", 20, set(seeded)), ("ranked_context_files_full", 6, files)):
        rows = queries[name](spark, DIR).collect()
        assert len(rows) == limit and all(abs(r.score - seeded[r.id]) < 2e-10 for r in rows)
        assert sorted((seeded[i] for i in among), reverse=True)[limit - 1] <= min(r.score for r in rows) + 2e-10
    assert [r.score for r in __spark_entry__.entry(spark).collect()] == [r.score for r in queries["pagerank_personalized_full"](spark, DIR).collect()]
