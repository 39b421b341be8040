import re

import xxhash

from lodestone.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component_id string"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    rows = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in rows]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """[(id, fp)] -> ids' smallest reachable id, comparing all pairs."""
    ids, root = list(range(len(fps))), list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids[:i]:
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= 2:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i in ids:
        if fps[i][0] is not None:
            least[find(i)] = min(least.get(find(i), fps[i][0]), fps[i][0])
    return [least.get(find(i)) for i in ids]


def check(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    found = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    fps = [(i, brute_fingerprint(t)) for i, t, *_ in rows]
    assert found == sorted(((i, fp, c) for (i, fp), c in zip(fps, brute_components(fps))), key=str)


def test_masks_cover_every_pair_of_bits():
    for radius in (1, 2):
        masks = simhash.covering_masks(radius)
        for i in range(64):
            for j in range(i if radius == 2 else i, i + 1 if radius == 1 else 64):
                assert any(not (m >> i & 1) and not (m >> j & 1) for m in masks)
        assert max(bin(m).count("1") for m in masks) - min(bin(m).count("1") for m in masks) <= 5


def test_real_documents_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    check(spark, [(r.doc_id, r.text, "x", "y") for r in docs])


def test_nulls_empty_ties_and_clashing_columns(spark):
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, None, "a", "b"), (2, "", "a", "b"), (3, " \t\n", "a", "b"), (4, "One", None, None), (4, "one", None, None), (5, "one two", "", ""), (None, "one two", "", ""), (6, long, "", ""), (7, long + " tail", "", ""), (None, "lonely text here", "", ""), (8, "É é x", "", "")]
    check(spark, rows)


def test_chains_of_links(spark, monkeypatch):
    import random

    draw = random.Random(7)
    centre = draw.getrandbits(64)
    values = {centre, 0, 1, 3, 2**64 - 1}
    for k in range(20):
        centre ^= 1 << k
        values.add(centre)
    values |= {draw.getrandbits(64) ^ 0 for _ in range(50)}
    values |= {v ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for v in list(values)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    from lodestone.llm.components import connected

    roots = {r.node: r.root for r in connected(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()}
    order = sorted(v[0] for v in signed)
    brute = brute_components([(s, s & (2**64 - 1)) for s in order])
    assert [roots.get(s, s) for s in order] == brute


def test_small_and_large_buckets_link_alike(spark):
    """Buckets compared in place, split by flips, and a mixture give the links' components that all pairs give."""
    import random

    from lodestone.llm.components import connected

    draw = random.Random(11)
    low = [k for k in range(64) if not simhash.covering_masks()[0] >> k & 1]
    base = draw.getrandbits(64)
    values = {base}
    while len(values) < 150:  # all in one bucket of the first table
        values.add(base ^ sum(1 << k for k in draw.sample(low, draw.choice((1, 2, 3, 6)))))
    values |= {draw.getrandbits(64) for _ in range(100)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    for radius in (1, 2):
        brute = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= radius}
        compared = {tuple(sorted(r)) for r in simhash.links(frame, radius, bucket=1000).collect()}
        assert compared == brute
        whole = {r.node: r.root for r in connected(simhash.links(frame, radius, bucket=1000)).collect()}
        for bucket in (1, 32):
            found = simhash.links(frame, radius, bucket)
            assert {tuple(sorted(r)) for r in found.collect()} <= brute
            assert {r.node: r.root for r in connected(found).collect()} == whole


def test_candidates_come_from_the_buckets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fps = [(r.fp,) for r in simhash.fingerprints(docs).select("fp").distinct().collect()]
    small, large = simhash.candidates(spark.createDataFrame(fps, "fp long"))
    masks = simhash.covering_masks()
    pairs = set()
    for row in small.collect():
        assert 2 <= len(row["all"]) <= simhash.BUCKET
        assert len({v & masks[row.t] & (2**64 - 1) for v in row["all"]}) == 1
        pairs |= {(a, b) for a in row["all"] for b in row["all"] if a < b}
    assert large.count() == 0
    near = {(a, b) for (a,) in fps for (b,) in fps if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    assert near <= pairs and len(pairs) < len(fps) * (len(fps) - 1) / 2 / 100


def test_any_names_and_ids(spark):
    rows = [("b", "same text of five words", 1, 2, 3, 4), ("a", "same text of five words", 5, 6, 7, 8), (None, "quite another text it is", 9, 10, 11, 12)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, id_0 int, none_0 int, TEXT_0 int, __key int")
    kept = simhash.drop_near_duplicates(docs, text_col="Text")
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(rows[1:], key=str)
    assert sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str) == sorted([("a", "a"), ("b", "a"), (None, None)], key=str)


def test_one_of_each_component_stays(spark):
    rows = [(3, "same text of five words", "a", "b"), (1, "same text of five words", "c", "d"), (1, "same text of five words", "c", "d"), (9, "another text with other words", "e", "f"), (None, "another text with other words", "e", "f")]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fp", "component_id"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 9]


def test_each_component_of_null_and_repeated_ids_keeps_one(spark):
    a, b, c, d = ("first text of some words", "second piece with other words", "third one is unlike both", "fourth and last of the unlike ones")
    rows = [(None, a, "", ""), (None, a, "", ""), (None, b, "", ""), (None, c, "", ""), (7, c, "", "")]  # c has a numbered row
    rows += [(5, d, "", ""), (5, "zebras cross a road here", "", ""), (2, d, "", "")]  # one id, two components, one of them led by 2
    rows += [(8, "Tie of Two Spellings here", "", ""), (8, "tie of two spellings here", "", ""), (9, "tie of two spellings here", "", ""), (10, None, "", ""), (10, "", "", ""), (None, None, "", "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = sorted(((r.doc_id, r.text) for r in simhash.drop_near_duplicates(docs).collect()), key=str)
    assert kept == sorted([(None, a), (None, b), (7, c), (2, d), (5, "zebras cross a road here"), (8, "Tie of Two Spellings here"), (10, None)], key=str)


def test_copies_of_null_ids_are_reduced_before_they_are_dealt(spark):
    docs = spark.createDataFrame([(None, "one text for all of these rows", "", "")] * 4000, SCHEMA).repartition(8)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.count() == 1
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.drop_near_duplicates(empty).count() == 0
