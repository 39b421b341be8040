import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import sharding
from lodestone.llm.sharding import Tree

KEYS = np.arange(-2000, 6000, dtype=np.int64) * 7919


def brute(tree, key):
    """The descent for one key, with plain numbers: every region in turn, arrivals until one counts."""
    mask, golden = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    def draw(*path):
        state = own
        for step in path:
            state = mixed(state + golden * (step + 1) & mask)
        return ((state >> 11) + 0.5) / 2**53

    own, found, size = mixed((key & mask) + golden & mask), [], tree.slots * tree.racks
    for region in range(-(-len(tree.weights) // size)):
        live = [tree.weights[k] if k < len(tree.weights) else 0 for k in range(region * size, region * size + size)]
        room = tree.capacities(region * size + size)[region * size :]
        of_rack = [sum(room[r * tree.slots : (r + 1) * tree.slots]) for r in range(tree.racks)]
        clock, attempt = 0.0, 0
        while any(live):
            clock -= math.log(draw(region, attempt, 0)) / sum(room)
            rack = min(range(tree.racks), key=lambda c: -math.log(draw(region, attempt, 1, c)) / of_rack[c])
            slot = min(range(tree.slots), key=lambda c: -math.log(draw(region, attempt, 2, rack, c)) / room[rack * tree.slots + c])
            leaf = rack * tree.slots + slot
            if draw(region, attempt, 3) * room[leaf] < live[leaf]:
                found.append((clock, region * size + leaf))
                break
            attempt += 1
    return min(found)[1]


#: Slots, and so racks and regions, of unlike capacity; the draws at each level are weighted by them.
UNEVEN = Tree((3.0, 0.5, 1.0, 0.0, 8.0, 1.0) * 4, capacity=(4.0, 0.5, 1.0, 2.0, 8.0, 1.0) * 4 + (1.0,))


def test_uneven_trees_share_by_weight_and_confine_movement():
    counts = np.bincount(UNEVEN.shard(KEYS), minlength=24)
    assert all(abs(c / len(KEYS) - w / sum(UNEVEN.weights)) < 0.02 for c, w in zip(counts, UNEVEN.weights))
    changed = Tree((*UNEVEN.weights[:4], 2.0, *UNEVEN.weights[5:]), capacity=UNEVEN.capacity)
    before, after = UNEVEN.shard(KEYS), changed.shard(KEYS)
    assert set(before[before != after].tolist()) == {4}
    grown = UNEVEN.grown().shard(KEYS)
    assert set(grown[grown != before].tolist()) == {24}


def test_copies_of_a_row_are_dealt_to_many_chunks(spark):
    docs = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one text").alias("text"), F.lit(1).alias("copy"))
    found = sharding.placed(docs, Tree.even(40), chunk_rows=10)
    assert sorted(r.slot for r in found.collect()) == list(range(20_000)) and found.select("shard").distinct().count() == 1
    keys = np.array([5, 7, 5, 5, 7]), np.array([1, 1, 1, 2, 1])
    assert sharding._nth_copy(*keys).tolist() == [0, 0, 1, 0, 1]


def test_ids_of_text(spark):
    docs = spark.createDataFrame([(f"id{k}", "t") for k in range(500)] + [(None, "t"), (None, None)], "doc_id string, text string")
    found = sharding.placed(docs, Tree.even(40)).collect()
    assert len(found) == 502 and len({r.shard for r in found}) == 40 and all(r.grown_shard in (r.shard, 40) for r in found)


def test_same_as_plain_descent():
    for tree in (Tree.even(40), Tree((0.5, 1.0, 0.25, 0.0, 1.0)), Tree.even(1), UNEVEN):
        assert tree.shard(KEYS[::40]).tolist() == [brute(tree, int(k)) for k in KEYS[::40]]


def test_one_more_shard_takes_rows_only_into_itself():
    now = Tree.even(1)
    for n in range(1, 70):
        a, b = now.shard(KEYS), now.grown().shard(KEYS)
        assert set(b[a != b].tolist()) <= {n}
        assert 0 < (b == n).sum() < 4 * len(KEYS) / (n + 1)
        now = now.grown()


def test_weights_confine_movement_and_set_shares():
    a = Tree((1.0,) * 20)
    less, more = Tree((1.0,) * 5 + (0.5,) + (1.0,) * 14), a
    before, after = more.shard(KEYS), less.shard(KEYS)
    assert set(before[before != after].tolist()) == {5}
    counts = np.bincount(less.shard(KEYS), minlength=20)
    assert abs(counts[5] / len(KEYS) - 0.5 / 19.5) < 0.012
    assert all(abs(c / len(KEYS) - 1 / 19.5) < 0.015 for i, c in enumerate(counts) if i != 5)


def test_table(spark):
    schema = "doc_id long, text string, shard string, key string"
    rows = [(i, "é" * (i % 7), "x", "y") for i in range(300)] + [(5, None, None, None), (5, "t", "", ""), (5, "t", "", ""), (None, "", "", ""), (None, "z" * 200_000, "", "")]
    tree = Tree.even(40)
    found = sharding.placed(spark.createDataFrame(rows, schema), tree, chunk_rows=2).collect()
    assert len(found) == len(rows)
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in found), key=key) == sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows), key=key)
    for r in found:
        if r.doc_id is not None:
            ids = np.array([r.doc_id])
            assert (r.shard, r.grown_shard) == (tree.shard(ids)[0], tree.grown().shard(ids)[0])
        assert r.grown_shard in (r.shard, 40) and r.law == "key"
    for s in range(40):
        slots = sorted(r.slot for r in found if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.placed(spark.createDataFrame([], schema), tree).count() == 0
