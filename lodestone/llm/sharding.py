"""Shards by a hierarchical weighted hash tree of regions, racks and shards.

Every region, rack and slot of the tree has a fixed capacity; a shard occupies one slot with a weight of at most the
slot's capacity. A key descends by weighted hash draws:

* each region draws arrival times, exponential with its capacity as rate, from a hash of (key, region, attempt);
* the attempt descends: rack, then slot, each the winner of an exponential draw weighted with its capacity;
* the attempt counts if a further hash draw falls under the weight of the shard in that slot; else the region's next
  arrival follows.

The key goes to the shard whose arrival counts first. The draws depend on capacities only, never on weights or on the
number of shards. A larger weight (a new shard: from zero) therefore only makes more arrivals of its own slot count:
rows move into that shard and nowhere else. A smaller one only moves rows out of it. Other subtrees exchange nothing.
A shard's share is its weight over the sum of weights. A region without live slots is not visited, and one is left
once its next arrival is later than the best so far, so a key costs about one draw a region.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged, type_of

SHARDS, SLOTS_PER_RACK, RACKS_PER_REGION, CAPACITY = 40, 4, 4, 1.0
ROW_OVERHEAD = 16
#: Rows of one shard that are numbered together, about.
CHUNK_ROWS = 8192

_GOLDEN, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _draw(keys: np.ndarray, *path: int) -> np.ndarray:
    """Uniform numbers in (0, 1) that depend on the key and on a place in the tree."""
    state = keys
    for step in path:
        state = _mixed(state + np.uint64(_GOLDEN * (step + 1) & _MASK))
    return ((state >> np.uint64(11)).astype(np.float64) + 0.5) / 9007199254740992.0


@dataclass(frozen=True)
class Tree:
    """Weights of shards 0, 1, ... in order of creation, laid out rack by rack and region by region.

    capacity: of every slot, or of each slot by itself; slots beyond the last have the last one's. A slot's capacity is
    fixed for good, a shard's weight may be anything up to it.
    """

    weights: tuple[float, ...]
    slots: int = SLOTS_PER_RACK
    racks: int = RACKS_PER_REGION
    capacity: float | tuple[float, ...] = CAPACITY

    def __post_init__(self):
        if not any(self.weights) or not all(0 <= w <= c for w, c in zip(self.weights, self.capacities(len(self.weights)))):
            raise ValueError("weights are from 0 to the slot's capacity, and one is over 0")

    def capacities(self, n: int) -> list[float]:
        own = list(self.capacity) if isinstance(self.capacity, tuple) else [self.capacity]
        return [*own[:n], *own[-1:] * (n - len(own))]

    @classmethod
    def even(cls, shards: int, **shape) -> Tree:
        return cls((CAPACITY,) * shards, **shape)

    def grown(self, weight: float = CAPACITY) -> Tree:
        return Tree((*self.weights, weight), self.slots, self.racks, self.capacity)

    def shard(self, keys: np.ndarray) -> np.ndarray:
        """The shard of each key (int64)."""
        keys = _mixed(keys.astype(np.int64).view(np.uint64) + np.uint64(_GOLDEN))
        size = self.slots * self.racks
        weights = np.zeros(-(-len(self.weights) // size) * size)
        weights[: len(self.weights)] = self.weights
        room = np.array(self.capacities(len(weights)))
        best, chosen = np.full(len(keys), np.inf), np.full(len(keys), -1, np.int64)
        for region in range(len(weights) // size):
            live = weights[region * size : (region + 1) * size]
            if not live.any():
                continue
            own_room = room[region * size : (region + 1) * size].reshape(self.racks, self.slots)
            rate = own_room.sum()
            rows, clock, attempt = np.arange(len(keys)), np.zeros(len(keys)), 0
            while len(rows):
                own = keys[rows]
                clock = clock - np.log(_draw(own, region, attempt, 0)) / rate
                ahead = clock < best[rows]
                rows, clock, own = rows[ahead], clock[ahead], own[ahead]
                rack = self._child(own, own_room.sum(axis=1), region, attempt, 1)
                slot = np.zeros(len(rows), np.int64)
                for r in range(self.racks):
                    here = rack == r
                    slot[here] = self._child(own[here], own_room[r], region, attempt, 2, r)
                leaf = rack * self.slots + slot
                counts = _draw(own, region, attempt, 3) * own_room.reshape(-1)[leaf] < live[leaf]
                best[rows[counts]], chosen[rows[counts]] = clock[counts], leaf[counts] + region * size
                rows, clock, attempt = rows[~counts], clock[~counts], attempt + 1
        return chosen

    @staticmethod
    def _child(keys: np.ndarray, rates: np.ndarray, *path: int) -> np.ndarray:
        """The child with the first of exponential draws, each at the rate of the child's capacity."""
        return np.argmin(np.stack([-np.log(_draw(keys, *path, c)) / max(rate, 1e-300) for c, rate in enumerate(rates.tolist())]), axis=0)


def _nth_copy(keys: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """For each row of a batch how many rows before it have its key and checksum."""
    order = np.lexsort([crcs, keys])
    a, b = keys[order], crcs[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    start = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    nth = np.empty(len(a), np.int64)
    nth[order] = np.arange(len(a)) - start
    return nth


def _descend(tree: Tree, grown: Tree):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            found = [pa.array(t.shard(keys).astype(np.int32)) for t in (tree, grown)]
            nth = _nth_copy(keys, batch.column("text_crc32").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, *found, pa.array(nth)], [*batch.schema.names, "shard", "grown_shard", "copy"])

    return run


def placed(docs: DataFrame, tree: Tree, id_col: str = "doc_id", text_col: str = "text", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one per row of ``docs``.

    law is ``key``: doc_id and the tree decide. grown_shard is the shard once the tree has one more. size is the text's
    UTF-8 bytes plus 16 (null text: 16, crc of no bytes). Ids are whole numbers or texts; a null id hashes as a key of its
    own. Repeated ids share a shard and take slots of their own. Other columns are not read. An empty table gives an
    empty result.

    Slots are gapless from 0 in each shard without a shard ever being gathered: its rows fall in hash chunks of about
    ``chunk_rows``, chunks are counted, counts are summed over the chunks before, and only a chunk is sorted. Rows equal
    in id and text are dealt to chunks by their place among their like in a batch, so many copies of a row share no task.
    Only ids, sizes and checksums are shuffled; the texts are read once, in the JVM.
    """
    text, kind = F.coalesce(F.col(text_col), F.lit("")), type_of(docs, id_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + ROW_OVERHEAD).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.coalesce(F.col(id_col).cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col)), F.xxhash64(F.lit("null id"))).alias("key"),
    )
    schema = f"doc_id {kind}, size long, text_crc32 long, key long, shard int, grown_shard int, copy long"
    rows = staged(rows.mapInArrow(_descend(tree, tree.grown()), schema), "placed")
    chunks = max(1, rows.count() // (len(tree.weights) * chunk_rows))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("key", "text_crc32", "copy"), F.lit(chunks)).cast("int"))
    before = W.partitionBy("shard").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    first = rows.groupBy("shard", "chunk").count().withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    nth = F.row_number().over(W.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size")) - 1
    numbered = rows.withColumn("nth", nth).join(first, ["shard", "chunk"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("nth")).cast("long").alias("slot"), "grown_shard")


def query(spark, sf_dir: str) -> DataFrame:
    return placed(spark.read.parquet(f"{sf_dir}/documents.parquet"), Tree.even(SHARDS))
