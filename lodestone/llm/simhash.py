"""SimHash near-duplicates found by covering locality-sensitive hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_name, slices, staged, type_of, words_of
from .components import connected

BITS, SEED, SHINGLE, RADIUS = 64, 42, 3, 2
#: Shingles that are hashed before their bits are counted.
STEP = 1 << 16
#: Fingerprints of a bucket that are compared with each other; larger buckets are split by flips of the ignored bits.
BUCKET = 32


def fingerprint(words: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a word sequence as an unsigned number.

    A bit is set if it is set in over half of the XXH64 of the space-joined shingles, repeats included. A sequence
    shorter than a shingle is one shingle; an empty one has fingerprint zero.
    """
    if not words:
        return 0
    width = min(shingle, len(words))
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    n, total, digest = len(words) - width + 1, np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for k in range(0, n, STEP):
        stop = min(n, k + STEP)
        spans = zip(begins[k:stop].tolist(), ends[k + width - 1 : stop + width - 1].tolist())
        hashes = np.fromiter((digest(text[a:b], seed) for a, b in spans), ">u8", stop - k)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def _fingerprint_batches(shingle: int, seed: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                codes, at, words = words_of(part.column("text"), binary=True)
                words = [w.lower() for w in words]  # of bytes: A-Z only
                rows = ([words[c] for c in codes[a:b].tolist()] for a, b in zip(at[:-1].tolist(), at[1:].tolist()))
                found = np.fromiter((fingerprint(row, shingle, seed) for row in rows), np.uint64, part.num_rows)
                kept = [n for n in part.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*map(part.column, kept), pa.array(found.view(np.int64))], [*kept, "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Rows (id, fp) of ``docs``: one per row, fp the fingerprint's 64 bits as a long. A null text has no words. id has
    the id's own type."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprint_batches(shingle, seed), f"id {type_of(docs, id_col)}, fp long")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """Masks, one per table, such that any two fingerprints at ``radius`` or fewer differing bits agree under one.

    Bit i gets a nonzero vector m(i) over GF(2) of radius + 1 digits; the table of each nonzero v keeps the bits with
    <m(i), v> = 1. For any ``radius`` positions some nonzero v is orthogonal to all their vectors, and its table
    ignores all of them. The vectors are dealt in turn, so the masks keep nearly equal numbers of bits.
    """
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if bin(m & v).count("1") % 2) for v in range(1, 2 ** (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def candidates(distinct_fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """The covering tables' buckets of two or more fingerprints (column fp, distinct): small ones and large ones.

    Small ones, up to ``bucket``, are rows (t, key, all) with their fingerprints in order. Of large ones each
    fingerprint is a row (t, key, fp). Sizes are counted before anything is gathered, so no array is longer.
    """
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in covering_masks(radius)])
    tables = distinct_fps.select("fp", F.posexplode(keys).alias("t", "key"))
    shared = tables.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    mates = tables.join(shared, ["t", "key"])
    small = mates.where(F.col("n") <= bucket).groupBy("t", "key").agg(F.array_sort(F.collect_list("fp")).alias("all"))
    return small, mates.where(F.col("n") > bucket).drop("n")


def _near(a, b, radius: int):
    return F.bit_count(a.bitwiseXOR(b)) <= radius


def links(distinct_fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints (column fp, distinct) at ``radius`` (1 or 2) or fewer bits.

    Candidates come from the buckets of the covering tables alone, and every link is verified by its differing bits. In
    a small bucket each fingerprint is compared with the others in place, and only those that hold leave it. A large
    bucket is split by its ignored bits: each fingerprint emits itself and its values one flip of such a bit away,
    and those that meet in a value, at most one more than there are ignored bits, link to the smallest of them. Two
    that differ in two ignored bits always meet so, hence work is linear in the bucket and no link is lost.
    """
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    small, large = candidates(distinct_fps, radius, bucket)
    pairs = F.transform("all", lambda x, i: F.transform(F.filter(F.slice("all", i + 2, F.size("all")), lambda y: _near(x, y, radius)), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    compared = small.select(F.explode(F.flatten(pairs)).alias("link")).select("link.a", "link.b")
    ignored = [[_signed(1 << i) for i in range(BITS) if not m >> i & 1] for m in covering_masks(radius)]
    flips = F.transform(F.element_at(F.lit(ignored), F.col("t") + 1), lambda bit: F.col("fp").bitwiseXOR(bit))
    at = large.select("t", "fp", F.explode(F.array_append(flips, F.col("fp"))).alias("at"))
    meets = at.groupBy("t", "at").agg(F.collect_set("fp").alias("all")).where("size(all) > 1")
    # at radius 1 the flip of the pair's bit is the other one itself, and only that is a link
    meets = meets.withColumn("hub", F.array_min("all")) if radius == 2 else meets.where(F.array_contains("all", F.col("at"))).withColumn("hub", F.col("at"))
    met = meets.select(F.col("hub").alias("a"), F.explode("all").alias("b")).where(_near(F.col("a"), F.col("b"), radius) & F.expr("a <> b"))
    return compared.unionByName(met).distinct()


def _rooted(each: DataFrame, radius: int) -> DataFrame:
    """The distinct fingerprints of ``each`` (id, fp) with the root of their component and its smallest id."""
    classes = staged(each.groupBy("fp").agg(F.min("id").alias("first_id")), "classes")
    roots = connected(links(classes.select("fp"), radius))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, fp, component_id), one per row of ``docs``.

    component_id is the smallest id reachable over links of ``radius`` or fewer bits, its own included. Equal
    fingerprints are gathered before anything else, so copies cost one fingerprint however many they are. Null and
    empty texts share fingerprint zero and link like any other; a very long text is hashed whole, a step of shingles at
    a time. Ids are of any ordered type, which doc_id and component_id have too. A null id is never the smallest; a
    component of null ids only has a null component_id. Repeated rows come back repeated, other columns are not read.
    An empty table gives an empty result.
    """
    each = staged(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    return each.join(_rooted(each, radius), "fp").select(F.col("id").alias("doc_id"), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Exactly one document of each component of ``near_duplicates``, one with its smallest id, with all its columns.

    Of a component's rows that repeat that id the one with the smallest text stays; of a component of null ids one row
    stays. Rows are told apart by id and the 64-bit digest of the text, so an id may stand for several components.
    Rows equal in both are reduced to one before and after they are dealt, so null ids and copies gather nowhere.
    Columns may have any names and ids any ordered type. An empty table gives an empty result.
    """
    names = {}
    for label in ("id", "none", "text", "nth"):
        names[label] = free_name(docs, label)
    # the id as text: one type to join by, with null apart from every id
    own = {names["id"]: F.coalesce(F.col(id_col).cast("string"), F.lit("")), names["none"]: F.col(id_col).isNull(), names["text"]: F.xxhash64(text_col)}
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("digest"))
    each = staged(rows.mapInArrow(_fingerprint_batches(shingle, seed), f"id {type_of(docs, id_col)}, digest long, fp long"), "fingerprints")
    first = F.col("id").eqNullSafe(F.col("component_id"))
    texts = staged(each.join(_rooted(each.select("id", "fp"), radius), "fp").where(first).select("root", "id", "digest").distinct(), "candidates")
    # of null ids any text may stay; where an id has several texts in its component the texts themselves decide
    spread = texts.groupBy("root").agg(F.min("id").alias("id"), F.min("digest").alias("digest"), F.max("digest").alias("last"))
    tied = F.col("id").isNotNull() & (F.col("digest") != F.col("last"))
    stay = spread.where(~tied).select("id", "digest")
    if not spread.where(tied).isEmpty():
        rivals = texts.join(spread.where(tied).select("root"), "root")
        least = rows.join(rivals, ["id", "digest"]).groupBy("root").agg(F.min(F.struct("text", "digest", "id")).alias("least"))
        stay = stay.unionByName(least.select("least.id", "least.digest"))
    stay = stay.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias(names["id"]), F.col("id").isNull().alias(names["none"]), F.col("digest").alias(names["text"]))
    # the window and the join are dealt by the same columns: the texts are shuffled once
    nth = F.row_number().over(W.partitionBy(*own).orderBy(names["text"]))
    distinct = docs.withColumns(own).withColumn(names["nth"], nth).where(F.col(names["nth"]) == 1)
    return distinct.join(stay.hint("merge"), list(own), "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
