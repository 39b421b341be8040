"""Token counts through a cache keyed by digests of normalised content and of the tokenizer's version."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.staging import file_system

from .common import new_path, slices, staged, type_of
from .pretrained import Pretrained, version_digest

TOKENIZER, LIMIT = "word_bpe_49k.json", 2048
CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def _digest(tokenizer: Pretrained, text: str | None) -> bytes:
    return hashlib.blake2b(tokenizer.normalised(text or "").encode(), digest_size=16).digest()


def _keys(name: str):
    def run(batches):
        tokenizer = Pretrained(name)
        for batch in batches:
            for part in slices(batch, "text"):
                found = [_digest(tokenizer, t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), pa.array(found, pa.binary())], ["id", "n_bytes", "digest"])

    return run


def _counts(name: str):
    def run(batches):
        tokenizer = Pretrained(name)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                found = [_digest(tokenizer, t) for t in texts], [tokenizer.count(t or "") for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.binary()), pa.array(found[1], pa.int64())], ["digest", "n_tokens"])

    return run


def open_cache(spark, path: str) -> DataFrame:
    """The cache at ``path``, an empty one where there is none yet."""
    target, files = file_system(spark, path)
    if not files.exists(target):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def count_tokens(docs: DataFrame, cache: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one per row of ``docs``; grows the table at path ``cache``.

    Contents are digested, digests joined to what the cache has for this tokenizer, one row of each distinct miss is
    encoded and its count appended; then every row takes its count from the cache. A null text counts as empty. Copies
    cost one encoding however many they are, and only digests of them are shuffled. Texts travel once, by id, to
    meet the first id of each missing content, by a merge join at every size. Ids that are null or repeat may bring a few more rows to encode and change no
    count. Appending is one committed write; a job that dies before it leaves the cache as it was. Two writers may both
    append a content: their counts are equal and reading takes one. doc_id has the id's own type, other columns are not
    read. A very long text is counted whole. An empty table gives an empty result and leaves the cache as it was.
    """
    spark = docs.sparkSession
    version = version_digest(tokenizer)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sized = rows.select("id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    keyed = staged(sized.mapInArrow(_keys(tokenizer), f"id {type_of(docs, id_col)}, n_bytes long, digest binary"), "digests")

    def stored():
        return open_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    missing = keyed.groupBy("digest").agg(F.min("id").alias("first_id")).join(stored(), "digest", "left_anti")
    chosen = rows.join(missing.select("first_id").distinct().hint("merge"), F.col("id").eqNullSafe(F.col("first_id")), "left_semi")
    counted = chosen.select("text").mapInArrow(_counts(tokenizer), "digest binary, n_tokens long")
    counted = counted.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")).join(missing.select("digest"), "digest", "left_semi")
    counted.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    known = staged(stored().join(keyed.select("digest").distinct(), "digest", "left_semi"), "counts")
    return keyed.join(known, "digest").select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), new_path(spark, "token-cache"))
