"""From raw documents to token ids: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bytebpe, decontaminate, langid, quality, simhash
from lodestone.llm.common import staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fertility bands of their script.

    A null, empty or wordless text goes. Ids are not read; equal rows are judged alike, texts of any length whole.
    """
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network finds; it learns from the labelled ones outside the held-out fold.

    A null or empty text, or one without a letter, goes; a null lang is not learned from. Where nothing is labelled
    all documents with a letter stay.
    """
    return langid.keep_identified(docs, langid.fit(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates (3-word shingles, 2 bits, as op1).

    Null and empty texts are one group. A null id is never the smallest; of a group of null ids one stays, of an id's
    several texts in a group the smallest. A very long text is hashed whole.
    """
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give no benchmark item away.

    A null or empty text gives nothing away and stays. Ids are not read; texts of any length are searched whole. With an
    empty benchmark all documents stay.
    """
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their digest, and the digest of what they decode to.

    A null or empty text has no ids. Repeated rows come back repeated, texts of any length are encoded whole.
    """
    return bytebpe.with_ids(docs).select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: Fertility, the network and the ids have no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. An empty table gives an empty result at every stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
