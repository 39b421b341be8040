"""Context for a question: seeds by shared words, ranked symbols, and their source lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.graph import CodeGraph

#: How many sources and lines of each a context has, the letters of the shortest word that counts, and what
#: stands between two sources.
SNIPPETS, SNIPPET_LINES, LEAST_WORD = 6, 60, 4
HEADING_RULE = "\n\n---\n\n"


def question_words(question: str, least: int = LEAST_WORD) -> list[str]:
    """Distinct identifiers of the question with ``least`` letters or more, in order."""
    return [w for w in dict.fromkeys(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", question)) if len(w) >= least]


def match_names(names: DataFrame, words: list[str]) -> DataFrame:
    """Distinct ``names(name)`` that hold one of the words or lie in one, in any case.

    The words are a question's, so they are literals of one filter and not a table to join.
    """
    name = F.lower("name")
    hit = F.lit(False)
    for w in {w.lower() for w in words}:
        hit = hit | F.contains(name, F.lit(w)) | F.contains(F.lit(w), name)
    return names.where(hit).select("name").distinct()


def line_slice(text: Column, first: Column, last: Column, most: int = SNIPPET_LINES) -> Column:
    """Lines first to last (from 1, at most ``most``) of a text."""
    size = F.least(last - first + 1, F.lit(most))
    return F.array_join(F.slice(F.split(text, "\n"), first, F.greatest(size, F.lit(0))), "\n")


def snippets(ranked: DataFrame, contents: DataFrame) -> DataFrame:
    """Ranked symbol rows with where and snippet, from ``contents(path, content)``."""
    text = contents.select("path", F.col("content").cast("string").alias("__text"))
    last = F.least(F.coalesce("end_line", "start_line"), F.col("start_line") + SNIPPET_LINES - 1)
    rows = ranked.where("kind = 'symbol' and start_line is not null").join(text, "path")
    where = F.concat("path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), last.cast("string"))
    return rows.withColumn("where", where).withColumn("snippet", line_slice(F.col("__text"), F.col("start_line"), last)).drop("__text")


def context_rows(graph: CodeGraph, contents: DataFrame, question: str, limit: int = SNIPPETS) -> DataFrame:
    """The best symbols for a question, each with where it is and its lines. Names that share a word with the question
    are the seeds; they stay a table however many match."""
    seeds = match_names(graph.symbols(), question_words(question)).select(F.col("name").alias("seed"))
    return snippets(graph.ranked_context(seeds=seeds, kind="symbol", limit=limit), contents)


def answer_context(graph: CodeGraph, contents: DataFrame, question: str, limit: int = SNIPPETS) -> str:
    """The text to give a model with the question: ``limit`` sources, the best first, under headings, parted by rules."""
    found = context_rows(graph, contents, question, limit).orderBy(F.desc("score"), "id").collect()
    return HEADING_RULE.join(f"// {r['where']} — {r['name']} ({r['symbol_kind']})\n{r['snippet']}" for r in found)
