"""All operators and stages on one table of edge cases: nulls everywhere, clashing names, repeated and long rows, none at all."""

import pytest

import corpus_pipeline
from lodestone.llm import bytebpe, chat, decontaminate, langid, quality, sharding, simhash, tokencount, tokenio, warc
from lodestone.llm.common import new_path

PROSE = "The old mill by the river was sold to a family from the north who kept bees and grew plums for the market in town"
#: Names that results and helpers use, or once used, as further columns of the input, in any case.
CLASHES = ["fp", "ID", "shard", "slot", "n_tokens", "held_out", "kept", "score", "item_id", "start", "__text", "__key", "__nth", "text_0", "id_0", "nth_0", "none_0", "copy", "bucket", "digest"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
TEXTS = [PROSE, None, "", " \t\n", PROSE, "Une vieille ferme pres de la mer fut vendue a des gens du nord qui aimaient les abeilles et le miel", "x" * 300_000, PROSE + " indeed", "\x00 \ud7ff \U0001f600 <|endoftext|>"]
ROWS = [(i, t, None if k % 3 == 0 else "en", None, None, *([f"keep {k}"] * len(CLASHES))) for k, t in enumerate(TEXTS) for i in (k, k, None, 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "Is this in here? It is not in there at all."), (None, None)], "item_id long, text string")


def tables(spark, docs, bench):
    """What each operator gives for a table, and the number of rows that it has for each of the table's."""
    folder, cache = new_path(spark, "tokens"), new_path(spark, "cache")
    whole, members = new_path(spark, "whole"), new_path(spark, "members")
    turns = docs.selectExpr("doc_id as conv_id", "0 as turn", "lang as role", "text", *(f"`{c}`" for c in CLASHES))
    return {
        "simhash": simhash.near_duplicates(docs), "sharding": sharding.placed(docs, sharding.Tree.even(3)), "tokencount": tokencount.count_tokens(docs, cache), "decontaminate": decontaminate.leaks(docs, bench), "tokenio": tokenio.read_tokens(tokenio.write_tokens(docs, folder), folder),
        "chat": chat.parse_chats(chat.format_chats(turns)), "quality": quality.quality(docs), "bytebpe": bytebpe.with_ids(docs), "warc": warc.read_archives(warc.normalise(warc.write_archives(docs, whole, id_col="doc_id", url_col="source", html_col="text"), whole, members), members), "langid": langid.identify(docs, langid.fit(docs)),
    }


def test_every_operator_on_edge_cases(spark, docs, bench):
    for name, found in tables(spark, docs, bench).items():
        n = found.count()
        assert n == (0 if name == "decontaminate" else len(TEXTS) + 1 if name == "chat" else len(ROWS)), name


def test_every_operator_on_an_empty_table(spark, bench):
    for name, found in tables(spark, spark.createDataFrame([], SCHEMA), bench).items():
        assert found.count() == 0, name


def test_every_stage_on_edge_cases_and_on_nothing(spark, docs, bench, tmp_path):
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        rows = list(map(tuple, out.collect()))
        assert set(rows) <= set(ROWS) and rows, name  # whole rows, no column touched
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(ROWS)


def test_stages_keep_what_they_should(spark, docs, bench, tmp_path):
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {name: {r.text for r in stage(spark, docs, str(tmp_path)).select("text").collect()} for name, stage in corpus_pipeline.STAGES[:-1]}
    assert PROSE in set.intersection(*kept.values())
    assert not {None, "", " \t\n"} & (kept["quality_rules"] | kept["language_id"])
    assert kept["decontamination"] == set(TEXTS)
