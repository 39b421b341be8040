import math
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

from lodestone.llm import quality
from lodestone.llm.quality import BANDS, Band

SCHEMA = "doc_id long, text string, n_words string, kept string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def brute_fertility(text):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(quality.VOCABULARY))
    ids = [i for w in re.findall(r"[^\x20\x09-\x0D]+", text or "") for i in model.encode(w)]
    n = len(ids)
    return n, sum(model.is_byte(i) for i in ids) / max(n, 1), -sum(c / n * math.log2(c / n) for c in Counter(ids).values())


CASES = [
    (1, None), (2, ""), (3, " \t\x0b\r\n "), (3, "one\ttwo\x0cthree"), (None, "a b c d e f a b c d e f g h i j k l m n o p q r"),
    (4, "l 1\nl 1\n\n \nl 1 \nx\n \n"), (5, "a a a a a a a"), (6, "#*$%&|<> x y z\x85w 　"), (7, "日本語のテキスト です これは 十分に 長い 文章 である はず です から ね"),
    (8, " ".join(f"w{i}" for i in range(60_000))), (9, "x" * 300_000), (9, "x" * 300_000), (10, "😀 " * 40), (11, "привет мир " * 3),
]


def test_base_counts_and_fertility_against_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(100 + r.doc_id, r.text) for r in docs] + CASES
    found = quality.quality(spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)).collect()
    got = sorted(((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found))
    assert got == sorted((str(i), *brute(t)) for i, t in rows)
    texts = dict(rows)
    for r in found:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
        if r.doc_id in texts and r.doc_id not in (3, 8) and r.n_words:
            n, share, entropy = brute_fertility(texts[r.doc_id])
            assert r.n_tokens == n and r.fallback_share == pytest.approx(share) and r.token_entropy == pytest.approx(entropy, abs=1e-9)
            band = BANDS[r.script]
            inside = band.least_chars_per_token <= r.word_chars / n <= band.most_chars_per_token and share <= band.most_fallback and (n < band.least_tokens or entropy >= band.least_entropy)
            assert r.kept == (inside and not r.base_failed)


def test_bands_reject_by_script(spark):
    good = "The committee will publish its full report on the regional water supply early next month"
    code = " ".join("0x%08x" % (k * 2654435761 % 2**32) for k in range(40))
    stuck = " ".join(f"{'na' * 30}{k}" for k in range(12))
    docs = spark.createDataFrame([(1, good, "", ""), (2, code, "", ""), (3, "🜀🜁🜂 " * 0 + " ".join(chr(0x1F700 + k) * 4 for k in range(40)), "", ""), (4, stuck, "", "")], SCHEMA)
    bands = BANDS | {"none": Band(1.0, 12.0, 0.5), "latin": Band(1.7, 8.0, 0.2)}
    kept = {r.doc_id: r.kept for r in quality.quality(docs, bands=bands).collect()}
    assert kept[1] and not kept[2] and not kept[3] and not kept[4]


def test_filter_keeps_columns(spark):
    rows = [(1, "short", "a", "b"), (2, "The committee will publish its full report on the regional water supply early next month", "a", None), (3, None, None, None)]
    kept = quality.keep_good(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "n_words", "kept"] and [tuple(r) for r in kept.collect()] == [rows[1]]
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.keep_good(empty).count() == 0 and quality.quality(empty).count() == 0


def test_production_bands_reject_junk_and_keep_what_is_labelled_good(spark):
    folder = "/root/testdata/sf0.01"
    good = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").collect()}
    passed = [r for r in quality.quality(spark.read.parquet(f"{folder}/documents.parquet")).collect() if not r.base_failed]
    rejected = {r.doc_id for r in passed if not r.kept}
    symbols = {r.doc_id for r in passed if r.n_symbols >= 0.1 * r.word_chars}
    assert len(symbols) > 50 and 2 * len(rejected & symbols) > len(symbols)
    assert not rejected & good and len(rejected - symbols) <= 2


def test_production_bands_judge_entropy_of_short_texts_too(spark):
    few = " ".join(f"{'na' * (1 + k)}" for k in range(14))  # few distinct tokens, no repeated window
    row = quality.quality(spark.createDataFrame([(1, few, "", "")], SCHEMA)).first()
    assert BANDS["latin"].floor_tokens <= row.n_tokens < BANDS["latin"].least_tokens and row.token_entropy < 2.5
    assert not row.base_failed and not row.kept


def test_other_ids_and_spellings(spark):
    good = "The old mill by the river was sold to a family from the north who kept bees and grew plums"
    rows = [("a", good, 1), (None, None, 2), ("b", "short", 3)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, Kept int")
    assert [(r.doc_id, r.kept) for r in quality.quality(docs, text_col="TEXT").collect()] == [("a", True), (None, False), ("b", False)]
    assert [tuple(r) for r in quality.keep_good(docs, text_col="TEXT").collect()] == rows[:1]
