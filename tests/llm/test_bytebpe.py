import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import bytebpe

RANKS = bytebpe.load_ranks()
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bytebpe.Encoder(RANKS)


def ids_of(text):
    return [i for p in bytebpe.pieces_of(text) for i in ENCODER.encode(p.encode())]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text_as_the_library(text):
    assert ids_of(text) == LIBRARY.encode_ordinary(text)
    assert ENCODER.decode(ids_of(text)) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab 'é\t\n\r\x85\xa0\x1c½²5Iİǅ.,-", max_size=60))
def test_latin_splits_as_the_library(text):
    assert ids_of(text) == LIBRARY.encode_ordinary(text)


def test_long_pieces_at_any_seam():
    draw = random.Random(3)
    tokens = [t for t in RANKS if t.isalpha() and len(t) > 2]
    for size in (33, 64, 200, 1000, 5000):
        for alphabet in ("a", "ab", "the", "abcdefghijklmnopqrstuvwxyz"):
            text = "".join(draw.choice(alphabet) for _ in range(size))
            assert ids_of(text) == LIBRARY.encode_ordinary(text)
        text = b"".join(draw.choice(tokens) for _ in range(size // 4)).decode()
        assert ids_of(text) == LIBRARY.encode_ordinary(text)
    for text in (" " * 5000, "=" * 3000 + "-" * 999, "\n" * 700 + "x", "é" * 2000, "日本語" * 700):
        assert ids_of(text) == LIBRARY.encode_ordinary(text)


def test_join_is_associative():
    draw = random.Random(5)
    for _ in range(60):
        text = "".join(draw.choice("aabtheinion") for _ in range(90)).encode()
        cuts = sorted(draw.sample(range(1, 89), 2))
        a, b, c = (ENCODER._reduced(text, x, y) for x, y in zip([0, *cuts], [*cuts, 90]))
        assert ENCODER._joined(ENCODER._joined(a, b), c) == ENCODER._joined(a, ENCODER._joined(b, c)) == ENCODER._merged(text)


def test_ids_of_real_documents_come_out_of_joins(spark, monkeypatch):
    """Every piece that is no token goes through one join for each inner node of its tree, and windows grow."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    joins, pieces, merged, plain = [], 0, [], bytebpe.Encoder._joined
    encoder = bytebpe.Encoder(RANKS)

    def counted(self, left, right):
        out = plain(self, left, right)
        assert self.decode(out) == self.decode(left) + self.decode(right)
        joins.append((len(left), len(right)))
        merged.append(len(out) < len(left) + len(right))
        return out

    monkeypatch.setattr(bytebpe.Encoder, "_joined", counted)
    for text in texts:
        for piece in map(str.encode, bytebpe.pieces_of(text)):
            before = len(joins)
            assert encoder.encode(piece) == LIBRARY.encode_ordinary(piece.decode())
            if piece not in RANKS:
                pieces += 1
                assert len(joins) - before >= max(1, len(piece) // 2 - 1) or len(piece) <= 2
    assert pieces > 1000 and len(joins) > 3 * pieces and sum(merged) > pieces


def test_decoding_goes_up_the_tree(monkeypatch):
    calls, plain = [], bytebpe.Encoder.decode
    monkeypatch.setattr(bytebpe.Encoder, "decode", lambda self, ids: calls.append(len(ids)) or plain(self, ids))
    text = "some words that repeat " * 100
    ids = ids_of(text)
    calls.clear()
    assert ENCODER.decode(ids) == text.encode()
    assert calls[0] == len(ids) and len(calls) > len(ids) // bytebpe.LEAF_TOKENS and min(calls) <= bytebpe.LEAF_TOKENS


def test_clashing_columns_and_other_ids(spark):
    rows = [("a", "one two", 7, "x"), (None, None, 8, "y"), ("a", "", 9, "z")]
    frame = spark.createDataFrame(rows, "doc_id string, text string, text_0 int, TOKEN_IDS string")
    made = bytebpe.with_ids(frame, text_col="TEXT")
    assert made.columns == ["doc_id", "text", "text_0", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]
    assert [tuple(r)[:4] for r in made.collect()] == [("a", "one two", 7, 2), (None, None, 8, 0), ("a", "", 9, 0)]
    assert [(r.doc_id, r.n_tokens) for r in bytebpe.digests(frame).collect()] == [("a", 2), (None, 0), ("a", 0)]


@pytest.mark.parametrize("name", [bytebpe.RANKS, "byte_bpe_multi_50k.tiktoken"])
def test_table_against_library(spark, name):
    schema = "doc_id long, text string, n_tokens string"
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text, "x") for r in docs] + [(1, None, None), (1, "", ""), (None, "<|endoftext|> x", ""), (None, "\x00\x1c ﻿", ""), (5, "a" * 100_000, ""), (6, "Ελλάδα 日本 😀‍ x", "")]
    frame = spark.createDataFrame(rows, schema)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.load_ranks(name), special_tokens={})
    brute = []
    for i, text, _ in rows:
        ids = library.encode_ordinary(text or "")
        brute.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in bytebpe.digests(frame, ranks=name).collect()) == sorted(brute)
    back = bytebpe.decoded(bytebpe.with_ids(frame, ranks=name), ranks=name).collect()
    assert [(r.doc_id, r.decoded_text) for r in back] == [(i, t or "") for i, t, _ in rows]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in back) == sorted(brute)
    empty = spark.createDataFrame([], schema)
    assert bytebpe.digests(empty).count() == 0 and bytebpe.with_ids(empty).count() == 0
