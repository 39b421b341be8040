import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import tokencount, tokenio
from lodestone.llm.common import new_path
from lodestone.llm.pretrained import Pretrained

LIBRARY = {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}
OURS = {n: Pretrained(n) for n in LIBRARY}
SCHEMA = "doc_id long, text string, digest string, id string"
EDGES = [None, "", " \t\n ", "<|endoftext|>", "a<|startoftext|> B<|ENDOFTEXT|>", "İstanbul ǅ ﬁ é é", "\x1c\x85\xa0 x\x00", "Ελλάς ΟΔΟΣ 日本 😀‍", "x" * 50_000, "don't DON'T we'll--'s '", "² ½ 5٣"]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aB 'sté\t\n\r\x85\xa0\x1c½5Iİ.,-<|>", max_size=60))
def test_as_the_library(text):
    for name, library in LIBRARY.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(OURS[name].packed(text), "<u4").tolist() == ids
        assert OURS[name].count(text) == len(ids)
        assert len(library.encode(OURS[name].normalised(text), add_special_tokens=False).ids) == len(ids)


def rows_of(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, r.text, "x", "y") for r in docs] + [(1000 + k // 2, t, None, "") for k, t in enumerate(EDGES)] + [(None, "Same  TEXT", "", ""), (7, "same text", "", ""), (None, "other", "", "")]


def test_counts_and_cache(spark):
    rows, cache = rows_of(spark), new_path(spark, "cache")
    library = LIBRARY["word_bpe_49k.json"]
    brute = sorted((str(i), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t, *_ in rows)
    assert sorted((str(r[0]), *r[1:]) for r in tokencount.count_tokens(spark.createDataFrame(rows[:150], SCHEMA), cache).collect()) is not None
    first = tokencount.open_cache(spark, cache).count()
    assert sorted((str(r[0]), *r[1:]) for r in tokencount.count_tokens(spark.createDataFrame(rows, SCHEMA), cache).collect()) == brute
    second = tokencount.open_cache(spark, cache)
    assert second.count() > first and second.select("digest").distinct().count() == second.count()
    tokencount.count_tokens(spark.createDataFrame(rows, SCHEMA), cache).collect()
    assert tokencount.open_cache(spark, cache).count() == second.count()
    assert tokencount.count_tokens(spark.createDataFrame([], SCHEMA), new_path(spark, "cache")).count() == 0


def test_counts_come_from_the_cache(spark):
    cache, version = new_path(spark, "cache"), tokencount.version_digest(tokencount.TOKENIZER)
    digest = tokencount._digest(OURS["word_bpe_49k.json"], "Some  text")
    spark.createDataFrame([(version, digest, 4711), ("other version", tokencount._digest(OURS["word_bpe_49k.json"], "b"), 9)], tokencount.CACHE_SCHEMA).write.parquet(cache)
    docs = spark.createDataFrame([(1, "some text", "", ""), (2, "b", "", "")], SCHEMA)
    assert {r.doc_id: (r.n_tokens, r.over_limit) for r in tokencount.count_tokens(docs, cache).collect()} == {1: (4711, True), 2: (1, False)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1]) | st.integers(0, 2**32 - 1), max_size=40))
def test_coding_round_trip(values):
    array = np.array(values, np.uint32)
    control, data = tokenio.pack(array)
    assert len(control) == -(-len(values) // 4)
    assert tokenio.unpack(control, data, len(values)).tolist() == values


def test_file_round_trip_and_damage():
    body = tokenio.encode_file([3, None, 5], [2, 0, 3], np.array([7, 50256, 7, 2, 7], "<u4"))
    ids, nulls, counts, tokens = tokenio.decode_file(body)
    assert nulls.tolist() == [False, True, False] and ids.tolist()[::2] == [3, 5] and counts.tolist() == [2, 0, 3] and tokens.tolist() == [7, 50256, 7, 2, 7]
    with pytest.raises(ValueError):
        tokenio.decode_file(body[:50] + b"\xff" + body[51:])
    assert tokenio.decode_file(tokenio.encode_file([], [], np.zeros(0, "<u4")))[3].tolist() == []


def held(found, rows, library):
    """Whether the files hold every row, in ascending order of id, each where the ids before it end."""
    brute = []
    for i, text, *_ in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        brute.append((str(i), len(ids), zlib.crc32(ids.tobytes())))
    found = sorted(found, key=lambda r: r.start)
    order = [(r.doc_id is not None, r.doc_id or 0) for r in found]
    starts = np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()
    return sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in found) == sorted(brute) and order == sorted(order) and [r.start for r in found] == starts


def test_a_hot_id_is_dealt_to_many_partitions(spark, request):
    key = "spark.sql.adaptive.coalescePartitions.enabled"  # these rows are few enough to be put together again
    spark.conf.set(key, "false")
    request.addfinalizer(lambda: spark.conf.unset(key))
    rows = [(None if k % 2 else 7, f"text {k}", "", "") for k in range(3000)] + [(k, "t", "", "") for k in range(20)]
    folder = new_path(spark, "tokens")
    manifest = tokenio.write_tokens(spark.createDataFrame(rows, SCHEMA).repartition(6), folder)
    sizes = [r.n_docs for r in manifest.collect()]
    assert len(sizes) == 4 and max(sizes) < 1200  # the session has four shuffle partitions
    assert held(tokenio.read_tokens(manifest, folder).collect(), rows, LIBRARY["byte_bpe_50k.json"])


def test_files_against_the_library(spark):
    rows, library = rows_of(spark), LIBRARY["byte_bpe_50k.json"]
    folder = new_path(spark, "tokens")
    manifest = tokenio.write_tokens(spark.createDataFrame(rows, SCHEMA).repartition(3), folder, file_ids=20_000)
    assert held(tokenio.read_tokens(manifest, folder).collect(), rows, library) and manifest.count() > 5
    empty = new_path(spark, "tokens")
    assert tokenio.read_tokens(tokenio.write_tokens(spark.createDataFrame([], SCHEMA), empty), empty).count() == 0
