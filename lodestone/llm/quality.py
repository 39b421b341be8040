r"""Quality rules: base counts, and the fertility of a public tokenizer with rejection bands for each script.

A word is ``[^\x20\x09-\x0D]+``. Each word is encoded by itself with its leading word mark, so a text's figures follow
from its words and a batch encodes each distinct word once.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import place_of, slices, type_of, words_of

VOCABULARY = "piece_bpe_32k.model"
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
SCRIPTS = ("none", "latin", "cyrillic", "greek", "arabic", "han_kana_hangul", "other")
#: First code points of blocks and their script, in order; a letter belongs to the last block that begins at or before it.
BLOCKS = ((0x00, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x600, "arabic"), (0x700, "other"), (0x1100, "han_kana_hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2E80, "han_kana_hangul"), (0xA000, "other"), (0xAC00, "han_kana_hangul"), (0xD800, "other"), (0xF900, "han_kana_hangul"), (0xFB00, "other"), (0xFF66, "han_kana_hangul"), (0x10000, "other"), (0x20000, "han_kana_hangul"), (0x32000, "other"))


@dataclass(frozen=True)
class Band:
    """What a text of a script may have.

    Entropy is judged against ``least_entropy`` from ``least_tokens`` tokens on, and against ``floor_entropy`` from
    ``floor_tokens`` on: short texts of good prose have less of it than long ones.
    """

    least_chars_per_token: float
    most_chars_per_token: float
    most_fallback: float
    least_entropy: float = 2.5
    least_tokens: int = 64
    floor_entropy: float = 2.5
    floor_tokens: int = 64


#: Latin entropy: the 0.1 per cent quantile of the documents labelled good that pass the base rules and have 384 tokens
#: or more (sf0.1: 6.16). Characters per token and fallback part no junk from prose on these tables at any cut that keeps
#: the good (README), so their limits stay wide; so do all limits of scripts of which the tables have no document.
BANDS = {
    "none": Band(1.0, 12.0, 0.5),
    "latin": Band(1.15, 8.0, 0.2, least_entropy=6.16, least_tokens=384),
    "cyrillic": Band(1.0, 8.0, 0.2),
    "greek": Band(0.6, 8.0, 0.4),
    "arabic": Band(0.5, 8.0, 0.6),
    "han_kana_hangul": Band(0.25, 4.0, 0.95),
    "other": Band(0.2, 8.0, 1.0),
}

_STARTS = [s for s, _ in BLOCKS]
_SCRIPT_OF = [SCRIPTS.index(name) for _, name in BLOCKS]


def script_of(word: str) -> int:
    """Index in SCRIPTS of the word's first letter; 0 where it has none."""
    for c in word:
        if c.isalpha():
            return _SCRIPT_OF[int(np.searchsorted(_STARTS, ord(c), "right")) - 1] if ord(c) >= 0x370 else 1
    return 0


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _window_repeats(codes: np.ndarray, row: np.ndarray, size: int) -> np.ndarray:
    """For each word, whether it lies in a window of ``size`` words that its row has twice or more."""
    inside = np.zeros(len(codes) + 1, np.int64)
    n = len(codes) - size + 1
    if n < 2:
        return inside[:-1] > 0
    start = np.flatnonzero(row[:n] == row[size - 1 :])
    key = row[start].astype(np.uint64)
    for k in range(size):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + codes[start + k].astype(np.uint64)
    start = start[np.argsort(key, kind="stable")]
    key = np.sort(key)
    a, b = start[:-1][same := key[1:] == key[:-1]], start[1:][same]
    equal = (row[a] == row[b]) & np.all([codes[a + k] == codes[b + k] for k in range(size)], axis=0)
    if not equal.all():  # two windows with one key: sort by the words themselves
        order = np.lexsort([*(codes[start + k] for k in reversed(range(size))), row[start]])
        start = start[order]
        a, b = start[:-1], start[1:]
        equal = (row[a] == row[b]) & np.all([codes[a + k] == codes[b + k] for k in range(size)], axis=0)
    hit = np.unique(np.concatenate([a[equal], b[equal]]))
    np.add.at(inside, hit, 1)
    np.add.at(inside, hit + size, -1)
    return np.cumsum(inside[:-1]) > 0


def _duplicate_lines(texts: pa.Array) -> np.ndarray:
    """For each text, its lines that have a word and equal an earlier line."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    flat = pc.dictionary_encode(lists.flatten())
    worded = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(flat.dictionary)), 0).to_numpy(zero_copy_only=False)
    codes, at = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy()
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    full = worded[codes]
    distinct = np.unique(row[full] * np.int64(len(worded) + 1) + codes[full]) // (len(worded) + 1)
    return np.bincount(row[full], minlength=len(at) - 1) - np.bincount(distinct, minlength=len(at) - 1)


class Fertility:
    """Token figures of words under a sentencepiece vocabulary."""

    def __init__(self, vocabulary: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))
        self.size = self.model.get_piece_size()
        self.byte = np.array([self.model.is_byte(i) for i in range(self.size)])

    def of(self, words: list[str], codes: np.ndarray, row: np.ndarray, rows: int):
        """Tokens, byte-fallback tokens and token entropy (bits) of each row."""
        pieces = self.model.encode(words, num_threads=1) if words else []
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.fromiter(chain.from_iterable(pieces), np.int64, int(lengths.sum()))
        first = np.cumsum(lengths) - lengths
        per_word = lengths[codes]
        token_row = np.repeat(row, per_word)
        within = np.arange(len(token_row)) - np.repeat(np.cumsum(per_word) - per_word, per_word)
        token = ids[np.repeat(first[codes], per_word) + within]
        n = np.bincount(token_row, minlength=rows)
        fallback = np.bincount(token_row[self.byte[token]], minlength=rows)
        pair, times = np.unique(token_row * np.int64(self.size) + token, return_counts=True)
        weighted = np.bincount(pair // self.size, weights=times * np.log2(times), minlength=rows)
        entropy = np.where(n > 0, np.log2(np.maximum(n, 1)) - weighted / np.maximum(n, 1), 0.0)
        return n, fallback, entropy


def _judge(vocabulary: str, bands: dict[str, Band]):
    def run(batches):
        fertility = Fertility(vocabulary)
        limits = {k: np.array([getattr(bands[s], k) for s in SCRIPTS]) for k in Band.__dataclass_fields__}
        for batch in batches:
            for part in slices(batch, "text"):
                codes, at, words = words_of(part.column("text"))
                rows = part.num_rows
                row = np.repeat(np.arange(rows), np.diff(at))
                n_words = np.diff(at)
                chars = _sums(np.fromiter(map(len, words), np.int64, len(words))[codes], at)
                symbols = _sums(np.fromiter((sum(map(w.count, SYMBOLS)) for w in words), np.int64, len(words))[codes], at)
                repeated = np.bincount(row[_window_repeats(codes, row, WINDOW)], minlength=rows)
                tokens, fallback, entropy = fertility.of(words, codes, row, rows)
                scripts = np.fromiter(map(script_of, words), np.int64, len(words))[codes]
                counted = np.bincount(row * len(SCRIPTS) + scripts, minlength=rows * len(SCRIPTS)).reshape(rows, -1)
                counted[:, 0] = 0
                script = np.argmax(counted, axis=1)
                per_token = chars / np.maximum(tokens, 1)
                share = fallback / np.maximum(tokens, 1)
                base_failed = (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n_words)
                inside = (
                    (per_token >= limits["least_chars_per_token"][script])
                    & (per_token <= limits["most_chars_per_token"][script])
                    & (share <= limits["most_fallback"][script])
                    & ((entropy >= limits["least_entropy"][script]) | (tokens < limits["least_tokens"][script]))
                    & ((entropy >= limits["floor_entropy"][script]) | (tokens < limits["floor_tokens"][script]))
                )
                made = pa.RecordBatch.from_pydict(
                    {
                        "n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": _duplicate_lines(part.column("text")), "n_repeat_words": repeated,
                        "base_failed": base_failed, "kept": ~base_failed & inside, "n_tokens": tokens, "chars_per_token": per_token, "fallback_share": share, "token_entropy": entropy,
                        "script": pa.array([SCRIPTS[k] for k in script.tolist()]),
                    },
                    schema=_ARROW,
                )
                yield pa.RecordBatch.from_arrays([part.column("id"), *made.columns], ["doc_id", *_ARROW.names])

    return run


_ARROW = pa.schema([*((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_tokens", pa.int64()), *((n, pa.float64()) for n in ("chars_per_token", "fallback_share", "token_entropy")), ("script", pa.string())])
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_tokens long, chars_per_token double, fallback_share double, token_entropy double, script string"


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, bands: dict[str, Band] = BANDS) -> DataFrame:
    """One row (doc_id, then SCHEMA) for each row of ``docs``; no shuffle. doc_id has the id's own type.

    A null or empty text has no words and fails the base rules. Ids may be null or repeat; each row is judged by its
    own text. Very long texts are split for no figure. An empty table gives an empty result.
    """
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_judge(vocabulary, bands), f"doc_id {type_of(docs, id_col)}, {SCHEMA}")


def _filter(text_at: int, vocabulary: str, bands: dict[str, Band]):
    judge = _judge(vocabulary, bands)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                pair = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(text_at)], ["id", "text"])
                kept = pa.concat_arrays([b.column("kept") for b in judge([pair])])
                yield batch.filter(kept)

    return run


def keep_good(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, bands: dict[str, Band] = BANDS) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns; no shuffle.

    A null or empty text has no words and goes. Repeated rows are judged alike, texts of any length whole. An empty
    table gives an empty result.
    """
    return docs.mapInArrow(_filter(place_of(docs, text_col), vocabulary, bands), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
