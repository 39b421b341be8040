"""Byte-level BPE by monoid tree reduction.

A piece is encoded by encoding its halves, down to single bytes, and joining them; every id of more than one byte comes
out of a join. Merges are made in order of rank, and a token's rank is
above that of what it was merged from, so whether a merge ever crosses a seam depends only on the last token before it
and the first one after it: a sequence of tokens is the encoding of its bytes if and only if each pair of neighbours
is the encoding of its own bytes. A join therefore re-encodes a window round the seam and lets it grow, on the side
that fails, until the pairs at both of its edges hold; then every pair holds and the tokens outside are final.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, slices, type_of
from .presplit import BYTE_BPE, Pieces, is_latin

RANKS = "byte_bpe_50k.tiktoken"
#: Tokens whose bytes are one leaf of the tree that decodes.
LEAF_TOKENS = 64
_PATTERN = regex.compile(public_tokenizers.PATTERN)


def load_ranks(name: str = RANKS) -> dict[bytes, int]:
    with open(public_tokenizers.path(name), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=1)
def vocabulary(name: str = RANKS) -> tuple[dict[bytes, int], dict[int, bytes]]:
    """Ranks by token and tokens by rank: a worker that runs many tasks reads the file once."""
    ranks = load_ranks(name)
    return ranks, {i: token for token, i in ranks.items()}


class Encoder:
    """Encodes and decodes pieces by the ranks of a vocabulary. A task has its own."""

    def __init__(self, ranks: dict[bytes, int], bytes_of: dict[int, bytes] | None = None):
        self.ranks = ranks
        self.bytes_of = bytes_of or {i: token for token, i in ranks.items()}
        #: (a, b) -> None where two tokens that meet stay as they are, else the encoding of the bytes of both
        self._meet = Pieces(self._met)

    @classmethod
    def named(cls, name: str) -> Encoder:
        return cls(*vocabulary(name))

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece; a piece that is a token is that token."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self._reduced(piece, 0, len(piece))

    def _reduced(self, piece: bytes, start: int, end: int) -> list[int]:
        """The tree over ``piece[start:end]``: leaves of two bytes or one, joined upwards."""
        size = end - start
        if size > 2:
            half = (start + end) >> 1
            return self._joined(self._reduced(piece, start, half), self._reduced(piece, half, end))
        whole = self.ranks.get(piece[start:end]) if size else None
        if whole is not None:
            return [whole]
        return [self.ranks[piece[k : k + 1]] for k in range(start, end)]

    def _met(self, pair: tuple[int, int]) -> list[int] | None:
        found = self._merged(self.bytes_of[pair[0]] + self.bytes_of[pair[1]])
        return None if found == [*pair] else found

    def _joined(self, left: list[int], right: list[int]) -> list[int]:
        """The monoid's product: the encoding of the bytes of both, each of them an encoding."""
        window = self._meet[left[-1], right[0]]
        if window is None:
            return left + right
        i = j = 1
        while True:
            before, after = left[: len(left) - i], right[j:]
            more_left = before and self._meet[before[-1], window[0]] is not None
            more_right = after and self._meet[window[-1], after[0]] is not None
            if not more_left and not more_right:
                return before + window + after
            i, j = min(len(left), 2 * i) if more_left else i, min(len(right), 2 * j) if more_right else j
            window = self._merged(b"".join(map(self.bytes_of.__getitem__, left[len(left) - i :] + right[:j])))

    def _merged(self, piece: bytes) -> list[int]:
        """Merges the pair of lowest rank, the leftmost of equals, until none is left."""
        n, ranks = len(piece), self.ranks
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := ranks.get(piece[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            if end[k] < 0 or end[k] >= n or ranks.get(piece[k : end[end[k]]]) != rank:
                continue  # one of the two has been merged since
            gone = end[k]
            end[k], end[gone] = end[gone], -1
            if end[k] < n:
                before[end[k]] = k
                if (r := ranks.get(piece[k : end[end[k]]])) is not None:
                    heapq.heappush(heap, (r, k))
            if (b := before[k]) >= 0 and (r := ranks.get(piece[b : end[k]])) is not None:
                heapq.heappush(heap, (r, b))
        ids, k = [], 0
        while k < n:
            ids.append(ranks[piece[k : end[k]]])
            k = end[k]
        return ids

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_TOKENS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def packed(self, piece: str) -> bytes:
        return np.array(self.encode(piece.encode()), "<u4").tobytes()


def pieces_of(text: str) -> list[str]:
    """The matches of the public pattern; every character belongs to one."""
    return BYTE_BPE.findall(text) if is_latin(text) else _PATTERN.findall(text)


class Worker:
    """What a task encodes with: each distinct piece goes through the tree once as long as it is kept."""

    def __init__(self, ranks_name: str):
        self.encoder = Encoder.named(ranks_name)
        self._pieces = Pieces(self.encoder.packed)

    def of(self, texts: list[str | None]) -> tuple[list[bytes], list[str], list[str]]:
        """The packed ids of each text, their digest, and that of what they decode to."""
        packed = [b"".join(map(self._pieces.__getitem__, pieces_of(t or ""))) for t in texts]
        decoded = (self.encoder.decode(np.frombuffer(p, "<u4").tolist()) for p in packed)
        return packed, [hashlib.sha256(p).hexdigest() for p in packed], [hashlib.sha256(d).hexdigest() for d in decoded]


def _encode_batches(ranks_name: str):
    def run(batches):
        worker = Worker(ranks_name)
        for batch in batches:
            for part in slices(batch, "text"):
                packed, of_ids, of_text = worker.of(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256), one per row of ``docs``; no shuffle.

    doc_id has the id's own type. A null text is empty: no tokens, digests of no bytes. Ids may be null or repeat, and
    other columns are not read. Memory is bounded by a slice of texts (or one longer text) and the pieces that a task
    keeps. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encode_batches(ranks), f"doc_id {type_of(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _table_batches(ranks_name: str, names: list[str]):
    def run(batches):
        worker = Worker(ranks_name)
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                packed, of_ids, of_text = worker.of(part.column(part.num_columns - 1).to_pylist())
                ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32)))
                made = [pa.array(np.diff(ends)), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string()), ids]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names)

    return run


_MADE = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "token_ids": "array<int>"}


def with_ids(docs: DataFrame, text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """``docs`` with columns n_tokens, ids_sha256, decoded_sha256 and token_ids at the end; no shuffle.

    Columns that have these names already are replaced, all others stay, whatever their names. A null or empty text has
    no ids. A very long text is encoded whole, by itself. Repeated rows come back repeated; an empty table gives an
    empty result.
    """
    rows = docs.drop(*_MADE)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *(f"{n} {t}" for n, t in _MADE.items())])
    rows = docs.select(*(F.col(f"`{c}`") for c in rows.columns), F.col(text_col).cast("string").alias(free_name(rows, "text")))
    return rows.mapInArrow(_table_batches(ranks, [*rows.columns[:-1], *_MADE]), schema)


def decoded(rows: DataFrame, ids_col: str = "token_ids", ranks: str = RANKS) -> DataFrame:
    """``rows`` with the text of their ids in a column decoded_text; null for null ids."""

    @F.pandas_udf("string")
    def text_of(ids):
        encoder = Encoder.named(ranks)
        return ids.map(lambda x: None if x is None else encoder.decode(x.tolist()).decode("utf-8", "replace"))

    return rows.withColumn("decoded_text", text_of(F.col(ids_col)))


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
