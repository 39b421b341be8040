"""What several operators share: written tables, Arrow slices and word splitting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lodestone.staging import new_path, shared_dir, staged  # noqa: F401

#: Bytes of text that a worker handles at once.
SLICE_BYTES = 2 << 20


def free_name(df: DataFrame, label: str) -> str:
    """A column name that begins with ``label`` and that ``df`` does not have, in any case."""
    taken, nth = {c.lower() for c in df.columns}, 0
    while (name := f"{label}_{nth}").lower() in taken:
        nth += 1
    return name


def place_of(df: DataFrame, column: str) -> int:
    """The place of ``column`` among the columns of ``df``; Spark says whether case matters and whether it is there."""
    df.select(column)
    return df.columns.index(column) if column in df.columns else [c.lower() for c in df.columns].index(column.lower())


def type_of(df: DataFrame, column: str) -> str:
    """The type of ``column``, as schema strings spell it."""
    return df.select(column).schema[0].dataType.simpleString()


def slices(batch: pa.RecordBatch, column: str | int, limit: int = SLICE_BYTES):
    """Consecutive parts of ``batch`` with about ``limit`` bytes of ``column`` each; a longer row comes alone."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield batch.slice(a, b - a)


def words_of(texts: pa.Array, binary: bool = False) -> tuple[np.ndarray, np.ndarray, list]:
    r"""Words ``[^\x20\x09-\x0D]+`` of each text (null: none): codes, row offsets, and the distinct words by code."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = pc.dictionary_encode(lists.flatten())
    codes, offsets = flat.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    words = flat.dictionary.cast(pa.binary()).to_pylist() if binary else flat.dictionary.to_pylist()
    empty = b"" if binary else ""
    if empty in words:
        full = codes != words.index(empty)
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        codes = codes[full]
    return codes.astype(np.int64), offsets.astype(np.int64), words
