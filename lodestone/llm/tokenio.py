"""Token ids in binary files: frequency-ranked, byte-aligned, with control bytes apart from data bytes.

A file is self-contained. Its ids are replaced by their rank in the file's own id frequencies (all of the file is
counted), so the commonest 256 take one data byte. Four values share one control byte, two bits each for the number of
data bytes less one. A reader finds the lengths of four values by one table lookup.

Layout, little-endian, in this order:

    magic       8 bytes  LSTOKEN1
    sizes       5 x u64  documents, ids, distinct ids, control bytes, data bytes
    ids by rank u32 each
    doc ids     i64 each, then one byte each: 1 where the id is null
    counts      u32 each
    control     bytes
    data        bytes
    checksum    u32      crc32 of all before
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import new_path, slices, staged
from .pretrained import Pretrained

TOKENIZER, END_ID = "byte_bpe_50k.json", 2
#: Ids in a file, about; a longer document makes a longer file.
FILE_IDS = 4 << 20
MAGIC, SIZES = b"LSTOKEN1", struct.Struct("<5Q")

#: For each control byte, the data bytes of its four values.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = size - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    data = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8), data[np.arange(4) < size[:, None]]


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    size = LENGTHS[control].reshape(-1)[:n]
    first = np.cumsum(size, dtype=np.int64) - size
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    values = padded[first].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        longer = np.flatnonzero(size > k)
        values[longer] |= padded[first[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def encode_file(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    times = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    used = np.flatnonzero(times)
    by_rank = used[np.lexsort([used, -times[used]])].astype("<u4")
    rank = np.zeros(len(times), np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    control, data = pack(rank[ids])
    parts = [
        MAGIC, SIZES.pack(len(doc_ids), len(ids), len(by_rank), len(control), len(data)), by_rank.tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.array(counts, "<u4").tobytes(), control.tobytes(), data.tobytes(),
    ]
    body = b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


def decode_file(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc ids, where they are null, counts, and all ids in order."""
    if body[:8] != MAGIC or struct.unpack("<I", body[-4:])[0] != zlib.crc32(memoryview(body)[:-4]):
        raise ValueError("not a token file, or a damaged one")
    docs, n, ranks, controls, datas = SIZES.unpack_from(body, 8)
    at = 8 + SIZES.size
    found = []
    for kind, many in (("<u4", ranks), ("<i8", docs), ("u1", docs), ("<u4", docs), ("u1", controls), ("u1", datas)):
        found.append(np.frombuffer(body, kind, many, at))
        at += found[-1].nbytes
    by_rank, doc_ids, nulls, counts, control, data = found
    return doc_ids, nulls.astype(bool), counts.astype(np.int64), by_rank[unpack(control, data, n)] if n else by_rank


MANIFEST = "part int, nth int, path string, n_docs long, n_ids long, n_bytes long"


def _write(folder: str, name: str, end_id: int | None, file_ids: int):
    def run(batches):
        tokenizer, end = Pretrained(name), b"" if end_id is None else struct.pack("<I", end_id)
        files, root = pa.fs.FileSystem.from_uri(folder)
        files.create_dir(root)
        part, nth = TaskContext.get().partitionId(), 0
        ids, packed, held = [], [], 0

        def flush():
            # each attempt of a task writes names of its own; only the manifest says which files count
            body = encode_file(ids, [len(p) // 4 for p in packed], np.frombuffer(b"".join(packed), "<u4"))
            file = f"{part:06d}-{nth:06d}-{uuid.uuid4().hex}.tokens"
            with files.open_output_stream(posixpath.join(root, file)) as out:
                out.write(body)
            row = [[part], [nth], [file], [len(ids)], [held], [len(body)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["part", "nth", "path", "n_docs", "n_ids", "n_bytes"])

        for batch in batches:
            for piece in slices(batch, "text"):
                for doc, text in zip(piece.column("id").to_pylist(), piece.column("text").to_pylist()):
                    row = tokenizer.packed(text or "") + end
                    ids.append(doc)
                    packed.append(row)
                    held += len(row) // 4
                    if held >= file_ids:
                        yield flush()
                        ids, packed, held, nth = [], [], 0, nth + 1
        if ids:
            yield flush()

    return run


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int | None = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of ``docs`` to files under ``folder`` in ascending id order; the manifest (MANIFEST) comes back.

    Null ids come first. Rows of one id follow each other in no stated order: where they are many, or null ids are, they
    are dealt to several range partitions by their place in the input, so no id gathers in one task. A null text is
    empty. Range partitions hold consecutive ids, and files are numbered by (part, nth). The manifest is a written table
    in the same folder and names the files of the task attempts that were kept, so retried and speculative tasks leave at
    most files that nobody reads. Ids are whole numbers; other columns are not read. A very long text is encoded whole and
    makes a longer file. An empty table writes no file and gives an empty manifest.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    first = F.col("id").asc_nulls_first()
    dealt = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(first, F.col("place"))
    ordered = dealt.sortWithinPartitions(first, F.col("text").asc_nulls_first()).drop("place")
    return staged(ordered.mapInArrow(_write(folder, tokenizer, end_id, file_ids), MANIFEST), "manifest")


def _read(folder: str):
    def run(batches):
        files, root = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with files.open_input_stream(posixpath.join(root, name)) as body:
                    doc_ids, nulls, counts, ids = decode_file(body.read())
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                digests = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64(), mask=nulls), pa.array(start + ends - counts), pa.array(counts), pa.array(digests, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of the documents in the files that ``manifest`` names.

    start is the number of ids in all documents before. Offsets are summed over the files of each writer's task, and over
    the tasks; a task reads whole files, each of bounded size but for a longer document. An empty manifest gives an
    empty result.
    """
    own = W.partitionBy("part").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # over one row a task of the writer
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids")).withColumn("base", F.coalesce(F.sum("ids").over(earlier), F.lit(0))).select("part", "base")
    placed = manifest.withColumn("within", F.coalesce(F.sum("n_ids").over(own), F.lit(0))).join(parts, "part").withColumn("start", (F.col("base") + F.col("within")).cast("long"))
    tasks = max(1, min(manifest.count(), 1 << 14))
    return placed.select("path", "start").repartition(tasks).mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "tokens")
    return read_tokens(write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder), folder)
