"""WARC archives: written as whole-file gzip streams, normalised to one gzip member per record with an offset index.

Three steps, each a map over files that a written manifest names:

* ``write_archives``: records, whole archives in one gzip stream each (what a plain compressor makes);
* ``normalise``: inflates each stream once, from front to back, and writes every record as its own gzip member, and
  beside the archive a sidecar index, one line a record: offset, length, type and record id;
* ``read_archives``: takes the index and inflates members by their offsets.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, slices, staged

#: Uncompressed bytes of an archive, about.
ARCHIVE_BYTES = 32 << 20
LEAST_REVISIT_BYTES, LEVEL, CHUNK, HEAD_BYTES = 0, 6, 1 << 20, 1 << 20
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
MANIFEST = "path string, n_records long, n_bytes long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_id(urn: str) -> int | None:
    """The id in ``record_id``'s form; None for a record without an id and for those of other writers."""
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn)
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, first: int | None, revisit: bool) -> bytes:
    """One record; a revisit has the HTTP head of the full payload and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "urn:page"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def inflated(stream, chunk: int = CHUNK):
    """The uncompressed bytes of a gzip file in parts, whether it is one member or many.

    Zero bytes that pad the file after a member are skipped. A ValueError says that the file ends inside a member, be it
    within the data or before the checksum, so no cut archive passes for a whole one.
    """
    inflate, begun = zlib.decompressobj(31), False
    while data := stream.read(chunk):
        while data:
            if not begun and not (data := data.lstrip(b"\0")):
                break
            begun = True
            if part := inflate.decompress(data, chunk):
                yield part
            data = inflate.unconsumed_tail
            if inflate.eof:
                data, inflate, begun = inflate.unused_data, zlib.decompressobj(31), False
    while begun:  # what a part's limit has held back
        if part := inflate.decompress(inflate.unconsumed_tail, chunk):
            yield part
        elif not inflate.eof:
            raise ValueError("the archive ends inside a gzip member")
        begun = not inflate.eof


def _fields(head: bytes) -> dict[str, str]:
    """Head fields by lower-case name; a line that begins with white space goes on with the field before."""
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def _length(fields: dict[str, str]) -> int:
    if not (found := fields.get("content-length", "")).isdecimal():
        raise ValueError("a record has no content length")
    return int(found)


def records(parts):
    """The raw records in consecutive parts of an uncompressed archive, one at a time, whoever wrote them.

    Field names are of any case, fields may be folded. A ValueError says that the archive ends inside a record, that a
    head is longer than HEAD_BYTES, or that a record has no length or does not end where its length says.
    """
    held, parts = bytearray(), iter(parts)

    def have(n):
        while len(held) < n:
            if (part := next(parts, None)) is None:
                return False
            held.extend(part)
        return True

    while have(1):
        sought = 0
        while (end := held.find(b"\r\n\r\n", sought)) < 0:
            sought = max(0, len(held) - 3)
            if len(held) > HEAD_BYTES:
                raise ValueError("a record's head does not end")
            if not have(len(held) + 1):
                raise ValueError("the archive ends inside a record's head")
        total = end + 4 + _length(_fields(bytes(held[:end]))) + 4
        if not have(total):
            raise ValueError("the archive ends inside a record")
        if held[total - 4 : total] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield bytes(held[:total])
        del held[:total]


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Head fields by lower-case name, and the block."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    return fields, block[: _length(fields)]


def member(raw: bytes, level: int = LEVEL) -> bytes:
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


def _manifest_row(name: str, n: int, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["path", "n_records", "n_bytes"])


def _write(folder: str, archive_bytes: int):
    def run(batches):
        files, root = pa.fs.FileSystem.from_uri(folder)
        files.create_dir(root)
        out, name, n, size, squeeze = None, "", 0, 0, None

        def close():
            out.write(squeeze.flush())
            out.close()
            return _manifest_row(name, n, size)

        for batch in batches:
            for part in slices(batch, "payload"):
                for page, url, payload, length, sha, first, revisit in zip(*(c.to_pylist() for c in part.columns)):
                    if out is None:
                        name, n, size, squeeze = f"{uuid.uuid4().hex}.warc.gz", 0, 0, zlib.compressobj(1, zlib.DEFLATED, 31)
                        out = files.open_output_stream(posixpath.join(root, name), compression=None)
                    raw = record(page, url, payload, length, base64.b32encode(bytes.fromhex(sha)).decode(), first, revisit)
                    out.write(squeeze.compress(raw))
                    n, size = n + 1, size + len(raw)
                    if size >= archive_bytes:
                        yield close()
                        out = None
        if out is not None:
            yield close()

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_revisit_bytes: int = LEAST_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes one record for each row of ``pages`` into gzip streams under ``folder``; the manifest comes back.

    Of records whose payloads are equal and have ``least_revisit_bytes`` or more, those with the smallest id are
    responses and the others revisit it; smaller payloads are always responses. A null html is an empty payload. A null
    id is never the smallest; equal payloads under null ids only are all responses. Repeated rows get a record each.
    Ids are whole numbers; other columns are not read, and columns may have any further names. A very long payload is
    one record of its archive, held whole by its task. An empty table writes no archive and gives an empty manifest.

    Equal payloads meet as digests only, aggregated before the shuffle; the join of digests has narrow rows and AQE can
    split it. A payload travels once, by its own id. Attempts of a task write files of their own and the manifest, a
    written table, names those that count.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    keys = staged(rows.select("page", "sha", F.octet_length("payload").cast("long").alias("size")), "payloads")
    first = keys.where(F.col("size") >= least_revisit_bytes).groupBy("sha").agg(F.min("page").alias("first"))
    known = keys.distinct().join(first, "sha", "left")
    revisit = F.coalesce(~F.col("first").eqNullSafe(F.col("page")) & F.col("first").isNotNull(), F.lit(False))
    known = known.select(F.col("page").alias("known_page"), F.col("sha").alias("known_sha"), "size", "first", revisit.alias("revisit"))
    joined = rows.join(known, rows.page.eqNullSafe(F.col("known_page")) & (rows.sha == F.col("known_sha")))
    ordered = joined.select("page", "url", "payload", "size", "sha", "first", "revisit")
    return staged(ordered.mapInArrow(_write(folder, archive_bytes), MANIFEST), "archives")


def _normalise(folder: str, to: str, level: int):
    def run(batches):
        files, root = pa.fs.FileSystem.from_uri(folder)
        out_files, out_root = pa.fs.FileSystem.from_uri(to)
        out_files.create_dir(out_root)
        for batch in batches:
            for source in batch.column("path").to_pylist():
                name, offset, index = f"{uuid.uuid4().hex}.warc.gz", 0, []
                with files.open_input_stream(posixpath.join(root, source), compression=None) as stream, out_files.open_output_stream(posixpath.join(out_root, name), compression=None) as out:
                    for raw in records(inflated(stream)):
                        own = member(raw, level)
                        out.write(own)
                        fields, _ = parsed(raw)
                        index.append(f"{offset} {len(own)} {fields.get('warc-type', '-')} {fields.get('warc-record-id', '-')}\n")
                        offset += len(own)
                with out_files.open_output_stream(posixpath.join(out_root, f"{name}.idx"), compression=None) as out:
                    out.write("".join(index).encode())
                yield _manifest_row(name, len(index), offset)

    return run


def normalise(manifest: DataFrame, folder: str, to: str, level: int = LEVEL) -> DataFrame:
    """Rewrites the archives that ``manifest`` names, however compressed, record by record under ``to``, each with its
    sidecar index ``<archive>.idx``; the new manifest comes back. A task inflates its stream once and holds one record.
    Records of any type and writer are kept as they are; a cut or damaged archive raises ValueError (see ``inflated``
    and ``records``)."""
    tasks = max(1, min(manifest.count(), 1 << 14))
    return staged(manifest.select("path").repartition(tasks).mapInArrow(_normalise(folder, to, level), MANIFEST), "members")


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _row(raw: bytes) -> tuple | None:
    fields, block = parsed(raw)
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "revisit":
        size = _fields(http).get("content-length", "")
        return _page_id(fields.get("warc-record-id", "")), int(size) if size.isdecimal() else None, stated, kind, _page_id(fields.get("warc-refers-to", ""))
    digest = base32_sha1(payload)
    if stated not in (None, digest, hashlib.sha1(payload).hexdigest()) and ":" not in stated:
        raise ValueError(f"{fields.get('warc-record-id')}: the payload does not have its digest")
    return _page_id(fields.get("warc-record-id", "")), len(payload), digest, kind, None


def _read(folder: str, rows_at_once: int = 4096):
    def batch_of(rows):
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    def run(batches):
        files, root = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("path").to_pylist():
                with files.open_input_stream(posixpath.join(root, f"{name}.idx"), compression=None) as lines:
                    index = lines.read().decode().splitlines()
                with files.open_input_file(posixpath.join(root, name)) as archive:
                    rows = []
                    for line in index:
                        offset, length, _ = line.split(" ", 2)
                        if (row := _row(zlib.decompress(archive.read_at(int(length), int(offset)), 31))) is not None:
                            rows.append(row)
                        if len(rows) == rows_at_once:
                            yield batch_of(rows)
                            rows = []
                    if rows:
                        yield batch_of(rows)

    return run


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to) of responses and revisits, read by offsets.

    The digest is the bare base32 SHA-1 of the full payload, checked against the one that a response states as SHA-1;
    a revisit's digest and size are those of the full payload, from its head and its HTTP head, null where it states
    none. refers_to is null for responses. Records of other types (an archive's own description, requests) are passed
    over, and ids that other writers gave come back null. An empty manifest gives an empty result.
    """
    tasks = max(1, min(manifest.count(), 1 << 14))
    return manifest.select("path").repartition(tasks).mapInArrow(_read(folder), _READ)


def query(spark, sf_dir: str) -> DataFrame:
    whole, members = new_path(spark, "warc-whole"), new_path(spark, "warc-members")
    written = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), whole)
    return read_archives(normalise(written, whole, members), members)


#: base32 of the hexadecimal SHA-1 is spelt out five bits at a time.
SQL = """
WITH sized AS (
    SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages
), firsts AS (SELECT sha, min(page_id) AS first_id FROM sized GROUP BY sha)
SELECT
    page_id, payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
        ((('0x' || substr(sha || '0', 1 + CAST(k * 5 // 4 AS INT), 2))::INT >> CAST(3 - (k * 5) % 4 AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM sized JOIN firsts USING (sha)
"""
