import gzip
import hashlib
import io
import zlib

import pyarrow.fs
import pytest

from lodestone.llm import warc
from lodestone.llm.common import new_path

SCHEMA = "page_id long, url string, html string, payload string, sha string"


def brute(rows, least=0):
    first, out = {}, []
    for page, _, html, *_ in rows:
        if page is not None and len((html or "").encode()) >= least:
            first[html or ""] = min(first.get(html or "", page), page)
    for page, _, html, *_ in rows:
        text, to = html or "", first.get(html or "")
        revisit = to is not None and to != page
        out.append((page, len(text.encode()), warc.base32_sha1(text.encode()), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def run(spark, rows, **options):
    whole, members = new_path(spark, "whole"), new_path(spark, "members")
    written = warc.write_archives(spark.createDataFrame(rows, SCHEMA), whole, **options)
    done = warc.normalise(written, whole, members)
    return sorted((tuple(r) for r in warc.read_archives(done, members).collect()), key=str), written, done, members


CASES = [(5, "http://a/ b\r\nX: y", "<p>é</p>", "", ""), (3, None, "<p>é</p>", "", ""), (3, None, "<p>é</p>", "", ""), (None, "u", "<p>é</p>", None, None), (9, "u", None, "", ""), (8, "u", "", "", ""), (None, "u", "alone\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n", "", ""), (None, "u", "alone\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n", "", ""), (11, "u", "x" * 3_000_000, "", ""), (-4, "u", "x" * 3_000_000, "", "")]


def test_cases_and_real_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    rows = [(100 + r.page_id, r.url, r.html, "", "") for r in pages] + CASES
    found, written, done, _ = run(spark, rows, archive_bytes=50_000)
    assert found == brute(rows)
    assert written.count() > 2 and sum(r.n_records for r in done.collect()) == len(rows)


def test_least_size_and_empty_table(spark):
    assert run(spark, CASES, least_revisit_bytes=10)[0] == brute(CASES, 10)
    assert run(spark, [])[0] == []


def test_each_record_is_a_member_at_its_offset(spark):
    _, _, done, folder = run(spark, CASES)
    files, root = pyarrow.fs.FileSystem.from_uri(folder)
    for name in (r.path for r in done.collect()):
        body = files.open_input_file(f"{root}/{name}").read()
        index = files.open_input_file(f"{root}/{name}.idx").read().decode().splitlines()
        whole = gzip.decompress(body)
        parts = [gzip.decompress(body[int(a) : int(a) + int(n)]) for a, n, *_ in (line.split(" ") for line in index)]
        assert b"".join(parts) == whole and list(warc.records([whole])) == parts
        assert [warc.parsed(p)[0]["warc-type"] for p in parts] == [line.split(" ")[2] for line in index]


def test_streams_of_any_cut():
    raw = [warc.record(k, "u", b"<p>" * k, 3 * k, warc.base32_sha1(b"<p>" * k), None, False) for k in range(50)]
    for stream in (gzip.compress(b"".join(raw)), b"".join(map(gzip.compress, raw)), gzip.compress(b"".join(raw[:20])) + gzip.compress(b"".join(raw[20:]))):
        for chunk in (1, 7, 100_000):
            assert list(warc.records(warc.inflated(io.BytesIO(stream), chunk))) == raw
    with pytest.raises(ValueError):
        list(warc.records([b"".join(raw)[:-9]]))


def test_cut_streams_raise():
    raw = [warc.record(k, "u", b"<p>" * k, 3 * k, warc.base32_sha1(b"<p>" * k), None, False) for k in range(50)]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    flushed = squeeze.compress(b"".join(raw[:20])) + squeeze.flush(zlib.Z_FULL_FLUSH)
    whole = flushed + squeeze.compress(b"".join(raw[20:])) + squeeze.flush()
    assert list(warc.records(warc.inflated(io.BytesIO(whole)))) == raw
    members = b"".join(map(gzip.compress, raw))
    for cut in (flushed, whole[:-8], whole[:-1], members[:-1], members[:-8], members + gzip.compress(b"x")[:5]):
        for chunk in (1, 7, 100_000):
            with pytest.raises(ValueError):
                list(warc.records(warc.inflated(io.BytesIO(cut), chunk)))
    assert list(warc.records(warc.inflated(io.BytesIO(members + bytes(700)), 64))) == raw  # padded
    squashed = gzip.compress(warc.record(1, "u", bytes(5_000_000), 5_000_000, "x", None, False))
    assert sum(map(len, warc.inflated(io.BytesIO(squashed), 1000))) > 5_000_000


def test_records_of_other_writers(spark):
    block = b"HTTP/1.1 200 OK\r\ncontent-length: 5\r\n\r\nhello"

    def foreign(kind, *fields, body=block):
        return b"\r\n".join([b"WARC/1.0", b"warc-type:" + kind, *fields, b"CONTENT-LENGTH: %d" % len(body)]) + b"\r\n\r\n" + body + b"\r\n\r\n"

    hexed = hashlib.sha1(b"hello").hexdigest().encode()
    raw = [
        foreign(b"warcinfo", b"WARC-Filename: a.warc\r\n  folded on\r\n\tand on", body=b"software: other"),
        foreign(b"request", b"WARC-Record-ID: <urn:uuid:1>", body=b"GET / HTTP/1.1"),
        foreign(b"response", b"WARC-Record-ID: <urn:uuid:2>"),
        foreign(b"response", b"WARC-Payload-Digest: sha1:" + hexed),
        foreign(b"response", b"WARC-Payload-Digest: md5:0123"),
        foreign(b"revisit", b"WARC-Refers-To: <urn:uuid:2>", body=b""),
    ]
    assert warc.parsed(raw[0])[0]["warc-filename"] == "a.warc folded on and on"
    source, members = new_path(spark, "foreign"), new_path(spark, "members")
    files, root = pyarrow.fs.FileSystem.from_uri(source)
    files.create_dir(root)
    with files.open_output_stream(f"{root}/a.warc.gz", compression=None) as out:
        out.write(gzip.compress(b"".join(raw)))
    done = warc.normalise(spark.createDataFrame([("a.warc.gz",)], "path string"), source, members)
    assert done.first().n_records == len(raw)
    digest = warc.base32_sha1(b"hello")
    found = sorted((tuple(r) for r in warc.read_archives(done, members).collect()), key=str)
    assert found == sorted([(None, 5, digest, "response", None)] * 3 + [(None, None, None, "revisit", None)], key=str)
    bad = foreign(b"response", b"WARC-Payload-Digest: sha1:" + warc.base32_sha1(b"other").encode())
    with pytest.raises(ValueError):
        warc._row(bad)


def test_heads_without_end_or_length():
    with pytest.raises(ValueError, match="no content length"):
        list(warc.records([b"WARC/1.0\r\nWARC-Type: response\r\n\r\nabc\r\n\r\n"]))
    with pytest.raises(ValueError, match="does not end"):
        list(warc.records(b"x" * 60_000 for _ in range(1000)))
    with pytest.raises(ValueError, match="length says"):
        list(warc.records([b"WARC/1.0\r\nContent-Length: 2\r\n\r\nabc\r\n\r\n"]))
