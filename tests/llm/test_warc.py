"""WARC archives: exact round trips, and reading without the index's help."""

import gzip
import hashlib
import io
import zlib

import pytest
from pyarrow import fs

from textguard.llm import queries, warc
from textguard.session import new_path

ROWS = [
    (1, "http://a/", "x" * 2000),
    (2, None, "x" * 2000),
    (3, "http://c/%0A\r\nX: y", "short"),
    (4, "http://d/", "short"),
    (5, "http://e/", None),
    (6, "http://f/", ""),
    (7, "http://g/", "é\r\n\r\nWARC/1.1\r\n\r\n" * 90_000),
    (7, "http://g/", "é\r\n\r\nWARC/1.1\r\n\r\n" * 90_000),
    (None, "http://h/", "x" * 2000),
    (None, None, "y" * 1000),
    (None, None, "y" * 1000),
    (9, "http://i/", "z" * 999),
    (10, "http://i/", "z" * 999),
]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "q") for r in ROWS], "page_id long, url string, html string, digest string")
    folder = new_path(spark, "warc-test")
    archives = warc.write_archives(warc.planned(pages.repartition(3)), f"{folder}/whole")
    index = warc.normalised(archives, f"{folder}/records")
    got = warc.read_records(index).collect()
    assert len(got) == len(ROWS) == index.count()
    bodies = {}
    for r in got:
        if r.record_type == "response":
            assert hashlib.sha1(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes
            bodies[r.page_id] = bytes(r.payload)
    seen = []
    for r in got:
        body = r.payload if r.record_type == "response" else bodies[r.refers_to]
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        seen.append((r.page_id, r.uri, bytes(body)))
    assert sorted(map(repr, seen)) == sorted(repr((i, u, (h or "").encode())) for i, u, h in ROWS)
    revisits = sorted((str(r.page_id), r.refers_to) for r in got if r.record_type == "revisit")
    assert revisits == [("1", 2), ("None", 2)]
    # Every member stands alone, and the members of an archive one after the other are the whole.
    for row in archives.collect():
        store, path = fs.FileSystem.from_uri(row.archive)
        whole = gzip.decompress(store.open_input_stream(path, compression=None).read())
        stem = path.rsplit("/", 1)[-1].removesuffix(".warc.gz")
        rows = [r for r in index.collect() if stem in r.archive]
        rows.sort(key=lambda r: r.offset)
        made = fs.FileSystem.from_uri(rows[0].archive)
        data = made[0].open_input_stream(made[1], compression=None).read()
        assert b"".join(zlib.decompress(data[r.offset : r.offset + r.length], wbits=31) for r in rows) == whole
        lines = made[0].open_input_stream(made[1] + ".idx").read().decode().splitlines()
        assert lines == [f"{r.offset}\t{r.length}\t{r.record_id}" for r in rows]


def test_sieve_of_two_rows_of_bits(spark, monkeypatch):
    """Bits set by chance change nothing, as the shared digests are joined behind the sieve."""
    rows = [(i, None, f"{i // 2 if i % 3 else i}" * 1500) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    most = {}
    for i, _, h in rows:
        most[h] = max(i, most.get(h, -1))
    want = {(i, most[h] if most[h] != i else None) for i, _, h in rows}
    for bits in (64, 1 << 24):
        monkeypatch.setattr(warc, "SIEVE", bits)
        assert {(r.page_id, r.refers_to) for r in warc.planned(pages).collect()} == want


def test_folders_are_qualified(spark):
    for folder in ("/tmp/a b", "file:/tmp/a b", "file:///tmp/a b"):
        assert warc.qualified(spark, folder) == "/tmp/a b"


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages).count() == 0


def test_damaged_streams():
    record = warc.header(1, "u", 3, hashlib.sha1(b"abc").digest(), None) + b"abc\r\n\r\n"
    assert len(list(warc.members(warc.Inflated(io.BytesIO(gzip.compress(record * 3))), io.BytesIO()))) == 3
    many = gzip.compress(record) + gzip.compress(record)
    assert len(list(warc.members(warc.Inflated(io.BytesIO(many)), io.BytesIO()))) == 2
    for bad in (record[:-2], record[:-7], record[:50], b"HTTP/1.1\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.members(warc.Inflated(io.BytesIO(gzip.compress(bad))), io.BytesIO()))


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.op10_warc(spark, folder).collect()}
    assert len(got) == len(pages)
    for p in pages:
        body = p.html.encode()
        assert (got[p.page_id].payload_bytes, got[p.page_id].payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
