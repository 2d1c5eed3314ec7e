"""WARC archives: writing whole-file gzip streams, and making them readable record by record."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.session import new_path, ship_package, written

#: Payloads of at least so many bytes are stored once.
LEAST_SHARED = 1000
#: Payload bytes after which a writer starts another archive, bytes that are held at once, level
#: of compression, and the span of an archive that one reading task takes.
ARCHIVE, PIECE, LEVEL, SPAN = 128 << 20, 1 << 20, 4, 16 << 20
#: Bits of the sieve of digests that are shared, 64 to a row; it is broadcast and has no more rows.
SIEVE = 1 << 24

_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "archive string, records long"
INDEX = "archive string, offset long, length long, record_id string, record_type string, uri string"
RECORDS = (
    "page_id long, uri string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary"
)


def planned(pages: DataFrame, key: str = "page_id", uri: str = "url", body: str = "html") -> DataFrame:
    """``page_id``, ``uri``, ``payload``, ``digest``, ``record_type``, ``refers_to`` of each page.

    Of equal payloads of at least 1000 bytes that of the largest page_id is the response, the
    others are revisits of it; smaller ones are all responses. Rows that repeat page_id and
    payload are records of their own, all of them responses where one is. A null body is an
    empty payload, a null page_id is smaller than any other and never referred to unless nothing
    else is there, in which case all are responses. Digests alone are counted; shared ones set
    bits in a sieve of fixed size, and only rows whose bit is set are joined, so a payload that
    occurs once stays where it is read. The pages are read three times.
    """
    body_ = F.coalesce(F.col(body).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(uri).alias("uri"), body_.alias("payload"))
    rows = rows.withColumns({"digest": F.unhex(F.sha1("payload")), "bytes": F.octet_length("payload")})
    shared = (
        rows.filter(F.col("bytes") >= LEAST_SHARED)
        .groupBy("digest", "bytes")
        .agg(F.count("*").alias("n"), F.max("page_id").alias("first"))
        .filter("n > 1 AND first IS NOT NULL")
        .drop("n")
    )
    # As a table its size is known, and a small one is sent to where the pages are.
    shared = written(shared, "shared")
    place = F.xxhash64("digest")
    at, bit = F.pmod(place, F.lit(SIEVE // 64)), F.expr("shiftleft(1L, cast(pmod(shiftright(xxhash64(digest), 40), 64) as int))")
    sieve = shared.select(at.alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    marked = rows.withColumns({"at": at, "bit": bit}).join(F.broadcast(sieve), "at", "left")
    maybe = F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False)) & (F.col("bytes") >= LEAST_SHARED)
    marked = marked.withColumn("maybe", maybe).drop("at", "bit", "bits")
    together = marked.filter("maybe").join(shared, ["digest", "bytes"], "left")
    joined = together.unionByName(marked.filter("NOT maybe").withColumn("first", F.lit(None).cast("long")))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id", "uri", "payload", "digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def header(page_id: int | None, uri: str | None, size: int, digest: bytes, refers: int | None) -> bytes:
    """A record's headers and the HTTP headers of its block; the payload comes after them."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    again = refers is not None
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if again else 'response'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (0 if again else size)}",
    ]
    if uri is not None:
        # Only what would end a header line is escaped, and the escape sign itself.
        safe = uri.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
        lines.append(f"WARC-Target-URI: {safe}")
    if again:
        lines += [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def parse_header(block: bytes) -> dict[str, str]:
    """Headers by lower-case name."""
    lines = block.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def _id(value: str | None) -> int | None:
    text = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text not in ("", "null") else None


def _unescaped(uri: str | None) -> str | None:
    return uri and uri.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def write_archives(plan: DataFrame, folder: str) -> DataFrame:
    """Writes the records as whole-file gzip streams below ``folder``; the list of archives.

    Each task writes its own files under names no other attempt uses, and an archive counts only
    once it is in the returned table, so a repeated task does no harm.
    """
    ship_package(plan.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        # The library would compress files named .gz by itself; the streams here are made as they are.
        out = squeeze = None
        name, records, size, done = "", 0, 0, []
        for batch in batches:
            for row in _rows(batch):
                if out is None:
                    context = TaskContext.get()
                    name = f"{context.partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    out, squeeze = store.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(LEVEL, wbits=31)
                    records = size = 0
                payload = row["payload"]
                out.write(squeeze.compress(header(row["page_id"], row["uri"], len(payload), row["digest"], row["refers_to"])))
                if row["refers_to"] is None:
                    out.write(squeeze.compress(payload))
                out.write(squeeze.compress(b"\r\n\r\n"))
                records, size = records + 1, size + len(payload)
                if size >= ARCHIVE:
                    out.write(squeeze.flush())
                    out.close()
                    out = None
                    done.append((f"{folder}/{name}", records))
        if out is not None:
            out.write(squeeze.flush())
            out.close()
            done.append((f"{folder}/{name}", records))
        if done:
            names, counts = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts, pa.int64())], ["archive", "records"])

    columns = plan.select("page_id", "uri", "payload", "digest", "refers_to")
    return written(columns.mapInArrow(run, MANIFEST), "archives")


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows one by one, so that a batch's payloads are not all copied at once."""
    for i in range(batch.num_rows):
        yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}


class Inflated:
    """A gzip stream of one or many members, read forward with little memory."""

    def __init__(self, source: pa.NativeFile):
        self.source, self.zip, self.held = source, zlib.decompressobj(wbits=31), bytearray()

    def _more(self) -> bool:
        left = self.zip.unconsumed_tail
        if self.zip.eof:
            left, self.zip = self.zip.unused_data, zlib.decompressobj(wbits=31)
        data = left or self.source.read(PIECE)
        # Output that a full piece left inside the decompressor comes without new input.
        more = self.zip.decompress(data, PIECE)
        self.held += more
        return bool(data or more)

    def head(self) -> bytes | None:
        """Up to the next empty line; None at the end."""
        while (at := self.held.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.held:
                    raise ValueError("a record ends within its headers")
                return None
        found = bytes(self.held[:at])
        del self.held[: at + 4]
        return found

    def pieces(self, size: int) -> Iterator[bytes]:
        """The next bytes, piece by piece."""
        while size:
            if not self.held and not self._more():
                raise ValueError("a record ends within its block")
            piece = bytes(self.held[:size])
            del self.held[: len(piece)]
            size -= len(piece)
            if piece:
                yield piece


def normalised(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites archives with each record as a gzip member of its own; the offset index.

    Each archive is inflated once, from front to back. Beside the new archive a sidecar file gets
    a line for each record: offset, length, id. The same rows are returned as a table. Damaged
    input is an error; archives without records have no rows.
    """
    spark = archives.sparkSession
    ship_package(spark)
    n = max(1, min(archives.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(archive)
                store.create_dir(base, recursive=True)
                name = f"{path.rsplit('/', 1)[-1].removesuffix('.warc.gz')}-{uuid.uuid4().hex}.warc.gz"
                rows = []
                with (
                    store.open_input_stream(path, compression=None) as source,
                    store.open_output_stream(f"{base}/{name}", compression=None) as out,
                    store.open_output_stream(f"{base}/{name}.idx") as sidecar,
                ):
                    for entry in members(Inflated(source), out):
                        sidecar.write("{}\t{}\t{}\n".format(*entry[:3]).encode())
                        rows.append((f"{folder}/{name}", *entry))
                        if len(rows) == 20_000:
                            yield _table(rows, INDEX)
                            rows = []
                if rows:
                    yield _table(rows, INDEX)

    return written(archives.select("archive").repartition(n, "archive").mapInArrow(run, INDEX), "warc-index")


def members(stream: Inflated, out: pa.NativeFile) -> Iterator[tuple]:
    """Writes each record as a member; its offset, length, id, type and URI."""
    offset = 0
    while (head := stream.head()) is not None:
        fields = parse_header(head)
        squeeze, length = zlib.compressobj(LEVEL, wbits=31), 0
        size = int(fields["content-length"])
        for piece in chain([head + b"\r\n\r\n"], stream.pieces(size)):
            length += out.write(squeeze.compress(piece))
        if b"".join(stream.pieces(4)) != b"\r\n\r\n":
            raise ValueError("a record does not end with two line ends")
        length += out.write(squeeze.compress(b"\r\n\r\n") + squeeze.flush())
        yield offset, length, fields.get("warc-record-id"), fields.get("warc-type"), _unescaped(fields.get("warc-target-uri"))
        offset += length


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [field.split()[0] for field in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[field.split()[1]] for field in schema.split(", ")]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def read_record(member: bytes, keep_payload: bool) -> tuple:
    """The values of ``RECORDS`` of one gzip member.

    Size and digest of a response are measured on the payload; a revisit has those it states of
    the payload it refers to.
    """
    data = zlib.decompress(member, wbits=31)
    end = data.index(b"\r\n\r\n")
    fields = parse_header(data[:end])
    block = memoryview(data)[end + 4 : end + 4 + int(fields["content-length"])]
    start = data.index(b"\r\n\r\n", end + 4) + 4 - (end + 4)
    payload = block[start:]
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
    kind = fields["warc-type"]
    if kind == "response":
        size, found = len(payload), hashlib.sha1(payload).digest()
        if found != digest:
            raise ValueError(f"{fields['warc-record-id']}: the payload does not have the stated digest")
    else:
        http = bytes(block[:start]).decode().lower()
        size = int(http.partition("content-length:")[2].split()[0])
    kept = bytes(payload) if keep_payload and kind == "response" else None
    ids = _id(fields["warc-record-id"]), _id(fields.get("warc-refers-to"))
    return ids[0], _unescaped(fields.get("warc-target-uri")), kind, ids[1], size, digest.hex(), kept


def read_records(index: DataFrame, keep_payload: bool = True) -> DataFrame:
    """The records an index names, each read by its offset alone.

    Tasks take spans of archives, so one large archive is read by many. ``payload`` is null for
    revisits, and everywhere without ``keep_payload``.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, file, rows, held = None, None, [], 0
        for batch in batches:
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != opened:
                    if file:
                        file.close()
                    store, path = fs.FileSystem.from_uri(archive)
                    opened, file = archive, store.open_input_file(path)
                rows.append(read_record(file.read_at(length, offset), keep_payload))
                held += len(rows[-1][-1] or b"") + 500
                if held >= 16 * PIECE:
                    yield _table(rows, RECORDS)
                    rows, held = [], 0
        if file:
            file.close()
        if rows:
            yield _table(rows, RECORDS)

    span = F.floor(F.col("offset") / SPAN)
    spread = index.select("archive", "offset", "length").repartition("archive", span)
    ship_package(index.sparkSession)
    return spread.sortWithinPartitions("archive", "offset").mapInArrow(run, RECORDS)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as all tasks reach it: one without a scheme is on Spark's default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    # Arrow takes a path of a mounted folder as it is, with any characters.
    return "/" + whole.removeprefix("file:").lstrip("/") if whole.startswith("file:") else whole


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as archives, normalises these, and reads all records back by the index.

    Files go to the shared folder. The result has the columns of ``RECORDS`` without payloads.
    """
    spark = pages.sparkSession
    folder = qualified(spark, new_path(spark, "warc"))
    index = normalised(write_archives(planned(pages), f"{folder}/whole"), f"{folder}/records")
    return read_records(index, keep_payload=False).drop("payload")
