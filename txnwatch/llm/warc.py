"""WARC archives of pages, and their chunked record table.

Pages become WARC/1.1 records in gzip archives written by Spark's text writer, so any shared
store Spark writes to will do. A payload longer than ``CHUNK`` is cut into a first segment and
continuation records, as the standard has it, so no archive line, no row and no buffer holds more
than a chunk. Reading streams archives line by line (a gzip archive is one task's input) and turns
records into rows of record identifier and chunk number. Only the digest state is carried from
chunk to chunk; each row has the payload's length and SHA-1 up to and including it.

Which of the records with equal payloads is the response is settled before writing, by an
aggregate on digest and length that is summed before its shuffle.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.llm.tables import checked, kept
from txnwatch.session import shared_folder

CHUNK, BATCH = 1 << 18, 1 << 22
VERSION, DATE = b"WARC/1.1", "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = (
    "page_id long, chunk_no int, record_type string, refers_to long, bytes_so_far long, "
    "digest_so_far string, last boolean, chunk binary"
)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def digests(pages: DataFrame) -> DataFrame:
    """(page_id, row_key, payload_bytes, payload_digest) of the full payload of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for value in batch.column(2):
                view = memoryview(value.as_buffer()) if value.is_valid else b""
                sizes.append(len(view))
                found.append(base32(hashlib.sha1(view).digest()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(found, pa.string())],
                ["page_id", "row_key", "payload_bytes", "payload_digest"],
            )

    return payloads(pages).select("page_id", "row_key", "payload").mapInArrow(
        run, "page_id long, row_key long, payload_bytes long, payload_digest string"
    )


def payloads(pages: DataFrame) -> DataFrame:
    """(page_id, row_key, url, payload); row_key tells rows with one page_id apart."""
    html = F.coalesce("html", F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.xxhash64(html).alias("row_key"),
        F.col("url").cast("string").alias("url"),
        html.cast("binary").alias("payload"),
    )


def record_types(found: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``digests`` with record_type and refers_to, one row per page_id and row_key."""
    same = ["payload_bytes", "payload_digest"]
    largest = found.groupBy(*same).agg(F.max("page_id").alias("original"))
    joined = found.distinct().join(largest, same)
    again = (F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("original"))
    return joined.select(
        "page_id",
        "row_key",
        *same,
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("original")).alias("refers_to"),
    )


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: bytes) -> int | None:
    name = urn.strip(b"<>").rsplit(b":", 1)[1]
    return None if name == b"none" else int(name)


def _record(fields: list[tuple[str, object]], block: memoryview | bytes) -> bytes:
    """A record up to the first of the two line ends after its block."""
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in fields if v is not None)]
    return b"\r\n".join([*lines, f"Content-Length: {len(block)}".encode(), b"", b""]) + bytes(block) + b"\r\n"


def _records(page_id, url, payload, size, digest, kind, refers_to) -> Iterator[bytes]:
    named = [
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else quote(url, safe="/:?#[]@!$&'()*+,;=%~-._")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Payload-Length", size),
        ("Content-Type", "text/html; charset=utf-8"),
    ]
    if kind == "revisit":
        extra = [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", PROFILE)]
        yield _record([("WARC-Type", kind), *named, *extra], b"")
        return
    first = memoryview(payload)[:CHUNK]
    segment = [("WARC-Segment-Number", 1)] if size > CHUNK else []
    yield _record([("WARC-Type", kind), *named, *segment], first)
    for number, start in enumerate(range(CHUNK, size, CHUNK), 2):
        more = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", _urn(page_id)[:-1] + f":{number}>"),
            ("WARC-Date", DATE),
            ("WARC-Segment-Origin-ID", _urn(page_id)),
            ("WARC-Segment-Number", number),
            ("WARC-Segment-Total-Length", size if start + CHUNK >= size else None),
        ]
        yield _record(more, memoryview(payload)[start : start + CHUNK])


def write(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write one WARC record per row of ``pages`` (page_id, url, html) into archives at ``path``.

    A null html is an empty payload, a null url is left out. Of records with equal payloads of at
    least ``min_bytes`` bytes, that with the largest page_id is the response; rows that repeat
    this page_id with the same payload are all responses. A null page_id counts as smaller than
    any other. Other columns are not read. An empty table gives archives without records.
    """
    kinds = checked(record_types(kept(digests(pages), "digests"), min_bytes), "record-types", 500_000)
    rows, renamed = payloads(pages), kinds.withColumnsRenamed({"page_id": "_page", "row_key": "_key"})
    joined = rows.join(
        renamed, rows.page_id.eqNullSafe(renamed["_page"]) & (rows.row_key == renamed["_key"])
    ).select("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            columns = [batch.column(i) for i in range(7)]
            for i in range(batch.num_rows):
                values = [c[i].as_py() for k, c in enumerate(columns) if k != 2]
                payload = columns[2][i].as_buffer()
                for record in _records(values[0], values[1], payload, *values[2:]):
                    held.append(record)
                    size += len(record)
                    if size >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])

    records = joined.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    records.write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


class _Reader:
    """Turns the lines of archives into chunk rows."""

    def __init__(self, with_chunks: bool):
        self.with_chunks, self.rows, self.size = with_chunks, [], 0
        self.head, self.left, self.gap, self.parts = None, None, 0, []
        self.origin = None

    def line(self, line: bytes) -> None:
        if self.left is not None:
            if self.left >= len(line) + 2:  # the line end belongs to the block too
                self.parts += (line, b"\r\n")
                self.left -= len(line) + 2
                return
            if self.left != len(line):
                raise ValueError("a record's block is not as long as its header says")
            self.parts.append(line)
            self.left, self.gap = None, 1
            self.block(b"".join(self.parts))
            self.parts = []
        elif self.gap:
            if line:
                raise ValueError("a record does not end where its header says")
            self.gap = 0
        elif self.head is None:
            if line != VERSION:
                raise ValueError(f"not the start of a record: {line[:40]!r}")
            self.head = {}
        elif line:
            name, _, value = line.partition(b": ")
            self.head[name] = value
        else:
            self.left = int(self.head[b"Content-Length"])

    def block(self, block: bytes) -> None:
        head, self.head = self.head, None
        kind = head[b"WARC-Type"]
        if kind == b"continuation":
            page, total, digest, state = self.origin
            if head[b"WARC-Segment-Origin-ID"] != _urn(page).encode():
                raise ValueError("a continuation does not follow its record")
            number = int(head[b"WARC-Segment-Number"])
        else:
            page, number = _page(head[b"WARC-Record-ID"]), 1
            total = int(head[b"WARC-Payload-Length"])
            digest = head[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode()
            if kind == b"revisit":
                self.row(page, 1, "revisit", _page(head[b"WARC-Refers-To"]), total, digest, True, None)
                return
            state = [hashlib.sha1(), 0]
            self.origin = (page, total, digest, state)
        state[0].update(block)
        state[1] += len(block)
        last, so_far = state[1] == total, base32(state[0].digest())
        if state[1] > total or last and so_far != digest:
            raise ValueError(f"payload of page {page} is not what its header says")
        self.row(page, number, "response", None, state[1], so_far, last, block)

    def row(self, *values) -> None:
        *most, chunk = values
        self.rows.append((*most, chunk if self.with_chunks else None))
        self.size += 100 + len(chunk or b"") * self.with_chunks

    def batch(self) -> pa.RecordBatch:
        types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        arrays = [pa.array(c, t) for c, t in zip(zip(*self.rows), types)]
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays(arrays, names)


def chunks(spark: SparkSession, path: str, with_chunks: bool = True) -> DataFrame:
    """The chunked record table of the archives at ``path``: page_id, chunk_no, record_type,
    refers_to, bytes_so_far, digest_so_far, last, chunk (null in revisits, which have one row,
    or where ``with_chunks`` is false). Raises on records whose lengths or digests are wrong."""
    lines = spark.read.option("lineSep", "\r\n").text(path).select(F.col("value").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(with_chunks)
        for batch in batches:
            for value in batch.column(0):
                reader.line(value.as_py())
                if reader.size >= BATCH:
                    yield reader.batch()
        if reader.head is not None or reader.left is not None:
            raise ValueError("an archive ends within a record")
        if reader.rows:
            yield reader.batch()

    return lines.mapInArrow(run, CHUNKS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives of ``pages`` to the shared folder and list what is read back: page_id,
    payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = shared_folder(spark, "llm-warc")
    write(pages, path)
    return (
        chunks(spark, path, with_chunks=False)
        .where("last")
        .select(
            "page_id",
            F.col("bytes_so_far").alias("payload_bytes"),
            F.col("digest_so_far").alias("payload_digest"),
            "record_type",
            "refers_to",
        )
    )
