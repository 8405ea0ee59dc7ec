"""WARC archives: one gzip member per record, written by Spark and read back sequentially with every digest verified."""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table, scratch_path, staged
from .registry import query

#: Payloads shorter than this are never replaced by a revisit record.
REVISIT_BYTES = 100
#: A task starts a new archive after this many compressed bytes, so a reader holds no more than that and one record.
ARCHIVE_BYTES = 16 << 20
#: Compressed bytes given to the decompressor at a time.
CHUNK = 1 << 16

_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                   ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_READ_SQL = ("page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, "
             "record_type string, refers_to bigint")


def with_originals(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, payload_digest, refers_to`` of every row.

    ``refers_to`` is the smallest page id with the same payload of at least
    ``REVISIT_BYTES`` bytes, null for that page itself and for short
    payloads. A null text is an empty payload; a null page id refers to the
    original and is never one, unless every copy has none. Repeated rows get
    a record each.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    large = rows.filter(F.octet_length("payload") >= REVISIT_BYTES)
    repeated = (large.groupBy("payload_digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n"))
                .filter("n > 1").drop("n"))
    # A staged table: both sides of the join are then plain exchanges, and a hot payload is split.
    joined = rows.join(staged(repeated, "originals"), "payload_digest", "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("original")), F.col("original"))
    return joined.select("page_id", "url", "payload", "payload_digest", refers.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC 1.1 record; a revisit holds the HTTP head only, the payload's length and digest stay in its headers."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
              f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        # Line breaks cannot stand in a header; percent signs keep the escape reversible.
        fields.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                   f"WARC-Refers-To: <urn:page:{refers_to}>"]
    fields += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"WARC-Payload-Digest: sha256:{digest}",
               "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_EMPTY_MEMBER = gzip.compress(b"", mtime=0)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gzip members without their last byte, which is zero and comes back as the writer's line end."""
    archive = size = 0
    for batch in batches:
        numbers, values = [], []
        for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest",
                                                               "refers_to"))):
            member = gzip.compress(record(*row), 6, mtime=0)
            if member[-1]:  # a record of 16 MB or more: an empty member supplies the zero
                member += _EMPTY_MEMBER
            if size and size + len(member) > ARCHIVE_BYTES:
                archive, size = archive + 1, 0
            size += len(member)
            numbers.append(archive)
            values.append(member[:-1])
            if sum(map(len, values[-64:])) > ARCHIVE_BYTES // 4 or len(values) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary()), pa.array(numbers, pa.int32())],
                                                 ["value", "archive"])
                numbers, values = [], []
        yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary()), pa.array(numbers, pa.int32())],
                                         ["value", "archive"])


def write_warc(records: DataFrame, path: str) -> str:
    """Write the rows of ``with_originals`` as WARC files below ``path``, through Spark's own file commit.

    An empty table gives a folder without archives.
    """
    members = records.mapInArrow(_members, "value binary, archive int")
    (members.select(F.col("value").cast("string").alias("value"), "archive")
     .write.partitionBy("archive").option("lineSep", "\0").text(path))
    return path


class WarcError(ValueError):
    """An archive that breaks the format or a digest."""


def _member_bytes(blob: memoryview, start: int) -> Iterator[bytes | int]:
    """Decompressed pieces of the member at ``start``, then the offset behind it."""
    inflate, at = zlib.decompressobj(31), start
    while not inflate.eof:
        if at >= len(blob):
            raise WarcError("the last member is cut off")
        piece = blob[at:at + CHUNK]
        at += len(piece)
        yield inflate.decompress(piece)
    yield at - len(inflate.unused_data)


def read_member(blob: memoryview, start: int) -> tuple[bytes, int]:
    """One record framed by its Content-Length, and the offset behind its member."""
    data, need, end = bytearray(), None, start
    for piece in _member_bytes(blob, start):
        if isinstance(piece, int):
            end = piece
            break
        data += piece
        if need is None and (cut := data.find(b"\r\n\r\n")) >= 0:
            need = cut + 4 + int(_fields(bytes(data[:cut]))[b"content-length"]) + 4
        if need is not None and len(data) > need:
            raise WarcError("bytes behind the record")
    if data and (need is None or len(data) != need or data[-4:] != b"\r\n\r\n"):
        raise WarcError("the record is shorter than its Content-Length")
    return bytes(data), end


def _fields(head: bytes) -> dict[bytes, bytes]:
    lines = head.split(b"\r\n")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(b":") for line in lines[1:])}


def _urn(value: bytes | None) -> int | None:
    return int(value[len(b"<urn:page:"):-1]) if value and value != b"<urn:page:>" else None


def parse_record(data: bytes) -> tuple:
    """Values of one record in the order of the read schema; raises ``WarcError`` where a digest differs."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields, block = _fields(head), rest[:-4]
    if hashlib.sha256(block).hexdigest().encode() != fields[b"warc-block-digest"].removeprefix(b"sha256:"):
        raise WarcError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    length, digest = int(_fields(http)[b"content-length"]), fields[b"warc-payload-digest"].removeprefix(b"sha256:").decode()
    revisit = fields[b"warc-type"] == b"revisit"
    if not revisit and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise WarcError("payload digest differs")
    url = fields.get(b"warc-target-uri")
    if url is not None:
        url = url.decode().replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return (_urn(fields[b"warc-record-id"]), url, None if revisit else payload, length, digest,
            "revisit" if revisit else "response", _urn(fields.get(b"warc-refers-to")))


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records below ``path``: ids, URL, payload, its length and digest, record type and original.

    A revisit has no payload; its length and digest are those of the full
    payload. ``payloads=False`` verifies payloads but leaves them out.
    """
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column("content"):
                blob, at, rows, held = memoryview(value.as_buffer()), 0, [], 0
                while at < len(blob):
                    data, at = read_member(blob, at)
                    if data:
                        row = parse_record(data)
                        rows.append(row if payloads else (*row[:2], None, *row[3:]))
                        held += len(data) if payloads else 0
                    if len(rows) >= 5000 or held > ARCHIVE_BYTES:
                        yield _rows(rows)
                        rows, held = [], 0
                yield _rows(rows)

    files = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true")
             .load(path).select("content"))
    return files.mapInArrow(records, _READ_SQL)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in _READ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _READ)], schema=_READ)


_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
o AS (SELECT payload_digest, min(page_id) AS original FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id > original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > original THEN original END AS refers_to
FROM d LEFT JOIN o USING (payload_digest)
"""


@query("op5_warc", _SQL)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives in the shared folder and read back from them."""
    path = write_warc(with_originals(read_table(spark, sf_dir, "pages")), scratch_path(spark, "warc"))
    return read_warc(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type",
                                                         "refers_to")
