"""WARC archives: writing pages as transactions, and assembling transactions from archives."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

CRLF = "\r\n"
#: Rows are handed on when their blocks are so long together.
BATCH_BYTES = 4 << 20
RECORDS = (
    "record_type string, record_id string, concurrent_to string, target_uri string, page_id long, refers_id string,"
    " header_digest string, payload_bytes long, payload_digest string, payload binary"
)


def _header(*lines: tuple[str, F.Column | str]) -> F.Column:
    """Header lines; those with a null value are left out."""
    parts = [F.concat(F.lit(f"{name}: "), value if not isinstance(value, str) else F.lit(value), F.lit(CRLF)) for name, value in lines]
    return F.concat_ws("", *parts)


def write(pages: DataFrame, scratch: Scratch, path: str, least_bytes: int = 100, records_per_file: int = 6000) -> None:
    """Write a request, a response or revisit, and a metadata record of every row to gzipped archives at path.

    Of rows with equal payloads of at least ``least_bytes``, those with the smallest page_id are responses
    and the others revisits, which have no payload but the digest. Request and metadata name the response
    or revisit in WARC-Concurrent-To. Records of a page are dealt over files by their order in the table.
    """
    rows = pages.select(
        "page_id",
        F.regexp_replace(F.col("url").cast("string"), r"[\x00-\x20\x7F]", "%20").alias("uri"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    rows = rows.select("*", F.octet_length("html").cast("long").alias("bytes"), F.unhex(F.sha2("html", 256)).alias("digest"))
    # Saved, as revisits name the ids that other rows were given.
    rows = scratch.save(rows.select("*", *(F.expr("uuid()").alias(c) for c in ("capture", "asking", "about"))))
    firsts = rows.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "capture"))).alias("first"), F.max("page_id").alias("last"))
    firsts = scratch.save(firsts.where("first.page_id < last").select("digest", "first"))
    rows = rows.join(firsts, "digest", "left").withColumn("refers_to", F.when(F.col("first.page_id") < F.col("page_id"), F.col("first.capture")))
    urn = lambda c: F.concat(F.lit("<urn:uuid:"), F.col(c), F.lit(">"))
    digest = F.concat(F.lit("sha256:"), F.lower(F.hex("digest")))
    said = _header(("HTTP/1.1 200 OK" + CRLF + "Content-Type", "text/html; charset=utf-8"), ("Content-Length", F.col("bytes").cast("string")))
    record = lambda kind, id, extra, block: F.concat(
        F.lit("WARC/1.1" + CRLF),
        _header(
            ("WARC-Type", kind), ("WARC-Record-ID", urn(id)), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", F.col("uri")), *extra,
            ("Content-Length", F.octet_length(block).cast("string")),
        ),
        F.lit(CRLF), block,
    )
    concurrent = ("WARC-Concurrent-To", urn("capture"))
    revisit = F.col("refers_to").isNotNull()
    told = F.concat(said, F.lit(CRLF), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    profile = F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    asked = F.concat(F.lit("GET / HTTP/1.1" + CRLF), _header(("Referer", F.col("uri"))), F.lit(CRLF))
    facts = F.concat(_header(("page-id", F.col("page_id").cast("string"))), F.lit(""))
    records = F.array(
        record(F.lit("request"), "asking", [concurrent, ("Content-Type", "application/http; msgtype=request")], asked),
        record(kind, "capture", [("WARC-Payload-Digest", digest), ("WARC-Profile", profile), ("WARC-Refers-To", urn("refers_to")), ("Content-Type", "application/http; msgtype=response")], told),
        record(F.lit("metadata"), "about", [concurrent, ("Content-Type", "application/warc-fields")], facts),
    )
    out = rows.select(F.explode(records).alias("value"))
    out.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in head.decode("utf-8", "replace").split(CRLF)[1:])
    return {p[0].strip().lower(): p[1].strip() for p in pairs if len(p) == 2}


def _length(fields: dict[str, str]) -> int:
    size = fields.get("content-length", "")
    return int(size) if size.isascii() and size.isdigit() else 0


def parse(data: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of each record of a stream, by Content-Length, so blocks may hold any bytes.

    A record without a length has an empty block; lines up to the next record are passed over.
    """
    while line := data.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = [line]
        while (line := data.readline()).strip():
            head.append(line)
        fields = _fields(b"".join(head))
        yield fields, data.read(_length(fields))


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records in the archives at path, one row each; payload: whether bodies are returned too."""

    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def row(head: dict[str, str], block: bytes) -> tuple:
        kind, page, body, length = head.get("warc-type"), None, b"", None
        if kind in ("response", "revisit"):
            http, _, body = block.partition(b"\r\n\r\n")
            length = _length(_fields(http)) if kind == "revisit" else len(body)
        elif kind == "metadata":
            number = _fields(b"\r\n" + block).get("page-id", "")
            page = int(number) if number.removeprefix("-").isdigit() else None
        declared = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
        found = hashlib.sha256(body).hexdigest() if kind == "response" else declared
        return kind, head.get("warc-record-id"), head.get("warc-concurrent-to"), head.get("warc-target-uri"), page, head.get("warc-refers-to"), declared, length, found, body if payload and kind == "response" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
        for batch in batches:
            for value in batch.column(0):
                rows, size = [], 0
                for head, block in parse(gzip.open(io.BytesIO(value.as_buffer()))):
                    rows.append(row(head, block))
                    size += len(block) if payload else 500
                    if size > BATCH_BYTES:
                        yield table(rows)
                        rows, size = [], 0
                if rows:
                    yield table(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, RECORDS)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, request, response, metadata).

    Request and metadata records meet the response or revisit that they name in WARC-Concurrent-To.
    A capture without one of them has null there; of several requests or metadata records of a capture
    the one with the smallest record id stays; those that name no record in the archives, and other
    record types, give no row.
    """
    key = F.coalesce("concurrent_to", "record_id")
    fields = F.struct("record_id", "record_type", "target_uri", "page_id", "refers_id", "header_digest", "payload_bytes", "payload_digest", "payload")
    own = lambda *kinds: F.min_by(F.when(F.col("record_type").isin(*kinds), fields), F.when(F.col("record_type").isin(*kinds), F.col("record_id")))
    return (
        records.groupBy(key.alias("capture_id"))
        .agg(own("request").alias("request"), own("response", "revisit").alias("response"), own("metadata").alias("metadata"))
        .where("response is not null")
    )


def archive(pages: DataFrame, scratch: Scratch, path: str, payload: bool = True, **options) -> DataFrame:
    """Write pages to archives at path and assemble the transactions read back from there.

    response.refers_to is the page_id in the metadata of the response that a revisit names by its record id.

    Null html: an empty payload. Null url: no target URI; control characters in it are escaped. Repeated
    rows: a capture each, and of a tie for the smallest page_id all are responses. Null page_id: a
    response, as nothing is smaller. Empty table: no rows. Other columns are ignored.
    """
    write(pages, scratch, path, **options)
    records = scratch.save(read(scratch.spark, path, payload))
    wanted = records.where("refers_id is not null").select("refers_id").distinct()
    about = records.where("record_type = 'metadata'").select(F.col("concurrent_to").alias("refers_id"), "page_id")
    known = scratch.save(about.join(wanted, "refers_id", "left_semi").groupBy("refers_id").agg(F.min("page_id").alias("_page")))
    # What refers to nothing gets keys of its own, so that no task meets all of them.
    found = transactions(records).withColumn("_id", F.coalesce("response.refers_id", "capture_id"))
    found = found.join(known.withColumnRenamed("refers_id", "_id"), "_id", "left")
    page = F.when(F.col("response.refers_id").isNotNull(), F.col("_page"))
    return found.withColumn("response", F.col("response").withField("refers_to", page)).drop("_id", "_page")
