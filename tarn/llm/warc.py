"""A content-addressed WARC archive.

Payload bytes are stored once under their SHA-256, which is verified against the bytes before and after; the exact head
of every record (WARC header and HTTP header) is kept in a table of its own. A join of the two gives back the original
records, byte for byte. Of records with equal payloads of at least `least` bytes the one with the smallest page_id is a
response and the others are revisits that refer to it.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm._shared import discard, new_path, save, stored

LEAST = 100
#: Fixed value: the profile that the WARC 1.1 standard names for revisits of equal payloads.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


@dataclass(frozen=True)
class Archive:
    """Folders of the payloads (digest, payload) and of the record heads (page_id, digest, head)."""

    payloads: str
    heads: str


def _record_id(page_id: Column, digest: Column, number: Column) -> Column:
    """Of a row: its number tells rows apart that repeat page_id and payload."""
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("null")), digest, number.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _head() -> Column:
    """The exact bytes before the payload. Line ends and blanks in a URL are percent-encoded; a null URL has no line."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    revisit = F.col("record_type") == "revisit"
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))
    url = F.col("url")
    for raw, coded in (("\r", "%0D"), ("\n", "%0A"), (" ", "%20")):
        url = F.replace(url, F.lit(raw), F.lit(coded))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"), F.col("number"))),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        F.coalesce(line("X-Page-ID", F.col("page_id").cast("string")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(F.col("first.page_id"), F.col("digest"), F.col("first.number"))), F.coalesce(line("X-Refers-To-Page-ID", F.col("first.page_id").cast("string")), F.lit("")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        http,
    )


def write(pages: DataFrame, least: int = LEAST) -> Archive:
    """Writes the archive to the shared folder. Null html is an empty payload; other columns than page_id, url, html are not kept.

    Every row is a record with an id of its own. Rows with equal payloads that also share the smallest page_id are all
    responses, and revisits refer to the first of them; a null page_id sorts last. Two payloads of one digest that differ (in length or in an independent 64-bit
    hash) stop the job.
    """
    spark = pages.sparkSession
    made = Archive(new_path(spark, "payloads"), new_path(spark, "heads"))
    at = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    named = at.select("page_id", "url", "payload", F.sha2("payload", 256).alias("digest"))
    # Rows are numbered when they are stored, so a lost task can't number them otherwise.
    facts = stored(named.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("n"), F.xxhash64("payload").alias("check"), F.monotonically_increasing_id().alias("number")), "facts")
    row = F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "number")
    first = facts.groupBy("digest").agg(F.min(row).alias("first"), F.min("check").alias("c0"), F.max("check").alias("c1"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    same = (F.col("c0") == F.col("c1")) & (F.col("n0") == F.col("n1"))
    first = first.where(F.when(same, True).otherwise(F.raise_error(F.concat(F.lit("different payloads have the digest "), F.col("digest"))).cast("boolean")))
    first = stored(first.select("digest", "first"), "first")
    typed = facts.join(first, "digest").withColumn("record_type", F.when((F.col("n") < least) | F.col("page_id").eqNullSafe(F.col("first.page_id")), "response").otherwise("revisit"))
    save(typed.select("page_id", "digest", F.encode(_head(), "UTF-8").alias("head")), made.heads)
    discard(facts, first)
    # Copies of one payload meet in their map task first, so each task sends a payload once; no row needs to be found again.
    save(named.groupBy("digest").agg(F.first("payload").alias("payload")), made.payloads)
    return made


def records(spark: SparkSession, archive: Archive) -> DataFrame:
    """(digest, head, payload): the parts of every record; payload is null for revisits, whose block ends with the head."""
    heads = spark.read.parquet(archive.heads).withColumn("is_revisit", F.expr("decode(head, 'UTF-8') LIKE 'WARC/1.1\\r\\nWARC-Type: revisit%'"))
    payloads = spark.read.parquet(archive.payloads)
    whole = heads.where("NOT is_revisit").join(payloads, "digest", "left").select("digest", "head", "payload")
    return whole.union(heads.where("is_revisit").select("digest", "head", F.lit(None).cast("binary").alias("payload")))


def bytes_of(spark: SparkSession, archive: Archive) -> DataFrame:
    """(record): each record as it stands in a WARC file."""
    return records(spark, archive).select(F.concat("head", F.coalesce("payload", F.encode(F.lit(""), "UTF-8")), F.encode(F.lit("\r\n\r\n"), "UTF-8")).alias("record"))


def split(data: bytes) -> Iterator[bytes]:
    """The records of a WARC file, found by their lengths; ValueError where one does not end where it says."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at) + 4
        length = re.search(rb"\r\nContent-Length: *(\d+)\r\n", data[at:end], re.I)
        if end < 4 or not length:
            raise ValueError(f"no record at byte {at}")
        end += int(length[1]) + 4
        if data[end - 4 : end] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end at byte {end - 4}")
        yield data[at:end]
        at = end


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and payload of a record; ValueError where lengths or marks do not agree."""
    head, mark, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not mark or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record")
    fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('warc-record-id')} does not end after {n} bytes")
    http, mark, payload = rest[:n].partition(b"\r\n\r\n")
    if not mark or not http.startswith(b"HTTP/"):
        raise ValueError("no HTTP header")
    return fields, payload


_READ = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def _reader(with_payload: bool):
    def read_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        names = [part.split()[0] for part in _READ.split(", ")]
        for batch in batches:
            rows = []
            for record in batch.column(0):
                fields, payload = parse(record.as_py())
                digest = fields["warc-payload-digest"].removeprefix("sha256:")
                revisit = fields["warc-type"] == "revisit"
                if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"the payload of {fields['warc-record-id']} does not have its digest")
                page, to = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                rows.append((int(page) if page else None, fields.get("warc-target-uri"), fields["warc-type"], digest, None if revisit else len(payload), int(to) if to else None, payload if with_payload and not revisit else None))
            columns = list(zip(*rows, strict=True)) or [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return read_


def read(spark: SparkSession, archive: Archive, with_payload: bool = False) -> DataFrame:
    """page_id, url, record_type, payload_digest, payload_bytes, refers_to[, payload] of every record, read from its bytes.

    Digests of responses are verified; a revisit takes length (and payload) from the response that it refers to.
    """
    parsed = bytes_of(spark, archive).mapInArrow(_reader(with_payload), _READ)
    columns = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to"]
    if not with_payload:
        sizes = spark.read.parquet(archive.payloads).select(F.sha2("payload", 256).alias("payload_digest"), F.octet_length("payload").cast("long").alias("_n"))
        return parsed.join(sizes, "payload_digest", "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "_n")).select(*columns)
    stored_ = spark.read.parquet(archive.payloads).select(F.col("digest").alias("payload_digest"), F.col("payload").alias("_payload"))
    full = parsed.join(stored_, "payload_digest", "left").withColumn("payload", F.coalesce("payload", "_payload"))
    return full.withColumn("payload_bytes", F.octet_length("payload").cast("long")).select(*columns, "payload")


def export(spark: SparkSession, archive: Archive, path: str, records_per_file: int = 2000) -> None:
    """Writes plain WARC files: records end with two line ends, which the text writer adds."""
    parts = records(spark, archive).select(F.concat("head", F.coalesce("payload", F.encode(F.lit(""), "UTF-8"))).cast("string").alias("value"))
    parts.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).text(path)


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            data = content.as_py()
            if data[:2] == b"\x1f\x8b":
                data = gzip.decompress(data)
            yield pa.RecordBatch.from_arrays([pa.array(list(split(data)), pa.binary())], names=["record"])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The columns of read() with payload, of plain or gzipped WARC files as export() writes them; a task holds one file at a time.

    Digests of responses are verified; a revisit takes its payload from a response with its digest, and has null where
    no file holds one.
    """
    parsed = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_files, "record binary").mapInArrow(_reader(True), _READ)
    payloads = parsed.where("record_type <> 'revisit'").groupBy("payload_digest").agg(F.first("payload").alias("_payload"))
    full = parsed.join(payloads, "payload_digest", "left").withColumn("payload", F.coalesce("payload", "_payload"))
    return full.withColumn("payload_bytes", F.octet_length("payload").cast("long")).select("page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload")
