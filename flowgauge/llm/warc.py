"""Legacy web archives (ARC, versions 1 and 2) converted to WARC, and both formats written and read by Spark jobs.

Archives are gzip files of many records, written by Spark's text writer and read whole with its binary reader, so any store
that Spark reaches will do; a file holds FILE_RECORDS records at most, which bounds a task's memory. Records are found by the lengths that their header lines declare, never by searching for separators.
Which payloads occur more than once is decided by digests alone, in Spark.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from flowgauge.llm import support
from flowgauge.session import scratch_dir

FILE_RECORDS = 1000
#: Payloads shorter than this are never revisits.
LEAST_PAYLOAD = 100
#: The fields of a record's header line by version, as the version block of an archive lists them.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


# ---- ARC -----------------------------------------------------------------------------------------------------------


def _octets(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def _in_line(text: Column) -> Column:
    """A value that may stand in a line of fields between single spaces."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x20\x7F]", "")
    return F.when(clean == "", F.lit("-")).otherwise(clean)


def arc_text(version: Column, url: Column, ip: Column, date: Column, kind: Column, status: Column, block: Column) -> Column:
    """One ARC record without its last line end: the header line of its version, then the block."""
    first = F.concat_ws(" ", _in_line(url), ip, date, kind)
    rest = F.when(version == 1, F.lit("")).otherwise(F.concat(F.lit(" "), status, F.lit(" - - 0 -")))
    return F.concat(first, rest, F.lit(" "), _octets(block).cast("string"), F.lit("\n"), block)


def _version_text(version: Column) -> Column:
    """The record that opens an archive: which version's fields its header lines have."""
    body = F.when(version == 1, F.lit(f"1 0 archive\n{ARC_FIELDS[1]}\n")).otherwise(F.lit(f"2 0 archive\n{ARC_FIELDS[2]}\n"))
    return arc_text(version, F.lit("filedesc://archive.arc"), F.lit("0.0.0.0"), F.lit("19960101000000"), F.lit("text/plain"),
                    F.lit("200"), body)


def write_files(texts: DataFrame, ends: str, label: str) -> str:
    """``texts`` (one column) written without a shuffle, FILE_RECORDS to an archive, each followed by ``ends``."""
    path = scratch_dir(texts.sparkSession, label)
    texts.write.option("compression", "gzip").option("lineSep", ends).option("maxRecordsPerFile", FILE_RECORDS).text(path)
    return path


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    kind: str
    status: str | None
    block: bytes


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file after the one that opens it; its version line says how many fields a header line has."""
    source = io.BytesIO(data)
    version = None
    while line := source.readline():
        if not line.strip():
            continue
        fields = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        length = int(fields[-1])
        block = source.read(length)
        if len(block) < length:
            raise ValueError(f"a record declares {length} bytes and has {len(block)}")
        if version is None:
            if not fields[0].startswith("filedesc:"):
                raise ValueError("an ARC file opens with its file description")
            version = int(block.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is not known")
            continue
        if len(fields) != len(ARC_FIELDS[version].split(" ")):
            raise ValueError(f"a header line of version {version} has {len(fields)} fields")
        yield ArcRecord(fields[0], fields[1], fields[2], fields[3], fields[4] if version == 2 else None, block)


# ---- WARC ----------------------------------------------------------------------------------------------------------


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """An HTTP message's head, up to and with its empty line, and its body; without a head all is body."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, gap, body = block.partition(b"\r\n\r\n")
    return (head + gap, body) if gap else (block, b"")


def iso_date(date: str) -> str:
    """An ARC date of 14 digits as WARC writes it; shorter ones are completed by the least value."""
    digits = date + "00000101000000"[len(date):]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def record_id(*parts: str) -> str:
    """The same record always gets the same identifier, so a task that runs again writes the same archive."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256('|'.join(parts).encode()).digest()[:16], version=5)}>"


def header_of(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower().encode():
            return value.strip().decode("utf-8", "replace")
    return None


CONVERTED = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("url", T.StringType()), T.StructField("ip", T.StringType()),
    T.StructField("date", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("place", T.LongType()),
    T.StructField("head", T.BinaryType()), T.StructField("payload", T.BinaryType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
])


def _files_by_batch(files: DataFrame, parse, schema: T.StructType, rows: int = 256) -> DataFrame:
    """``parse(bytes)`` for each file, its rows in batches of a bounded number and about four MB of content."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                waiting, held = [], 0
                for row in parse(data):
                    waiting.append(row)
                    held += sum(len(x) for x in row if isinstance(x, bytes))
                    if len(waiting) >= rows or held > 4 << 20:
                        yield _batch(pa, waiting, schema)
                        waiting, held = [], 0
                if waiting:
                    yield _batch(pa, waiting, schema)

    return support.by_batch(files.select("content"), run, schema)


def _batch(pa, rows: list[tuple], schema: T.StructType):
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    columns = [pa.array(column, kinds[f.dataType.simpleString()]) for column, f in zip(zip(*rows), schema, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=schema.names)


def converted(spark: SparkSession, path: str) -> DataFrame:
    """What WARC records need, from the ARC files below ``path``: one row for each record.

    The identifier follows from url, date, place and digest; the date is written as WARC does; digests are SHA-256 of the
    payload, which is the body of an HTTP message or else the whole block.
    """

    def parse(data: bytes):
        for record in read_arc(data):
            head, body = split_http(record.block)
            digest = hashlib.sha256(body).hexdigest()
            place = header_of(head, "X-Archive-Place")
            if head:
                kind = "application/http; msgtype=response"
            else:
                kind = record.kind if record.kind != "-" else "application/octet-stream"
            yield (record_id(record.url, record.date, place or "", digest), record.url, record.ip, iso_date(record.date), kind,
                   int(place) if place else None, head, body, len(body), digest)

    return _files_by_batch(_archives(spark, path), parse, CONVERTED)


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)


def with_types(records: DataFrame) -> DataFrame:
    """``records`` with record_type and, for revisits, first: place, id, url and date of the record they refer to.

    Of equal payloads the record with the smallest place is the response, of several with that place the one with the least
    identifier. Payloads below LEAST_PAYLOAD bytes are all responses.
    """
    slim = support.stored(records.select("id", "place", "url", "date", "payload_bytes", "payload_digest"), "warc-records")
    first = slim.where(F.col("payload_bytes") >= LEAST_PAYLOAD).groupBy("payload_digest").agg(
        F.min(F.struct(F.col("place").isNull().alias("lost"), "place", "id", "url", "date")).alias("first"),
        F.count(F.lit(1)).alias("copies"))
    facts = support.stored(first.where("copies > 1"), "warc-first")
    known = support.with_group_facts(records, "payload_digest", facts, "copies", slim.count())
    again = F.col("first").isNotNull() & ~(
        F.col("first")["place"].eqNullSafe(F.col("place")) & (F.col("first")["id"] == F.col("id")))
    return known.withColumn("record_type", F.when(again, "revisit").otherwise("response"))


def warc_text() -> Column:
    """One WARC record without its last two line ends: header lines, an empty line, and the block.

    A response holds the HTTP message, a revisit only its head; both carry the digest of the full payload.
    """
    revisit = F.col("record_type") == "revisit"
    # as text, but byte for byte as they are: Spark's text writer does not look into them
    block = F.when(revisit, F.col("head")).otherwise(F.concat("head", "payload")).cast("string")

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    return F.concat(
        F.lit("WARC/1.0\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("id")),
        line("WARC-Date", F.col("date")), line("WARC-Target-URI", F.col("url")), line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(block, 256))),
        F.when(revisit, F.concat(
            line("WARC-Refers-To", F.col("first.id")), line("WARC-Refers-To-Target-URI", F.col("first.url")),
            line("WARC-Refers-To-Date", F.col("first.date")), line("WARC-Profile", F.lit(_PROFILE)),
            F.when(F.col("first.place").isNotNull(), line("X-Refers-To-Place", F.col("first.place").cast("string"))).otherwise(F.lit("")),
        )).otherwise(F.lit("")),
        F.when(F.col("place").isNotNull(), line("X-Archive-Place", F.col("place").cast("string"))).otherwise(F.lit("")),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Type", F.col("kind")), line("Content-Length", _octets(block).cast("string")),
        F.lit("\r\n"), block,
    )


def converted_to_warc(spark: SparkSession, arc_path: str) -> str:
    """The ARC files below ``arc_path`` as WARC files in a new folder, with revisit records for payloads that repeat."""
    return write_files(with_types(converted(spark, arc_path)).select(warc_text().alias("text")), "\r\n\r\n", "warc")


READ = T.StructType([
    T.StructField("record_type", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("date", T.StringType()), T.StructField("place", T.LongType()), T.StructField("refers_to_id", T.StringType()),
    T.StructField("refers_to_place", T.LongType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("payload", T.BinaryType()),
])


def read_warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a WARC file."""
    source = io.BytesIO(data)
    while line := source.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record opens with its version")
        fields: dict[str, str] = {}
        while (line := source.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        block = source.read(length)
        if len(block) < length:
            raise ValueError(f"a record declares {length} bytes and has {len(block)}")
        yield fields, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files below ``path``. Blocks and the payloads of responses are held against their digests."""

    def parse(data: bytes):
        for fields, block in read_warc_records(data):
            if fields["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
                raise ValueError(f"the block of {fields['warc-record-id']} differs from its digest")
            kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
            payload = split_http(block)[1] if kind == "response" else None
            if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"the payload of {fields['warc-record-id']} differs from its digest")
            size = len(payload) if payload is not None else int(fields["x-payload-length"])
            place, other = fields.get("x-archive-place"), fields.get("x-refers-to-place")
            yield (kind, fields["warc-record-id"], fields["warc-target-uri"], fields["warc-date"], int(place) if place else None,
                   fields.get("warc-refers-to"), int(other) if other else None, size, digest, payload)

    return _files_by_batch(_archives(spark, path), parse, READ)


def pages_to_arc(pages: DataFrame, url: str = "url", html: str = "html", page_id: str = "page_id") -> str:
    """``pages`` written as ARC files, a task's every other file of version 2; the page's id travels in a header of its response."""
    body = F.coalesce(pages[html], F.lit(""))
    place = pages[page_id].cast("long")
    number = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # of the row in its task
    rows = pages.select(place.alias("place"), pages[url].alias("url"), body.alias("body"), number.alias("number"))
    rows = rows.withColumn("version", F.floor(F.col("number") / FILE_RECORDS) % 2 + 1)
    mark = F.when(F.col("place").isNotNull(), F.concat(F.lit("X-Archive-Place: "), F.col("place").cast("string"), F.lit("\r\n")))
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "),
                     _octets(F.col("body")).cast("string"), F.lit("\r\n"), F.coalesce(mark, F.lit("")), F.lit("\r\n"), F.col("body"))
    text = arc_text(F.col("version"), F.col("url"), F.lit("0.0.0.0"), F.lit("20200101000000"), F.lit("text/html"), F.lit("200"), block)
    opened = F.when(F.col("number") % FILE_RECORDS == 0, F.concat(_version_text(F.col("version")), F.lit("\n"), text)).otherwise(text)
    return write_files(rows.select(opened.alias("text")), "\n", "arc")


def archived(pages: DataFrame, url: str = "url", html: str = "html", page_id: str = "page_id") -> DataFrame:
    """``pages`` through ARC and WARC files: one record of ``read_warc`` for each row.

    A null html counts as empty; a null url is written as "-"; a page without an id has a record without a place. Rows that
    repeat have a record each. Other columns are not read. No rows give no records.
    """
    spark = pages.sparkSession
    return read_warc(spark, converted_to_warc(spark, pages_to_arc(pages, url, html, page_id)))


SQL = """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM (SELECT *, octet_length(encode(coalesce(html, ''))) >= 100 AND page_id > first AS again FROM (
        SELECT *, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages))
"""


@support.query("op7_arc_to_warc", SQL)
def op7(spark, sf_dir):
    return archived(support.table(spark, sf_dir, "pages")).select(
        F.col("place").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_place").alias("refers_to"))
