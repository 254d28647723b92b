"""WARC archives: writing captures, reading records back, assembling transactions.

Writing: payloads are named by SHA-256. Payloads of at least ``min_revisit_bytes`` bytes that
several pages share are stored once, with the smallest page id; the other pages become revisit records
that refer to it. The lookup table of shared payloads is pre-aggregated and repeated under a
few salts, so a payload that a third of all pages share is joined by many tasks. A page's
request, response (or revisit) and metadata records are adjacent in one archive; archives are
plain WARC/1.1 text parts, closed after ``archive_bytes``, written by Spark into shared storage.

Reading: every archive is one bounded file, split into records by Content-Length; a file of
several gzip members reads as well. Header names are matched in any case; a record may hold
several WARC-Concurrent-To headers, read as an array. A record without a usable Content-Length ends before the next
record's first line, or with the file.

Assembly: ``assemble`` joins request, response and metadata records through their
WARC-Concurrent-To identifiers into one nested row per capture. A response or revisit
is a capture's centre; the others name it, are named by it, or reach it over other requests and metadata records,
however many stand between; rings that reach no centre stay unassembled. With several
requests (metadata records) for one centre the one with the smallest record id is nested and ``n_requests``
(``n_metadata``) tells their number; ``unassembled`` returns all records that are in no nested row.

Defined cases: a null html is an empty payload; a null page id is written without a page-id field
and read back as null, and never is the one referred to while another page has an id; rows with
the same smallest page id are all responses; repeated rows give records of their own; an empty
table gives no archive and an empty result; other columns are ignored; a null url reads back as null.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rankfold.llm.common import extended, stage
from rankfold.session import scratch_dir

SALTS = 16
CRLF = "\r\n"
RECORD_END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
HEADER_FIELDS = ("WARC-Type", "WARC-Record-ID", "WARC-Concurrent-To", "WARC-Target-URI", "WARC-Date", "WARC-Refers-To",
                 "WARC-Payload-Digest")
REPEATED = "WARC-Concurrent-To"
RECORDS = ("warc_type string, record_id string, concurrent_to array<string>, target_uri string, warc_date string, refers_to_id string, "
           "header_digest string, block_bytes long, payload_bytes long, payload_digest string, fields map<string,string>, archive string")


def _id(kind: str, uid) -> F.Column:
    h = F.md5(F.concat_ws("/", F.lit(kind), uid))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4),
                    F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _record(headers: list[tuple[str, F.Column | str | None]], block: F.Column) -> F.Column:
    """Text of one record without its closing empty lines; headers with a null value are left out."""
    lines = [F.lit("WARC/1.1" + CRLF)]
    for name, value in headers:
        value = F.lit(value) if isinstance(value, str) else value
        lines.append(F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(CRLF)), F.lit("")))
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF)), block]
    return F.concat(*lines)


def captures(pages: DataFrame, min_revisit_bytes: int = 100) -> DataFrame:
    """Pages with payload, digest and, for repeated payloads, the page id they refer to."""
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    named = base.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("bytes", F.octet_length("payload").cast("long"))
    shared = (named.where(F.col("bytes") >= min_revisit_bytes).groupBy("digest")
              .agg(F.min("page_id").alias("first_page"), F.count("*").alias("n")).where("n > 1 and first_page is not null")
              .select("digest", "first_page", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    salted = named.withColumn("uid", F.concat_ws("-", F.coalesce(F.col("page_id").cast("string"), F.lit("")),
                                                 F.monotonically_increasing_id().cast("string")))
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int"))
    again = F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    return (salted.join(shared, ["digest", "salt"], "left")
            .withColumn("refers_to", F.when(again, F.col("first_page"))).drop("salt", "first_page"))


def write_archives(pages: DataFrame, path: str, archive_bytes: int = 16 << 20, compression: str = "none") -> None:
    """Write request, response or revisit, and metadata records of every page under ``path``."""
    c = captures(pages)
    uri = F.regexp_replace("url", r"[\r\n]", "")
    centre, request, meta = _id("response", F.col("uid")), _id("request", F.col("uid")), _id("metadata", F.col("uid"))
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    common = [("WARC-Target-URI", uri), ("WARC-Date", DATE)]
    host = F.regexp_extract(F.coalesce(uri, F.lit("")), "^[a-z]+://([^/]*)", 1)
    tail = F.regexp_extract(F.coalesce(uri, F.lit("")), "^[a-z]+://[^/]*(/.*)$", 1)
    asked = F.concat(F.lit("GET "), F.when(tail == "", "/").otherwise(tail), F.lit(" HTTP/1.1" + CRLF + "Host: "), host, F.lit(CRLF + CRLF))
    told = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit("")),
                    F.coalesce(F.concat(F.lit("refers-to-page: "), F.col("refers_to").cast("string"), F.lit(CRLF)), F.lit("")),
                    F.lit("payload-bytes: "), F.col("bytes").cast("string"), F.lit(CRLF))
    records = [
        _record([("WARC-Type", "request"), ("WARC-Record-ID", request), ("WARC-Concurrent-To", centre), *common,
                 ("Content-Type", "application/http; msgtype=request")], asked),
        F.when(F.col("refers_to").isNull(),
               _record([("WARC-Type", "response"), ("WARC-Record-ID", centre), *common, ("WARC-Payload-Digest", digest),
                        ("Content-Type", "application/http; msgtype=response")], F.concat(http, F.col("payload")))
               ).otherwise(
               _record([("WARC-Type", "revisit"), ("WARC-Record-ID", centre), *common, ("WARC-Payload-Digest", digest),
                        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                        ("Content-Type", "application/http; msgtype=response")], http)),
        _record([("WARC-Type", "metadata"), ("WARC-Record-ID", meta), ("WARC-Concurrent-To", centre), *common,
                 ("Content-Type", "application/warc-fields")], told),
    ]
    # One text row holds a page's records, so they stay adjacent; the writer adds the last record's end.
    rows = c.select(F.concat_ws(RECORD_END, *records).alias("value"))

    def deal(batches):
        """Name the archive of every row: a new one after each ``archive_bytes``."""
        part, number, size = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            names = []
            for n in pc.binary_length(batch.column(0)).to_pylist():
                if size and size + n > archive_bytes:
                    number, size = number + 1, 0
                size += n
                names.append(f"{part:06d}-{number:05d}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names)], names=["value", "archive"])

    (rows.mapInArrow(deal, "value string, archive string").write.partitionBy("archive")
     .option("lineSep", RECORD_END).option("compression", compression).text(path))


class Headers(dict):
    """Header values by lower-case name, found by a name in any case; ``every`` has the values of a repeated one."""

    def add(self, name: str, value: str) -> None:
        self.setdefault(name.lower(), []).append(value)

    def every(self, name: str) -> list[str]:
        return super().get(name.lower(), [])

    def get(self, name: str, default=None):
        return next(iter(self.every(name)), default)

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())[0]


def split_records(content: bytes):
    """(header fields, block) of every record of an archive; gzip members are read one after the other."""
    if content[:2] == b"\x1f\x8b":
        parts = []
        while content:
            member = zlib.decompressobj(31)
            parts.append(member.decompress(content) + member.flush())
            content = member.unused_data
        content = b"".join(parts)
    at, view = 0, memoryview(content)
    while at < len(content):
        head = content.index(b"\r\n\r\n", at)
        fields = Headers()
        for line in content[at:head].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields.add(name.decode().strip(), value.decode().strip())
        start = head + 4
        told = fields.get("Content-Length", "")
        if told.isascii() and told.isdigit():
            end = start + int(told)
        else:
            # The empty line that ends the header may also be the first half of the record's end.
            end = content.find(b"\r\n\r\nWARC/1.", start)
            if end < 0:
                end = len(content) - 4 * content.endswith(b"\r\n\r\n")
            end = max(end, start)
        yield fields, view[start:end]
        at = end + 4


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of all archives under ``path``; ``with_payload`` adds the payload bytes."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*")
             .load(path).select("path", "content"))
    ddl = RECORDS + (", payload binary" if with_payload else "")
    names = extended(files.select().schema, ddl).names

    def parse(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows = []
                for fields, block in split_records(content.as_py()):
                    kind, content_type = fields.get("WARC-Type"), fields.get("Content-Type", "")
                    payload, told = block, None
                    if content_type.startswith("application/http"):
                        raw = bytes(block)
                        payload = block[raw.index(b"\r\n\r\n") + 4:]
                    elif content_type == "application/warc-fields":
                        told = [tuple(p.strip() for p in line.split(":", 1)) for line in bytes(block).decode().split(CRLF) if ":" in line]
                    row = [fields.every(k) or None if k == REPEATED else fields.get(k) for k in HEADER_FIELDS] + [len(block), len(payload), hashlib.sha256(payload).hexdigest(),
                                                                    told, name.as_py()]
                    rows.append(row + [bytes(payload)] if with_payload else row)
                    if len(rows) == 2000:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    def batch_of(rows):
        kinds = [*[pa.list_(pa.string()) if k == REPEATED else pa.string() for k in HEADER_FIELDS], pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*rows), kinds)], names=names)

    return files.mapInArrow(parse, ddl)


def _centres(records: DataFrame) -> DataFrame:
    return records.where(F.col("warc_type").isin("response", "revisit", "resource"))


def _links(records: DataFrame) -> DataFrame:
    """(record_id, capture_id) of every request and metadata record that belongs to a capture.

    ``concurrent_to`` is one identifier or an array of them. Records that name a centre, or are named by one, come first; each pass then
    adds those that name a record found by the pass before, until nothing is added.
    """
    told = F.col("concurrent_to")
    told = told if isinstance(records.schema["concurrent_to"].dataType, T.ArrayType) else F.array(told)
    named = records.select("warc_type", "record_id", F.explode(told).alias("to")).where("to is not null")
    centres = _centres(records)
    ids = centres.select(F.col("record_id").alias("capture_id")).distinct()
    others = named.where(F.col("warc_type").isin("request", "metadata")).select("record_id", "to")
    back = _centres(named).select(F.col("to").alias("record_id"), F.col("record_id").alias("to"))
    # Joins are written before repeats go, so that a record named by very many is joined by many tasks.
    direct = stage(others.unionByName(back).join(ids, F.col("to") == F.col("capture_id")).select("record_id", "capture_id"), "links").distinct()
    rest = stage(others.join(ids, F.col("to") == F.col("capture_id"), "left_anti"), "unlinked")
    found, last = direct, direct
    while not rest.isEmpty() and not last.isEmpty():
        via = last.select(F.col("record_id").alias("via"), "capture_id")
        more = stage(rest.join(via, F.col("to") == F.col("via")).select("record_id", "capture_id"), "links").distinct()
        last = stage(more.join(found, ["record_id", "capture_id"], "left_anti"), "links")
        found = found.unionByName(last)
    return found


def _satellites(records: DataFrame, links: DataFrame, kind: str) -> DataFrame:
    """Per capture: the request (metadata) record with the smallest id, and how many there are."""
    body = F.struct("record_id", *[c for c in records.columns if c != "record_id"])
    found = records.where(F.col("warc_type") == kind).withColumn("__body", body).select("record_id", "__body")
    # min_by keeps one record per capture from the map side on, however many there are.
    return (found.join(links, "record_id").groupBy("capture_id")
            .agg(F.min_by("__body", "record_id").alias(kind), F.count("*").alias("n_requests" if kind == "request" else "n_metadata")))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, request, metadata, n_requests, n_metadata."""
    centre = _centres(records).select(F.col("record_id").alias("capture_id"), F.struct(*records.columns).alias("response"))
    links = _links(records)
    out = centre.join(_satellites(records, links, "request"), "capture_id", "left").join(_satellites(records, links, "metadata"), "capture_id", "left")
    return out.fillna(0, ["n_requests", "n_metadata"])


def unassembled(records: DataFrame) -> DataFrame:
    """Records that ``assemble`` nests nowhere: without a capture, or beyond a capture's first."""
    rows = assemble(records)
    used = None
    for kind in ("response", "request", "metadata"):
        part = rows.where(F.col(kind).isNotNull()).select(F.col(f"{kind}.record_id").alias("record_id"))
        used = part if used is None else used.unionByName(part)
    return records.join(used.distinct(), "record_id", "left_anti")


def archive_round_trip(pages: DataFrame, archive_bytes: int = 16 << 20, compression: str = "gzip") -> DataFrame:
    """Write all pages, read the archives back, assemble: one digest row per page."""
    spark = pages.sparkSession
    path = scratch_dir(spark, "warc")
    write_archives(pages, path, archive_bytes, compression)
    if not list_archives(spark, path):
        return spark.createDataFrame([], page_schema(pages))
    rows = assemble(stage(read_archives(spark, path), "records"))
    told = F.col("metadata.fields")
    revisit = F.col("response.warc_type") == "revisit"
    return rows.select(
        told["page-id"].cast(pages.schema["page_id"].dataType).alias("page_id"),
        F.when(revisit, told["payload-bytes"].cast("long")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.substring_index("response.header_digest", ":", -1)).otherwise(F.col("response.payload_digest")).alias("payload_digest"),
        F.col("response.warc_type").alias("record_type"),
        told["refers-to-page"].cast(pages.schema["page_id"].dataType).alias("refers_to"))


def list_archives(spark: SparkSession, path: str) -> bool:
    """Whether any archive was written (an empty table writes none)."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    entries = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jvm.org.apache.hadoop.fs.Path(folder, "archive=*"))
    return entries is not None and len(entries) > 0


def page_schema(pages: DataFrame):
    id_type = pages.schema["page_id"].dataType.simpleString()
    return f"page_id {id_type}, payload_bytes long, payload_digest string, record_type string, refers_to {id_type}"
