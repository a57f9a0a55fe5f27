"""Web archives: write captures as WARC records, read them back, and assemble
transactions from request, response and metadata records.

Writing stays in DataFrame operations: a row becomes the text of three records
(capture, request, metadata) and Spark's text sink ends each with the blank
line WARC asks for.  Of captures with equal payloads of at least
``REVISIT_BYTES`` bytes the first (smallest page_id, then order of the table) is
a response; the others are revisits that carry no payload.  First ones are found
from digests and ids alone; the captures of a payload that very many pages share
are spread over tasks when they meet them.  Each task begins a new
archive before a record that would bring the running size over ``ARCHIVE_BYTES``,
so an archive holds at most so much, or a single larger record.

Reading inflates each archive piece by piece and parses it by the records'
declared lengths, so payloads may hold anything, blank lines included; payload
digests are computed anew and held against the declared ones.  ``transactions``
joins the records through their concurrent-to identifiers and gives one nested
row per capture.

Defined results: null html is an empty payload; a null url is the empty target;
a null page_id stays null and comes after all others (it is the response only
where no other page has the payload); repeated rows are captures of their own;
very long payloads are kept whole; an empty table gives no captures.  Extra
columns are ignored.  Captures are numbered by their place, so the pages must
come from a stored table, whose rows stay in place.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ARROW_ROWS, arrow_rows, hot_keys, new_path, pick, salted_join, stored

REVISIT_BYTES, ARCHIVE_BYTES, PIECE = 100, 128 << 20, 1 << 20
DATE = "2024-01-01T00:00:00Z"
EOL = "\r\n"
RECORD = "kind string, record_id string, concurrent_to string, refers_to string, target string, payload_bytes bigint, payload_digest string, fields map<string,string>"


def _record(kind: str, uid, block, *headers):
    """Text of one record: version line, headers, blank line, block."""
    lines = [F.lit(f"WARC/1.1{EOL}WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind, F.lit(f"{EOL}WARC-Date: {DATE}{EOL}WARC-Record-ID: "), uid]
    for name, value in headers:
        lines.append(F.when(value.isNotNull(), F.concat(F.lit(f"{EOL}{name}: "), value)).otherwise(F.lit("")))
    return F.concat(*lines, F.lit(f"{EOL}Content-Length: "), F.octet_length(block).cast("string"), F.lit(EOL + EOL), block)


def dealt_to_archives(records: DataFrame, most: int) -> DataFrame:
    """Records (value) with the number of their archive (archive) in their task,
    by running bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = held = 0
        for b in batches:
            numbers = []
            for n in pa.compute.binary_length(b.column(0)).to_pylist():
                n += len(EOL + EOL)
                if held and held + n > most:
                    archive, held = archive + 1, 0
                held += n
                numbers.append(archive)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(numbers, pa.int32())], ["value", "archive"])

    arrow_rows(records.sparkSession)
    return records.mapInArrow(run, "value string, archive int")


def write_archives(pages: DataFrame, path: str, most: int = ARCHIVE_BYTES) -> None:
    """Write pages (page_id, url, html) as gzipped WARC files, which hold at most
    so many bytes of records each, in folders below ``path``."""
    rows = pick(pages, "page_id", "url", "html").select(
        "page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20]", "%20").alias("target"), F.coalesce("html", F.lit("")).alias("html"), F.monotonically_increasing_id().alias("uid")
    )
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html"))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "uid")
    first = stored(rows.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "first")
    rows = salted_join(rows, first.drop("copies"), "digest", hot_keys(first, "digest", "copies"), "uid", "left")
    rows = rows.withColumn("again", F.col("first").isNotNull() & (F.col("first.uid") != F.col("uid")))

    def name(kind: str, uid):
        return F.concat(F.lit("<urn:attestra:"), uid.cast("string"), F.lit(f":{kind}>"))

    capture = name("capture", F.col("uid"))
    declared = F.concat(F.lit("sha256:"), F.col("digest"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("bytes").cast("string"), F.lit(EOL + EOL))
    response = _record(
        F.when(F.col("again"), F.lit("revisit")).otherwise(F.lit("response")),
        capture,
        F.concat(http, F.when(F.col("again"), F.lit("")).otherwise(F.col("html"))),
        ("WARC-Target-URI", F.col("target")),
        ("WARC-Payload-Digest", declared),
        ("WARC-Refers-To", F.when(F.col("again"), name("capture", F.col("first.uid")))),
        ("WARC-Profile", F.when(F.col("again"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
    )
    host = F.regexp_extract("target", r"://([^/?#]*)", 1)
    request = _record("request", name("request", F.col("uid")), F.concat(F.lit("GET "), F.col("target"), F.lit(f" HTTP/1.1{EOL}Host: "), host, F.lit(EOL + EOL)), ("WARC-Target-URI", F.col("target")), ("WARC-Concurrent-To", capture), ("Content-Type", F.lit("application/http; msgtype=request")))
    fields = F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(EOL)), F.lit(""))
    metadata = _record("metadata", name("metadata", F.col("uid")), fields, ("WARC-Target-URI", F.col("target")), ("WARC-Concurrent-To", capture), ("Content-Type", F.lit("application/warc-fields")))
    records = rows.select(F.explode(F.array(response, request, metadata)).alias("value"))
    dealt_to_archives(records, most).write.partitionBy("archive").option("lineSep", EOL + EOL).option("compression", "gzip").text(path)


def parse(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive that
    comes in pieces; no more than a record and a piece is held."""
    held, source = bytearray(), iter(pieces)

    def fill(wanted: int) -> bool:
        while len(held) < wanted:
            piece = next(source, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while fill(1):
        end = held.find(b"\r\n\r\n")
        while end < 0:
            if not fill(len(held) + 1):
                raise ValueError("record is cut short")
            end = held.find(b"\r\n\r\n")
        version, *lines = held[:end].decode().split(EOL)
        if not version.startswith("WARC/"):
            raise ValueError("not at the start of a record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        stop = end + 4 + int(headers["content-length"])
        if not fill(stop + 4) or held[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("record is cut short")
        yield headers, bytes(held[end + 4 : stop])
        del held[: stop + 4]


def inflated(data: bytes) -> Iterator[bytes]:
    """A gzipped archive, or one whose records are gzipped one by one, in pieces."""
    rest = memoryview(data)
    while len(rest):
        z, at = zlib.decompressobj(47), 0
        while not z.eof:
            if at >= len(rest):
                raise ValueError("archive is cut short")
            tail = bytes(rest[at : at + PIECE])
            at += len(tail)
            while tail and not z.eof:
                yield z.decompress(tail, PIECE)
                tail = z.unconsumed_tail
        rest = rest[at - len(z.unused_data) :]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under ``path``, without their payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string())]
        names = [f.split()[0] for f in RECORD.split(", ")]
        for b in batches:
            for content in b.column(0):
                rows = []
                for h, block in parse(inflated(content.as_py())):
                    size = digest = None
                    fields: dict[str, str] = {}
                    declared = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    if h["warc-type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        if digest != declared:
                            raise ValueError(f"payload of {h['warc-record-id']} differs from its digest")
                    elif h["warc-type"] == "revisit":
                        digest = declared
                    elif h["warc-type"] == "metadata":
                        fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode().split(EOL) if x)}
                    rows.append((h["warc-type"], h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), size, digest, list(fields.items())))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    arrow_rows(spark, 1)  # a row is a whole archive
    try:
        return stored(spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, RECORD), "records")
    finally:
        arrow_rows(spark, ARROW_ROWS)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture, request and metadata records that
    name each other, and for a revisit the response that it refers to."""
    whole = F.struct(*[F.col(c) for c in records.columns])

    def part(kind: str) -> DataFrame:
        return records.where(F.col("kind") == kind).groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min(F.struct("record_id", "target")).alias(kind), F.first("fields").alias(f"{kind}_fields"))

    captures = records.where(F.col("kind").isin("response", "revisit")).select("record_id", "refers_to", whole.alias("capture"))
    nested = captures.join(part("request").drop("request_fields"), "record_id", "left").join(part("metadata"), "record_id", "left")
    origin = nested.where("capture.kind = 'response'").select(F.col("record_id").alias("refers_to"), F.col("capture.payload_bytes").alias("origin_bytes"), F.col("metadata_fields")["page-id"].alias("origin_page"))
    again = nested.where("capture.kind = 'revisit'")
    counts = records.where("kind = 'revisit'").groupBy("refers_to").agg(F.count(F.lit(1)).alias("n"))
    again = salted_join(again, origin, "refers_to", hot_keys(counts, "refers_to", "n"), "record_id", "left")
    return nested.where("capture.kind = 'response'").withColumn("origin_bytes", F.lit(None).cast("long")).withColumn("origin_page", F.lit(None).cast("string")).unionByName(again)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as archives, read them back, and state each page's capture."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    t = transactions(read_records(spark, path))
    return t.select(
        F.col("metadata_fields")["page-id"].cast("long").alias("page_id"),
        F.coalesce("capture.payload_bytes", "origin_bytes").alias("payload_bytes"),
        F.col("capture.payload_digest").alias("payload_digest"),
        F.col("capture.kind").alias("record_type"),
        F.col("origin_page").cast("long").alias("refers_to"),
        F.col("capture.target").alias("target"),
        F.col("request.target").alias("request_target"),
    )


ORACLE = f"""
WITH p AS (SELECT page_id, regexp_replace(coalesce(url, ''), '[\\x00-\\x20]', '%20', 'g') AS target, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, target, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id > first THEN first END AS refers_to, target, target AS request_target FROM f
"""
