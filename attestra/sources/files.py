"""Binary intake: signatures, archive inspection, content hash, ceilings.

Files are rows of Spark's ``binaryFile`` source.  Signatures are native; only
the inside of a zip archive is looked at in Python, in Arrow batches.  Refused
files stay as rows with a status and a reason.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 25 << 20
MAX_UNPACKED = 200 << 20
MAX_PIXELS = 40_000_000


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files under a path; Spark's source lists no files of zero bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def scan(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files under a path, without reading them."""
    return read_files(spark, path, pattern).select("path", "length")


def against_manifest(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """The entries of a manifest (entry, file), and whether their file is there;
    files that no entry announces come as rows without an entry."""
    return manifest.join(found.select("file").distinct().withColumn("_there", F.lit(True)), "file", "full_outer").select("entry", "file", F.coalesce("_there", F.lit(False)).alias("present"))


def kind_of(content: Column) -> Column:
    """Media kind by the first bytes."""
    start = lambda n: F.hex(F.substring(content, 1, n))
    return (
        F.when(start(5) == "255044462D", "PDF")
        .when(start(8) == "89504E470D0A1A0A", "PNG")
        .when(start(3) == "FFD8FF", "JPEG")
        .when(start(4).isin("504B0304", "504B0506", "504B0708"), "ZIP")
        .otherwise("UNSUPPORTED")
    )


def inspect_zip(data: bytes, most: int = MAX_UNPACKED) -> tuple[str, str, str | None]:
    """(kind, status, reason) of a zip archive."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            entries = z.infolist()
            if sum(e.file_size for e in entries) > most:
                return "UNSUPPORTED", "UNSUPPORTED", "declared size is over the ceiling"
            if any(e.flag_bits & 1 for e in entries):
                return "UNSUPPORTED", "UNSUPPORTED", "encrypted"
            names = {e.filename for e in entries}
            if any(n.lower().endswith("vbaproject.bin") for n in names):
                return "UNSUPPORTED", "UNSUPPORTED", "macros"
            if z.testzip() is not None:
                return "UNSUPPORTED", "CORRUPT", "damaged member"
            return ("XLSX", "RECEIVED", None) if "xl/workbook.xml" in names else ("UNSUPPORTED", "UNSUPPORTED", "not a workbook")
    except (zipfile.BadZipFile, OSError, EOFError, NotImplementedError, RuntimeError):
        return "UNSUPPORTED", "CORRUPT", "damaged archive"


def _archives(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        rows = [inspect_zip(bytes(d)) if d is not None else (None, None, None) for d in s]
        yield pd.DataFrame(rows, columns=["kind", "status", "reason"])


def pixels(content: Column) -> Column:
    """Width times height of a PNG, from its header."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    return number(17) * number(21)


def jpeg_pixels(data: bytes) -> int | None:
    """Width times height of a JPEG, from its first frame header; null if none is found."""
    at = 2
    while at + 9 <= len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 5 : at + 7], "big") * int.from_bytes(data[at + 7 : at + 9], "big")
        at += 2 + size
    return None


def _jpegs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([jpeg_pixels(bytes(d)) if d is not None else None for d in s], dtype="Int64")


def pdf_fault(content: Column) -> Column:
    """Why a PDF can't be read: encrypted, or no page; null if it can.  A file
    whose objects are packed in streams shows its pages to a PDF reader only."""
    text = F.decode(content, "ISO-8859-1")
    return F.when(F.contains(text, F.lit("/Encrypt")), "encrypted").when(~text.rlike(r"/Type\s*/Page\b") & ~F.contains(text, F.lit("/ObjStm")), "no pages")


def intake(files: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """(path, size, digest, kind, status, reason) of files (path, length, content)."""
    rows = files.select("path", F.col("length").alias("size"), "content").withColumn("digest", F.sha2("content", 256)).withColumn("sniffed", kind_of(F.col("content")))
    over = F.col("size") > most
    archive = F.when((F.col("sniffed") == "ZIP") & ~over, F.pandas_udf(_archives, "kind string, status string, reason string")(F.when(F.col("sniffed") == "ZIP", F.col("content"))))
    rows = rows.withColumn("a", archive)
    jpeg = F.pandas_udf(_jpegs, "long")(F.when((F.col("sniffed") == "JPEG") & ~over, F.col("content")))
    rows = rows.withColumn("pixels", F.when(F.col("sniffed") == "PNG", pixels(F.col("content"))).when(F.col("sniffed") == "JPEG", jpeg)).withColumn("fault", F.when((F.col("sniffed") == "PDF") & ~over, pdf_fault(F.col("content"))))
    large = F.coalesce(F.col("pixels") > MAX_PIXELS, F.lit(False))
    fault = F.coalesce(F.col("fault"), F.when((F.col("sniffed") == "JPEG") & ~over & F.col("pixels").isNull(), "no frame"))
    kind = F.when(over, "UNSUPPORTED").when(F.col("sniffed") == "ZIP", F.col("a.kind")).otherwise(F.col("sniffed"))
    status = F.when(F.col("size") == 0, "CORRUPT").when(over | large | (F.col("sniffed") == "UNSUPPORTED"), "UNSUPPORTED").when(F.col("sniffed") == "ZIP", F.col("a.status")).when(fault == "encrypted", "UNSUPPORTED").when(fault.isNotNull(), "CORRUPT").otherwise("RECEIVED")
    reason = F.when(F.col("size") == 0, "empty").when(over, "over the byte ceiling").when(large, "over the pixel ceiling").when(F.col("sniffed") == "UNSUPPORTED", "unknown signature").otherwise(F.coalesce(fault, F.col("a.reason")))
    return rows.select("path", "size", "digest", kind.alias("kind"), status.alias("status"), reason.alias("reason"))
