"""The library's functions by name in SQL.

``register(spark)`` makes them known to a session: scalar functions as SQL macros over
built-ins (so that Catalyst sees through them), and table functions for what gives
several rows of one value, used with ``LATERAL``:

    SELECT d.doc_id, c.* FROM documents d, LATERAL paragraph_chunks(d.text) c
    SELECT f.path, c.* FROM books f, LATERAL workbook_cells(f.content) c
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.extraction import cut_blocks
from .sources.workbook import read_book


class Chunks:
    """Chunks of a text: where they lie and what they hold."""

    def eval(self, text: str) -> Iterator[tuple]:
        for k, (start, end) in enumerate(cut_blocks(text or "")):
            yield k, start, end, text[start:end]


class Cells:
    """Cells of a workbook by one parse: a first row with the book's status, then the cells."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        cells, status, reason = read_book(bytes(content or b""))
        yield status, reason, *[None] * 7
        for c in cells:
            yield None, None, *c


TABLES = {
    "paragraph_chunks": (Chunks, "ordinal int, char_start int, char_end int, text string"),
    "workbook_cells": (Cells, "status string, reason string, sheet string, row int, col int, value string, value_kind string, is_formula boolean, formula string"),
}
#: Name, parameters, kind and body.
SCALARS = (
    ("content_hash", "content BINARY", "STRING", "sha2(content, 256)"),
    ("storage_key", "digest STRING", "STRING", "concat_ws('/', substring(digest, 1, 2), substring(digest, 3, 2), digest)"),
    ("row_amount", "hours DECIMAL(16,4), rate DECIMAL(16,4)", "DECIMAL(16,4)", "cast(bround(hours * rate, 2) AS DECIMAL(16,4))"),
    ("differs", "a DECIMAL(16,4), b DECIMAL(16,4)", "BOOLEAN", "abs(a - b) > 0.01"),
    ("month_start", "month STRING", "DATE", "CASE WHEN month RLIKE '^[0-9]{4}-[0-9]{2}$' THEN try_to_date(concat(month, '-01'), 'yyyy-MM-dd') END"),
    ("reciprocal_rank", "first_place INT, second_place INT", "DOUBLE", "coalesce(1.0D / (60 + first_place), 0.0D) + coalesce(1.0D / (60 + second_place), 0.0D)"),
)


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to a session; their names."""
    for name, (handler, schema) in TABLES.items():
        spark.udtf.register(name, F.udtf(handler, returnType=schema, useArrow=True))
    for name, parameters, kind, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return [*TABLES, *(s[0] for s in SCALARS)]
