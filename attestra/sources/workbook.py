"""Workbook cells by the standard library: one row for each filled cell."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MAX_CELLS = 200_000
CELLS = "document_id string, sheet string, row int, col int, value string, value_kind string, is_formula boolean, formula string"
STATUS = "document_id string, status string, reason string, cells int"


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def cells_of(data: bytes, most: int = MAX_CELLS) -> Iterator[tuple[str, int, int, str | None, str, bool, str | None]]:
    """(sheet, row, col, value, kind, is formula, formula); formulas give their
    text and the value stored with it, which nobody has computed anew."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter(f"{MAIN}t")))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        n = 0
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
            part = targets[sheet.get(f"{REL}id")].lstrip("/")
            root = ElementTree.fromstring(z.read(part if part.startswith("xl/") else f"xl/{part}"))
            for c in root.iter(f"{MAIN}c"):
                n += 1
                if n > most:
                    raise ValueError("over the cell budget")
                at = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r"))
                kind, v, f = c.get("t", "n"), c.find(f"{MAIN}v"), c.find(f"{MAIN}f")
                value = v.text if v is not None else None
                if kind == "s" and value is not None:
                    value = shared[int(value)]
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                if value is not None or f is not None:
                    yield sheet.get("name"), int(at[2]), column_number(at[1]), value, kind, f is not None, None if f is None else f.text


def read_book(data: bytes | None) -> tuple[list, str, str | None]:
    """Cells, status and reason: a damaged or too large book has no cells."""
    try:
        return list(cells_of(data or b"")), "EXTRACTED", None
    except ValueError as e:
        return [], "UNSUPPORTED" if "budget" in str(e) else "CORRUPT", str(e)
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, TypeError, OSError, EOFError, NotImplementedError, RuntimeError) as e:
        return [], "CORRUPT", type(e).__name__


def workbook_cells(files: DataFrame) -> DataFrame:
    """Cells of workbooks (document_id, content); books that can't be read have
    none, see ``workbook_status``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [(name, *c) for c in read_book(content)[0]]
                if rows:
                    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in CELLS.split(", ")])

    return files.select("document_id", "content").mapInArrow(run, CELLS)


def workbook_status(files: DataFrame) -> DataFrame:
    """(document_id, status, reason, cells): a row for each book, whatever its state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [read_book(c) for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for _, s, _ in found], pa.string()), pa.array([r for *_, r in found], pa.string()), pa.array([len(c) for c, *_ in found], pa.int32())], [f.split()[0] for f in STATUS.split(", ")])

    return files.select("document_id", "content").mapInArrow(run, STATUS)


def workbook_contents(files: DataFrame) -> DataFrame:
    """Cells and states of workbooks (document_id, content) by one parse: a row with
    ``status`` and ``reason`` for each book, and a row without for each of its cells."""
    schema = f"{CELLS}, status string, reason string"
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cells, status, reason = read_book(content)
                rows = [(name, *[None] * 7, status, reason), *[(name, *c, None, None) for c in cells]]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select("document_id", "content").mapInArrow(run, schema)
