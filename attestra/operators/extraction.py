"""From text, recognised words and worksheet cells to field candidates.

Candidates are rows (document_id, field_path, value_text, value_number,
value_date, locator parts, confidence, method): the tall table that everything
after works on.  All readers are native; only ``paragraph_chunks`` runs Python,
in Arrow batches, as it cuts at the last line or word end before a limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from .relational import margin

# Labels of report and invoice fields, on folded text.
REPORT_LABELS = {
    "report.project_code": r"expediente",
    "report.call_code": r"convocatoria",
    "report.title": r"titulo\s+del\s+proyecto",
    "report.period": r"periodo\s+de\s+ejecucion",
    "report.declared_personnel_cost_eur": r"(?:coste|gastos)\s+de\s+personal\s+(?:declarado|declarados|imputados)",
    "report.declared_external_cost_eur": r"(?:gastos\s+de\s+)?colaboraciones\s+externas\s+(?:declaradas|declarados|imputadas)",
    "report.declared_total_eur": r"total\s+(?:gastos\s+)?declarados?",
}
INVOICE_LABELS = {
    "invoice.number": r"numero",
    "invoice.issue_date": r"fecha\s+de\s+emision",
    "invoice.supplier_name": r"proveedor",
    "invoice.supplier_tax_id": r"nif(?:\s*\([^)]*\))?",
    "invoice.project_code": r"referencia\s+de\s+proyecto",
    "invoice.base_eur": r"base\s+imponible",
    "invoice.vat_eur": r"iva\s*\d{1,2}\s*%",
    "invoice.total_eur": r"total\s+factura",
}
TIMESHEET_HEADERS = ("id empleado", "mes", "horas", "tarifa eur/h", "importe eur")
# Weighted signals of the document kinds, on folded text.
KIND_SIGNALS = {
    "TECHNICAL_REPORT": ((r"memoria\s+tecnica", 0.55), (r"descripcion\s+del\s+proyecto", 0.2), (r"resumen\s+economico", 0.2), (r"personal\s+investigador", 0.15)),
    "EXPENSE_INVOICE": ((r"\bfactura\b", 0.5), (r"base\s+imponible", 0.25), (r"\biva\b", 0.15), (r"total\s+factura", 0.2)),
    "TIMESHEET": ((r"partes?\s+horarios?", 0.5), (r"\bhoras\b", 0.2), (r"tarifa", 0.2), (r"id\s+empleado", 0.2)),
}
# Confidences by method.
TEXT_CONFIDENCE, CELL_CONFIDENCE, REPAIRED = 0.95, 0.98, 0.75
REVIEW_THRESHOLD = 0.80


def _is_amount() -> Column:
    return F.col("field_path").endswith("_eur")


def once(df: DataFrame, parts: Column) -> DataFrame:
    """``df`` with the fields of a struct as columns, worked out once for each row:
    a filter on them isn't pushed below, where it would work them out again."""
    return df.select("*", F.inline(F.array(parts)))


def typed(df: DataFrame, tolerant: bool = False) -> DataFrame:
    """Adds value_number and value_date by field; a typed value that doesn't
    parse yields no candidate."""
    amount = numbers.parse_amount_tolerant(F.col("value_text")) if tolerant else numbers.parse_amount(F.col("value_text"))
    is_date = F.col("field_path").endswith("_date")
    out = once(df, F.struct(F.when(_is_amount(), amount).alias("value_number"), F.when(is_date, dates.parse_date(F.col("value_text"))).alias("value_date")))
    return out.where((~_is_amount() | F.col("value_number").isNotNull()) & (~is_date | F.col("value_date").isNotNull()))


def _labelled(df: DataFrame, body: str, labels: Mapping[str, str]) -> DataFrame:
    """One row for each label that a text holds.  Matches are found before the
    rows are made, so nothing after it looks for them again."""
    found = []
    for path, label in labels.items():
        size = F.when(F.contains("_folded", F.lit(text.certain_word(label))), F.length(F.regexp_extract("_folded", *text.label_pattern(label))))
        found.append(F.struct(F.lit(path).alias("field_path"), text.labelled_match(F.col("_folded"), label).alias("whole"), size.alias("size")))
    rows = df.withColumn("_folded", text.fold(F.col(body))).withColumn("_f", F.explode(F.array(*found))).where("_f.whole != ''")
    start = F.instr("_folded", F.col("_f.whole")) - 1 + F.length("_f.whole") - F.col("_f.size")
    value = F.struct(F.col("_f.field_path").alias("field_path"), text.collapse_spaces(F.substring(F.col(body), start + 1, F.col("_f.size"))).alias("value_text"), start.alias("char_start"), (start + F.col("_f.size")).alias("char_end"))
    return once(rows, value).drop("_folded", "_f").where("value_text != ''")


def report_fields(pages: DataFrame, labels: Mapping[str, str] = REPORT_LABELS) -> DataFrame:
    """Fields of text pages (document_id, page, text); the first page on which
    a field parses wins."""
    rows = typed(_labelled(pages, "text", labels)).withColumn("confidence", F.lit(TEXT_CONFIDENCE))
    w = Window.partitionBy("document_id", "field_path").orderBy("page")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "text")


def ocr_lines(words: DataFrame) -> DataFrame:
    """Lines of recognised words: ordered text, box union, mean confidence of
    the words that have one."""
    line = ["document_id", "page", "block", "par", "line"]
    ordered = F.array_sort(F.collect_list(F.struct("word_no", "text")))
    g = words.groupBy(*line).agg(
        F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"),
        F.min("left").alias("left"),
        F.min("top").alias("top"),
        (F.max(F.col("left") + F.col("width")) - F.min("left")).alias("width"),
        (F.max(F.col("top") + F.col("height")) - F.min("top")).alias("height"),
        F.coalesce(F.avg(F.when(F.col("confidence") >= 0, F.col("confidence"))), F.lit(0.0)).alias("confidence"),
    )
    return g


def invoice_fields(lines: DataFrame, labels: Mapping[str, str] = INVOICE_LABELS) -> DataFrame:
    """Fields of OCR lines; amounts are read with digit repair, which lowers
    the confidence.  The first line wins."""
    rows = typed(_labelled(lines, "text", labels), tolerant=True)
    repaired = _is_amount() & ~F.col("value_number").eqNullSafe(numbers.parse_amount(F.col("value_text")))
    rows = rows.withColumn("confidence", numbers.confidence(F.col("confidence"), repaired))
    w = Window.partitionBy("document_id", "field_path").orderBy("page", "block", "par", "line")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def timesheet_rows(cells: DataFrame) -> DataFrame:
    """Data rows of worksheets from a cell table (document_id, sheet, row, col,
    value, is_formula): columns are located by the first row that holds all
    headers; a row needs a literal employee and a numeric literal of hours."""
    keys = ["document_id", "sheet"]
    named = cells.withColumn("label", text.fold(text.collapse_spaces(F.col("value"))))
    heads = named.groupBy(*keys, "row").agg(F.collect_set("label").alias("have")).where(F.size(F.array_except(F.array(*[F.lit(h) for h in TIMESHEET_HEADERS]), F.col("have"))) == 0)
    head = heads.groupBy(*keys).agg(F.min("row").alias("head"))
    columns = named.join(head, keys).where("row = head").select(*keys, "head", "col", "label")
    below = cells.where("not is_formula").join(columns, [*keys, "col"]).where("row > head")
    wide = below.groupBy(*keys, "row").pivot("label", [*TIMESHEET_HEADERS, "nombre", "rol"]).agg(F.first("value"))
    n = lambda c: numbers.cell_number(F.col(f"`{c}`")).cast("decimal(16,4)")
    rows = wide.select(*keys, "row", F.col("`id empleado`").alias("employee_id"), F.col("nombre").alias("full_name"), F.col("rol").alias("role"), F.col("mes").alias("month"), n("horas").alias("hours"), n("tarifa eur/h").alias("rate"), n("importe eur").alias("amount"))
    rows = rows.where("employee_id is not null and employee_id != '' and hours is not null")
    return rows.withColumn("row_index", F.row_number().over(Window.partitionBy(*keys).orderBy("row")) - 1)


def unpivot_registry(registry: DataFrame) -> DataFrame:
    """One candidate for each attribute of each person."""
    names = [c for c in registry.columns if c != "employee_id"]
    typed_rows = registry.select("employee_id", *[F.col(c).cast("string").alias(c) for c in names])
    tall = typed_rows.unpivot(["employee_id"], names, "suffix", "value_text").where("value_text is not null")
    return tall.select(F.concat(F.lit("registry.personnel["), "employee_id", F.lit("]."), "suffix").alias("field_path"), "value_text", F.lit("API").alias("method"))


def classify(body: Column, signals: Mapping = KIND_SIGNALS) -> Column:
    """Kind and confidence of a document by weighted signals in its whole text."""
    folded = text.fold(body)
    return margin({k: text.weighted_score(folded, s).cast("double") for k, s in signals.items()})


def routed(confidence: Column, threshold: float = REVIEW_THRESHOLD) -> Column:
    return F.when(confidence < threshold, "NEEDS_REVIEW").otherwise("EXTRACTED")


def usable_text(pages: DataFrame, least: int = 120) -> DataFrame:
    """(document_id, pages, usable): whether a text layer holds enough text."""
    g = pages.groupBy("document_id").agg(F.count("*").alias("pages"), F.sum(F.length(F.trim("text"))).alias("chars"))
    return g.select("document_id", "pages", (F.col("chars") >= F.lit(least) * F.least("pages", F.lit(3))).alias("usable"))


def cut_blocks(body: str, most: int = 900, blank: str = r"\n\s*\n") -> list[tuple[int, int]]:
    """Spans of paragraph chunks: blocks between blank lines, longer ones cut
    at the last line end in the window, else the last space, else hard."""
    out: list[tuple[int, int]] = []
    at = 0
    for part in re.split(f"({blank})", body):
        if not re.fullmatch(blank, part):
            start = at + len(part) - len(part.lstrip())
            end = at + len(part.rstrip())
            while end - start > most:
                window = body[start : start + most]
                cut = window.rfind("\n")
                cut = cut if cut > 0 else window.rfind(" ")
                cut = cut if cut > 0 else most
                out.append((start, start + cut))
                start += cut
                while start < end and body[start] in " \n":
                    start += 1
            if end > start:
                out.append((start, end))
        at += len(part)
    return out


def paragraph_chunks(pages: DataFrame, most: int = 900, blank: str = r"\n\s*\n") -> DataFrame:
    """(document_id, page, ordinal, char_start, char_end, text): chunks whose
    span reproduces the text; ordinals run on across the pages."""
    kind = pages.schema["document_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, body in enumerate(b.column(2).to_pylist()):
                spans = cut_blocks(body or "", most, blank)
                if spans:
                    take = pa.array([i] * len(spans))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array([s for s, _ in spans], pa.int32()), pa.array([e for _, e in spans], pa.int32()), pa.array([body[s:e] for s, e in spans])], ["document_id", "page", "char_start", "char_end", "text"])

    rows = pages.select("document_id", F.col("page").cast("int"), "text").mapInArrow(run, f"document_id {kind}, page int, char_start int, char_end int, text string")
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("document_id").orderBy("page", "char_start")) - 1)


def line_chunks(lines: DataFrame, least: int = 3) -> DataFrame:
    """One chunk for each line of enough characters."""
    w = Window.partitionBy("document_id").orderBy("page", "line")
    return lines.where(F.length("text") >= least).withColumn("ordinal", F.row_number().over(w) - 1)


def sheet_chunks(cells: DataFrame, most: int = 900) -> DataFrame:
    """One chunk for each worksheet row after the header: the header is the
    first row of three or more filled cells, none of them numeric."""
    keys = ["document_id", "sheet"]
    filled = cells.where("value is not null and trim(value) != ''")
    rows = filled.groupBy(*keys, "row").agg(F.count("*").alias("n"), F.max(F.col("value").try_cast("double").isNotNull()).alias("numeric"))
    head = rows.where("n >= 3 and not numeric").groupBy(*keys).agg(F.min("row").alias("head"))
    names = filled.join(head, keys).where("row = head").select(*keys, "col", F.col("value").alias("name"))
    body = filled.join(head, keys, "left").where("head is null or row > head").join(names, [*keys, "col"], "left")
    g = body.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(F.struct("col", "name", "value"))).alias("c"))
    shown = F.transform("c", lambda x: F.concat_ws(": ", x["name"], x["value"]))
    pair = F.concat_ws(": ", F.col("c")[0]["value"], F.get(F.col("c"), F.lit(1))["value"])
    line = F.when((F.size("c") == 2) & F.col("c")[0]["name"].isNull(), pair).otherwise(F.array_join(shown, " · "))
    out = g.select(*keys, "row", F.substring(F.concat(F.lit("Hoja «"), "sheet", F.lit("», fila "), F.col("row").cast("string"), F.lit(": "), line), 1, most).alias("text"))
    return out.withColumn("ordinal", F.row_number().over(Window.partitionBy("document_id").orderBy("sheet", "row")) - 1)
