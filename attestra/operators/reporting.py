"""Reports and exports: groups and order of fields, locator texts, CSV, JSON,
HTML and metrics text."""

from __future__ import annotations

import html
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# Reading order of fields, and of the fields of one row.
FIELD_ORDER = (
    "report.title",
    "report.project_code",
    "report.call_code",
    "report.period",
    "report.period_start",
    "report.period_end",
    "report.declared_personnel_cost_eur",
    "report.declared_external_cost_eur",
    "report.declared_total_eur",
    "invoice.number",
    "invoice.issue_date",
    "invoice.supplier_name",
    "invoice.supplier_tax_id",
    "invoice.project_code",
    "invoice.base_eur",
    "invoice.vat_eur",
    "invoice.total_eur",
    "invoices.count",
    "invoices.total_eur",
    "timesheet.row_count",
    "timesheet.total_amount_eur",
    "call.code",
    "call.status",
    "call.eligible_from",
    "call.eligible_to",
    "call.max_funding_eur",
)
ROW_ORDER = ("employee_id", "full_name", "role", "contract_start", "contract_end", "month", "hours", "hourly_rate_eur", "amount_eur")
UNRANKED = len(FIELD_ORDER) + 100
# Groups of fields by prefix, in order.
GROUPS = {
    "report.": "Memoria técnica",
    "invoice.": "Facturas y justificantes",
    "invoices.": "Totales de facturas",
    "timesheet.rows": "Parte horario",
    "timesheet.": "Totales del parte horario",
    "registry.": "Registro de personal",
    "call.": "Convocatoria",
}
OTHER_GROUP = "Otros"
# Columns of the CSV export.
CSV_COLUMNS = ("field_path", "value", "confidence", "status", "method", "extractor_version", "document", "evidence", "original_value", "corrected_by")
STATUS_LABELS = {"DRAFT": "Borrador", "NEEDS_REVIEW": "Pendiente de revisión", "APPROVED": "Aprobado", "REJECTED": "Rechazado", "OPEN": "Abierta", "ACCEPTED": "Aceptada", "DISMISSED": "Descartada", "RESOLVED": "Resuelta"}

ROW = r"^timesheet\.rows\[(\d+)\]\.(\w+)$"
PERSON = r"^registry\.personnel\[([\w-]+)\]\.(\w+)$"


def _rank(c: Column, order) -> Column:
    ranks = F.create_map(*[x for k, v in enumerate(order) for x in (F.lit(v), F.lit(k))])
    return F.coalesce(F.try_element_at(ranks, c), F.lit(UNRANKED))


def sort_key(path: Column) -> Column:
    """Struct that sorts field paths as a person reads them."""
    row, person = path.rlike(ROW), path.rlike(PERSON)
    first = F.when(row, F.regexp_extract(path, ROW, 1).try_cast("int")).when(person, F.lit(0)).otherwise(_rank(path, FIELD_ORDER))
    owner = F.when(person, F.regexp_extract(path, PERSON, 1)).otherwise(F.lit(""))
    inner = F.when(row, _rank(F.regexp_extract(path, ROW, 2), ROW_ORDER)).when(person, _rank(F.regexp_extract(path, PERSON, 2), ROW_ORDER)).otherwise(F.lit(0))
    return F.struct(first.alias("a"), owner.alias("b"), inner.alias("c"), path.alias("d"))


def group_of(path: Column) -> Column:
    """Title of the first group whose prefix fits."""
    return F.coalesce(*[F.when(path.startswith(p), F.lit(title)) for p, title in GROUPS.items()], F.lit(OTHER_GROUP))


def member_of(path: Column, document: Column) -> Column:
    """What a repeated field belongs to: its document, row or person."""
    return F.when(path.rlike(ROW), F.regexp_extract(path, ROW, 1)).when(path.rlike(PERSON), F.regexp_extract(path, PERSON, 1)).when(path.startswith("invoice."), document)


def link_labels(links: DataFrame, finding: str, label: str, place: Column) -> DataFrame:
    """Labels of evidence links, with the place added where they repeat."""
    n = F.count("*").over(Window.partitionBy(finding, label))
    return links.withColumn("shown", F.when(n > 1, F.concat(F.col(label), F.lit(" · "), place)).otherwise(F.col(label)))


def describe(kind: Column, a: Column, b: Column) -> Column:
    """One line for a locator: where in the source a value stands."""
    return (
        F.when(kind == "PDF_PAGE", F.concat(F.lit("página "), a))
        .when(kind == "OCR_WORD_BOX", F.concat(F.lit("página "), a, F.lit(", recuadro "), b))
        .when(kind == "EXCEL_CELL", F.concat(F.lit("hoja «"), a, F.lit("», celda "), b))
        .when(kind == "API_FIELD", F.concat(F.lit("registro "), a, F.lit(", "), b))
        .when(kind == "HTML_SELECTOR", F.concat(F.lit("selector "), a))
        .when(kind == "DERIVED", F.concat(F.lit("calculado: "), a))
    )


#: Fields that each kind of locator must have.
LOCATOR_FIELDS: Mapping[str, tuple[str, ...]] = {"PDF_PAGE": ("page", "char_start", "char_end"), "OCR_WORD_BOX": ("page", "left", "top", "width", "height"), "EXCEL_CELL": ("sheet", "cell"), "API_FIELD": ("endpoint", "record_id", "json_path"), "HTML_SELECTOR": ("url", "selector"), "DERIVED": ("inputs", "rule")}


def validate_locator(locator: Column) -> Column:
    """Whether a locator struct has exactly the parts that its kind needs."""
    checks = F.lit(False)
    for kind, fields in LOCATOR_FIELDS.items():
        whole = F.lit(True)
        for f in fields:
            whole = whole & locator[f].isNotNull()
        checks = F.when(locator["kind"] == kind, whole).otherwise(checks)
    return F.coalesce(checks, F.lit(False))


def csv_rows(df: DataFrame) -> DataFrame:
    """Export columns as safe cells."""
    return df.select(*[text.neutralised(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in CSV_COLUMNS if c in df.columns])


def write_csv(df: DataFrame, path: str, dialect: str = "plain") -> None:
    """Two dialects: comma with line feeds, or semicolon with CRLF, a byte order
    mark and one header, for spreadsheet programs (one file: what a person opens)."""
    if dialect == "plain":
        df.write.options(header="true", escape='"', sep=",", lineSep="\n").csv(path)
        return

    # Spark's CSV writer takes one character as line separator; the text sink writes this dialect
    def line(cells: list[Column]) -> Column:
        return F.concat_ws(";", *[F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in cells])

    place = F.monotonically_increasing_id()
    head = df.sparkSession.range(1).select(F.lit(-1).cast("long").alias("_at"), F.concat(F.lit("\ufeff"), line([F.lit(c) for c in df.columns])).alias("value"))
    body = df.select(place.alias("_at"), line([F.col(f"`{c}`") for c in df.columns]).alias("value"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("_at").select("value").write.option("lineSep", "\r\n").text(path)


def nested_json(parent: DataFrame, key: str, children: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """(key, json): each parent with its children as sorted arrays."""
    out = parent
    names = []
    for name, (child, child_key) in children.items():
        columns = [c for c in child.columns if c != child_key]
        g = child.groupBy(F.col(child_key).alias(key)).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(g, key, "left")
        names.append(name)
    return out.select(key, F.to_json(F.struct(*parent.columns, *names)).alias("json"))


def metrics_text(df: DataFrame, name: str, label: str, value: str) -> DataFrame:
    """One row with the text exposition of a labelled gauge."""
    line = F.concat(F.lit(name + "{" + label + '="'), F.col(label), F.lit('"} '), F.col(value).cast("string"))
    return df.select(line.alias("l")).agg(F.array_join(F.array_sort(F.collect_list("l")), "\n").alias("text"))


def html_table(df: DataFrame, title: str, most: int = 1000) -> str:
    """A report page; of a longer frame it shows the first ``most`` rows and says
    how many there are."""
    rows = df.limit(most + 1).collect()
    more = f"<p>Se muestran {most} de {df.count()} filas.</p>" if len(rows) > most else ""
    rows = rows[:most]
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<!DOCTYPE html><html lang=\"es\"><head><meta charset=\"utf-8\"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table>{more}</body></html>"


def html_pages(df: DataFrame, group: str, order: Sequence[str], title: str, size: int = 500) -> DataFrame:
    """(group, page, pages, n_rows, html, sha256): all rows of each group, in order, as report
    pages of at most ``size`` rows.  A null group is one of them, a null cell is empty, equal
    rows all stay.  Rows are numbered inside ranges of the order and ranges by their
    counts, so that a group of any size is dealt over tasks."""

    def escaped(c: Column) -> Column:
        out = F.coalesce(c.cast("string"), F.lit(""))
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            out = F.replace(out, F.lit(sign), F.lit(name))
        return out

    shown = [c for c in df.columns if c != group]
    line = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), escaped(F.col(f"`{c}`")), F.lit("</td>")) for c in shown], F.lit("</tr>"))
    rows = df.select(F.col(f"`{group}`").alias("_g"), F.struct(*[F.col(f"`{c}`") for c in order]).alias("_o"), line.alias("_line"), F.monotonically_increasing_id().alias("_tie"))
    # ranges are drawn from samples: they have to be the same when counted and when numbered
    placed = rows.repartitionByRange("_g", "_o", "_line", "_tie").withColumn("_p", F.spark_partition_id()).checkpoint()
    of_group = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_n").over(of_group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = placed.groupBy("_g", "_p").agg(F.count("*").alias("_n")).select(F.col("_g").alias("_rg"), F.col("_p").alias("_rp"), before.alias("_before"), F.sum("_n").over(of_group).alias("n_rows"))
    numbered = placed.withColumn("_r", F.row_number().over(Window.partitionBy("_g", "_p").orderBy("_o", "_line", "_tie"))).join(ranges, F.col("_g").eqNullSafe(F.col("_rg")) & (F.col("_p") == F.col("_rp")))
    at = F.col("_before") + F.col("_r") - 1
    paged = numbered.groupBy("_g", F.floor(at / size).cast("int").alias("_page"), "n_rows").agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), "_line"))).alias("_rows"))
    page, pages = F.col("_page") + 1, F.ceil(F.col("n_rows") / size).cast("int")
    body = F.array_join(F.transform("_rows", lambda r: r["_line"]), "")
    name = F.concat(escaped(F.lit(title)), F.lit(" "), escaped(F.col("_g")))
    head = F.lit("<tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in shown) + "</tr>")
    foot = F.format_string("<p>Página %d de %d, %d filas en total.</p>", page, pages, F.col("n_rows"))
    whole = F.concat(F.lit('<!DOCTYPE html><html lang="es"><head><meta charset="utf-8"><title>'), name, F.lit("</title></head><body><h1>"), name, F.lit("</h1><table>"), head, body, F.lit("</table>"), foot, F.lit("</body></html>"))
    return paged.select(F.col("_g").alias(group), page.alias("page"), pages.alias("pages"), "n_rows", whole.alias("html")).withColumn("sha256", F.sha2("html", 256))


def append_audit(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)
