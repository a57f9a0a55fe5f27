"""From submitted files to findings: intake, extraction, readings, rules, upsert.

All dossiers of a folder (see ``corpus``) are processed together; every step is a
frame, so a run over very many dossiers is the same plan.  A run writes the next
snapshot under ``out`` (``run=N/``): files, documents, readings, chunks, findings and the
frames between them.

* Files that the last run knows by path, length and time aren't read, and dossiers
  whose files and text layers are those of the last run aren't extracted: their rows
  are carried over.  What belongs to a document that is gone, goes.
* Readings are kept as the machine made them (``machine``) and as they hold
  (``readings``): decisions of people (``review``) are a log beside the runs, folded in
  before the rules.  A correction changes what the rules see, in each later run.
* Decisions on findings are folded in before the upsert, which never changes an
  accepted or dismissed finding.  None is ever approved by a run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates, numbers
from .functions import structured as S
from .functions import text as X
from .operators import extraction as E
from .operators import relational as R
from .operators import reporting as P
from .operators import retrieval as Q
from .operators import rules
from .operators import workflow as W
from .sources import files, pages, workbook

KEYS = ["dossier_id", "fingerprint"]
MONEY = "decimal(16,4)"
WORDS = "reference string, file string, page int, block int, par int, line int, word_no int, text string, confidence double, left int, top int, width int, height int"
FORMS = {
    "dossiers": "reference string, period_start date, period_end date, claimed_total_eur decimal(14,2)",
    "texts": "reference string, file string, page int, text string",
    "words": WORDS,
    "registry": f"employee_id string, rate {MONEY}, contract_start date, contract_end date",
    "calls": "reference string, html string, error string",
}
FINDINGS = "dossier_id string, fingerprint string, rule_id string, severity string, subject string, detail map<string,string>, document_ids array<string>, status string, action string"


STATES = "path string, length bigint, modificationTime timestamp, digest string, kind string, status string, reason string"
DECISIONS = "seq bigint, dossier_id string, target string, key string, action string, new_value string, reason string, actor string"
ACTIONS = {"reading": ("CORRECT", "CONFIRM"), "finding": ("ACCEPT", "DISMISS")}
READING = ["dossier_id", "document_id", "field_path", "place", "value_text", "value_number", "value_date", "confidence", "method"]


@dataclass(frozen=True)
class Extracted:
    documents: DataFrame
    readings: DataFrame
    chunks: DataFrame
    context: rules.Context


@dataclass(frozen=True)
class Last:
    """What the run before left; ``table`` gives nothing where there was none."""

    spark: SparkSession
    at: str | None

    def table(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.at}/{name}") if self.at else None


def file_states(spark: SparkSession, root: str, before: DataFrame | None) -> DataFrame:
    """Every submitted file with its digest and the intake's verdict.  Only files that are
    new, or differ in length or time from ``before``, are read."""
    as_it_was = ["path", "length", "modificationTime"]
    found = files.read_files(spark, f"{root}/files")
    listed = found.select(*as_it_was)
    known = None
    if before is not None:
        new = listed.join(before, as_it_was, "left_anti")
        known = listed.join(before, as_it_was).select(*before.columns)
        first = new.agg(F.min("modificationTime")).first()[0]
        if first is None:
            return known
        found = found.where(F.col("modificationTime") >= F.lit(first)).join(new.select("path"), "path", "left_semi")
    read = files.intake(found).join(listed, "path").select(*[f.split()[0] for f in STATES.split(", ")])
    return read if known is None else read.unionByName(known)


def documents(states: DataFrame) -> DataFrame:
    """One row for each distinct file of a dossier, refused ones included."""
    taken = states.withColumn("dossier_id", F.regexp_extract("path", "/files/([^/]+)/", 1)).withColumn("name", F.regexp_extract("path", "([^/]+)$", 1))
    first = W.intake(taken, ["dossier_id", "digest"], [F.length("name"), F.col("name")], "name")
    return first.withColumn("document_id", F.concat_ws(":", "dossier_id", F.substring("digest", 1, 16)))


def signatures(docs: DataFrame, texts: DataFrame, words: DataFrame) -> DataFrame:
    """(dossier_id, signature): a mark of all that extraction reads of a dossier, in any order."""

    def mark(df: DataFrame, dossier: str, columns: list[str]) -> DataFrame:
        sums = df.groupBy(F.col(dossier).alias("dossier_id")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h"))
        return sums.select("dossier_id", F.concat_ws(":", "n", "h").alias("mark"))

    own = mark(docs, "dossier_id", ["digest", "name", "status"])
    layers = mark(texts, "reference", texts.columns).withColumnRenamed("mark", "texts"), mark(words, "reference", words.columns).withColumnRenamed("mark", "words")
    both = own.join(layers[0], "dossier_id", "left").join(layers[1], "dossier_id", "left")
    return both.select("dossier_id", F.sha2(F.concat_ws("|", "mark", F.coalesce("texts", F.lit("")), F.coalesce("words", F.lit(""))), 256).alias("signature"))


def _one(path: str, column: str) -> Column:
    return F.max(F.when(F.col("field_path") == path, F.col(column)))


def _reading(df: DataFrame, method: str, place: Column, **columns: Column) -> DataFrame:
    """Rows in the shape of readings; what isn't given is missing."""
    kinds = {"document_id": "string", "value_text": "string", "value_number": MONEY, "value_date": "date", "confidence": "double"}
    given = {"method": F.lit(method), "place": place} | columns
    return df.select(*[(given[c] if c in given else F.col(c) if c in df.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in READING])


def _tall(df: DataFrame, prefix: Column, texts: tuple[str, ...], numbers_: tuple[str, ...] = (), days: tuple[str, ...] = ()) -> DataFrame:
    """A row for each attribute that a record has."""
    value = lambda c: F.struct(F.concat(prefix, F.lit("."), F.lit(c)).alias("field_path"), F.col(c).cast("string").alias("value_text"), (F.col(c) if c in numbers_ else F.lit(None)).cast(MONEY).alias("value_number"), (F.col(c) if c in days else F.lit(None)).cast("date").alias("value_date"))
    return df.select("*", F.inline(F.array(*[value(c) for c in (*texts, *numbers_, *days)]))).where("value_text IS NOT NULL AND trim(value_text) != ''")


def effective(machine: DataFrame, decisions: DataFrame) -> DataFrame:
    """Readings as they hold: machine readings with the decisions on them folded in."""
    own = decisions.where("target = 'reading'").select("key", "seq", "action", "new_value")
    folded = W.fold_decisions(machine.select("key", F.col("value_text").alias("value"), E.routed(F.col("confidence")).alias("status"), "confidence"), own, "key", "seq")
    changed = folded.select("key", "status", "revision", F.col("original").alias("original_value_text"), F.when(F.col("original").isNotNull(), F.col("value")).alias("_v"), F.col("confidence").alias("_c"))
    was = F.col("_v").isNotNull()
    j = machine.join(changed, "key")
    return j.select("key", "dossier_id", "document_id", "field_path", "place", F.coalesce("_v", "value_text").alias("value_text"), F.when(was, numbers.parse_amount(F.col("_v")).cast(MONEY)).otherwise(F.col("value_number")).alias("value_number"), F.when(was, dates.parse_date(F.col("_v"))).otherwise(F.col("value_date")).alias("value_date"), F.col("_c").alias("confidence"), "method", "status", "original_value_text", "revision")


def derived(readings: DataFrame) -> DataFrame:
    """Totals and counts per dossier, from readings as they hold; their key names the
    rule, not its inputs."""
    kept = readings.where("status != 'REJECTED' AND value_number IS NOT NULL")
    out = []
    for wanted, total, count in (("field_path = 'invoice.total_eur'", "invoices.total_eur", "invoices.count"), ("field_path LIKE 'timesheet.rows[%.amount_eur'", "timesheet.total_amount_eur", "timesheet.row_count")):
        g = kept.where(wanted).groupBy("dossier_id").agg(F.sum("value_number").cast(MONEY).alias("s"), F.count(F.lit(1)).cast(MONEY).alias("n"), F.min("confidence").alias("least"))
        each = F.array(F.struct(F.lit(total).alias("field_path"), F.col("s").alias("value_number"), F.col("least").alias("confidence")), F.struct(F.lit(count).alias("field_path"), F.col("n").alias("value_number"), F.lit(1.0).alias("confidence")))
        out.append(g.select("dossier_id", F.inline(each)))
    rows = out[0].unionByName(out[1])
    return _reading(rows, "DERIVED", F.col("field_path"), value_text=F.col("value_number").cast("string"))


def keyed(readings: DataFrame) -> DataFrame:
    """Readings with the key by which later runs and people know them."""
    return readings.withColumn("key", S.dedup_key(F.coalesce("document_id", "dossier_id"), F.col("field_path"), F.col("place"), F.col("method")))


def extract(spark: SparkSession, root: str, keep: Callable[[DataFrame, str], DataFrame], last: Last, decisions: DataFrame) -> Extracted:
    """What the files of all dossiers say.  ``keep`` stores a frame that several
    later ones read, and reads it again."""
    t = {name: spark.read.schema(form).json(f"{root}/{name}.json") for name, form in FORMS.items()}
    all_docs = keep(documents(keep(file_states(spark, root, last.table("files")), "files")), "intake")
    marks = keep(signatures(all_docs, t["texts"], t["words"]), "signatures")
    before = last.table("signatures")
    changed = keep((marks if before is None else marks.join(before, ["dossier_id", "signature"], "left_anti")).select("dossier_id"), "changed")

    def carried(new: DataFrame, name: str) -> DataFrame:
        """The rows of changed dossiers, and the last run's of those that are as they were."""
        old = last.table(name)
        if old is not None:
            same = marks.join(changed, "dossier_id", "left_anti").select("dossier_id")
            new = new.unionByName(old.select(*new.columns).join(same, "dossier_id", "left_semi"))
        return keep(new, name)

    docs = all_docs.join(changed, "dossier_id", "left_semi")
    accepted = docs.where("status = 'RECEIVED'").select("dossier_id", "document_id", "name", "path", F.col("kind").alias("media"))
    named = accepted.select(F.col("dossier_id").alias("reference"), F.col("name").alias("file"), "document_id")
    texts = t["texts"].join(named, ["reference", "file"]).select("document_id", "page", "text")
    words = t["words"].join(named, ["reference", "file"])
    lines = keep(E.ocr_lines(words), "lines")
    content = files.read_files(spark, f"{root}/files").select("path", "content")
    books = keep(workbook.workbook_contents(accepted.where("media = 'XLSX'").join(content, "path").select("document_id", "content")), "books")
    cells, states = books.where("status IS NULL").drop("status", "reason"), books.where("status IS NOT NULL")

    # the text of each document, whatever it was read from
    place = F.struct("page", "block", "par", "line", "text")
    nothing = F.lit(0).alias("block"), F.lit(0).alias("par"), F.lit(0).alias("line")
    parts = texts.select("document_id", F.struct("page", *nothing, "text").alias("p")).unionByName(lines.select("document_id", place.alias("p")))
    parts = parts.unionByName(cells.where("value is not null").select("document_id", F.struct(F.lit(1).alias("page"), F.lit(0).alias("block"), F.col("row").alias("par"), F.col("col").alias("line"), F.col("value").alias("text")).alias("p")))
    bodies = parts.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["text"]), "\n").alias("text"))
    sure = words.groupBy("document_id").agg(F.avg(F.when(F.col("confidence") >= 0, F.col("confidence"))).alias("mean_confidence"))
    formulas = cells.where("is_formula").groupBy("document_id").agg(F.array_sort(F.collect_list(F.concat_ws("!", "sheet", F.concat_ws(":", "row", "col")))).alias("formula_cells"))
    read = docs.join(bodies, "document_id", "left").join(sure, "document_id", "left").join(formulas, "document_id", "left").join(states.select("document_id", F.col("status").alias("book")), "document_id", "left")
    status = F.when(F.col("status") != "RECEIVED", F.col("status")).when(F.coalesce(F.col("book"), F.lit("EXTRACTED")) != "EXTRACTED", F.col("book")).when(F.col("text").isNull(), "FAILED").otherwise("EXTRACTED")
    kind = F.when(status == "EXTRACTED", E.classify(F.col("text"))["kind"]).otherwise("UNKNOWN")
    none = F.array().cast("array<string>")
    read = read.select("document_id", "dossier_id", "name", F.col("kind").alias("media"), kind.alias("kind"), status.alias("status"), "reason", "mean_confidence", F.coalesce("formula_cells", none).alias("formula_cells"), "alternates", "text")
    fresh = keep(read, "extracted")
    of = fresh.select("document_id", "dossier_id", "kind")
    only = lambda df, kind: df.join(of.where(F.col("kind") == kind).select("document_id", "dossier_id"), "document_id")

    report = only(E.report_fields(texts), "TECHNICAL_REPORT")
    period = dates.split_period(F.col("value_text"))
    ends = F.array(F.struct(F.lit("report.period_start").alias("to"), period["start"].alias("day")), F.struct(F.lit("report.period_end").alias("to"), period["end"].alias("day")))
    spans = report.where("field_path = 'report.period'").select("dossier_id", "document_id", "page", "confidence", F.inline(ends)).where("day IS NOT NULL")
    invoice = only(E.invoice_fields(lines), "EXPENSE_INVOICE")
    sheet = only(E.timesheet_rows(cells), "TIMESHEET").withColumnsRenamed({"rate": "hourly_rate_eur", "amount": "amount_eur"})
    worked = _tall(sheet, F.concat(F.lit("timesheet.rows["), F.col("row_index"), F.lit("]")), ("employee_id", "full_name", "role", "month"), ("hours", "hourly_rate_eur", "amount_eur"))
    page = F.concat(F.lit("page "), F.col("page"))
    machine = _reading(report, "TEXT_LAYER", page).unionByName(_reading(spans, "TEXT_LAYER", page, field_path=F.col("to"), value_text=F.col("day").cast("string"), value_date=F.col("day")))
    machine = machine.unionByName(_reading(invoice, "OCR", page)).unionByName(_reading(worked, "CELL", F.concat_ws("!", "sheet", "row"), confidence=F.lit(E.CELL_CONFIDENCE)))
    of_files = carried(keyed(machine), "machine_files")

    # readings of what isn't a file come with each run: call pages, and the registry's people that a timesheet names
    found = pages.page_fields(t["calls"].where("error is null"), "reference", "html").where("value IS NOT NULL")
    day, amount = F.col("field_path").rlike("(from|to)$"), F.col("field_path") == "call.max_funding_eur"
    call = _reading(found, "HTML_SELECTOR", F.lit("call page"), dossier_id=F.col("reference"), value_text=F.col("value"), value_number=F.when(amount, numbers.parse_amount(F.col("value"))), value_date=F.when(day, dates.parse_date(F.col("value"))), confidence=F.lit(1.0))
    people = of_files.where("field_path LIKE 'timesheet.rows[%.employee_id'").select("dossier_id", F.col("value_text").alias("employee_id")).distinct().join(t["registry"].withColumnRenamed("rate", "hourly_rate_eur"), "employee_id")
    person = _tall(people, F.concat(F.lit("registry.personnel["), F.col("employee_id"), F.lit("]")), ("employee_id",), ("hourly_rate_eur",), ("contract_start", "contract_end"))
    outside = keyed(call.unionByName(_reading(person, "HTTP_API", F.lit("registry"), confidence=F.lit(1.0))))
    held = keep(effective(of_files.unionByName(outside), decisions), "held")
    totals_of = effective(keyed(derived(held)), decisions)
    readings = keep(held.unionByName(totals_of), "readings")

    documents_ = carried(fresh, "documents")
    every = documents_.select("document_id", "dossier_id", "kind")
    number = lambda p: _one(p, "value_number").cast(MONEY)
    invoices = every.where("kind = 'EXPENSE_INVOICE'").join(held.drop("dossier_id", "status"), "document_id", "left").groupBy("document_id", "dossier_id").agg(
        _one("invoice.number", "value_text").alias("number"),
        _one("invoice.issue_date", "value_date").alias("issue_date"),
        _one("invoice.supplier_name", "value_text").alias("supplier_name"),
        _one("invoice.project_code", "value_text").alias("project_code"),
        number("invoice.base_eur").alias("base_eur"),
        number("invoice.vat_eur").alias("vat_eur"),
        number("invoice.total_eur").alias("total_eur"),
    )
    of_row = held.where("field_path LIKE 'timesheet.rows[%'").withColumn("field_path", F.regexp_extract("field_path", r"\.([a-z_]+)$", 1))
    sheet = of_row.groupBy("dossier_id", "document_id", "place").agg(_one("employee_id", "value_text").alias("employee_id"), _one("month", "value_text").alias("month"), number("hours").alias("hours"), number("hourly_rate_eur").alias("rate"), number("amount_eur").alias("amount"))
    sheet = keep(sheet.select("dossier_id", "employee_id", "month", "hours", "rate", F.coalesce("amount", numbers.row_amount(F.col("hours"), F.col("rate"))).cast(MONEY).alias("amount")), "timesheet")
    invoices = keep(invoices, "invoices")

    dossiers = t["dossiers"].select(F.col("reference").alias("dossier_id"), "reference", "period_start", "period_end", "claimed_total_eur")
    reported = held.groupBy("dossier_id").agg(number("report.declared_personnel_cost_eur").alias("report_personnel"), number("report.declared_external_cost_eur").alias("report_external"), number("report.declared_total_eur").alias("report_total"))
    spent = sheet.groupBy("dossier_id").agg(F.sum("amount").cast(MONEY).alias("timesheet_total"))
    billed = invoices.groupBy("dossier_id").agg(F.sum("total_eur").cast(MONEY).alias("invoice_total"))
    totals = dossiers.select("dossier_id").join(reported, "dossier_id", "left").join(spent, "dossier_id", "left").join(billed, "dossier_id", "left")
    window = held.where("method = 'HTML_SELECTOR'").groupBy("dossier_id").agg(_one("call.eligible_from", "value_date").alias("eligible_from"), _one("call.eligible_to", "value_date").alias("eligible_to"), number("call.max_funding_eur").alias("max_funding_eur"))
    captures = t["calls"].select(F.col("reference").alias("dossier_id"), F.lit("call_page").alias("source"), "error")
    files_say = held.where("document_id IS NOT NULL").select("dossier_id", "document_id", "field_path", "value_text", "value_number", "value_date")
    context = rules.Context(dossiers, documents_, captures, invoices, sheet, t["registry"], keep(totals, "totals"), keep(window, "call_window"), files_say)
    chunks = E.paragraph_chunks(fresh.where("status = 'EXTRACTED'").select("document_id", F.lit(1).alias("page"), "text")).join(of.select("document_id", "dossier_id"), "document_id")
    return Extracted(documents_, readings, carried(chunks, "chunks"), context)


def runs(spark: SparkSession, out: str) -> list[int]:
    """Numbers of the runs whose findings are complete."""
    top = spark._jvm.org.apache.hadoop.fs.Path(out)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(top):
        return []
    done = [s.getPath() for s in system.listStatus(top) if s.getPath().getName().startswith("run=")]
    return sorted(int(p.getName()[4:]) for p in done if system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "findings/_SUCCESS")))


def findings(spark: SparkSession, out: str) -> DataFrame:
    """The last snapshot of findings; none before the first run."""
    held = runs(spark, out)
    return spark.read.schema(FINDINGS).parquet(f"{out}/run={held[-1]}/findings") if held else spark.createDataFrame([], FINDINGS)


def decisions(spark: SparkSession, out: str) -> DataFrame:
    """The log of people's decisions, oldest first by ``seq``."""
    held = _children(spark, f"{out}/decisions")
    return spark.read.schema(DECISIONS).parquet(*[f"{out}/decisions/{n}" for n in held]) if held else spark.createDataFrame([], DECISIONS)


def review(spark: SparkSession, out: str, wanted: DataFrame) -> DataFrame:
    """Take decisions (dossier_id, target, key, action, new_value, reason, actor and, for
    readings, the expected revision) on the last run's readings and findings.  Those that can't be
    taken are refused: UNKNOWN (no such reading or finding), ACTION (not one of its
    kind), REASON (none given), VALUE (a correction without one), STALE (decided
    meanwhile).  Gives each with its outcome; what was taken holds from the next run on."""
    at = f"{out}/run={runs(spark, out)[-1]}"
    known = spark.read.parquet(f"{at}/readings").select(F.lit("reading").alias("target"), "dossier_id", "key")
    known = known.unionByName(findings(spark, out).select(F.lit("finding").alias("target"), "dossier_id", F.col("fingerprint").alias("key")))
    log = decisions(spark, out)
    since = log.groupBy("target", "dossier_id", "key").agg(F.count(F.lit(1)).alias("_n"))
    keys = ["target", "dossier_id", "key"]
    if "expected_revision" not in wanted.columns:
        wanted = wanted.withColumn("expected_revision", F.lit(None).cast("long"))
    j = wanted.join(known.distinct().withColumn("_known", F.lit(True)), keys, "left").join(since, keys, "left")
    fits = F.lit(False)
    for target, actions in ACTIONS.items():
        fits = fits | ((F.col("target") == target) & F.col("action").isin(*actions))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    outcome = F.when(F.col("_known").isNull(), "UNKNOWN").when(~F.coalesce(fits, F.lit(False)), "ACTION").when(blank("reason"), "REASON").when((F.col("action") == "CORRECT") & blank("new_value"), "VALUE").when(F.col("expected_revision") != F.coalesce("_n", F.lit(0)), "STALE").otherwise("TAKEN")
    number = len(_children(spark, f"{out}/decisions"))
    told = j.withColumn("outcome", outcome).withColumn("seq", F.lit(number << 40) + F.monotonically_increasing_id())
    columns = [f.split()[0] for f in DECISIONS.split(", ")]
    path = f"{out}/reviews/{number}"
    told.select(*columns, "outcome").write.mode("overwrite").parquet(path)
    told = spark.read.parquet(path)
    told.where("outcome = 'TAKEN'").select(*columns).write.parquet(f"{out}/decisions/{number}")
    return told


def process(spark: SparkSession, root: str, out: str) -> DataFrame:
    """Process all dossiers under ``root`` and return the findings, with the
    status and what the run did to each."""
    done = runs(spark, out)
    number = max(done, default=-1) + 1
    at = f"{out}/run={number}"

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{at}/{name}")
        return spark.read.schema(df.schema).parquet(f"{at}/{name}")

    log = decisions(spark, out)
    found = extract(spark, root, keep, Last(spark, f"{out}/run={done[-1]}" if done else None), log)
    name = F.concat_ws("|", "dossier_id", "fingerprint")
    decided = log.where("target = 'finding'").select(F.concat_ws("|", "dossier_id", "key").alias("_key"), "seq", "action", "reason")
    before = W.resolve_findings(findings(spark, out).withColumn("_key", name), decided, "_key", "seq").drop("_key")
    produced = keep(rules.evaluate(found.context), "produced")
    steps = R.upsert(produced, before, KEYS, found.context.dossiers.select("dossier_id"))
    columns = ["rule_id", "severity", "subject", "detail", "document_ids"]
    new, old = produced.select(*KEYS, F.struct(*columns).alias("new")), before.select(*KEYS, F.struct(*columns).alias("old"))
    kept = steps.join(new, KEYS, "left").join(old, KEYS, "left").withColumn("f", F.coalesce("new", "old"))
    kept.select(*KEYS, *[f"f.{c}" for c in columns], F.col("after").alias("status"), "action").write.mode("overwrite").parquet(f"{at}/findings")
    return findings(spark, out)


def summary(found: DataFrame) -> DataFrame:
    """Per dossier: open findings, and how many of them block."""
    return found.where("status = 'OPEN'").groupBy("dossier_id").agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.col("severity") == "BLOCKER").alias("blocking")).orderBy("dossier_id")


def report(spark: SparkSession, out: str, to: str) -> None:
    """Readings as CSV (both dialects), dossiers with their findings as JSON, and
    a page of the open findings, from the last run."""
    at, found = f"{out}/run={runs(spark, out)[-1]}", findings(spark, out)
    held = spark.read.parquet(f"{at}/readings").join(spark.read.parquet(f"{at}/documents").select("document_id", F.col("name").alias("document")), "document_id", "left")
    rows = P.csv_rows(held.select("field_path", F.col("value_text").alias("value"), "confidence", "status", "method", "document").orderBy("document", P.sort_key(F.col("field_path"))))
    P.write_csv(rows, f"{to}/readings.csv")
    P.write_csv(rows, f"{to}/readings-spreadsheet.csv", "semicolon")
    shown = found.select("dossier_id", "rule_id", "severity", "subject", "status")
    P.nested_json(found.select("dossier_id").distinct(), "dossier_id", {"findings": (shown, "dossier_id")}).select("json").write.text(f"{to}/findings.json")
    page = P.html_table(shown.where("status = 'OPEN'").orderBy("dossier_id", "severity", "rule_id", "subject"), "Incidencias abiertas")
    spark.createDataFrame([(page,)], "page string").coalesce(1).write.text(f"{to}/findings.html")


def reindex(spark: SparkSession, out: str) -> int:
    """Embed the chunks of the last run whose text the index before it doesn't
    hold, keep the others, and return how many were embedded."""
    held = runs(spark, out)
    config = f"hashing-{Q.WIDTH}"
    keys = ["document_id", "ordinal"]
    current = spark.read.parquet(f"{out}/run={held[-1]}/chunks").select(*keys, "text")
    empty = spark.createDataFrame([], "document_id string, ordinal int, text string, embedding array<double>, config_hash string")
    number = max((int(n) for n in _children(spark, f"{out}/index")), default=-1)
    before = spark.read.schema(empty.schema).parquet(f"{out}/index/{number}") if number >= 0 else empty
    todo = Q.pending(current, before, keys, config).select(*keys, "text")
    key = F.to_json(F.struct(*keys))
    vectors = Q.embedded(todo.withColumn("key", key), "key", X.plain_words(F.col("text")))
    new = todo.withColumn("key", key).join(vectors, "key", "left").select(*keys, "text", F.coalesce("embedding", F.array().cast("array<double>")).alias("embedding"), F.lit(config).alias("config_hash"))
    kept = before.join(current, [*keys, "text"], "left_semi").join(todo.select(*keys), keys, "left_anti")
    kept.select(*new.columns).unionByName(new.withColumn("embedding", F.col("embedding").cast("array<double>"))).write.mode("overwrite").parquet(f"{out}/index/{number + 1}")
    return todo.count()


def _children(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in system.listStatus(p)] if system.exists(p) else []


def reset(spark: SparkSession, out: str) -> None:
    """Remove the runs, the index and the decisions under ``out``, and nothing else there."""
    for name in _children(spark, out):
        if name.startswith("run=") or name in ("index", "decisions", "reviews"):
            p = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{name}")
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
