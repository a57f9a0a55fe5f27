"""The rule catalogue: deterministic checks of sources against each other.

Each rule takes the context and returns findings (dossier_id, rule_id,
severity, subject, detail, document_ids, fingerprint).  A rule is a join,
aggregate or filter over frames; nothing is collected.  A finding's identity is
its fingerprint within the dossier, so equal findings of a run collapse.

Context frames (wide, typed):

* dossiers    dossier_id, reference, period_start, period_end, claimed_total_eur
* documents   document_id, dossier_id, kind, status, mean_confidence,
              formula_cells array, alternates array, text
* captures    dossier_id, source, error
* invoices    document_id, dossier_id, number, issue_date, supplier_name,
              project_code, base_eur, vat_eur, total_eur
* timesheet   dossier_id, employee_id, month, hours, rate, amount
* registry    employee_id, rate, contract_start, contract_end
* totals      dossier_id, report_personnel, report_external, report_total,
              timesheet_total, invoice_total
* call_window dossier_id, eligible_from, eligible_to, max_funding_eur
* readings    dossier_id, document_id, field_path, value_text, value_number,
              value_date
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, numbers, structured, text
from .relational import intersection, outside

# Ceilings and tolerances of the catalogue.
TOLERANCE = "0.01"
MONTHLY_HOURS, ANNUAL_HOURS = 180, 1720
LEAST_CONFIDENCE = 78.0
REQUIRED_KINDS = ("TECHNICAL_REPORT", "EXPENSE_INVOICE", "TIMESHEET")
REQUIRED_INVOICE_FIELDS = ("number", "issue_date", "supplier_name", "base_eur", "total_eur")
REQUIRED_TOTALS = ("report_personnel", "report_external", "report_total")


@dataclass(frozen=True)
class Context:
    dossiers: DataFrame
    documents: DataFrame
    captures: DataFrame
    invoices: DataFrame
    timesheet: DataFrame
    registry: DataFrame
    totals: DataFrame
    call_window: DataFrame
    readings: DataFrame


Rule = Callable[[Context], DataFrame]
RULES: dict[str, Rule] = {}


def rule(*ids: str):
    def add(f: Rule) -> Rule:
        WIDER.append(f)
        for i in ids:
            RULES[i] = f
        return f

    return add


def finding(df: DataFrame, rule_id: str, severity: str, subject: Column, detail: Mapping[str, Column] | None = None, documents: Column | None = None) -> DataFrame:
    pairs = [x for k, v in (detail or {}).items() for x in (F.lit(k), v.cast("string"))]
    return df.select(
        "dossier_id",
        F.lit(rule_id).alias("rule_id"),
        F.lit(severity).alias("severity"),
        subject.cast("string").alias("subject"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("detail"),
        (documents if documents is not None else F.array().cast("array<string>")).alias("document_ids"),
    ).withColumn("fingerprint", structured.fingerprint(F.col("rule_id"), F.col("subject")))


@dataclass(frozen=True)
class Check:
    """A rule, or a part of one, that looks at one row: when it fires, and its finding."""

    rule_id: str
    severity: str
    fires: Column
    subject: Column
    detail: Mapping[str, Column] | None = None
    documents: Column | None = None


def _registered_invoices(c: Context) -> DataFrame:
    known = c.dossiers.select("dossier_id", "reference", text.reference_key(F.col("reference")).alias("reference_key"), "period_start", "period_end", F.lit(True).alias("has_dossier"))
    window = c.call_window.select("dossier_id", "eligible_from", "eligible_to")
    return c.invoices.join(known, "dossier_id", "left").join(window, "dossier_id", "left")


def _registered_timesheet(c: Context) -> DataFrame:
    known = c.registry.select("employee_id", F.col("rate").alias("known_rate"), "contract_start", "contract_end", F.lit(True).alias("is_known"))
    return c.timesheet.join(known, "employee_id", "left")


#: Frames whose rows rules look at one by one, and those checks; each frame is
#: passed over once for all of them.
FRAMES: dict[str, Callable[[Context], DataFrame]] = {"documents": lambda c: c.documents, "invoices": _registered_invoices, "timesheet": _registered_timesheet}
CHECKS: dict[str, list[Callable[[], Sequence[Check]]]] = {name: [] for name in FRAMES}
#: Rules, or parts of them, that need more than a row.
WIDER: list[Rule] = []


def row_rule(rule_id: str, frame: str, joined: bool = False):
    """Register checks of a frame's rows as a rule.  The rule alone reads the
    context's own frame unless a check needs what is joined to it."""

    def add(f: Callable[[], Check]) -> Rule:
        def alone(c: Context) -> DataFrame:
            return _hits(FRAMES[frame](c) if joined else getattr(c, frame), f())

        CHECKS[frame].append(lambda: [f()])
        RULES[rule_id] = alone
        return alone

    return add


def _hits(df: DataFrame, k: Check) -> DataFrame:
    return finding(df.where(k.fires), k.rule_id, k.severity, k.subject, k.detail, k.documents)


def _all_hits(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """The findings of all checks in one pass: a row goes on once for each that
    fires, and only then are its subject and details made."""
    fired = df.withColumn("_n", F.explode(F.array(*[F.when(k.fires, F.lit(n)) for n, k in enumerate(checks)]))).where("_n is not null")

    def of(values: Sequence[Column]) -> Column:
        return reduce(lambda chain, nv: chain.when(F.col("_n") == nv[0], nv[1]), enumerate(values), F)

    none = F.array().cast("array<string>")
    details = [F.create_map(*[x for key, v in k.detail.items() for x in (F.lit(key), v.cast("string"))]) if k.detail else F.create_map().cast("map<string,string>") for k in checks]
    return fired.select(
        "dossier_id",
        of([F.lit(k.rule_id) for k in checks]).alias("rule_id"),
        of([F.lit(k.severity) for k in checks]).alias("severity"),
        of([k.subject.cast("string") for k in checks]).alias("subject"),
        of(details).alias("detail"),
        of([none if k.documents is None else k.documents for k in checks]).alias("document_ids"),
    )


def _document(rule_id: str, severity: str, fires: Column, detail=None) -> Check:
    return Check(rule_id, severity, fires, F.col("document_id"), detail, F.array("document_id"))


@row_rule("UNSUPPORTED_DOCUMENT", "documents")
def unsupported() -> Check:
    return _document("UNSUPPORTED_DOCUMENT", "WARNING", F.col("status") == "UNSUPPORTED")


@row_rule("CORRUPT_DOCUMENT", "documents")
def corrupt() -> Check:
    return _document("CORRUPT_DOCUMENT", "WARNING", F.col("status") == "CORRUPT")


@row_rule("DOCUMENT_EXTRACTION_FAILED", "documents")
def failed() -> Check:
    return _document("DOCUMENT_EXTRACTION_FAILED", "BLOCKER", F.col("status") == "FAILED")


@row_rule("UNTRUSTED_EXCEL_FORMULA", "documents")
def formulas() -> Check:
    cells = F.array_join(F.slice("formula_cells", 1, 20), ", ")
    return _document("UNTRUSTED_EXCEL_FORMULA", "WARNING", F.size("formula_cells") > 0, {"formula_cells": cells})


@rule("EXTERNAL_SOURCE_UNAVAILABLE")
def unavailable(c: Context) -> DataFrame:
    return finding(c.captures.where("error is not null"), "EXTERNAL_SOURCE_UNAVAILABLE", "BLOCKER", F.col("source"), {"source": F.col("source"), "error": F.col("error")})


@row_rule("DUPLICATE_DOCUMENT", "documents")
def duplicates() -> Check:
    return _document("DUPLICATE_DOCUMENT", "INFO", F.size("alternates") > 0, {"also_submitted_as": F.array_join("alternates", ", ")})


@row_rule("LOW_OCR_CONFIDENCE", "documents")
def low_confidence() -> Check:
    return _document("LOW_OCR_CONFIDENCE", "WARNING", F.col("mean_confidence") < LEAST_CONFIDENCE, {"mean_word_confidence": F.bround("mean_confidence", 1)})


@row_rule("PROMPT_INJECTION_ATTEMPT", "documents")
def injection() -> Check:
    hits = text.directive_hits(F.col("text"))
    return _document("PROMPT_INJECTION_ATTEMPT", "WARNING", F.size(hits) > 0, {"matched_phrases": F.array_join(hits, " | ")})


def _no_code() -> Column:
    return F.coalesce(text.strip_dashes(F.col("project_code")), F.lit("")) == ""


@row_rule("MISSING_PROJECT_CODE", "invoices")
def missing_code() -> Check:
    return _document("MISSING_PROJECT_CODE", "BLOCKER", _no_code())


@row_rule("PROJECT_CODE_MISMATCH", "invoices", joined=True)
def code_mismatch() -> Check:
    other = ~F.contains(text.reference_key(F.col("project_code")), F.col("reference_key"))
    return _document("PROJECT_CODE_MISMATCH", "BLOCKER", F.col("has_dossier").isNotNull() & ~_no_code() & other, {"found": F.col("project_code"), "expected": F.col("reference")})


@rule("DUPLICATE_INVOICE_NUMBER")
def repeated_number(c: Context) -> DataFrame:
    n = c.invoices.withColumn("key", text.reference_key(F.col("number"))).where("key != ''")
    # distinct rows are counted: the ids themselves are gathered only where they are read
    d = n.select("dossier_id", "key", "document_id").distinct().groupBy("dossier_id", "key")
    g = d.agg(F.count("document_id").alias("n"), F.array_sort(F.collect_list("document_id")).alias("ids")).where("n > 1")
    return finding(g, "DUPLICATE_INVOICE_NUMBER", "BLOCKER", F.col("key"), {"invoice_number": F.col("key"), "occurrences": F.col("n").cast("int")}, F.col("ids"))


@row_rule("EXPENSE_OUTSIDE_ELIGIBLE_PERIOD", "invoices", joined=True)
def outside_period() -> Check:
    start, end = intersection(F.col("eligible_from"), F.col("eligible_to"), F.col("period_start"), F.col("period_end"))
    fires = F.col("has_dossier").isNotNull() & outside(F.col("issue_date"), start, end)
    return _document("EXPENSE_OUTSIDE_ELIGIBLE_PERIOD", "BLOCKER", fires, {"issue_date": F.col("issue_date"), "eligible_from": start, "eligible_to": end})


@row_rule("INVOICE_ARITHMETIC_MISMATCH", "invoices")
def invoice_arithmetic() -> Check:
    total = F.col("base_eur") + F.col("vat_eur")
    return _document("INVOICE_ARITHMETIC_MISMATCH", "WARNING", numbers.differs(total, F.col("total_eur")), {"base_eur": F.col("base_eur"), "vat_eur": F.col("vat_eur"), "stated_total_eur": F.col("total_eur"), "computed_total_eur": total})


def _row(rule_id: str, severity: str, fires: Column, *subject: str, **detail: Column) -> Check:
    return Check(rule_id, severity, fires, F.concat_ws("|", *subject), {"employee_id": F.col("employee_id"), **detail})


@row_rule("NEGATIVE_HOURS", "timesheet")
def negative_hours() -> Check:
    return _row("NEGATIVE_HOURS", "BLOCKER", F.col("hours") < 0, "employee_id", "month", month=F.col("month"))


def _monthly_hours() -> Check:
    return _row("HOURS_ABOVE_MONTHLY_CEILING", "WARNING", F.col("hours") > MONTHLY_HOURS, "employee_id", "month", month=F.col("month"))


row_rule("HOURS_ABOVE_MONTHLY_CEILING", "timesheet")(_monthly_hours)


def monthly_hours(c: Context, grain: str = "row") -> DataFrame:
    """Per row, or (grain ``person_month``) for the sum of a person's month."""
    t = c.timesheet
    if grain == "person_month":
        t = t.groupBy("dossier_id", "employee_id", "month").agg(F.sum("hours").alias("hours"))
    return _hits(t, _monthly_hours())


@rule("HOURS_ABOVE_ANNUAL_CEILING")
def annual_hours(c: Context) -> DataFrame:
    g = c.timesheet.where("hours > 0").groupBy("dossier_id", "employee_id", F.substring("month", 1, 4).alias("year")).agg(F.sum("hours").alias("hours"))
    return _hits(g, _row("HOURS_ABOVE_ANNUAL_CEILING", "WARNING", F.col("hours") > ANNUAL_HOURS, "employee_id", "year", year=F.col("year"), hours=F.col("hours")))


@row_rule("TIMESHEET_ROW_ARITHMETIC", "timesheet")
def row_arithmetic() -> Check:
    wrong = numbers.differs(numbers.row_amount(F.col("hours"), F.col("rate")), F.col("amount"))
    return Check("TIMESHEET_ROW_ARITHMETIC", "WARNING", wrong, F.concat_ws("|", "employee_id", "month"))


@row_rule("UNKNOWN_PERSON", "timesheet", joined=True)
def unknown_person() -> Check:
    return _row("UNKNOWN_PERSON", "BLOCKER", F.col("is_known").isNull(), "employee_id")


@row_rule("PERSONNEL_RATE_MISMATCH", "timesheet", joined=True)
def rate_mismatch() -> Check:
    return _row("PERSONNEL_RATE_MISMATCH", "BLOCKER", numbers.differs(F.col("rate"), F.col("known_rate")), "employee_id", "rate", declared_rate_eur=F.col("rate"), registry_rate_eur=F.col("known_rate"))


@row_rule("PERSON_OUTSIDE_CONTRACT", "timesheet", joined=True)
def outside_contract() -> Check:
    fires = F.col("is_known").isNotNull() & outside(dates.month_start(F.col("month")), F.col("contract_start"), F.col("contract_end"))
    return _row("PERSON_OUTSIDE_CONTRACT", "BLOCKER", fires, "employee_id", "month", month=F.col("month"), contract_start=F.col("contract_start"), contract_end=F.col("contract_end"))


def _costs(c: Context, rule_id: str, declared: str, evidence: str) -> DataFrame:
    d, e = F.col(declared), F.col(evidence)
    return finding(c.totals.where(numbers.differs(d, e)), rule_id, "BLOCKER", F.lit(rule_id), {"declared_eur": d, "evidence_eur": e, "difference_eur": d - e})


@rule("PERSONNEL_COST_MISMATCH")
def personnel_cost(c: Context) -> DataFrame:
    return _costs(c, "PERSONNEL_COST_MISMATCH", "report_personnel", "timesheet_total")


@rule("EXTERNAL_COST_MISMATCH")
def external_cost(c: Context) -> DataFrame:
    return _costs(c, "EXTERNAL_COST_MISMATCH", "report_external", "invoice_total")


@rule("CLAIMED_TOTAL_MISMATCH")
def claimed_total(c: Context) -> DataFrame:
    j = c.totals.join(c.dossiers.select("dossier_id", "claimed_total_eur"), "dossier_id")
    claimed, report = F.col("claimed_total_eur"), F.col("report_total")
    return finding(j.where(numbers.differs(claimed, report)), "CLAIMED_TOTAL_MISMATCH", "BLOCKER", F.lit("claimed_total"), {"claimed_total_eur": claimed, "report_total_eur": report})


@rule("CLAIM_ABOVE_CALL_MAXIMUM")
def above_maximum(c: Context) -> DataFrame:
    j = c.dossiers.join(c.call_window, "dossier_id")
    return finding(j.where("claimed_total_eur > max_funding_eur"), "CLAIM_ABOVE_CALL_MAXIMUM", "BLOCKER", F.lit("call_maximum"), {"claimed_total_eur": F.col("claimed_total_eur"), "max_funding_eur": F.col("max_funding_eur")})


def _lacking_fields() -> list[Check]:
    return [Check("INSUFFICIENT_EVIDENCE", "BLOCKER", F.col(f).isNull(), F.concat_ws("|", "document_id", F.lit(f)), {"missing_field": F.lit(f)}, F.array("document_id")) for f in REQUIRED_INVOICE_FIELDS]


CHECKS["invoices"].append(_lacking_fields)


def _insufficient_dossier(c: Context) -> DataFrame:
    ident = "INSUFFICIENT_EVIDENCE"
    kinds = c.dossiers.select("dossier_id", F.explode(F.array(*[F.lit(k) for k in REQUIRED_KINDS])).alias("kind"))
    present = c.documents.where("status = 'EXTRACTED'").select("dossier_id", "kind").distinct()
    missing_kind = finding(kinds.join(present, ["dossier_id", "kind"], "left_anti"), ident, "BLOCKER", F.col("kind"), {"missing_kind": F.col("kind")})
    reported = c.totals.join(present.where("kind = 'TECHNICAL_REPORT'").select("dossier_id"), "dossier_id", "left_semi")
    lacks = [F.when(F.col(f).isNull(), F.lit(f)) for f in REQUIRED_TOTALS]
    report_fields = reported.select("dossier_id", F.explode(F.array_compact(F.array(*lacks))).alias("field"))
    sheets = present.where("kind = 'TIMESHEET'").select("dossier_id")
    empty = sheets.join(c.timesheet.select("dossier_id").distinct(), "dossier_id", "left_anti")
    report_found = finding(report_fields, ident, "BLOCKER", F.col("field"), {"missing_field": F.col("field")})
    return missing_kind.unionByName(report_found).unionByName(finding(empty, ident, "BLOCKER", F.lit("timesheet.rows"), {"missing_field": F.lit("timesheet.rows")}))


WIDER.append(_insufficient_dossier)


def insufficient(c: Context) -> DataFrame:
    lacking = _all_hits(c.invoices, _lacking_fields()).withColumn("fingerprint", structured.fingerprint(F.col("rule_id"), F.col("subject")))
    return _insufficient_dossier(c).unionByName(lacking)


RULES["INSUFFICIENT_EVIDENCE"] = insufficient


@rule("AMBIGUOUS_FIELD")
def ambiguous_field(c: Context) -> DataFrame:
    keys, values = ["dossier_id", "document_id", "field_path"], ["value_text", "value_number", "value_date"]
    d = c.readings.select(*keys, *values).distinct().groupBy(*keys)
    g = d.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(*values))).alias("r")).where("n > 1")
    subject = F.concat_ws("|", F.coalesce("document_id", F.lit("")), "field_path")
    return finding(g, "AMBIGUOUS_FIELD", "BLOCKER", subject, {"field_path": F.col("field_path"), "readings": F.to_json(F.slice("r", 1, 5))}, F.array_compact(F.array("document_id")))


def evaluate(c: Context) -> DataFrame:
    """All findings; equal fingerprints of a dossier count once, with the
    greatest detail.  Rules that look at one row share a pass over its frame.

    A fingerprint stands for its rule and subject, and a rule has one severity,
    so these are the key: plain columns, which a reader that needs no more than
    them (a count of findings) groups without details and fingerprints."""
    passes = [_all_hits(FRAMES[name](c), [k for f in made for k in f()]) for name, made in CHECKS.items()]
    every = reduce(DataFrame.unionByName, passes + [f(c).drop("fingerprint") for f in WIDER])
    keys = ["dossier_id", "rule_id", "severity", "subject"]
    rest, order = F.struct("detail", "document_ids"), F.struct(F.to_json("detail"), F.to_json("document_ids"))
    last = every.groupBy(*keys).agg(F.max_by(rest, order).alias("_f"))
    return last.select(*keys, "_f.*").withColumn("fingerprint", structured.fingerprint(F.col("rule_id"), F.col("subject")))
