"""The rule catalogue over a context that is derived from the driver tables:
orders stand in for invoices, lineitem for timesheet rows, supplier for the
personnel registry, and fifty dossiers share them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules
from .registry import Tables, query

DOSSIERS = 50
REF = "'INN-2025-' || lpad({d}::VARCHAR, 3, '0')"

PRELUDE = f"""
dossiers AS (SELECT d::VARCHAR AS dossier_id, {REF.format(d="d")} AS reference, DATE '1995-03-01' AS period_start, DATE '1997-12-31' AS period_end, (1000000 + d)::DECIMAL(14,2) AS claimed FROM range(0, {DOSSIERS}) r(d)),
docs AS (SELECT doc_id::VARCHAR AS document_id, (doc_id % {DOSSIERS})::VARCHAR AS dossier_id, CASE doc_id % 10 WHEN 0 THEN 'UNSUPPORTED' WHEN 1 THEN 'CORRUPT' WHEN 2 THEN 'FAILED' ELSE 'EXTRACTED' END AS status,
  CASE doc_id % 3 WHEN 0 THEN 'TECHNICAL_REPORT' WHEN 1 THEN 'EXPENSE_INVOICE' ELSE 'TIMESHEET' END AS kind, (n_chars % 100)::DOUBLE AS conf, doc_id % 13 = 0 AS formula, doc_id % 17 = 0 AS twice, text FROM documents),
inv AS (SELECT 'o' || o_orderkey AS document_id, (o_custkey % {DOSSIERS})::VARCHAR AS dossier_id, CASE WHEN o_orderkey % 11 <> 0 THEN 'F-' || o_custkey END AS number, o_orderdate::DATE AS issue_date, 'p' AS supplier_name,
  CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' - ' WHEN 2 THEN 'INN-2024-999' ELSE {REF.format(d=f"(o_custkey % {DOSSIERS})")} END AS code,
  (o_totalprice * 0.8)::DECIMAL(16,2)::DECIMAL(16,4) AS base, (o_totalprice * 0.2)::DECIMAL(16,2)::DECIMAL(16,4) AS vat, (o_totalprice::DECIMAL(16,2) + CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END)::DECIMAL(16,4) AS total FROM orders),
sheet AS (SELECT (l_orderkey % {DOSSIERS})::VARCHAR AS dossier_id, l_suppkey::VARCHAR AS emp, strftime(l_shipdate, '%Y-%m') AS month, (l_quantity::DECIMAL(10,2) * 5 - 20)::DECIMAL(16,4) AS hours, (10 + l_suppkey % 7)::DECIMAL(16,4) AS rate,
  ((l_quantity::DECIMAL(10,2) * 5 - 20) * (10 + l_suppkey % 7) + CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END)::DECIMAL(16,4) AS amount FROM lineitem),
reg AS (SELECT s_suppkey::VARCHAR AS emp, (10 + s_suppkey % 7 + CASE WHEN s_suppkey % 5 = 0 THEN 0.5 ELSE 0 END)::DECIMAL(16,4) AS rate, DATE '1995-06-01' AS cs, CASE WHEN s_suppkey % 3 = 0 THEN DATE '1997-06-01' END AS ce FROM supplier WHERE s_suppkey % 10 <> 0),
totals AS (SELECT dossier_id, CASE WHEN dossier_id::INT % 7 <> 0 THEN (dossier_id::INT * 1000)::DECIMAL(16,4) END AS rp, (dossier_id::INT * 2000)::DECIMAL(16,4) AS re, (1000000 + dossier_id::INT % 2)::DECIMAL(16,4) AS rt, (SELECT sum(amount) FROM sheet s WHERE s.dossier_id = d.dossier_id) AS ts, (SELECT sum(total) FROM inv i WHERE i.dossier_id = d.dossier_id) AS it FROM dossiers d)
"""


def context(t: Tables) -> rules.Context:
    spark = t.spark
    ref = lambda d: F.concat(F.lit("INN-2025-"), F.lpad(d.cast("string"), 3, "0"))
    d = F.col("id")
    dossiers = spark.range(DOSSIERS).select(d.cast("string").alias("dossier_id"), ref(d).alias("reference"), F.lit("1995-03-01").cast("date").alias("period_start"), F.lit("1997-12-31").cast("date").alias("period_end"), (d + 1000000).cast("decimal(14,2)").alias("claimed_total_eur"))
    k = F.col("doc_id")
    status = F.when(k % 10 == 0, "UNSUPPORTED").when(k % 10 == 1, "CORRUPT").when(k % 10 == 2, "FAILED").otherwise("EXTRACTED")
    kind = F.when(k % 3 == 0, "TECHNICAL_REPORT").when(k % 3 == 1, "EXPENSE_INVOICE").otherwise("TIMESHEET")
    none = F.array().cast("array<string>")
    documents = t.documents.select(k.cast("string").alias("document_id"), (k % DOSSIERS).cast("string").alias("dossier_id"), kind.alias("kind"), status.alias("status"), (F.col("n_chars") % 100).cast("double").alias("mean_confidence"), F.when(k % 13 == 0, F.array(F.lit("A1"))).otherwise(none).alias("formula_cells"), F.when(k % 17 == 0, F.array(F.lit("copia.pdf"))).otherwise(none).alias("alternates"), "text")
    captures = dossiers.select("dossier_id", F.lit("registry").alias("source"), F.when(F.col("dossier_id").cast("int") % 9 == 0, "timeout").alias("error"))
    o, own = F.col("o_orderkey"), F.col("o_custkey") % DOSSIERS
    price = F.col("o_totalprice")
    m = lambda c: c.cast("decimal(16,2)").cast("decimal(16,4)")
    code = F.when(o % 5 == 0, F.lit(None)).when(o % 5 == 1, " - ").when(o % 5 == 2, "INN-2024-999").otherwise(ref(own))
    invoices = t.orders.select(F.concat(F.lit("o"), o.cast("string")).alias("document_id"), own.cast("string").alias("dossier_id"), F.when(o % 11 != 0, F.concat(F.lit("F-"), F.col("o_custkey").cast("string"))).alias("number"), F.to_date("o_orderdate").alias("issue_date"), F.lit("p").alias("supplier_name"), code.alias("project_code"), m(price * 0.8).alias("base_eur"), m(price * 0.2).alias("vat_eur"), (price.cast("decimal(16,2)") + F.when(o % 6 == 0, 1).otherwise(0)).cast("decimal(16,4)").alias("total_eur"))
    s = F.col("l_suppkey")
    hours = (F.col("l_quantity").cast("decimal(10,2)") * 5 - 20).cast("decimal(16,4)")
    rate = (s % 7 + 10).cast("decimal(16,4)")
    timesheet = t.lineitem.select((F.col("l_orderkey") % DOSSIERS).cast("string").alias("dossier_id"), s.cast("string").alias("employee_id"), F.date_format("l_shipdate", "yyyy-MM").alias("month"), hours.alias("hours"), rate.alias("rate"), (hours * rate + F.when(F.col("l_linenumber") == 1, 1).otherwise(0)).cast("decimal(16,4)").alias("amount"))
    e = F.col("s_suppkey")
    registry = t.supplier.where("s_suppkey % 10 != 0").select(e.cast("string").alias("employee_id"), (e % 7 + 10 + F.when(e % 5 == 0, F.lit(0.5)).otherwise(0.0)).cast("decimal(16,4)").alias("rate"), F.lit("1995-06-01").cast("date").alias("contract_start"), F.when(e % 3 == 0, F.lit("1997-06-01").cast("date")).alias("contract_end"))
    n = F.col("dossier_id").cast("int")
    sheet_sum = timesheet.groupBy("dossier_id").agg(F.sum("amount").alias("timesheet_total"))
    invoice_sum = invoices.groupBy("dossier_id").agg(F.sum("total_eur").alias("invoice_total"))
    totals = dossiers.select("dossier_id", F.when(n % 7 != 0, (n * 1000).cast("decimal(16,4)")).alias("report_personnel"), (n * 2000).cast("decimal(16,4)").alias("report_external"), (n % 2 + 1000000).cast("decimal(16,4)").alias("report_total")).join(sheet_sum, "dossier_id", "left").join(invoice_sum, "dossier_id", "left")
    window = dossiers.select("dossier_id", F.lit("1995-01-01").cast("date").alias("eligible_from"), F.lit("1996-06-30").cast("date").alias("eligible_to"), F.lit("1000020").cast("decimal(16,4)").alias("max_funding_eur"))
    u = F.col("user_id")
    readings = t.events.select((u % DOSSIERS).cast("string").alias("dossier_id"), u.cast("string").alias("document_id"), F.concat(F.lit("day."), F.to_date("ts").cast("string")).alias("field_path"), F.col("event_type").alias("value_text"), F.lit(None).cast("decimal(16,4)").alias("value_number"), F.lit(None).cast("date").alias("value_date"))
    return rules.Context(dossiers, documents, captures, invoices, timesheet, registry, totals, window, readings)


DOC = "SELECT dossier_id, document_id AS subject FROM docs WHERE "
KEY = "regexp_replace(upper({c}), '[^A-Z0-9-]', '', 'g')"
EMP_MONTH = "emp || '|' || month"

#: Rule id, severity and the (dossier_id, subject) rows in SQL.
RULE_SQL = {
    "UNSUPPORTED_DOCUMENT": ("WARNING", DOC + "status = 'UNSUPPORTED'"),
    "CORRUPT_DOCUMENT": ("WARNING", DOC + "status = 'CORRUPT'"),
    "DOCUMENT_EXTRACTION_FAILED": ("BLOCKER", DOC + "status = 'FAILED'"),
    "UNTRUSTED_EXCEL_FORMULA": ("WARNING", DOC + "formula"),
    "EXTERNAL_SOURCE_UNAVAILABLE": ("BLOCKER", "SELECT dossier_id, 'registry' AS subject FROM dossiers WHERE dossier_id::INT % 9 = 0"),
    "DUPLICATE_DOCUMENT": ("INFO", DOC + "twice"),
    "LOW_OCR_CONFIDENCE": ("WARNING", DOC + "conf < 78.0"),
    "PROMPT_INJECTION_ATTEMPT": ("WARNING", DOC + "regexp_matches(text, '(?i)ignore\\s+(all\\s+)?previous\\s+instructions|assistant\\s*:|\\bsystem\\s*:')"),
    "MISSING_PROJECT_CODE": ("BLOCKER", "SELECT dossier_id, document_id AS subject FROM inv WHERE coalesce(trim(code, '- '), '') = ''"),
    "PROJECT_CODE_MISMATCH": ("BLOCKER", f"SELECT dossier_id, document_id AS subject FROM inv JOIN dossiers USING (dossier_id) WHERE coalesce(trim(code, '- '), '') <> '' AND NOT contains({KEY.format(c='code')}, {KEY.format(c='reference')})"),
    "DUPLICATE_INVOICE_NUMBER": ("BLOCKER", f"SELECT dossier_id, {KEY.format(c='number')} AS subject FROM inv WHERE number IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT document_id) > 1"),
    "EXPENSE_OUTSIDE_ELIGIBLE_PERIOD": ("BLOCKER", "SELECT dossier_id, document_id AS subject FROM inv WHERE NOT issue_date BETWEEN DATE '1995-03-01' AND DATE '1996-06-30'"),
    "INVOICE_ARITHMETIC_MISMATCH": ("WARNING", "SELECT dossier_id, document_id AS subject FROM inv WHERE abs(base + vat - total) > 0.01"),
    "NEGATIVE_HOURS": ("BLOCKER", f"SELECT dossier_id, {EMP_MONTH} AS subject FROM sheet WHERE hours < 0"),
    "HOURS_ABOVE_MONTHLY_CEILING": ("WARNING", f"SELECT dossier_id, {EMP_MONTH} AS subject FROM sheet WHERE hours > 180"),
    "HOURS_ABOVE_ANNUAL_CEILING": ("WARNING", "SELECT dossier_id, emp || '|' || substr(month, 1, 4) AS subject FROM sheet WHERE hours > 0 GROUP BY 1, 2 HAVING sum(hours) > 1720"),
    "TIMESHEET_ROW_ARITHMETIC": ("WARNING", f"SELECT dossier_id, {EMP_MONTH} AS subject FROM sheet WHERE abs(round_even(hours * rate, 2) - amount) > 0.01"),
    "UNKNOWN_PERSON": ("BLOCKER", "SELECT dossier_id, emp AS subject FROM sheet WHERE emp NOT IN (SELECT emp FROM reg)"),
    "PERSONNEL_RATE_MISMATCH": ("BLOCKER", "SELECT dossier_id, emp || '|' || sheet.rate::DECIMAL(16,4) AS subject FROM sheet JOIN reg USING (emp) WHERE abs(sheet.rate - reg.rate) > 0.01"),
    "PERSON_OUTSIDE_CONTRACT": ("BLOCKER", f"SELECT dossier_id, {EMP_MONTH} AS subject FROM sheet JOIN reg USING (emp) WHERE (month || '-01')::DATE < cs OR (month || '-01')::DATE > ce"),
    "PERSONNEL_COST_MISMATCH": ("BLOCKER", "SELECT dossier_id, 'PERSONNEL_COST_MISMATCH' AS subject FROM totals WHERE abs(rp - ts) > 0.01"),
    "EXTERNAL_COST_MISMATCH": ("BLOCKER", "SELECT dossier_id, 'EXTERNAL_COST_MISMATCH' AS subject FROM totals WHERE abs(re - it) > 0.01"),
    "CLAIMED_TOTAL_MISMATCH": ("BLOCKER", "SELECT dossier_id, 'claimed_total' AS subject FROM totals JOIN dossiers USING (dossier_id) WHERE abs(claimed - rt) > 0.01"),
    "CLAIM_ABOVE_CALL_MAXIMUM": ("BLOCKER", "SELECT dossier_id, 'call_maximum' AS subject FROM dossiers WHERE claimed > 1000020"),
    "INSUFFICIENT_EVIDENCE": ("BLOCKER", """
        SELECT dossier_id, kind AS subject FROM dossiers, (VALUES ('TECHNICAL_REPORT'), ('EXPENSE_INVOICE'), ('TIMESHEET')) v(kind) WHERE NOT EXISTS (SELECT 1 FROM docs x WHERE x.dossier_id = dossiers.dossier_id AND x.kind = v.kind AND status = 'EXTRACTED')
        UNION ALL SELECT dossier_id, 'report_personnel' FROM totals WHERE rp IS NULL AND EXISTS (SELECT 1 FROM docs x WHERE x.dossier_id = totals.dossier_id AND x.kind = 'TECHNICAL_REPORT' AND status = 'EXTRACTED')
        UNION ALL SELECT dossier_id, document_id || '|number' FROM inv WHERE number IS NULL
        UNION ALL SELECT dossier_id, 'timesheet.rows' FROM dossiers WHERE dossier_id NOT IN (SELECT dossier_id FROM sheet) AND dossier_id IN (SELECT dossier_id FROM docs WHERE kind = 'TIMESHEET' AND status = 'EXTRACTED')"""),
    "AMBIGUOUS_FIELD": ("BLOCKER", f"SELECT (user_id % {DOSSIERS})::VARCHAR AS dossier_id, user_id || '|day.' || ts::DATE AS subject FROM events GROUP BY 1, 2 HAVING count(DISTINCT event_type) > 1"),
}


def rows_sql(rule_id: str) -> str:
    severity, source = RULE_SQL[rule_id]
    return f"SELECT DISTINCT dossier_id, '{rule_id}' AS rule_id, '{severity}' AS severity, subject, sha256('{rule_id}|1.0.0|' || subject) AS fingerprint FROM ({source})"


COLUMNS = ["dossier_id", "rule_id", "severity", "subject", "fingerprint"]

for number, rule_id in enumerate(rules.RULES, 1):
    query(f"rul{number:02d}_{rule_id.lower()}", f"WITH {PRELUDE} {rows_sql(rule_id)}")(lambda t, rule_id=rule_id: rules.RULES[rule_id](context(t)).select(*COLUMNS).distinct())


@query("set02_all_rules", f"WITH {PRELUDE} SELECT rule_id, severity, count(*) AS n FROM ({' UNION ALL '.join(rows_sql(r) for r in RULE_SQL)}) GROUP BY 1, 2")
def _(t):
    return rules.evaluate(context(t)).groupBy("rule_id", "severity").agg(F.count("*").alias("n"))
