"""Workflow, reporting and evaluation over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import evaluation as V
from ..operators import relational as R
from ..operators import reporting as P
from ..operators import workflow as W
from ..session import shared_folder
from .registry import query
from .relational import UPSERT_SQL, finding_upsert

EDGES = {"view": ("view", "click"), "click": ("view", "purchase", "click"), "purchase": ("view",)}


@query("stm01_illegal_moves", """
WITH s AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, before, event_type FROM s WHERE before IS NOT NULL AND NOT coalesce((before = 'view' AND event_type IN ('view', 'click')) OR (before = 'click' AND event_type IN ('view', 'purchase', 'click')) OR (before = 'purchase' AND event_type = 'view'), false)""")
def _(t):
    return W.illegal_moves(t.events, "user_id", ["ts", "event_id"], "event_type", EDGES).select("event_id", "before", "event_type")


STATES = tuple(W.EDGES)


@query("stm01_allowed_table", f"""
SELECT o_orderkey, state, next, coalesce({' OR '.join(f"(state = '{a}' AND next IN ({', '.join(repr(b) for b in v)}))" for a, v in W.EDGES.items() if v)}, false) AS allowed
FROM (SELECT o_orderkey, list_extract({list(STATES)}, (o_orderkey % {len(STATES)})::INT + 1) AS state, list_extract({list(STATES)}, (o_orderkey // 7 % {len(STATES)})::INT + 1) AS next FROM orders)""")
def _(t):
    """Whether the table of moves lets each order go from one state to another."""
    states = F.array(*[F.lit(s) for s in STATES])
    at = lambda c: F.get(states, c.cast("int"))
    moves = t.orders.select("o_orderkey", at(F.col("o_orderkey") % len(STATES)).alias("state"), at(F.floor(F.col("o_orderkey") / 7) % len(STATES)).alias("next"))
    return moves.select("*", F.coalesce(W.allowed(F.col("state"), F.col("next")), F.lit(False)).alias("allowed"))


@query("stm02_compare_and_set", """
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'APPROVED' ELSE 'NEEDS_REVIEW' END AS status, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS version, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 2 = 0 END AS moved FROM orders""")
def _(t):
    k = F.col("o_orderkey")
    snapshot = t.orders.select(k.alias("k"), F.lit("NEEDS_REVIEW").alias("status"), F.lit(1).cast("long").alias("version"))
    requests = t.orders.where(k % 3 == 0).select(k.alias("k"), F.when(k % 2 == 0, 1).otherwise(9).cast("long").alias("version"), F.lit("APPROVED").alias("to"))
    return W.transition(snapshot, requests, "k")


@query("stm03_approval_gate", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus IN ('O', 'P')) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def _(t):
    o = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    findings = o.select("c_custkey", F.when(F.col("o_orderpriority") == "1-URGENT", "BLOCKER").otherwise("INFO").alias("severity"), F.when(F.col("o_orderstatus") == "F", "RESOLVED").otherwise("OPEN").alias("status"))
    fields = o.select("c_custkey", F.when(F.col("o_totalprice") > 300000, "NEEDS_REVIEW").otherwise("EXTRACTED").alias("status"))
    return W.approvable(t.customer.select("c_custkey"), findings, fields, "c_custkey")


@query("ups01_extractions", """
SELECT coalesce(e.k, p.k) AS k, CASE WHEN e.s IN ('CORRECTED', 'CONFIRMED') OR p.k IS NULL THEN e.v ELSE p.v END AS value, CASE WHEN e.s IN ('CORRECTED', 'CONFIRMED') OR p.k IS NULL THEN e.s ELSE 'EXTRACTED' END AS status
FROM (SELECT o_orderkey AS k, 'old' AS v, CASE o_orderkey % 3 WHEN 0 THEN 'CORRECTED' WHEN 1 THEN 'CONFIRMED' ELSE 'EXTRACTED' END AS s FROM orders WHERE o_orderkey % 5 <> 0) e FULL JOIN (SELECT o_orderkey AS k, 'new' AS v FROM orders WHERE o_orderkey % 2 = 0) p ON e.k = p.k""")
def _(t):
    k = F.col("o_orderkey")
    old = t.orders.where(k % 5 != 0).select(k.alias("k"), F.lit("old").alias("value"), F.when(k % 3 == 0, "CORRECTED").when(k % 3 == 1, "CONFIRMED").otherwise("EXTRACTED").alias("status"))
    new = t.orders.where(k % 2 == 0).select(k.alias("k"), F.lit("new").alias("value"), F.lit("EXTRACTED").alias("status"))
    return W.upsert_extractions(old, new, "k")


@query("ups02_chunks", "SELECT doc_id, md5(text) AS text, doc_id % 3 = 0 AND doc_id % 5 <> 0 AS kept_vector FROM documents WHERE doc_id % 2 = 0")
def _(t):
    k = F.col("doc_id")
    old = t.documents.where(k % 3 == 0).select("doc_id", F.when(k % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text"), F.array(F.lit(1.0)).alias("embedding"))
    out = W.upsert_chunks(old, t.documents.where(k % 2 == 0).select("doc_id", "text"), ["doc_id"])
    return out.select("doc_id", F.md5("text").alias("text"), F.col("embedding").isNotNull().alias("kept_vector"))


@query("ups03_finding_upsert", UPSERT_SQL)
def _(t):


    return finding_upsert(t)


@query("ups04_intake", """
SELECT min(doc_id) AS doc_id, list_filter(list_sort(list(DISTINCT 'f' || doc_id)), lambda x: x <> 'f' || min_id) AS alternates FROM (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS min_id FROM documents) GROUP BY text, min_id""")
def _(t):
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("sha"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("name"))
    return W.intake(d, ["sha"], [F.col("doc_id")], "name").select("doc_id", "alternates")


@query("ups05_idempotency", """
SELECT event_id, CASE WHEN n = 1 THEN 'RESERVED' WHEN event_type = f THEN 'REPLAYED' ELSE 'CONFLICT' END AS outcome FROM (SELECT event_id, event_type, row_number() OVER w AS n, first_value(event_type) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id))""")
def _(t):
    e = t.events.withColumn("day", F.to_date("ts"))
    return W.idempotent(e, ["user_id", "day"], [F.col("ts"), F.col("event_id")], "event_type").select("event_id", "outcome")


DECISIONS = """d AS (SELECT event_id, user_id AS k, CASE event_type WHEN 'click' THEN 'CORRECT' WHEN 'view' THEN 'CONFIRM' ELSE 'OTHER' END AS action, 'v' || event_id AS new_value FROM events)"""


@query("rev01_fold_decisions", f"""
WITH {DECISIONS}, x AS (SELECT DISTINCT k FROM d),
l AS (SELECT k, max_by(action, event_id) AS last, max_by(new_value, event_id) FILTER (action = 'CORRECT') AS fix, count(*) AS n FROM d GROUP BY 1)
SELECT k, coalesce(fix, 'read') AS value, CASE WHEN fix IS NOT NULL THEN 'read' END AS original, CASE last WHEN 'CORRECT' THEN 'CORRECTED' WHEN 'CONFIRM' THEN 'CONFIRMED' ELSE 'EXTRACTED' END AS status, CASE WHEN fix IS NOT NULL THEN 1.0 ELSE 0.9 END::DOUBLE AS confidence, n AS revision FROM x JOIN l USING (k)""")
def _(t):
    action = F.when(F.col("event_type") == "click", "CORRECT").when(F.col("event_type") == "view", "CONFIRM").otherwise("OTHER")
    d = t.events.select(F.col("user_id").alias("k"), "event_id", action.alias("action"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("new_value"))
    x = t.events.select(F.col("user_id").alias("k")).distinct().select("k", F.lit("read").alias("value"), F.lit("EXTRACTED").alias("status"), F.lit(0.9).alias("confidence"))
    return W.fold_decisions(x, d, "k", "event_id")


@query("rev02_resolutions", """
WITH d AS (SELECT user_id AS k, event_id, CASE event_type WHEN 'click' THEN 'ACCEPT' ELSE 'DISMISS' END AS action FROM events WHERE event_id % 4 <> 0)
SELECT u.k, CASE max_by(action, event_id) WHEN 'ACCEPT' THEN 'ACCEPTED' WHEN 'DISMISS' THEN 'DISMISSED' ELSE 'OPEN' END AS status FROM (SELECT DISTINCT user_id AS k FROM events) u LEFT JOIN d USING (k) GROUP BY 1""")
def _(t):
    e = F.col("event_id")
    d = t.events.select(F.col("user_id").alias("k"), "event_id", F.when(F.col("event_type") == "click", "ACCEPT").otherwise("DISMISS").alias("action"), F.when(e % 4 != 0, "why").otherwise(" ").alias("reason"))
    f = t.events.select(F.col("user_id").alias("k")).distinct().withColumn("status", F.lit("OPEN"))
    return W.resolve_findings(f, d, "k", "event_id")


@query("job01_enqueue", "SELECT o_custkey, o_orderdate::DATE AS day, min(o_orderkey) AS job FROM orders GROUP BY 1, 2")
def _(t):
    j = t.orders.withColumn("day", F.to_date("o_orderdate"))
    return W.enqueue(j, ["o_custkey", "day"], [F.col("o_orderkey")]).select("o_custkey", "day", F.col("o_orderkey").alias("job"))


JOBS = """j AS (SELECT o_orderkey AS job, CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'RUNNING' ELSE 'SUCCEEDED' END AS status, o_orderkey % 5 AS attempts, o_orderdate AS available_at, o_orderdate + INTERVAL 120 SECOND AS leased_until FROM orders)"""


def jobs(t):
    status = F.when(F.col("o_orderstatus") == "O", "PENDING").when(F.col("o_orderstatus") == "P", "RUNNING").otherwise("SUCCEEDED")
    at = F.col("o_orderdate")
    return t.orders.select(F.col("o_orderkey").alias("job"), status.alias("status"), (F.col("o_orderkey") % 5).alias("attempts"), at.alias("available_at"), (at + F.expr("INTERVAL 120 SECONDS")).alias("leased_until"), (F.col("o_orderkey") % 7).alias("leased_by"))


NOW = "1998-01-01"


@query("job02_claim", f"WITH {JOBS} SELECT job FROM j WHERE status = 'PENDING' AND available_at <= TIMESTAMP '{NOW}' ORDER BY available_at, job LIMIT 10")
def _(t):
    return W.claimable(jobs(t), F.lit(NOW).cast("timestamp"), 10, [F.col("available_at"), F.col("job")]).select("job")


@query("job03_fenced_heartbeat", f"WITH {JOBS} SELECT job, CASE WHEN status = 'RUNNING' AND job % 7 = job % 3 THEN greatest(leased_until, TIMESTAMP '{NOW}' + INTERVAL 120 SECOND) ELSE leased_until END AS leased_until FROM j")
def _(t):
    beats = t.orders.select(F.col("o_orderkey").alias("job"), (F.col("o_orderkey") % 3).alias("worker"), F.lit(NOW).cast("timestamp").alias("at"))
    return W.fenced(jobs(t), beats, "job").select("job", "leased_until")


@query("job04_after_failure", f"""WITH {JOBS} SELECT job, CASE WHEN status <> 'RUNNING' THEN status WHEN job % 2 = 0 AND attempts < 3 THEN 'PENDING' WHEN job % 2 = 0 THEN 'DEAD_LETTER' ELSE 'FAILED' END AS status,
CASE WHEN status = 'RUNNING' AND job % 2 = 0 AND attempts < 3 THEN (5 * 2.0 ** (attempts - 1))::DECIMAL(18,1)::DOUBLE END AS wait FROM j WHERE attempts > 0""")
def _(t):
    n = W.after_failure(F.col("status"), F.col("job") % 2 == 0, F.col("attempts"))
    return jobs(t).where("attempts > 0").select("job", n["status"].alias("status"), n["wait"].cast("double").alias("wait"))


@query("job05_reclaim", f"WITH {JOBS} SELECT job, CASE WHEN attempts >= 3 THEN 'DEAD_LETTER' ELSE 'PENDING' END AS status FROM j WHERE status = 'RUNNING' AND leased_until < TIMESTAMP '{NOW}'")
def _(t):
    return W.reclaim(jobs(t), F.lit(NOW).cast("timestamp")).select("job", "status")


# reporting


GROUPS = (("report.title", "Memoria técnica"), ("invoice.number", "Facturas y justificantes"), ("invoices.count", "Totales de facturas"), ("timesheet.rows[#].hours", "Parte horario"), ("timesheet.row_count", "Totales del parte horario"), ("registry.personnel[EMP-#].role", "Registro de personal"), ("call.code", "Convocatoria"), ("zzz", "Otros"))


@query("rep02_groups", f"""
SELECT replace(list_extract({[p for p, _ in GROUPS]}, (p_partkey % {len(GROUPS)})::INT + 1), '#', p_partkey::VARCHAR) AS path, list_extract({[g for _, g in GROUPS]}, (p_partkey % {len(GROUPS)})::INT + 1) AS title FROM part""")
def _(t):
    paths = F.array(*[F.lit(p) for p, _ in GROUPS])
    rows = t.part.select(F.replace(F.get(paths, (F.col("p_partkey") % len(GROUPS)).cast("int")), F.lit("#"), F.col("p_partkey").cast("string")).alias("path"))
    return rows.select("path", P.group_of(F.col("path")).alias("title"))


@query("srt04_reading_order", """
SELECT path, row_number() OVER (ORDER BY n, k)::INT AS place FROM (SELECT 'timesheet.rows[' || s_suppkey || '].' || k AS path, s_suppkey AS n, CASE k WHEN 'month' THEN 1 WHEN 'hours' THEN 2 ELSE 3 END AS k FROM (SELECT s_suppkey, unnest(['hours', 'month', 'zzz']) AS k FROM supplier))""")
def _(t):
    rows = t.supplier.select(F.explode(F.transform(F.array(F.lit("hours"), F.lit("month"), F.lit("zzz")), lambda k: F.concat(F.lit("timesheet.rows["), F.col("s_suppkey").cast("string"), F.lit("]."), k))).alias("path"))
    return R.dense_index(rows.withColumn("_g", F.lit(1)), ["_g"], [P.sort_key(F.col("path"))], "p").select("path", (F.col("p") + 1).alias("place"))


@query("rep03_link_labels", "SELECT o_orderkey, CASE WHEN count(*) OVER (PARTITION BY o_custkey, o_orderpriority) > 1 THEN o_orderpriority || ' · ' || o_orderkey ELSE o_orderpriority END AS shown FROM orders")
def _(t):
    return P.link_labels(t.orders, "o_custkey", "o_orderpriority", F.col("o_orderkey").cast("string")).select("o_orderkey", "shown")


@query("rep04_locators", """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'página 3' WHEN 1 THEN 'página 3, recuadro B7' WHEN 2 THEN 'hoja «3», celda B7' WHEN 3 THEN 'registro 3, B7' WHEN 4 THEN 'selector 3' ELSE 'calculado: 3' END AS line FROM orders""")
def _(t):
    kinds = F.array(*[F.lit(k) for k in P.LOCATOR_FIELDS])
    kind = F.get(kinds, (F.col("o_orderkey") % 6).cast("int"))
    return t.orders.select("o_orderkey", P.describe(kind, F.lit("3"), F.lit("B7")).alias("line"))


@query("rep05_labels", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Abierta' WHEN 'F' THEN 'Resuelta' ELSE o_orderstatus END AS label FROM orders")
def _(t):
    from ..functions.text import label_of

    code = F.when(F.col("o_orderstatus") == "O", "OPEN").when(F.col("o_orderstatus") == "F", "RESOLVED").otherwise(F.col("o_orderstatus"))
    return t.orders.select("o_orderkey", label_of(code, P.STATUS_LABELS).alias("label"))


@query("join12_concept_table", """
SELECT o_orderkey, concept, declared::DOUBLE AS declared, supported::DOUBLE AS supported, CASE WHEN declared IS NULL OR supported IS NULL THEN 'incompleto' WHEN declared = supported THEN 'cuadra' ELSE 'descuadre' END AS state FROM (
SELECT o_orderkey, unnest(['total', 'lines']) AS concept, unnest([o_totalprice::DECIMAL(18,4), 4]) AS declared, unnest([NULL, n]) AS supported FROM orders LEFT JOIN (SELECT l_orderkey, count(*)::DECIMAL(18,4) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)""")
def _(t):
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").cast("decimal(18,4)").alias("n"))
    d = lambda c: c.cast("decimal(18,4)")
    rows = F.array(F.struct(F.lit("total").alias("concept"), d(F.col("o_totalprice")).alias("declared"), d(F.lit(None)).alias("supported")), F.struct(F.lit("lines").alias("concept"), d(F.lit(4)).alias("declared"), d(F.col("n")).alias("supported")))
    tall = t.orders.join(n, "o_orderkey", "left").select("o_orderkey", F.inline(rows)).withColumn("k", F.struct("o_orderkey", "concept"))
    out = R.reconcile(tall.select("k", "declared"), tall.select("k", "supported"), "k")
    return out.select("k.o_orderkey", "k.concept", F.col("declared").cast("double").alias("declared"), F.col("supported").cast("double").alias("supported"), "state")


@query("snk02_csv_cells", "SELECT c_name AS field_path, CASE WHEN c_acctbal < 0 THEN '''' || c_acctbal::DECIMAL(14,2) ELSE c_acctbal::DECIMAL(14,2)::VARCHAR END AS value, c_mktsegment AS status FROM customer")
def _(t):
    return P.csv_rows(t.customer.select(F.col("c_name").alias("field_path"), F.col("c_acctbal").cast("decimal(14,2)").alias("value"), F.col("c_mktsegment").alias("status")))


@query("snk04_nested_json", """
SELECT c_custkey, '{"c_custkey":' || c_custkey || CASE WHEN n IS NULL THEN '' ELSE ',"orders":[' || n || ']' END || '}' AS json FROM customer LEFT JOIN (SELECT o_custkey, string_agg('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def _(t):
    return P.nested_json(t.customer.select("c_custkey"), "c_custkey", {"orders": (t.orders.select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey")})


@query("snk05_html_report", """
WITH h AS (SELECT '<!DOCTYPE html><html lang="es"><head><meta charset="utf-8"><title>Países</title></head><body><h1>Países</h1><table><tr><th>n_nationkey</th><th>n_name</th><th>n_regionkey</th></tr>'
|| string_agg('<tr><td>' || n_nationkey || '</td><td>' || n_name || '</td><td>' || n_regionkey || '</td></tr>', '' ORDER BY n_nationkey) || '</table></body></html>' AS html FROM nation)
SELECT length(html)::INT AS size, sha256(html) AS digest FROM h""")
def _(t):
    page = P.html_table(t.nation.orderBy("n_nationkey"), "Países")
    return t.spark.createDataFrame([(page, len(page))], "html string, size int").select("size", F.sha2("html", 256).alias("digest"))


@query("snk07_metrics_text", "SELECT string_agg('events_total{event_type=\"' || event_type || '\"} ' || n, chr(10) ORDER BY event_type) AS text FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def _(t):
    return P.metrics_text(t.events.groupBy("event_type").agg(F.count("*").alias("n")), "events_total", "event_type", "n")


# evaluation


@query("evl01_field_accuracy", "SELECT o_orderkey AS k, o_orderkey % 4 <> 3 AS correct FROM orders")
def _(t):
    k = F.col("o_orderkey")
    amount = F.col("o_totalprice").cast("decimal(14,2)")
    day = F.to_date("o_orderdate").cast("string")
    truth = F.when(k % 4 == 0, amount.cast("string")).when(k % 4 == 1, day).otherwise("Some Text")
    found = F.when(k % 4 == 0, amount.cast("decimal(18,4)").cast("string")).when(k % 4 == 1, day).when(k % 4 == 2, " some text ")
    return V.field_accuracy(t.orders.select(k.alias("k"), truth.alias("value")), t.orders.select(k.alias("k"), found.alias("value")), ["k"])


@query("agg15_precision_recall", """
WITH t AS (SELECT doc_id FROM labels WHERE toxic = 1), p AS (SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'idiot|stupid|moron|loser|scum|trash|pathetic|worthless|disgusting|clown') AND doc_id IN (SELECT doc_id FROM labels)),
n AS (SELECT (SELECT count(*) FROM t WHERE doc_id IN (SELECT * FROM p)) AS tp, (SELECT count(*) FROM p WHERE doc_id NOT IN (SELECT * FROM t)) AS fp, (SELECT count(*) FROM t WHERE doc_id NOT IN (SELECT * FROM p)) AS fn)
SELECT tp, fp, fn, round(tp / (tp + fp), 6)::DOUBLE AS precision, round(tp / (tp + fn), 6)::DOUBLE AS recall FROM n""")
def _(t):
    truth = t.labels.where("toxic = 1").select("doc_id")
    words = "idiot|stupid|moron|loser|scum|trash|pathetic|worthless|disgusting|clown"
    predicted = t.documents.where(F.lower("text").rlike(words)).join(t.labels.select("doc_id"), "doc_id", "left_semi")
    return V.precision_recall(truth, predicted, "doc_id")


@query("evl02_receipts", "SELECT 'n' || o_orderkey AS number, CASE WHEN o_orderkey % 3 = 0 THEN 'name' ELSE 'number' END AS found_by, o_orderkey % 5 <> 0 AS correct FROM orders")
def _(t):
    k = F.col("o_orderkey")
    number, name = F.concat(F.lit("n"), k.cast("string")), F.concat(F.lit("f"), k.cast("string"))
    truth = t.orders.select(number.alias("number"), name.alias("file_name"), k.alias("total"))
    found = t.orders.select(F.when(k % 3 != 0, number).alias("number"), name.alias("file_name"), (k + F.when(k % 5 == 0, 1).otherwise(0)).alias("total"))
    return V.receipt_scores(truth, found)


@query("evl03_replay_equality", "SELECT true AS equal, count(*) AS n FROM orders")
def _(t):
    a = R.content_digest(t.orders)
    b = R.content_digest(t.orders.repartition(3, "o_custkey")).withColumnRenamed("digest", "again").drop("n")
    return a.crossJoin(b).select((F.col("digest") == F.col("again")).alias("equal"), "n")


@query("evl04_withheld", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'WITHHELD' ELSE 'q' || quality END AS verdict FROM labels")
def _(t):
    s = t.labels.select("doc_id", (F.col("doc_id") % 3 != 0).alias("complete"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("v"))
    return V.verdicts(s, "complete", "v").select("doc_id", "verdict")


@query("snk08_audit_append", "SELECT event_id, ts, event_type AS action, user_id::VARCHAR AS actor FROM events")
def _(t):
    """Two appends to one log, read back."""
    path = f"{shared_folder(t.spark)}/audit/{uuid.uuid4().hex}"
    rows = t.events.select("event_id", "ts", F.col("event_type").alias("action"), F.col("user_id").cast("string").alias("actor"))
    for part in (rows.where("event_type = 'view'"), rows.where("event_type != 'view'")):
        P.append_audit(part, path)
    return t.spark.read.schema(rows.schema).parquet(path)
