"""Filters, joins, aggregations, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from .registry import query


def dec(c):
    return F.col(c).cast("decimal(18,4)")


NET = "(l_extendedprice::DECIMAL(18,4) * (1 - l_discount::DECIMAL(18,4)))::DECIMAL(24,4)"


def net():
    return (dec("l_extendedprice") * (F.lit(1).cast("decimal(18,4)") - dec("l_discount"))).cast("decimal(24,4)")


# filters


@query("flt01_optional_filters", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def _(t):
    return R.given(t.orders, o_orderstatus="F", o_orderpriority="1-URGENT", o_custkey=None).select("o_orderkey", "o_orderstatus")


@query("flt02_prefix", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'STANDARD%'")
def _(t):
    return t.part.where(F.col("p_type").startswith("STANDARD")).select("p_partkey", "p_type")


@query("flt03_sets", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'purchase') AND event_type NOT IN ('view') GROUP BY 1")
def _(t):
    e = F.col("event_type")
    return t.events.where(e.isin("click", "view", "purchase") & ~e.isin("view")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("flt04_not_rejected", "SELECT l_shipdate::DATE AS day, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag <> 'R' GROUP BY 1")
def _(t):
    return t.lineitem.where("l_linestatus = 'O' and l_returnflag != 'R'").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("n"))


@query("flt05_readable_documents", "SELECT lang, count(*) AS n FROM documents WHERE n_chars > 0 AND text IS NOT NULL AND lang IN ('es', 'en') GROUP BY 1")
def _(t):
    return t.documents.where("n_chars > 0 and text is not null and lang in ('es', 'en')").groupBy("lang").agg(F.count("*").alias("n"))


@query("flt06_indexed_path", "SELECT l_linenumber::INT AS row_no, l_returnflag AS suffix, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(t):
    path = F.concat(F.lit("timesheet.rows["), F.col("l_linenumber").cast("string"), F.lit("]."), "l_returnflag")
    shape = r"^timesheet\.rows\[(\d+)\]\.(\w+)$"
    return t.lineitem.select(F.regexp_extract(path, shape, 1).cast("int").alias("row_no"), F.regexp_extract(path, shape, 2).alias("suffix")).groupBy("row_no", "suffix").agg(F.count("*").alias("n"))


@query("flt07_hostile_exclusion", "SELECT source, count(*) AS quotable, (SELECT count(*) FROM documents d2 WHERE d2.source = d.source AND d2.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS withheld FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1")
def _(t):
    flagged = t.labels.where("toxic = 1").select("doc_id").distinct().withColumn("flagged", F.lit(True))
    d = t.documents.select("doc_id", "source").join(flagged, "doc_id", "left")
    return d.groupBy("source").agg(F.count_if(F.col("flagged").isNull()).alias("quotable"), F.count_if("flagged").alias("withheld")).where("quotable > 0")


@query("flt09_vector_guard", "SELECT label, count(*) AS n FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64 GROUP BY 1")
def _(t):
    return t.embeddings.where(F.col("embedding").isNotNull() & (F.size("embedding") == 64)).groupBy("label").agg(F.count("*").alias("n"))


@query("flt11_reference_shape", "SELECT o_orderkey, upper(trim(' inn-2025-' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') || ' ')) AS reference, regexp_matches(upper(trim(' inn-2025-' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') || ' ')), '^INN-\\d{4}-\\d{3}$') AS valid FROM orders")
def _(t):
    raw = F.concat(F.lit(" inn-2025-"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), F.lit(" "))
    ref = F.upper(F.trim(raw))
    return t.orders.select("o_orderkey", ref.alias("reference"), ref.rlike(r"^INN-\d{4}-\d{3}$").alias("valid"))


@query("flt13_accepts_documents", "SELECT o_orderstatus, o_orderstatus IN ('O', 'P') AS accepts, count(*) AS n FROM orders GROUP BY 1, 2")
def _(t):
    return t.orders.groupBy("o_orderstatus", F.col("o_orderstatus").isin("O", "P").alias("accepts")).agg(F.count("*").alias("n"))


# joins


@query("join01_inner", "SELECT l_orderkey, l_linenumber, l_partkey, p_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 45")
def _(t):
    return t.lineitem.where("l_quantity > 45").join(t.part, F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", "p_name")


@query("join02_left_fallback", "SELECT o_orderkey, coalesce(c_name, o_custkey::VARCHAR) AS shown FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey")
def _(t):
    c = t.customer.where("c_acctbal > 0")
    return t.orders.join(c, F.col("c_custkey") == F.col("o_custkey"), "left").select("o_orderkey", F.coalesce("c_name", F.col("o_custkey").cast("string")).alias("shown"))


@query("join03_left_dimension", "SELECT n_name, count(*) AS n, count(c_custkey) AS with_customer FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def _(t):
    return t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count("*").alias("n"), F.count("c_custkey").alias("with_customer"))


@query("join04_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def _(t):
    return R.unmatched(t.orders, t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey")


@query("join05_theta", """
SELECT l_returnflag, count(*) AS differing FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE abs(l_extendedprice::DECIMAL(18,4) - (l_quantity::DECIMAL(10,2) * p_retailprice::DECIMAL(12,2))::DECIMAL(22,4)) > 0.01 GROUP BY 1""")
def _(t):
    claimed = (F.col("l_quantity").cast("decimal(10,2)") * F.col("p_retailprice").cast("decimal(12,2)")).cast("decimal(22,4)")
    j = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return j.where(F.abs(dec("l_extendedprice") - claimed) > 0.01).groupBy("l_returnflag").agg(F.count("*").alias("differing"))


@query("join06_interval", "SELECT o_orderpriority, count(*) AS outside FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE NOT (l_shipdate >= o_orderdate AND (o_orderstatus = 'O' OR l_shipdate <= o_orderdate + INTERVAL 60 DAY)) GROUP BY 1")
def _(t):
    j = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    end = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS"))
    return R.outside_interval(j, F.col("l_shipdate"), F.col("o_orderdate"), end).groupBy("o_orderpriority").agg(F.count("*").alias("outside"))


@query("join07_intersection", """
WITH w AS (SELECT min(o_orderdate)::DATE + 100 AS ws, max(o_orderdate)::DATE - 100 AS we FROM orders)
SELECT c_custkey, greatest(min(o_orderdate)::DATE, any_value(ws)) AS starts, least(max(o_orderdate)::DATE, any_value(we)) AS ends FROM orders JOIN customer ON c_custkey = o_custkey, w GROUP BY 1""")
def _(t):
    o = t.orders.select("o_custkey", F.to_date("o_orderdate").alias("d"))
    window = o.agg(F.date_add(F.min("d"), 100).alias("ws"), F.date_sub(F.max("d"), 100).alias("we"))
    spans = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("d").alias("s"), F.max("d").alias("e"))
    start, end = R.intersection(F.col("s"), F.col("e"), F.col("ws"), F.col("we"))
    return spans.join(F.broadcast(window), F.lit(True)).select("c_custkey", start.alias("starts"), end.alias("ends"))


@query("join08_repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("join09_declared_computed", f"""
WITH s AS (SELECT l_orderkey, sum({NET}) AS supported FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_totalprice::DECIMAL(18,4)::DOUBLE AS declared, supported::DOUBLE AS computed, abs(o_totalprice::DECIMAL(18,4) - supported)::DOUBLE AS gap FROM orders JOIN s ON l_orderkey = o_orderkey WHERE abs(o_totalprice::DECIMAL(18,4) - supported) > 0.01""")
def _(t):
    s = t.lineitem.groupBy("l_orderkey").agg(F.sum(net()).alias("supported"))
    j = t.orders.join(s, F.col("l_orderkey") == F.col("o_orderkey"))
    gap = F.abs(dec("o_totalprice") - F.col("supported"))
    return j.where(gap > 0.01).select("o_orderkey", dec("o_totalprice").cast("double").alias("declared"), F.col("supported").cast("double").alias("computed"), gap.cast("double").alias("gap"))


UPSERT_SQL = """
WITH p AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_totalprice > 150000),
e AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'ACCEPTED' WHEN o_orderkey % 4 = 1 THEN 'RESOLVED' WHEN o_orderkey % 7 = 2 THEN 'DISMISSED' ELSE 'OPEN' END AS before FROM orders WHERE o_orderkey % 3 <> 0),
b AS (SELECT coalesce(p.k, e.k) AS k, p.k IS NOT NULL AS seen, before FROM p FULL JOIN e ON p.k = e.k)
SELECT k, before, CASE WHEN before IS NULL THEN 'OPEN' WHEN before IN ('ACCEPTED', 'DISMISSED') THEN before WHEN seen THEN 'OPEN' ELSE 'RESOLVED' END AS after,
CASE WHEN before IS NULL THEN 'CREATED' WHEN seen AND before = 'RESOLVED' THEN 'REOPENED' WHEN seen THEN 'REFRESHED' WHEN before = 'OPEN' THEN 'AUTO_RESOLVED' ELSE 'KEPT' END AS action FROM b"""


def finding_upsert(t):
    k = F.col("o_orderkey")
    produced = t.orders.where("o_totalprice > 150000").select(k.alias("k"))
    status = F.when(k % 4 == 0, "ACCEPTED").when(k % 4 == 1, "RESOLVED").when(k % 7 == 2, "DISMISSED").otherwise("OPEN")
    existing = t.orders.where(k % 3 != 0).select(k.alias("k"), status.alias("status"))
    return R.upsert(produced, existing, "k")


@query("join10_full_outer_upsert", UPSERT_SQL)
def _(t):
    return finding_upsert(t)


@query("join11_pending", "SELECT doc_id, CASE WHEN text IS NULL THEN 'gone' WHEN o IS NULL THEN 'new' WHEN o <> sha256(text) THEN 'changed' END AS why FROM documents LEFT JOIN (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '.' ELSE text END) AS o FROM documents WHERE doc_id % 3 <> 0) USING (doc_id) WHERE o IS NULL OR o <> sha256(text)")
def _(t):
    text = F.col("text")
    stored = t.documents.where("doc_id % 3 != 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat(text, F.lit("."))).otherwise(text), 256).alias("o"))
    j = t.documents.join(stored, "doc_id", "left")
    why = F.when(text.isNull(), "gone").when(F.col("o").isNull(), "new").when(F.col("o") != F.sha2(text, 256), "changed")
    return j.where(F.col("o").isNull() | (F.col("o") != F.sha2(text, 256))).select("doc_id", why.alias("why"))


@query("join13_array_keys", "SELECT g, list(n_name ORDER BY n_name) AS names FROM (SELECT n_regionkey AS g, unnest(list(n_nationkey)) AS k FROM nation GROUP BY 1) JOIN nation ON n_nationkey = k GROUP BY 1")
def _(t):
    held = t.nation.groupBy(F.col("n_regionkey").alias("g")).agg(F.collect_list("n_nationkey").alias("ks"))
    j = held.select("g", F.explode("ks").alias("k")).join(t.nation, F.col("n_nationkey") == F.col("k"))
    return j.groupBy("g").agg(F.array_sort(F.collect_list("n_name")).alias("names"))


@query("join14_lineage", "SELECT r_regionkey, count(*)::BIGINT AS inputs, sum(c_custkey)::BIGINT AS ids FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def _(t):
    derived = t.customer.groupBy("c_nationkey").agg(F.collect_list("c_custkey").alias("inputs"))
    upper = t.nation.join(derived, F.col("c_nationkey") == F.col("n_nationkey"))
    leaves = upper.select("n_regionkey", F.explode("inputs").alias("c"))
    return t.region.join(leaves, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey").agg(F.count("*").alias("inputs"), F.sum("c").alias("ids"))


@query("join15_fallback_match", """
SELECT p_partkey, coalesce(s1.s_suppkey, s2.s_suppkey) AS supplier, CASE WHEN s1.s_suppkey IS NOT NULL THEN 'number' WHEN s2.s_suppkey IS NOT NULL THEN 'size' END AS found_by
FROM part LEFT JOIN supplier s1 ON s1.s_suppkey = p_partkey LEFT JOIN supplier s2 ON s2.s_suppkey = p_size""")
def _(t):
    s1, s2 = t.supplier.select(F.col("s_suppkey").alias("k1")), t.supplier.select(F.col("s_suppkey").alias("k2"))
    j = t.part.join(s1, F.col("k1") == F.col("p_partkey"), "left").join(s2, F.col("k2") == F.col("p_size"), "left")
    return j.select("p_partkey", F.coalesce("k1", "k2").alias("supplier"), F.when(F.col("k1").isNotNull(), "number").when(F.col("k2").isNotNull(), "size").alias("found_by"))


@query("join16_set_difference", "SELECT doc_id, 'missed' AS side FROM (SELECT doc_id FROM labels WHERE toxic = 1 EXCEPT SELECT doc_id FROM labels WHERE quality = 0) UNION ALL SELECT doc_id, 'unexpected' FROM (SELECT doc_id FROM labels WHERE quality = 0 EXCEPT SELECT doc_id FROM labels WHERE toxic = 1)")
def _(t):
    return R.both_differences(t.labels.where("toxic = 1"), t.labels.where("quality = 0"), "doc_id")


# aggregations


@query("agg01_sum_with_lineage", f"SELECT l_orderkey, sum({NET})::DOUBLE AS total, count(*) AS n, list(l_linenumber ORDER BY l_linenumber) AS inputs, min(l_discount) AS confidence FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1")
def _(t):
    out = R.sum_with_lineage(t.lineitem.where("l_returnflag != 'R'"), ["l_orderkey"], net(), "l_linenumber", F.col("l_discount"))
    return out.withColumn("total", F.col("total").cast("double"))


@query("agg02_count_with_lineage", "SELECT o_custkey, count(*) AS n, list(o_orderkey ORDER BY o_orderkey) AS inputs FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("o_orderkey")).alias("inputs"))


@query("agg03_annual_ceiling", "SELECT user_id, year(ts)::INT AS year, sum(value::DECIMAL(16,4))::DOUBLE AS hours FROM events WHERE value > 0 GROUP BY 1, 2 HAVING sum(value::DECIMAL(16,4)) > 3000")
def _(t):
    v = F.col("value").cast("decimal(16,4)")
    out = t.events.where("value > 0").groupBy("user_id", F.year("ts").alias("year")).agg(F.sum(v).alias("hours")).where("hours > 3000")
    return out.withColumn("hours", F.col("hours").cast("double"))


@query("agg04_mean_confidence", "SELECT user_id, (coalesce(sum(CASE WHEN value >= 20 THEN value::DECIMAL(16,4) END)::DOUBLE / count(CASE WHEN value >= 20 THEN 1 END), 0))::DECIMAL(16,6)::DOUBLE AS mean FROM events GROUP BY 1")
def _(t):
    used = F.when(F.col("value") >= 20, F.col("value").cast("decimal(16,4)"))
    return t.events.groupBy("user_id").agg(F.coalesce(F.sum(used).cast("double") / F.count(used), F.lit(0.0)).cast("decimal(16,6)").cast("double").alias("mean"))


@query("agg05_box_union", "SELECT l_orderkey, min(l_linenumber)::INT AS left_edge, (max(l_linenumber + l_quantity) - min(l_linenumber))::DOUBLE AS width FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("left_edge"), (F.max(F.col("l_linenumber") + F.col("l_quantity")) - F.min("l_linenumber")).alias("width"))


@query("agg06_ambiguous", "SELECT user_id, ts::DATE AS day, count(DISTINCT event_type)::INT AS readings FROM events GROUP BY 1, 2 HAVING count(DISTINCT event_type) > 1")
def _(t):
    e = t.events.withColumn("day", F.to_date("ts"))
    return R.ambiguous(e, ["user_id", "day"], ["event_type"]).drop("sample")


@query("agg07_conditional_counts", "SELECT o_orderpriority, count(*) AS n, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS open_n, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS closed_n FROM orders GROUP BY 1")
def _(t):
    s = F.col("o_orderstatus")
    return t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(s == "O").alias("open_n"), F.count_if(s == "F").alias("closed_n"))


@query("agg07_rollup", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def _(t):
    return t.orders.rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("agg08_accepted_refused", "SELECT source, count(CASE WHEN n_chars >= 1000 THEN 1 END) AS accepted, count(CASE WHEN n_chars < 1000 THEN 1 END) AS refused FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy("source").agg(F.count_if(F.col("n_chars") >= 1000).alias("accepted"), F.count_if(F.col("n_chars") < 1000).alias("refused"))


@query("agg09_table_counts", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("orders", "lineitem", "events", "documents")))
def _(t):
    one = [getattr(t, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("orders", "lineitem", "events", "documents")]
    return one[0].unionByName(one[1]).unionByName(one[2]).unionByName(one[3])


@query("agg10_configurations", "SELECT sha256('d64|' || label) AS config, count(*) AS n FROM embeddings GROUP BY 1")
def _(t):
    return t.embeddings.groupBy(F.sha2(F.concat(F.lit("d64|"), F.col("label").cast("string")), 256).alias("config")).agg(F.count("*").alias("n"))


@query("agg11_rolling_budget", "SELECT count(CASE WHEN event_type <> 'view' THEN 1 END) AS metered, count(*) AS calls FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def _(t):
    now = t.events.agg(F.max("ts").alias("now"))
    recent = t.events.join(F.broadcast(now), F.col("ts") > F.col("now") - F.expr("INTERVAL 7 DAYS"))
    return recent.agg(F.count_if(F.col("event_type") != "view").alias("metered"), F.count("*").alias("calls"))


@query("agg12_daily_usage", "SELECT ts::DATE AS day, event_type, count(*) AS calls, sum((props::JSON ->> 'k')::BIGINT)::BIGINT AS tokens FROM events GROUP BY 1, 2")
def _(t):
    k = F.from_json("props", "k long")["k"]
    return t.events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("calls"), F.sum(k).alias("tokens"))


@query("agg13_count_since", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1")
def _(t):
    return t.events.where("ts >= timestamp '2024-01-15'").groupBy("event_type").agg(F.count("*").alias("n"))


@query("agg14_validation_summary", f"SELECT action, after, count(*) AS n FROM ({UPSERT_SQL}) GROUP BY 1, 2")
def _(t):
    return finding_upsert(t).groupBy("action", "after").agg(F.count("*").alias("n"))


@query("agg16_queue_digest", """
SELECT o_orderpriority, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS claimed, list(o_orderkey ORDER BY o_totalprice::DECIMAL(18,2) DESC, o_orderkey DESC) AS orders FROM orders WHERE o_orderstatus = 'P' GROUP BY 1""")
def _(t):
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    rows = F.sort_array(F.collect_list(F.struct(amount.alias("a"), "o_orderkey")), False)
    g = t.orders.where("o_orderstatus = 'P'").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum(amount).cast("double").alias("claimed"), rows.alias("r"))
    return g.select("o_orderpriority", "n", "claimed", F.col("r.o_orderkey").alias("orders"))


@query("agg17_rule_sets", "SELECT user_id, list_sort(list(DISTINCT event_type)) AS kinds FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))


@query("agg18_counters", "SELECT event_type, count(*) AS n, sum(value::DECIMAL(16,4))::DOUBLE AS total FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(16,4)")).cast("double").alias("total"))


SCENARIOS = ((90, 45.0, 0.4), (150, 55.0, 0.6), (120, 50.0, 0.5))


@query("agg19_scenarios", f"""
SELECT o_orderpriority, minutes, n, round(n * minutes / 60.0::DOUBLE * share, 1)::DOUBLE AS hours, round(n * minutes / 60.0::DOUBLE * cost * share, 2)::DOUBLE AS saved
FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), (VALUES {', '.join(f"({m}, {c}::DOUBLE, {s}::DOUBLE)" for m, c, s in SCENARIOS)}) v(minutes, cost, share)""")
def _(t):
    """What each scenario would save on the orders of each priority."""
    grid = F.array(*[F.struct(F.lit(m).alias("minutes"), F.lit(c).alias("cost"), F.lit(s).alias("share")) for m, c, s in SCENARIOS])
    rows = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n")).select("o_orderpriority", "n", F.inline(grid))
    hours = F.col("n") * F.col("minutes") / F.lit(60.0)
    return rows.select("o_orderpriority", "minutes", "n", F.round(hours * F.col("share"), 1).alias("hours"), F.round(hours * F.col("cost") * F.col("share"), 2).alias("saved"))


@query("arr01_tall_to_wide", "SELECT user_id, sum(CASE WHEN event_type = 'click' THEN 1 END)::BIGINT AS click, sum(CASE WHEN event_type = 'view' THEN 1 END)::BIGINT AS view FROM events GROUP BY 1")
def _(t):
    tall = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return R.tall_to_wide(tall, ["user_id"], "event_type", "n", ["click", "view"])


# windows


@query("win01_best_reading", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def _(t):
    return R.best_reading(t.events, ["user_id"], "value", "event_id").select("user_id", "event_id", "value")


@query("win02_best_per_document", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def _(t):
    return R.best_reading(t.events, ["user_id", "event_type"], "value", "event_id").select("user_id", "event_type", "event_id")


@query("win03_first_occurrence", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def _(t):
    return R.first_per(t.events, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("win04_last_emission", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def _(t):
    return R.first_per(t.orders, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey")


@query("win05_latest", "SELECT o_custkey, max(o_orderdate) AS latest, max(o_orderkey) FILTER (true) >= 0 AS known FROM orders GROUP BY 1")
def _(t):
    g = t.orders.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m"))
    return g.select("o_custkey", F.col("m.o_orderdate").alias("latest"), (F.col("m.o_orderkey") >= 0).alias("known"))


@query("win06_dense_index", "SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1)::INT AS row_index FROM orders WHERE o_totalprice > 100000")
def _(t):
    return R.dense_index(t.orders.where("o_totalprice > 100000"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "row_index")


@query("win08_context_budget", """
WITH r AS (SELECT conv_id, turn, text, 400 - (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING) - length(text)) AS room FROM conversations)
SELECT conv_id, turn, md5(substr(text, 1, room::INT)) AS kept FROM r WHERE room > 0""")
def _(t):
    return R.within_budget(t.conversations, ["conv_id"], [F.col("turn"), F.col("role")], "text", 400).select("conv_id", "turn", F.md5("kept").alias("kept"))


@query("win10_list_ranks", "SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id)::INT AS position FROM embeddings")
def _(t):
    return R.dense_index(t.embeddings, ["label"], [F.col("embedding")[0].desc(), F.col("vec_id")], "p").select("label", "vec_id", (F.col("p") + 1).alias("position"))


# sorts


@query("srt01_page", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 20")
def _(t):
    return R.top(t.orders, [F.col("o_orderdate").desc(), F.col("o_orderkey")], 50, 20).select("o_orderkey", "o_orderdate")


@query("srt02_top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50")
def _(t):
    return R.top(t.part, [F.col("p_retailprice").desc(), F.col("p_partkey")], 500, most=50).select("p_partkey", "p_retailprice")


@query("srt03_severity_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderkey)::INT AS place FROM orders")
def _(t):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return R.dense_index(t.orders, ["o_orderstatus"], [rank, F.col("o_orderkey")], "p").select("o_orderkey", (F.col("p") + 1).alias("place"))


@query("srt05_attention", "SELECT event_id, event_type, value FROM events WHERE event_type IN ('error', 'purchase') ORDER BY value, event_id LIMIT 100")
def _(t):
    return R.top(t.events.where(F.col("event_type").isin("error", "purchase")), [F.col("value"), F.col("event_id")], 100).select("event_id", "event_type", "value")


@query("srt06_next_job", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def _(t):
    return R.top(t.orders.where("o_orderstatus = 'O'"), [F.col("o_orderdate"), F.col("o_orderkey")], 1).select("o_orderkey")


@query("srt07_history", "SELECT event_id, ts FROM events WHERE user_id = 7 ORDER BY ts, event_id LIMIT 200")
def _(t):
    return R.top(t.events.where("user_id = 7"), [F.col("ts"), F.col("event_id")], 200).select("event_id", "ts")


@query("srt08_exists", "SELECT count(*) > 0 AS any_open FROM (SELECT 1 FROM orders WHERE o_orderstatus = 'P' LIMIT 1)")
def _(t):
    return t.orders.where("o_orderstatus = 'P'").limit(1).agg((F.count("*") > 0).alias("any_open"))


# set operations


@query("set01_union_all", "SELECT 'customer' AS kind, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier UNION ALL SELECT 'part', p_partkey FROM part")
def _(t):
    c = t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"))
    s = t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"))
    p = t.part.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"))
    return c.unionByName(s).unionByName(p)


@query("set03_sorted_distinct", "SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS suppliers FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.array_distinct(F.collect_list("l_suppkey"))).alias("suppliers"))


@query("set04_except_both", "SELECT key, side FROM (SELECT c_nationkey AS key, 'missed' AS side FROM customer EXCEPT SELECT s_nationkey, 'missed' FROM supplier) UNION ALL SELECT key, side FROM (SELECT s_nationkey AS key, 'unexpected' AS side FROM supplier EXCEPT SELECT c_nationkey, 'unexpected' FROM customer)")
def _(t):
    return R.both_differences(t.customer.select(F.col("c_nationkey").alias("key")), t.supplier.select(F.col("s_nationkey").alias("key")), "key")


@query("set06_subset", "SELECT user_id, list_has_all(list(DISTINCT event_type), ['click', 'purchase']) AS complete FROM events GROUP BY 1")
def _(t):
    need = F.array(F.lit("click"), F.lit("purchase"))
    return t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("k")).select("user_id", (F.size(F.array_except(need, "k")) == 0).alias("complete"))


@query("set07_ordered_distinct", "SELECT user_id, list(event_type ORDER BY f) AS kinds FROM (SELECT user_id, event_type, min((ts, event_id)) AS f FROM events GROUP BY 1, 2) GROUP BY 1")
def _(t):
    g = t.events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("r"))
    return g.select("user_id", F.array_distinct(F.col("r.event_type")).alias("kinds"))


# flagship: reconciliation


@query("rep01_reconciliation", f"""
WITH s AS (SELECT l_orderkey, sum({NET}) AS supported FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_totalprice::DECIMAL(18,4)::DOUBLE AS declared, supported::DOUBLE AS supported, (o_totalprice::DECIMAL(18,4) - supported)::DOUBLE AS difference,
CASE WHEN o_totalprice IS NULL OR supported IS NULL THEN 'incompleto' WHEN o_totalprice::DECIMAL(18,4) = supported THEN 'cuadra' ELSE 'descuadre' END AS state FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")
def reconciliation(t):
    declared = t.orders.select("o_orderkey", dec("o_totalprice").alias("declared"))
    supported = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(net()).alias("supported"))
    out = R.reconcile(declared, supported, "o_orderkey")
    return out.select("o_orderkey", *[F.col(c).cast("double").alias(c) for c in ("declared", "supported", "difference")], "state")
