"""Scalar functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import numbers as N
from ..functions import structured as S
from ..functions import text as X
from .registry import query

ACC = "translate(text, 'áéíóúüñÁÉÍÓÚÜÑ', 'aeiouunAEIOUUN')"


@query("str01_fold", f"SELECT doc_id, md5(lower({ACC})) AS folded, length(lower({ACC})) = length(text) AS same_length FROM documents")
def _(t):
    f = X.fold(F.col("text"))
    return t.documents.select("doc_id", F.md5(f).alias("folded"), (F.length(f) == F.length("text")).alias("same_length"))


@query("str02_collapse_spaces", "SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\x{00A0}\\x{202F}]+', ' ', 'g'), ' ')) AS collapsed FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(X.collapse_spaces(F.col("text"))).alias("collapsed"))


@query("str03_labelled_value", """
WITH p AS (SELECT page_id, 'Titulo:  ' || regexp_extract(html, '<title>([^<]*)</title>', 1) || chr(10) || 'x' AS line FROM pages),
m AS (SELECT page_id, line, regexp_extract(line, 'Titulo\\s*:?\\s*([^\\n\\r]+)', 1) AS v FROM p)
SELECT page_id, trim(regexp_replace(v, '[ \\t]+', ' ', 'g'), ' ') AS value, (strpos(line, v) - 1)::INT AS start_at, (strpos(line, v) - 1 + length(v))::INT AS end_at FROM m WHERE v <> ''""")
def _(t):
    line = F.concat(F.lit("Titulo:  "), F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("\nx"))
    found = X.labelled_value(F.col("line"), "titulo")
    return t.pages.select("page_id", line.alias("line")).select("page_id", found.alias("f")).where("f is not null").select("page_id", "f.value", F.col("f.start").cast("int").alias("start_at"), F.col("f.end").cast("int").alias("end_at")).where("value != ''")


@query("str04_reference_key", "SELECT c_custkey, regexp_replace(upper(c_name), '[^A-Z0-9-]', '', 'g') AS key FROM customer")
def _(t):
    return t.customer.select("c_custkey", X.reference_key(F.col("c_name")).alias("key"))


@query("str05_project_code", "SELECT p_partkey, trim('- ' || p_brand || ' -', '- ') AS code, contains(p_name, split_part(p_brand, '#', 2)) AS has_code FROM part")
def _(t):
    code = F.concat(F.lit("- "), F.col("p_brand"), F.lit(" -"))
    return t.part.select("p_partkey", X.strip_dashes(code).alias("code"), F.contains("p_name", F.split_part("p_brand", F.lit("#"), F.lit(2))).alias("has_code"))


@query("str06_directives", f"""
WITH all_text AS (SELECT text FROM documents UNION ALL SELECT text FROM conversations),
p(pattern) AS (VALUES {", ".join(f"('{x}')" for x in X.DIRECTIVE_PATTERNS)})
SELECT pattern, count(CASE WHEN regexp_matches(text, '(?i)' || pattern) THEN 1 END) AS hits FROM all_text, p GROUP BY 1""")
def _(t):
    every = t.documents.select("text").unionByName(t.conversations.select("text"))
    counts = every.agg(*[F.count_if(F.col("text").rlike(f"(?i){p}")).alias(f"n{k}") for k, p in enumerate(X.DIRECTIVE_PATTERNS)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"n{k}").alias("hits")) for k, p in enumerate(X.DIRECTIVE_PATTERNS)])).alias("r")).select("r.*")


WATCH = (r"licen[sc]e", r"\b[\w.]+@[\w.]+\b", r"\b\d+\.\d+\.\d+\.\d+\b")


@query("str06_watched_phrases", f"""
SELECT doc_id, list_slice(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i){"|".join(f"(?:{w})" for w in WATCH)}'), lambda x: lower(x)))), 1, 10) AS hits FROM documents
WHERE regexp_matches(text, '(?i){"|".join(f"(?:{w})" for w in WATCH)}')""")
def _(t):
    hits = X.directive_hits(F.col("text"), WATCH)
    return t.documents.select("doc_id", hits.alias("hits")).where(F.size("hits") > 0)


@query("str07_prompt_screen", f"""
SELECT role, count(*) AS turns, count(CASE WHEN regexp_matches(role || ': ' || text, '(?im){"|".join(f"(?:{p})" for p in X.SCREEN_PATTERNS)}') THEN 1 END) AS screened FROM conversations GROUP BY 1""")
def _(t):
    said = F.concat("role", F.lit(": "), "text")
    return t.conversations.groupBy("role").agg(F.count("*").alias("turns"), F.count_if(X.screened(said)).alias("screened"))


@query("str08_grounding", """
SELECT doc_id, contains(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(substr(text, 11, 30), '\\s+', ' ', 'g')))) AND contains(lower(trim(regexp_replace(substr(text, 11, 30), '\\s+', ' ', 'g'))), lower(trim(regexp_replace(substr(text, 15, 8), '\\s+', ' ', 'g')))) AS grounded FROM documents""")
def _(t):
    return t.documents.select("doc_id", X.grounded(F.col("text"), F.substring("text", 11, 30), F.substring("text", 15, 8)).alias("grounded"))


LETTERS = "a-zà-ÿ0-9_"
LANGUAGE_WORDS = {k: ((a, 0.5), (b, 0.3), (c, 0.3)) for k, (a, b, c) in {"en": ("the", "and", "of"), "de": ("der", "und", "die"), "fr": ("le", "et", "pour"), "es": ("que", "los", "del")}.items()}
LANGUAGE_SIGNALS = {k: tuple((f"(?:^|[^{LETTERS}]){w}(?:[^{LETTERS}]|$)", x) for w, x in s) for k, s in LANGUAGE_WORDS.items()}


def _score_sql(signals):
    return "least(" + " + ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN {w}::DECIMAL(6,3) ELSE 0::DECIMAL(6,3) END" for p, w in signals) + ", 1)::DECIMAL(6,3)"


@query("str09_weighted_score", f"SELECT doc_id, {', '.join(f'{_score_sql(s)}::DOUBLE AS {k}' for k, s in LANGUAGE_SIGNALS.items())} FROM documents")
def _(t):
    spaced = t.documents.select("doc_id", X.between_spaces(X.lower(F.col("text")), LETTERS).alias("spaced"))
    return spaced.select("doc_id", *[X.weighted_words(F.col("spaced"), s).cast("double").alias(k) for k, s in LANGUAGE_WORDS.items()])


@query("str10_words", "SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}\\p{Pc}]+'))::INT AS n_words FROM documents")
def _(t):
    return t.documents.select("doc_id", N.word_count(F.col("text")).alias("n_words"))


@query("str11_plain_words", "SELECT doc_id, len(w)::INT AS n_words, md5(array_to_string(w, ' ')) AS words FROM (SELECT doc_id, regexp_extract_all(strip_accents(replace(lower(text), 'ß', 'ss')), '[a-z0-9]+') AS w FROM documents)")
def _(t):
    w = X.plain_words(F.col("text"))
    return t.documents.select("doc_id", F.size(w).alias("n_words"), F.md5(F.array_join(w, " ")).alias("words"))


@query("str12_trigrams", "SELECT p_partkey, list_transform(range(1, greatest(1, length('^' || p_brand || '$') - 2) + 1), lambda i: substr('^' || p_brand || '$', i, 3)) AS trigrams FROM part")
def _(t):
    return t.part.select("p_partkey", X.trigrams(F.col("p_brand")).alias("trigrams"))


@query("str13_clip", "SELECT doc_id, md5(substr(text, 1, 200)) AS c200, md5(substr(text, 1, 500)) AS c500, length(substr(text, 1, 2000))::INT AS n2000 FROM documents")
def _(t):
    c = F.col("text")
    return t.documents.select("doc_id", F.md5(X.clip(c, 200)).alias("c200"), F.md5(X.clip(c, 500)).alias("c500"), F.length(X.clip(c, 2000)).alias("n2000"))


@query("str14_extension", "SELECT page_id, lower(regexp_extract(url, '\\.([^./\\\\]+)$', 1)) AS extension FROM pages")
def _(t):
    return t.pages.select("page_id", X.extension(F.col("url")).alias("extension"))


@query("str15_breakable", "SELECT page_id, regexp_replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '([/:?])', '\\1<wbr>', 'g') AS html FROM pages")
def _(t):
    return t.pages.select("page_id", X.breakable(F.col("url")).alias("html"))


@query("str16_redaction", "SELECT c_custkey, '[redacted]' AS token, c_name AS name FROM customer")
def _(t):
    m = X.redacted(F.create_map(F.lit("Token"), "c_mktsegment", F.lit("name"), "c_name"))
    return t.customer.select("c_custkey", m["Token"].alias("token"), m["name"].alias("name"))


@query("str17_spanish_amount", "SELECT o_orderkey, translate(format('{:,.2f}', o_totalprice::DECIMAL(14,2)), ',.', '.,') AS amount FROM orders")
def _(t):
    return t.orders.select("o_orderkey", X.spanish_amount(F.col("o_totalprice").cast("decimal(14,2)")).alias("amount"))


@query("str18_fixed_point", "SELECT l_quantity AS q, CASE WHEN l_quantity = floor(l_quantity) THEN floor(l_quantity)::BIGINT::VARCHAR ELSE l_quantity::DECIMAL(18,2)::VARCHAR END AS shown, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(t):
    q = F.col("l_quantity")
    return t.lineitem.groupBy(q.alias("q"), X.fixed_point(q).alias("shown")).agg(F.count("*").alias("n"))


# dates


@query("dat01_parse_date", "SELECT o_orderkey, o_orderdate::DATE AS iso, o_orderdate::DATE AS written, o_orderdate::DATE AS day_first, NULL::DATE AS wrong FROM orders")
def _(t):
    o = F.col("o_orderdate")
    months = F.array(*[F.lit(m) for m in D.MONTHS if m != "setiembre"])
    written = F.concat_ws(" de ", F.day(o).cast("string"), F.element_at(months, F.month(o)), F.year(o).cast("string"))
    return t.orders.select("o_orderkey", D.parse_date(F.concat(F.lit("el "), F.date_format(o, "yyyy-MM-dd"), F.lit(", 1/1/2000"))).alias("iso"), D.parse_date(written).alias("written"), D.parse_date(F.date_format(o, "d/M/yyyy")).alias("day_first"), D.parse_date(F.concat(F.date_format(o, "yyyy"), F.lit("-02-30 o "), F.date_format(o, "dd/MM/yyyy"))).alias("wrong"))


@query("dat02_split_period", "SELECT o_orderkey, o_orderdate::DATE AS starts, (o_orderdate::DATE + 30) AS ends FROM orders")
def _(t):
    o = F.to_date("o_orderdate")
    p = D.split_period(F.concat(o.cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(" al ")).otherwise(F.lit(" a ")), F.date_add(o, 30).cast("string")))
    return t.orders.select("o_orderkey", p["start"].alias("starts"), p["end"].alias("ends"))


@query("dat03_month_start", "SELECT strftime(o_orderdate, '%Y-%m') AS month, date_trunc('month', o_orderdate)::DATE AS first_day, count(*) AS n FROM orders GROUP BY 1, 2")
def _(t):
    m = F.date_format("o_orderdate", "yyyy-MM")
    return t.orders.groupBy(m.alias("month"), D.month_start(m).alias("first_day")).agg(F.count("*").alias("n"))


@query("dat04_until_midnight", "SELECT event_id, (86400 - (floor(epoch(ts))::BIGINT % 86400))::BIGINT AS seconds FROM events")
def _(t):
    return t.events.select("event_id", D.seconds_to_midnight(F.col("ts")).alias("seconds"))


@query("dat05_spanish_date", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS shown, 'sin fecha' AS other FROM orders")
def _(t):
    return t.orders.select("o_orderkey", D.spanish_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("shown"), D.spanish_date(F.lit("sin fecha")).alias("other"))


@query("dat06_backoff", "SELECT l_linenumber AS attempt, (5 * 2 ** (l_linenumber - 1))::BIGINT AS seconds, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(t):
    a = F.col("l_linenumber")
    return t.lineitem.groupBy(a.alias("attempt"), D.backoff_seconds(a).alias("seconds")).agg(F.count("*").alias("n"))


# numbers


@query("num01_parse_amount", "SELECT o_orderkey, o_totalprice::DECIMAL(14,2)::DOUBLE AS amount FROM orders")
def _(t):
    shown = X.spanish_amount(F.col("o_totalprice").cast("decimal(14,2)"))
    return t.orders.select("o_orderkey", N.parse_amount(F.concat(F.lit("TOTAL: "), shown, F.lit(" EUR"))).cast("double").alias("amount"))


@query("num02_repair_digits", "SELECT o_orderkey, o_totalprice::DECIMAL(14,2)::DOUBLE AS amount FROM orders WHERE o_totalprice >= 1000")
def _(t):
    shown = F.translate(X.spanish_amount(F.col("o_totalprice").cast("decimal(14,2)")), "0158", "OISB")
    return t.orders.where("o_totalprice >= 1000").select("o_orderkey", N.parse_amount_tolerant(F.concat(F.lit("Total BIen "), shown)).cast("double").alias("amount"))


@query("num03_tolerance", "SELECT count(*) AS rows, count(CASE WHEN abs(l_extendedprice::DECIMAL(14,2) + (l_extendedprice * l_tax)::DECIMAL(14,2) - (l_extendedprice * (1 + l_tax))::DECIMAL(14,2)) > 0.01 THEN 1 END) AS mismatches FROM lineitem")
def _(t):
    d = lambda c: c.cast("decimal(14,2)")
    price, tax = F.col("l_extendedprice"), F.col("l_tax")
    return t.lineitem.agg(F.count("*").alias("rows"), F.count_if(N.differs(d(price) + d(price * tax), d(price * (1 + tax)))).alias("mismatches"))


@query("num04_row_amount", """
SELECT l_returnflag, count(*) AS rows, count(CASE WHEN abs(round_even((l_quantity::DECIMAL(16,4) * p_retailprice::DECIMAL(16,4))::DECIMAL(30,8), 2) - l_extendedprice::DECIMAL(16,4)) > 0.01 THEN 1 END) AS mismatches
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def _(t):
    amount = N.row_amount(F.col("l_quantity").cast("decimal(16,4)"), F.col("p_retailprice").cast("decimal(16,4)"))
    joined = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return joined.groupBy("l_returnflag").agg(F.count("*").alias("rows"), F.count_if(N.differs(amount, F.col("l_extendedprice").cast("decimal(16,4)"))).alias("mismatches"))


@query("num05_cell_number", "SELECT o_orderkey, o_totalprice::DECIMAL(14,2)::DOUBLE AS spanish, o_totalprice::DECIMAL(14,2)::DOUBLE AS plain, NULL::DOUBLE AS text FROM orders")
def _(t):
    amount = F.col("o_totalprice").cast("decimal(14,2)")
    return t.orders.select("o_orderkey", N.cell_number(X.spanish_amount(amount)).cast("double").alias("spanish"), N.cell_number(amount.cast("string")).cast("double").alias("plain"), N.cell_number(F.lit("n/a")).cast("double").alias("text"))


@query("num06_confidence", "SELECT event_id, round_even((CASE WHEN event_type = 'click' THEN greatest(0, least(0.99, value / 100)) * 0.75 ELSE greatest(0, least(0.99, value / 100)) END)::DECIMAL(12,6), 3)::DOUBLE AS confidence FROM events")
def _(t):
    return t.events.select("event_id", N.confidence(F.col("value"), F.col("event_type") == "click").cast("double").alias("confidence"))


@query("num07_budget_stop", "SELECT p_size AS ceiling, CASE WHEN p_size = 0 THEN 0 ELSE greatest(floor(p_size * 0.9)::BIGINT, 1) END::BIGINT AS stop, count(*) AS n FROM part GROUP BY 1, 2")
def _(t):
    c = F.col("p_size")
    return t.part.groupBy(c.alias("ceiling"), N.budget_stop(c, F.lit(0.9)).alias("stop")).agg(F.count("*").alias("n"))


@query("num08_token_cost", """
SELECT doc_id, greatest(1, floor(n_chars / 4))::BIGINT AS tokens,
       round_even(((greatest(1, floor(n_chars / 4))::DECIMAL(12,0) * CASE WHEN doc_id % 2 = 0 THEN 1.00 ELSE 5.00 END + 100 * CASE WHEN doc_id % 2 = 0 THEN 5.00 ELSE 25.00 END) * 0.92)::DECIMAL(30,4) / 1000000.0::DOUBLE, 6)::DECIMAL(20,6)::DOUBLE AS eur FROM documents""")
def _(t):
    tokens = N.token_estimate(F.col("n_chars"))
    model = F.when(F.col("doc_id") % 2 == 0, F.lit("claude-haiku-4-5")).otherwise(F.lit("unknown"))
    return t.documents.select("doc_id", tokens.alias("tokens"), N.cost_eur(model, tokens, F.lit(100)).cast("double").alias("eur"))


@query("num12_as_count", "SELECT c_custkey, greatest(coalesce(try_cast(c_custkey::VARCHAR AS BIGINT), 0), 0)::BIGINT AS whole, 0::BIGINT AS other FROM customer")
def _(t):
    return t.customer.select("c_custkey", N.as_count(F.col("c_custkey").cast("string")).alias("whole"), N.as_count(F.col("c_name")).alias("other"))


# structured values


@query("hsh01_content_hash", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", S.content_hash(F.col("text")).alias("digest"))


@query("snk01_storage_key", "SELECT doc_id, substr(sha256(text), 1, 2) || '/' || substr(sha256(text), 3, 2) || '/' || sha256(text) AS key FROM documents")
def _(t):
    return t.documents.select("doc_id", S.storage_key(S.content_hash(F.col("text"))).alias("key"))


@query("hsh02_fingerprint", "SELECT doc_id, sha256('AMBIGUOUS_FIELD|1.0.0|' || doc_id) AS fingerprint FROM documents")
def _(t):
    return t.documents.select("doc_id", S.fingerprint(F.lit("AMBIGUOUS_FIELD"), F.col("doc_id").cast("string")).alias("fingerprint"))


@query("jsn01_canonical_json", """SELECT n_nationkey, sha256('{"key":' || n_nationkey || ',"name":"' || n_name || '","region":' || n_regionkey || '}') AS digest FROM nation""")
def _(t):
    j = S.canonical_json(region=F.col("n_regionkey"), name=F.col("n_name"), key=F.col("n_nationkey"))
    return t.nation.select("n_nationkey", F.sha2(j, 256).alias("digest"))


@query("jsn02_payload", "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def _(t):
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("jsn03_object_with_value", None)
def _(t):
    doc = F.to_json(F.struct(F.lit("n").alias("kind"), F.array(F.struct("n_nationkey", "n_name")).alias("items")))
    return t.nation.select("n_nationkey", S.object_with_value(doc, F.col("n_name")).alias("found"))


@query("jsn04_last_json", "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def _(t):
    noisy = F.concat(F.lit('answer {"k": -1} or {broken} so '), "props", F.lit(" done"))
    return t.events.select("event_id", S.last_json(noisy, "k long")["k"].alias("k"))


@query("jsn05_detail_rows", """
SELECT n_nationkey, u.label, u.value FROM (SELECT n_nationkey, unnest([{'label': 'Nombre', 'value': n_name}, {'label': 'region', 'value': n_regionkey::VARCHAR}]) AS u FROM nation)""")
def _(t):
    m = F.create_map(F.lit("region"), F.col("n_regionkey").cast("string"), F.lit("name"), F.col("n_name"))
    return t.nation.select("n_nationkey", F.explode(S.detail_rows(m, {"name": "Nombre"})).alias("r")).select("n_nationkey", "r.label", "r.value")


@query("arr02_alternate_names", """
WITH d AS (SELECT sha256(text) AS digest, doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS document FROM documents)
SELECT digest, document, list(doc_id ORDER BY doc_id) FILTER (doc_id <> document) AS alternates FROM d GROUP BY 1, 2 HAVING count(*) > 1""")
def _(t):
    g = t.documents.groupBy(S.content_hash(F.col("text")).alias("digest")).agg(F.array_sort(F.collect_list("doc_id")).alias("ids")).where(F.size("ids") > 1)
    return g.select("digest", F.get("ids", F.lit(0)).alias("document"), F.slice("ids", 2, F.size("ids")).alias("alternates"))


@query("arr03_row_text", "SELECT n_nationkey, 'Name: ' || n_name || ' · Region: ' || n_regionkey AS line FROM nation")
def _(t):
    cells = F.array(F.struct(F.lit("Name").alias("h"), F.col("n_name").alias("v")), F.struct(F.lit("Region").alias("h"), F.col("n_regionkey").cast("string").alias("v")))
    return t.nation.select("n_nationkey", F.array_join(F.transform(cells, lambda x: F.concat_ws(": ", x["h"], x["v"])), " · ").alias("line"))


@query("flt12_display_name", """
WITH n AS (SELECT page_id, trim(regexp_replace(regexp_extract(url, '([^/\\\\]*)$', 1), '[\\x00-\\x1f\\x7f<>:"|?*]', '', 'g'), ' ') AS v FROM pages)
SELECT page_id, substr(CASE WHEN v = '' THEN 'unnamed' ELSE v END, 1, 255) AS name FROM n""")
def _(t):
    return t.pages.select("page_id", X.display_name(F.col("url")).alias("name"))


@query("snk03_neutralised", "SELECT c_custkey, CASE WHEN regexp_matches(c_acctbal::DECIMAL(14,2)::VARCHAR, '^[=+\\-@\\t\\r]') THEN '''' || c_acctbal::DECIMAL(14,2)::VARCHAR ELSE c_acctbal::DECIMAL(14,2)::VARCHAR END AS cell FROM customer")
def _(t):
    return t.customer.select("c_custkey", X.neutralised(F.col("c_acctbal").cast("decimal(14,2)").cast("string")).alias("cell"))


@query("snk09_content_disposition", """SELECT s_suppkey, 'attachment; filename="informe ' || s_suppkey || '.pdf"; filename*=UTF-8''''inf%C3%B3rme%20' || s_suppkey || '.pdf' AS header FROM supplier""")
def _(t):
    return t.supplier.select("s_suppkey", X.content_disposition(F.concat(F.lit("infórme "), F.col("s_suppkey").cast("string"), F.lit(".pdf"))).alias("header"))
