"""Secret scans over a ledger of blobs, in DataFrame operations only.

A version of a path is a row with a text.  Texts are addressed by their SHA-256
(the *blob*), so a text that many paths or versions hold is scanned once.  The
ledger is a folder of Parquet tables, one for each increment.  It holds

* a row without a span for each blob of the increment, with the rules (``kind@version``)
  that were run over it, and
* a row for each span that they found.

``scan`` looks up which rules of the rule set each blob has not seen, and runs
those alone: a later call with more versions scans new blobs, one with a new
version of a rule runs that rule over all blobs.  An increment is written by one
job, so that it is there whole or not at all.  ``findings`` joins the spans of
the current rule versions back to all versions of all paths.

Places are code points and come from the pieces between the matches: the start of
a match is the length of all pieces and matches before it, a running sum.

Shuffles: texts once, one for each blob and task (equal texts meet before they
travel); digests with their place; spans.  Rows of frequent blobs are spread
when spans are joined back to them.

Defined results: a null text counts as empty; an empty text has no spans; rows
with null or repeated ids keep a row each; an empty table gives no rows; of a
text of any length all spans are found; extra columns are ignored.  Spans of one
kind don't overlap, those of different kinds may.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hot_keys, new_path, pick, salted_join, stored


@dataclass(frozen=True)
class Rule:
    """What a kind of secret looks like: leftmost matches of ``pattern`` that don't
    overlap and whose group ``part`` has ``least`` characters."""

    kind: str
    version: int
    pattern: str
    part: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# A match of a run of characters that is too short holds no longer one, so the least
# length of ``access`` and ``hex`` stands in the pattern; that of ``assign`` can't.
BASE = (
    Rule("assign", 1, r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
#: Kinds beyond the base: access tokens of code hosts and chats, signed web tokens,
#: private keys, and passwords inside addresses.
ADDED = (
    Rule("host", 1, r"(?:gh[opsu]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,})"),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web", 1, r"eyJ[A-Za-z0-9_-]{8,200}\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\x20\r\n]*-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----"),
    Rule("address", 1, r"(?:https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x00-\x20/:@]{1,100}:[^\x00-\x20/@]{1,100}@"),
)
RULES = BASE + ADDED

LEDGER = "blob string, rules array<string>, kind string, rule string, start bigint, end bigint"


def address(text: str) -> Column:
    """The name of a text's blob."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def ledger_at(spark: SparkSession, path: str) -> DataFrame | None:
    """All increments of a ledger; nothing, if none was written there yet."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{path}/increment=*")
    except AnalysisException:
        return None


def _matches(rule: Rule) -> Column:
    """The rule's matches in ``text``: length of the piece before, length, and
    whether it counts.  Texts without a match are read once."""
    lengths = lambda parts: F.transform(parts, F.length)
    text, pattern = F.col("text"), F.lit(rule.pattern)
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.part))
    found = F.arrays_zip(lengths(F.split(text, rule.pattern, -1)).alias("gap"), lengths(F.regexp_extract_all(text, pattern, F.lit(0))).alias("size"), lengths(tested).alias("tested"))
    return F.when(F.array_contains("todo", rule.key) & text.rlike(rule.pattern), found)


def unseen(blobs: DataFrame, ledger: DataFrame | None, rules: Sequence[Rule]) -> DataFrame:
    """Blobs with the rules that they haven't seen (``todo``), if there are any."""
    wanted = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        return blobs.withColumn("todo", wanted)
    seen = ledger.where("kind IS NULL").groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    rest = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").withColumn("todo", rest).where(F.size("todo") > 0).drop("seen")


def spans_of(todo: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The ledger's rows for blobs (blob, text, todo): one without a span each, and
    one for each span."""
    none = F.array().cast("array<struct<gap:int,size:int,tested:int>>")
    each = [F.struct(F.lit(r.kind).alias("kind"), F.lit(r.key).alias("rule"), F.lit(r.least).alias("least"), _matches(r).cast("array<struct<gap:int,size:int,tested:int>>").alias("found")) for r in rules]
    mark = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("rule"), F.lit(0).alias("least"), none.alias("found"))
    by_rule = todo.select("blob", "todo", F.inline(F.filter(F.array(mark, *each), lambda x: x["found"].isNotNull())))
    rows = by_rule.select("blob", "todo", "kind", "rule", "least", F.posexplode_outer("found").alias("k", "at"))
    rows = rows.where("kind IS NULL OR at.size IS NOT NULL")  # the piece after the last match has none
    w = Window.partitionBy("blob", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    until = F.sum(F.col("at.gap").cast("bigint") + F.col("at.size")).over(w)
    placed = rows.withColumn("end", until).where("kind IS NULL OR at.tested >= least")
    return placed.select("blob", F.when(F.col("kind").isNull(), F.col("todo")).alias("rules"), "kind", "rule", (F.col("end") - F.col("at.size")).alias("start"), "end")


def scan(ledger: str, versions: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> None:
    """Add what is new among ``versions`` to the ledger in the folder ``ledger``."""
    spark = versions.sparkSession
    blobs = versions.select(address(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text")).dropDuplicates(["blob"])
    todo = unseen(blobs, ledger_at(spark, ledger), rules)
    spans_of(todo, rules).write.parquet(f"{ledger}/increment={uuid.uuid4().hex}")


def findings(ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per blob its spans of the current rule versions, by start and then kind as listed:
    (blob, spans array<struct<start, nth, end, kind>>); blobs without one have no row.
    If two calls scanned the same at once, their equal spans count once."""
    nth = F.array_position(F.array(*[F.lit(r.key) for r in rules]), F.col("rule"))
    current = ledger.where(F.col("rule").isin([r.key for r in rules])).select("blob", F.struct("start", nth.alias("nth"), "end", "kind").alias("span"))
    return current.groupBy("blob").agg(F.array_sort(F.collect_set("span")).alias("spans"))


def _spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secrets(versions: DataFrame, rules: Sequence[Rule] = RULES, ledger: str | None = None) -> DataFrame:
    """Scan what the ledger (a new one, if none is given) hasn't seen, and give each
    version the spans of its blob: doc_id, their numbers by base kind, and the spans."""
    spark = versions.sparkSession
    ledger = ledger or new_path(spark, "ledger")
    scan(ledger, pick(versions, "text"), rules=rules)
    paths = stored(versions.select(F.col("`doc_id`").alias("doc_id"), address("`text`").alias("blob"), F.monotonically_increasing_id().alias("place")), "paths")
    hot = hot_keys(paths.groupBy("blob").agg(F.count("*").alias("n")), "blob", "n")
    joined = salted_join(paths, findings(ledger_at(spark, ledger), rules), "blob", hot, "place", "left")
    base = F.filter("spans", lambda x: x["kind"].isin([r.kind for r in BASE]))
    number = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    joined = joined.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,nth:bigint,end:bigint,kind:string>>")))
    return joined.select("doc_id", *[number(r.kind) for r in BASE], F.sha2(_spelled(base).cast("binary"), 256).alias("base_sha256"), _spelled(F.col("spans")).alias("spans"))


def _oracle(rules: Sequence[Rule] = RULES) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    lengths = lambda parts: f"list_transform({parts}, lambda x: length(x))"
    each = [
        f"SELECT rid, {quoted(r.kind)} AS kind, {n} AS nth, {r.least} AS least, unnest(range(1, len(m) + 1)) AS k, unnest({lengths('m')}) AS size, unnest({lengths('p')}) AS tested, unnest({lengths('s')}[1:len(m)]) AS gap "
        f"FROM (SELECT rid, regexp_extract_all(t, {quoted(r.pattern)}) AS m, regexp_extract_all(t, {quoted(r.pattern)}, {r.part}) AS p, string_split_regex(t, {quoted(r.pattern)}) AS s FROM d)"
        for n, r in enumerate(rules)
    ]
    base = ", ".join(quoted(r.kind) for r in BASE)
    numbers = ", ".join(f"count(*) FILTER (kind = {quoted(r.kind)}) AS n_{r.kind}" for r in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(each)}),
w AS (SELECT *, sum(gap + size) OVER (PARTITION BY rid, nth ORDER BY k) AS upto FROM m),
s AS (SELECT rid, kind, nth, upto - size AS start, kind || ':' || (upto - size)::BIGINT || ':' || upto::BIGINT AS span FROM w WHERE tested >= least),
g AS (SELECT rid, {numbers}, string_agg(span, ',' ORDER BY start, nth) FILTER (kind IN ({base})) AS base, string_agg(span, ',' ORDER BY start, nth) AS spans FROM s GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)
"""


ORACLE = _oracle()
