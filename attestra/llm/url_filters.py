"""URL filters: explicit rules first, else an empirical-Bayes reputation of the
host, in DataFrame operations only.

Labelled outcomes of pages are counted for host, registered domain and suffix.
From the top down, each level has a beta prior whose mean is the posterior mean
of the level above (the corpus for suffixes) and whose weight follows from the
over-dispersion of that level's groups, estimated by moments.  A page is
blocked if the lower bound of its host's posterior share of bad outcomes is
over the limit: hosts with few labels lean on their domain and suffix.

Defined results: a null url, or one without ``://``, has empty host and path
and is judged as the empty host; a host of a suffix alone is its own domain;
labels without a page, and pages without a label, add no outcome; repeated
pages are separate outcomes; of rules that fit a page the longest counts, then the
last by name; very long urls are read whole; an empty table gives no rows; without
any label every host gets the prior of ``PRIOR``.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, stored

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Suffixes of more than one label under which registrations are made.
SUFFIXES = ("example.com", "example.net", "example.org")
#: Some public suffixes; pass the whole public list as ``suffixes``.
PUBLIC_SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "org.au", "co.jp", "com.br", "co.nz", "co.za", "*.ck", "!www.ck")
#: Share of bad outcomes from which a host is blocked, and the bound's distance in standard deviations.
LIMIT, DISTANCE = 0.2, 1.645
#: Share and weight assumed where nothing is labelled.
PRIOR = (0.1, 10.0)
LEAST_RHO, MOST_RHO = 1e-4, 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict."""
    fits = [F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in rules]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES + PUBLIC_SUFFIXES) -> Column:
    """The suffix under which the host is registered, by rules in the manner of the
    public suffix list: ``co.uk``; ``*.ck``, any one label before ck; ``!www.ck``,
    an exception to that.  Exceptions come first, then rules of more labels; a
    host that no rule fits has its last label."""

    def under(s: str) -> Column:
        return (host == s) | F.endswith(host, F.lit("." + s))

    known = []
    for rule in sorted(suffixes, key=lambda s: (not s.startswith("!"), -s.count("."), s)):
        if rule.startswith("!"):
            known.append(F.when(under(rule[1:]), F.lit(rule.partition(".")[2])))
        elif rule.startswith("*."):
            known.append(F.when(F.endswith(host, F.lit(rule[1:])), F.substring_index(host, ".", -rule.count(".") - 1)))
        else:
            known.append(F.when(under(rule), F.lit(rule)))
    return F.coalesce(*known, F.substring_index(host, ".", -1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix with one label more."""
    before = F.substring(host, F.lit(1), F.length(host) - F.length(suffix) - 1)
    return F.when(host == suffix, host).otherwise(F.concat(F.substring_index(before, ".", -1), F.lit("."), suffix))


def _rho(level: DataFrame) -> float:
    """Over-dispersion of groups (n, k, m: outcomes, bad ones, prior mean)."""
    used = level.where((F.col("n") > 0) & (F.col("m") > 0) & (F.col("m") < 1))
    x = used.agg(
        F.sum((F.col("k") - F.col("n") * F.col("m")) * (F.col("k") - F.col("n") * F.col("m")) / (F.col("n") * F.col("m") * (1 - F.col("m")))).alias("chi"),
        F.count(F.lit(1)).alias("groups"),
        F.sum(F.col("n") - 1).alias("more"),
    ).first()
    if not x["more"]:
        return MOST_RHO
    return min(max((x["chi"] - x["groups"]) / x["more"], LEAST_RHO), MOST_RHO)


def _posterior(level: DataFrame, weight: float) -> DataFrame:
    w = F.lit(weight)
    return level.withColumn("a", w * F.col("m") + F.col("k")).withColumn("b", w * (1 - F.col("m")) + F.col("n") - F.col("k"))


def reputation(outcomes: DataFrame, suffixes: Sequence[str] = SUFFIXES + PUBLIC_SUFFIXES) -> DataFrame:
    """(host, n, k, a, b): beta posteriors of hosts from rows (host, n, k)."""
    host = outcomes.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("suffix", suffix_of(F.col("host"), suffixes))
    host = stored(host.withColumn("domain", domain_of(F.col("host"), F.col("suffix"))), "hosts")
    domain = host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffix = host.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = host.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    mean, weight = (total["k"] / total["n"], None) if total["n"] else PRIOR
    mean = min(max(mean, 1e-6), 1 - 1e-6)

    def fitted(level: DataFrame) -> DataFrame:
        level = stored(level, "level")
        return _posterior(level, weight if weight else 1 / _rho(level) - 1)

    suffix = fitted(suffix.withColumn("m", F.lit(mean)))
    above = suffix.select("suffix", (F.col("a") / (F.col("a") + F.col("b"))).alias("m"))
    domain = fitted(domain.join(above, "suffix"))
    above = domain.select("domain", (F.col("a") / (F.col("a") + F.col("b"))).alias("m"))
    return fitted(host.join(above, "domain"))


def lower_bound(a: Column, b: Column, distance: float = DISTANCE) -> Column:
    s = a + b
    return a / s - F.lit(distance) * F.sqrt(a * b / (s * s * (s + 1)))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, limit: float = LIMIT, suffixes: Sequence[str] = SUFFIXES + PUBLIC_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    urls = pick(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    bad = pick(labels, "doc_id", "quality").where("quality is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("quality") == 0).cast("long")).alias("k"))
    counted = urls.select("page_id", "host").join(bad, "page_id", "left").select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("k", F.lit(0)).alias("k"))
    blocked = reputation(counted, suffixes).where(lower_bound(F.col("a"), F.col("b")) > limit).select("host", F.lit(True).alias("blocked"))
    fit = rule_of(F.col("host"), F.col("path"), rules)
    judged = urls.join(blocked, "host", "left").withColumn("fit", fit)
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def _oracle() -> str:
    rule = " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
    verdict = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for h, p, v in RULES)
    suffix = " ".join(f"WHEN host = '{s}' OR host LIKE '%.{s}' THEN '{s}'" for s in SUFFIXES)

    def post(name: str, source: str, extra: str) -> str:
        return f"""{name}_w AS (SELECT CASE WHEN sum(n - 1) IS NULL OR sum(n - 1) = 0 THEN {MOST_RHO} ELSE least(greatest((sum((k - n * m) * (k - n * m) / (n * m * (1 - m))) - count(*)) / sum(n - 1), {LEAST_RHO}), {MOST_RHO}) END AS rho FROM {source} WHERE n > 0 AND m > 0 AND m < 1),
{name}_p AS (SELECT {extra}, (1 / rho - 1) * m + k AS a, (1 / rho - 1) * (1 - m) + n - k AS b FROM {source}, {name}_w)"""

    return f"""
WITH urls AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{URL}', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '{URL}', 2), '') AS path FROM pages),
bad AS (SELECT doc_id, count(*) AS n, sum((quality = 0)::INT) AS k FROM labels WHERE quality IS NOT NULL GROUP BY 1),
counted AS (SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(k), 0)::DOUBLE AS k FROM urls LEFT JOIN bad ON doc_id = page_id GROUP BY 1),
suffixed AS (SELECT *, CASE {suffix} ELSE split_part(host, '.', -1) END AS suffix FROM counted),
hosts AS (SELECT *, CASE WHEN host = suffix THEN host ELSE split_part(substr(host, 1, length(host) - length(suffix) - 1), '.', -1) || '.' || suffix END AS domain FROM suffixed),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(m) AS m FROM hosts, (SELECT sum(k) / sum(n) AS m FROM hosts) GROUP BY 1),
{post("s", "s", "suffix")},
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k, any_value(a / (a + b)) AS m FROM hosts JOIN s_p USING (suffix) GROUP BY 1, 2),
{post("d", "d", "domain")},
h AS (SELECT host, n, k, a / (a + b) AS m FROM hosts JOIN d_p USING (domain)),
{post("h", "h", "host")},
blocked AS (SELECT host FROM h_p WHERE a / (a + b) - {DISTANCE} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {LIMIT}),
ruled AS (SELECT *, CASE {rule} END AS rule FROM urls)
SELECT page_id, host, path, rule, CASE rule {verdict} ELSE CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END END AS verdict FROM ruled
"""


ORACLE = _oracle()
