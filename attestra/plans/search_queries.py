"""Search by places over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cover as C
from .registry import query

WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


def _cover_sql(terms: tuple[str, ...]) -> str:
    latest = ", ".join(f"last_value(CASE WHEN term = '{t}' THEN {c} END IGNORE NULLS) OVER x AS {c}{k}" for k, t in enumerate(terms) for c in ("pos", "nth"))
    least = lambda c: f"least({', '.join(f'{c}{k}' for k in range(len(terms)))})"
    have = " + ".join(f"(pos{k} IS NOT NULL)::INT" for k in range(len(terms)))
    return f"""
WITH p AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT doc_id, {WORDS} AS w FROM documents)),
n AS (SELECT doc_id, term, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM p WHERE term IN {terms}),
d AS (SELECT doc_id, count(DISTINCT term) AS covered FROM n GROUP BY 1),
h AS (SELECT doc_id, pos, nth, {latest} FROM n WINDOW x AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT h.doc_id, pos, nth, covered, {have} AS have, {least("pos")} AS start, {least("nth")} AS first FROM h JOIN d ON h.doc_id = d.doc_id),
c AS (SELECT *, lag(CASE WHEN have = covered THEN start END) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM s),
g AS (SELECT doc_id, covered, count(*) AS covers, round(sum(1.0::DOUBLE / (1 + (pos - start) - (nth - first))), 6) AS score FROM c WHERE have = covered AND (before IS NULL OR start > before) GROUP BY 1, 2)
SELECT * FROM g WHERE covered = {len(terms)} OR (SELECT max(covered) FROM g) < {len(terms)} ORDER BY covered DESC, score DESC, doc_id LIMIT 20"""


def _ranked(t, terms):
    index = C.positional_postings(t.documents, "doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), terms)
    return C.by_cover_density(index, "doc_id", terms, 20)


@query("ret01_cover_density", _cover_sql(("the", "and", "that")))
def _(t):
    return _ranked(t, ("the", "and", "that"))


@query("ret01_cover_density_any_term", _cover_sql(("the", "of", "zzzabsent")))
def _(t):
    return _ranked(t, ("the", "of", "zzzabsent"))
