"""Lexical search with places: postings that hold positions, and ranking by cover
density.

A *cover* is a stretch of a text that holds all of the query's terms (or all of
those that the text has) and no shorter one inside.  Texts rank by the sum over
their covers of 1 / (1 + words between the terms): more covers and denser ones come
first.  Covers are found by one sweep over a text's hits in order of place, which is
a window per text: the latest place of every term so far gives the only cover that
can end here, and it is one if it begins later than the one before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import top


def positional_postings(df: DataFrame, key: str, words: Column, terms: Sequence[str] | None = None) -> DataFrame:
    """(key, term, positions): where each term stands, in ascending order.  With ``terms``
    only those are taken, before a word becomes a row."""
    placed = F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("at")))
    if terms is not None:
        placed = F.filter(placed, lambda x: x["term"].isin(*terms))
    return df.select(key, F.inline(placed)).groupBy(key, "term").agg(F.array_sort(F.collect_list("at")).alias("positions"))


def covers(index: DataFrame, key: str, terms: Sequence[str]) -> DataFrame:
    """(key, covered, first, last, noise): the covers of each text by the terms that it
    has, and how many other words stand inside."""
    hits = index.where(F.col("term").isin(*terms)).select(key, "term", F.explode("positions").alias("at"))
    so_far = Window.partitionBy(key).orderBy("at")
    whole = so_far.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hits = hits.withColumn("nth", F.row_number().over(so_far))
    latest = [F.last(F.when(F.col("term") == t, F.struct("at", "nth")), ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, 0)).alias(f"t{k}") for k, t in enumerate(terms)]
    has = [F.max(F.when(F.col("term") == t, 1).otherwise(0)).over(whole) for t in terms]
    ends = hits.select(key, "at", "nth", sum(has[1:], has[0]).alias("covered"), *latest)
    found = [F.col(f"t{k}") for k in range(len(terms))]
    there = [F.when(c.isNotNull(), 1).otherwise(0) for c in found]
    start = F.least(*found) if len(found) > 1 else found[0]
    ends = ends.select(key, "at", "nth", "covered", F.when(sum(there[1:], there[0]) == F.col("covered"), start).alias("start"))
    before = F.lag("start.at").over(so_far)
    ends = ends.withColumn("before", before).where("start IS NOT NULL AND (before IS NULL OR start.at > before)")
    return ends.select(key, "covered", F.col("start.at").alias("first"), F.col("at").alias("last"), (F.col("at") - F.col("start.at") - F.col("nth") + F.col("start.nth")).alias("noise"))


def by_cover_density(index: DataFrame, key: str, terms: Sequence[str], k: int) -> DataFrame:
    """Texts with all terms; if there is none, with any.  Ranked by how many terms they
    hold, then by cover density, then by key."""
    wanted = list(dict.fromkeys(terms))
    if not wanted:
        raise ValueError("a query has a term at least")
    scored = covers(index, key, wanted).groupBy(key, "covered").agg(F.count("*").alias("covers"), F.round(F.sum(1 / (1 + F.col("noise"))), 6).alias("score"))
    best = scored.agg(F.max("covered").alias("best"))
    strict = scored.join(F.broadcast(best), (F.col("best") < len(wanted)) | (F.col("covered") == len(wanted)))  # one row
    return top(strict.drop("best"), [F.col("covered").desc(), F.col("score").desc(), F.col(key)], k, most=50)
