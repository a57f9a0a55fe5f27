"""Operators on readings: best reading, aggregates with lineage, joins that
check one source against another, ordered picks and upserts.

All stay inside Catalyst.  Aggregates keep the ids of their inputs, sorted, so
that a figure can be traced; every order has a unique last key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def given(df: DataFrame, **equal) -> DataFrame:
    """Rows that equal every parameter that isn't None."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key.  Spark limits groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def best_reading(df: DataFrame, keys: Sequence[str], confidence: str, tie: str) -> DataFrame:
    """The most confident reading of each key; ties go to the smallest tie key."""
    return first_per(df, keys, [F.col(confidence).desc_nulls_last(), F.col(tie).asc()])


def sum_with_lineage(df: DataFrame, keys: Sequence[str], value: Column, ident: str, confidence: Column) -> DataFrame:
    """Total, number, sorted input ids and least confidence; null values are skipped."""
    used = df.withColumn("_v", value).withColumn("_c", confidence).where("_v is not null")
    return used.groupBy(*keys).agg(F.sum("_v").alias("total"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(ident)).alias("inputs"), F.min("_c").alias("confidence"))


def unmatched(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "left_anti")


def outside(at: Column, start: Column, end: Column) -> Column:
    """Not within [start, end]; a null end is open, a null start too."""
    inside = (start.isNull() | (at >= start)) & (end.isNull() | (at <= end))
    return at.isNotNull() & ~inside


def outside_interval(df: DataFrame, at: Column, start: Column, end: Column) -> DataFrame:
    """Rows not within [start, end]; a null end is open, a null start too."""
    return df.where(outside(at, start, end))


def intersection(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> tuple[Column, Column]:
    """Bounds of the intersection of two intervals with open ends."""
    return F.greatest(a_start, b_start), F.least(a_end, b_end)


def repeated(df: DataFrame, keys: Sequence[str], ident: Column) -> DataFrame:
    """Keys that more than one distinct row holds."""
    found = df.groupBy(*keys).agg(F.array_sort(F.collect_set(ident)).alias("ids"))
    return found.where(F.size("ids") > 1)


def ambiguous(df: DataFrame, keys: Sequence[str], reading: Sequence[str], sample: int = 5) -> DataFrame:
    """Keys with different readings; keys match null-safely, as in any grouping."""
    found = df.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct(*reading))).alias("_r")).where(F.size("_r") > 1)
    return found.select(*keys, F.size("_r").alias("readings"), F.slice("_r", 1, sample).alias("sample"))


def reconcile(declared: DataFrame, supported: DataFrame, key: str) -> DataFrame:
    """Declared against supported amounts.  A missing amount stays missing."""
    d, s = F.col("declared"), F.col("supported")
    state = F.when(d.isNull() | s.isNull(), "incompleto").when(d == s, "cuadra").otherwise("descuadre")
    return declared.join(supported, key, "left").select(key, "declared", "supported", (d - s).alias("difference"), state.alias("state"))


def tall_to_wide(df: DataFrame, keys: Sequence[str], path: str, value: str, paths: Sequence[str]) -> DataFrame:
    """One column for each path of a fixed list, so no extra job finds them."""
    return df.groupBy(*keys).pivot(path, list(paths)).agg(F.first(value, ignorenulls=True))


def dense_index(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "row_index") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def within_budget(df: DataFrame, keys: Sequence[str], order: Sequence[Column], text: str, budget: int) -> DataFrame:
    """Texts in order until the budget of characters is used; the last is cut."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length(text)
    left = F.lit(budget) - (F.sum(size).over(w) - size)
    return df.withColumn("_left", left).where("_left > 0").withColumn("kept", F.substring(F.col(text), F.lit(1), F.col("_left").cast("int"))).drop("_left")


def top(df: DataFrame, order: Sequence[Column], k: int, offset: int = 0, most: int = 200) -> DataFrame:
    """Ordered rows with a clamped limit (planned as one top-k)."""
    df = df.orderBy(*order)
    return (df.offset(offset) if offset else df).limit(max(1, min(k, most)))


def margin(scores: Mapping[str, Column], least: float = 0.2) -> Column:
    """Best class of several scores, its score and the confidence in it."""
    ranked = F.sort_array(F.array(*[F.struct(c.alias("score"), F.lit(k).alias("kind")) for k, c in scores.items()]), False)
    best, second = ranked[0], ranked[1]
    gap = best["score"] - second["score"]
    sure = F.when(gap < least, F.least(best["score"], F.lit(0.55) + gap)).otherwise(best["score"])
    return F.struct(F.when(best["score"] > 0, best["kind"]).otherwise("UNKNOWN").alias("kind"), F.when(best["score"] > 0, sure).otherwise(0.0).alias("confidence"))


def upsert(produced: DataFrame, existing: DataFrame, keys: str | Sequence[str], scope: DataFrame | None = None) -> DataFrame:
    """What a run does to stored findings: (keys, status before, status after,
    action).  Accepted and dismissed findings are never changed; open ones that
    are no longer produced are resolved; resolved ones that come back reopen.
    A finding is named by all its keys: (dossier_id, fingerprint).  ``scope``
    names what the run has looked at, by some of the keys (the dossiers); open
    findings elsewhere are left alone."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    p = produced.select(*keys).distinct().withColumn("_p", F.lit(True))
    e = existing.select(*keys, F.col("status").alias("before"))
    both = p.join(e, keys, "full_outer")
    if scope is not None:
        both = both.join(scope.distinct().withColumn("_in", F.lit(True)), scope.columns, "left")
    looked = F.lit(True) if scope is None else F.col("_in").isNotNull() | F.col("_p").isNotNull()
    seen, kept = F.col("_p").isNotNull(), F.col("before").isin("ACCEPTED", "DISMISSED") | ~looked
    after = F.when(F.col("before").isNull(), "OPEN").when(kept, F.col("before")).when(seen, "OPEN").otherwise("RESOLVED")
    action = F.when(F.col("before").isNull(), "CREATED").when(seen & (F.col("before") == "RESOLVED"), "REOPENED").when(seen, "REFRESHED").when(looked & (F.col("before") == "OPEN"), "AUTO_RESOLVED").otherwise("KEPT")
    return both.select(*keys, "before", after.alias("after"), action.alias("action"))


def both_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one side only: (key, side)."""
    only_a = a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit("missed"))
    only_b = b.select(key).distinct().join(a.select(key), key, "left_anti").withColumn("side", F.lit("unexpected"))
    return only_a.unionByName(only_b)


def content_digest(df: DataFrame) -> DataFrame:
    """Number of rows and a digest that doesn't depend on their order."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("digest"))
