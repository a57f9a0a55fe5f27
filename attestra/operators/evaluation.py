"""Evaluation against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def field_accuracy(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(key, correct): values are equal as numbers, else as dates, else as
    trimmed lower-case text.  What wasn't found is wrong."""
    j = truth.select(*keys, F.col("value").alias("t")).join(found.select(*keys, F.col("value").alias("f")), keys, "left")
    same = F.coalesce(F.col("t").try_cast("decimal(20,4)") == F.col("f").try_cast("decimal(20,4)"), F.try_to_date("t") == F.try_to_date("f"), F.lower(F.trim("t")) == F.lower(F.trim("f")), F.lit(False))
    return j.select(*keys, same.alias("correct"))


def precision_recall(truth: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """One row of counts, precision and recall; both are 1 without a case."""
    t, p = truth.select(key).distinct().withColumn("t", F.lit(1)), predicted.select(key).distinct().withColumn("p", F.lit(1))
    n = t.join(p, key, "full_outer").agg(F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    share = lambda other: F.when(F.col("tp") + F.col(other) == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col(other)))
    return n.select("tp", "fp", "fn", F.round(share("fp"), 6).alias("precision"), F.round(share("fn"), 6).alias("recall"))


def receipt_scores(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Receipts (number, file_name, total) found by number, else by file name."""
    by_number = found.select(F.col("number"), F.col("total").alias("t1"))
    by_name = found.where("number is null").select(F.col("file_name"), F.col("total").alias("t2"))
    j = truth.join(by_number, "number", "left").join(by_name, "file_name", "left")
    got = F.coalesce("t1", "t2")
    return j.select("number", F.when(F.col("t1").isNotNull(), "number").when(F.col("t2").isNotNull(), "name").alias("found_by"), F.coalesce(got == F.col("total"), F.lit(False)).alias("correct"))


def verdicts(scores: DataFrame, complete: str, verdict: str) -> DataFrame:
    """Verdicts withheld where a source was missing."""
    return scores.withColumn("verdict", F.when(F.col(complete), F.col(verdict)).otherwise(F.lit("WITHHELD")))
