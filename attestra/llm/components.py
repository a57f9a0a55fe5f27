"""Connected components of a table of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of links (a, b); label is the smallest node
    of the component.  Labels go to neighbours and to the node that stands for
    the neighbour's component, and are shortened by jumping, so the number of
    rounds grows with the logarithm of a chain's length.  Every round is
    written to the shared folder."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        told = labels.join(near, "node").where("m < label").select(F.explode(F.array("node", "label")).alias("node"), "m").groupBy("node").agg(F.min("m").alias("m"))
        hooked = labels.join(told, "node", "left").select("node", F.least("label", F.coalesce("m", "label")).alias("label"), F.col("label").alias("was"))
        hooked = stored(hooked, "hooked")
        if hooked.where("label < was").isEmpty():
            return labels
        upper = hooked.select(F.col("node").alias("label"), F.col("label").alias("top"))
        labels = stored(hooked.join(upper, "label").select("node", F.least("label", "top").alias("label")), "labels")
