"""Connected components of links held in a DataFrame, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.llm.common import store


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (id, label): every id of a link with the smallest id it can reach. Nothing is gathered on the driver."""
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    both = store(both, "components-links")
    labels = store(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "components-labels")
    while True:
        # Each id, and the id it is labelled with, takes the least label around it; then labels are followed one step.
        own = labels.select(F.col("id").alias("a"), F.col("label").alias("top"))
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near")).join(own, "a")
        offers = near.select(F.explode(F.array("a", "top")).alias("id"), "near").groupBy("id").agg(F.min("near").alias("near"))
        # Stored, so that Spark can split the partition of a label that many ids have.
        lower = store(labels.join(offers, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label")), "components-lower")
        jump = lower.select(F.col("id").alias("label"), F.col("label").alias("further"))
        new = store(lower.join(jump, "label").select("id", "was", F.least("label", "further").alias("label")), "components-labels")
        labels = new.select("id", "label")
        if new.where("label <> was").isEmpty():
            return labels
