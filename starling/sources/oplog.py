"""The state of a collection as a fold over a snapshot and a log of operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RECORD = "id string, vector array<float>, metadata string"
#: op: A adds or replaces, D deletes, U changes the vector, if not null, and the metadata, if sets_metadata.
LOG = "id string, seq long, op string, vector array<float>, metadata string, sets_metadata boolean"


def fold(snapshot: DataFrame, log: DataFrame) -> DataFrame:
    """Live records (id, vector, metadata) after the log's operations in order of seq.

    A snapshot's row counts as added before all of them. Updates and deletions of
    missing ids are ignored. Only ids that the log names are grouped; the others
    pass an anti-join."""
    touched = log.select("id").distinct()
    same = snapshot.select("id", "vector", "metadata").join(touched, "id", "left_anti")
    before = snapshot.join(touched, "id", "left_semi").select("id", F.lit(-1).cast("long").alias("seq"), F.lit("A").alias("op"), "vector", "metadata", F.lit(True).alias("sets_metadata"))
    ops = before.unionByName(log.select("id", "seq", "op", "vector", "metadata", F.coalesce("sets_metadata", F.lit(False)).alias("sets_metadata")))
    reset = F.max(F.when(F.col("op").isin("A", "D"), F.col("seq"))).over(Window.partitionBy("id"))
    since = ops.withColumn("reset", reset).where(F.col("seq") >= F.col("reset"))
    state = since.groupBy("id").agg(
        F.max_by("vector", F.when(F.col("vector").isNotNull(), F.col("seq"))).alias("vector"),
        F.max_by(F.struct("metadata"), F.when((F.col("op") == "A") | F.col("sets_metadata"), F.col("seq"))).alias("m"),
        F.max_by("op", F.when(F.col("op") != "U", F.col("seq"))).alias("op"),
    )
    return same.unionByName(state.where("op = 'A'").select("id", "vector", F.col("m.metadata").alias("metadata")))


def latest(records: DataFrame, order_col: str) -> DataFrame:
    """Of rows that share an id the last by order_col: what a batch of upserts leaves."""
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.col(order_col).desc()))
    return records.withColumn("__last", last).where("__last = 1").drop("__last")
