"""Following a collection's log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from starling.sources.collection import Collection
from starling.sources.oplog import LOG, latest


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """The operations in a folder of log segments, as they arrive."""
    return spark.readStream.schema(LOG).option("recursiveFileLookup", "true").parquet(path)


def upsert_stream(source: DataFrame, target: Collection, checkpoint: str, order_col: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Upserts each micro-batch of records (id, vector, metadata) into a collection.

    Of an id that a batch holds twice the last by order_col counts. A batch that is
    run again after a failure leaves the same state, as upserts replace records."""

    def write(batch: DataFrame, _: int) -> None:
        rows = latest(batch, order_col) if order_col else batch
        if not rows.isEmpty():
            target.upsert_many(rows.select("id", "vector", "metadata"))

    stream = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()
