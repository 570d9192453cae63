"""What the operators of this package share: tables, and cuts of lineage that survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Learned labels come only from rows whose crc32(doc_id as text) modulo FOLDS is not 0.
FOLDS = 5


#: Rows of an Arrow batch, at most: texts may be long, and a batch is held as a whole by the JVM and by a worker.
BATCH_ROWS = 500


def bound_batches(spark: SparkSession) -> None:
    """Keeps batches of texts small, unless the session has them smaller still."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def release() -> None:
    """Gives memory back that a worker no longer uses, as it waits for its next task with all it has."""
    import ctypes
    import sys

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only a local master without that setting gets a temporary folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="starling-")
        atexit.register(shutil.rmtree, base[7:], True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def store(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: a cut of the lineage that lost executors don't undo."""
    bound_batches(spark := df.sparkSession)
    df.write.parquet(path := fresh_path(spark, tag))
    return spark.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, name: str) -> str:
    """The name, or that with as many underscores before it as it takes to be none of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def held_out(id_col) -> F.Column:
    """True where labels may not be learned from."""
    return F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0


def bounded_broadcast(df: DataFrame, rows: int, known: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has `rows` rows at most (counted, unless known); else df, for a shuffled join."""
    return F.broadcast(df) if (df.count() if known is None else known) <= rows else df


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text and label (0 or 1) of labelled rows outside the held-out fold; a hash of the id picks max_rows ids at most.

    Rows without id or label are left out; an id with several labels has the largest."""
    chosen = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(max_rows)
    )
    chosen = F.broadcast(store(chosen, f"labels-{label_col}"))  # max_rows rows at most
    return store(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id").select("text", "label"), f"sample-{label_col}")
