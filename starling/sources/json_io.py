"""The JSON form of a collection: {version, dim, metric, vectors: [{id, vector, metadata?}]}."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starling.errors import CorruptData, DimensionMismatch

DOCUMENT = "version int, dim int, metric string, vectors array<struct<id: string, vector: array<float>, metadata: variant>>"


def records_to_json(records: DataFrame, dim: int, metric: str, pretty: bool = False) -> str:
    """One document, gathered on the driver; metadata is left out where there is none."""
    vectors = []
    for r in records.orderBy("id").toLocalIterator():
        vectors.append({"id": r["id"], "vector": list(r["vector"])} | ({} if r["metadata"] is None else {"metadata": json.loads(r["metadata"])}))
    return json.dumps({"version": 1, "dim": dim, "metric": metric, "vectors": vectors}, indent=2 if pretty else None)


def rows_of_document(document: str) -> tuple[dict, list, list, list]:
    try:
        head = json.loads(document)
        vectors = head.pop("vectors")
        ids, values = [v["id"] for v in vectors], [v["vector"] for v in vectors]
        head["dim"], head["metric"]
    except (ValueError, KeyError, TypeError) as e:
        raise CorruptData(f"no collection document: {e}") from e
    for v in values:
        if len(v) != head["dim"]:
            raise DimensionMismatch(head["dim"], len(v))
    return head, ids, values, [v.get("metadata") for v in vectors]


def read_head(spark: SparkSession, path: str) -> dict:
    """dim and metric of a document in a file."""
    row = spark.read.schema("dim int, metric string").json(path, multiLine=True).first()
    if row is None or row["dim"] is None or row["metric"] is None:
        raise CorruptData(f"{path}: no collection document")
    return row.asDict()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Records of files with a JSON object per line: id, vector, metadata."""
    return spark.read.schema("id string, vector array<float>, metadata variant").json(path).select("id", "vector", F.to_json("metadata").alias("metadata"))


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """Records of documents in files, read and exploded by the tasks: id, vector, metadata."""
    rows = spark.read.schema(DOCUMENT).json(path, multiLine=True).select(F.explode("vectors").alias("v"))
    return rows.select("v.id", "v.vector", F.to_json("v.metadata").alias("metadata"))
