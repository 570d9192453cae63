"""Scalar quantization of vectors to eight bits a component."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def train(vectors: DataFrame, vector_col: str = "vector") -> DataFrame:
    """pos, low and scale of each dimension: scale is the range over 255, or 1 where the range is 0."""
    each = vectors.select(F.posexplode(F.col(vector_col).cast("array<double>")).alias("pos", "v"))
    range_of = each.groupBy("pos").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    spread = (F.col("high") - F.col("low")) / 255
    return range_of.select("pos", "low", F.when(spread == 0, F.lit(1.0)).otherwise(spread).alias("scale"))


def parameters(trained: DataFrame) -> tuple[list[float], list[float]]:
    """Lows and scales by dimension, on the driver: as many rows as a vector has components."""
    rows = sorted(trained.collect(), key=lambda r: r["pos"])
    return [r["low"] for r in rows], [r["scale"] for r in rows]


def _literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def quantize(vector, low: list[float], scale: list[float]) -> Column:
    """Codes from 0 to 255; halves are rounded up."""
    v = (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")
    steps = F.zip_with(F.zip_with(v, _literal(low), lambda x, l: x - l), _literal(scale), lambda x, s: x / s)
    return F.transform(steps, lambda x: F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(255.0)) + 0.5).cast("smallint"))


def dequantize(codes, low: list[float], scale: list[float]) -> Column:
    c = F.col(codes) if isinstance(codes, str) else codes
    return F.zip_with(F.zip_with(c, _literal(scale), lambda q, s: q.cast("double") * s), _literal(low), lambda x, l: x + l)
