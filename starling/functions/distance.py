"""Distances between vectors: column expressions for one query, a numpy kernel for many.

All are computed in double precision, and lower is nearer: cosine distance is 1 - cos,
and 1 if either vector has no length; euclidean is squared; dot_product is negated.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from starling.errors import InvalidMetric, InvalidVector

NAMES = {"cosine": "cosine", "euclidean": "euclidean", "l2": "euclidean", "dot": "dot_product", "dot_product": "dot_product"}


def parse_metric(name: str) -> str:
    if name not in NAMES:
        raise InvalidMetric(name)
    return NAMES[name]


def check_vector(vector, dim: int | None = None) -> list[float]:
    """The vector as floats; it must have components, all finite, dim of them if given."""
    from starling.errors import DimensionMismatch

    out = [float(x) for x in vector]
    if not out or not all(map(math.isfinite, out)):
        raise InvalidVector("a vector needs components, all of them finite")
    if dim is not None and len(out) != dim:
        raise DimensionMismatch(dim, len(out))
    return out


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + x)


def as_double(vector) -> Column:
    return (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")


def dot(a, b) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(_sum(F.transform(as_double(a), lambda x: x * x)))


def cosine_distance(a, b, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    lengths = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(lengths > 0, 1 - dot(a, b) / lengths).otherwise(F.lit(1.0))


def euclidean_distance_sq(a, b) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def neg_dot_product(a, b) -> Column:
    return -dot(a, b)


def distance(metric: str, a, b) -> Column:
    return {"cosine": cosine_distance, "euclidean": euclidean_distance_sq, "dot_product": neg_dot_product}[parse_metric(metric)](a, b)


def distance_matrix(metric: str, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distances of each query to each row, by one matrix product where the metric allows."""
    q, x = np.asarray(queries, dtype=np.float64), np.asarray(rows, dtype=np.float64)
    metric = parse_metric(metric)
    product = q @ x.T
    if metric == "dot_product":
        return -product
    if metric == "cosine":
        lengths = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
        return np.where(lengths > 0, 1 - product / np.where(lengths > 0, lengths, 1), 1.0)
    squares = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * product
    close = squares < 1e-6 * ((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :])
    i, j = np.nonzero(close)  # cancellation: those few are computed directly
    squares[i, j] = ((q[i] - x[j]) ** 2).sum(1)
    return np.maximum(squares, 0)
