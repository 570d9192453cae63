"""Approximate search for data too large to scan: an inverted file of lists around k-means centroids.

Centroids are fitted on a bounded sample; every vector is assigned to a list and the
table is laid out by list, so a probe reads few files. Candidates are ranked by
their exact distance.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starling.functions.distance import as_double, check_vector, distance, distance_matrix, parse_metric
from starling.functions.quantize import dequantize, parameters, quantize, train
from starling.operators.search import CELL_QUERIES, CELL_ROWS, _where, meet, nearest, search, search_many

#: Vectors that the centroids are fitted on, at most.
SAMPLE = 100_000
#: Recall that the lists probed by default must reach, over so many sampled queries and for so many results; for more results than the last all lists are probed.
RECALL, QUERIES, RESULTS = 0.9, 200, (10, 100)
#: Floats in a collection below which a scan is used.
EXACT_BELOW = 10_000_000


def default_effort(k: int) -> int:
    """Candidates worth looking at for k results."""
    return max(200, k + math.floor(10 * math.sqrt(k)))


def use_exact(rows: int, dim: int) -> bool:
    return rows * dim < EXACT_BELOW


def _kmeans(x: np.ndarray, n: int, seed: int, steps: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), n, replace=False)].copy()
    for _ in range(steps):
        own = np.concatenate([distance_matrix("euclidean", part, centres).argmin(1) for part in np.array_split(x, max(1, len(x) // 4096))])
        for c in range(n):
            mine = x[own == c]
            centres[c] = mine.mean(0) if len(mine) else x[rng.integers(len(x))]
    return centres


@dataclass
class IvfIndex:
    """lists: records with list_id; sizes: list_id -> rows; needed: results -> lists to probe for them by default, as measured."""

    lists: DataFrame
    centroids: np.ndarray
    sizes: dict[int, int]
    metric: str
    needed: dict[int, int] = field(default_factory=dict)

    def order(self, vector) -> list[int]:
        """Lists that hold rows, nearest first."""
        q = np.array([check_vector(vector)])
        if self.metric == "cosine":
            q = q / max(np.linalg.norm(q), 1e-30)
        order = distance_matrix("dot_product" if self.metric == "dot_product" else "euclidean", q, self.centroids)[0].argsort(kind="stable")
        return [c for c in map(int, order) if self.sizes.get(c)]

    def probes(self, vector, k: int, effort: int | None = None) -> list[int]:
        """Nearest lists until they hold `effort` rows; without effort, as many as reach RECALL for k results."""
        order = self.order(vector)
        if effort is None:
            return order[: next((n for results, n in sorted(self.needed.items()) if k <= results), len(order))]
        out, held = [], 0
        for c in order:
            out.append(c)
            held += self.sizes[c]
            if held >= effort:
                break
        return out

    def search(self, vector, k: int = 10, effort: int | None = None, where=None, max_distance: float | None = None) -> DataFrame:
        """As search.search, over the candidates of the nearest lists.

        With a filter four times as many are looked at, and all rows if it keeps fewer than k of them."""
        probed = self.probes(vector, k, effort)
        if where is not None:
            wide = self.probes(vector, k, max(effort or default_effort(k), 4 * k) * 4)
            probed = max(probed, wide, key=len)
        found = search(self.lists.where(F.col("list_id").isin(probed)), vector, k, self.metric, where)
        if where is not None and len(probed) < len(self.sizes) and found.count() < k:
            found = search(self.lists, vector, k, self.metric, where)  # the filter keeps too few rows of the lists probed
        return found if max_distance is None else found.where(F.col("distance") <= max_distance)

    def save(self, path: str) -> None:
        """Centroids and sizes, a row per list; the lists themselves are their owner's."""
        rows = [(c, [float(x) for x in centroid], self.sizes.get(c, 0)) for c, centroid in enumerate(self.centroids)]
        self.lists.sparkSession.createDataFrame(rows, "list_id int, centroid array<double>, rows long").coalesce(1).write.parquet(path)

    @classmethod
    def load(cls, path: str, lists: DataFrame, metric: str, needed: dict) -> IvfIndex:
        """The index that save wrote, over lists; needed as it was, with keys of any kind."""
        rows = lists.sparkSession.read.parquet(path).orderBy("list_id").collect()
        return cls(lists, np.array([r["centroid"] for r in rows]), {r["list_id"]: r["rows"] for r in rows if r["rows"]}, metric, {int(k): n for k, n in needed.items()})

    def search_many(self, queries: DataFrame, k: int = 10, effort: int | None = None) -> DataFrame:
        """query_id, rank, id, distance for queries (query_id, vector), ties to the smaller id.

        Queries meet the lists that they probe in cells of bounded size, each one matrix
        product in a task, of which every query keeps its best k."""
        probing, metric = replace(self, lists=None), self.metric  # tasks can't carry a DataFrame
        kinds = [(df.schema[c].dataType.simpleString(), c) for df, c in ((queries, "query_id"), (self.lists, "id"))]
        row_parts = {c: -(-n // CELL_ROWS) for c, n in self.sizes.items()}
        query_parts = max(1, -(-queries.count() // CELL_QUERIES))

        @F.pandas_udf("array<struct<list_id: int, part: int>>")
        def cells_of(vectors: pd.Series) -> pd.Series:
            return vectors.map(lambda v: [{"list_id": c, "part": p} for c in probing.probes(v, k, effort) for p in range(row_parts[c])])

        asked = queries.select("query_id", as_double("vector").alias("q"), F.pmod(F.xxhash64("query_id"), F.lit(query_parts)).alias("query_part"))
        asked = asked.withColumn("cell", F.explode(cells_of("q"))).select("query_id", "q", "query_part", "cell.*")
        parts = F.element_at(F.create_map(*[F.lit(x) for pair in row_parts.items() for x in pair]), F.col("list_id")) if row_parts else F.lit(1)
        rows = self.lists.select("id", as_double("vector").alias("v"), "list_id", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
        rows = rows.withColumn("query_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_parts - 1).cast("long"))))

        near = meet(asked, rows, ["list_id", "part", "query_part"], metric, f"query_id {kinds[0][0]}, id {kinds[1][0]}, distance double", nearest(k))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
        return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def _needed(index: IvfIndex) -> dict[int, int]:
    """Lists to probe for each of RESULTS, so that the mean recall of sampled records, less two standard errors, is RECALL or more.

    Each is asked for its neighbours but itself, which an exact search gives with the lists they are in."""
    spark = index.lists.sparkSession
    sample = index.lists.select(F.col("id").alias("query_id"), "vector").orderBy(F.xxhash64("query_id"), "query_id").limit(QUERIES)
    rows = sample.collect()
    truth = search_many(index.lists, spark.createDataFrame(rows, sample.schema), max(RESULTS) + 1, index.metric, with_metadata=False)
    true_lists: dict = {}
    for q, _, c in truth.where("query_id <> id").join(index.lists.select("id", "list_id"), "id").select("query_id", "rank", "list_id").orderBy("query_id", "rank").collect():
        true_lists.setdefault(q, []).append(c)
    places = []
    for row in rows:
        place = {c: n for n, c in enumerate(index.order(row["vector"]))}
        places.append(np.array([place[c] for c in true_lists.get(row["query_id"], [])]))
    places, most, out = [p for p in places if len(p)], len(index.sizes), {}
    for results in RESULTS:
        for n in range(1, most + 1):
            recalls = np.array([(p[:results] < n).mean() for p in places])
            if n == most or len(recalls) and recalls.mean() - 2 * recalls.std() / math.sqrt(len(recalls)) >= RECALL:
                out[results] = n
                break
    return out


def fit(records: DataFrame, metric: str = "cosine", n_lists: int | None = None, seed: int = 0) -> np.ndarray:
    """Centroids of n_lists lists, the root of the number of rows by default, from SAMPLE rows at most; none without rows."""
    rows = records.where(F.col("vector").isNotNull())
    total = rows.count()
    taken = rows if total <= SAMPLE else rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    x = np.array([r[0] for r in taken.select(as_double("vector")).collect()], dtype=np.float64)
    if not len(x):
        return np.zeros((0, 1))
    if metric == "cosine":
        x = x / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None]
    return _kmeans(x, min(n_lists or max(1, int(math.sqrt(total))), len(x)), seed)


def list_of(centroids: np.ndarray, metric: str):
    """A function of a vector's column: the number of its list."""

    @F.pandas_udf("int")
    def assign(vectors: pd.Series) -> pd.Series:
        v = np.array(vectors.tolist(), dtype=np.float64)
        if metric == "cosine":
            v = v / np.maximum(np.linalg.norm(v, axis=1), 1e-30)[:, None]
        return pd.Series(distance_matrix("euclidean", v, centroids).argmin(1).astype("int32"))

    return assign


def over_lists(lists: DataFrame, centroids: np.ndarray, metric: str, needed: dict[int, int] | None = None) -> IvfIndex:
    """An index over records with list_id; how many lists to probe is measured unless it is given."""
    index = IvfIndex(lists, centroids, {r[0]: r[1] for r in lists.groupBy("list_id").count().collect()}, metric, needed or {})
    return index if needed or not index.sizes else replace(index, needed=_needed(index))


def by_list(lists: DataFrame) -> DataFrame:
    """Laid out by list, in files of the session's advisory size: a list much larger than others is split."""
    return lists.hint("rebalance", F.col("list_id")).sortWithinPartitions("list_id", "id")


def build_ivf(records: DataFrame, metric: str = "cosine", n_lists: int | None = None, seed: int = 0, path: str | None = None) -> IvfIndex:
    """Indexes every record and measures how many lists to probe; with a path the lists are written there, partitioned by list."""
    metric = parse_metric(metric)
    rows = records.where(F.col("vector").isNotNull())
    centroids = fit(rows, metric, n_lists, seed)
    if not len(centroids):
        return IvfIndex(rows.withColumn("list_id", F.lit(0)), np.zeros((1, 1)), {}, metric)
    lists = rows.withColumn("list_id", list_of(centroids, metric)("vector"))
    if path:
        by_list(lists).write.mode("overwrite").partitionBy("list_id").parquet(path)
        lists = records.sparkSession.read.parquet(path)
    else:
        lists = lists.persist()
    return over_lists(lists, centroids, metric)


def two_stage_search(records: DataFrame, vector, k: int = 10, metric: str = "cosine", effort: int | None = None, where=None, max_distance: float | None = None, sq8: tuple[list[float], list[float]] | None = None) -> DataFrame:
    """Ranks by distance to the eight-bit form of each vector, then the best `effort` by their full vectors.

    sq8 has lows and scales, or they are trained on records; codes are taken from a column `codes` if sq8 is given and there is one."""
    low, scale = sq8 or parameters(train(records))
    if not low:
        return search(records, vector, k, metric, where, max_distance)
    codes = F.col("codes") if sq8 and "codes" in records.columns else quantize("vector", low, scale)
    query = F.array(*[F.lit(x) for x in check_vector(vector)])
    rough = _where(records, where).withColumn("rough", distance(metric, dequantize(codes, low, scale), query))
    kept = rough.orderBy("rough", "id").limit(max(k, effort or default_effort(k)))
    return search(kept.select("id", "vector", "metadata"), vector, k, metric, None, max_distance)
