"""Nearest-neighbour search, k-NN join, range join and near-duplicate pairs over records (id, vector, metadata).

One query is a column expression under TakeOrderedAndProject. Up to QUERY_BLOCK
queries are shipped to the tasks, each of which keeps the best k of all its rows for
each query. More queries meet the rows in cells of bounded size, and never pass
through the driver. Ties go to the smaller id everywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starling.functions.distance import as_double, check_vector, distance, distance_matrix, parse_metric
from starling.functions.filters import metadata_filter

#: Queries shipped, at most, and distances a task holds at a time.
QUERY_BLOCK, HELD = 4096, 4_000_000
#: Rows and queries that meet in one task where queries aren't shipped.
CELL_ROWS, CELL_QUERIES = 20_000, 50_000


def _where(records: DataFrame, where) -> DataFrame:
    if where is None:
        return records
    return records.where(where if isinstance(where, Column) else metadata_filter(where))


def search(records: DataFrame, vector, k: int = 10, metric: str = "cosine", where=None, max_distance: float | None = None) -> DataFrame:
    """id, distance, metadata of the k records nearest to the vector, of those that `where` (a filter or a column) keeps.

    max_distance, inclusive, is applied after the k are chosen."""
    if k < 0:
        raise ValueError("k must not be negative")
    query = F.array(*[F.lit(x) for x in check_vector(vector)])
    found = _where(records, where).select("id", distance(metric, "vector", query).alias("distance"), "metadata").orderBy("distance", "id").limit(k)
    return found if max_distance is None else found.where(F.col("distance") <= max_distance)


def _matrix(column, n: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(n, -1)


def _first(i: np.ndarray, d: np.ndarray, ties: np.ndarray, k: int) -> np.ndarray:
    """Places of each i's k smallest by distance and then by ties, in that order."""
    order = np.lexsort((ties, d, i))
    grouped = i[order]
    return order[np.arange(len(grouped)) - np.searchsorted(grouped, grouped) < k]


def nearest(k: int):
    """Picks (i, j) of the k smallest of each row of a matrix of distances, ties to the smaller j."""

    def pick(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if k == 0:
            return np.zeros(0, int), np.zeros(0, int)
        i, j = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k] if d.shape[1] > k else np.ones(d.shape, bool))
        kept = _first(i, d[i, j], j, k)
        return i[kept], j[kept]

    return pick


class _Best:
    """The k nearest rows so far of each of n queries; rows that no query needs any more are let go."""

    def __init__(self, n: int, k: int):
        self.n, self.k, self.rows, self.bound = n, k, None, np.full(n, np.inf)
        self.i, self.d, self.at = np.zeros(0, int), np.zeros(0), np.zeros(0, int)
        self.merged = 0

    def add(self, i: np.ndarray, j: np.ndarray, d: np.ndarray, part: pa.Table) -> None:
        near = d <= self.bound[i]
        used, at = np.unique(j[near], return_inverse=True)
        if not len(used):
            return
        held = 0 if self.rows is None else self.rows.num_rows
        part = part.take(pa.array(used))
        self.rows = part if self.rows is None else pa.concat_tables([self.rows, part])
        self.i, self.d, self.at = np.concatenate([self.i, i[near]]), np.concatenate([self.d, d[near]]), np.concatenate([self.at, at + held])
        if len(self.i) > self.merged + self.n * self.k:
            self.merge()

    def merge(self) -> None:
        if self.rows is None:
            return
        rank = np.empty(self.rows.num_rows, int)
        rank[pc.sort_indices(self.rows["id"]).to_numpy()] = np.arange(len(rank))
        kept = _first(self.i, self.d, rank[self.at], self.k)
        self.i, self.d, at = self.i[kept], self.d[kept], self.at[kept]
        used, self.at = np.unique(at, return_inverse=True)
        self.rows = self.rows.take(pa.array(used)).combine_chunks()
        counts = np.bincount(self.i, minlength=self.n)
        ends = np.cumsum(counts) - 1
        self.bound = np.where(counts == self.k, self.d[np.maximum(ends, 0)], np.inf)
        self.merged = len(self.i)

    def batches(self, q_ids: pa.Array):
        self.merge()
        for at in range(0, len(self.i), 10_000):
            i, d, rows = self.i[at : at + 10_000], self.d[at : at + 10_000], self.rows.take(pa.array(self.at[at : at + 10_000]))
            columns = [c.combine_chunks() for c in rows.columns]
            yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(i)), columns[0], pa.array(d), *columns[1:]], ["query_id", "id", "distance", *rows.column_names[1:]])


def _schema(records: DataFrame, queries: DataFrame, with_metadata: bool) -> str:
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return f"query_id {kind(queries, 'query_id')}, id {kind(records, 'id')}, distance double" + (f", metadata {kind(records, 'metadata')}" if with_metadata else "")


def _shipped(rows: DataFrame, asked: DataFrame, metric: str, schema: str, k: int | None, max_distance: float | None) -> DataFrame:
    """Rows near the few queries (query_id, q): the k nearest in each task, or all within max_distance."""
    table = asked.toArrow()
    if not table.num_rows:
        return rows.sparkSession.createDataFrame([], schema)
    shipped = rows.sparkSession.sparkContext.broadcast((table["query_id"].combine_chunks(), _matrix(table["q"], table.num_rows)))

    def kernel(batches):
        q_ids, q = shipped.value
        best, step = _Best(len(q), k or 0), max(1, HELD // len(q))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = pa.Table.from_batches([batch.slice(at, step)])
                if k is not None:
                    part = part.take(pc.sort_indices(part["id"]))
                d = distance_matrix(metric, q, _matrix(part["v"], part.num_rows))
                i, j = np.nonzero(d <= max_distance) if k is None else nearest(k)(d)
                part = part.drop_columns("v")
                if k is not None:
                    best.add(i, j, d[i, j], part)
                else:
                    yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(i)), part["id"].combine_chunks().take(pa.array(j)), pa.array(d[i, j])], ["query_id", "id", "distance"])
        yield from best.batches(q_ids)

    return rows.mapInArrow(kernel, schema)


def meet(asked: DataFrame, rows: DataFrame, cell: list[str], metric: str, schema: str, pick) -> DataFrame:
    """What pick(distances) takes of the queries (query_id, q) and rows (id, v[, metadata]) of each cell, columns of the matrix in order of id."""
    metadata = ["metadata"] if "metadata" in rows.columns else []

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        right, i, j, distances = right.take(pc.sort_indices(right["id"])), [], [], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            q, x = _matrix(left["q"], left.num_rows), _matrix(right["v"], right.num_rows)
            step = max(1, HELD // len(x))
            for at in range(0, len(q), step):
                d = distance_matrix(metric, q[at : at + step], x)
                near, to = pick(d)
                i.append(near + at)
                j.append(to)
                distances.append(d[near, to])
        i, j = (pa.array(np.concatenate([np.zeros(0, int), *places])) for places in (i, j))
        return pa.table({"query_id": left["query_id"].take(i), "id": right["id"].take(j), "distance": np.concatenate(distances)} | {c: right[c].take(j) for c in metadata})

    return asked.groupBy(*cell).cogroup(rows.groupBy(*cell)).applyInArrow(kernel, schema)


def _joined(records: DataFrame, queries: DataFrame, metric: str, query_id: str, vector: str, k: int | None, max_distance: float | None, with_metadata: bool) -> DataFrame:
    """(query_id, id, distance[, metadata]) of at least the k nearest records to each query, or of all within max_distance."""
    metric, columns = parse_metric(metric), ["metadata"] if with_metadata else []
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(query_id).alias("query_id"), as_double(vector).alias("q"))
    rows = records.where(F.col("vector").isNotNull()).select("id", F.col("vector").alias("v"), *columns)
    schema, n = _schema(rows, asked, with_metadata), asked.count()
    if n <= QUERY_BLOCK:
        return _shipped(rows, asked, metric, schema, k, max_distance)
    row_parts = max(1, -(-rows.count() // CELL_ROWS))
    busy = min(-(-rows.sparkSession.sparkContext.defaultParallelism // row_parts), n // 1000)  # cells for all cores where there are few
    parts = {"query_part": max(-(-n // CELL_QUERIES), busy), "row_part": row_parts}
    own = lambda c, part: F.pmod(F.xxhash64(c), F.lit(parts[part])).alias(part)
    every = lambda part: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts[part] - 1).cast("long"))).alias(part)
    asked = asked.select("query_id", "q", own("query_id", "query_part"), every("row_part"))
    rows = rows.select("id", "v", *columns, own("id", "row_part"), every("query_part"))
    return meet(asked, rows, ["query_part", "row_part"], metric, schema, nearest(k) if k is not None else lambda d: np.nonzero(d <= max_distance))


def search_many(records: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", where=None, max_distance: float | None = None, query_id: str = "query_id", vector: str = "vector", with_metadata: bool = True) -> DataFrame:
    """k-NN join: query_id, rank (from 1), id, distance, metadata of each query's k nearest records; queries without a vector have none."""
    if k < 0:
        raise ValueError("k must not be negative")
    found = _joined(_where(records, where), queries, metric, query_id, vector, k, None, with_metadata)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    if max_distance is not None:
        found = found.where(F.col("distance") <= max_distance)
    return found.select("query_id", "rank", "id", "distance", *(["metadata"] if with_metadata else []))


def range_join(records: DataFrame, queries: DataFrame, max_distance: float, metric: str = "cosine", where=None, query_id: str = "query_id", vector: str = "vector") -> DataFrame:
    """query_id, id, distance of every record within max_distance of a query: no limit on their number."""
    return _joined(_where(records, where), queries, metric, query_id, vector, None, max_distance, False)


def duplicate_pairs(records: DataFrame, threshold: float, k: int = 5, metric: str = "cosine") -> DataFrame:
    """query_id, id, distance: of each record's k nearest (itself among them) the others that are nearer than threshold."""
    queries = records.select(F.col("id").alias("query_id"), "vector")
    near = search_many(records, queries, k, metric, with_metadata=False)
    return near.where((F.col("distance") < threshold) & (F.col("query_id") != F.col("id"))).select("query_id", "id", "distance")


def greedy_groups(pairs: DataFrame) -> list[list]:
    """Groups as a greedy pass in order of id makes them: an unseen record takes its unseen neighbours.

    The order decides the result, so the pairs, which must be few, are walked on the driver."""
    near: dict = {}
    for r in pairs.select("query_id", "id").orderBy("query_id", "distance", "id").toLocalIterator():
        near.setdefault(r[0], []).append(r[1])
    seen, groups = set(), []
    for one in sorted(near):
        if one in seen:
            continue
        group = [one, *[x for x in near[one] if x not in seen]]
        if len(group) > 1:
            seen.update(group)
            groups.append(group)
    return groups


def recall(found: DataFrame, truth: DataFrame, query_id: str = "query_id") -> DataFrame:
    """query_id, recall: which share of the true ids was found."""
    hit = truth.join(found.select(query_id, "id", F.lit(1).alias("hit")), [query_id, "id"], "left")
    return hit.groupBy(query_id).agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"))
