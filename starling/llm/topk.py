"""Exact top-k by integer inner product, with block-at-a-time pruning.

Candidates lie in blocks: ranges of rows, near ones together. A component is split
into two terms by sign, and a block's maxima of all terms (its largest and least
value in each dimension) bound the score that a query can reach in it. Each query
visits its blocks by falling bound, scores a block through its forward index (one
matrix product for all queries that want the block), and drops blocks whose bound
is below its k-th score so far. Scores are integers, so nothing is rounded.

A block of queries of a fixed size is shipped to the tasks, which search what they
read. More queries never pass the driver: parts of them meet parts of the candidates
in cells of bounded size. A first k-th score comes from the queries of a part
themselves, which are candidates too, so tasks return few rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starling.llm.common import store

#: Queries shipped, at most, rows of a block, rows that a task holds at a time, blocks that each query visits in its own order.
QUERY_BLOCK, BLOCK_ROWS, HELD_ROWS, OWN_ORDER = 8192, 256, 65_536, 3
#: Queries of a cell, about; its rows are HELD_ROWS, about.
CELL_QUERIES = 16_384

FOUND = "query_id long, vec_id long, score long"


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and floor(64 * x) of each component; without vectors that are null or hold null or non-finite components."""
    ok = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(ok)
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(F.lit(64.0) * x.cast("double")).cast("long")).alias("q"))


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as int64; shorter ones are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    width = max(width or 0, int(lengths.max(initial=0)))
    values = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()] if len(column) else np.zeros(0, np.int64)
    if len(values) == len(column) * width:
        return values.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def _exact_type(a: np.ndarray, b: np.ndarray):
    """The fastest type in which no inner product of rows of a and b is rounded."""
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object


class TopK:
    """The best k of each query so far; ties go to the smaller id."""

    def __init__(self, n_queries: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.q, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.more: list = []
        self.waiting = 0

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if len(q):
            self.more.append((q, ids, score))
            self.waiting += len(q)
            if self.waiting > 400_000:
                self.settle()

    def settle(self) -> None:
        if not self.more:
            return
        q, ids, score = (np.concatenate(x) for x in zip((self.q, self.id, self.score), *self.more))
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        last = place == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], score[last])
        keep = place < self.k
        self.q, self.id, self.score, self.more, self.waiting = q[keep], ids[keep], score[keep], [], 0


NOTHING = -(1 << 62)


def search_rows(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, best: TopK, stats: dict | None = None) -> None:
    """Adds what rows hold to best. stats, if given, counts (query, block) pairs and those that were scored."""
    if not len(rows) or not len(queries):
        return
    width = max(queries.shape[1], rows.shape[1])
    queries, rows = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in (queries, rows))
    kind = _exact_type(queries, rows)
    # Near rows together: by the largest component and its sign, then by the next largest.
    big = np.argsort(-np.abs(rows), axis=1, kind="stable")[:, :2]
    signs = np.take_along_axis(rows, big, 1) > 0
    order = np.lexsort((*(2 * big + signs).T[::-1],)) if rows.shape[1] > 1 else np.argsort(rows[:, 0] if rows.shape[1] else ids)
    rows, ids = rows[order], ids[order]
    starts = np.arange(0, len(rows), BLOCK_ROWS)
    high, low = np.maximum.reduceat(rows, starts), np.minimum.reduceat(rows, starts)
    q, r = queries.astype(kind), rows.astype(kind)
    bound = np.maximum(q, 0) @ high.astype(kind).T + np.minimum(q, 0) @ low.astype(kind).T
    todo = np.ones(bound.shape, bool)

    def visit(block: int, who: np.ndarray) -> None:
        at = starts[block]
        score = (q[who] @ r[at : at + BLOCK_ROWS].T).astype(np.int64)
        i, j = np.nonzero(score >= best.floor[who][:, None])
        own = query_ids[who[i]] != ids[at + j]
        best.add(who[i][own], ids[at + j][own], score[i, j][own])
        todo[who, block] = False
        if stats is not None:
            stats["scored"] = stats.get("scored", 0) + len(who)

    if stats is not None:
        stats["pairs"] = stats.get("pairs", 0) + bound.size
    own_order = np.argsort(-bound, axis=1, kind="stable")[:, :OWN_ORDER]
    for turn in range(own_order.shape[1]):
        for block in np.unique(own_order[:, turn]):
            who = np.flatnonzero((own_order[:, turn] == block) & (bound[:, block] >= best.floor))
            if len(who):
                visit(int(block), who)
        best.settle()
    for n, block in enumerate(np.argsort(-bound.astype(float).mean(axis=0), kind="stable")):
        who = np.flatnonzero(todo[:, block] & (bound[:, block] >= best.floor))
        if len(who):
            visit(int(block), who)
        if n % 8 == 7:
            best.settle()
    best.settle()


def first_floor(queries: np.ndarray, query_ids: np.ndarray, k: int) -> np.ndarray:
    """For each query a score that k other queries reach; the k-th of all candidates is no lower."""
    best = TopK(len(queries), k, np.full(len(queries), NOTHING))
    search_rows(queries, query_ids, queries[:2048], query_ids[:2048], best)
    return best.floor


def _search(queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, k: int, batches) -> pa.Table:
    """The k best of each query among the rows (vec_id, q) of all batches."""
    best, held, n = TopK(len(queries), k, floor), [], 0

    def scan():
        width = max(m.shape[1] for m, _ in held)
        search_rows(queries, query_ids, np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m, _ in held]), np.concatenate([i for _, i in held]), best)

    for batch in batches:
        held.append((_matrix(batch.column("q")), batch.column("vec_id").to_numpy()))
        n += batch.num_rows
        if n >= HELD_ROWS:
            scan()
            held, n = [], 0
    if n:
        scan()
    return pa.table({"query_id": query_ids[best.q], "vec_id": best.id, "score": best.score})


def _shipped(rows: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    """The k best of each task for the few queries (vec_id, q)."""
    part = asking.orderBy("vec_id").toArrow()
    queries, query_ids = _matrix(part.column("q")), part.column("vec_id").to_numpy()
    shipped = rows.sparkSession.sparkContext.broadcast((queries, query_ids, first_floor(queries, query_ids, k)))

    def search(batches):
        yield from _search(*shipped.value, k, batches).to_batches()

    return rows.mapInArrow(search, FOUND)


def _in_cells(rows: DataFrame, asking: DataFrame, n_queries: int, k: int) -> DataFrame:
    """The k best of each cell of queries (vec_id, q) and rows. Rows are dealt by their place, so that no repeated one fills a cell."""
    query_parts, row_parts = -(-n_queries // CELL_QUERIES), max(1, -(-rows.count() // HELD_ROWS))

    def with_floor(part: pa.Table) -> pa.Table:
        return part.append_column("floor", pa.array(first_floor(_matrix(part.column("q")), part.column("vec_id").to_numpy(), k)))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        return _search(_matrix(left.column("q")), left.column("vec_id").to_numpy(), left.column("floor").to_numpy(), k, [right] if left.num_rows and right.num_rows else [])

    dealt = lambda by, n: F.pmod(F.xxhash64(by), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = asking.select("vec_id", "q", dealt("vec_id", query_parts).alias("query_part"))
    asked = store(asked.groupBy("query_part").applyInArrow(with_floor, "vec_id long, q array<long>, query_part long, floor long"), "topk-floors")
    asked = asked.select("*", every(row_parts).alias("row_part"))
    rows = rows.select("vec_id", "q", dealt(F.monotonically_increasing_id(), row_parts).alias("row_part"), every(query_parts).alias("query_part"))
    cell = ["query_part", "row_part"]
    return asked.groupBy(*cell).cogroup(rows.groupBy(*cell)).applyInArrow(search, FOUND)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: of each row whose id is divisible by `every` the k best other rows.

    Vectors that are null, or hold null or non-finite components, take no part, nor
    do rows without id. Of repeated query ids the least vector asks; a query's own
    id is no candidate, other repeated rows each are. Shorter vectors count as
    filled up with zeros. An empty table gives no rows. Other columns are ignored."""
    rows = store(quantized(vectors, id_col, vector_col).where("vec_id is not null"), "topk-rows")
    asking = store(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("q").alias("q")), "topk-queries")
    n = asking.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = _shipped(rows, asking, k) if n <= QUERY_BLOCK else _in_cells(rows, asking, n, k)
    best_first = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
