"""Minimax contiguous partition of documents into shards, from DataFrame operations alone.

Documents with equal texts form one atomic group. Groups are ordered by the
SHA-256 of their text, and shards are contiguous ranges of that order, so a
document's shard follows from at most ``n_shards - 1`` cut keys: no join, and no
group is ever gathered in one task. The smallest capacity for which a greedy
filling needs no more than ``n_shards`` shards is found by binary search.

The driver never holds the groups. It holds sums of *cells*, which are ranges of
groups with a common hash prefix. A greedy filling over cells brackets where each
cut can lie; only the cells in which some cut is still open are split further,
sixteen-fold each round, until those cells are single groups. What the driver
gets in a round is bounded by shards and FIRST_HEX, not by the data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starling.llm.common import store

#: Hex digits of a cell's prefix at first: 4,096 cells.
FIRST_HEX = 3
#: Parts of a shard for numbering its rows; 16 shards make 65,536 sums, which are broadcast.
SLOT_CELLS = 4096


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and group key of each row; a null text has size 1, checksum 0 and a key of its own."""
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
        F.coalesce(F.sha2(text.cast("binary"), 256), F.lit("")).alias("key"),
    )


def group_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.sum("size").alias("size"))


class _Cells:
    """Sorted cells with their sums; single tells which are one group."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        rows = sorted(rows)
        self.prefix = [r[0] for r in rows]
        self.size = [r[1] for r in rows]
        self.single = [r[2] == 1 for r in rows]
        self.end = np.cumsum(np.array(self.size, dtype=np.int64)) if rows else np.zeros(0, np.int64)
        self.start = self.end - np.array(self.size, dtype=np.int64)
        self.total = int(self.end[-1]) if rows else 0

    def cuts(self, capacity: int, n: int, hopeful: bool) -> list[int]:
        """Where n shards of this capacity end at the most (hopeful) or at the least, as sizes before that end."""
        at, out = 0, []
        for _ in range(n):
            k = int(np.searchsorted(self.end, at + capacity, side="right"))  # cells that end within reach
            if k == len(self.size):
                at = self.total
            elif hopeful and not self.single[k]:
                at = max(at, at + capacity)
            else:
                at = max(at, int(self.end[k - 1]) if k else 0)
            out.append(min(at, self.total))
        return out

    def feasible(self, capacity: int, n: int, hopeful: bool) -> bool:
        return not self.size or self.cuts(capacity, n, hopeful)[-1] >= self.total

    def smallest(self, n: int, hopeful: bool, low: int, high: int) -> int:
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.feasible(mid, n, hopeful) else (mid + 1, high)
        return low


def minimax_cuts(groups: DataFrame, n_shards: int) -> tuple[int, list[str]]:
    """The smallest feasible capacity, and the keys at which shards 1, 2, ... begin (fewer, if fewer shards are filled)."""

    def cells(df: DataFrame, digits: int) -> list[tuple[str, int, int]]:
        return [tuple(r) for r in df.groupBy(F.substring("key", 1, digits).alias("cell")).agg(F.sum("size"), F.count(F.lit(1))).collect()]

    known = _Cells(cells(groups, FIRST_HEX))
    if not known.size:
        return 0, []
    while True:
        floor = max(-(-known.total // n_shards), max((s for s, one in zip(known.size, known.single) if one), default=1))
        least = known.smallest(n_shards, True, floor, known.total)  # no smaller capacity can do
        most = known.smallest(n_shards, False, least, known.total)  # this one surely does
        lows, highs = known.cuts(least, n_shards, False), known.cuts(most, n_shards, True)
        open_cells = {
            known.prefix[k]
            for a, b in zip(lows, highs)
            for k in range(int(np.searchsorted(known.end, a, side="right")), min(len(known.size) - 1, int(np.searchsorted(known.start, b, side="left"))) + 1)
            if not known.single[k]
        }
        if not open_cells:
            break
        finer = []
        for digits in sorted({len(c) for c in open_cells}):
            inside = groups.where(F.substring("key", 1, digits).isin(sorted(c for c in open_cells if len(c) == digits)))
            finer += cells(inside, digits + 1)
        known = _Cells([r for r in zip(known.prefix, known.size, (1 if s else 2 for s in known.single)) if r[0] not in open_cells] + finer)
    ends = sorted({e for e in known.cuts(most, n_shards, False) if e < known.total})
    return most, [known.prefix[int(np.searchsorted(known.start, e, side="left"))] for e in ends]


def assign_shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot and grown_shard (null under this law) of every row.

    Rows with equal texts, null counting as a text, share a shard. Repeated rows
    each get a slot. An empty table gives no rows; with fewer groups than shards
    the last shards stay empty. Other columns of docs are ignored, whatever their
    names. Slots number a shard's rows from 0 without gaps.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    rows = store(digests(docs, id_col, text_col), "shard-rows")
    groups = store(group_sizes(rows), "shard-groups")
    _, keys = minimax_cuts(groups, n_shards)
    shard = F.lit(0)
    for key in keys:
        shard = shard + (F.col("key") >= F.lit(key)).cast("int")
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("cell", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SLOT_CELLS)).cast("int"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "key")
    numbered = placed.withColumn("nth", F.row_number().over(inside))
    if n_shards * SLOT_CELLS <= 1 << 20:
        offsets = F.broadcast(offsets)  # n_shards * SLOT_CELLS rows at most
    return numbered.join(offsets, ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("offset") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
