"""Benchmark decontamination by greedy string tiling.

A benchmark item leaks into a document if tiles cover enough of the item: runs of
tokens that both hold, taken longest first, none overlapping another on either
side. Their order doesn't matter, so passages moved about are caught too.

Hashes of every window of SEED tokens of a batch of documents are joined with those
of the items, which gives the pairs that share enough seeds. A pair is tiled by
running Karp-Rabin: of hashes of all unmarked windows, which come from sums over
prefixes whatever their length, the greatest length at which both sides share one is
searched for, such windows are marked, and so on with shorter ones. Items come in
blocks of bounded size, each shipped to the tasks.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.llm.common import store

#: Tokens of a seed, which is also the shortest tile; covered share of an item that counts as a leak; bytes of item text in a block.
SEED, LEAK, BLOCK_BYTES = 4, 0.5, 16 << 20
#: Tokens of documents that are hashed at a time.
CHUNK_TOKENS = 500_000
BASE = 0x9E3779B97F4A7C15

_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def window_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hashes, modulo 2**64, of all windows of this length."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, base = np.zeros(n, np.uint64), np.uint64(BASE)
    with np.errstate(over="ignore"):
        for k in range(length):
            out = out * base + (ids[k : k + n].astype(np.uint64) + np.uint64(1))
    return out


class _Windows:
    """Hashes of the windows of any length of a sequence, and which windows hold no marked token."""

    def __init__(self, ids: np.ndarray, marked: np.ndarray, powers: np.ndarray, inverse: np.ndarray):
        self.ids, self.marked, self.inverse = ids, marked, inverse
        with np.errstate(over="ignore"):
            self.sums = np.r_[np.uint64(0), np.cumsum((ids + 2).astype(np.uint64) * powers[: len(ids)], dtype=np.uint64)]

    def count(self) -> None:
        self.marks = np.r_[0, np.cumsum(self.marked)]

    def longest(self) -> int:
        """Tokens of the longest unmarked run."""
        at = np.flatnonzero(np.r_[True, self.marked, True])
        return int(np.diff(at).max()) - 1

    def free(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the unmarked windows, and their hashes."""
        starts = np.flatnonzero(self.marks[length:] == self.marks[: len(self.marks) - length])
        with np.errstate(over="ignore"):
            return starts, (self.sums[starts + length] - self.sums[starts]) * self.inverse[starts]


def tiles(doc: np.ndarray, item: np.ndarray, least: int, ignore: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy tiling of two sequences of ids: (document, item, tokens) of each tile of `least` tokens or more.

    The longest match goes first, then the earliest in the document, then in the
    item; what is left of a match that others overlap goes on. Places of the document
    that `ignore` marks are part of no tile."""
    n = max(len(doc), len(item))
    if not n:
        return []
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE, np.uint64)], dtype=np.uint64)
        inverse = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)], dtype=np.uint64)
    d = _Windows(doc, np.zeros(len(doc), bool) if ignore is None else ignore.copy(), powers, inverse)
    i = _Windows(item, np.zeros(len(item), bool), powers, inverse)
    out, most = [], n

    def shared(length: int) -> np.ndarray:
        """Unmarked windows of the document whose hash an unmarked one of the item has."""
        starts, hashes = d.free(length)
        return starts[np.isin(hashes, i.free(length)[1])]

    while True:
        d.count()
        i.count()
        most = min(most, d.longest(), i.longest())
        if most < least or not len(shared(least)):
            return out
        low = least  # windows are shared at `low`, and not at `high`
        high, step = most + 1, 1
        while low + step < high:  # most tiles are short
            if not len(shared(low + step)):
                high = low + step
                break
            low, step = low + step, 2 * step
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if len(shared(middle)) else (low, middle)
        places: dict[int, list[int]] = {}
        for start, h in zip(*(x.tolist() for x in i.free(low))):
            places.setdefault(h, []).append(start)
        starts, hashes = d.free(low)
        held = np.isin(hashes, np.fromiter(places, np.uint64, len(places)))
        for start, h in zip(starts[held].tolist(), hashes[held].tolist()):
            if not places[h] or d.marked[start : start + low].any():
                continue
            rest = [p for p in places[h] if not i.marked[p : p + low].any()]
            at = next((p for p in rest if np.array_equal(d.ids[start : start + low], i.ids[p : p + low])), None)
            places[h] = rest
            if at is not None:
                d.marked[start : start + low] = i.marked[at : at + low] = True
                out.append((start, at, low))
        most = low - 1


class ItemIndex:
    """Items of one block, with the hashes of their windows.

    An item of fewer tokens than a seed is only found in a text that is that item, an item without tokens nowhere."""

    def __init__(self, items: list[tuple[int, str | None]], leak: float = LEAK):
        self.leak, self.word, self.items, self.short = leak, {}, [], {}
        hashes, whose = [], []
        for item_id, text in sorted(items, key=lambda x: (x[0], x[1] or "")):
            said = tokens(text)
            if 0 < len(said) < SEED:
                self.short.setdefault(tuple(said), []).append(item_id)
            elif said:
                ids = np.array([self.word.setdefault(w, len(self.word)) for w in said], dtype=np.int64)
                h = window_hashes(ids, SEED)
                hashes.append(h)
                whose += [len(self.items)] * len(h)
                self.items.append((item_id, ids))
        flat, whose = np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.array(whose, dtype=np.int64)
        # Each hash of an item once, with the number of its windows that have it.
        order = np.lexsort((whose, flat))
        flat, whose = flat[order], whose[order]
        first = np.flatnonzero(np.r_[True, (flat[1:] != flat[:-1]) | (whose[1:] != whose[:-1])][: len(flat)])
        self.hashes, self.whose, self.windows = flat[first], whose[first], np.diff(np.r_[first, len(flat)])
        self.own = hashes

    def find(self, texts: list[str | None]) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in texts]
        rows, size = [], 0
        for k, text in enumerate(texts):
            said = tokens(text)
            if self.short and 0 < len(said) < SEED:
                out[k] += [{"item_id": i, "n_tokens": len(said), "covered": len(said), "n_tiles": 1, "longest": len(said)} for i in self.short.get(tuple(said), ())]
            rows.append((k, np.fromiter(map(self.word.get, said, repeat(-1)), dtype=np.int64, count=len(said))))
            size += len(said)
            if size >= CHUNK_TOKENS or k == len(texts) - 1:
                self._find(rows, out)
                rows, size = [], 0
        return out

    def _find(self, rows: list[tuple[int, np.ndarray]], out: list[list[dict]]) -> None:
        flat = np.concatenate([np.r_[ids, -1] for _, ids in rows])  # -1 parts the documents
        known = np.flatnonzero(np.convolve(flat >= 0, np.ones(SEED, int), "valid") == SEED) if len(flat) >= SEED else np.zeros(0, int)
        if not len(known) or not len(self.hashes):
            return
        h = window_hashes(flat, SEED)[known]
        hit = np.isin(h, self.hashes)
        known, h = known[hit], h[hit]
        ends = np.cumsum([len(ids) + 1 for _, ids in rows])
        of_row = np.searchsorted(ends, known, side="right")
        for row in np.unique(of_row):
            a, b = np.searchsorted(of_row, [row, row + 1])
            start, seeds = int(ends[row - 1]) if row else 0, np.unique(h[a:b])
            low, high = np.searchsorted(self.hashes, seeds, "left"), np.searchsorted(self.hashes, seeds, "right")
            at = np.repeat(low - np.r_[0, np.cumsum(high - low)[:-1]], high - low) + np.arange((high - low).sum())
            windows = np.bincount(self.whose[at], self.windows[at], len(self.items))
            for item in np.flatnonzero(windows).tolist():
                item_id, ids = self.items[item]
                if windows[item] * SEED < self.leak * len(ids):
                    continue
                own = np.flatnonzero(np.isin(self.own[item], seeds))
                if len(np.unique(own[:, None] + np.arange(SEED))) < self.leak * len(ids):
                    continue  # all windows together cover too little
                here = known[a:b][np.isin(h[a:b], self.own[item])] - start
                ignore = np.ones(len(rows[row][1]), bool)
                for k in range(SEED):
                    ignore[here + k] = False
                got = tiles(rows[row][1], ids, SEED, ignore)
                covered = sum(t[2] for t in got)
                if covered >= self.leak * len(ids):
                    out[rows[row][0]].append({"item_id": item_id, "n_tokens": len(ids), "covered": covered, "n_tiles": len(got), "longest": max(t[2] for t in got)})


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[list[tuple[int, str | None]]]:
    """The items in blocks of about BLOCK_BYTES, read one at a time."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    if n > 1:
        items = store(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), "benchmark-items")
    for k in range(n):
        yield [tuple(r) for r in (items.where(F.col("block") == k).drop("block") if n > 1 else items).collect()]


def leaks_udf(index: ItemIndex):
    """text -> the items that leak into it."""
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

    fields = [("item_id", LongType(), pa.int64()), *[(n, IntegerType(), pa.int32()) for n in ("n_tokens", "covered", "n_tiles", "longest")]]
    kind = pa.list_(pa.struct([(n, a) for n, _, a in fields]))

    @F.arrow_udf(ArrayType(StructType([StructField(n, s) for n, s, _ in fields])))
    def leaks(text: pa.Array) -> pa.Array:
        return pa.array(index.find(text.to_pylist()), type=kind)

    return leaks


def find_leaks(docs: DataFrame, benchmark: DataFrame, leak: float = LEAK, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_tokens (of the item), covered, n_tiles, longest, coverage: a row for each item that leaks into a document.

    Null, empty and wordless texts leak nothing, on either side. Repeated documents
    and repeated items each give their rows. Empty tables give none. Columns beyond
    those named are ignored."""
    found = None
    for block in item_blocks(benchmark, item_col, item_text_col):
        leaks = leaks_udf(ItemIndex(block, leak)).asNondeterministic()  # else Spark filters by the result first, so searches each text twice
        rows = docs.select(F.col(id_col).alias("doc_id"), leaks(F.col(text_col)).alias("l"))
        rows = rows.select("doc_id", F.explode("l").alias("l")).select("doc_id", "l.*").withColumn("coverage", F.col("covered") / F.col("n_tokens"))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = docs.select(F.col(id_col).alias("doc_id")).where(F.lit(False)).selectExpr("doc_id", "0L item_id", "0 n_tokens", "0 covered", "0 n_tiles", "0 longest", "0D coverage")
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, leak: float = LEAK, text_col: str = "text") -> DataFrame:
    """docs without the rows into which some item leaks; columns stay as they are."""
    for block in item_blocks(benchmark):
        docs = docs.where(F.coalesce(F.size(leaks_udf(ItemIndex(block, leak))(F.col(text_col))), F.lit(0)) == 0)
    return docs
