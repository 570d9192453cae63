"""Near-duplicates by HyperMinHash.

A document is the set of its distinct word shingles, as 64-bit hashes. The set's
sketch has REGISTERS registers: a hash's low bits choose the register, of the rest
the least value is kept as its count of leading zeros and MANTISSA_BITS bits after
them. Bands, fixed random choices of registers, are hashed to keys; documents of
one key are candidates.

Within a key no pairs are made. Every member is paired with the key's smallest
document, its centre; members that can't be linked to it have another in a second
round. An estimate of the Jaccard similarity from equal registers, corrected for
registers that are equal by chance, says which pairs may be links; those are
confirmed on the full sets, and confirmed links join documents into components.

Linked documents that are not joined by then share a key with several components,
so only members of such open keys matter further. Documents whose estimate with a
centre isn't FAMILY below the threshold form families with it. Of a family with several components
the members are compared on their full sets, in blocks: those outside its largest
component with all. A task gets two blocks and returns no more links than join what
it holds. Members of open keys with several families have finer bands, more and
longer ones, that miss a link by the same small chance; in those of several
families members are paired with a centre again, and where three members or more
have several components still, they are compared in blocks like a family.

Documents with equal sets are one node from the start.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.llm.common import bounded_broadcast, release, store
from starling.llm.components import components

REGISTERS, MANTISSA_BITS, EMPTY = 128, 10, -(1 << 15)
#: Chance, at most, that no band shows a link just at the threshold; bands at most.
MISS, MOST_BANDS, MOST_FINE_BANDS = 1e-7, 64, 256
#: Standard errors by which an estimate may lie below the threshold of a link.
ERRORS = 6.5
#: By how much an estimate that makes a family may lie below the threshold of a link. It decides where pairs are compared, not whether.
FAMILY = 0.25
#: Rounds of centres.
ROUNDS = 2
#: Members of a block, and shingles of all of them, about.
BLOCK, BLOCK_SHINGLES = 2_048, 600_000
#: Ids whose texts are wanted that may be broadcast to pick those; beyond, a shuffled join does it.
SETS_BROADCAST = 1_000_000
_WORDS_KEPT = 100_000

A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of fewer words, one hash of them all.

    Words are runs without ASCII white space, with A-Z lower-cased, which is what bytes.lower and bytes.split do."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = (h ^ w[i : len(w) - n + 1 + i]) * A
            h ^= h >> np.uint64(29)
        h *= C
        h ^= h >> np.uint64(32)
    return np.unique(h)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a set, as small integers: leading zeros and mantissa of each register's least value, EMPTY where none fell."""
    bits = REGISTERS.bit_length() - 1
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, (hashes & np.uint64(REGISTERS - 1)).astype(np.int64), hashes >> np.uint64(bits))
    mantissa, exponent = np.frexp(least.astype(np.float64))
    register = (64 - bits - exponent) * (1 << MANTISSA_BITS) + (mantissa * (2 << MANTISSA_BITS)).astype(np.int64) % (1 << MANTISSA_BITS)
    return np.where(least == np.iinfo(np.uint64).max, EMPTY, register + EMPTY + 1).astype(np.int16)


@dataclass(frozen=True)
class Bands:
    """Bands for sets of `least` to under `below` shingles."""

    least: int
    below: float
    registers: tuple[tuple[int, ...], ...]


@lru_cache(maxsize=8)
def band_plan(threshold: float, fine: bool = False) -> tuple[Bands, ...]:
    """Bands by size of set. Small sets leave most registers empty, so their bands have more registers.

    A set of fewer than t / (1 - t) shingles has no similar other set. Two linked sets of
    under n shingles differ in d = 2 (1 - t) (n - 1) / (1 + t) at most, each of which
    spoils one register at most; so a band of r registers is equal with a chance of
    (1 - r / REGISTERS) ** d or more. Large sets have equal registers with a chance of t each.

    Fine bands have more registers, and are more, than the others."""
    rng, out = np.random.default_rng(11), []

    def add(least: int, below: float, rows: int, equal: float) -> None:
        n = math.ceil(math.log(MISS) / math.log1p(-equal))
        out.append(Bands(least, below, tuple(tuple(sorted(map(int, rng.choice(REGISTERS, rows, replace=False)))) for _ in range(n))))

    least, rows = math.ceil(threshold / (1 - threshold) - 1e-9), REGISTERS // 2
    while rows >= 8:
        spoilt = math.floor(2 * (1 - threshold) * (2 * least - 1) / (1 + threshold) + 1e-9)
        wide = min(2 * rows, 3 * REGISTERS // 4) if fine else rows
        add(least, 2 * least, wide, (1 - wide / REGISTERS) ** spoilt)
        least, rows = 2 * least, rows // 2
    most, widest = (MOST_FINE_BANDS, 24) if fine else (MOST_BANDS, 8)
    rows = next(r for r in range(widest, 0, -1) if r == 1 or math.log(MISS) / math.log1p(-(threshold**r)) <= most)
    add(least, math.inf, rows, threshold**rows)
    return tuple(out)


def band_keys(registers: np.ndarray, sizes: np.ndarray, threshold: float, fine: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each band of each sketch in which some register is filled, by row.

    A set also has the bands of the next sizes if a set of those can be similar to it."""
    rows, keys = [], []
    largest = np.floor(sizes / threshold + 1e-9)
    plan = band_plan(threshold, fine)
    for kind, bands in enumerate(plan):
        who = np.flatnonzero((largest >= bands.least) & (sizes < bands.below) & (sizes >= plan[0].least))
        mine = registers[who]
        for band, which in enumerate(bands.registers):
            h = np.full(len(who), kind << 32 | band + 1, np.uint64)
            with np.errstate(over="ignore"):
                for i in which:
                    h = (h ^ mine[:, i].astype(np.int64).view(np.uint64)) * A
                    h ^= h >> np.uint64(29)
                h *= C
            some = (mine[:, which] != EMPTY).any(axis=1)
            rows.append(who[some])
            keys.append(h[some])
    rows, keys = np.concatenate(rows), np.concatenate(keys)
    order = np.argsort(rows, kind="stable")
    return rows[order], keys[order].view(np.int64)


def signatures(docs: DataFrame, k: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, digest of the set, registers, keys of the bands."""

    def sign(batches):
        for batch in batches:
            n, digest, registers = [], [], []
            for text in batch.column(1):
                h = shingle_hashes(text.as_py(), k)
                n.append(len(h))
                digest.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                registers.append(sketch(h))
            flat = np.concatenate(registers) if registers else np.zeros(0, np.int16)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * REGISTERS), pa.array(flat))
            of, keys = band_keys(flat.reshape(-1, REGISTERS), np.array(n, dtype=np.int64), threshold)
            ends = np.searchsorted(of, np.arange(len(n) + 1)).astype(np.int32)
            key_lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), lists, key_lists], ["doc_id", "n_shingles", "digest", "registers", "keys"])
        _words.clear()
        release()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(sign, "doc_id long, n_shingles long, digest binary, registers array<smallint>, keys array<long>")


def fine_keys(nodes: DataFrame, threshold: float) -> DataFrame:
    """nodes (node, n, registers) -> (node, key) of their fine bands."""

    def make(batches):
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy().reshape(-1, REGISTERS)
            of, keys = band_keys(flat, batch.column(1).to_numpy(), threshold, fine=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(keys)], ["node", "key"])

    return nodes.select("node", "n", "registers").mapInArrow(make, "node long, key long")


def _estimate(a: str, b: str, n: str, m: str) -> tuple[F.Column, F.Column]:
    """Jaccard similarity from registers, without what chance makes equal, and the registers it rests on.

    Two least values of n and m hashes that differ share a register with a chance near
    2**-MANTISSA_BITS * nm / (n + m)**2 / (2 ln 2)."""
    used = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != EMPTY) | (y != EMPTY)), lambda x: x))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != EMPTY) & (x == y)), lambda x: x))
    chance = F.lit(2.0**-MANTISSA_BITS / (2 * math.log(2))) * F.col(n) * F.col(m) / F.pow(F.col(n) + F.col(m), F.lit(2))
    return F.greatest(F.lit(0.0), (same / used - chance) / (1 - chance)), used


def full_sets(docs: DataFrame, ids: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(id, sets) of the rows whose id is among ids; several sets only where rows share an id."""

    def make(batches):
        for batch in batches:
            sets = [shingle_hashes(x.as_py(), k).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, type=pa.list_(pa.int64()))], ["id", "set"])
        _words.clear()
        release()

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(bounded_broadcast(ids, SETS_BROADCAST), "id", "left_semi")
    sets = store(texts.mapInArrow(make, "id long, set array<long>").where(F.size("set") > 0), "dedup-sets")
    if sets.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return sets.select("id", F.array("set").alias("sets"))
    return store(sets.groupBy("id").agg(F.collect_set("set").alias("sets")), "dedup-sets")


def _linked(num: int, den: int, both, n, m):
    return den * both >= num * (n + m - both)


def cross_links(labels: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of labels between which some set of `left` and some set of `right` are linked: no more than it takes to join them.

    Of pairs with different labels one at least hasn't the commonest label, so only such rows are held against the other side."""
    sizes, now = np.fromiter(map(len, sets), np.int64, len(sets)), labels.copy()
    values, counts = np.unique(labels, return_counts=True)
    rare = labels != values[np.argmax(counts)]
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(codes, np.cumsum(sizes)[:-1])
    mark, out = np.zeros(len(codes), bool), []
    for mine, others in ((left, right), (right, left)):
        for i in np.flatnonzero(mine & rare):
            near = np.flatnonzero(others & (now != now[i]) & _linked(num, den, np.minimum(sizes, sizes[i]), sizes[i], sizes))
            if not len(near):
                continue
            mark[own[i]] = True
            both = np.add.reduceat(mark[np.concatenate([own[j] for j in near])], np.r_[0, np.cumsum(sizes[near])[:-1]])
            mark[own[i]] = False
            for label in np.unique(now[near[_linked(num, den, both, sizes[i], sizes[near])]]):
                low, high = sorted((int(label), int(now[i])))
                out.append((low, high))
                now[now == high] = low
    return out


def _named(rows: DataFrame, label: DataFrame, name: str) -> DataFrame:
    """Rows with the label of their node under this name; it is the node if that has no link."""
    return rows.join(label.select(F.col("id").alias("node"), F.col("label").alias(name)), "node", "left").withColumn(name, F.coalesce(name, "node"))


def open_groups(rows: DataFrame, by: str, differ: str, least: int) -> DataFrame:
    """Of rows with a node, those of groups with several values of `differ` and `least` members at least; of groups of the same members, one's."""
    mixed = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("size"), F.min(differ).alias("low"), F.max(differ).alias("high"),
        F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("sum"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("xor"),
    ).where((F.col("size") >= least) & (F.col("low") < F.col("high")))
    groups = store(mixed.groupBy("size", "sum", "xor").agg(F.min(by).alias(by)).select(by), "dedup-open")
    return store(rows.join(groups, by), "dedup-members")


def near_duplicates(docs: DataFrame, k: int = 3, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row: links are den * |both| >= num * |either|.

    A text that is null, empty or without words has no shingles and no links. Of
    rows that share a doc_id each has the component of its own text; texts with the
    same smallest doc_id count as one. A row without doc_id links nothing: its
    component_id is null and it is kept. Repeated rows give repeated results, an
    empty table none, and other columns are ignored."""
    signed = store(signatures(docs, k, num / den, id_col, text_col), "dedup-signed")
    named = signed.where("doc_id is not null and n_shingles > 0")
    of_set = named.groupBy("digest").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(a) for c, a in (("n_shingles", "n"), ("registers", "registers"), ("keys", "keys"))])
    nodes = store(of_set, "dedup-nodes")
    big = nodes.where(F.size("keys") > 0)

    # What is joined on a key that many rows share is stored before, so that Spark can split that key's partition.
    banded = big.select("node", F.explode("keys").alias("key"))
    shared = store(banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key"), "dedup-shared")
    members = open_groups(store(banded.join(shared, "key").select("key", "node"), "dedup-members"), "key", "node", 2)

    size = F.least("n", "m") * den >= F.greatest("n", "m") * num
    estimate, used = _estimate("r", "s", "n", "m")
    least = F.lit(num / den) - F.lit(ERRORS * math.sqrt(num * (den - num)) / den) / F.sqrt(F.greatest(used, F.lit(1)))

    def judge(pairs: DataFrame) -> DataFrame:
        """(node, centre) with whether they may be a link, and whether they are of one family."""
        one = pairs.join(big.select("node", "n", F.col("registers").alias("r")), "node")
        two = one.join(big.select(F.col("node").alias("centre"), F.col("n").alias("m"), F.col("registers").alias("s")), "centre")
        return two.select("node", "centre", (size & (estimate >= least)).alias("maybe"), (estimate >= num / den - FAMILY).alias("near"))

    def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Those of (node, centre) that are links, as (a, b)."""
        one = pairs.select(F.col("node").alias("a"), F.col("centre").alias("b")).join(sets.select(F.col("id").alias("a"), F.col("sets").alias("x")), "a")
        two = one.join(sets.select(F.col("id").alias("b"), F.col("sets").alias("y")), "b")
        both = lambda x, y: F.size(F.array_intersect(x, y))
        link = F.exists("x", lambda x: F.exists("y", lambda y: _linked(num, den, both(x, y), F.size(x), F.size(y))))
        return store(two.where(link).select("a", "b"), "dedup-links")

    def round_of_centres(members: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Judged pairs of members (key, node, family) and centres of other families; the members that can't be linked to their key's centre."""
        centres = members.groupBy("key").agg(F.min("node").alias("centre"), F.min_by("family", "node").alias("its"), F.count(F.lit(1)).alias("size")).where("size > 1")
        centres = store(centres.select("key", "centre", "its"), "dedup-centres")
        at = store(members.join(centres, "key").where("family <> its").select("key", "node", "family", "centre"), "dedup-at-centres")
        judged = store(judge(at.select("node", "centre").distinct()), "dedup-judged")
        return judged, at.join(judged.where("not maybe").select("node", "centre"), ["node", "centre"]).select("key", "node", "family")

    judged, rest = round_of_centres(members.withColumn("family", F.col("node")))
    for _ in range(1, ROUNDS):
        more, rest = round_of_centres(store(rest, "dedup-members"))
        judged = judged.union(more)
    maybe = store(judged.where("maybe").select("node", "centre").distinct(), "dedup-maybe")
    sets = full_sets(docs, store(_ends(maybe), "dedup-wanted"), k, id_col, text_col)
    links = confirmed(maybe, sets)
    label = components(links)

    # Two documents that are linked and not joined share a key of several components. In a key of two, both have been compared.
    opened = open_groups(_named(members, label, "label"), "key", "label", 3)
    if not opened.isEmpty():
        family = components(links.union(judged.where("near").select("node", "centre")))
        opened = store(_named(opened, family, "family"), "dedup-opened")
        inside = open_groups(opened.select("family", "node", "label").distinct(), "family", "label", 2)
        outside = open_groups(opened, "key", "family", 3).select("node", "label", "family").distinct()
        fine = fine_keys(big.join(outside.select("node"), "node", "left_semi"), num / den)
        fine = open_groups(store(fine.join(outside, "node"), "dedup-fine"), "key", "family", 2)
        wanted = store(inside.select(F.col("node").alias("id")).union(fine.select("node")).distinct(), "dedup-wanted")
        sets = full_sets(docs, wanted, k, id_col, text_col)
        near = confirmed(round_of_centres(fine.select("key", "node", "family"))[0].where("maybe"), sets)
        across = open_groups(fine, "key", "family", 3)
        crossed = _crossed(inside.withColumnRenamed("family", "key"), sets, num, den).union(_crossed(across, sets, num, den))
        side = lambda c: label.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
        paired = near.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("a_label", "a"), F.coalesce("b_label", "b"))
        crossed = store(crossed.union(paired).distinct(), "dedup-crossed")
        if not crossed.isEmpty():
            merged = components(crossed).select(F.col("id").alias("label"), F.col("label").alias("least"))
            every = label.union(opened.select("node", "label")).distinct()
            label = every.join(merged, "label", "left").select("id", F.coalesce("least", "label").alias("label"))
    node_label = nodes.select("digest", "node").join(label.withColumnRenamed("id", "node"), "node", "left").select("digest", F.coalesce("label", "node").alias("component_id"), "node")
    return _per_row(signed, store(node_label, "dedup-found"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("node").alias("id")).union(pairs.select("centre")).distinct()


def _crossed(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of labels that links join, from comparing the members (key, node, label) of each key on their sets, in blocks.

    Members with a key's commonest label are in blocks of their own, which aren't compared with each other."""
    counted = members.join(sets.select(F.col("id").alias("node"), F.size(F.flatten("sets")).alias("n")), "node").groupBy("key", "label")
    counted = counted.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"))
    blocks = lambda rows, n: F.ceil(F.greatest(rows / BLOCK, n / BLOCK_SHINGLES))
    of_key = counted.groupBy("key").agg(F.max(F.struct("rows", "n", "label")).alias("most"), F.sum("rows").alias("rows"), F.sum("n").alias("n"))
    of_key = of_key.select("key", F.col("most.label").alias("common"), blocks(F.col("most.rows"), F.col("most.n")).alias("common_blocks"), blocks(F.col("rows") - F.col("most.rows"), F.col("n") - F.col("most.n")).alias("blocks"))
    rows = store(members.select("key", "node", "label"), "dedup-compared").join(store(of_key, "dedup-blocks"), "key")
    is_common, of = F.col("label") == F.col("common"), F.xxhash64("node")
    part = F.when(is_common, F.col("blocks") + F.pmod(of, F.col("common_blocks"))).otherwise(F.pmod(of, F.col("blocks")))
    last = F.when(is_common, F.col("blocks")).otherwise(F.col("blocks") + F.col("common_blocks")) - 1
    rows = rows.select("key", "node", "label", part.alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other"))
    rows = rows.join(sets.select(F.col("id").alias("node"), F.explode("sets").alias("set")), "node")
    rows = rows.select("key", "label", "set", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part")

    def compare(table: pa.Table) -> pa.Table:
        part = table["part"].to_numpy()
        left, right = part == table["i"][0].as_py(), part == table["j"][0].as_py()
        sets = [s for c in table["set"].chunks if len(c) for s in np.split(c.flatten().to_numpy(), np.diff(c.offsets.to_numpy())[:-1].cumsum())]
        found = cross_links(table["label"].to_numpy(), sets, left, right, num, den)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return rows.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def _per_row(signed: DataFrame, found: DataFrame) -> DataFrame:
    """Labels of sets for the rows that hold them."""
    joined = signed.select("doc_id", "n_shingles", "digest").join(found.select("digest", "component_id"), "digest", "left")
    usable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    component = F.when(usable, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
