import math

import numpy as np

from starling.llm import topk

KIND = "vec_id long, embedding array<float>, score string"


def brute(rows, k=20, every=20):
    ok = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for i in sorted({i for i, _ in ok if i % every == 0}):
        q = min(v for j, v in ok if j == i)
        s = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i))[:k]
        out[i] = [(n + 1, j, -x) for n, (x, j) in enumerate(s)]
    return {i: r for i, r in out.items() if r}


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {i: sorted(r) for i, r in out.items()}


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], KIND)


def test_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(700)]
    assert got(topk.top_k(frame(spark, rows))) == brute(rows)


def test_ties_nulls_and_repeats(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(20, [1.0, 0.0]), (21, [-1.0, 0.5]), (40, [0.5, 0.5]), (None, [1.0, 1.0]), (80, None), (81, [float("nan"), 1.0]), (82, [None, 1.0]), (83, [float("inf"), 0.0]), (100, [3.0]), (120, [1e6, -1e6])]
    assert got(topk.top_k(frame(spark, rows))) == brute(rows)


def test_few_rows(spark):
    assert got(topk.top_k(frame(spark, [(0, [1.0]), (1, [2.0])]))) == {0: [(1, 1, 8192)]}
    assert topk.top_k(frame(spark, [(0, [1.0])])).count() == 0
    assert topk.top_k(frame(spark, [])).count() == 0


def test_cells(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(900)] + [(40, [0.5] * 8)] * 400 + [(61, [2.0] * 9)] * 30
    for name, size in (("QUERY_BLOCK", 10), ("CELL_QUERIES", 17), ("HELD_ROWS", 200)):
        monkeypatch.setattr(topk, name, size)
    assert got(topk.top_k(frame(spark, rows))) == brute(rows)
    few = [(20 * i, [float(i)]) for i in range(15)]
    assert got(topk.top_k(frame(spark, few))) == brute(few)


def test_blocks_are_pruned():
    rng, stats = np.random.default_rng(3), {}
    centres = rng.normal(size=(20, 16)) * 60
    rows = (centres[rng.integers(20, size=20_000)] + rng.normal(size=(20_000, 16)) * 3).astype(np.int64)
    best = topk.TopK(50, 10, np.full(50, topk.NOTHING))
    topk.search_rows(rows[:50], np.arange(50), rows, np.arange(20_000), best, stats)
    score = rows[:50] @ rows.T
    score[np.arange(50), np.arange(50)] = topk.NOTHING
    assert (np.sort(score, 1)[:, -10] == np.array([best.score[best.q == q].min() for q in range(50)])).all()
    assert stats["scored"] < 0.5 * stats["pairs"]
