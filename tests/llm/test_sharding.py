import hashlib
import random
import zlib

import pytest

from starling.llm.sharding import assign_shards


def least_capacity(sizes, n):
    def need(c):
        shards, at = 1, 0
        for s in sizes:
            if s > c:
                return n + 1
            if at + s > c:
                shards, at = shards + 1, 0
            at += s
        return shards

    low, high = 1, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if need(mid) <= n else (mid + 1, high)
    return low


@pytest.mark.parametrize("n_docs, n_shards, copies", [(400, 16, 1), (300, 16, 120), (5, 16, 1), (200, 3, 7)])
def test_brute_force(spark, n_docs, n_shards, copies):
    rng = random.Random(n_docs)
    texts = [None, "", "", *("x" * rng.randrange(300) + str(rng.randrange(200)) for _ in range(n_docs)), *["hot ä " * 9] * copies]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, shard string")
    rows = assign_shards(df, n_shards).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    size = lambda t: len((t or "").encode()) + 1
    groups, where, fill, slots = {}, {}, {}, {}
    for r in rows:
        t = texts[r["doc_id"]]
        assert r["size"] == size(t) and r["text_crc32"] == zlib.crc32((t or "").encode()) and r["law"] == "bytes" and r["grown_shard"] is None
        assert where.setdefault(t, r["shard"]) == r["shard"]
        key = "" if t is None else hashlib.sha256(t.encode()).hexdigest()
        groups[key] = groups.get(key, 0) + size(t)
        fill[r["shard"]] = fill.get(r["shard"], 0) + size(t)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert max(fill.values()) == least_capacity([groups[k] for k in sorted(groups)], n_shards)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(fill) < n_shards


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert assign_shards(empty).collect() == []
    same = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    rows = assign_shards(same, 2).collect()
    assert len(rows) == 3 and len({(r["shard"], r["slot"]) for r in rows}) == 3
    with pytest.raises(ValueError):
        assign_shards(same, 0)
