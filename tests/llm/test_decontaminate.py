import random
import time

import numpy as np

from starling.llm import decontaminate as D


def wise(a, b, least):
    """Greedy string tiling by its definition."""
    in_a, in_b, out = set(), set(), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and i + k not in in_a and j + k not in in_b:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return out
        k, i, j = best
        in_a.update(range(i, i + k))
        in_b.update(range(j, j + k))
        out.append((i, j, k))


def test_tiling_is_greedy():
    rng = random.Random(1)
    for _ in range(300):
        a, b = (rng.choices("abc" if _ % 2 else "abcdefgh", k=rng.randrange(30)) for _i in range(2))
        one, two = (np.array([ord(c) for c in x], dtype=np.int64) for x in (a, b))
        assert D.tiles(one, two, 3) == wise(a, b, 3), (a, b)


def test_finding_is_the_definition():
    """find, on texts and items of few words, against tiling every pair by the definition."""
    rng = random.Random(4)
    for _ in range(40):
        words = ["aa", "bb", "cc", "dd", "ee", "ff"][: rng.randrange(1, 7)]
        items = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 25)))) for k in range(4)]
        texts = [" ".join(rng.choices([*words, "zz"], k=rng.randrange(40))) for _ in range(6)] + [items[0][1], None, ""]
        for text, got in zip(texts, D.ItemIndex(items).find(texts)):
            want = {}
            for item, said in items:
                a, b = (text or "").split(), said.split()
                found = wise(a, b, D.SEED) if len(b) >= D.SEED else [(0, 0, len(b))] * (a == b)
                if found and 2 * sum(t[2] for t in found) >= len(b):
                    want[item] = (sum(t[2] for t in found), len(found), max(t[2] for t in found))
            assert {g["item_id"]: (g["covered"], g["n_tiles"], g["longest"]) for g in got} == want, (text, items)


def test_repetitive_and_long_texts():
    began = time.process_time()
    index = D.ItemIndex([(1, "the " * 500), (2, "the cat " * 100), (3, " ".join(f"w{n}" for n in range(60)))])
    texts = ["the " * 20_000, "the cat " * 10_000, " ".join(f"w{n % 977}" for n in range(200_000)), "x" * 300_000]
    got = [{g["item_id"]: (g["covered"], g["n_tiles"]) for g in found} for found in index.find(texts)]
    assert got == [{1: (500, 1)}, {2: (200, 1)}, {3: (60, 1)}, {}]
    assert time.process_time() - began < 10


def test_finding(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    item = [word() for _ in range(30)]
    filler = lambda n: [word() for _ in range(n)]
    swapped = filler(50) + item[15:] + filler(9) + item[:15] + filler(20)
    edited = item[:7] + ["x"] + item[8:20] + ["y", "z"] + item[22:]
    docs = [(1, " ".join(filler(40) + item + filler(10))), (2, " ".join(swapped)), (3, ", ".join(edited).upper()), (4, " ".join(filler(500))), (5, " ".join(item[:10])), (6, None), (7, ""), (8, "two words"), (1, " ".join(item)), (9, " ".join(item * 50)), (None, " ".join(item))]
    bench = [(1, " ".join(item)), (2, None), (3, ""), (4, "two words"), (1, " ".join(item)), (5, "the " * 40)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, t, 0) for i, t in bench], "item_id long, text string, doc_id int")
    rows = D.find_leaks(docs, bench).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in rows) == sorted([(1, 1)] * 4 + [(2, 1)] * 2 + [(3, 1)] * 2 + [(8, 4)] + [(9, 1)] * 2 + [(0, 1)] * 2)
    assert {r["n_tiles"] for r in rows if r["doc_id"] == 2} == {2} and all(r["coverage"] >= D.LEAK for r in rows)
    assert sorted(r["doc_id"] for r in D.drop_leaks(docs, bench).collect()) == [4, 5, 6, 7]
    assert D.find_leaks(docs, bench.limit(0)).count() == 0 and D.find_leaks(docs.limit(0), bench).count() == 0
    assert D.drop_leaks(docs, bench.limit(0)).count() == 11


def test_blocks_agree(spark, monkeypatch):
    items = [(i, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(40)]
    docs = spark.createDataFrame([(i, "a b c d " + t) for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(D, "BLOCK_BYTES", 400)
    assert sorted((r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, bench).collect()) == [(i, i) for i in range(40)]
