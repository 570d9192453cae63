import random
import re

import numpy as np
import pytest

from starling.llm import near_dedup as N
from starling.llm.components import components


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words)} if 0 < len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k, num, den):
    sets = [(i, shingles(t, k)) for i, t in rows]
    label = {i: i for i, _ in sets}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = top(i), top(j)
                label[max(x, y)] = min(x, y)
    return {i: (len(s), top(i)) for i, s in sets}


def make(seed, families, members, edits, words=(4, 120)):
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{n}" for n in range(400)]
    for _ in range(families):
        base = rng.choices(vocabulary, k=rng.randint(*words))
        for _ in range(rng.randint(1, members)):
            text = list(base)
            for _ in range(rng.randint(0, edits)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary).upper() if rng.random() < 0.5 else rng.choice(vocabulary)
            rows.append((len(rows) * 7 % 100_003, rng.choice([" ", "\t", "\n "]).join(text)))
    return rows


@pytest.mark.parametrize("k, num, den", [(3, 85, 100), (5, 80, 100)])
def test_brute_force(spark, k, num, den):
    rows = make(k, 60, 9, 4) + [(900_001, None), (900_002, ""), (900_003, " \n"), (900_004, "one"), (900_005, "ONE"), (900_006, "one two"), (900_007, "É"), (900_008, "é")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(df, k, num, den).collect()}
    assert got == brute(rows, k, num, den)


def test_a_large_family(spark, monkeypatch):
    """One family whose members are linked to its centre or to each other only: blocks of it are compared."""
    monkeypatch.setattr(N, "BLOCK", 16)
    rng = random.Random(5)
    base = [f"b{n}" for n in range(150)]
    rows = []
    for n in range(90):
        text = list(base)
        for at in rng.sample(range(150), rng.choice([1, 3, 6, 9])):
            text[at] = f"x{n}y{at}"
        rows.append((n, " ".join(text)))
    for n in range(20):  # pairs that are near each other and not to the rest
        text = list(base)
        for at in rng.sample(range(150), 12):
            text[at] = f"z{n}y{at}"
        rows += [(1000 + 2 * n, " ".join(text)), (1001 + 2 * n, " ".join(text[:-1] + ["end"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(df).collect()}
    assert got == brute(rows, 3, 85, 100)


@pytest.mark.parametrize("fixed, own", [(30, 17), (60, 20), (40, 8)])
def test_a_passage_with_own_words(spark, monkeypatch, fixed, own):
    """Many texts of a fixed passage and words of their own, with links among a few of them and to the bare passage."""
    monkeypatch.setattr(N, "BLOCK", 32)
    rng = random.Random(fixed)
    passage = [f"p{n}" for n in range(fixed)]
    texts = [passage + [f"u{n}x{i}" for i in range(own)] for n in range(150)] + [passage, passage[:-1], passage + ["end"]]
    for n in range(0, 150, 10):
        near = list(texts[n])
        near[rng.randrange(fixed, fixed + own)] = "other"
        texts += [near, near + ["more"]]
    rng.shuffle(texts)
    rows = [(n, " ".join(words)) for n, words in enumerate(texts)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 3, 85, 100)


def test_stored_rows_grow_with_a_group(spark, monkeypatch):
    """Near copies of one text, and four times as many: no table on the way grows with their square."""
    made, plain = {}, N.store

    def counting(df, tag):
        out = plain(df, tag)
        made[tag] = made.get(tag, 0) + out.count()
        return out

    monkeypatch.setattr(N, "store", counting)
    rng, counts = random.Random(9), []
    base = [f"b{n}" for n in range(120)]
    for members in (150, 600):
        rows = []
        for n in range(members):
            text = list(base)
            for at in rng.sample(range(120), rng.choice([1, 2, 3, 6])):
                text[at] = f"x{n}y{at}"
            rows.append((n, " ".join(text)))
        made.clear()
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == brute(rows, 3, 85, 100)
        counts.append(dict(made))
    for tag, n in counts[1].items():
        assert n <= 6 * max(counts[0].get(tag, 0), 150), (tag, n, counts[0].get(tag))


def test_cross_links_join_what_is_linked():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 40, 60)
    sets = [np.unique(np.r_[base[rng.random(60) < 0.93], rng.integers(0, 1 << 40, 2)]) for _ in range(60)]
    labels = np.r_[np.zeros(20, np.int64), np.arange(1, 41)]
    every = np.ones(60, bool)
    top = {int(x): int(x) for x in labels}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    def joined(pairs):
        top.update({int(x): int(x) for x in labels})
        for a, b in pairs:
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
        return [find(int(x)) for x in labels]

    true = [(int(labels[i]), int(labels[j])) for i in range(60) for j in range(i) if 100 * (b := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - b)]
    found = N.cross_links(labels, sets, every, every, 85, 100)
    assert joined(found) == joined(true) and len(found) < 41 and len({*joined(true)}) > 1
    half = np.arange(60) < 30
    parts = [N.cross_links(labels, sets, a, b, 85, 100) for a, b in ((half, half), (half, ~half), (~half, ~half))]
    assert joined([p for x in parts for p in x]) == joined(true)


def test_long_texts_and_clashing_columns(spark):
    long = " ".join(f"w{n % 7919}x{n}" for n in range(60_000))
    rows = [(1, long, "a", 1), (2, long + " end", "b", 2), (3, "one word " * 30_000, "c", 3), (4, "x" * 400_000, "d", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, label long")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(df).collect()}
    assert got == brute([r[:2] for r in rows], 3, 85, 100)


def test_a_common_passage_links_nothing(spark):
    rng = random.Random(6)
    passage = " ".join(f"p{n}" for n in range(60))
    rows = [(i, passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(120))) for i in range(300)]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in got) and len(got) == 300


def test_repeats_and_missing_ids(spark):
    text = " ".join(f"a{n}" for n in range(40))
    rows = [(4, text), (4, text), (2, text + " more"), (None, text), (7, "other words here and there")]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (2, 2, True), (4, 2, False), (4, 2, False), (7, 7, True)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(empty).count() == 0
    assert N.near_duplicates(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0]["component_id"] == 1


def test_sketches_estimate():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    one, two = N.sketch(np.unique(a[:3000])), N.sketch(np.unique(a[500:3500]))
    assert abs((one == two).mean() - 2500 / 3500) < 0.2 and (N.sketch(np.zeros(0, np.uint64)) == N.EMPTY).all()


def test_bands_miss_little():
    for t in (0.8, 0.85):
        for bands in N.band_plan(t):
            assert bands.registers and all(len(set(r)) == len(r) for r in bands.registers)
        assert (1 - t ** len(N.band_plan(t)[-1].registers[0])) ** len(N.band_plan(t)[-1].registers) <= N.MISS


def test_components(spark):
    chain = [(i, i + 1) for i in range(64)] + [(100, 102), (102, 101), (7, 7)]
    got = {r["id"]: r["label"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(65)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_linked_across_a_centre(spark):
    """A linked pair of which, in every band that the two share, one is similar to the centre and the other isn't."""
    rng = random.Random(8)
    x = [f"p{n}" for n in range(172)]
    texts = [x, x + [f"q{n}" for n in range(28)]]

    def signed(words):
        h = N.shingle_hashes(" ".join(words), 1)
        return N.sketch(h), set(N.band_keys(N.sketch(h)[None], np.array([len(h)]), 0.85)[1].tolist())

    def similar(a, b):
        return ((a == b) & (a != N.EMPTY)).sum() / ((a != N.EMPTY) | (b != N.EMPTY)).sum()

    (one, keys), (two, more) = map(signed, texts)
    open_keys, centres = keys & more, []
    assert open_keys
    while open_keys:
        part = rng.sample(x, 112)
        registers, its = signed(part)
        if its & open_keys and similar(registers, one) > 0.61 and similar(registers, two) < 0.59:
            centres.append(part)
            open_keys -= its
    rows = [(n, " ".join(words)) for n, words in enumerate(centres + texts)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1).collect()}
    assert got == brute(rows, 1, 85, 100) and got[len(rows) - 1][1] == len(rows) - 2
