"""Toxicity and quality."""

import random

import numpy as np
import pytest

from starling.llm import quality, toxicity
from starling.llm.common import held_out

WORDS = "the house garden of and river tree stone light water under over morning paper".split()


def labelled(spark, n=900):
    rng, docs, labels = random.Random(2), [], []
    for i in range(n):
        words, bad = rng.choices(WORDS, k=rng.randrange(20, 80)), i % 6 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "zorgl" + rng.choice(["ish", "er", "s", "ing"]))
        junk = i % 7 == 0
        docs.append((i, (" ||| " if junk else " ").join(words), "x"))
        labels.append((i, int(not junk), int(bad)))
    extra = [(n, None, "x"), (n + 1, "", "x"), (None, "the z0rgler", "x"), (n + 2, "ZORGLING " * 4000, "x"), (0, docs[0][1], "x")]
    return spark.createDataFrame(docs + extra, "doc_id long, text string, score string"), spark.createDataFrame(labels + [(None, 1, 1), (n, None, None)], "doc_id long, quality int, toxic int"), labels


def test_toxicity_learns_stems(spark):
    docs, labels, truth = labelled(spark)
    lexicon = toxicity.learn(docs, labels)
    assert any("zorgl".startswith(t[:5]) for t in lexicon.weights if t not in toxicity.Lexicon().weights)
    rows = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, lexicon).collect()}
    assert len(rows) == len(truth) + 4  # one id is repeated
    wrong = [i for i, _, t in truth if rows[i]["predicted"] != t]
    assert not wrong and all(0 <= r["score"] <= 1 for r in rows.values())
    assert rows[None]["predicted"] == 1 and rows[None]["held_out"] is False  # folded digits
    assert rows[len(truth)]["predicted"] == rows[len(truth) + 1]["predicted"] == 0 and rows[len(truth) + 2]["predicted"] == 1


def test_held_out_rows_teach_nothing(spark):
    docs, labels, _ = labelled(spark)
    flipped = labels.withColumn("toxic", toxicity.F.when(held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    one, two = toxicity.learn(docs, labels), toxicity.learn(docs, flipped)
    assert one.weights == two.weights and one.curve == pytest.approx(two.curve)


def test_without_labels(spark):
    docs, labels, _ = labelled(spark, 30)
    lexicon = toxicity.learn(docs, labels.limit(0))
    assert lexicon.weights == toxicity.Lexicon().weights
    assert toxicity.score_toxicity(docs.limit(0), lexicon).count() == 0
    model = quality.learn(docs, labels.limit(0))
    assert quality.score_quality(docs.limit(0), model).count() == 0
    assert {r["predicted"] for r in quality.score_quality(docs, model).collect()} == {1}


@pytest.mark.parametrize("text, n", [("what an idiot", 1), ("1D10T!", 1), ("mоrоn", 1), ("ｉｄｉｏｔ", 1), ("the class clown", 0), ("a clownfish, a clown", 1), ("unidiotic", 0), ("", 0), ("mo​ron $cum", 1), ("st$pid tra$h", 1)])
def test_folding_and_exceptions(text, n):
    assert toxicity.Lexicon().weigh(text)[1] == n


def naive(lexicon, text):
    """Weight and terms of a text by looking for every term at every place."""
    folded, hits, safe = toxicity.fold(text), {}, set()
    for start in range(len(folded)):
        if start and folded[start - 1].isalnum():
            continue
        for phrase in lexicon.exceptions:
            if folded.startswith(phrase, start):
                safe |= {*range(start, start + len(phrase))}
        weights = [w for term, w in lexicon.weights.items() if folded.startswith(term, start)]
        if weights:
            hits[start] = max(weights)
    found = [w for start, w in hits.items() if start not in safe]
    return sum(found), len(found)


def test_matching_is_the_naive_search():
    rng = random.Random(12)
    lexicon = toxicity.Lexicon(weights={t: rng.random() for t in ("ab", "abc", "bca", "cab ca", "aa", "c", "idiot")}, exceptions=("ab c", "aab", "class clown"))
    for _ in range(500):
        text = "".join(rng.choices("aabbcc  0@4-é", k=rng.randrange(60))) + rng.choice(["", " class clown", " 1d10t", " idi0ts"])
        weight, terms, words = lexicon.weigh(text)
        assert (weight, terms) == (pytest.approx(naive(lexicon, text)[0]), naive(lexicon, text)[1]), text
        assert words == len(toxicity.fold(text).split())


def test_length_matters():
    lexicon = toxicity.Lexicon()
    short, long = lexicon.weigh("you idiot"), lexicon.weigh("you idiot " + "word " * 5000)
    assert lexicon.score(short[0], short[2]) > lexicon.score(long[0], long[2])


def test_quality(spark):
    docs, labels, truth = labelled(spark)
    model = quality.learn(docs, labels)
    rows = {r["doc_id"]: r for r in quality.score_quality(docs, model).collect()}
    assert sum(rows[i]["predicted"] != q for i, q, _ in truth) <= 2
    x = np.array([quality.statistics(r["text"]) for r in docs.collect()])
    assert np.isfinite(x).all() and x.shape[1] == len(quality.STATISTICS)
    ours = {i: s for i, s in zip([r["doc_id"] for r in docs.collect()], model.scores(x))}
    assert all(rows[i]["score"] == pytest.approx(ours[i], abs=1e-6) for i in rows)  # the column expression is the model
    assert model.describe() and all("if " in d for d in model.describe())


def test_rules_of_one_label():
    assert quality.fit(np.zeros((0, 3)), np.zeros(0)).base > 0
    assert quality.fit(np.ones((4, 3)), np.zeros(4)).base < 0
