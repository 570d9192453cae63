"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters and digits to the letters they stand
for, and drops invisible characters. A term counts where a word begins with it,
unless the match lies inside an exception phrase. The weights found are related
to the text's length in words, and a logistic curve over both turns them into a
score from 0 to 1.

Terms and weights are learned from labelled rows: word stems (and whole short
words) that toxic texts hold far more often than others, by a likelihood-ratio
test. A fixed seed list stands in where labels say nothing.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.llm.common import held_out, labelled_sample, store

#: Bound of the labelled sample that a lexicon is learned from.
MAX_LABELLED = 12_000
#: Lengths of the stems that are counted, and what a term must show.
STEM_LENGTHS = (4, 5, 6, 7, 8)
LEAST_LLR, LEAST_ODDS = 24.0, 20.0

# Seed terms, phrases in which a term is harmless, look-alike letters, digits, invisible characters.
SEED_TERMS = (
    "idiot moron stupid loser scum trash pathetic worthless disgusting clown imbecile dumbass bastard vermin "
    "dummkopf abschaum arschloch trottel gilipollas pendejo connard salaud"
).split()
EXCEPTIONS = ("class clown", "rodeo clown", "clownfish", "clown fish", "trash can", "trash bin", "trash bag", "pond scum")
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "a", "Е": "e", "О": "o", "Р": "p", "С": "c", "У": "y", "Х": "x", "І": "i", "Ѕ": "s", "Ј": "j", "К": "k", "М": "m", "Т": "t", "В": "b", "Н": "h",
    "α": "a", "ο": "o", "ρ": "p", "ι": "i", "ν": "v", "κ": "k", "τ": "t", "υ": "u", "ε": "e",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ſ": "s",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
INVISIBLE = "­​‌‍⁠﻿"

_FOLD = HOMOGLYPHS | {c: "" for c in INVISIBLE} | {chr(0xFF01 + i): chr(0x21 + i).lower() for i in range(94)}
_FOLDED = re.compile(f"[{''.join(map(re.escape, _FOLD))}]")
_SIGNS = re.compile(r"(?<=\w)[@$](?=\w)")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """A folded text; a text of plain letters only changes its case."""
    if not text.isascii():
        text = _FOLDED.sub(lambda m: _FOLD[m[0]], text)
    text = text.lower()
    for digit, letter in DIGITS.items():
        if digit in text:
            text = text.replace(digit, letter)
    if "@" in text or "$" in text:
        text = _SIGNS.sub(lambda m: "a" if m[0] == "@" else "s", text)
    return text


@dataclass
class Lexicon:
    """Weights of folded terms, exception phrases, and the curve from (log weight, log weight per 100 words) to a score."""

    weights: dict[str, float] = field(default_factory=lambda: {fold(t): 3.0 for t in SEED_TERMS})
    exceptions: tuple[str, ...] = tuple(map(fold, EXCEPTIONS))
    curve: tuple[float, float, float] = (-4.0, 2.0, 1.5)

    def __post_init__(self):
        self._automaton = None

    def __getstate__(self):
        return (self.weights, self.exceptions, self.curve)

    def __setstate__(self, state):
        self.weights, self.exceptions, self.curve = state
        self._automaton = None

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for term in self.exceptions:
                a.add_word(term, (len(term), None))
            for term, w in self.weights.items():
                a.add_word(term, (len(term), w))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def weigh(self, text: str | None) -> tuple[float, int, int]:
        """Summed weight, terms found and words of a text; of terms that begin at one place the heaviest counts."""
        if not text or not (self.weights or self.exceptions):
            return 0.0, 0, len((text or "").split())
        folded = fold(text)
        hits, safe = {}, []
        for last, (n, w) in self.automaton().iter(folded):
            start = last - n + 1
            if start and folded[start - 1].isalnum():
                continue
            if w is None:
                safe.append((start, last))
            else:
                hits[start] = max(w, hits.get(start, 0.0))
        if safe:
            hits = {s: w for s, w in hits.items() if not any(a <= s <= b for a, b in safe)}
        return math.fsum(hits.values()), len(hits), len(folded.split())

    def score(self, weight: float, words: int) -> float:
        a, b, c = self.curve
        z = a + b * math.log1p(weight) + c * math.log1p(100 * weight / max(words, 1))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _count_terms(batches):
    """(text, label) -> per batch, in how many texts of either label each stem begins a word; the stem '' counts texts."""
    from collections import Counter

    for batch in batches:
        seen = (Counter(), Counter())
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = {w[: STEM_LENGTHS[-1]] for w in _WORD.findall(fold(text or "")) if len(w) >= STEM_LENGTHS[0]}
            seen[label].update({w[:n] for w in words for n in STEM_LENGTHS if len(w) >= n} | {""})
        terms = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([seen[1][t] for t in terms], pa.int64()), pa.array([seen[0][t] for t in terms], pa.int64())], ["term", "toxic", "clean"])


def _llr(k1, n1, k2, n2):
    """Dunning's likelihood ratio that k1 of n1 and k2 of n2 have one rate."""

    def part(k, n, p):
        return (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n > k else 0.0)

    p = (k1 + k2) / (n1 + n2)
    return 2 * (part(k1, n1, k1 / n1) + part(k2, n2, k2 / n2) - part(k1, n1, p) - part(k2, n2, p)) if 0 < p < 1 else 0.0


def choose_terms(counts: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """The stems that tell toxic texts, with log odds as weights; of nested stems the longest that loses under 5 % of the shorter one's texts."""
    good = {}
    for term, k, c in counts:
        odds = ((k + 0.5) / (n_toxic + 1)) / ((c + 0.5) / (n_clean + 1))
        if odds >= LEAST_ODDS and _llr(k, n_toxic, c, n_clean) >= LEAST_LLR:
            good[term] = (k, min(math.log(odds), 8.0))
    kept: dict[str, float] = {}
    for term in sorted(good, key=lambda t: (len(t), t)):
        if any(term[:n] in kept for n in STEM_LENGTHS if n < len(term)):
            continue  # a shorter stem finds it
        longer = [t for t in good if t.startswith(term) and t != term and good[t][0] >= 0.95 * good[term][0]]
        best = max([term, *longer], key=len)
        kept[best] = good[best][1]
    return kept


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, steps: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the first column of x is 1 and isn't shrunk."""
    w, shrink = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1]) * len(y)
    shrink[0, 0] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * np.maximum(p * (1 - p), 1e-9)[:, None]) + shrink + 1e-9 * np.eye(x.shape[1]), x.T @ (p - y) + shrink @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> Lexicon:
    """A lexicon from a bounded sample of labelled rows; without rows of both labels it is the seed lexicon."""
    sample = labelled_sample(docs, labels, label_col, max_labelled, id_col, text_col)
    counts = sample.mapInArrow(_count_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = store(counts.where("term = '' or toxic >= 5"), "toxic-terms")
    texts = counts.where("term = ''").first()
    if not texts or not texts["toxic"] or not texts["clean"]:
        return Lexicon()
    n_toxic, n_clean = texts["toxic"], texts["clean"]
    odds = (F.col("toxic") + 0.5) / (n_toxic + 1) / ((F.col("clean") + 0.5) / (n_clean + 1))
    best = counts.where((F.col("term") != "") & (odds >= 0.99 * LEAST_ODDS)).orderBy("term").collect()  # only what choose_terms may keep
    lexicon = Lexicon()
    lexicon.weights |= choose_terms([tuple(r) for r in best], n_toxic, n_clean)

    def weighed(batches):
        for batch in batches:
            rows = [lexicon.weigh(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.int64()), batch.column(1).cast(pa.int32())], ["weight", "words", "label"])

    rows = sample.mapInArrow(weighed, "weight double, words long, label int").collect()  # max_labelled rows, or more if ids repeat
    w, n, y = (np.array([r[i] for r in rows], dtype=float) for i in range(3))
    lexicon.curve = tuple(map(float, logistic(np.stack([np.ones(len(y)), np.log1p(w), np.log1p(100 * w / np.maximum(n, 1))], 1), y, 1e-4)))
    return lexicon


def score_udf(lexicon: Lexicon):
    kind = pa.struct([("score", pa.float64()), ("predicted", pa.int32()), ("n_terms", pa.int32()), ("weight", pa.float64())])

    @F.arrow_udf("score double, predicted int, n_terms int, weight double")
    def toxicity(text: pa.Array) -> pa.Array:
        out = []
        for x in text:
            weight, terms, words = lexicon.weigh(x.as_py())
            score = lexicon.score(weight, words)
            out.append({"score": score, "predicted": int(score >= 0.5), "n_terms": terms, "weight": weight})
        return pa.array(out, type=kind)

    return toxicity


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, n_terms and weight of every row.

    Null and empty texts score as texts without terms. A null id counts as not
    held out. Repeated rows are each scored, an empty table gives none, and
    columns beyond the two named are ignored."""
    scored = docs.select(F.col(id_col).alias("doc_id"), score_udf(lexicon)(F.col(text_col)).alias("s"))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "s.*")
