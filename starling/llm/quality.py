"""Quality by a sparse ensemble of rules over text statistics.

Boosted shallow trees over a bounded labelled sample propose rules: each path from
a root to a node is a conjunction of thresholds. A lasso logistic regression keeps
few of them, and those are compiled into one Spark column expression, so scoring
runs inside Catalyst's generated code on top of the statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starling.llm.common import held_out, labelled_sample

#: Bound of the labelled sample that the rules are learned from.
MAX_LABELLED = 20_000
TREES, DEPTH, BINS, RATE = 40, 3, 32, 0.3
#: Strengths of the lasso that are tried, strongest first.
LASSO = (0.02, 0.01, 0.005, 0.002, 0.001)

STATISTICS = (
    "log_words", "word_length", "longest_word", "upper", "digits", "symbols", "marks", "exclaims", "bars", "stops", "non_ascii",
    "lines_per_word", "distinct_words", "distinct_lines", "short_words", "commonest_word",
)

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digits": b"0123456789", "symbols": b"#$%&*+<>=@^_~`\\/{}[]", "marks": b",;:'\"()-", "exclaims": b"!?", "bars": b"|", "stops": b".", "lines": b"\n"}


def statistics(text: str | None) -> tuple[float, ...]:
    """STATISTICS of one text, all finite; a null text counts as empty."""
    text = text or ""
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
    of = {k: int(counts[list(v)].sum()) for k, v in _CLASSES.items()}
    words = text.split()
    n, size = len(words), max(len(text), 1)
    lengths = list(map(len, words))
    low = text.lower().split()
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    seen: dict[str, int] = {}
    for w in low:
        seen[w] = seen.get(w, 0) + 1
    m = max(n, 1)
    return (
        math.log1p(n), sum(lengths) / m, math.log1p(max(lengths, default=0)), of["upper"] / max(of["upper"] + of["lower"], 1), of["digits"] / size,
        of["symbols"] / size, of["marks"] / size, of["exclaims"] / size, of["bars"] / size, of["stops"] / m, int(counts[128:].sum()) / size,
        of["lines"] / m, len(seen) / m * math.log1p(m), len(set(lines)) / max(len(lines), 1), sum(k <= 3 for k in lengths) / m, max(seen.values(), default=0) / m,
    )


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def statistics_udf(text: pa.Array) -> pa.Array:
    return pa.array([statistics(x.as_py()) for x in text], type=pa.list_(pa.float64()))


#: A rule holds where all of its (statistic, is above, threshold) do.
Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class RuleModel:
    rules: list[Rule]
    weights: list[float]
    base: float

    def column(self, stats: Column) -> Column:
        """The score as a column expression over the array of statistics."""
        total = F.lit(float(self.base))
        for rule, weight in zip(self.rules, self.weights):
            holds = None
            for k, above, at in rule:
                value = stats.getItem(k)
                one = value > F.lit(at) if above else value <= F.lit(at)
                holds = one if holds is None else holds & one
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.base + rule_matrix(x, self.rules) @ np.array(self.weights) if self.rules else np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{STATISTICS[k]} {'>' if up else '<='} {at:.4g}" for k, up, at in r) for r, w in zip(self.rules, self.weights)]


def rule_matrix(x: np.ndarray, rules: list[Rule]) -> np.ndarray:
    out = np.ones((len(x), len(rules)), dtype=np.float32)
    for j, rule in enumerate(rules):
        for k, above, at in rule:
            out[:, j] *= x[:, k] > at if above else x[:, k] <= at
    return out


def propose_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Paths of boosted trees, each fitted to the logistic residuals that its predecessors left."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], 1)
    z, found = np.full(len(y), math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, path: Rule) -> None:
        if path:
            found.setdefault(tuple(sorted(path)), None)
        best = (1e-6, 0, 0)
        if len(path) < DEPTH and len(rows) >= 10:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for k, e in enumerate(edges):
                if len(e):
                    gs = np.bincount(bins[rows, k], g[rows], len(e) + 1).cumsum()[:-1]
                    hs = np.bincount(bins[rows, k], h[rows], len(e) + 1).cumsum()[:-1]
                    gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                    if gain.max() > best[0]:
                        best = (float(gain.max()), k, int(gain.argmax()))
        if best[0] <= 1e-6:
            z[rows] += RATE * g[rows].sum() / (h[rows].sum() + 1)
            return
        _, k, i = best
        left = bins[rows, k] <= i
        grow(rows[left], g, h, (*path, (k, False, float(edges[k][i]))))
        grow(rows[~left], g, h, (*path, (k, True, float(edges[k][i]))))

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        grow(np.arange(len(y)), y - p, p * (1 - p), ())
    return list(found)


def lasso_logistic(m: np.ndarray, y: np.ndarray, strength: float, start: np.ndarray, steps: int = 300) -> np.ndarray:
    """Weights of the columns and, last, the base, by accelerated proximal gradient; the base isn't shrunk."""
    m = np.column_stack([m, np.ones(len(m), dtype=np.float32)])
    v = np.random.default_rng(0).normal(size=m.shape[1]).astype(np.float32)
    for _ in range(15):  # the largest curvature, by power iteration
        v = m.T @ (m @ v)
        norm = float(np.linalg.norm(v)) or 1.0
        v /= norm
    rate = 4 * len(y) / (1.1 * norm)
    w, momentum, t = start.astype(np.float32), start.astype(np.float32), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(m @ momentum, -30, 30)))
        new = momentum - rate * (m.T @ (p - y).astype(np.float32)) / len(y)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * strength, 0)
        t, old = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        momentum = new + (old - 1) / t * (new - w)
        w = new
    return w


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Rules and weights; a fifth of the rows picks the lasso's strength."""
    if not len(y) or y.min() == y.max():
        return RuleModel([], [], 8.0 if not len(y) or y.max() else -8.0)
    test = np.arange(len(y)) % 5 == 4
    train = ~test if test.any() and len(set(y[~test])) == 2 else np.ones(len(y), bool)
    rules = propose_rules(x[train], y[train])
    m = rule_matrix(x, rules)
    w, best, least = np.zeros(len(rules) + 1), None, math.inf
    for strength in LASSO:
        w = lasso_logistic(m[train], y[train], strength, w)
        p = np.clip(1 / (1 + np.exp(-np.clip(m[test] @ w[:-1] + w[-1], -30, 30))), 1e-6, 1 - 1e-6)
        loss = float(-(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean())
        if best is None or loss < least - 1e-4:
            best, least = w, loss
    keep = np.flatnonzero(np.abs(best[:-1]) > 1e-4)
    return RuleModel([rules[k] for k in keep], [float(best[k]) for k in keep], float(best[-1]))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> RuleModel:
    """Rules from a bounded sample of labelled rows; without labels every text is of good quality."""
    sample = labelled_sample(docs, labels, label_col, max_labelled, id_col, text_col)
    rows = sample.select(statistics_udf("text").alias("s"), "label").toPandas()  # max_labelled rows, or more if ids repeat
    x = np.array(rows["s"].tolist(), dtype=float).reshape(-1, len(STATISTICS))
    order = np.lexsort(x.T)  # the rows' order is Spark's; the model must not depend on it
    return fit(x[order], rows["label"].to_numpy(dtype=float)[order])


def score_quality(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) of every row.

    Null and empty texts are scored by their statistics like any other. A null id
    counts as not held out. Repeated rows are each scored, an empty table gives
    none, and columns beyond the two named are ignored."""
    stats = docs.select(F.col(id_col).alias("doc_id"), statistics_udf(F.col(text_col)).alias("stats"))
    scored = stats.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), model.column(F.col("stats")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
