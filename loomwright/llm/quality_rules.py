"""Quality: a sparse ensemble of rules over statistics of the text.

Shallow trees are grown by boosting on a sample of labelled documents. The path to each of their nodes is a rule, a conjunction of
bounds on statistics ("over 4 % symbols and under 30 % distinct words"). A lasso logistic regression over all rules leaves few of them
with a weight, and those are compiled into one Spark column: the sigmoid of a sum of weighted conditions. So a model is a short list that
can be read (describe()), and scoring is an expression over the statistics.

Statistics come from an Arrow batch function that reads each whole text once. Training uses a bounded sample (max_docs
documents); only their statistics go to the driver, never their texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import own_name, renamed, text_groups

STATS = (
    "log_words", "word_bytes", "long_words", "upper", "digits", "symbols", "exclaims", "stops", "wide", "white",
    "distinct_words", "top_word", "repeats", "marked_words", "distinct_lines", "line_words", "ended_lines", "capital_words",
)
TREES = 60
DEPTH = 3
RATE = 0.2
BINS = 32
LEAST = 0.004  # of the sample: the least that a node holds
LASSO = 0.0015
STEPS = 400

_CLASS = np.zeros(256, dtype=np.uint8)  # 0: control characters
for _k, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\r\x0b\x0c", b"!", b".,;:?'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~", bytes(range(128, 256))), 1):
    _CLASS[list(_bytes)] = _k
_ENDS, _MARKS = (b".", b"!", b"?", b":", b'"', b"\xe2\x80\xa6"), tuple(bytes([b]) for b in b"#$%&*+/<=>@[\\]^_`{|}~!")


def statistics(text: str | None) -> tuple[float, ...]:
    """STATS of a text. All are shares or logarithms; a text without words has zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATS)
    _, upper, lower, digits, white, exclaims, stops, symbols, wide = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=9).tolist()
    counts = Counter(words)
    lines = [x for x in (line.strip() for line in raw.split(b"\n")) if x]
    body = len(raw) - white
    return (
        float(np.log1p(n)),
        body / n,
        sum(len(w) > 24 for w in words) / n,
        upper / max(1, upper + lower),
        digits / body,
        symbols / body,
        exclaims / body,
        stops / body,
        wide / body,
        white / len(raw),
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        sum(w.endswith(_MARKS) for w in words) / n,
        len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        sum(line.endswith(_ENDS) for line in lines) / len(lines),
        sum(w[:1].isupper() for w in words) / n,
    )


@F.pandas_udf(T.StructType([T.StructField(s, T.DoubleType()) for s in STATS]))
def _statistics(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([statistics(t) for texts in text_groups(batch) for t in texts], columns=STATS, dtype="float64")


@dataclass(frozen=True)
class Rule:
    """above[s] < statistic s <= upto[s], for all that are named."""

    above: tuple[tuple[str, float], ...]
    upto: tuple[tuple[str, float], ...]

    def column(self, stats: Column) -> Column:
        parts = [stats[s] > F.lit(v) for s, v in self.above] + [stats[s] <= F.lit(v) for s, v in self.upto]
        return reduce(Column.__and__, parts)

    def holds(self, x: np.ndarray) -> np.ndarray:
        parts = [x[:, STATS.index(s)] > v for s, v in self.above] + [x[:, STATS.index(s)] <= v for s, v in self.upto]
        return np.logical_and.reduce(parts)

    def __str__(self) -> str:
        return " and ".join([f"{s} > {v:.4g}" for s, v in self.above] + [f"{s} <= {v:.4g}" for s, v in self.upto])


@dataclass(frozen=True)
class Model:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, stats: Column) -> Column:
        """The compiled model. Conditions are added pairwise, so the expression is shallow."""
        terms = [F.lit(self.bias)] + [F.when(r.column(stats), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.rules]
        while len(terms) > 1:
            terms = [reduce(Column.__add__, terms[i : i + 2]) for i in range(0, len(terms), 2)]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-terms[0]))

    def describe(self) -> list[str]:
        """The rules, the heaviest first."""
        return [f"{w:+.3f} if {r}" for r, w in sorted(self.rules, key=lambda x: -abs(x[1]))]


def _tree(binned: np.ndarray, edges: list[np.ndarray], residual: np.ndarray, weight: np.ndarray, rows: np.ndarray, least: int) -> tuple[list[Rule], np.ndarray]:
    """Grow one tree for the residuals: the rules of all its nodes but the root, and its step for every row."""
    rules, step = [], np.zeros(len(residual))
    everything = np.arange(len(residual))
    open_nodes = [(rows, everything, {}, {}, 0)]
    while open_nodes:
        own, all_own, above, upto, depth = open_nodes.pop()
        g, h = residual[own].sum(), weight[own].sum() + 1.0
        if depth:
            rules.append(Rule(tuple(sorted(above.items())), tuple(sorted(upto.items()))))
        best = (1e-6, -1, -1)
        if depth < DEPTH and len(own) >= 2 * least:
            for k, cuts in enumerate(edges):
                if not len(cuts):
                    continue
                b = binned[own, k]
                gs = np.bincount(b, weights=residual[own], minlength=len(cuts) + 1).cumsum()[:-1]
                hs = np.bincount(b, weights=weight[own], minlength=len(cuts) + 1).cumsum()[:-1]
                ns = np.bincount(b, minlength=len(cuts) + 1).cumsum()[:-1]
                gain = gs**2 / (hs + 1.0) + (g - gs) ** 2 / (h - hs + 1.0) - g**2 / h
                gain[(ns < least) | (len(own) - ns < least)] = 0
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (float(gain[at]), k, at)
        if best[1] < 0:
            step[all_own] = g / h
            continue
        _, k, at = best
        s, cut = STATS[k], float(edges[k][at])
        left, all_left = binned[own, k] <= at, binned[all_own, k] <= at
        open_nodes.append((own[left], all_own[all_left], above, upto | {s: min(cut, upto.get(s, cut))}, depth + 1))
        open_nodes.append((own[~left], all_own[~all_left], above | {s: max(cut, above.get(s, cut))}, upto, depth + 1))
    return rules, step


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty on all weights but the bias, by accelerated proximal gradient steps."""
    n, m = x.shape
    a = np.column_stack([x, np.ones(n)])
    v = np.ones(m + 1)
    for _ in range(30):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    size = 4.0 * n / float(np.linalg.norm(a.T @ (a @ v)) * 1.02)
    w, z, t = np.zeros(m + 1), np.zeros(m + 1), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ z, -40, 40)))
        new = z - size * (a.T @ (p - y)) / n
        new[:m] = np.sign(new[:m]) * np.maximum(np.abs(new[:m]) - size * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w[:m], float(w[m])


def fit(x: np.ndarray, y: np.ndarray, *, seed: int = 3, penalty: float = LASSO) -> Model:
    """Rules from boosted trees, then their lasso weights. With one class only, or no rows, the score is constant: 0.5 without any label."""
    n = len(y)
    prior = (y.sum() + 1.0) / (n + 2.0)
    constant = Model(float(np.log(prior / (1 - prior))), ())
    if n < 2 or y.min() == y.max():
        return constant
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for k in range(x.shape[1])]
    # A cut in the middle between two values that occur: rows near the edge of the sample's values fall on the nearer side.
    values = [np.unique(c) for c in x.T]
    edges = [(v[np.searchsorted(v, e)] + v[np.minimum(np.searchsorted(v, e) + 1, len(v) - 1)]) / 2 for v, e in zip(values, edges)]
    edges = [np.unique(e[e < v[-1]]) for v, e in zip(values, edges)]
    binned = np.column_stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)])
    rng, logit, found = np.random.default_rng(seed), np.full(n, constant.bias), {}
    least = max(2, int(LEAST * n))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        rows = np.flatnonzero(rng.random(n) < 0.6)
        rules, step = _tree(binned, edges, y - p, p * (1 - p), rows, least)
        logit = logit + RATE * np.clip(step, -4, 4)
        found |= dict.fromkeys(rules)
    kept, columns, seen = [], [], set()
    for rule in found:
        holds = rule.holds(x)
        key = min(holds.tobytes(), (~holds).tobytes())
        if least <= holds.sum() <= n - least and key not in seen:
            seen.add(key)
            kept.append(rule)
            columns.append(holds)
    if not kept:
        return constant
    r = np.column_stack(columns).astype(np.float64)
    mean, scale = r.mean(axis=0), r.std(axis=0)
    w, bias = _lasso((r - mean) / scale, y, penalty, STEPS)
    w = w / scale
    return Model(bias - float((w * mean).sum()), tuple((rule, float(v)) for rule, v in zip(kept, w) if abs(v) > 1e-9))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = 12_000, **options: float) -> Model:
    """From the statistics of about max_docs labelled documents at most, chosen by a hash of the id.

    Labels other than 0 and 1, null ids and ids without a document teach nothing; an id with both labels counts as 1. Of rows that share an id, or
    an equal text, each counts. The chosen ids are broadcast: at most 1.1 times max_docs.
    """
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    marks = marks.withColumn("_h", F.pmod(F.xxhash64("_id"), F.lit(1 << 30)))
    n = marks.count()
    chosen = marks.where(F.col("_h") < int(min(1.0, max_docs / max(n, 1)) * (1 << 30))).orderBy("_h", "_id").limit(max_docs + max_docs // 10).select("_id", "_y")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = texts.join(F.broadcast(chosen), "_id").select(F.xxhash64("_id", "_text").alias("_h"), "_y", _statistics("_text").alias("_s")).orderBy("_h").limit(2 * max_docs).select("_y", "_s.*").toPandas()
    found = found.sort_values(list(found.columns), ignore_index=True)
    return fit(found[list(STATS)].to_numpy(np.float64).reshape(-1, len(STATS)), found["_y"].to_numpy(np.float64), **options)


def score_documents(docs: DataFrame, model: Model, *, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from threshold on). Only the text is read for them.

    A null text, an empty one and one without words have zero statistics and the score that the rules give to those. Columns score and
    predicted of docs, in any case, are replaced; rows are neither dropped nor combined, and an empty table gives an empty one.
    """
    rest = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted")])
    scored = renamed(rest).withColumn("_stats", _statistics(own_name(rest, text_col))).withColumn("_score", model.score(F.col("_stats")))
    return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest.columns)], F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, *, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, **options: float) -> DataFrame:
    """docs with score and predicted, learned from the labels of the documents where learn holds (an expression of the id)."""
    model = train(docs, labels.where(learn), id_col=id_col, text_col=text_col, label_col=label_col, **options)
    return score_documents(docs, model, threshold=threshold, text_col=text_col)
