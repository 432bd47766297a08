"""Toxicity: bags of subword embeddings, averaged, into a linear softmax.

A word is the mean of the vectors of its character n-grams (with marks for its two ends), a document the
mean of its words, and a softmax over two classes reads that mean. Vectors and softmax are trained
together by Adagrad in numpy. A misspelling that was never seen shares most n-grams with the word it comes from.

Training uses a bounded sample of labelled documents (max_toxic and max_clean; documents over max_chars are left out
of the sample, never of the scoring), whose texts go to the driver. The model has a fixed size. Since the
softmax is linear, scoring needs one number for each n-gram, the vectors' dot product with the softmax, which is
broadcast (BUCKETS floats).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_groups, tidy

BUCKETS = 1 << 17
ORDERS = (3, 4, 5, 6)
DIM = 4
EPOCHS = 6
BATCH = 32
RATE = 0.15
GAIN = 60.0  # the mean of many words is small; the softmax reads it this much enlarged
NULL_WORDS = 30  # zero vectors in every mean, so that a text of few words isn't judged by one of them
CACHE = 100_000  # words remembered by a worker, then forgotten all at once
WORDS_AT_ONCE = 5_000  # whose n-grams are held together, some 2,000 bytes a word
WORD = re.compile(r"\w(?:\S*\w)?")
_M = np.uint32(0x9E3779B1)


def words_of(text: str | None) -> list[str]:
    """Runs without white space, lower-cased, without marks at their ends. Inner marks and digits stay: they are how words are disguised."""
    return WORD.findall((text or "").lower())


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all words, and the bounds of each word's. Every word has one at least."""
    joined = "".join(f"<{w}>" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(w) + 2 for w in words], dtype=np.int64)
    ends = np.repeat(np.cumsum(lengths), lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(codes))
    all_b, all_o = [], []
    h = np.zeros(len(codes), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = (h[: len(codes) - n + 1] ^ codes[n - 1 :]) * _M
        h ^= h >> np.uint32(15)
        if n in ORDERS:
            inside = at[: len(h)] + n <= ends[: len(h)]
            all_b.append((h & np.uint32(BUCKETS - 1))[inside].astype(np.int32))
            all_o.append(owner[: len(h)][inside])
    buckets, owners = np.concatenate(all_b), np.concatenate(all_o)
    order = np.argsort(owners, kind="stable")
    return buckets[order], np.searchsorted(owners[order], np.arange(len(words) + 1))


@dataclass
class Model:
    table: np.ndarray  # by bucket: dot product of its vector with the difference of the two classes
    bias: float

    def word_values(self, words: list[str]) -> np.ndarray:
        values = [np.zeros(0)]
        for at in range(0, len(words), WORDS_AT_ONCE):
            buckets, bounds = subwords(words[at : at + WORDS_AT_ONCE])
            values.append(np.add.reduceat(self.table[buckets], bounds[:-1], dtype=np.float64) / np.diff(bounds))
        return np.concatenate(values)


class Scorer:
    """Of one worker; remembers the values of words."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def score(self, texts: list[str]) -> list[float]:
        found = [words_of(t) for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        new = [w for w in set().union(*found) if w not in self.known]
        self.known.update(zip(new, self.model.word_values(new).tolist()))
        logits = [self.model.bias + (GAIN * sum(map(self.known.__getitem__, ws)) / (len(ws) + NULL_WORDS)) for ws in found]
        return (1 / (1 + np.exp(-np.clip(logits, -40, 40)))).tolist()


def _rows(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each text, the buckets that it has and their weights in the mean."""
    buckets, weights = [], []
    for text in texts:
        counts = Counter(words_of(text))
        if not counts:
            buckets.append(np.zeros(0, dtype=np.int64))
            weights.append(np.zeros(0, dtype=np.float32))
            continue
        b, bounds = subwords(list(counts))
        sizes = np.diff(bounds)
        w = np.repeat(np.array(list(counts.values())) / sizes, sizes) / (sum(counts.values()) + NULL_WORDS)
        own, where = np.unique(b, return_inverse=True)
        buckets.append(own)
        weights.append(np.bincount(where, weights=w).astype(np.float32))
    return buckets, weights


def fit(texts: list[str], toxic: list[int], seed: int = 5) -> Model:
    """Train vectors and softmax together. Classes weigh the same in all, whatever their counts."""
    y = np.array(toxic, dtype=np.int64)
    if len(set(toxic)) < 2:  # nothing to tell apart: the constant that was seen, or clean without any label
        return Model(np.zeros(BUCKETS, dtype=np.float32), 4.0 if len(y) and y[0] == 1 else -4.0)
    rng = np.random.default_rng(seed)
    buckets, weights = _rows(texts)
    class_weight = len(y) / (2.0 * np.bincount(y, minlength=2))
    vectors = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    softmax = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    seen_v, seen_s, seen_b = np.full((BUCKETS, DIM), 1e-6, dtype=np.float32), np.full((DIM, 2), 1e-6), np.full(2, 1e-6)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS) + 0.01
        for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
            size = [len(buckets[i]) for i in at]
            b = np.concatenate([buckets[i] for i in at])
            w = np.concatenate([weights[i] for i in at]) * GAIN
            doc = np.repeat(np.arange(len(at)), size)
            own, where = np.unique(b, return_inverse=True)
            v = vectors[own]
            mean = np.stack([np.bincount(doc, weights=w * v[where, k], minlength=len(at)) for k in range(DIM)], axis=1)
            z = mean @ softmax + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(at)), y[at]] -= 1
            p *= class_weight[y[at]][:, None] / len(at)
            back = p @ softmax.T
            grad = np.stack([np.bincount(where, weights=w * back[doc, k], minlength=len(own)) for k in range(DIM)], axis=1)
            grad_s, grad_b = mean.T @ p, p.sum(axis=0)
            seen_v[own] += grad**2
            vectors[own] -= rate * grad / np.sqrt(seen_v[own])
            seen_s += grad_s**2
            softmax -= (rate * grad_s / np.sqrt(seen_s)).astype(np.float32)
            seen_b += grad_b**2
            bias -= (rate * grad_b / np.sqrt(seen_b)).astype(np.float32)
    return Model((vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = 1500, max_clean: int = 3000, max_chars: int = 50_000) -> Model:
    """From about max_toxic and max_clean labelled documents at most; from all of a class that has no more.

    The sample is chosen by a hash of the id among the labels, so it is at most a few thousand ids when it is broadcast to
    find the texts. Labels other than 0 and 1, null ids and null texts teach nothing. The
    sample is the only part of the corpus that the driver sees.
    """
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"), F.pmod(F.xxhash64(id_col), F.lit(1 << 30)).alias("_h"))
    most = {0: max_clean, 1: max_toxic}
    counts = {r["_y"]: r["count"] for r in marks.groupBy("_y").count().collect()}
    if not counts:
        return fit([], [])
    room = F.create_map(*[x for y, n in counts.items() for x in (F.lit(y), F.lit(int(min(1.0, most[y] / n) * (1 << 30))))])
    chosen = marks.where(F.col("_h") < room[F.col("_y")]).orderBy("_h", "_id", "_y").limit(2 * (max_toxic + max_clean)).groupBy("_id").agg(F.max("_y").alias("_y"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull() & (F.char_length("_text") <= max_chars))
    found = texts.join(F.broadcast(chosen), "_id").orderBy(F.xxhash64("_id"), "_id", F.xxhash64("_text")).select("_text", "_y").limit(2 * (max_toxic + max_clean)).collect()
    sample = sorted((r["_text"], r["_y"]) for r in found)
    return fit([t for t, _ in sample], [y for _, y in sample])


def score_documents(docs: DataFrame, model: Model, *, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """docs with score and predicted (1 from threshold on). Only the text is read for them.

    A null text, an empty one and one without words get the score of the bias alone. Columns score
    and predicted of docs are replaced; rows are neither dropped nor combined.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pd.Series([s for texts in text_groups(batch) for s in scorer.score(texts)], dtype="float64")

    udf = F.pandas_udf(tidy(run), "double")
    rest = docs.drop("score", "predicted")
    return rest.withColumn("score", udf(F.col(text_col))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def detect(docs: DataFrame, labels: DataFrame, *, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7, **bounds: int) -> DataFrame:
    """docs with score and predicted, learned from the labels of the documents where learn holds (an expression of the id)."""
    model = train(docs, labels.where(learn), id_col=id_col, text_col=text_col, label_col=label_col, **bounds)
    return score_documents(docs, model, threshold=threshold, text_col=text_col)
