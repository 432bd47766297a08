"""Language identification: multinomial naive Bayes over hashed character n-grams.

Text is lower-cased; every character but a letter becomes one space, runs of which count once. All
1- to 3-grams of the result are hashed into BUCKETS. Training counts buckets by language on executors, with
add-ALPHA smoothing; the log-probability matrix has BUCKETS x languages floats (the number of languages is bounded by
max_classes), so it is broadcast. Scoring turns a batch of texts into one sparse matrix (row
bounds and bucket numbers) and sums rows of the log-probability matrix by it, in numpy.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_groups

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
ALPHA = 0.5
_M = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """By code point: is it a letter? Made once in a worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1))
    return _letters[0]


def sparse_rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all texts, the bounds of each text's among them, and whether it has a letter.

    A space is put before and after each text, so that no n-gram spans two texts.
    """
    joined = " \x00 ".join(["", *texts, ""]).lower()
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    cut = codes == 0
    is_letter = letter_table()[codes]
    # A text may hold U+0000 itself; the separators are those that follow the texts' own lengths.
    lengths = np.array([len(t.lower()) for t in texts])
    starts = np.concatenate([[1], 1 + np.cumsum(lengths + 3)])
    cut[:] = False
    cut[starts[:-1]] = True
    cut[starts[-1]] = True
    owner = np.cumsum(cut) - 1
    codes = np.where(is_letter, codes, np.uint32(32))
    codes[cut] = 0
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = ~((codes[1:] == 32) & (codes[:-1] == 32))
    codes, owner, is_letter = codes[keep], owner[keep], is_letter[keep]
    all_b, all_o = [], []
    for n in ORDERS:
        h = np.full(max(0, len(codes) - n + 1), n, dtype=np.uint32)
        whole = np.ones(len(h), dtype=bool)
        for k in range(n):
            part = codes[k : len(codes) - n + 1 + k]
            h = (h ^ part) * _M[k]
            h ^= h >> np.uint32(15)
            whole &= part != 0
        if n == 1:
            whole &= codes != 32
        all_b.append((h & np.uint32(BUCKETS - 1))[whole])
        all_o.append(owner[: len(h)][whole])
    buckets, owners = np.concatenate(all_b), np.concatenate(all_o)
    order = np.argsort(owners, kind="stable")
    bounds = np.searchsorted(owners[order], np.arange(len(texts) + 1))
    has_letter = np.bincount(owner[is_letter & (owner >= 0)], minlength=len(texts) + 1)[: len(texts)] > 0
    return buckets[order], bounds, has_letter


def train(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 20_000, max_classes: int = 64) -> tuple[list[str], np.ndarray]:
    """Languages and the log-probability matrix (BUCKETS + 1 rows; the last has log priors).

    Learned from about max_docs rows with a language and a text, chosen by a hash of id and text (so that copies of one text are rows like any others); from all, where they are no
    more. More than max_classes languages are an error. Without any labelled row the model has no language.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("draw"))
    total = rows.count()
    if total > max_docs:
        rows = rows.where(F.pmod("draw", F.lit(1_000_000)) < int(1_000_000 * max_docs / total))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                for texts in text_groups(part["text"]):
                    buckets, _, _ = sparse_rows(texts)
                    own = sums.setdefault(lang, np.zeros(BUCKETS + 1, dtype=np.int64))
                    own[:BUCKETS] += np.bincount(buckets, minlength=BUCKETS)
                    own[BUCKETS] += len(texts)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": own[at]})

    counts = rows.drop("draw").mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # At most (BUCKETS + 1) * max_classes rows: one array for each language.
    found = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).limit(max_classes + 1).toPandas()
    if len(found) > max_classes:
        raise ValueError(f"more than {max_classes} languages")
    found = found.sort_values("lang")
    langs = list(found["lang"])
    n = np.zeros((BUCKETS + 1, len(langs)))
    for i, c in enumerate(found["c"]):
        pairs = np.array([(r["bucket"], r["n"]) for r in c], dtype=np.int64)
        n[pairs[:, 0], i] = pairs[:, 1]
    model = np.empty(n.shape, dtype=np.float32)
    model[:BUCKETS] = np.log(n[:BUCKETS] + ALPHA) - np.log(n[:BUCKETS].sum(axis=0) + ALPHA * BUCKETS)
    model[BUCKETS] = np.log((n[BUCKETS] + 1) / (n[BUCKETS].sum() + max(1, len(langs))))
    return langs, model


def score(langs: list[str], model: np.ndarray, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its posterior probability; "und" and 0 without a letter or a model."""
    if not langs:
        return ["und"] * len(texts), np.zeros(len(texts))
    buckets, bounds, has_letter = sparse_rows(texts)
    logs = np.tile(model[-1].astype(np.float64), (len(texts), 1))
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        for k in range(len(langs)):
            logs[full, k] += np.add.reduceat(model[:, k][buckets], bounds[:-1][full], dtype=np.float64)
    logs -= logs.max(axis=1, keepdims=True)
    p = np.exp(logs)
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    return [langs[b] if ok else "und" for b, ok in zip(best, has_letter)], np.where(has_letter, p[np.arange(len(texts)), best], 0.0)


def predict(docs: DataFrame, langs: list[str], model: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, lang_pred, score.

    Only the text is read for a prediction. A null text, an empty one and one without letters are "und"
    with score 0. Of equally likely languages the alphabetically first is taken. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((langs, model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        langs, model = shared.value
        for batch in batches:
            names, scores = [], []
            for texts in text_groups(batch["text"]):
                a, b = score(langs, model, texts)
                names += a
                scores.append(b)
            yield pd.DataFrame({"id": batch["id"], "lang_pred": names, "score": np.concatenate(scores) if scores else []})

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInPandas(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def identify(docs: DataFrame, *, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds: int) -> DataFrame:
    """Learn from the rows where learn holds, predict all."""
    langs, model = train(docs.where(learn), id_col=id_col, text_col=text_col, lang_col=lang_col, **bounds)
    return predict(docs, langs, model, id_col=id_col, text_col=text_col)
