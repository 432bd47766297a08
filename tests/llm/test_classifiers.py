import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import lang_id as L
from loomwright.llm import toxicity as X
from loomwright.llm.common import held_out

WORDS = {"en": "the of and to in is that for with was house water".split(), "de": "der die und das nicht mit für ist auf straße wasser haus".split(), "fr": "le la les des une être dans pour avec maison eau où".split()}


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(2)
    return [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(4, 60))), lang, "s") for i in range(400) for lang in [list(WORDS)[i % 3]]]


def test_held_out_is_crc32(spark):
    got = [r[0] for r in spark.range(200).select(held_out(F.col("id"))).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(200)]


def test_languages_on_held_out_rows(documents, clashing, prose):
    extra = [(1000, None, "en", "s"), (1001, "", None, "s"), (1002, "123 !?", "de", "s"), (1003, "\0 der und \0", None, "s"), (1003, "der und nicht " * 50_000, None, "s"), (None, "the of and", "en", "s")]
    docs = clashing(documents(*prose, *extra))
    out = L.identify(docs, learn=~held_out(F.col("doc_id")))
    rows = out.collect()
    assert len(rows) == len(prose) + len(extra) and all(0 <= r["score"] <= 1 for r in rows)
    got = {r["doc_id"]: r["lang_pred"] for r in rows}
    test = [p for p in prose if zlib.crc32(str(p[0]).encode()) % 3 == 1]
    assert sum(got[p[0]] == p[2] for p in test) / len(test) > 0.98
    assert got[1000] == got[1001] == got[1002] == "und" and got[1003] == "de" and got[None] == "en"


def test_language_edges(documents):
    assert L.identify(documents((1, "a")).limit(0), learn=F.lit(True)).count() == 0
    none = L.identify(documents((1, "the of", None, "s")), learn=F.lit(True)).first()
    assert none["lang_pred"] == "und" and none["score"] == 0
    with pytest.raises(ValueError, match="more than 2 languages"):
        L.train(documents((1, "a", "x", "s"), (2, "b", "y", "s"), (3, "c", "z", "s")), max_classes=2)


def test_a_batch_is_scored_as_single_texts_are():
    texts = ["der und", "", "the of", "\0", "x" * 3000]
    all_, bounds, letters = L.sparse_rows(texts)
    for i, t in enumerate(texts):
        one, _, letter = L.sparse_rows([t])
        assert sorted(all_[bounds[i] : bounds[i + 1]]) == sorted(one) and letters[i] == letter[0]


def grams(text):
    """Hashed n-grams by the definition, one character at a time."""
    t = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
    while "  " in t:
        t = t.replace("  ", " ")
    out = []
    for n in (1, 2, 3):
        for i in range(len(t) - n + 1):
            if t[i : i + n] == " ":
                continue
            h = n
            for k, m in zip(t[i : i + n], (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
                h = (h ^ ord(k)) * m & 0xFFFFFFFF
                h ^= h >> 15
            out.append(h % L.BUCKETS)
    return out


def test_languages_like_plain_bayes(documents, prose):
    rows = [*prose[:120], (2000, "Straße, house! 12 maison", "de", "s"), (2001, "Été\nÀ", None, "s"), (2002, "x", "fr", "s")]
    learned = [r for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 3 != 1]
    langs = sorted({r[2] for r in learned})
    counts = {k: Counter(g for r in learned if r[2] == k for g in grams(r[1])) for k in langs}
    log = lambda k, g: math.log((counts[k][g] + L.ALPHA) / (sum(counts[k].values()) + L.ALPHA * L.BUCKETS))
    prior = {k: math.log((sum(r[2] == k for r in learned) + 1) / (len(learned) + len(langs))) for k in langs}
    for r in L.identify(documents(*rows), learn=~held_out(F.col("doc_id"))).collect():
        text = next(x[1] for x in rows if x[0] == r["doc_id"])
        z = {k: prior[k] + sum(log(k, g) for g in grams(text)) for k in langs}
        best = max(langs, key=lambda k: z[k])
        assert r["lang_pred"] == best and r["score"] == pytest.approx(1 / sum(math.exp(v - z[best]) for v in z.values()), rel=1e-3)


@pytest.fixture(scope="module")
def marked():
    rng = random.Random(4)
    bad, rows = ["idiot", "worthless", "pathetic", "moron", "disgusting"], []
    syllables = ["an", "er", "th", "on", "re", "ing", "ble", "st", "ou", "wh"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    for i in range(900):
        toxic = i % 4 == 0
        words = [word() for _ in range(rng.randint(10, 150))]
        if toxic:
            for _ in range(2 + len(words) // 40):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_on_held_out_rows_and_misspellings(spark, documents, marked):
    docs = documents(*[(i, t) for i, t, _ in marked], (5000, "such an idi0t and a moronn, whwhwh thanre " * 2), (5001, None), (5002, ""), (5003, "worthless " * 30_000))
    docs = docs.withColumn("score", F.lit("clash")).withColumn("_text", F.lit(1))
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in marked] + [(None, 1, 1), (7, 1, None), (77777, 0, 1)], "doc_id bigint, quality int, toxic int")
    rows = {r["doc_id"]: r for r in X.detect(docs, labels, learn=~held_out(F.col("doc_id"))).collect()}
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows.values())
    test = [m for m in marked if zlib.crc32(str(m[0]).encode()) % 3 == 1]
    assert sum(rows[i]["predicted"] == y for i, _, y in test) / len(test) > 0.97
    assert rows[5000]["predicted"] == 1 and rows[5003]["predicted"] == 1
    assert rows[5001]["score"] == rows[5002]["score"] and rows[5001]["predicted"] == 0


def plain_subwords(word):
    """Buckets of a word's n-grams by the definition; those of the shorter lengths first."""
    w, out = f"<{word}>", []
    for n in X.ORDERS:
        for i in range(len(w) - n + 1):
            h = 0
            for c in w[i : i + n]:
                h = (h ^ ord(c)) * 0x9E3779B1 & 0xFFFFFFFF
                h ^= h >> 15
            out.append(h % X.BUCKETS)
    return out


def plain_row(text):
    """The weights of all buckets in a document's mean."""
    words, row = X.words_of(text), Counter()
    for w in words:
        own = plain_subwords(w)
        for b in own:
            row[b] += 1 / len(own) / (len(words) + X.NULL_WORDS)
    return row


def test_scores_like_the_definition():
    rng = np.random.default_rng(3)
    model = X.Model(rng.normal(size=X.BUCKETS).astype(np.float32), 0.3)
    texts = ["", "idiot", "such an i.d-iot! \n x", "ééé 😀😀", "a " * 400 + "worthless"]
    want = [1 / (1 + math.exp(-(0.3 + X.GAIN * sum(v * float(model.table[b]) for b, v in plain_row(t).items())))) for t in texts]
    assert X.Scorer(model).score(texts) == pytest.approx(want, rel=1e-5)


def test_training_like_dense_gradients(marked):
    """Adagrad on dense matrices over the buckets in use, with the softmax's gradient by definition."""
    texts, y = [t for _, t, _ in marked[:80]], np.array([v for *_, v in marked[:80]])
    rows = [plain_row(t) for t in texts]
    used = sorted(set().union(*rows))
    x = np.zeros((len(rows), len(used)))
    for i, row in enumerate(rows):
        for b, v in row.items():
            x[i, used.index(b)] = v * X.GAIN
    rng = np.random.default_rng(5)
    v = rng.normal(0, 0.1, (X.BUCKETS, X.DIM)).astype(np.float32)[used].astype(float)
    s, bias = rng.normal(0, 0.3, (X.DIM, 2)).astype(np.float32).astype(float), np.zeros(2)
    gv, gs, gb = np.full(v.shape, 1e-6), np.full(s.shape, 1e-6), np.full(2, 1e-6)
    share = np.array([len(y) / (2 * (y == k).sum()) for k in (0, 1)])
    for epoch in range(X.EPOCHS):
        rate = X.RATE * (1 - epoch / X.EPOCHS) + 0.01
        for at in np.array_split(rng.permutation(len(y)), len(y) // X.BATCH):
            z = x[at] @ v @ s + bias
            p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
            error = (p - np.eye(2)[y[at]]) * share[y[at]][:, None] / len(at)
            dv, ds, db = x[at].T @ error @ s.T, (x[at] @ v).T @ error, error.sum(axis=0)
            touched = x[at].any(axis=0)
            gv[touched] += dv[touched] ** 2
            v[touched] -= rate * dv[touched] / np.sqrt(gv[touched])
            gs, gb = gs + ds**2, gb + db**2
            s, bias = s - rate * ds / np.sqrt(gs), bias - rate * db / np.sqrt(gb)
    model = X.fit(texts, y.tolist())
    got, want = model.table[used], v @ (s[:, 1] - s[:, 0])
    assert np.abs(got - want).max() < 0.02 * np.abs(want).max() and model.bias == pytest.approx(bias[1] - bias[0], abs=0.02)


def test_toxicity_without_labels(spark, documents):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    out = X.detect(documents((1, "idiot"), (None, None)), labels, learn=F.lit(True)).collect()
    assert [r["predicted"] for r in out] == [0, 0]
    assert X.detect(documents((1, "a")).limit(0), labels, learn=F.lit(True)).count() == 0


def test_n_grams_of_many_new_words_take_little_room():
    model, words = X.Model(np.arange(X.BUCKETS, dtype=np.float32), 0.0), [f"w{i * 7919:x}rd" for i in range(30_000)]
    tracemalloc.start()
    values = model.word_values(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 800 * len(words)
    assert len(values) == len(words) and all(values[i] == model.word_values([words[i]])[0] for i in (0, 4_999, 5_000, 29_999))
