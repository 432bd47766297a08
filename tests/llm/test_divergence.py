"""The audit against counts and sums in plain Python, with chunks and blocks so small that tiles matter."""

import random
import re
from collections import Counter, defaultdict

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwright.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return [t.translate(FOLD) for t in TERM.findall(text or "")]


def brute(rows, least=3, top=200):
    counts, in_docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        counts[lang, source].update(terms(text))
        in_docs[lang].update(set(terms(text)))
    found = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in in_docs[lang].items() if n >= least)
        whole = sum((counts[lang, s] for s in sources), Counter())

        def share(c, kept=kept):
            mass = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // mass for t in kept}

        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            own = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", own)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                found |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(items, 1) if part == "pair" or k <= top}
    return found


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "lang string, source string, text string") if isinstance(rows, list) else rows
    got = D.audit(docs, **options).collect()
    assert len(set(got)) == len(got)
    return {tuple(r) for r in got}


def made(n, sources, seed):
    rng = random.Random(seed)
    words = ["The", "the", "THE", "river", "Öl", "öl", "straße", "naïve", "it's", "a_b", "x1y", "日本", "e-mail", "Ünder"] + [f"w{chr(97 + i)}" for i in range(25)]
    weights = [rng.random() ** 3 + 0.01 for _ in words]
    return [(rng.choice(["en", "en", "de", None]), rng.choice(sources), " ".join(rng.choices(words, weights, k=rng.randrange(12)))) for _ in range(n)]


@pytest.mark.parametrize("chunk, stripe, block", [(16384, 16, 16), (5, 2, 2), (1, 3, 3)])
def test_like_plain_sums(spark, monkeypatch, chunk, stripe, block):
    for name, value in (("CHUNK", chunk), ("STRIPE", stripe), ("BLOCK", block)):
        monkeypatch.setattr(D, name, value)
    rows = made(160, ["s1", "s2", "s3", "s4", "s5", "", None], chunk)
    rows += [("fr", "s1", None), ("fr", "s2", ""), ("fr", "s3", "un deux"), ("xx", "lone", "un un un"), ("xx", "lone", "un"), ("xx", "lone", "un 9")] + [("en", "hot", "the river " * 5000)] * 4
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, top_terms=3, least_docs=5) == brute(rows, 5, 3)


def test_empty_and_clashing(spark, documents, clashing):
    assert run(spark, documents()) == set()
    rows = made(60, ["s1", "s2"], 9)
    docs = clashing(spark.createDataFrame(rows, "lang string, source string, text string")).withColumns({c: F.lit(1) for c in ("term", "at", "docs", "value", "rank", "no")})
    assert run(spark, docs) == brute(rows)


def test_parts_of_a_task(monkeypatch):
    rows = made(80, ["s1", "s2"], 4)
    batch = pa.RecordBatch.from_pandas(pd.DataFrame([tuple(v or "" for v in r) for r in rows], columns=["lang", "source", "text"]))
    counted = lambda *batches: [b.to_pandas() for b in D._count(iter(batches))]
    whole = pd.concat(counted(batch))
    monkeypatch.setattr(D, "HELD", 5)
    monkeypatch.setattr(D, "_LONG", 7)
    parts = counted(batch[:30], batch[30:])
    assert len(parts) > 10
    by = ["lang", "source", "term"]
    assert whole.groupby(by)[["n", "docs"]].sum().equals(pd.concat(parts).groupby(by)[["n", "docs"]].sum())
    assert all(D.terms_of(t) == [x.encode() for x in terms(t)] for _, _, t in rows)


def test_exact_shares_of_large_counts(spark):
    import numpy as np

    for count, mass in ((10**12, 10**15 + 7), (0, 3), (2, 3), (8 * 10**15, 8 * 10**15 + 1)):
        wanted = 1 + 10**9 * (count + 1) // mass
        assert D._shares(np.array([count]), np.array([mass]))[0] == wanted
        assert spark.range(1).select(F.lit(count).alias("c"), F.lit(mass - 1).alias("t"), F.lit(1).alias("v")).select(D._p("c", "t", "v")).first()[0] == wanted
