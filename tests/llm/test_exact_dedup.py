import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from loomwright.llm import exact_dedup as X
from loomwright.llm.common import LOWER, UPPER

FOLD = str.maketrans(UPPER, LOWER)
TEXTS = ["Same Text", "same text", "ÄÖ", "äö", "Äö", "", None, "x" * 200_000, "X" * 200_000, "other", "p" * 40 + "a", "p" * 40 + "b"]


def brute(rows, pick):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(FOLD)].append(i)
    out = []
    for t, ids in groups.items():
        best = pick(ids)
        for i in ids:
            out.append((i, best, len(ids), i == best, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))


def test_like_brute_force_both_ways(documents, clashing):
    rows = list(enumerate(TEXTS))
    for keep, pick in (("smallest", min), ("largest", max)):
        assert rows_of(X.exact_groups(clashing(documents(*rows)), keep=keep)) == brute(rows, pick)


def test_heavy_texts_are_split_and_whole(spark, documents):
    rows = [(i, "Copy" if i % 3 else f"own {i}") for i in range(4000)]
    got = X.exact_groups(documents(*rows), keep="largest", most=500)
    assert rows_of(got) == brute(rows, max)


def test_heavy_texts_that_are_not_broadcast(documents, monkeypatch):
    monkeypatch.setattr(X, "SMALL", 0)
    rows = [(i, ("Copy", "copy", f"own {i}", None)[i % 4]) for i in range(400)]
    assert rows_of(X.exact_groups(documents(*rows), most=20)) == brute(rows, min)


def test_dropping_keeps_columns_with_names_of_its_own(documents):
    own = ("_h", "_id", "_norm", "_salt", "_rank", "_best", "_n", "_sha", "_kept", "_keep_id", "_lead", "c0", "a.b")
    d = documents((1, "a"), (2, "A"), (3, "b")).withColumns({c: F.lit(c) for c in own})
    for most in (1, 100):
        out = X.drop_exact_copies(d, most=most)
        assert out.columns == d.columns and sorted((r["doc_id"], *r[5:]) for r in out.collect()) == [(1, *own), (3, *own)]


def test_empty_table_null_ids_and_repeated_rows(documents):
    assert X.exact_groups(documents((1, "a")).limit(0)).count() == 0
    got = [tuple(r) for r in X.exact_groups(documents((None, "a"), (3, "a"), (3, "a"), (None, "b"))).select("doc_id", "keep_id", "group_size", "kept").collect()]
    assert sorted(got, key=str) == sorted([(None, 3, 3, False), (3, 3, 3, True), (3, 3, 3, False), (None, None, 1, True)], key=str)


def test_dropping_keeps_columns_and_one_of_each(documents, clashing):
    d = clashing(documents((1, "a"), (2, "A"), (2, "A"), (3, None), (4, "")))
    out = X.drop_exact_copies(d, keep="largest")
    assert out.columns == d.columns and sorted(r["doc_id"] for r in out.collect()) == [2, 4]


def test_texts_are_shuffled_once_and_no_python_runs(documents):
    plan = X.exact_groups(documents((1, "a")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "hashpartitioning" not in plan and plan.count("rangepartitioning") >= 1
