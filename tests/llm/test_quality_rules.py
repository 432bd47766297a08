"""The rule ensemble: compiled rules against plain evaluation, what it learns, and edges."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import quality_rules as Q
from loomwright.llm.common import held_out, table
from loomwright.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
GOOD = "The river rose in spring, and all of the old mills along it turned again. Nobody had seen so much water."
BAD = "BUY NOW!! CHEAP!! FREE!! CLICK!! HERE!! BUY NOW!! CHEAP!! FREE!!"


def plain_score(model, text):
    x = np.array([Q.statistics(text)])
    return 1 / (1 + np.exp(-(model.bias + sum(w for rule, w in model.rules if rule.holds(x)[0]))))


@pytest.fixture(scope="module")
def learned(spark):
    docs = table(spark, SF, "documents")
    return Q.train(docs, table(spark, SF, "labels").where(~held_out(F.col("doc_id"), 5, 0)))


def test_statistics_by_hand():
    s = dict(zip(Q.STATS, Q.statistics("Ab ab ab 12\n\n#x! ab.")))
    assert s["log_words"] == pytest.approx(np.log1p(6)) and s["repeats"] == pytest.approx(1 / 6) and s["distinct_words"] == pytest.approx(5 / 6)
    assert s["upper"] == pytest.approx(1 / 9) and s["digits"] == pytest.approx(2 / 14) and s["symbols"] == pytest.approx(1 / 14) and s["exclaims"] == pytest.approx(1 / 14) and s["stops"] == pytest.approx(1 / 14)
    assert s["marked_words"] == pytest.approx(1 / 6) and s["distinct_lines"] == 1 and s["ended_lines"] == pytest.approx(1 / 2)
    assert Q.statistics(None) == Q.statistics("") == Q.statistics(" \n ") == (0.0,) * len(Q.STATS)


def test_compiled_like_plain(spark, documents, learned, clashing):
    texts = [None, "", " ", GOOD, BAD, GOOD + "\n" + BAD, "word " * 200_000, "é" * 50, "a | b | c |\n| d", GOOD, GOOD]
    docs = clashing(documents(*enumerate(texts))).withColumn("Score", F.lit("theirs"))
    rows = Q.score_documents(docs, learned).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == list(range(len(texts)))
    for r, text in zip(rows, texts):
        assert r["score"] == pytest.approx(plain_score(learned, text)) and r["predicted"] == int(r["score"] >= 0.3)
    assert rows[3]["score"] == rows[9]["score"] and rows[0]["score"] == rows[1]["score"]
    assert "Score" not in rows[0].asDict() and rows[0]["kept"] == "kept"


def test_sparse_and_right_on_held_out_rows(spark, learned):
    out = held_out(F.col("doc_id"), 5, 0)
    scored = Q.score_documents(table(spark, SF, "documents").where(out), learned).join(table(spark, SF, "labels"), "doc_id")
    n, right, kept = scored.agg(F.count("*"), F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.avg(F.when(F.col("quality") == 1, F.col("predicted")))).first()
    assert n > 50 and right >= 0.95 and kept >= 0.97
    assert 1 <= len(learned.rules) <= 150 and all(1 <= len(rule.above) + len(rule.upto) <= 2 * Q.DEPTH for rule, _ in learned.rules)
    assert len(learned.describe()) == len(learned.rules) and " if " in learned.describe()[0]


def test_stronger_penalty_keeps_fewer_rules():
    rng = np.random.default_rng(0)
    x = rng.random((600, len(Q.STATS)))
    y = ((x[:, 3] > 0.6) & (x[:, 5] <= 0.5)).astype(float)
    weak, strong = Q.fit(x, y, penalty=0.001), Q.fit(x, y, penalty=0.03)
    assert 0 < len(strong.rules) < len(weak.rules)
    logit = weak.bias + sum(w * rule.holds(x) for rule, w in weak.rules)
    assert ((logit > 0) == (y == 1)).mean() > 0.97
    assert Q.fit(x, y).rules == Q.fit(x, y).rules


def test_labels_with_edges(spark, documents):
    docs = documents((1, GOOD), (2, BAD), (3, None), (None, GOOD), (2, BAD))
    labels = lambda *rows: spark.createDataFrame(rows, "doc_id bigint, quality int")
    for marks, wanted in ((labels(), 1), (labels((1, 1), (9, 0)), 1), (labels((2, 0)), 0), (labels((1, None), (None, 1), (2, 7)), 1)):
        rows = Q.classify(docs, marks, learn=F.lit(True)).collect()
        assert len(rows) == 5 and all(0 < r["score"] < 1 and r["predicted"] == wanted for r in rows)
    assert Q.classify(documents(), labels((1, 1)), learn=F.lit(True)).count() == 0
    many = documents(*[(i, GOOD if i % 2 else BAD) for i in range(60)])
    marks = labels(*[(i, i % 2) for i in range(60)])
    rows = Q.classify(many, marks, learn=F.col("doc_id") < 40).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in rows)


def test_query_on_the_smallest_tables(spark):
    small = "/root/testdata/sf0.001"
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    model = Q.train(docs, labels.where(~held_out(F.col("doc_id"), 5, 0)))
    texts = dict(docs.select("doc_id", "text").collect())
    rows = QUERIES["op11_quality_rules"](spark, small).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert r["score"] == pytest.approx(plain_score(model, texts[r["doc_id"]])) and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
