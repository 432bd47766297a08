"""The manifest against a tree built in plain Python, over trees of one block and of several tiers."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from loomwright.llm import merkle

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes):
    """The root of nodes, and of each the (left, right) of every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for k, i in enumerate(at):
            paths[k].append(("".join(runs[i // 3][: i % 3]), "".join(runs[i // 3][i % 3 + 1 :])))
        nodes, at = [H(*run) for run in runs], [i // 3 for i in at]
    return nodes[0], paths


def brute(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s, own in by_source.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = climb([leaf(r) for r in own])
    root, over = climb([trees[s][0] for s in order])
    found = []
    for s, up in zip(order, over):
        for r, path in zip(by_source[s], trees[s][1]):
            path = path + up
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = leaf((*r[:4], r[4].replace("\n", "") if r[4] else r[4])) if even else leaf(r)
            for left, right in path:
                node = H(left, node, right)
            found.append((r[0] if r[0] is not None else -1, leaf(r), trees[s][0], root, H(*[left + right for left, right in path]), node, node == root))
    return sorted(found)


def run(spark, rows, docs=None):
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string") if docs is None else docs
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    claimed = F.when(even, merkle.digest(*[F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in COLUMNS]))
    got = merkle.verified(merkle.build(docs, claimed=claimed).proofs())
    return sorted((r["id"] if r["id"] is not None else -1, r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in got.collect())


def made(n, sources, seed):
    rng = random.Random(seed)
    texts = [None, "", "one line", "two\nlines", "drei Zeilen\nü\n€", "\n", "long\n" * 3000]
    return [(i, rng.choice(sources), rng.choice(["en", None]), rng.choice([None, 5]), rng.choice(texts)) for i in rng.sample(range(10 * n), n)]


def test_edges(spark):
    rows = made(90, ["a", "a", "a", "b", None, "", "é", "z"], 1)
    rows += [rows[0], rows[0], (None, "a", None, None, None), (None, None, "x", 1, "\n"), (7000, "only", "en", 1, "alone\n")]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("height, n, sources", [(1, 60, ["a"]), (2, 130, ["a"] * 8 + ["b", "c"]), (2, 83, ["a"]), (2, 200, [f"s{i}" for i in range(30)])])
def test_tiers(spark, monkeypatch, height, n, sources):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "BLOCK", 3**height)
    rows = made(n, sources, n)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28])
def test_sizes_of_one_source(spark, monkeypatch, n):
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)
    rows = made(n, ["s"], n)
    assert run(spark, rows) == brute(rows)


def test_empty_and_clashing(spark, documents, clashing):
    manifest = merkle.build(documents())
    assert manifest.root is None and manifest.proofs().count() == 0
    rows = [(1, "a", "en", 3, "x\ny"), (2, "a", "en", 3, "z")]
    docs = clashing(spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")).withColumns({"key": F.lit(1), "node": F.lit(2), "total": F.lit(3), "at": F.lit(4)})
    assert run(spark, rows, docs) == brute(rows)


def test_store_and_proofs(spark):
    rows = made(40, ["a", "b"], 5)
    manifest = merkle.build(spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string"))
    assert spark.read.parquet(manifest.sources.path).select("level").distinct().count() == manifest.sources.levels
    got = merkle.verified(manifest.proofs()).collect()
    assert all(r["verified"] and r["folded_root"] == manifest.root for r in got) and len(got) == 40
    forged = merkle.verified(manifest.proofs().withColumn("claimed", F.sha2(F.lit("forged").cast("binary"), 256)))
    assert not any(r["verified"] for r in forged.collect())
