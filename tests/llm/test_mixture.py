import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomwright.llm import mixture as M


@pytest.fixture
def rows():
    langs, topics = ["en", "en", "en", "de", None], ["plain words here ", "a@b mail ", "x | y | z "]
    return [(i, topics[i % 7 % 3] * (1 + i % 11), langs[i % 5], f"s{0 if i % 2 else i % 6}") for i in range(600)]


def brute(rows, rounds=16, temperature=0.7, fraction=0.5):
    tokens = lambda t: len(t.split()) if t else 0
    topic = lambda t: "contact" if "@" in t else "table" if " | " in t else "prose"
    cell = lambda r: (r[3] or "(null)", r[2] or "(null)", topic(r[1] or ""))
    have = defaultdict(float)
    for r in rows:
        have[cell(r)] += tokens(r[1])
    total = sum(have.values())
    w = {c: n / total for c, n in have.items()}
    target = []
    for d in range(3):
        m = defaultdict(float)
        for c, n in have.items():
            m[c[d]] += n / total
        p = {k: v**temperature for k, v in m.items()}
        target.append({k: v / sum(p.values()) for k, v in p.items()})
    for _ in range(rounds):
        for d in range(3):
            m = defaultdict(float)
            for c, v in w.items():
                m[c[d]] += v
            w = {c: v * target[d][c[d]] / m[c[d]] for c, v in w.items()}
    scale = min(fraction * total, 1 / max(w[c] / have[c] for c in w))
    draw = lambda i: int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:12], 16) / (1 << 48)
    return {r[0]: (tokens(r[1]), w[cell(r)] / have[cell(r)] * scale, draw(r[0]) < w[cell(r)] / have[cell(r)] * scale) for r in rows}, target, have


def test_like_brute_force(documents, rows, clashing):
    want, _, _ = brute(rows)
    for r in M.mix(clashing(documents(*rows))).collect():
        n, p, s = want[r["doc_id"]]
        assert r["n_tokens"] == n and r["probability"] == pytest.approx(p, rel=1e-9) and r["sampled"] == s


def test_expected_tokens_meet_the_marginals(documents, rows):
    _, target, _ = brute(rows)
    got = M.mix(documents(*rows), rounds=40).groupBy("source").agg(F.sum(F.col("probability") * F.col("n_tokens")).alias("e")).collect()
    total = sum(r["e"] for r in got)
    for r in got:
        assert r["e"] / total == pytest.approx(target[0][r["source"]], rel=1e-6)


def test_given_targets(documents, rows):
    got = M.mix(documents(*rows), targets={"lang": {"en": 0.2, "de": 0.7, M.OTHER: 0.1}}, rounds=40)
    e = {r["lang"]: r["e"] for r in got.groupBy("lang").agg(F.sum(F.col("probability") * F.col("n_tokens")).alias("e")).collect()}
    assert e["de"] / sum(e.values()) == pytest.approx(0.7, rel=1e-6) and e[None] / sum(e.values()) == pytest.approx(0.1, rel=1e-6)


def test_topics_are_the_densest_marks(documents):
    texts = [None, "", "word " * 300 + "a | b", "word " * 50 + "a | b", "x | y ** z", "x | y ** z **** v", "Permission; and copyright", "mail a.b@c.org or so", "f => {}", "é@ alone", "a | b ## c"]
    got = {r["doc_id"]: r["t"] for r in documents(*enumerate(texts)).select("doc_id", M.topic_of(F.col("text")).alias("t")).collect()}
    assert [got[i] for i in range(len(texts))] == ["prose", "prose", "prose", "table", "table", "noise", "legal", "contact", "code", "contact", "table"]


def test_sampling_keeps_columns_with_names_of_its_own(documents):
    d = documents(*[(i, f"word {i}") for i in range(60)]).withColumns({c: F.lit(c) for c in ("n_tokens", "topic_", "probability", "sampled", "tokens", "p", "_source", "t_lang", "c1", "a.b")})
    out = M.sample(d)
    ids = {r["doc_id"] for r in M.mix(d).where("sampled").collect()}
    assert out.columns == d.columns and 0 < len(ids) < 60 and {(r["doc_id"], r["n_tokens"], r["sampled"]) for r in out.collect()} == {(i, "n_tokens", "sampled") for i in ids}


def test_edges(documents):
    assert M.mix(documents((1, "a")).limit(0)).count() == 0
    got = {r["doc_id"]: r for r in M.mix(documents((1, None, None, None), (2, "", "en", "s"), (3, "one", "en", "s"), (3, "one", "en", "s"), (None, "one", "en", "s"))).collect()}
    assert got[1]["n_tokens"] == 0 and got[1]["probability"] == 0.0 and not got[1]["sampled"]
    assert got[2]["probability"] == got[3]["probability"] > 0
    none = M.mix(documents((1, None), (2, "")))
    assert [r["sampled"] for r in none.collect()] == [False, False]


def test_no_python_runs(documents):
    assert "Python" not in M.mix(documents((1, "a b")))._jdf.queryExecution().executedPlan().toString()


def skewed():
    """A hot source, a tail of 300 sources under 1/128 of all tokens each, and a tiny cell of a rare language and topic."""
    rows = [(i, "plain words here " * 3, "en" if i % 3 else "de", "hot") for i in range(500)]
    rows += [(1000 + i, "plain words " * (1 + i % 5), "en" if i % 3 else "de", f"tail{i % 300}") for i in range(900)]
    return [*rows, (5000, "a@b mail", "fr", "hot")]


def marginals(got):
    total = sum(r["probability"] * r["n_tokens"] for r in got)
    e = defaultdict(float)
    for r in got:
        e[r["source"]] += r["probability"] * r["n_tokens"]
    return total, {k: v / total for k, v in e.items()}


def test_a_tiny_cell_does_not_shrink_the_sample(documents):
    got = M.mix(documents(*skewed())).collect()
    total, _ = marginals(got)
    assert total / sum(r["n_tokens"] for r in got) == pytest.approx(0.5, rel=1e-6)
    assert max(r["probability"] for r in got) == 1.0


def filled(have, size, temperature=0.7):
    goal = {k: v**temperature for k, v in have.items()}
    full = set()
    while True:
        left, free = size - sum(have[k] for k in full), sum(v for k, v in goal.items() if k not in full)
        now = full | {k for k in goal if k not in full and goal[k] / free * left > have[k]}
        if now == full:
            return {k: have[k] if k in full else goal[k] / free * left for k in goal}
        full = now


@pytest.mark.parametrize("few", [50_000, 0])
def test_every_source_has_its_own_target(documents, monkeypatch, few):
    monkeypatch.setattr(M, "FEW_CELLS", few)
    rows = skewed()
    got = M.mix(documents(*rows), rounds=8 if few else 2).collect()
    have = defaultdict(float)
    for r in rows:
        have[r[3]] += len(r[1].split())
    total, share = marginals(got)
    assert total == pytest.approx(sum(have.values()) / 2, rel=1e-5)
    for k, v in filled(have, sum(have.values()) / 2).items():
        assert share[k] * total == pytest.approx(v, rel=1e-3)


def test_names_that_clash_by_case(documents):
    d = documents(*[(i, "a word " * (1 + i % 5)) for i in range(40)]).withColumns({"SAMPLED": F.lit("s"), "Probability": F.lit("p"), "N_Tokens": F.col("doc_id"), "topic_": F.lit("t")})
    rows = M.sample(d).collect()
    assert rows[0].asDict().keys() == set(d.columns)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in M.sample(d.select("doc_id", "text", "lang", "source", "n_chars")).collect()}
    assert all((r["SAMPLED"], r["Probability"], r["topic_"], r["N_Tokens"]) == ("s", "p", "t", r["doc_id"]) for r in rows)
