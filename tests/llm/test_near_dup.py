import random

import numpy as np
import pytest

from loomwright.llm import near_dup as N


def brute(rows, percent=75):
    sets = {i: N.shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


@pytest.fixture(scope="module")
def rows():
    """Bases, copies with few and with many changes, a passage that many share, equal sets, short texts."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    out, i = [], 0
    passage = " ".join(word() for _ in range(60))
    for _ in range(6):
        base = [word() for _ in range(120)]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 6, 9])):
                w[rng.randrange(len(w))] = word()
            out.append((i := i + 1, " ".join(w)))
    for _ in range(40):
        out.append((i := i + 1, " ".join(word() for _ in range(90)) + " " + passage))
    out += [(i + 1, "one two"), (i + 2, "One\tTWO "), (i + 3, "two one"), (i + 4, ""), (i + 5, None), (i + 6, " \n"), (i + 7, "a b c d e f " * 3000), (i + 8, "a b c d e f " * 2000)]
    return out


def test_like_brute_force(documents, clashing, rows):
    got = N.near_groups(clashing(documents(*rows)))
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id", "kept").collect())) == brute(rows)


def test_edges(documents):
    assert N.near_groups(documents((1, "a")).limit(0)).count() == 0
    got = sorted(map(tuple, N.near_groups(documents((None, "a b"), (4, "a b"), (4, "a b"), (9, "a  b"), (5, "c"))).collect()), key=str)
    assert got == sorted([(None, 1, None, True), (4, 1, 4, True), (4, 1, 4, True), (9, 1, 4, False), (5, 1, 5, True)], key=str)


def test_recall_of_links_at_the_border(documents):
    """2,600 pairs of similarity 0.75 to 0.77, each of an own vocabulary: how many of their links are found."""
    rng = random.Random(11)
    rows, linked = [], set()
    for k in range(2600):
        base = [f"{rng.randrange(1 << 20)}w{k}" for _ in range(rng.choice([60, 100, 300]))]
        changed = next(c for c in range(len(base) - 4, 0, -1) if 100 * (len(base) - 4 - c) >= 75 * (len(base) - 4 + c)) - 4  # words, each run of them also changes 4 shingles
        at = rng.randrange(4, len(base) - changed - 4)
        other = base[:at] + [f"{rng.randrange(1 << 20)}x{k}" for _ in range(changed)] + base[at + changed :]
        texts = " ".join(base), " ".join(other)
        a, b = map(N.shingles, texts)
        assert 0.75 <= len(a & b) / len(a | b) < 0.77
        rows += [(2 * k, texts[0]), (2 * k + 1, texts[1])]
        linked.add(2 * k + 1)
    got = {r["doc_id"]: r["component_id"] for r in N.near_groups(documents(*rows)).collect()}
    assert all(c in (i, i - 1) for i, c in got.items()) and all(got[i] == i for i in got if i % 2 == 0)
    found = sum(got[i] == i - 1 for i in linked)
    assert found >= 0.998 * len(linked), found


def test_texts_under_one_id_and_shared_shingles(documents):
    """All shingles of the second text of id 7 are shared, none of its first: the link is found all the same, and links of any text are links of the id."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    lone = " ".join(word() for _ in range(40))
    base = [word() for _ in range(60)]
    near = " ".join(base[:30] + [word()] + base[31:])
    rest = [(20 + i, " ".join(base[:i] + [word() for _ in range(30)] + base[i + 30 :])) for i in range(0, 30, 3)]
    rows = [(7, lone), (7, " ".join(base)), (9, near), (3, lone + " z"), *rest]
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in N.near_groups(documents(*rows)).collect()}
    assert got[7, 36] == got[7, 56] == got[9, 56] == got[3, 37] == 3


def test_bitmaps_bound_what_sets_share():
    rng = np.random.default_rng(2)
    for size in (5, 300, 5000):
        pool = rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64) * np.uint64(2)
        for _ in range(20):
            a, b = (np.unique(rng.choice(pool, size)) for _ in range(2))
            x, y = N.bitmap(a).view(np.uint64), N.bitmap(b).view(np.uint64)
            fallen = min(len(a) - int(np.bitwise_count(x).sum()), len(b) - int(np.bitwise_count(y).sum()))
            assert len(np.intersect1d(a, b)) <= int(np.bitwise_count(x & y).sum()) + fallen


def test_dropping_keeps_one_of_each_component(documents, clashing, rows):
    d = clashing(documents(*rows))
    out = N.drop_near_copies(d)
    assert out.columns == d.columns and sorted(r["doc_id"] for r in out.collect()) == [r[0] for r in brute(rows) if r[3]]


def test_pairs_within_the_distance_always_share_a_key():
    """Pigeonhole: fewer than CHUNKS * (ERRORS + 1) differing symbols leave a chunk with at most ERRORS of them."""
    rng = random.Random(1)
    for _ in range(2000):
        wrong = rng.sample(range(N.SYMBOLS), N.CHUNKS * (N.ERRORS + 1) - 1)
        assert any(sum(w // N.CHUNK == c for w in wrong) <= N.ERRORS for c in range(N.CHUNKS))


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(10, 40)] + [(100, i) for i in range(101, 180)] + [(7, 5), (5, 7)]
    got = {r["id"]: r["component"] for r in N.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 10 for i in range(10, 41)}, **{i: 100 for i in range(100, 180)}, 5: 5, 7: 5}


def _one_template(count, seed=4):
    """Documents of one template of 60 phrases, of which each has 40 and, between them, words of its own or of a few others: about half alike, nearly every shingle in several."""
    rng = random.Random(seed)
    phrases = [" ".join(f"{chr(97 + i % 26)}{i}{j}" for j in range(9)) for i in range(60)]
    names = [" ".join(f"n{k}x{j}" for j in range(10)) for k in range(count)]
    out = []
    for i in range(count):
        own = [names[rng.randrange(max(0, i - 3), min(count, i + 4))] for _ in range(14)]
        out.append((i + 1, " ".join(x for k, p in enumerate(phrases[:40]) for x in ([p, own[k % 14]] if k % 2 else [p]))))
    return out


def test_documents_of_one_template_meet_in_few_pairs(spark, documents, monkeypatch):
    """Four times the rows of one template make about four times the pairs, and a low HOT changes no link."""
    pairs = {}
    whole = N.open_buckets

    def counted(rows, hashed, percent):
        out = whole(rows, hashed, percent)
        got = out.groupBy("bucket").agg({"id": "count"}).withColumnRenamed("count(id)", "k").selectExpr("sum(k * (k - 1) / 2)").first()[0]
        pairs[len(pairs)] = got or 0
        return out

    monkeypatch.setattr(N, "open_buckets", counted)
    for count in (300, 1200):
        rows = _one_template(count)
        got = {r["doc_id"]: r["component_id"] for r in N.near_groups(documents(*rows)).collect()}
        if count == 300:
            assert got == {i: c for i, _, c, _ in brute(rows)}
    assert 0 < pairs[1] <= 5 * pairs[0], pairs


def test_rare_shingles_find_every_link(documents, monkeypatch, rows):
    monkeypatch.setattr(N, "HOT", 1)
    got = N.near_groups(documents(*rows))
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id", "kept").collect())) == brute(rows)
