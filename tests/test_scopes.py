"""Intervals of brackets and what they enclose, against a plain scan; composed calls by hand."""

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwright.operators import scopes, summaries

PIECES = st.sampled_from(["(", ")", "[", "]", "{", "}", "'(['", '"}"', "`)${x}`", "// {\n", "/* ( */", " a ", " ", "\n"])


def plain(pieces):
    opened, found, at = [], set(), 0
    for p in pieces:
        if p in "([{":
            opened.append(at)
        elif p in ")]}" and opened:
            found.add((opened.pop(), at, len(opened) + 1))
        at += len(p)
    return found | {(start, scopes.END, k) for k, start in enumerate(opened, 1)}


@settings(max_examples=4, deadline=None, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(PIECES, max_size=30), min_size=30, max_size=30))
def test_intervals_like_a_plain_scan(spark, texts):
    texts = [[p for i, p in enumerate(t) if p not in ")]}" or sum(x in "([{" for x in t[:i]) > sum(x in ")]}" for x in t[:i])] for t in texts]
    texts = [t for t in texts if _balanced(t)]
    rows = spark.createDataFrame([*((i, "".join(t)) for i, t in enumerate(texts)), (-1, None)], "i int, text string")
    got = {}
    for r in scopes.intervals(rows, "i").collect():
        got.setdefault(r["i"], set()).add((r["start"], r["end"], r["depth"]))
    for i, t in enumerate(texts):
        assert got.get(i, set()) == plain(t), t
    assert -1 not in got


def _balanced(t):
    """No piece closes more than was opened before it."""
    depth = 0
    for p in t:
        depth += (p in "([{") - (p in ")]}")
        if depth < 0:
            return False
    return True


def test_innermost_and_its_ties(spark):
    spans = spark.createDataFrame([("a", 0, 50, "outer"), ("a", 10, 20, "inner"), ("a", 10, 20, "also"), ("b", 0, 5, "other")], "k string, start int, end int, what string")
    points = spark.createDataFrame([("a", 15), ("a", 15), ("a", 30), ("a", 60), ("b", 15), (None, 3)], "k string, at int")
    got = sorted((r["k"], r["at"], r["what"]) for r in scopes.innermost(points, spans, ["k"], first="what").collect())
    assert got == [("a", 15, "also"), ("a", 15, "also"), ("a", 30, "outer")]


def test_compose_ends_in_circles_and_bounds_products(spark):
    atom = "struct<kind:string,value:string,steps:string>"
    none, hole = [("undef", None, "")], "\x02{}\x1f\x03".format
    rows = spark.createDataFrame([("w", "o", [("name", "part", f"{hole('a')}_{hole('b')}", "")]), ("lone", "p", [("name", "prop", "x", "")])], f"owner string, origin string, atoms {summaries.ATOMS}")
    calls = spark.createDataFrame([("self", "w", "w"), ("top", None, "w"), ("many", None, "w"), ("swap", "v", "w"), ("out", None, "v")], "call string, owner string, target string")
    said = lambda *v: [("str", x, "") for x in v]
    answers = [
        ("self", "a", "", [("prop", "b", "")]), ("self", "b", "", [("prop", "a", "")]),
        ("top", "a", "", said("x", "y")), ("top", "b", "", said("z")),
        ("many", "a", "", said(*(f"m{i}" for i in range(20)))), ("many", "b", "", said(*(f"n{i}" for i in range(20)))),
        ("swap", "a", "", [("prop", "b", "")]), ("swap", "b", "", said("k")), ("out", "b", "", said("l")),
    ]
    answers = spark.createDataFrame(answers, f"call string, prop string, steps string, said array<{atom}>")
    out = summaries.compose(rows, calls, answers).where("owner IS NULL").select("origin", F.explode("atoms").alias("a")).select("a.kind", "a.value").collect()
    assert none and {r["value"] for r in out if r["kind"] == "str"} == {"x_z", "y_z", "z_x", "z_y", "l_k", "k_l"}
    assert {r["kind"] for r in out} == {"str", "unknown"} and "too many" in {r["value"] for r in out if r["kind"] == "unknown"}.pop()
