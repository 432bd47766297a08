import os
import random

import pytest
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators import graph, registry, verify
from loomwright.sources import tables

ICONS = [("rounded", "home", "M0", "M1"), ("rounded", "info", "M2", None), ("outlined", "home", "M2", "M3"), ("rounded", "schedule", "M4", None)]


@pytest.fixture
def icons(spark):
    return spark.createDataFrame(ICONS, tables.ICONS)


@pytest.fixture
def uses(spark):
    rows = [("rounded", "home", "d"), ("rounded", "home", "f"), ("rounded", "home", "f"), ("rounded", "info", "d"), ("rounded", "info", "f"), ("outlined", "home", "d"), ("outlined", "none", "d")]
    return spark.createDataFrame(rows, "variant string, name string, shape string")


def test_selected_and_stats(uses, icons):
    chosen = registry.selected(uses, icons)
    assert sorted(map(tuple, chosen.collect())) == [("outlined", "home", "d", "M2"), ("rounded", "home", "d", "M0"), ("rounded", "home", "f", "M1"), ("rounded", "info", "d", "M2"), ("rounded", "info", "f", "M2")]
    assert registry.stats(chosen).first().asDict() == {"icons": 3, "d_shapes": 3, "f_shapes": 2, "shared": 1, "path_chars": 6}
    assert registry.stats(chosen.limit(0)).first()["icons"] == 0
    assert registry.over_limit(chosen, 1).collect()[0].asDict() == {"variant": "rounded", "icons": 2}
    assert "3 icons (outlined 1, rounded 2)" in registry.report(chosen, 0, 9, "values")


def test_text_does_not_depend_on_the_order_of_rows(spark, uses, icons, tmp_path):
    aliases = spark.createDataFrame([("clock", "schedule")], "alias string, target string")
    chosen = registry.selected(uses, icons)
    text = registry.render(chosen, aliases)
    assert text == registry.render(chosen.orderBy(F.desc("name"), F.desc("shape")), aliases)
    assert text.splitlines()[1:4] == ['var p0="M2";', 'var p1="M0";', 'var p2="M1";']
    assert '"info":{d:p0,f:p0},' in text and 'aliases:{"clock":"schedule"}' in text
    path = str(tmp_path / "out/registry.js")
    assert registry.write_if_changed(path, text) and not registry.write_if_changed(path, text) and registry.write_if_changed(path, text + "\n")


def test_lookup(spark, icons):
    aliases = spark.createDataFrame([("clock", "schedule")], "alias string, target string")
    asked = spark.createDataFrame([("rounded", "clock", False), ("rounded", "info", True), ("sharp", "home", False), ("rounded", "toString", False)], "variant string, name string, filled boolean")
    got = {(r["variant"], r["name"]): (r["path"], r["message"]) for r in registry.lookup(asked, icons, aliases).collect()}
    assert got["rounded", "clock"] == ("M4", None) and got["rounded", "info"] == ("M2", None)
    assert "no variant 'sharp'" in got["sharp", "home"][1] and "not found in the sources" in got["rounded", "toString"][1]


def test_twins(spark):
    cols = "variant string, name string, d string, f string"
    symbols = spark.createDataFrame([(v, n, d + v, None) for v in ("a", "b") for n, d in (("alpha", "1"), ("beta", "1"), ("gamma", "2"), ("delta", "3"))], cols)
    legacy = spark.createDataFrame([(v, n, d + v, None) for v in ("a", "b") for n, d in (("old", "1"), ("gamma", "1"), ("own", "9"))] + [("a", "half", "2a", None), ("b", "half", "3b", None), ("a", "once", "1a", None)], cols)
    assert [tuple(r) for r in registry.twins(legacy, symbols, 2).collect()] == [("old", "alpha")]
    assert {r["name"] for r in registry.standalone(legacy, symbols, 2).collect()} == {"own", "half", "once"}


def test_numbered_without_one_task(spark):
    values = random.Random(1).sample(range(100_000), 2000)
    df = spark.createDataFrame([(v,) for v in values], "v bigint").repartition(7)
    assert {r["v"]: r["n"] for r in registry.numbered(df, ["v"], "n").collect()} == {v: i for i, v in enumerate(sorted(values))}


def test_dictionary_metadata_and_axes(spark):
    one = lambda c, *v: spark.createDataFrame([(x,) for x in v], f"{c} string")
    d = tables.dictionary(one("name", "home", "info"), spark.createDataFrame([("clock", "home"), ("info", "home")], "alias string, target string"), one("name", "old"))
    assert {tuple(r) for r in d.collect()} == {("home", "symbol"), ("info", "symbol"), ("clock", "alias"), ("old", "legacy")}
    text = ')]}\'\n{"icons": [{"name": "home", "version": 3, "unsupported_families": ["Other"]}, {"name": "old", "version": 1, "unsupported_families": ["Signs Outlined"]}]}'
    assert {tuple(r) for r in tables.metadata(spark, text, "Signs").collect()} == {("home", 3, "symbol"), ("old", 1, "legacy")}
    fetched = spark.createDataFrame([("r", "a", "default", "M0"), ("r", "a", "fill", "M0"), ("r", "b", "default", "M0"), ("r", "c", "default", "M1"), ("r", "c", "fill", "M2")], "variant string, name string, axis string, path string")
    assert {tuple(r) for r in tables.join_axes(fetched).collect()} == {("r", "a", "M0", None), ("r", "c", "M1", "M2")}
    assert [tuple(r) for r in tables.missing_axes(fetched).collect()] == [("r", "b", "fill")]


def test_order_by_utf16_units_and_bounded_modules(spark):
    names = spark.createDataFrame([("symbol", n) for n in ("z", "\uff5e", "\U0001f600", "a")], "kind string, name string")
    aliases = spark.createDataFrame([("\uff5e", "a"), ("\U0001f600", "z")], "alias string, target string")
    text = tables.names_module(names, aliases)
    assert text.index("\\ud83d") < text.index("\\uff5e") and text.rindex("\\ud83d") < text.rindex("\\uff5e")
    with pytest.raises(ValueError):
        tables.names_module(names.limit(1), aliases, most=1)


def test_checks(spark):
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "name string")
    assert [r[0] for r in verify.missing(one("a", "b"), one("b", "c")).collect()] == ["a"]
    assert [r[0] for r in verify.unexpected(one("a", "b"), one("b", "c")).collect()] == ["c"]
    paths = spark.createDataFrame([("M0", "a"), ("M0", "b"), ("M1", "c"), ("M2", "a")], "path string, name string")
    present = spark.createDataFrame([("M0",), ("M1",)], "path string")
    assert {tuple(r) for r in verify.owners(present, paths, one("b")).collect()} == {("M0", "b"), ("M1", "c")}
    assert verify.leaked(one("a", "b"), one("b", "c"), limit=0).first().asDict() == {"names": 1, "leaked": True}
    df = spark.createDataFrame([([0.0, 3.0], [1.0, -1.0], b"ab", "x = 'a\\'b' + \"c\"")], "a array<double>, b array<double>, c binary, s string")
    r = df.select(verify.max_shift(df.a, df.b), verify.diff_percent(df.a, df.b), verify.is_text(df.c), verify.quoted_strings(df.s), T.round_half_up(F.lit(-2.5))).first()
    assert tuple(r) == (4.0, 100.0, True, ["a\\'b", "c"], -2.0)


def test_imports(spark):
    files = spark.createDataFrame([(p,) for p in ("app/a.ts", "app/ui/index.ts", "app/ui/b.tsx", "lib/shared/icons.ts", "other/shared/icons/index.ts")], "path string")
    rows = [("app/a.ts", "./ui"), ("app/a.ts", "./ui/b"), ("app/ui/b.tsx", "../a"), ("app/a.ts", "@/shared/icons"), ("app/a.ts", "@scope/shared/icons"), ("app/a.ts", "./none"), ("app/a.ts", "react")]
    got = {(r["source"], r["resolved"]) for r in graph.resolve_imports(spark.createDataFrame(rows, "path string, source string"), files).collect()}
    both = {"lib/shared/icons.ts", "other/shared/icons/index.ts"}
    assert got == {("./ui", "app/ui/index.ts"), ("./ui/b", "app/ui/b.tsx"), ("../a", "app/a.ts"), *(("@/shared/icons", x) for x in both), *(("@scope/shared/icons", x) for x in both)}


def test_reach_has_set_semantics_and_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 1)], "src bigint, dst bigint")
    assert sorted(r[0] for r in graph.reach(edges, spark.createDataFrame([(1,)], "node bigint")).collect()) == [1, 2, 3, 4]


def test_contained_like_brute_force(spark):
    rng = random.Random(8)
    words = [rng.choice(["ab", "abc", "b", "cab"]) for _ in range(4000)]
    texts = [(i, " ".join(words[i * 40 : i * 40 + 60])) for i in range(60)]
    parts = [(i, t[k : k + n]) for i, (t, k, n) in enumerate((rng.choice(texts)[1], rng.randrange(60), rng.choice([2, 9, 20, 45])) for _ in range(40))]
    got = graph.contained(spark.createDataFrame(texts, "text_id bigint, text string"), spark.createDataFrame(parts, "part_id bigint, part string"))
    assert {tuple(r) for r in got.collect()} == {(a, b) for a, t in texts for b, p in parts if p in t}


def test_tables_between_steps_can_be_dropped(spark):
    from loomwright.operators import graph

    kept = graph.written(spark.range(5), "five")
    assert kept.count() == 5
    folder = graph.shared_tables(spark).removeprefix("file://")
    assert os.listdir(folder)
    graph.drop_tables(spark)
    assert not os.path.exists(folder)
