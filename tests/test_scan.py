import os
import sys
import time

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import corpus

from loomwright.functions import text as T
from loomwright.operators import scan
from loomwright.plans.project import Config, project
from loomwright.sources.file_tree import from_store, read_tree
from loomwright.streaming import watch

NAMES = "info home settings search close apps check delete star bolt".split()


@pytest.fixture
def names(spark):
    return spark.createDataFrame([(n,) for n in NAMES], "name string")


def put(root, **files):
    for path, code in files.items():
        full = os.path.join(root, path.replace("__", "/").replace("_ts", ".ts").replace("_js", ".js"))
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.write(code if isinstance(code, bytes) else code.encode())


def one(spark, expr, **columns):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} string" for c in columns))
    return df.select(expr(*[F.col(c) for c in columns])).first()[0]


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("const a = on ? 'home' : \"star\";", ["home", "star"]),
        ("<Glyph name='info' /> // 'close'", ["info"]),
        ("import x from 'apps';\nexport { y } from 'check';\nexport * from './bolt';\nconst z = 'home'", ["home"]),
        ("type A = 'close' | 'search';\nconst a = `star`;", ["star"]),
        ("export type A =\n  | 'close'\n  | 'search';\nexport const a = 'info';", ["info"]),
        ("interface P { icon: 'close' | 'search' }\nconst a = { icon: 'info' };", ["info"]),
        ("function f(p: 'close' | 'search') { return 'info'; }", ["info"]),
        ("'use strict';\nconst k = `${a ? 'add' : 'remove'}`;", ["add", "remove"]),
        ("const url = 'http://x.y/z'; const b = 'home';", ["home"]),
        ("/* 'close'\n'apps' */ const b = 'home' as 'home' | 'star';", ["home"]),
        ("'Home' 'a b' \"a-b\" 'x\" 'home\"", []),
        ("enum E { A = 'bolt' }", ["bolt"]),
    ],
)
def test_value_literals(spark, code, want):
    assert one(spark, T.value_literals, code=code, path="a.tsx") == want


def test_declaration_files_have_no_values_and_null_code_none(spark):
    assert one(spark, T.value_literals, code="const a = 'home'", path="x.d.ts") == []
    assert one(spark, T.literals, code=None) == []


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [
        ("**/gen", ["gen", "a/gen", "a/gen/x.ts"], ["a/general.ts", "regen/x"]),
        ("*.test.*", ["a.test.ts"], ["b/a.test.ts", "atest.ts"]),
        ("./src/**", ["src/a", "src/b/c"], ["srcs/a", "src"]),
        ("a?[b].ts", ["a?[b].ts"], ["axb.ts", "ab.ts"]),
        ("**/*.stories.*", ["x.stories.tsx", "a/b/x.stories.js"], ["x.story.tsx"]),
    ],
)
def test_globs(spark, glob, yes, no):
    df = spark.createDataFrame([(p,) for p in yes + no], "p string")
    assert [r[0] for r in df.where(T.excluded(F.col("p"), [glob])).collect()] == yes


def test_paths(spark):
    paths = ["a.ts", "a.mjs", "b/c.cts", "a.tsx\n", "a.txt", "node_modules/x.ts", "b/.git/x.ts", "b/.x.ts", "lib/x.js"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.where(T.is_source(F.col("p")) & ~T.in_ignored_directory(F.col("p"))).collect()] == ["a.ts", "a.mjs", "b/c.cts", "b/.x.ts", "lib/x.js"]


def test_top_files_order(spark):
    df = spark.createDataFrame([("c", ["x", "y"]), ("B", ["x"]), ("a", ["x"]), ("d", ["x"])], "path string, names array<string>")
    assert [tuple(r) for r in scan.top_files(df, 3).collect()] == [("c", 2), ("a", 1), ("B", 1)]


def test_fingerprint_of_nothing_and_of_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "name string")
    assert scan.fingerprint(df).first()[0].startswith("2:") and scan.fingerprint(df.limit(0)).first()[0] == "0:da39a3ee5e6b4b0d3255bfef95601890afd80709"


def test_tree(spark, tmp_path):
    put(tmp_path, app__a_ts="1", app__sub__b_js="2", app__gen__c_ts="3", **{"app__.d_ts": "4", "app__.git__e_ts": "5", "app__node_modules__f_ts": "6", "app__g.txt": "7", "app__h_ts": b"\xff'home'"})
    os.symlink(tmp_path / "app/a.ts", tmp_path / "app/link.ts")
    os.symlink(tmp_path / "app", tmp_path / "app/loop")
    rows = {r["rel_path"]: r for r in read_tree(spark, [str(tmp_path / "app"), str(tmp_path / "app/sub")], exclude=["**/gen"]).collect()}
    assert sorted(r if r != "b.js" else "sub/b.js" for r in rows) == [".d.ts", "a.ts", "h.ts", "sub/b.js"]
    assert rows["h.ts"]["code"] == "�'home'" and rows["a.ts"]["size"] == 1 and rows["a.ts"]["status"] == "read"
    assert [r["rel_path"] for r in read_tree(spark, [str(tmp_path / "app/a.ts")]).collect()] == ["a.ts"]
    with pytest.raises(Exception, match="source not found"):
        read_tree(spark, [str(tmp_path / "nowhere")]).count()
    assert sorted(r["rel_path"] for r in from_store(spark, f"file://{tmp_path}/app/sub").collect()) == ["b.js"]


def test_cold_warm_and_changed(spark, tmp_path, names):
    put(tmp_path, app__a_ts="const a = 'home';", app__b_ts="glyph-kit 'star' type T = 'x';", app__c_ts="none")
    tree = lambda: read_tree(spark, [str(tmp_path / "app")])
    config = Config(cache_path=f"file://{tmp_path}/cache", markers=["glyph-kit", "zzz"])
    first = project(spark, tree(), names, config)
    assert (first.files, first.from_cache, first.engine, first.fallback_reason) == (3, 0, "values", None)
    assert sorted(r[0] for r in first.names.collect()) == ["home", "star"]
    assert [r["marks"] for r in first.marks.collect()] == [["glyph-kit"]]
    os.utime(tmp_path / "app/a.ts", (1, 1))
    put(tmp_path, app__a_ts="const a = 'close';")
    os.remove(tmp_path / "app/c.ts")
    second = project(spark, tree(), names, config)
    assert (second.files, second.from_cache) == (2, 1) and sorted(r[0] for r in second.names.collect()) == ["close", "star"]
    assert {"list", "match", "read", "aggregate"} == set(second.seconds)
    versions = sorted(os.listdir(tmp_path / "cache"))
    again = project(spark, tree(), names, config)
    assert (again.files, again.from_cache) == (2, 2) and set(again.seconds) == {"list", "match"} and sorted(r[0] for r in again.names.collect()) == ["close", "star"]
    assert sorted(os.listdir(tmp_path / "cache")) == versions  # nothing changed, nothing was written
    third = project(spark, tree(), names.limit(3), config)  # another dictionary: nothing of the cache holds
    assert third.from_cache == 0


def test_a_poisoned_cache_shows_that_it_is_read(spark, tmp_path, names):
    from loomwright.sources import tables

    put(tmp_path, app__a_ts="const a = 'home';")
    config = Config(cache_path=f"file://{tmp_path}/cache")
    files = read_tree(spark, [str(tmp_path / "app")])
    project(spark, files, names, config)
    key = tables.read_cache  # the entries as they are, with another name
    entry = spark.read.parquet(f"{config.cache_path}/{tables._versions(spark, config.cache_path)[-1]}")
    tables.write_cache(entry.withColumn("names", F.array(F.lit("bolt"))), config.cache_path)
    assert key and [r[0] for r in project(spark, files, names, config).names.collect()] == ["bolt"]


def test_versions_of_a_table(spark, tmp_path):
    from loomwright.sources import tables

    path = f"file://{tmp_path}/t"
    assert tables.read_table(spark, path, "id bigint").count() == 0
    for n in (1, 2, 3, 4):
        tables.write_table(spark.range(n), path)
        assert tables.read_table(spark, path, "id bigint").count() == n
    assert sum(x.startswith("v-") for x in os.listdir(tmp_path / "t")) == 2


def test_icon_data_and_names_go_out_and_come_back(spark, tmp_path):
    from loomwright.sources import tables

    icons = spark.createDataFrame([("sharp", "b", "M1 1z", None), ("rounded", "c", "M2 2z", "M3 3z"), ("rounded", "a", "M4 4z", None)], tables.ICONS)
    tables.write_icons(icons, f"file://{tmp_path}/icons")
    lines = [x for f in sorted((tmp_path / "icons").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines[0] == '{"variant":"rounded","name":"a","d":"M4 4z"}' and len(lines) == 3
    assert sorted(map(str, tables.icon_data(spark, f"file://{tmp_path}/icons").collect())) == sorted(map(str, icons.collect()))
    one = lambda *names: spark.createDataFrame([(n,) for n in names], "name string")
    aliases = spark.createDataFrame([("z", "a")], "alias string, target string")
    known = tables.dictionary(one("b", "a"), aliases, one("old", "a"))
    assert tables.names_module(known, aliases) == 'export const symbols = ["a","b"];\nexport const legacy = ["old"];\nexport const aliases = {"z":"a"};\n'
    assert {r["what"]: r["n"] for r in tables.summary(icons, known).collect()} == {"rounded": 2, "sharp": 1, "symbol": 2, "alias": 1, "legacy": 1}
    with pytest.raises(ValueError):
        tables.names_module(known, aliases, most=2)


def test_unknown_extractor_is_refused():
    with pytest.raises(ValueError):
        Config(extractor="none")


def test_synthetic_corpus(spark, tmp_path, names):
    used = corpus.write(str(tmp_path / "c"), 240, NAMES)
    result = project(spark, read_tree(spark, [str(tmp_path / "c")]), names)
    got = {r["path"]: set(r["names"]) for r in result.by_file.collect()}
    assert got == {p: u for p, u in used.items() if u} and result.files == 240


def test_watch(spark, tmp_path):
    put(tmp_path, app__a_ts="1", app__b_ts="2")
    seen, failed = [], []

    def changed(df):
        seen.append(sorted((os.path.basename(r["path"]), r["op"]) for r in df.collect()))
        if not failed:
            failed.append(1)
            raise RuntimeError("once")

    w = watch.Watch(spark, [str(tmp_path / "app")], changed, interval="500 milliseconds")
    try:
        put(tmp_path, app__c_ts="3", app__a_ts="11", app__x__node_modules__n_ts="no")
        os.remove(tmp_path / "app/b.ts")
        until(lambda: sum(map(len, seen)) >= 3)
        put(tmp_path, app__d_ts="4")
        until(lambda: sum(map(len, seen)) >= 4)
    finally:
        watch.stop_all()
    assert sorted(x for s in seen for x in s) == [("a.ts", "changed"), ("b.ts", "deleted"), ("c.ts", "created"), ("d.ts", "created")]


def until(condition, seconds=60):
    end = time.time() + seconds
    while not condition() and time.time() < end:
        time.sleep(0.2)


def test_late_registration_answers_a_missing_name(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "r").mkdir()
    schema = "name string, ts timestamp"
    row = lambda n, s: f'{{"name": "{n}", "ts": "2026-01-01T00:00:{s:02d}.000Z"}}\n'
    (tmp_path / "m/1.json").write_text(row("late", 1) + row("never", 1) + row("never", 2))
    (tmp_path / "r/1.json").write_text(row("late", 2))
    read = lambda p: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / p))
    (tmp_path / "m/2.json").write_text(row("end", 50))
    (tmp_path / "r/2.json").write_text(row("end", 50))
    os.utime(tmp_path / "m/1.json", (1, 1))
    os.utime(tmp_path / "r/1.json", (1, 1))
    out = watch.recheck(read("m"), read("r")).writeStream.format("memory").queryName("rechecked").option("checkpointLocation", str(tmp_path / "cp")).start()
    out.processAllAvailable()
    out.stop()
    assert [r["name"] for r in spark.table("rechecked").collect()] == ["never"]
