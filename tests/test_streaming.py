"""Changes as a stream that starts again where it ended, bursts that fire once, and lookups that are asked again once."""

import os
import time

import pytest

from loomwright.streaming import changes


def put(root, **files):
    for path, code in files.items():
        full = os.path.join(root, path.replace("__", "/") + ".ts")
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(f"{full}.part", "w") as f:
            f.write(code)
        os.replace(f"{full}.part", full)  # a listing sees the whole file or the one before


def until(condition, seconds=60):
    end = time.time() + seconds
    while not condition() and time.time() < end:
        time.sleep(0.2)
    assert condition()


@pytest.fixture
def followed(spark, tmp_path):
    """Runs the stream from its checkpoint while a block runs, and gives what it has told in all runs."""
    told = []

    class Run:
        def __enter__(self):
            stream = changes.tree_changes(spark, [str(tmp_path / "tree")], str(tmp_path / "state"))
            keep = lambda df, _: told.extend((os.path.relpath(r["path"], tmp_path / "tree"), r["op"]) for r in df.collect())
            self.query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="300 milliseconds").start()
            return told

        def __exit__(self, *_):
            self.query.stop()

    return Run, tmp_path / "tree"


def test_changes_are_told_once_over_restarts(followed):
    run, tree = followed
    put(tree, a__one="1", a__two="2", b__three="3", top="4")
    with run() as told:
        time.sleep(1)
        put(tree, a__one="11", c__new="5")
        until(lambda: len(told) == 2)
    put(tree, b__while__down="6")
    os.remove(tree / "a/two.ts")
    with run() as told:
        until(lambda: len(told) == 4)
        os.remove(tree / "c/new.ts")
        os.rmdir(tree / "c")
        until(lambda: len(told) == 5)
        time.sleep(1)
    assert sorted(told) == [("a/one.ts", "changed"), ("a/two.ts", "deleted"), ("b/while/down.ts", "created"), ("c/new.ts", "created"), ("c/new.ts", "deleted")]


def test_a_batch_that_runs_again_tells_the_same(tmp_path):
    put(tmp_path / "tree", a__one="1")
    options = {"paths": str(tmp_path / "tree"), "state": str(tmp_path / "state")}
    first = changes._Baseline(options)
    for p in first.partitions():
        list(first.read(p))
    put(tmp_path / "tree", a__two="2")
    reader = changes._Changes(options)
    told = lambda start, end: sorted((os.path.basename(r[0]), r[3]) for p in reader.partitions({"time": start}, {"time": end}) for r in reader.read(p))
    assert told(0, 10) == [("two.ts", "created")]
    put(tmp_path / "tree", a__three="3")
    assert told(0, 10) == [("two.ts", "created")] and told(10, 20) == [("three.ts", "created")]
    reader.commit({"time": 20})
    assert told(20, 30) == [] and all(len(reader.snapshots.times(h.path)) == 1 for h in os.scandir(tmp_path / "state"))


def test_a_burst_fires_once_after_its_end(spark, tmp_path):
    (tmp_path / "in").mkdir()
    fired = []
    rows = spark.readStream.schema("key string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = changes.settled(rows, 4000).writeStream.outputMode("append").foreachBatch(lambda df, _: fired.extend((r["key"], r["events"], time.time()) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for i in range(3):
            (tmp_path / f"in/{i}.json").write_text('{"key": "tree"}\n' * (i + 1))
            time.sleep(0.5)
        until(lambda: len(fired) == 1, 90)
        time.sleep(1)
        assert [f[:2] for f in fired] == [("tree", 6)]
        (tmp_path / "in/9.json").write_text('{"key": "tree"}\n')
        until(lambda: len(fired) == 2, 90)
        assert fired[1][1] == 1
    finally:
        query.stop()


def test_a_name_that_was_registered_long_before(spark, tmp_path):
    row = lambda n, t: f'{{"name": "{n}", "ts": "2026-01-01T{t}.000Z"}}\n'
    for d in "mr":
        (tmp_path / d).mkdir()
    (tmp_path / "r/1.json").write_text(row("old", "00:00:01"))
    (tmp_path / "m/1.json").write_text(row("first", "00:00:01"))
    (tmp_path / "r/2.json").write_text(row("late", "09:00:02") + row("too_late", "09:00:09"))
    (tmp_path / "m/2.json").write_text(row("old", "09:00:00") + row("late", "09:00:01") + row("never", "09:00:01") + row("never", "09:00:02") + row("too_late", "09:00:01"))
    for d in "mr":
        (tmp_path / d / "3.json").write_text(row("end", "10:00:00"))
        for i in (1, 2, 3):
            os.utime(tmp_path / d / f"{i}.json", (i, i))
    read = lambda p: spark.readStream.schema("name string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / p))
    query = changes.unanswered(read("m"), read("r")).writeStream.outputMode("append").format("memory").queryName("unanswered").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r["name"] for r in spark.table("unanswered").collect()) == ["first", "never", "too_late"]
