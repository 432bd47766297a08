"""Changes of source trees as a stream, with state that outlives the query.

`tree_changes` is a streaming Python data source. An offset is a point in time; what a shard (a first-level directory) looked like then is a snapshot in
the folder `state`, which driver and executors share. A batch lists each shard on an executor, compares it with the snapshot of the batch's start and leaves one for
its end. A batch that is run again finds that snapshot and gives the same rows; a query that starts again from its checkpoint
goes on from the last committed snapshot. So no change is lost or told twice, and what changed while nothing ran is told by the first batch.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.file_tree import Part, TreeReader

SCHEMA = "path string, mtime_ms double, size bigint, op string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Shard(InputPartition):
    def __init__(self, part: Part, start: int, end: int):
        super().__init__(part.relative)
        self.part, self.start, self.end = part, start, end


class Snapshots:
    """Listings of shards by time, one file each: {path: [mtime_ms, size]}."""

    def __init__(self, folder: str):
        self.folder = folder

    def _home(self, part: Part) -> str:
        return os.path.join(self.folder, hashlib.sha256(f"{part.root}\0{part.relative}\0{part.deep}".encode()).hexdigest()[:32])

    def times(self, home: str) -> list[int]:
        return sorted(int(f[:-5]) for f in os.listdir(home) if f.endswith(".json") and f != "shard.json") if os.path.isdir(home) else []

    def shards(self) -> list[Part]:
        """Of all that a snapshot is known of, directories that are gone by now too."""
        found = []
        for name in sorted(os.listdir(self.folder)) if os.path.isdir(self.folder) else ():
            try:
                with open(os.path.join(self.folder, name, "shard.json")) as f:
                    found.append(Part(**json.load(f)))
            except (FileNotFoundError, NotADirectoryError):
                continue
        return found

    def at(self, part: Part, when: int) -> dict:
        """The latest snapshot not after when; empty if there is none."""
        known = [t for t in self.times(self._home(part)) if t <= when]
        return self.exact(part, known[-1]) if known else {}

    def exact(self, part: Part, when: int) -> dict | None:
        try:
            with open(os.path.join(self._home(part), f"{when}.json")) as f:
                return json.load(f)
        except FileNotFoundError:
            return None

    def put(self, part: Part, when: int, listing: dict) -> None:
        home = self._home(part)
        os.makedirs(home, exist_ok=True)
        for name, what in (("shard", {"root": part.root, "relative": part.relative, "deep": part.deep}), (str(when), listing)):
            own = os.path.join(home, f".{name}-{os.getpid()}-{time.monotonic_ns()}")
            with open(own, "w") as f:
                json.dump(what, f)
            os.replace(own, os.path.join(home, f"{name}.json"))  # all of it or nothing

    def forget_before(self, when: int) -> None:
        """Drop snapshots that no batch from when on needs."""
        for name in os.listdir(self.folder) if os.path.isdir(self.folder) else ():
            home = os.path.join(self.folder, name)
            for t in [t for t in self.times(home) if t <= when][:-1]:
                os.remove(os.path.join(home, f"{t}.json"))


class TreeChanges(DataSource):
    """Options: paths and exclude (separated by NUL), and state, a folder that all machines see. Read as a batch, it takes the first snapshots of shards that
    have none, and gives their number of files."""

    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Baseline(self.options)

    def streamReader(self, schema):
        return _Changes(self.options)


class _Shards:
    def __init__(self, options):
        self.tree, self.snapshots = TreeReader(options), Snapshots(options["state"])

    def shards(self) -> list[Part]:
        # Shards are the same however the tree grows: each root's own files, and each first-level directory.
        now = [p for root in self.tree.roots for p in (Part(root, "", False), *(Part(root, inner, True) for inner in self.tree._inner(root, "")))]
        there = {(p.root, p.relative, p.deep) for p in now}
        return now + [p for p in self.snapshots.shards() if (p.root, p.relative, p.deep) not in there and p.root in self.tree.roots]

    def listing(self, part: Part) -> dict:
        try:
            rows = list(self.tree._rows(part))
        except (FileNotFoundError, NotADirectoryError):  # the directory is gone
            rows = []
        return {path: [mtime, size] for _, path, _, mtime, size, status in rows if status == "listed"}


class _Baseline(_Shards, DataSourceReader):
    def partitions(self):
        return [Shard(p, 0, 0) for p in self.shards()]

    def read(self, partition):
        if not self.snapshots.times(self.snapshots._home(partition.part)):
            self.snapshots.put(partition.part, 0, self.listing(partition.part))
        return iter(())


class _Changes(_Shards, DataSourceStreamReader):
    def initialOffset(self):
        return {"time": 0}

    def latestOffset(self):
        return {"time": time.time_ns() // 1_000_000}

    def partitions(self, start, end):
        return [Shard(p, start["time"], end["time"]) for p in self.shards()]

    def read(self, partition):
        part = partition.part
        before, now = self.snapshots.at(part, partition.start), self.snapshots.exact(part, partition.end)
        if now is None:
            now = self.listing(part)
            if now != before:
                self.snapshots.put(part, partition.end, now)
        for path in sorted(before.keys() | now.keys()):
            if before.get(path) != now.get(path):
                mtime, size = now.get(path) or (None, None)
                yield path, mtime, size, "created" if path not in before else "deleted" if path not in now else "changed"

    def commit(self, end):
        self.snapshots.forget_before(end["time"])


def tree_changes(spark: SparkSession, paths: list[str], state: str, *, exclude: list[str] | None = None) -> DataFrame:
    """A stream of (path, mtime_ms, size, op: created, changed or deleted). What is there before the first use of state is no change; later
    streams with the same state and checkpoint go on where the last one ended."""
    spark.dataSource.register(TreeChanges)
    options = {"paths": "\0".join(paths), "exclude": "\0".join(exclude or []), "state": state}
    spark.read.format("tree_changes").options(**options).load().count()
    return spark.readStream.format("tree_changes").options(**options).load()


def _timers(spark: SparkSession) -> None:
    """State with timers is kept by the RocksDB provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class _Quiet(StatefulProcessor):
    """Counts events of a key, and fires once none has come for a while."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.burst = handle, handle.getValueState("burst", "events bigint, due bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        events = sum(1 for _ in rows)
        if self.burst.exists():
            before, due = self.burst.get()
            events += before
            self.handle.deleteTimer(due)
        due = timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms
        self.handle.registerTimer(due)
        self.burst.update((events, due))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        from pyspark.sql import Row

        events, _ = self.burst.get()
        self.burst.clear()
        yield Row(key=key[0], events=events)

    def close(self) -> None:
        pass


def settled(events: DataFrame, quiet_ms: int = 100) -> DataFrame:
    """A stream with a column key, to (key, events): one row for each burst, once no event of the key has come for quiet_ms. Each event puts
    the end of the burst off; nothing of the events is kept but their number."""
    _timers(events.sparkSession)
    return events.select("key").groupBy("key").transformWithState(_Quiet(quiet_ms), "key string, events bigint", "Append", "ProcessingTime")


class _Missing(StatefulProcessor):
    """Remembers when a name was first registered, however long ago, and asks once, some time after it was missed."""

    def __init__(self, delay_ms: int):
        self.delay_ms = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known, self.missed = handle.getValueState("known", "at bigint"), handle.getValueState("missed", "at bigint, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        found = [(r["registered"], r["ms"]) for r in rows]
        first = min((ms for registered, ms in found if registered), default=None)
        if first is not None and not (self.known.exists() and self.known.get()[0] <= first):
            self.known.update((first,))
        asked = min((ms for registered, ms in found if not registered), default=None)
        if asked is not None and not self.missed.exists():
            self.missed.update((asked, False))
            self.handle.registerTimer(asked + self.delay_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        from pyspark.sql import Row

        asked, told = self.missed.get()
        if not told and not (self.known.exists() and self.known.get()[0] <= asked + self.delay_ms):
            self.missed.update((asked, True))
            yield Row(name=key[0], ms=asked)
        elif not told:
            self.missed.clear()  # it was there; another miss is a new question

    def close(self) -> None:
        pass


def unanswered(missing: DataFrame, registered: DataFrame, delay: str = "2 seconds") -> DataFrame:
    """Streams (name, ts) of lookups that failed and of registrations, to (name, ts): the lookups that no registration answers, made at any time before or up
    to delay after, once a name. Timers on the event time."""
    _timers(missing.sparkSession)
    wait = missing.sparkSession.range(1).select((F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {delay}")) / 1000).cast("long")).first()[0]
    both = missing.select("name", "ts", F.lit(False).alias("registered")).unionByName(registered.select("name", "ts", F.lit(True).alias("registered"))).withWatermark("ts", delay)
    rows = both.withColumn("ms", F.unix_millis("ts")).groupBy("name").transformWithState(_Missing(wait), "name string, ms bigint", "Append", "EventTime")
    return rows.select("name", F.timestamp_millis("ms").alias("ts"))
