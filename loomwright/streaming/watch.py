"""Following a changing tree: what changed is scanned again."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import shared_tables, written
from .changes import tree_changes, unanswered

log = logging.getLogger(__name__)
_active: dict[str, Watch] = {}


def differences(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, mtime_ms, size, op): created, changed and deleted files between two listings (path, mtime_ms, size)."""
    old = before.select("path", F.col("mtime_ms").alias("_m"), F.col("size").alias("_s"), F.lit(True).alias("_was"))
    new = now.select("path", "mtime_ms", "size", F.lit(True).alias("_is"))
    both = old.join(new, "path", "full")
    op = F.when(F.col("_was").isNull(), "created").when(F.col("_is").isNull(), "deleted").when(~(F.col("_m").eqNullSafe(F.col("mtime_ms")) & F.col("_s").eqNullSafe(F.col("size"))), "changed")
    return both.select("path", "mtime_ms", "size", op.alias("op")).where("op IS NOT NULL")


class Watch:
    """Follows trees (changes.tree_changes) and calls on_change(differences) once for each micro-batch with any, however many files changed in it.

    Only sources outside ignored and excluded directories are listed, on executors. A callback that fails is logged, and watching goes on. A second watch
    under the same name stops the first. state is a folder that all machines see, for the snapshots and the checkpoint: a watch that is
    given that of an earlier one begins with what changed since. By default it is a new one among the application's tables.
    """

    def __init__(self, spark: SparkSession, paths: list[str], on_change: Callable[[DataFrame], None], *, exclude: list[str] | None = None, interval: str = "1 second", name: str = "watch", state: str | None = None):
        self.on_change = on_change
        state = state or _own_folder(spark)
        stream = tree_changes(spark, paths, f"{state}/snapshots", exclude=exclude)
        if name in _active:
            _active.pop(name).stop()
        _active[name] = self
        self.query = stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{state}/checkpoint").trigger(processingTime=interval).start()

    def _batch(self, changed: DataFrame, _number: int) -> None:
        try:
            found = written(changed, "differences")
            if not found.isEmpty():
                self.on_change(found)
        except Exception:
            log.exception("a rescan failed")

    def stop(self) -> None:
        self.query.stop()
        self.query.awaitTermination(30)


def _own_folder(spark: SparkSession) -> str:
    folder = shared_tables(spark)
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError("state is needed: the shared folder is a store, and snapshots need a mount that all machines see")
    return f"{folder.removeprefix('file://').removeprefix('file:')}/watch-{uuid.uuid4().hex}"


def stop_all() -> None:
    while _active:
        _active.popitem()[1].stop()


def recheck(missing: DataFrame, registered: DataFrame, delay: str = "2 seconds") -> DataFrame:
    """Streams (name, ts) of lookups that failed and of registrations: the lookups that no registration answers, however long before or up to delay
    later, once a name."""
    return unanswered(missing, registered, delay)
