"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary folder of this machine does for a local
    master, where all tasks run here; on a cluster it would not, so that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: tables between steps need a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="loomwright-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_table(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder, among this application's tables."""
    return f"{shared_dir(spark)}/loomwright/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def drop_tables(spark: SparkSession) -> None:
    """Remove all tables of this application that durable() wrote. For when its results have been written: what is not computed yet still reads them."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/loomwright/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs nothing that is already written."""
    spark, path = df.sparkSession, new_table(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def renamed(docs: DataFrame) -> DataFrame:
    """docs with columns c0, c1 ..., so that no column's name can clash with an operator's own. restored() is the way back."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def restored(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, of what renamed(docs) became."""
    return df.select([f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def own_name(docs: DataFrame, column: str) -> str:
    """What renamed(docs) calls a column."""
    return f"c{docs.columns.index(column)}"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. lower() does the same to pure ASCII and is much the faster there."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, parts: int = 3, part: int = 1) -> Column:
    """crc32 of doc_id as text, mod parts, is part. A null doc_id counts as held out: it has no checksum to learn by."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(True))


def text_groups(texts: Iterable[str | None], most: int = 1 << 20) -> Iterator[list[str]]:
    """Whole texts in lists of about most characters, so that memory follows the longest text and not the batch."""
    held, size = [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


@functools.cache
def _trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)  # the GNU library's; others give memory back themselves


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function that gives freed memory back to the system at its end. Workers go on from task to task and from operator to operator, and
    what one has freed but kept would come on top of what the next one needs."""

    @functools.wraps(run)
    def to_the_end(batches):
        try:
            yield from run(batches)
        finally:
            _trim()(0)

    return to_the_end


def numbered(df: DataFrame, key: str, *order: str, name: str = "numbered") -> DataFrame:
    """df, written in sorted runs, with _at (0, 1 ... within each key by order) and _of (rows of the key).

    Rows are dealt by sampled ranges of key and order and sorted in each, so no key has to fit one task; the number of a row in its run comes
    with the sort, and a running total over the runs of a key gives what lies before it. key must not be null. Rows that are equal in
    all of these columns come in either order; equal rows should be told apart by a further column.
    """
    run = F.shiftright("_seq", 33).alias("_run")
    sorted_runs = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_seq", F.monotonically_increasing_id())
    rows = durable(sorted_runs, name).withColumn("_run", run)
    runs = rows.groupBy(key, "_run").agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_run")
    runs = runs.select(
        key, "_run", (F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy(key)).alias("_of")
    )
    return rows.join(runs, [key, "_run"]).withColumn("_at", F.col("_seq") + F.col("_shift")).drop("_seq", "_run", "_shift")
