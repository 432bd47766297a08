"""Source trees as a table.

`source_tree` is a Python data source for trees that all executors can see (a mount): it keeps files whose names begin with a dot or an underscore, follows no
symbolic links below the root, and does not descend into ignored or excluded directories. Directories are
partitions, of the first level that has enough of them. Files that vanish between listing and reading are rows with status 'gone'; other failures fail the read.
For stores that only Spark reads there is from_store(), with Spark's own listing rules.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import islice, pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as T

SCHEMA = "root string, path string, rel_path string, mtime_ms double, size bigint, status string"
ARROW = pa.schema([("root", pa.string()), ("path", pa.string()), ("rel_path", pa.string()), ("mtime_ms", pa.float64()), ("size", pa.int64()), ("status", pa.string())])
#: Files that a task reads, about. Listings come by directory, which may be one for all.
FILES_IN_TASK = 2000
#: Partitions of a listing, at least, if one of so many levels of directories has them without having more than the most.
LISTINGS, MOST_LISTINGS, LEVELS = 16, 256, 4
SOURCE_FILE = re.compile(r"\.[cm]?[jt]sx?\Z")


class Part(InputPartition):
    def __init__(self, root: str, relative: str, deep: bool):
        super().__init__(relative)
        self.root, self.relative, self.deep = root, relative, deep


class SourceTree(DataSource):
    """Lists files. Options: paths and exclude (globs), each separated by NUL."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return TreeReader(self.options)


class TreeReader(DataSourceReader):
    def __init__(self, options):
        split = lambda key: [x for x in options.get(key, "").split("\0") if x]
        self.roots = [os.path.abspath(p) for p in split("paths")]
        self.exclude = [re.compile(T.glob_regex(g).replace(r"\z", r"\Z")) for g in split("exclude")]
        for root in self.roots:
            if not os.path.exists(root):
                raise FileNotFoundError(f"source not found: {root}")

    def _dropped(self, relative: str) -> bool:
        return any(p.search(relative) for p in self.exclude)

    def _enters(self, entry: os.DirEntry, relative: str) -> bool:
        return entry.is_dir(follow_symlinks=False) and not entry.name.startswith(".") and entry.name not in T.IGNORED_DIRECTORIES and not self._dropped(relative)

    def partitions(self):
        """A partition for each directory of the levels that give enough of them, for its own files, and one for each tree below."""
        parts = []
        for root in self.roots:
            parts.append(Part(root, "", False))
            level = self._inner(root, "")
            for _ in range(LEVELS - 1):
                if not level or len(level) >= LISTINGS:
                    break
                below = [deeper for relative in level for deeper in self._inner(root, relative)]
                if len(below) > MOST_LISTINGS:
                    break
                parts += [Part(root, relative, False) for relative in level]
                level = below
            parts += [Part(root, relative, True) for relative in level]
        return parts

    def _inner(self, root: str, relative: str) -> list[str]:
        """The directories in one that are entered."""
        try:
            with os.scandir(os.path.join(root, relative)) as entries:
                named = [(e, f"{relative}/{e.name}" if relative else e.name) for e in sorted(entries, key=lambda e: e.name)]
                return [inner for e, inner in named if self._enters(e, inner)]
        except (FileNotFoundError, NotADirectoryError):
            return []

    def _files(self, root: str, relative: str, deep: bool) -> Iterator[str]:
        if os.path.isfile(root):
            if SOURCE_FILE.search(root) and not self._dropped(os.path.basename(root)):
                yield ""
            return
        try:
            entries = sorted(os.scandir(os.path.join(root, relative)), key=lambda e: e.name)
        except FileNotFoundError:  # gone since it was listed as a partition
            return
        for entry in entries:
            inner = f"{relative}/{entry.name}" if relative else entry.name
            if entry.is_file(follow_symlinks=False):
                if SOURCE_FILE.search(entry.name) and not self._dropped(inner):
                    yield inner
            elif deep and self._enters(entry, inner):
                yield from self._files(root, inner, True)

    def read(self, partition):
        rows = self._rows(partition)
        while batch := list(islice(rows, 4096)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*batch), ARROW.types)], schema=ARROW)

    def _rows(self, partition):
        for relative in self._files(partition.root, partition.relative, partition.deep):
            path = os.path.join(partition.root, relative) if relative else partition.root
            name = relative or os.path.basename(path)
            try:
                stat = os.stat(path)
                yield partition.root, path, name, stat.st_mtime_ns / 1e6, stat.st_size, "listed"
            except FileNotFoundError:
                yield partition.root, path, name, None, None, "gone"


def read_tree(spark: SparkSession, paths: list[str], *, exclude: list[str] | None = None, content: bool = True) -> DataFrame:
    """Files of all trees; one that several hold stands once. A missing root fails before anything is listed. code is the content as text; without content there
    is no such column, and files are only listed."""
    spark.dataSource.register(SourceTree)
    options = {"paths": "\0".join(paths), "exclude": "\0".join(exclude or [])}
    files = spark.read.format("source_tree").options(**options).load()
    roots = sorted(os.path.abspath(p) for p in paths)
    if any(b == a or b.startswith(a.rstrip("/") + "/") for a, b in pairwise(roots)):
        files = files.dropDuplicates(["path"])
    return with_code(files) if content else files


def with_code(files: DataFrame) -> DataFrame:
    """Listed files with their text. One that is gone by now has none, and status 'gone'. Files are dealt out by a hash of the path, however few directories they
    are in."""
    fields = [f for f in files.schema.fields if f.name not in ("status", "code")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", status string, code string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):  # so many files are held at once
                part = batch.iloc[at : at + 256]
                texts = [_text(p) for p in part["path"]]
                yield part[[f.name for f in fields]].assign(status=["gone" if t is None else "read" for t in texts], code=texts)

    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-files.count() // FILES_IN_TASK))
    return files.repartition(tasks, F.xxhash64("path")).mapInPandas(run, schema)


def _text(path: str) -> str | None:
    try:
        with open(path, "rb") as f:
            return f.read().decode("utf-8", "replace")
    except FileNotFoundError:
        return None


def from_store(spark: SparkSession, path: str, *, exclude: list[str] | None = None) -> DataFrame:
    """Files below a path in any store. Spark's listing leaves out names that begin with a dot or an underscore."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    relative = F.regexp_replace(F.regexp_replace("path", r"\A[a-zA-Z][\w+.-]*:/*", "/"), F.lit("\\A" + re.escape(re.sub(r"\A[a-zA-Z][\w+.-]*:/*", "/", path.rstrip("/"))) + "/"), F.lit(""))
    files = files.select(F.lit(path).alias("root"), "path", relative.alias("rel_path"), (F.unix_micros("modificationTime") / 1000).alias("mtime_ms"), F.col("length").alias("size"), F.lit("read").alias("status"), T.text_of(F.col("content")).alias("code"))
    return files.where(T.is_source(F.col("path")) & ~T.in_ignored_directory(F.col("rel_path")) & ~T.excluded(F.col("rel_path"), exclude or []))
