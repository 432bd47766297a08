"""Literal scans of a corpus: which dictionary names stand in which texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import written
from .registry import running_total

#: Names that may be broadcast to the scan; a larger dictionary is joined by a shuffle.
BROADCAST_NAMES = 2_000_000
#: Texts whose values are found in one task, about a second's work.
TEXTS_IN_TASK = 5_000


def _names(names: DataFrame) -> DataFrame:
    """The dictionary as a join side. Its size is checked before it is broadcast."""
    names = names.select("name").distinct()
    return F.broadcast(names) if names.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES else names


def in_scope(files: DataFrame, exclude: list[str]) -> DataFrame:
    """Source files (path, rel_path) outside ignored and excluded directories."""
    return files.where(T.is_source(F.col("path")) & ~T.in_ignored_directory(F.col("rel_path")) & ~T.excluded(F.col("rel_path"), exclude))


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by a hash of their key, in tasks of TEXTS_IN_TASK or so, and as many as there are cores at least. For stored rows that are few
    bytes each but much work: a scan cuts tasks by bytes, and a row group, however many rows it has, is never cut."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TEXTS_IN_TASK))
    return rows.repartition(tasks, F.xxhash64(key))


def occurrences(files: DataFrame, key: str, found: Column) -> DataFrame:
    """(key, name) for each literal of an array column."""
    return files.select(key, F.explode(found).alias("name"))


def hits(files: DataFrame, names: DataFrame, *, key: str = "path", found: Column | None = None) -> DataFrame:
    """Distinct (key, name) of the literals that the dictionary has. Texts whose quoted tokens are none of them are gone before any shuffle."""
    found = T.literals(F.col("code")) if found is None else found
    return occurrences(files, key, found).join(_names(names), "name", "left_semi").select(key, "name").distinct()


def prefiltered(files: DataFrame, names: DataFrame, *, key: str = "path", code: str = "code") -> DataFrame:
    """Rows with at least one quoted dictionary name; only these need closer reading."""
    tokens = files.select(key, F.explode(T.literals(F.col(code))).alias("name"))
    return files.join(tokens.join(_names(names), "name", "left_semi").select(key).distinct(), key, "left_semi")


def names_by_file(found: DataFrame, *, key: str = "path") -> DataFrame:
    """Sorted names of each file with any."""
    return found.groupBy(key).agg(F.array_sort(F.collect_set("name")).alias("names"))


def top_files(by_file: DataFrame, limit: int, *, key: str = "path") -> DataFrame:
    """Most names first; of equal counts in the reading order of the keys, then in binary order."""
    ranked = by_file.select(key, F.size("names").alias("cnt"))
    order = [F.desc("cnt"), *([F.collate(F.col(key), "UNICODE")] if dict(by_file.dtypes)[key] == "string" else []), F.col(key)]
    return ranked.orderBy(*order).limit(limit)


def marked(files: DataFrame, wanted: list[str], *, key: str = "path", code: str = "code") -> DataFrame:
    """Files that contain any marker, with those that they contain."""
    return files.select(key, T.markers(F.col(code), wanted).alias("marks")).where(F.size("marks") > 0)


def unchanged(files: DataFrame, cache: DataFrame, on: list[str]) -> DataFrame:
    """Rows that the cache has with equal key, time and size."""
    return files.join(cache.select(*on).distinct(), on, "left_semi")


def changed(files: DataFrame, cache: DataFrame, on: list[str]) -> DataFrame:
    """Rows that have to be read again: new, or of another time or size."""
    return files.join(cache.select(*on).distinct(), on, "left_anti")


def fingerprint(names: DataFrame, column: str = "name") -> DataFrame:
    """One row: the number of distinct names and the digest of all, each followed by NUL, in order.

    The names meet in one row, so a dictionary of more than BROADCAST_NAMES is refused.
    """
    names = names.select(column).distinct()
    if (n := names.limit(BROADCAST_NAMES + 1).count()) > BROADCAST_NAMES:
        raise ValueError(f"a dictionary of {n} names or more has no fingerprint")
    one = names.agg(F.array_sort(F.collect_list(column)).alias("a"))
    text = F.when(F.size("a") == 0, "").otherwise(F.concat(F.array_join("a", "\0"), F.lit("\0")))
    return one.select(F.concat_ws(":", F.size("a").cast("string"), F.sha1(text.cast("binary"))).alias("fingerprint"))


def merged(parts: list[DataFrame], *, key: str = "path") -> DataFrame:
    """Names of each file over several extractors' results."""
    all_parts = parts[0].select(key, "names")
    for p in parts[1:]:
        all_parts = all_parts.unionByName(p.select(key, "names"))
    return all_parts.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))


def upper_median(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Minimum and upper median (of an even number the larger of the middle two) of each group.

    Equal values are counted first, and the counts are summed along ranges of (group, value), so a group with very many rows
    is no larger task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = written(running_total(counts, [*group, value], F.col("_c"), "_sum"), "ranked")
    groups = ranked.groupBy(*group).agg(F.min(value).alias("least"), F.min("_sum").alias("_first"), F.sum("_c").alias("_n"))
    at = ranked.join(groups.withColumnsRenamed({g: f"_g_{g}" for g in group}), [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group])
    middle = F.col("_first") + F.floor(F.col("_n") / 2)
    return at.where((F.col("_sum") <= middle) & (middle < F.col("_sum") + F.col("_c"))).select(*group, "least", F.col(value).alias("median"))
