"""Checks of a result against what was expected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"\"[^\"\\\n]*(?:\\.[^\"\\\n]*)*+\"|'[^'\\\n]*(?:\\.[^'\\\n]*)*+'"


def is_text(content: Column) -> Column:
    """Bytes that are valid UTF-8 without NUL."""
    as_text = content.cast("string")
    return F.call_function("is_valid_utf8", as_text) & ~F.contains(as_text, F.lit("\0"))


def quoted_strings(code: Column) -> Column:
    """The contents of all quoted strings, escapes as they are written."""
    found = F.regexp_extract_all(F.coalesce(code, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.transform(found, lambda x: F.substring(x, F.lit(2), F.char_length(x) - 2))


def missing(expected: DataFrame, found: DataFrame, column: str = "name") -> DataFrame:
    """Expected, but not found."""
    return expected.select(column).distinct().join(found.select(column).distinct(), column, "left_anti")


def unexpected(expected: DataFrame, found: DataFrame, column: str = "name") -> DataFrame:
    """Found, but not expected."""
    return missing(found, expected, column)


def owners(present: DataFrame, paths: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, name) of the paths that are present. A path may belong to several names: the expected ones where there are any, else all."""
    wanted = expected.select("name").distinct().withColumn("_wanted", F.lit(True))
    owned = paths.select("path", "name").distinct().join(present.select("path").distinct(), "path", "left_semi").join(wanted, "name", "left")
    any_wanted = owned.groupBy("path").agg(F.max(F.coalesce("_wanted", F.lit(False))).alias("_any"))
    return owned.join(any_wanted, "path").where(F.coalesce("_wanted", F.lit(False)) | ~F.col("_any")).select("path", "name")


def leaked(tokens: DataFrame, dictionary: DataFrame, *, limit: int = 200, binary: bool = False) -> DataFrame:
    """One row: how many dictionary names stand among the tokens, and whether that is more than limit. In binaries only names of 10 characters or more count."""
    names = dictionary.select("name").distinct()
    if binary:
        names = names.where(F.char_length("name") >= 10)
    n = tokens.select("name").distinct().join(names, "name", "left_semi").agg(F.count(F.lit(1)).alias("names"))
    return n.select("names", (F.col("names") > limit).alias("leaked"))


def max_shift(a: Column, b: Column) -> Column:
    """The largest absolute difference of two arrays of equal length; null where lengths differ."""
    return F.when(F.size(a) == F.size(b), F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))))


def diff_percent(a: Column, b: Column) -> Column:
    """100 times the share of positions in which two arrays differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (~x.eqNullSafe(y)).cast("int")), F.lit(0), lambda s, x: s + x) * 100.0 / F.size(a)


def status(percent: Column, threshold: float = 0.5) -> Column:
    return F.when(percent >= threshold, "DIFF").otherwise("ok")


def without_calls(definitions: DataFrame, calls: DataFrame, on: str) -> DataFrame:
    """Definitions that nothing calls."""
    return definitions.join(calls.select(on).distinct(), on, "left_anti")


def distinct_messages(messages: DataFrame, keys: list[str]) -> DataFrame:
    """Each message once."""
    return messages.select(*keys).distinct()
