"""Registries: from uses of names to the entries, shapes and text that are really needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import units
from .graph import written


def resolve_aliases(names: DataFrame, aliases: DataFrame, *, name: str = "name") -> DataFrame:
    """names with target: the alias' target, or the name itself. One hop; aliases are (alias, target), one row an alias."""
    known = aliases.select(F.col("alias").alias("_alias"), F.col("target").alias("_target"))
    joined = names.join(known, F.col(name) == F.col("_alias"), "left")
    return joined.withColumn("target", F.coalesce("_target", name)).drop("_alias", "_target")


def expand_variants(uses: DataFrame, configured: list[str]) -> DataFrame:
    """A use of variant '*' is one of each configured variant."""
    every = F.array(*[F.lit(v) for v in configured]).cast("array<string>")
    return uses.withColumn("variant", F.explode(F.when(F.col("variant") == "*", every).otherwise(F.array("variant"))))


def shape_sets(uses: DataFrame, keys: list[str], shape: str = "shape") -> DataFrame:
    """For each key the distinct shapes, joined in order: 'd', 'f' or 'df'."""
    return uses.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(shape)), "").alias("shapes"))


def selected(uses: DataFrame, icons: DataFrame) -> DataFrame:
    """(variant, name, shape, path) of the uses that icon data has: shape d is the path d, and f the path f, or d where both are alike."""
    path = F.when(F.col("shape") == "f", F.coalesce("f", "d")).otherwise(F.col("d"))
    return uses.select("variant", "name", "shape").distinct().join(icons.select("variant", "name", "d", "f"), ["variant", "name"]).select("variant", "name", "shape", path.alias("path"))


def first_seen_codes(rows: DataFrame, value: str, order: list[str]) -> DataFrame:
    """(value, code): distinct values numbered from 0 in the order in which they first appear.

    Distinct values are aggregated first; only they are numbered, by ranges: rows are dealt by the order, numbered in
    their range, and shifted by the rows of the ranges before.
    """
    first = rows.groupBy(value).agg(F.min(F.struct(*order)).alias("_first"))
    return numbered(first, ["_first"], "code").select(value, "code")


def running_total(df: DataFrame, order: list[str], weight: Column, name: str) -> DataFrame:
    """df with the sum of weight over all rows before, along an order, without bringing all rows to one task.

    Rows are dealt by ranges of the order and written once; each range is summed by itself and shifted by the ranges before.
    """
    dealt = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).withColumn("_w", weight), "ranges")
    sizes = dealt.groupBy("_part").agg(F.sum("_w").alias("_n"))  # one row for each partition
    sum_before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select("_part", sum_before("_n", Window.orderBy("_part")).alias("_shift"))
    inner = sum_before("_w", Window.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(shift), "_part").withColumn(name, F.col("_shift") + inner).drop("_part", "_w", "_shift")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with numbers from 0 along an order without ties."""
    return running_total(df, order, F.lit(1), name)


def stats(chosen: DataFrame) -> DataFrame:
    """One row: icons, d and f shapes, entries whose two shapes share a path, and the length of all distinct paths."""
    entries = chosen.groupBy("variant", "name").agg(
        F.max(F.when(F.col("shape") == "d", F.col("path"))).alias("d"), F.max(F.when(F.col("shape") == "f", F.col("path"))).alias("f")
    )
    counts = entries.agg(F.count(F.lit(1)).alias("icons"), F.count("d").alias("d_shapes"), F.count("f").alias("f_shapes"), F.count(F.when(F.col("d") == F.col("f"), 1)).alias("shared"))
    size = distinct_length(chosen, "path").withColumnRenamed("total", "path_chars")
    both = counts.unionByName(size, allowMissingColumns=True)  # one row each
    return both.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in both.columns])


def distinct_length(df: DataFrame, column: str) -> DataFrame:
    """Σ length over the distinct values; a value is counted once however often it stands."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().agg(F.coalesce(F.sum(F.char_length(column)), F.lit(0)).cast("long").alias("total"))


def render(chosen: DataFrame, aliases: DataFrame, mode: str = "scanned", most: int = 2_000_000) -> str:
    """The registry as a script: paths once each, then variants and names in order, then aliases. It holds only what is used; one of more than most rows or aliases is refused."""
    codes = first_seen_codes(chosen, "path", ["variant", "name", "shape"])
    rows = chosen.join(codes, "path").select("variant", "name", "shape", "code", "path").limit(most + 1).collect()
    known = aliases.select("alias", "target").limit(most + 1).collect()
    if max(len(rows), len(known)) > most:
        raise ValueError(f"a registry of more than {most} rows or aliases is no script")
    paths = sorted({(r["code"], r["path"]) for r in rows})
    lines = ["'use strict';", *[f"var p{c}={_quoted(p)};" for c, p in paths], f"module.exports={{mode:{_quoted(mode)},icons:{{"]
    shapes: dict[str, dict[str, list]] = {}
    for r in sorted(rows, key=lambda r: units(r["variant"], r["name"], r["shape"])):
        shapes.setdefault(r["variant"], {}).setdefault(r["name"], []).append(f"{r['shape']}:p{r['code']}")
    for variant, names in shapes.items():
        lines += [f"{_quoted(variant)}:{{", *[f"{_quoted(name)}:{{{','.join(each)}}}," for name, each in names.items()], "},"]
    pairs = sorted(((r["alias"], r["target"]) for r in known), key=lambda p: units(*p))
    lines.append(f"}},aliases:{{{','.join(f'{_quoted(a)}:{_quoted(t)}' for a, t in pairs)}}}}};")
    return "\n".join(lines) + "\n"


def _quoted(s: str) -> str:
    import json

    return json.dumps(s)


def write_if_changed(path: str, text: str) -> bool:
    """Replace a driver-side file as a whole, unless it already holds the text. Says whether it was written."""
    import os
    import tempfile

    try:
        with open(path, encoding="utf-8") as f:
            if f.read() == text:
                return False
    except FileNotFoundError:
        pass
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        f.write(text)
    os.replace(f.name, path)
    return True


def lookup(requests: DataFrame, icons: DataFrame, aliases: DataFrame, mode: str | None = "scanned") -> DataFrame:
    """requests (variant, name, filled) with path and message: the path to draw or null, and then why.

    mode is the registry's: 'scanned' has what a scan found, 'all' every icon, 'stub' nothing for want of a scan; any other is damaged. A registry of all icons
    draws the path d where an icon has no f.
    """
    data = icons.select("variant", F.col("name").alias("target"), F.col("d").alias("_d"), (F.coalesce("f", "d") if mode == "all" else F.col("f")).alias("_f"))
    variants = icons.select(F.col("variant").alias("_v")).distinct()
    found = resolve_aliases(requests, aliases).join(data, ["variant", "target"], "left").join(variants, F.col("variant") == F.col("_v"), "left")
    path = F.when(F.lit(mode in ("scanned", "all")), F.when(F.col("filled"), F.coalesce("_f", "_d")).otherwise(F.col("_d")))
    message = missing_message(F.col("_v").isNotNull(), F.col("_d").isNotNull() | F.col("_f").isNotNull(), mode)
    return found.withColumn("path", path).withColumn("message", F.when(F.col("path").isNull(), message)).drop("_d", "_f", "_v")


def missing_message(has_variant: Column, has_name: Column, mode: str | None = "scanned") -> Column:
    if mode == "stub":
        return F.lit("no scan has filled the registry")
    if mode == "all":
        return F.format_string("'%s' is no name that is known", F.col("name"))
    if mode != "scanned":
        return F.lit("the registry is damaged")
    return (
        F.when(~has_variant, F.format_string("the registry has no variant '%s'", F.col("variant")))
        .when(has_name, F.format_string("'%s' is there, but not in the shape asked for", F.col("name")))
        .otherwise(F.format_string("'%s' was not found in the sources", F.col("name")))
    )


def report(chosen: DataFrame, aliases_used: int, files: int, engine: str) -> str:
    """One line about a scan."""
    s = stats(chosen).first()
    per = ", ".join(f"{r['variant']} {r['n']}" for r in chosen.groupBy("variant").agg(F.count_distinct("name").alias("n")).orderBy("variant").collect())
    return f"{s['icons']} icons ({per}) · {s['d_shapes']} outline, {s['f_shapes']} filled, {s['shared']} shared · {s['path_chars'] / 1024:.1f} KB · {aliases_used} aliases · {files} files · {engine}"


def over_limit(chosen: DataFrame, limit: int) -> DataFrame:
    """Variants with more icons than limit."""
    return chosen.groupBy("variant").agg(F.count_distinct("name").alias("icons")).where(F.col("icons") > limit)


def unknown_names(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Names that were asked for and that nobody knows."""
    return wanted.select("name").distinct().join(known.select("name").distinct(), "name", "left_anti")


def twins(legacy: DataFrame, symbols: DataFrame, variants: int) -> DataFrame:
    """(alias, target): legacy names whose content equals one and the same symbol's in every variant.

    Both are (variant, name, d, f); of symbols with equal content the alphabetically first counts, and legacy names that are
    symbols too are left out.
    """
    key = F.concat_ws("\n", F.col("d"), F.coalesce("f", F.lit("")))
    index = symbols.groupBy("variant", key.alias("content")).agg(F.min("name").alias("target"))
    own = legacy.join(symbols.select("name").distinct(), "name", "left_anti").select("variant", "name", key.alias("content")).distinct()
    found = own.join(index, ["variant", "content"], "left").groupBy("name").agg(F.count_distinct(F.when(F.col("target").isNotNull(), F.col("variant"))).alias("in_variants"), F.min("target").alias("target"), F.max("target").alias("other"))
    return found.where((F.col("in_variants") == variants) & (F.col("target") == F.col("other"))).select(F.col("name").alias("alias"), "target")


def standalone(legacy: DataFrame, symbols: DataFrame, variants: int) -> DataFrame:
    """Legacy entries that are neither symbols nor twins of one."""
    found = twins(legacy, symbols, variants).select(F.col("alias").alias("name"))
    return legacy.join(symbols.select("name").distinct(), "name", "left_anti").join(found, "name", "left_anti")
