"""Dictionaries, icon data, and cache tables."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import units

CACHE = "cache_key string, path string, mtime_ms double, size bigint, names array<string>, marks array<string>"
ICONS = "variant string, name string, d string, f string"


def dictionary(symbols: DataFrame, aliases: DataFrame, legacy: DataFrame) -> DataFrame:
    """(name, kind) of all names that may be written: symbols, keys of aliases, legacy names; a name that is several counts as the first."""
    kinds = [symbols.select("name", F.lit(0).alias("k")), aliases.select(F.col("alias").alias("name"), F.lit(1).alias("k")), legacy.select("name", F.lit(2).alias("k"))]
    every = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    return every.groupBy("name").agg(F.min("k").alias("k")).select("name", F.element_at(F.array(*map(F.lit, ("symbol", "alias", "legacy"))), F.col("k") + 1).alias("kind"))


def icon_data(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of variant, name, d and, where it differs from d, f."""
    return spark.read.schema(ICONS).json(path)


def filled(icons: DataFrame) -> DataFrame:
    """Icon data with f for every icon."""
    return icons.withColumn("f", F.coalesce("f", "d"))


def metadata(spark: SparkSession, text: str, family: str) -> DataFrame:
    """Icons of a metadata document, which may have a guard before its first brace: name, version, and kind: legacy if the families that don't have
    it include one whose name begins with family, else symbol."""
    schema = "icons array<struct<name: string, version: int, unsupported_families: array<string>>>"
    body = F.regexp_replace("text", r"\A[^{]*", "")
    rows = spark.createDataFrame([(text,)], "text string").select(F.explode(F.from_json(body, schema)["icons"]).alias("i")).select("i.*")
    unsupported = F.exists("unsupported_families", lambda x: x.startswith(family))
    return rows.select("name", "version", F.when(unsupported, "legacy").otherwise("symbol").alias("kind"))


def join_axes(fetched: DataFrame) -> DataFrame:
    """icons from (variant, name, axis 'default' or 'fill', path): both axes are needed; f is left out where it equals d."""
    both = fetched.groupBy("variant", "name").pivot("axis", ["default", "fill"]).agg(F.first("path", ignorenulls=True))
    return both.where("`default` IS NOT NULL AND fill IS NOT NULL").select("variant", "name", F.col("default").alias("d"), F.nullif("fill", "default").alias("f"))


def missing_axes(fetched: DataFrame) -> DataFrame:
    """(variant, name, axis): what join_axes() leaves an icon out for, the axis without a path."""
    both = fetched.groupBy("variant", "name").pivot("axis", ["default", "fill"]).agg(F.first("path", ignorenulls=True))
    absent = F.array_compact(F.array(*[F.when(F.col(f"`{a}`").isNull(), F.lit(a)) for a in ("default", "fill")]))
    return both.select("variant", "name", F.explode(absent).alias("axis"))


def write_icons(icons: DataFrame, path: str) -> None:
    """Icon data as JSON lines in the order of variant and name, without f where it is null. icon_data() reads them."""
    icons.select("variant", "name", "d", "f").repartitionByRange("variant", "name").sortWithinPartitions("variant", "name").write.json(path)


def summary(icons: DataFrame, names: DataFrame) -> DataFrame:
    """(what, n): icons of each variant, and names of each kind of a dictionary()."""
    counts = lambda df, c: df.groupBy(F.col(c).alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return counts(icons, "variant").unionByName(counts(names, "kind"))


def names_module(names: DataFrame, aliases: DataFrame, most: int = 2_000_000) -> str:
    """A module of the names by kind, and of aliases, in order. A dictionary is small; one of more than most names or aliases is refused."""
    rows = names.select("kind", "name").limit(most + 1).collect()
    pairs = aliases.select("alias", "target").limit(most + 1).collect()
    if max(len(rows), len(pairs)) > most:
        raise ValueError(f"a dictionary of more than {most} names or aliases is no module")
    kinds = {k: sorted((r["name"] for r in rows if r["kind"] == k), key=units) for k in ("symbol", "legacy")}
    known = dict(sorted(((r["alias"], r["target"]) for r in pairs), key=lambda p: units(*p)))
    return "".join(f"export const {k} = {json.dumps(v, separators=(',', ':'))};\n" for k, v in [("symbols", kinds["symbol"]), ("legacy", kinds["legacy"]), ("aliases", known)])


def read_cache(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Entries under the key; other keys' entries are stale, and an absent or unreadable cache is an empty one."""
    return read_table(spark, path, CACHE).where(F.col("cache_key") == key)


def write_cache(entries: DataFrame, path: str) -> str:
    """A new version of the cache."""
    return write_table(entries, path)


def _versions(spark: SparkSession, path: str) -> list[str]:
    return [r["value"] for r in spark.read.text(f"{path}/current").orderBy("value").collect()]


def read_table(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The newest version of a table of versions; an absent or unreadable one is empty."""
    try:
        return spark.read.schema(schema).parquet(f"{path}/{_versions(spark, path)[-1]}")
    except (AnalysisException, IndexError):
        return spark.createDataFrame([], schema)


def write_table(df: DataFrame, path: str, keep: int = 2) -> str:
    """A new version of a table, which readers see once it is whole: the data come first, then a pointer to them is added, and nothing is overwritten. Of older
    versions the last keep - 1 stay, for readers that are at work; the others go."""
    spark = df.sparkSession
    version = f"v-{time.time_ns():020d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("append").text(f"{path}/current")
    for old in _versions(spark, path)[:-keep]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{old}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return version
