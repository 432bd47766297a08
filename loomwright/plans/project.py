"""A whole scan: files, cache, prefilter, extraction, hits, markers and counts."""

from __future__ import annotations

import logging
import re
import time
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import scan
from ..operators.graph import written
from ..sources import file_tree, tables

log = logging.getLogger(__name__)
REVISION = 1
#: What extraction fails with: a pattern that goes too deep, or that the engine refuses.
EXTRACTION = re.compile(r"StackOverflowError|INVALID_PARAMETER_VALUE\.(?:PATTERN|REGEX)|PatternSyntaxException")
EXTRACTORS = ("auto", "values", "quoted")
DEFAULT_EXCLUDE = ("**/__tests__", "**/__mocks__", "**/*.test.*", "**/*.spec.*", "**/*.stories.*")


@dataclass
class Config:
    """extractor: 'values' reads value positions only, 'quoted' any quoted token; 'auto' is 'values' and falls back to 'quoted' on failure, and says so."""

    markers: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    include_tests: bool = False
    extractor: str = "auto"
    cache_path: str | None = None
    cache_key: str = ""

    def __post_init__(self):
        if self.extractor not in EXTRACTORS:
            raise ValueError(f"extractor: {self.extractor!r} is none of {', '.join(EXTRACTORS)}")

    @property
    def globs(self) -> list[str]:
        return [*([] if self.include_tests else DEFAULT_EXCLUDE), *self.exclude]


@dataclass
class Result:
    names: DataFrame  # name
    by_file: DataFrame  # path, names
    marks: DataFrame  # path, marks
    files: int
    from_cache: int
    engine: str
    fallback_reason: str | None = None
    seconds: dict[str, float] = field(default_factory=dict)  # by phase: list, match with the cache, read, aggregate


def project(spark: SparkSession, files: DataFrame, names: DataFrame, config: Config | None = None) -> Result:
    """Scan files (path, rel_path, mtime_ms, size and code) for the names. Files that are only listed (without code) are read here, and only where the
    cache does not have them.

    Unchanged files are taken from the cache: equal path, time and size, under a key that holds the dictionary, the markers, the extractor and the
    revision. The new cache has the files of this scan only, and where no file changed it is not written again. A file that vanished counts, and has neither names nor a cache entry.
    Failing to write the cache does not fail the scan.
    """
    config = config or Config()
    engine = "quoted" if config.extractor == "quoted" else "values"
    try:
        return _project(spark, files, names, config, engine)
    except (PySparkException, Py4JJavaError) as e:  # extraction; other failures, such as a lost executor or a full disk, are not answered by another extractor
        if config.extractor != "auto" or not EXTRACTION.search(str(e)):
            raise
        log.warning("extractor 'values' failed, taking 'quoted': %s", e)
        out = _project(spark, files, names, config, "quoted")
        out.fallback_reason = str(e)[:600]
        return out


def _project(spark: SparkSession, files: DataFrame, names: DataFrame, config: Config, engine: str) -> Result:
    files = scan.in_scope(files, config.globs)
    clock, seconds = [time.perf_counter()], {}

    def phase(name: str) -> None:
        clock.append(time.perf_counter())
        seconds[name] = clock[-1] - clock[-2]

    listed = "code" not in files.columns
    if listed:
        files = written(files, "listing")
    phase("list")
    on = ["path", "mtime_ms", "size"]
    fresh, cached, n_cached, n_files = files, None, 0, None
    if config.cache_path:
        print_ = scan.fingerprint(names).first()["fingerprint"]
        key = f"{config.cache_key}:{print_}:m{chr(1).join(config.markers)}:{engine}:{REVISION}"
        cache = tables.read_cache(spark, config.cache_path, key)
        cached = cache.join(files.select(*on), on, "left_semi")
        # One pass counts what is listed, what is cached and what is both.
        sides = files.select(*on, F.lit(1).alias("_listed")).join(cache.select(*on, F.lit(1).alias("_cached")), on, "full")
        n_files, n_cache, n_cached = (n or 0 for n in sides.agg(F.count("_listed"), F.count("_cached"), F.count(F.col("_listed") + F.col("_cached"))).first())
        if n_cached == n_files == n_cache:  # nothing changed: the cache is the result, and stays as it is
            phase("match")
            return _result(cache, n_files, n_cached, engine, seconds)
        fresh = scan.changed(files, cache, on)
    phase("match")
    if listed:
        fresh = file_tree.with_code(fresh)
    # One pass over the code: markers, and the quoted tokens that may be names. A file without any quoted token is not read more closely.
    quoted = T.literals(F.col("code"))
    found = quoted if engine == "quoted" else F.when(F.size(quoted) > 0, T.value_literals(F.col("code"), F.col("path"))).otherwise(quoted)
    read = written(fresh.select("path", "mtime_ms", "size", T.markers(F.col("code"), config.markers).alias("marks"), found.alias("tokens")), "read")
    phase("read")
    hits = scan.names_by_file(scan.hits(read, names, found=F.col("tokens")))
    entries = read.drop("tokens").join(hits, "path", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    if config.cache_path:
        entries = entries.select(F.lit(key).alias("cache_key"), "path", "mtime_ms", "size", "names", "marks").unionByName(cached)
        try:
            # The new cache is the table that the result is read from. Files without a time are in it, but match no listing.
            tables.write_cache(entries, config.cache_path)
            entries = tables.read_cache(spark, config.cache_path, key)
        except (PySparkException, Py4JJavaError) as e:  # a cache is a help, not a result
            log.warning("the cache was not written: %s", e)
            entries = written(entries, "entries")
    else:
        counted = Observation()
        entries = written(entries.observe(counted, F.count(F.lit(1)).alias("files")), "entries")
        n_files = counted.get["files"]
    phase("aggregate")
    return _result(entries, n_files, n_cached, engine, seconds)


def _result(entries: DataFrame, n_files: int | None, n_cached: int, engine: str, seconds: dict[str, float]) -> Result:
    by_file = entries.where(F.size("names") > 0).select("path", "names")
    return Result(
        names=by_file.select(F.explode("names").alias("name")).distinct(),
        by_file=by_file,
        marks=entries.where(F.size("marks") > 0).select("path", "marks"),
        files=entries.count() if n_files is None else n_files,
        from_cache=n_cached,
        engine=engine,
        seconds=seconds,
    )
