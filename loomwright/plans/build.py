"""From sources to a registry in one plan: scan, usage, variants and aliases, icon data, the registry's text, and a report."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import registry, scan, usage
from ..operators.graph import written
from ..sources.file_tree import with_code
from .project import Config, Result, project

log = logging.getLogger(__name__)
COLLECT = ("usage", "literals")
#: Warnings of one kind that a report spells out.
TOLD = 200


@dataclass
class Options(Config):
    """Those of a scan, and: library and component that are traced; variants that are bundled; include, names that are bundled whole; collect, 'usage' for
    traced uses or 'literals' for all names that stand in the sources; limit, of icons a variant before a warning; registry_path, a file of the driver."""

    library: str = ""
    component: str = ""
    variants: list[str] = field(default_factory=lambda: ["rounded"])
    include: list[str] = field(default_factory=list)
    collect: str = "usage"
    limit: int = 500
    registry_path: str | None = None

    def __post_init__(self):
        super().__post_init__()
        if self.collect not in COLLECT:
            raise ValueError(f"collect: {self.collect!r} is none of {', '.join(COLLECT)}")
        if not self.variants:
            raise ValueError("variants: at least one is needed")
        if self.collect == "usage" and not (self.library and self.component):
            raise ValueError("library and component are needed to trace uses")
        if self.library and self.library not in self.markers:
            self.markers = [*self.markers, self.library]


@dataclass
class Build:
    text: str
    changed: bool
    chosen: DataFrame  # variant, name, shape, path
    report: str
    warnings: list[str]
    scan: Result
    usage: usage.Usage | None


def build(spark: SparkSession, files: DataFrame, names: DataFrame, aliases: DataFrame, icons: DataFrame, options: Options) -> Build:
    """files as for project(), listed or with code; names (name) of all that may be written; aliases (alias, target); icons (variant, name, d, f).

    Names to include and variants that the icon data does not know are an error before anything is scanned. Uses of other variants are left out
    with a warning, and so are names that a variant has no icon of, silently.
    """
    _validate(spark, names, icons, options)
    found = project(spark, files, names, options)
    warnings = [f"extraction fell back: {found.fallback_reason}"] if found.fallback_reason else []
    every = F.explode(F.array(F.lit("d"), F.lit("f"))).alias("shape")
    traced = None
    if options.collect == "usage":
        scoped = scan.in_scope(files, options.globs)
        listed = "code" not in scoped.columns
        if listed:
            scoped = written(scoped, "scope")
        if options.cache_path:
            own = None if listed else lambda fresh: scoped.join(fresh.select("path"), "path", "left_semi")
            stmts = usage.cached_statements(spark, scoped, f"{options.cache_path}-statements", read=own)
        else:
            stmts = written(usage.statements(with_code(scoped) if listed else scoped), "statements")
        traced = usage.analyze(scoped, names, library=options.library, component=options.component, default_variant=options.variants[0], stmts=stmts)
        uses = written(traced.uses, "uses")
        strange = uses.where(~F.col("variant").isin("*", *options.variants)).select("variant").distinct()
        warnings += _told(strange, ["variant"], lambda r: f"variant '{r['variant']}' of the sources is not bundled and is left out")
        warnings += _told(traced.diagnostics, ["path", "line"], lambda r: f"{r['path']}:{r['line']}: {r['message']}")
        uses = registry.expand_variants(uses.where(F.col("variant").isin("*", *options.variants)), options.variants)
    else:
        uses = registry.expand_variants(found.names.select(F.lit("*").alias("variant"), "name", every), options.variants)
    if options.include:
        wanted = spark.createDataFrame([(n,) for n in options.include], "name string").select(F.lit("*").alias("variant"), "name", every)
        uses = uses.unionByName(registry.expand_variants(wanted, options.variants))
    resolved = written(registry.resolve_aliases(uses, aliases), "resolved")
    chosen = written(registry.selected(resolved.select("variant", F.col("target").alias("name"), "shape"), icons), "chosen")
    used = resolved.where("target <> name").select(F.col("name").alias("alias"), "target").distinct().join(chosen.select(F.col("name").alias("target")).distinct(), "target", "left_semi").select("alias", "target")
    text = registry.render(chosen, used)
    changed = registry.write_if_changed(options.registry_path, text) if options.registry_path else True
    many = registry.over_limit(chosen, options.limit).orderBy("variant").collect()
    if many:
        top = ", ".join(f"{r['path']} ({r['cnt']})" for r in scan.top_files(found.by_file, 5).collect())
        warnings += [f"{r['icons']} icons of variant {r['variant']}, over {options.limit}: a list of all names may have been scanned. Most names: {top}" for r in many]
    line = registry.report(chosen, used.count(), found.files, found.engine) + f" · {len(options.include)} included"
    if traced:
        line += f" · {traced.sites} uses · {traced.fallback_files.count()} files taken whole"
    log.info(line)
    return Build(text, changed, chosen, line, warnings, found, traced)


def _told(found: DataFrame, order: list[str], said) -> list[str]:
    """The first TOLD of some findings in words, and how many more there are. All of them are in the result's tables."""
    found = written(found, "findings")
    more = found.count() - TOLD
    return [said(r) for r in found.orderBy(*order).limit(TOLD).collect()] + ([f"... and {more} more of these"] if more > 0 else [])


def _validate(spark: SparkSession, names: DataFrame, icons: DataFrame, options: Options) -> None:
    known = {r["variant"] for r in icons.where(F.col("variant").isin(options.variants)).select("variant").distinct().collect()}
    if missing := [v for v in options.variants if v not in known]:
        raise ValueError(f"no icon data of {', '.join(missing)}")
    if options.include:
        wanted = spark.createDataFrame([(n,) for n in options.include], "name string")
        if unknown := sorted(r["name"] for r in registry.unknown_names(wanted, names).collect()):
            raise ValueError(f"no such names: {', '.join(unknown)}")
