"""Lexical scopes as intervals: what brackets enclose, and which declaration a name belongs to.

Brackets outside strings and comments are numbered by their place in the text; a running sum of +1 and -1 gives each its depth, and on one depth openings and
closings alternate, so the next one on the depth closes the interval. A name belongs to the innermost interval with a declaration of it: a join by equal
keys and a range, of which the latest start wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values

#: The end of a scope that no bracket closes.
END = 1 << 30
_SKIPPED = rf"/\*(?s:.*?)\*/|//[^\n]*+|{values.STRING}|{values.TEMPLATE}"


def offsets(text: Column, pattern: str, *groups: int) -> Column:
    """Each match of pattern in text, as structs of at (the number of characters before it) and g0, g1 ... (the groups asked for)."""
    # What stands between matches is matched as well, so that lengths add up.
    spaced = F.lit(rf"(?s)(.*?)((?-s:{pattern}))")
    wholes, before = F.regexp_extract_all(text, spaced, F.lit(0)), F.regexp_extract_all(text, spaced, F.lit(1))
    ends = F.aggregate(wholes, F.array(F.lit(0)), lambda done, w: F.concat(done, F.array(F.element_at(done, -1) + F.char_length(w))))
    parts = [F.regexp_extract_all(text, spaced, F.lit(g + 2)).alias(f"g{i}") for i, g in enumerate(groups)]
    zipped = F.arrays_zip(ends.alias("start"), before.alias("before"), *parts)
    found = F.transform(F.slice(zipped, F.lit(1), F.size(wholes)), lambda z: F.struct((z["start"] + F.char_length(z["before"])).cast("int").alias("at"), *[z[f"g{i}"].alias(f"g{i}") for i in range(len(groups))]))
    return F.coalesce(found, F.array().cast("array<struct<at:int" + "".join(f",g{i}:string" for i in range(len(groups))) + ">>"))


def intervals(texts: DataFrame, *key: str) -> DataFrame:
    """(key, start, end, depth) of all brackets of text: start is the place of the opening one, end that of its closing one, or END where there is none.

    Round, square and curly brackets count alike. A closing bracket that nothing opened is ignored. A null text has none.
    """
    marks = offsets(F.coalesce("text", F.lit("")), rf"{_SKIPPED}|[(){{}}\[\]]", 0)
    rows = texts.select(*key, F.explode(marks).alias("m")).where(F.length("m.g0") == 1).select(*key, F.col("m.at").alias("at"), F.when(F.col("m.g0").isin("(", "[", "{"), 1).otherwise(-1).alias("turn"))
    running = Window.partitionBy(*key).orderBy("at")
    depth = F.sum("turn").over(running.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    level = Window.partitionBy(*key, "level").orderBy("at")
    rows = rows.withColumn("depth", depth).withColumn("level", F.when(F.col("turn") > 0, F.col("depth")).otherwise(F.col("depth") + 1))
    rows = rows.withColumn("end", F.coalesce(F.lead("at").over(level), F.lit(END)))
    return rows.where("turn > 0").select(*key, F.col("at").alias("start"), "end", F.col("level").alias("depth"))


def innermost(points: DataFrame, spans: DataFrame, key: list[str], *, at: str = "at", first: str | None = None) -> DataFrame:
    """points with what the innermost span (start < at < end) of equal key carries; those in no span are left out. Rows of spans that
    start alike are ranked by the column first, the smallest being taken. Each row of points comes once; equal rows of points stay so."""
    marked = points.withColumn("_row", F.monotonically_increasing_id())
    found = marked.join(spans, key).where((F.col("start") < F.col(at)) & (F.col(at) < F.col("end")))
    best = Window.partitionBy("_row").orderBy(F.col("start").desc(), F.col("end"), *([first] if first else []))
    return found.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank", "_row")
