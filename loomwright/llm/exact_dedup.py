"""Exact deduplication by content sort.

Rows are dealt by sampled splitters over the leading bytes of the normalised text (a hash of the whole
text breaks ties between long common prefixes, so that the sampled keys stay short), sorted
externally inside each range, and compared in full with their neighbours: the window below opens a new
group wherever a whole normalised text differs from the one before it. Texts cross the network once.

A text with very many copies would make one range of its own. Such texts are found first by a count of
hashes, which partial aggregation combines before the shuffle. A hash with more than most rows is heavy: its rows get
as many salts as bring each below most, and the number and best id of its texts come from an aggregation by
whole text, again combined before the shuffle. Both tables are broadcast where they are small, which is
checked, and joined by a shuffle otherwise.

Nothing but DataFrame expressions is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, durable, own_name, renamed, restored

PREFIX = 32
#: Rows of equal texts in one task, about.
MOST = 10_000
#: Heavy hashes or texts that may be broadcast: some 100 bytes each.
SMALL = 100_000


def _norm(text_col: str) -> Column:
    return ascii_lower(F.coalesce(F.col(text_col), F.lit("")))


def _marked(docs: DataFrame, id_col: str, text_col: str, keep: str, most: int) -> DataFrame:
    """docs, whose columns have no leading underscores, with _keep_id, _group_size, _kept and _sha."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep!r} is neither 'smallest' nor 'largest'")
    best = F.min if keep == "smallest" else F.max
    hashed = docs.select(F.col(id_col).alias("_id"), _norm(text_col).alias("_norm")).withColumn("_h", F.xxhash64("_norm"))
    heavy = durable(hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select("_h", F.ceil(F.col("_n") / most).alias("_salts")), "heavy-texts")
    n_heavy = heavy.count()
    small = F.broadcast if n_heavy <= SMALL else lambda df: df
    dealt = docs.withColumn("_n0", _norm(text_col)).withColumn("_h", F.xxhash64("_n0")).withColumn("_lead", F.substring("_n0", 1, PREFIX)).drop("_n0")
    keys = ["_lead", "_h"]
    if n_heavy:
        keys.append("_salt")
        salted = F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(id_col), F.col("_salts"))).otherwise(F.lit(0).cast("long"))
        dealt = dealt.join(small(heavy), "_h", "left").withColumn("_salt", salted).drop("_salts")
    # The normalised text is made again after the shuffle, which so carries each text once.
    dealt = dealt.repartitionByRange(*keys).withColumn("_norm", _norm(text_col))
    group = Window.partitionBy(*keys, "_norm")
    order = group.orderBy(F.col(id_col).asc_nulls_last() if keep == "smallest" else F.col(id_col).desc_nulls_last())
    runs = (
        dealt.withColumn("_rank", F.row_number().over(order))
        .withColumn("_best", best(id_col).over(group))
        .withColumn("_n", F.count(F.lit(1)).over(group))
        .withColumn("_sha", F.sha2(F.col("_norm").cast("binary"), 256))
        .drop("_norm", *keys)
        .withColumns({"_keep_id": F.col("_best"), "_group_size": F.col("_n")})
    )
    if n_heavy:
        # Of a heavy hash all texts are here, were they several.
        groups = hashed.join(small(heavy), "_h", "left_semi").groupBy("_norm").agg(best("_id").alias("_all_best"), F.count(F.lit(1)).alias("_all_n"))
        groups = durable(groups.select(F.sha2(F.col("_norm").cast("binary"), 256).alias("_sha"), "_all_best", "_all_n"), "heavy-groups")
        runs = runs.join(small(groups) if groups.count() <= SMALL else groups, "_sha", "left")
        runs = runs.withColumns({"_keep_id": F.coalesce("_all_best", "_best"), "_group_size": F.coalesce("_all_n", "_n")})
    return runs.withColumn("_kept", (F.col("_rank") == 1) & F.col(id_col).eqNullSafe(F.col("_keep_id")))


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", most: int = MOST) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    keep: "smallest" or "largest" id of a group of equal texts (equal after lower-casing A-Z only).
    A null text counts as empty; empty texts are one group. Of repeated rows with one id, one is kept.
    A null id is kept only where all ids of its group are null. Other columns of docs are ignored,
    whatever their names, and an empty table gives an empty
    result. However long a text is, it is compared in full.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return _marked(own, "id", "text", keep, most).select(
        F.col("id").alias(id_col), F.col("_keep_id").alias("keep_id"), F.col("_group_size").cast("long").alias("group_size"), F.col("_kept").alias("kept"), F.col("_sha").alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", most: int = MOST) -> DataFrame:
    """docs without the rows that exact_groups does not keep; all columns, whatever their names, travel through the one sort."""
    return restored(_marked(renamed(docs), own_name(docs, id_col), own_name(docs, text_col), keep, most).where("_kept"), docs)
