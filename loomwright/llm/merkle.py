"""Merkle manifest of a dataset, with a node store outside memory.

A leaf is the digest of a row. Leaves of a source are sorted by id and hashed up in runs of FANOUT until one node remains, the subroot of
the source; the subroots, sorted by source, are hashed up alike to the root.

The store has one Parquet folder a level. A row of it is a block: the nodes of one level that lie under FANOUT ** HEIGHT consecutive ones of
the level where the block began. Runs never cross blocks, so a level is written from the one before by a sequential read without a shuffle,
and holds a third of its bytes. After HEIGHT levels each block has come down to one node; those are gathered into new blocks (one shuffle
of so much less), and so on. Blocks are bounded, so neither a hot source nor a deep tree meets one task.

Proofs are read out from the top: the levels of a block are merged by their coordinate (source, block), the path above the block comes from
the blocks above it, and a node's siblings at each level are what stands beside it in its run.

Digests are lowercase hex SHA-256; the digest of a node is that of the concatenated hex digests of its run.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, new_table, numbered

FANOUT = 3
#: Levels of a block: it begins with FANOUT ** HEIGHT nodes at most, 729.
HEIGHT = 6
BLOCK = FANOUT**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODES = "key string, block bigint, total bigint, nodes array<string>"
_PATH = "array<struct<left:string,right:string>>"


def digest(*fields: Column) -> Column:
    """The leaf of a row: its fields, each as its UTF-8 byte count, a colon and its value, or - if null. Integers are written in decimal."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]).cast("binary"), 256))


def path_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "").cast("binary"), 256)


@dataclass(frozen=True)
class Tree:
    """The levels of all keys in the store at path: blocks (key, block, total, nodes), where total is the key's number of nodes on the level."""

    spark: SparkSession
    path: str
    levels: int

    def level(self, k: int) -> DataFrame:
        return self.spark.read.schema(_NODES).parquet(f"{self.path}/level={k}")

    def bottom(self) -> DataFrame:
        """Level 0 with what it carries."""
        return self.spark.read.parquet(f"{self.path}/level=0")

    def roots(self) -> DataFrame:
        """key, root."""
        tops = [self.level(k).where("total = 1").select("key", F.col("nodes")[0].alias("root")) for k in range(self.levels)]
        return reduce(DataFrame.unionByName, tops)


def _gathered(nodes: DataFrame, *carried: str) -> DataFrame:
    """Blocks of nodes (key, at, total, node); carried columns become arrays beside them."""
    packed = F.array_sort(F.collect_list(F.struct("at", "node", *carried)))
    blocks = nodes.groupBy("key", F.expr(f"at div {BLOCK}").alias("block"), "total").agg(packed.alias("_p"))
    return blocks.select("key", "block", "total", F.col("_p.node").alias("nodes"), *[F.col(f"_p.{c}").alias(c) for c in carried])


def _grow(blocks: DataFrame, path: str) -> Tree:
    """Write blocks as level 0 and every level above it."""
    spark, k = blocks.sparkSession, 0
    blocks.write.parquet(f"{path}/level=0")
    most = Tree(spark, path, 1).level(0).agg(F.max("total")).first()[0] or 0
    while most > 1:
        runs = F.sequence(F.lit(0), F.ceil(F.size("nodes") / FANOUT).cast("int") - 1)
        parents = F.transform(runs, lambda i: F.sha2(F.array_join(F.slice("nodes", i * FANOUT + 1, FANOUT), "").cast("binary"), 256))
        total = F.expr(f"(total + {FANOUT - 1}) div {FANOUT}")
        up = Tree(spark, path, k + 1).level(k).where("total > 1").select("key", "block", total.alias("total"), parents.alias("nodes"))
        k, most = k + 1, -(-most // FANOUT)
        if k % HEIGHT == 0:
            up = _gathered(up.select("key", F.col("block").alias("at"), "total", F.col("nodes")[0].alias("node")))
        up.write.parquet(f"{path}/level={k}")
    return Tree(spark, path, k + 1)


def _paths(tree: Tree, above: DataFrame) -> DataFrame:
    """A row for each node of level 0, with all that its block carries and all columns of above (by key), and with its path: siblings from the
    node's own run up to those of the root, and above's path after them."""
    over = None
    for start in reversed(range(0, tree.levels, HEIGHT)):
        blocks = tree.bottom() if start == 0 else tree.level(start)
        carried = ["nodes", *[c for c in blocks.columns if c not in _NODES]]
        stack = F.array("nodes")
        higher = range(start + 1, min(start + HEIGHT, tree.levels))
        if higher:
            levels = reduce(DataFrame.unionByName, [tree.level(k).select("key", "block", F.lit(k).alias("level"), "nodes") for k in higher])
            levels = levels.groupBy("key", "block").agg(F.array_sort(F.collect_list(F.struct("level", F.col("nodes").alias("higher")))).alias("_levels"))
            blocks = blocks.join(levels, ["key", "block"], "left")
            stack = F.concat(stack, F.coalesce("_levels.higher", F.array().cast("array<array<string>>")))
        blocks = blocks.join(above, "key")
        if over is not None:
            blocks = blocks.join(over, ["key", "block"], "left").withColumn("path", F.coalesce("_over", "path"))
        # A key that goes on above this tier is hashed at each level; one that ends in it, until a single node is left.
        stack = F.when(F.col("total") > BLOCK, stack).otherwise(F.filter(stack, lambda nodes: F.size(nodes) > 1))
        # The stack is bound by a lambda of its own, or it would be built anew for each node.
        steps = F.transform(F.array(stack), lambda own: F.transform(F.sequence(F.lit(0), F.size("nodes") - 1), lambda i: F.transform(own, lambda nodes, k: _step(nodes, i, k))))[0]
        zipped = F.arrays_zip(*carried, steps.alias("_steps"))
        rest = [c for c in above.columns if c not in ("key", "path")]
        each = blocks.select("key", "block", *rest, F.col("path").alias("_rest"), zipped.alias("_z")).select("key", "block", *rest, "_rest", F.posexplode("_z").alias("_i", "_z"))
        each = each.select("key", (F.col("block") * BLOCK + F.col("_i")).alias("at"), *rest, *[F.col(f"_z.{c}").alias(c) for c in carried], F.concat("_z._steps", "_rest").alias("path"))
        over = each.select("key", F.col("at").alias("block"), F.col("path").alias("_over"))
    return each.withColumnRenamed("nodes", "node")


def _step(nodes: Column, at: Column, k: Column) -> Column:
    """What stands left and right, in its run, of the node over node at of the block's first level, k levels up."""
    powers = F.array(*[F.lit(FANOUT**j) for j in range(HEIGHT)])
    at = F.floor(at / F.element_at(powers, k + 1)).cast("int")
    inside = at % FANOUT
    return F.struct(F.array_join(F.slice(nodes, at - inside + 1, inside), "").alias("left"), F.array_join(F.slice(nodes, at + 2, F.lit(FANOUT - 1) - inside), "").alias("right"))


@dataclass(frozen=True)
class Manifest:
    """sources: the tree of each source over its rows. top: the tree of the subroots. root: None for an empty table."""

    sources: Tree
    top: Tree
    root: str | None

    def proofs(self) -> DataFrame:
        """A row for each row of the table: id, leaf, claimed, subroot, root and path, the siblings from the leaf's run to the root's."""
        spark = self.top.spark
        none = spark.range(1).select(F.lit("").alias("key"), F.array().cast(_PATH).alias("path"))
        above = _paths(self.top, none).select(F.col("source").alias("key"), F.col("node").alias("subroot"), "path")
        return _paths(self.sources, above).select("id", F.col("node").alias("leaf"), "claimed", "subroot", F.lit(self.root).cast("string").alias("root"), "path")


def build(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", claimed: Column | None = None, path: str | None = None) -> Manifest:
    """The manifest of docs, with its node store at path (default: the shared folder), in the folders sources and top.

    fields are the columns that a leaf covers. claimed is a leaf as somebody else gives it (an expression over docs, null for "as it is"), which is
    carried to the proofs to be verified there. Rows of a source are sorted by id, null first; rows that share an id by leaf. Equal rows are leaves of
    their own. A null source is a source, before all others. Empty texts are values (0:), nulls are -. An empty table has empty trees. Other columns,
    whatever their names, are ignored.
    """
    spark, path = docs.sparkSession, path or new_table(docs.sparkSession, "merkle")
    key = F.coalesce(F.concat(F.lit("+"), F.col(source_col).cast("string")), F.lit("")).alias("key")  # a plus, so that an empty source isn't the null one
    leaves = docs.select(key, F.col(id_col).alias("id"), digest(*[F.col(c) for c in fields]).alias("node"), (F.lit(None) if claimed is None else claimed).cast("string").alias("claimed"))
    leaves = durable(leaves.withColumn("tie", F.monotonically_increasing_id()), "merkle-leaves")
    placed = numbered(leaves, "key", "id", "node", "tie", name="merkle-runs").select("key", F.col("_at").alias("at"), F.col("_of").alias("total"), "node", "id", "claimed")
    sources = _grow(_gathered(placed, "id", "claimed"), f"{path}/sources")
    subroots = numbered(sources.roots().select(F.lit("").alias("key"), F.col("key").alias("source"), F.col("root").alias("node")), "key", "source", name="merkle-subroots")
    top = _grow(_gathered(subroots.select("key", F.col("_at").alias("at"), F.col("_of").alias("total"), "node", "source"), "source"), f"{path}/top")
    root = top.roots().first()
    return Manifest(sources, top, root["root"] if root else None)


def verified(proofs: DataFrame) -> DataFrame:
    """proofs with proof_sha256, folded_root (from the claimed leaf where there is one) and verified."""
    proofs = proofs.withColumns({"proof_sha256": path_digest(F.col("path")), "folded_root": fold(F.coalesce("claimed", "leaf"), F.col("path"))})
    return proofs.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_leaf(**instead: str) -> str:
    parts = [f"coalesce(concat(strlen({v}::VARCHAR), ':', {v}::VARCHAR), '-')" for v in (instead.get(c, c) for c in FIELDS)]
    return f"sha256(concat({', '.join(f'CASE WHEN {v} IS NULL THEN {chr(39)}-{chr(39)} ELSE {p} END' for v, p in zip((instead.get(c, c) for c in FIELDS), parts))}))"


#: The query op13 in DuckDB's SQL, which has no crc32: both trees level by level, then each leaf folded up through its siblings.
MANIFEST_SQL = f"""
    WITH RECURSIVE crcs AS (
        SELECT *, replace(text, chr(10), '') AS changed, list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
            lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))) AS inverse
        FROM documents
    ),
    leaves AS (
        SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
               {_sql_leaf()} AS leaf, CASE WHEN inverse & 1 = 1 THEN {_sql_leaf(text="changed")} ELSE {_sql_leaf()} END AS claimed
        FROM crcs
    ),
    tree AS (
        SELECT source, 0 AS k, pos, leaf AS h, n FROM leaves
        UNION ALL
        SELECT source, k + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3) FROM tree WHERE n > 1 GROUP BY source, k, pos // 3
    ),
    subroots AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
    top AS (
        SELECT 0 AS k, pos, subroot AS h, n FROM subroots
        UNION ALL
        SELECT k + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3) FROM top WHERE n > 1 GROUP BY k, pos // 3
    ),
    runs AS (
        SELECT coalesce('+' || source, '') AS key, k, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM tree WHERE n > 1 GROUP BY source, k, pos // 3
        UNION ALL
        SELECT '*', k, pos // 3, list(h ORDER BY pos) FROM top WHERE n > 1 GROUP BY k, pos // 3
    ),
    fold AS (
        SELECT l.doc_id, l.leaf, s.subroot, s.pos AS place, coalesce('+' || l.source, '') AS key, 0 AS k, l.pos, l.claimed AS node, '' AS proof
        FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source
        UNION ALL
        SELECT f.doc_id, f.leaf, f.subroot, f.place, CASE WHEN r.hs IS NULL THEN '*' ELSE f.key END, CASE WHEN r.hs IS NULL THEN 0 ELSE f.k + 1 END,
               CASE WHEN r.hs IS NULL THEN f.place ELSE f.pos // 3 END,
               CASE WHEN r.hs IS NULL THEN f.node ELSE sha256(array_to_string(list_concat(r.hs[1:f.pos % 3], [f.node], r.hs[f.pos % 3 + 2:]), '')) END,
               concat(f.proof, array_to_string(list_concat(r.hs[1:f.pos % 3], r.hs[f.pos % 3 + 2:]), ''))
        FROM fold f LEFT JOIN runs r ON r.key = f.key AND r.k = f.k AND r.run = f.pos // 3
        WHERE r.hs IS NOT NULL OR f.key <> '*'
    )
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified
    FROM fold, (SELECT h AS root FROM top WHERE n = 1) WHERE key = '*' AND k = (SELECT max(k) FROM top)"""
