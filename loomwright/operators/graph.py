"""Links between files: import specifiers to files, reachability to a fixed point, neighbours, containment."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Endings that a relative import may leave out, in the order in which they are tried.
ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
EXTENSION = r"\.[cm]?[jt]sx?\z"


def shared_tables(spark: SparkSession) -> str:
    """The folder of this application's tables between steps, below the one that the cluster shares (spark.checkpoint.dir). Where that is unset, a temporary folder of
    this machine does for a local master; on a cluster it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: tables between steps need a folder that driver and executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="loomwright-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/tables/{spark.sparkContext.applicationId}"


def drop_tables(spark: SparkSession) -> None:
    """Remove all tables between steps of this application. For when its results have been written: what is not computed yet still reads them."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_tables(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, so that lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_tables(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def normal_path(c: Column) -> Column:
    """A path without '.', '..' and empty parts."""
    parts = F.filter(F.split(c, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(p == "..", acc).otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(kept, "/")


def suffixes(path: Column) -> Column:
    """All trailing parts of a path: c, b/c and a/b/c of a/b/c."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (path, source, ...) with resolved: a relative source is the first existing of its endings; any other is each file whose path, without
    extension, ends in it (or in it and /index), after a leading alias mark is taken off. Sources that nothing resolves are left out.

    Both are equi-joins: candidates are made for the first, suffixes of known files for the second.
    """
    known = files.select(F.col("path").alias("resolved")).distinct()
    relative = imports.where(F.col("source").startswith("."))
    folder = F.regexp_replace("path", r"[^/]*\z", "")
    tried = relative.withColumn("_base", normal_path(F.concat(folder, F.col("source")))).select("*", F.posexplode(F.array(*[F.lit(e) for e in ENDINGS])).alias("_at", "_ending"))
    tried = tried.withColumn("resolved", F.concat("_base", "_ending")).join(known, "resolved")
    first = tried.groupBy(*imports.columns).agg(F.min_by("resolved", "_at").alias("resolved"))
    bare = F.regexp_replace(known["resolved"], EXTENSION, "")
    by_suffix = known.select("resolved", F.explode(suffixes(bare)).alias("_suffix"))
    others = imports.where(~F.col("source").startswith(".")).withColumn("_rest", F.regexp_replace("source", r"\A(?:[@~#]/|@[^/]+/)", ""))
    others = others.withColumn("_suffix", F.explode(F.array("_rest", F.concat("_rest", F.lit("/index")))))
    return first.unionByName(others.join(by_suffix, "_suffix").select(*imports.columns, "resolved").distinct())


def reach(edges: DataFrame, seeds: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node) reachable from seeds along edges (src, dst), seeds included; set semantics, until a round adds nothing.

    Only what the last round added is joined with the edges, and each round's result is a written table.
    """
    found = written(seeds.select("node").distinct(), "reached")
    front = found
    for _ in range(max_rounds):
        new = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        front = written(new.join(found, "node", "left_anti"), "front")
        if front.isEmpty():
            return found
        found = found.unionByName(front)
    raise RuntimeError(f"still growing after {max_rounds} rounds")


def with_neighbours(keys: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, near): each node with itself and what it links to."""
    own = keys.select("node", F.col("node").alias("near"))
    linked = keys.join(edges, keys["node"] == edges["src"]).select("node", F.col("dst").alias("near"))
    return own.union(linked).distinct()


def _run_hashes(words: Column, n: int) -> Column:
    """Hashes of all runs of n words."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, F.lit(n))))


def contained(texts: DataFrame, parts: DataFrame, *, words: int = 4) -> DataFrame:
    """(text_id, part_id) where the text contains the part. texts: (text_id, text); parts: (part_id, part).

    Instead of comparing all with all, each part is looked up by its inner words, which a text that contains it has
    too, white space before each word being whatever it is; contains() then decides. The edge words are skipped, as they may be parts of longer
    words in the text. A part of one or two words has no inner ones: words of the texts that contain its longer word are found
    among the distinct words, by their pieces of that length. Only parts without any word are compared with every text.
    """
    token = r"\S+"
    part_words = parts.withColumn("_w", F.regexp_extract_all("part", F.lit(token), F.lit(0)))
    part_words = written(part_words.withColumn("_k", F.slice("_w", 2, F.greatest(F.least(F.size("_w") - 2, F.lit(words)), F.lit(0)))), "parts")
    keyed = part_words.where(F.size("_k") > 0).select("part_id", "part", F.xxhash64("_k").alias("_key"), F.size("_k").alias("_n"))
    lengths = sorted(r["_n"] for r in keyed.select("_n").distinct().collect())  # at most `words` different numbers
    text_words = texts.withColumn("_w", F.regexp_extract_all("text", F.lit(token), F.lit(0)))
    found = []
    if lengths:
        runs = F.array_distinct(F.concat(*[_run_hashes(F.col("_w"), n) for n in lengths]))
        at = text_words.select("text_id", F.explode(runs).alias("_key")).join(keyed.select("_key").distinct(), "_key", "left_semi")
        found.append(at.join(keyed, "_key").select("text_id", "part_id", "part"))
    short = part_words.where((F.size("_k") == 0) & (F.size("_w") > 0)).select("part_id", "part", F.when(F.char_length(F.get("_w", F.lit(1))) > F.char_length(F.get("_w", F.lit(0))), F.get("_w", F.lit(1))).otherwise(F.get("_w", F.lit(0))).alias("_piece"))
    sizes = sorted(r["n"] for r in short.select(F.char_length("_piece").alias("n")).distinct().collect())  # lengths of words
    if sizes:
        of_text = text_words.select("text_id", F.explode(F.array_distinct("_w")).alias("_word"))
        pieces = lambda n: F.when(F.char_length("_word") >= n, F.transform(F.sequence(F.lit(1), F.char_length("_word") - n + 1), lambda i: F.substring("_word", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
        vocabulary = of_text.select("_word").distinct().select("_word", F.explode(F.array_distinct(F.concat(*map(pieces, sizes)))).alias("_piece"))
        found.append(of_text.join(vocabulary.join(short, "_piece"), "_word").select("text_id", "part_id", "part").distinct())
    blank = part_words.where(F.size("_w") == 0).select("part_id", "part")
    if not blank.isEmpty():
        found.append(texts.join(blank, F.contains("text", F.col("part"))).select("text_id", "part_id", "part"))
    if not found:
        return texts.select("text_id").join(parts.select("part_id")).limit(0)
    pairs = reduce(DataFrame.union, found).distinct()
    return pairs.join(texts.select("text_id", "text"), "text_id").where(F.contains("text", F.col("part"))).select("text_id", "part_id").distinct()
