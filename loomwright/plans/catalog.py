"""The operators on the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, registry, scan, scopes, summaries, verify

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

WORD = "[a-z0-9_]+"
MARKS = ["License", "the and", "@", "TOKEN"]
ALIASES = [("FRANCE", "GAUL"), ("GERMANY", "GERMANIA"), ("CHINA", "CATHAY"), ("JAPAN", "NIPPON"), ("EGYPT", "KEMET")]


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the benchmark, as a dictionary of names."""
    text = F.lower("text")
    return _t(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("name")).distinct()


DICT = "(SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS name FROM benchmark)"
DOC_WORDS = "(SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) AS name FROM documents)"


def _doc_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (doc_id, name) of dictionary words in documents."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0)))
    return scan.hits(_t(spark, sf_dir, "documents"), _dictionary(spark, sf_dir), key="doc_id", found=words)


@query(
    """SELECT page_id, name FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '''[a-z0-9_]+''|"[a-z0-9_]+"|`[a-z0-9_]+`')) AS q FROM pages),
    LATERAL (SELECT substr(q, 2, length(q) - 2) AS name) GROUP BY ALL"""
)
def literal_extract(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.explode(T.literals(F.col("html"))).alias("name"))


@query(f"SELECT doc_id, name FROM {DOC_WORDS} SEMI JOIN {DICT} AS d USING (name)")
def dict_semijoin(spark, sf_dir):
    return _doc_hits(spark, sf_dir)


@query(
    f"""SELECT page_id FROM pages WHERE EXISTS (SELECT 1 FROM (SELECT unnest(regexp_extract_all(html, '''[a-z0-9_]+''|"[a-z0-9_]+"|`[a-z0-9_]+`')) AS q)
    WHERE substr(q, 2, length(q) - 2) IN (SELECT name FROM {DICT}))"""
)
def prefilter_exists(spark, sf_dir):
    return scan.prefiltered(_t(spark, sf_dir, "pages"), _dictionary(spark, sf_dir), key="page_id", code="html").select("page_id")


@query(
    """SELECT doc_id, unnest(list_filter(['License', 'the and', '@', 'TOKEN'], lambda m: contains(coalesce(text, ''), m))) AS mark FROM documents"""
)
def marker_flags(spark, sf_dir):
    return scan.marked(_t(spark, sf_dir, "documents"), MARKS, key="doc_id", code="text").select("doc_id", F.explode("marks").alias("mark"))


@query(f"SELECT doc_id, string_agg(name, ',' ORDER BY name) AS names, count(*) AS cnt FROM {DOC_WORDS} SEMI JOIN {DICT} AS d USING (name) GROUP BY doc_id")
def names_per_doc(spark, sf_dir):
    found = scan.names_by_file(_doc_hits(spark, sf_dir), key="doc_id")
    return found.select("doc_id", F.array_join("names", ",").alias("names"), F.size("names").cast("long").alias("cnt"))


@query(f"SELECT doc_id, count(*) AS cnt FROM {DOC_WORDS} SEMI JOIN {DICT} AS d USING (name) GROUP BY doc_id ORDER BY cnt DESC, doc_id LIMIT 25")
def topk_docs(spark, sf_dir):
    """The flagship: literals, dictionary, names by document, the busiest documents."""
    found = scan.names_by_file(_doc_hits(spark, sf_dir), key="doc_id")
    return scan.top_files(found, 25, key="doc_id").select("doc_id", F.col("cnt").cast("long").alias("cnt"))


@query(
    r"""WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://(.*)$', 1), '[?#].*$', '') AS rel FROM pages)
    SELECT page_id, rel FROM p WHERE NOT regexp_full_match(rel, 'blog\.[^/]*/.*') AND NOT regexp_full_match(rel, '(?:.*/)?es(/.*)?') AND NOT regexp_full_match(rel, '.*[^/]*\.html')"""
)
def glob_exclude(spark, sf_dir):
    rel = F.regexp_replace(F.regexp_extract("url", "^[a-z]+://(.*)$", 1), "[?#].*$", "")
    return _t(spark, sf_dir, "pages").select("page_id", rel.alias("rel")).where(~T.excluded(F.col("rel"), ["blog.*/**", "**/es", "**/*.html"]))


SNAPSHOTS = "old AS (SELECT doc_id, n_chars FROM documents WHERE doc_id % 5 <> 0), new AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 11 <> 0)"


def _snapshots(spark, sf_dir):
    """Two states of a tree: what the cache saw, and what is there now. Both come from all documents."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "n_chars")
    now = d.where("doc_id % 11 <> 0").withColumn("n_chars", F.expr("CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END"))
    return d.where("doc_id % 5 <> 0"), now


@query(f"WITH {SNAPSHOTS} SELECT new.* FROM new SEMI JOIN old USING (doc_id, n_chars)")
def incremental_hits(spark, sf_dir):
    cache, now = _snapshots(spark, sf_dir)
    return scan.unchanged(now, cache, ["doc_id", "n_chars"])


@query(f"WITH {SNAPSHOTS} SELECT new.* FROM new ANTI JOIN old USING (doc_id, n_chars)")
def incremental_misses(spark, sf_dir):
    cache, now = _snapshots(spark, sf_dir)
    return scan.changed(now, cache, ["doc_id", "n_chars"])


@query(f"WITH {SNAPSHOTS} SELECT old.* FROM old SEMI JOIN new USING (doc_id)")
def cache_survivors(spark, sf_dir):
    cache, now = _snapshots(spark, sf_dir)
    return scan.unchanged(cache, now, ["doc_id"])


ALIAS_ROWS = ", ".join(f"('{a}', '{t}')" for a, t in ALIASES)


@query(
    f"""SELECT c_custkey, n_name AS name, coalesce(target, n_name) AS target FROM customer JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN (VALUES {ALIAS_ROWS}) AS a(alias, target) ON n_name = alias"""
)
def alias_resolve(spark, sf_dir):
    customer, nation = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation")
    named = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).select("c_custkey", F.col("n_name").alias("name"))
    return registry.resolve_aliases(named, spark.createDataFrame(ALIASES, "alias string, target string"))


@query(
    """WITH s AS (SELECT source AS variant, text, min(doc_id) AS target FROM documents WHERE lang = 'en' AND text IS NOT NULL GROUP BY ALL)
    SELECT doc_id AS alias, target FROM documents AS d JOIN s ON source = variant AND d.text = s.text WHERE coalesce(lang, '') <> 'en'"""
)
def twin_aliases(spark, sf_dir):
    """Documents of other languages that are twins of an English one of their source: the ones are legacy entries, the others symbols, each of one variant."""
    d = _t(spark, sf_dir, "documents").where("text IS NOT NULL").select("lang", F.col("source").alias("variant"), F.col("doc_id").alias("name"), F.sha2("text", 256).alias("d"), F.lit(None).cast("string").alias("f"))
    return registry.twins(d.where("coalesce(lang, '') <> 'en'"), d.where("lang = 'en'"), 1)


@query(
    """WITH legacy AS (SELECT l_linestatus AS variant, l_orderkey AS name, l_returnflag AS d FROM lineitem),
    f AS (SELECT name, count(DISTINCT variant) AS k, min(d) AS target, max(d) AS other FROM legacy GROUP BY name)
    SELECT name AS alias, target FROM f WHERE k = 1 AND target = other"""
)
def all_equal_targets(spark, sf_dir):
    """Orders of one line status all of whose lines agree: all entries of a name have to lead to one and the same target."""
    entries = lambda name: _t(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("variant"), F.col(name).cast("string").alias("name"), F.col("l_returnflag").alias("d"), F.lit(None).cast("string").alias("f"))
    return registry.twins(entries("l_orderkey"), entries("l_returnflag").distinct(), 1).select(F.col("alias").cast("bigint").alias("alias"), "target")


@query("SELECT user_id, string_agg(DISTINCT event_type, '' ORDER BY event_type) AS shapes FROM events GROUP BY user_id")
def shape_sets(spark, sf_dir):
    return registry.shape_sets(_t(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("SELECT coalesce(sum(length(url)), 0)::BIGINT AS total FROM (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL)")
def registry_bytes(spark, sf_dir):
    """Characters of all distinct urls."""
    return registry.distinct_length(_t(spark, sf_dir, "pages"), "url")


@query(
    """WITH f AS (SELECT source, min(doc_id) AS first FROM documents GROUP BY source), c AS (SELECT source, row_number() OVER (ORDER BY first) - 1 AS code FROM f)
    SELECT doc_id, lang, code FROM documents JOIN c USING (source)"""
)
def dict_encode(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return d.join(registry.first_seen_codes(d, "source", ["doc_id"]), "source").select("doc_id", "lang", "code")


@query("SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS at FROM documents")
def ordered_numbers(spark, sf_dir):
    return registry.numbered(_t(spark, sf_dir, "documents").select("doc_id", "source"), ["source", "doc_id"], "at").select("doc_id", "at")


@query(
    r"""WITH f AS (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://(.*)$', 1), '[?#].*$', ''), '/$', '') AS path FROM pages),
    i AS (SELECT page_id, 'example.org/' || string_split(path, '/')[-2] || '/' || string_split(path, '/')[-1] AS source FROM f)
    SELECT i.page_id, f.page_id AS target FROM i JOIN f ON ends_with('/' || regexp_replace(f.path, '\.[cm]?[jt]sx?$', ''), '/' || regexp_replace(source, '^example\.org/', ''))"""
)
def import_suffix_join(spark, sf_dir):
    """Every page imports by the last two parts of its path; which pages does that name?"""
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract("url", "^[a-z]+://(.*)$", 1), "[?#].*$", ""), "/$", "")
    f = _t(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    parts = F.split("path", "/")
    i = f.select(F.col("page_id"), F.lit("").alias("path"), F.concat(F.lit("@example/"), F.array_join(F.slice(parts, -2, 2), "/")).alias("source"))
    found = graph.resolve_imports(i, f)
    return found.join(f.select(F.col("path").alias("resolved"), F.col("page_id").alias("target")), "resolved").select("page_id", "target")


HREFS = """h AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)"""


def _page_links(spark, sf_dir):
    """(src, dst): pages to their link targets and back."""
    h = _t(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("page"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("href"))
    return h.select(F.col("page").alias("src"), F.col("href").alias("dst")).union(h.select("href", "page"))


@query(
    f"""WITH RECURSIVE {HREFS}, e AS (SELECT page_id::VARCHAR AS src, href AS dst FROM h UNION SELECT href, page_id::VARCHAR FROM h),
    r AS (SELECT '0' AS node UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r"""
)
def fixpoint_reach(spark, sf_dir):
    edges = graph.written(_page_links(spark, sf_dir), "edges")
    return graph.reach(edges, spark.createDataFrame([("0",)], "node string"))


@query(
    f"""WITH {HREFS}, k AS (SELECT DISTINCT page_id FROM h) SELECT page_id::VARCHAR AS node, page_id::VARCHAR AS near FROM k UNION SELECT page_id::VARCHAR, href FROM h"""
)
def fallback_neighbors(spark, sf_dir):
    edges = _page_links(spark, sf_dir).where(F.col("dst").startswith("/"))
    return graph.with_neighbours(edges.select(F.col("src").alias("node")).distinct(), edges)


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_missing(spark, sf_dir):
    return verify.missing(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE lang = 'en'")
def set_unexpected(spark, sf_dir):
    return verify.unexpected(_t(spark, sf_dir, "documents").where("lang = 'en'"), _t(spark, sf_dir, "labels"), "doc_id")


@query("SELECT d.doc_id AS text_id, b.item_id AS part_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def contains_selfjoin(spark, sf_dir):
    texts = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return graph.contained(texts, _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("part_id"), F.col("text").alias("part")))


@query("SELECT count(*)::VARCHAR || ':' || sha1(string_agg(p_type || chr(0), '' ORDER BY p_type)) AS fingerprint FROM (SELECT DISTINCT p_type FROM part)")
def fingerprint(spark, sf_dir):
    return scan.fingerprint(_t(spark, sf_dir, "part"), "p_type")


@query(
    """SELECT event_type, min(value) AS least, max(CASE WHEN r = n // 2 + 1 THEN value END) AS median FROM
    (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY event_type"""
)
def bench_median(spark, sf_dir):
    return scan.upper_median(_t(spark, sf_dir, "events"), ["event_type"], "value")


@query("SELECT DISTINCT user_id, event_type FROM events")
def dedupe_diag(spark, sf_dir):
    return verify.distinct_messages(_t(spark, sf_dir, "events"), ["user_id", "event_type"])


@query("SELECT c_custkey FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') AS o ON c_custkey = o_custkey")
def zero_calls(spark, sf_dir):
    calls = _t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return verify.without_calls(_t(spark, sf_dir, "customer").select("c_custkey"), calls, "c_custkey")


@query(
    """SELECT a.vec_id AS a, b.vec_id AS b, round(100.0 * list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END)) / len(a.embedding), 6) AS pct,
    CASE WHEN 100.0 * list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END)) / len(a.embedding) >= 40 THEN 'DIFF' ELSE 'ok' END AS status
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
)
def sign_diff_pct(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x > 0).alias("bits"))
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("bits").alias("other"))
    pct = verify.diff_percent(F.col("bits"), F.col("other"))
    return e.join(other, "vec_id").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), F.round(pct, 6).alias("pct"), verify.status(pct, 40).alias("status"))


@query(
    """SELECT a.vec_id AS a, round(list_max(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))), 6) AS shift
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
)
def max_shift(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(other, "vec_id").select(F.col("vec_id").alias("a"), F.round(verify.max_shift(F.col("v"), F.col("w")), 6).alias("shift"))


@query("SELECT user_id, unnest(CASE WHEN event_type = 'view' THEN ['rounded', 'outlined', 'sharp'] ELSE [event_type] END) AS variant, event_id FROM events")
def variant_expand(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_type") == "view", "*").otherwise(F.col("event_type")).alias("variant"))
    return registry.expand_variants(e, ["rounded", "outlined", "sharp"]).select("user_id", "variant", "event_id")


@query(
    """WITH u AS (SELECT DISTINCT event_type AS variant, user_id AS name, CASE WHEN value > 0 THEN 'd' ELSE 'f' END AS shape FROM events),
    i AS (SELECT DISTINCT event_type AS variant, user_id AS name, (user_id % 50)::VARCHAR || event_type AS d FROM events), c AS (SELECT u.*, d AS path FROM u JOIN i USING (variant, name)),
    e AS (SELECT variant, name, max(CASE WHEN shape = 'd' THEN path END) AS d, max(CASE WHEN shape = 'f' THEN path END) AS f FROM c GROUP BY ALL)
    SELECT count(*) AS icons, count(d) AS d_shapes, count(f) AS f_shapes, count(CASE WHEN d = f THEN 1 END) AS shared, (SELECT sum(length(path))::BIGINT FROM (SELECT DISTINCT path FROM c)) AS path_chars FROM e"""
)
def registry_stats(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("event_type").alias("variant"), F.col("user_id").alias("name"), F.when(F.col("value") > 0, "d").otherwise("f").alias("shape"))
    icons = e.select("variant", "name", F.concat((F.col("name") % 50).cast("string"), "variant").alias("d"), F.lit(None).cast("string").alias("f")).distinct()
    return registry.stats(registry.selected(e, icons))


@query(
    """SELECT name, path FROM (SELECT DISTINCT p_brand AS name, p_type AS path FROM part) o
    WHERE name IN ('Brand#11', 'Brand#12', 'Brand#21') OR NOT EXISTS (SELECT 1 FROM part q WHERE q.p_type = o.path AND q.p_brand IN ('Brand#11', 'Brand#12', 'Brand#21'))"""
)
def path_owners(spark, sf_dir):
    paths = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("path"))
    expected = spark.createDataFrame([("Brand#11",), ("Brand#12",), ("Brand#21",)], "name string")
    return verify.owners(paths, paths, expected)


@query(
    f"""SELECT count(*) AS names, count(*) > 200 AS leaked FROM (SELECT DISTINCT name FROM {DOC_WORDS} SEMI JOIN {DICT} AS d USING (name))"""
)
def name_leak(spark, sf_dir):
    return verify.leaked(_doc_hits(spark, sf_dir), _dictionary(spark, sf_dir))


@query(
    """SELECT n_nationkey, n_regionkey, floor((n_nationkey - 12.5) / 4 + 0.5) AS snapped FROM nation"""
)
def half_up(spark, sf_dir):
    return _t(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", T.round_half_up((F.col("n_nationkey") - 12.5) / 4).alias("snapped"))


@query("SELECT count(*) AS files, count(DISTINCT text) AS texts, count(CASE WHEN text IS NULL THEN 1 END) AS unreadable FROM documents")
def file_counts(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content"))
    g = d.groupBy("content").agg(F.count(F.lit(1)).alias("n"))
    unreadable = F.coalesce(F.sum(F.when(F.col("content").isNull(), F.col("n"))), F.lit(0))
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.count("content").alias("texts"), unreadable.alias("unreadable"))


@query("SELECT path, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM (SELECT p_partkey AS path, p_type AS name FROM part UNION ALL SELECT p_partkey, p_brand FROM part) GROUP BY path")
def merge_extractors(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    parts = [p.select(F.col("p_partkey").alias("path"), F.array(c).alias("names")) for c in ("p_type", "p_brand")]
    return scan.merged(parts).select("path", F.array_join("names", ",").alias("names"))


COMMENT_SQL = f"({T.NO_COMMENT})|{T.BLOCK_COMMENT}|{T.LINE_COMMENT}".replace("'", "''").replace("*+", "*")
NAME_SQL = T.QUOTED_NAME.replace("'", "''")
STRING_SQL = verify.TOKEN.replace("'", "''").replace("*+", "*")


@query(
    f"""SELECT DISTINCT page_id, substr(q, 2, length(q) - 2) AS name FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '{COMMENT_SQL}', '\\1', 'g'), '{NAME_SQL}')) AS q FROM pages)"""
)
def value_literals(spark, sf_dir):
    """Quoted names outside comments."""
    return _t(spark, sf_dir, "pages").select("page_id", F.explode(T.literals(T.without_comments(F.col("html")))).alias("name"))


@query(f"SELECT page_id, substr(q, 2, length(q) - 2) AS content FROM (SELECT page_id, unnest(regexp_extract_all(html, '{STRING_SQL}')) AS q FROM pages)")
def quoted_strings(spark, sf_dir):
    """The contents of all quoted strings of pages."""
    return _t(spark, sf_dir, "pages").select("page_id", F.explode(verify.quoted_strings(F.col("html"))).alias("content"))


#: Forms of code, by the part's key: B, T and N stand for names of its brand, type and name. Listed with those that stand where values do.
PROGRAMS = (
    ("type Kind = 'B' | 'T'\nasync function go() { return 'N' }\n", "N"),
    ("interface P { kind: 'T'; on?: (x: 'B') => void }\nconst f = (a: 'T', b = 'B'): 'T' => x ? 'N' : y\n", "BN"),
    ("class A extends Q<'T'> {\n  kind: 'T' = 'B'\n  m(k: 'B'): 'N' { return use<'T'>(cond ? 'N' : z) }\n}\n", "BN"),
    ("const o = { kind: 'B', t: `T`, n: [x as 'N'] } // 'N'\n", "BT"),
    ("import a from 'B'\nexport const V = () => <View>Kind: {on ? 'T' : `x_${'N'}`}</View>\n", "TN"),
    ("switch (k) { case 'B': go('T'); default: let v: 'N'\n}\n", "BT"),
    ("'B'\ntype F<X = 'T'> = X extends 'B' ? 'T' : 'N'\nregister('N')", "N"),
)


def _program_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT {i} AS form, unnest([{', '.join(dict(B='b', T='t', N='n')[x] for x in used)}]) AS name, p_partkey FROM p WHERE p_partkey % {len(PROGRAMS)} = {i}" for i, (_, used) in enumerate(PROGRAMS))
    named = lambda c, mark: f"'{mark}_' || regexp_replace(lower({c}), '[^a-z0-9]+', '_', 'g')"
    return f"WITH p AS (SELECT p_partkey, {named('p_brand', 'b')} AS b, {named('p_type', 't')} AS t, {named('p_name', 'n')} AS n FROM part) SELECT DISTINCT p_partkey, name FROM ({rows})"


@query(_program_sql())
def value_positions(spark, sf_dir):
    """Names in value positions of a program for each part, of types, classes, tags and code without semicolons."""
    named = lambda c, mark: F.concat(F.lit(f"{mark}_"), F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"))
    part = scan.dealt(_t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name"), "p_partkey")
    code = F.element_at(F.array(*[F.lit(form) for form, _ in PROGRAMS]), (F.col("p_partkey") % len(PROGRAMS) + 1).cast("int"))
    for mark, c in (("B", "p_brand"), ("T", "p_type"), ("N", "p_name")):
        code = F.regexp_replace(code, F.lit(f"(?<=['`]){mark}(?=['`])"), named(c, mark.lower()))
    return part.select("p_partkey", F.explode(T.value_literals(code, F.lit("program.tsx"))).alias("name"))


@query(
    """SELECT l_orderkey, l_linenumber, o_orderkey FROM (
        SELECT l_orderkey, l_linenumber, w.o_orderkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate ORDER BY w.o_orderdate DESC, w.o_orderkey) AS k
        FROM lineitem JOIN orders o ON l_orderkey = o.o_orderkey JOIN orders w ON w.o_custkey = o.o_custkey AND w.o_orderdate::DATE < l_shipdate::DATE AND l_shipdate::DATE < w.o_orderdate::DATE + 90
    ) WHERE k = 1"""
)
def innermost_scope(spark, sf_dir):
    """For each item, the customer's latest order that was open (under 90 days old) when it was shipped: the innermost of the intervals around a point."""
    orders = _t(spark, sf_dir, "orders")
    days = lambda c: F.unix_date(F.col(c).cast("date"))
    points = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", days("l_shipdate").alias("at"))
    points = points.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    spans = orders.select("o_custkey", "o_orderkey", days("o_orderdate").alias("start"), (days("o_orderdate") + 90).alias("end"))
    return scopes.innermost(points, spans, ["o_custkey"], first="o_orderkey").select("l_orderkey", "l_linenumber", "o_orderkey")


@query(
    """SELECT DISTINCT 'r' || r_regionkey AS origin, s_name AS name, r_name || '_' || n_name AS variant
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
)
def composed_calls(spark, sf_dir):
    """Regions as components, nations as wrappers that pass a name on and put their own into a text, suppliers as call sites: what is rendered in the end."""
    region, nation, supplier = (_t(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    atom = lambda attr, kind, value: F.struct(F.lit(attr).alias("attr"), F.lit(kind).alias("kind"), value.alias("value"), F.lit("").alias("steps"))
    key = lambda mark, c: F.concat(F.lit(mark), F.col(c))
    text = F.concat("r_name", F.lit("_"), summaries.hole(F.lit("kind"), F.lit("")))
    rows = region.select(key("r", "r_regionkey").alias("owner"), key("r", "r_regionkey").alias("origin"), F.array(atom("name", "prop", F.lit("mark")), atom("variant", "part", text)).alias("atoms"))
    calls = nation.select(key("cn", "n_nationkey").alias("call"), key("n", "n_nationkey").alias("owner"), key("r", "n_regionkey").alias("target"))
    calls = calls.unionByName(supplier.select(key("cs", "s_suppkey").alias("call"), F.lit(None).cast("string").alias("owner"), key("n", "s_nationkey").alias("target")))
    given = lambda prop, said: (F.lit(prop).alias("prop"), F.lit("").alias("steps"), F.array(said).alias("said"))
    answers = nation.select(key("cn", "n_nationkey").alias("call"), *given("mark", summaries.atom("prop", F.lit("sign"))))
    answers = answers.unionByName(nation.select(key("cn", "n_nationkey").alias("call"), *given("kind", summaries.atom("str", F.col("n_name")))))
    answers = answers.unionByName(supplier.select(key("cs", "s_suppkey").alias("call"), *given("sign", summaries.atom("str", F.col("s_name")))))
    ends = summaries.compose(rows, calls, answers).where("owner IS NULL")
    value = lambda attr: F.filter("atoms", lambda a: a["attr"] == attr)[0]["value"].alias(attr)
    return ends.select("origin", value("name"), value("variant"))
