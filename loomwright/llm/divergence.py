"""How far the sources of a language differ from one another, and by which terms.

Terms are counted once over all texts, combined in each task before anything is shuffled. Each language keeps the terms that enough of its
documents have, numbers them by sorted ranges, and cuts them into chunks of CHUNK. The counts of a (language, source) group become one
packed vector a chunk.

All pairs of groups are compared by tiles: groups are numbered within their language and cut into blocks of BLOCK; a tile is a
pair of blocks, and each packed vector is copied to the tiles of its block. A task has a tile, and of it a stripe of chunks,
which it takes one after another: only two blocks' vectors of one chunk are ever in memory, as an array, and the
sums of the tile's pairs are added up from its chunks. Terms that no group of a tile has in a chunk need no
column: their value is the same for all of them.

Arithmetic is in whole numbers throughout: p = 1 + floor(SCALE * (count + 1) / (N + V)), where N is the sum of a group's counts over the V kept terms
of its language, and the divergence of p from q at a term is floor((p - q)^2 / q).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, numbered

SCALE = 1_000_000_000
#: Kept terms in one packed vector, at most.
CHUNK = 16_384
#: Chunks that one task takes one after another.
STRIPE = 16
#: Groups in one block.
BLOCK = 16
#: Entries of a task's counts before they are handed on.
HELD = 500_000
_LONG = 4_000_000

#: A byte of a term as it is, A-Z lower-cased; of anything else a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_CUT = re.compile(rb" ")


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII; only A-Z are lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _pieces(text: str | None) -> Iterator[list[bytes]]:
    """terms_of a text, of a very long one in parts that end between terms, so that memory doesn't grow by the number of its terms."""
    if len(text or "") <= _LONG:
        yield terms_of(text)
        return
    folded, start = text.encode("utf-8", "surrogatepass").translate(_FOLD), 0
    while start < len(folded):
        cut = _CUT.search(folded, min(start + _LONG, len(folded)))
        end = cut.start() if cut else len(folded)
        yield folded[start:end].split()
        start = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, term, n, docs), combined over what a task reads. Every group has a row with an empty term. Terms stay bytes
    until Arrow takes them."""
    n, docs, seen = {}, {}, 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in n.items():
            of_term, size = docs[lang, source], len(counts)
            columns = [pa.repeat(lang, size), pa.repeat(source, size), pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64()), pa.array(map(of_term.__getitem__, counts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            group = (lang, source)
            if group not in n:
                n[group], docs[group] = Counter({b"": 0}), Counter()
            counts, before = n[group], len(n[group])
            distinct = set()
            for terms in _pieces(text):
                counts.update(terms)
                distinct.update(terms)
            docs[group].update(distinct)
            seen += len(counts) - before + 1
            if seen > HELD:
                yield from out()
                n, docs, seen = {}, {}, 0
    yield from out()


def _p(count: str, total: str, kept: str) -> Column:
    """p in exact decimals: counts may pass 2^63 / SCALE."""
    return F.expr(f"1 + (cast({count} + 1 as decimal(19, 0)) * {SCALE}) div cast({total} + {kept} as decimal(19, 0))").cast("long")


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _shares(counts: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + 1) / mass), by long division in base 1000, so that nothing overflows. mass: N + V, below 9e15."""
    digits, rest = np.divmod(counts + 1, mass)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, mass)
        digits = digits * 1000 + more
    return digits + 1


def tile(rows: pd.DataFrame) -> pd.DataFrame:
    """The divergence of every ordered pair of a tile's groups, summed over the terms of one chunk. rows: two blocks' groups (one block's, on the diagonal) with
    no (number), mass, at (places of their terms in the chunk) and n (their counts); width: terms of the chunk."""
    a, b, width = int(rows["a"].iloc[0]), int(rows["b"].iloc[0]), int(rows["width"].iloc[0])
    places, own = np.unique(np.concatenate([np.asarray(x, np.int64) for x in rows["places"]]), return_inverse=True)
    counts = np.zeros((len(rows), len(places) + 1), np.int64)  # the last column stands for all terms that no group has
    ends = np.cumsum([len(x) for x in rows["places"]])
    for i, (end, n) in enumerate(zip(ends, rows["counts"])):
        counts[i, own[end - len(n) : end]] = n
    mass = rows["mass"].to_numpy(np.int64)[:, None]
    # Without kept terms there is no column at all, and no mass to divide by.
    p = _shares(counts, np.maximum(mass, 1))
    no, block = rows["no"].to_numpy(np.int64), rows["block"].to_numpy(np.int64)
    found = []
    for i in range(len(rows)):
        others = np.flatnonzero((block != block[i]) if a != b else (no != no[i]))
        d = p[i] - p[others]
        f = d * d // p[others]
        found.append(pd.DataFrame({"no": no[i], "other": no[others], "value": f[:, :-1].sum(axis=1) + f[:, -1] * (width - len(places))}))
    out = pd.concat(found)
    out.insert(0, "lang", rows["lang"].iloc[0])
    return out


def audit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 3, top_terms: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: for each group, every other source of its language by divergence (part "pair"), and the top_terms
    terms that it has more of than its language, by what they add (part "term").

    A language keeps the terms that at least least_docs of its rows have. Null texts, languages and sources count as ''. Repeated rows count
    again. Groups without terms are groups; a language without kept terms has pairs of value 0, and one with a single source no pairs.
    Equal values are ranked by item, as UTF-8 bytes. An empty table gives an empty result. Other columns,
    whatever their names, are ignored.
    """
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = own.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    counts = durable(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")

    # Terms of a language, numbered; N and V of groups and languages.
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    terms = durable(numbered(kept.select("lang", "term", "lang_n"), "lang", "term", name="terms").withColumnsRenamed({"_at": "at", "_of": "v"}), "kept-terms")
    langs = terms.groupBy("lang").agg(F.max("v").alias("v"), F.sum("lang_n").alias("lang_total"))
    held = durable(counts.where("term <> ''").select("lang", "source", "term", "n").join(terms, ["lang", "term"]), "group-terms")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "v", "lang_total"])
    groups = durable(numbered(groups, "lang", "source", name="groups").withColumnsRenamed({"_at": "no", "_of": "groups"}).withColumn("block", F.expr(f"no div {BLOCK}")), "groups")

    return _pairs(held, groups).unionByName(_terms(held, groups, top_terms))


def _terms(held: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("term"))
    rows = held.drop("v").join(groups.select("lang", "source", "total", "lang_total", "v"), ["lang", "source"])
    rows = rows.withColumns({"p": _p("n", "total", "v"), "q": _p("lang_n", "lang_total", "v")}).where("p > q").withColumn("value", _f("p", "q"))
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _pairs(held: DataFrame, groups: DataFrame) -> DataFrame:
    packed = held.select("lang", "source", F.expr(f"at div {CHUNK}").alias("chunk"), F.struct(F.expr(f"cast(at % {CHUNK} as int)").alias("at"), "n").alias("x"))
    packed = packed.groupBy("lang", "source", "chunk").agg(F.array_sort(F.collect_list("x")).alias("x")).select("lang", "source", "chunk", F.col("x.at").alias("places"), F.col("x.n").alias("counts"))
    # A group that has no term of a chunk takes part in it all the same: the others' terms count against its zeros.
    last = F.greatest(F.expr(f"(v - 1) div {CHUNK}"), F.lit(0).cast("long"))
    width = F.least(F.col("v") - F.col("chunk") * CHUNK, F.lit(CHUNK))
    every = groups.where("groups > 1").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last))).join(packed, ["lang", "source", "chunk"], "left")
    blocks = F.expr(f"(groups - 1) div {BLOCK}")
    vectors = every.select(
        "lang", "no", "block", "chunk", width.alias("width"), (F.col("total") + F.col("v")).alias("mass"),
        F.coalesce("places", F.array().cast("array<int>")).alias("places"), F.coalesce("counts", F.array().cast("array<bigint>")).alias("counts"),
        F.explode(F.sequence(F.lit(0).cast("long"), blocks)).alias("peer"),
    )
    tiles = vectors.withColumns({"a": F.least("block", "peer"), "b": F.greatest("block", "peer"), "stripe": F.expr(f"chunk div {STRIPE}")}).drop("peer").repartition("lang", "a", "b", "stripe")
    sums = tiles.groupBy("lang", "a", "b", "stripe", "chunk").applyInPandas(tile, "lang string, no long, other long, value long").groupBy("lang", "no", "other").agg(F.sum("value").alias("value"))
    own = groups.select("lang", "no", "source")
    named = sums.join(own, ["lang", "no"]).join(own.select("lang", F.col("no").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    return named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))


#: The query op12 in DuckDB's SQL.
AUDIT_SQL = rf"""
    WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    occurs AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS n FROM occurs GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
    langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
    held AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM occurs o JOIN kept k ON o.lang = k.lang AND o.term = k.term GROUP BY ALL),
    totals AS (SELECT lang, source, sum(n) AS total FROM held GROUP BY ALL),
    groups AS (SELECT DISTINCT d.lang, d.source, coalesce(t.total, 0) AS total FROM d LEFT JOIN totals t ON d.lang = t.lang AND d.source = t.source),
    every AS (
        SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n, (1 + {SCALE}::HUGEINT * (coalesce(h.n, 0) + 1) // (g.total + l.v)) AS p,
               (1 + {SCALE}::HUGEINT * (k.n + 1) // (l.total + l.v)) AS lang_p
        FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term
    ),
    sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM every a JOIN every b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    ),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - lang_p) * (p - lang_p) // lang_p AS value FROM every WHERE n > 0 AND p > lang_p),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""
