"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling.

1. Documents fall into cells of source x language x topic. One aggregation, combined before its shuffle,
   gives tokens per cell; a hot source is a few rows by then. Every observed category is raked.
2. Targets are given or are the corpus' own shares to the power temperature (flatter when below 1), scaled to
   sum to 1. The sample has fraction of all tokens. A tempered category that is asked for more tokens than it has gives
   all of them, and the others of its dimension share what is left in proportion. Given targets are met as
   they are: where a category has too few tokens for them, the sample shrinks.
3. Raking: in turn for each dimension, probabilities of cells are multiplied by target / marginal. If one passes 1 after that,
   bounded raking goes on: cells over 1 count as 1, and the others carry what is left of the target,
   until the marginals meet the targets or no longer come nearer (cells of several dimensions can exclude each other).
4. The draw is a hash of the id: repeatable on any cluster, after any retry.

Few cells are one partition, where windows are sorts without an exchange. Many are a distributed table, with marginals by
aggregations that combine before their shuffle; the arithmetic is the same.

Nothing but DataFrame expressions is used.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, own_name

log = logging.getLogger(__name__)
OTHER = "(other)"
DIMS = ("source", "lang", "topic")
OWN = ("topic_", "n_tokens", "probability", "sampled")
#: Up to so many cells are raked in one partition and broadcast to documents.
FEW_CELLS = 50_000
#: Bounded raking ends when less than this share of the sample is not where the targets are.
CALIBRATED = 1e-6
WORD = r"[^\x20\x09-\x0D]+"
#: What speaks for a topic: marks that are counted as they stand.
TOPICS: dict[str, tuple[str, ...]] = {"legal": ("icense", "opyright"), "contact": ("@", "://"), "table": (" | ",), "code": ("{", "=>"), "noise": ("**", "##", "!!")}
PLAIN = "prose"
#: A topic needs so many marks for a hundred words.
DENSITY = 1.0


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def n_marks(text: Column, marks: Sequence[str]) -> Column:
    """How often any of the marks stands in a text, by the bytes that go when it is taken out."""
    gone = lambda m: (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(m), F.lit("")))) / len(m.encode())
    return sum(map(gone, marks[1:]), gone(marks[0])).cast("long")


def topic_of(text: Column, topics: Mapping[str, Sequence[str]] = TOPICS, density: float = DENSITY) -> Column:
    """The topic whose marks stand in the text most often; PLAIN where none has density marks for a hundred words.

    Of equals the first in the order of topics. A null text has no marks.
    """
    t = F.coalesce(text, F.lit(""))
    any_mark = reduce(Column.__or__, [F.contains(t, F.lit(m)) for marks in topics.values() for m in marks])  # texts without any mark need no counts
    names = F.array(*map(F.lit, topics))
    counted = F.array(F.struct(F.array(*[n_marks(t, marks) for marks in topics.values()]).alias("hits"), n_words(text).alias("n")))  # each count once
    densest = F.transform(counted, lambda x: F.when((F.array_max(x["hits"]) > 0) & (F.array_max(x["hits"]) * 100 >= x["n"] * density), F.get(names, F.array_position(x["hits"], F.array_max(x["hits"])).cast("int") - 1)).otherwise(F.lit(PLAIN)))[0]
    return F.when(any_mark, densest).otherwise(F.lit(PLAIN))


def uniform(id_: Column, seed: str) -> Column:
    """A number in [0, 1) by the first 48 bits of md5(seed:id). A null id draws as the text 'null'."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_.cast("string"), F.lit("null"))).cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def _filled(categories: DataFrame, size: float) -> DataFrame:
    """categories (category, n, share) with goal: share of size tokens, but n at most; what those leave goes to the others in proportion."""
    scale, short = 1.0, 0
    while True:
        over = F.col("share") * F.lit(scale * size) >= F.col("n")
        r = categories.agg(F.count(F.when(over, 1)).alias("k"), F.sum(F.when(over, F.col("n"))).alias("taken"), F.sum(F.when(~over, F.col("share"))).alias("free")).first()
        if r["k"] == short or not r["free"]:
            return categories.withColumn("goal", F.least(F.col("n").cast("double"), F.col("share") * F.lit(scale * size)) if r["free"] else F.col("n").cast("double"))
        short, scale = r["k"], (size - r["taken"]) / (size * r["free"])


def _step(w: DataFrame, d: str, bounded: bool, few: bool) -> DataFrame:
    """w with p multiplied by goal / marginal of each category of d. Bounded: a cell whose p is 1 or more counts as 1, and the others carry the rest."""
    n, p, goal = F.col("tokens"), F.col("p"), F.col(f"t_{d}")
    sums = {"_all": F.sum(n * p)} | ({"_full": F.sum(F.when(p >= 1, n).otherwise(0)), "_free": F.sum(F.when(p < 1, n * p).otherwise(0.0))} if bounded else {})
    if few:
        w = w.withColumns({k: x.over(Window.partitionBy(d)) for k, x in sums.items()})
    else:
        w = w.join(w.groupBy(d).agg(*[x.alias(k) for k, x in sums.items()]), d)
    f = F.when(F.col("_all") > 0, F.try_divide(goal, F.col("_all"))).otherwise(0.0)
    if bounded:
        full, free = F.col("_full"), F.col("_free")
        f = F.when((free > 0) & (goal > full), F.try_divide(goal - full, free)).when((free <= 0) & (goal >= full), 1.0).otherwise(f)
    w = w.withColumn("p", p * f).drop(*sums)
    return w if few else durable(w, "raked")


def _rounds(w: DataFrame, dims: Sequence[str], rounds: int, bounded: bool, few: bool, per_step: int = 8) -> DataFrame:
    """So many rounds over dims. The table is written after every per_step rounds (each step where cells are many), which keeps plans short."""
    for i in range(rounds):
        for d in dims:
            w = _step(w, d, bounded, few)
        if few and i % per_step == per_step - 1 and i < rounds - 1:
            w = durable(w, "raked").coalesce(1)
    return durable(w, "raked").coalesce(1) if few else w


def _off(w: DataFrame, dims: Sequence[str], few: bool) -> float:
    """The largest share of a dimension's tokens that is not where its goals are."""
    drawn = F.col("tokens") * F.least("p", F.lit(1.0))
    if few:  # in one partition: by windows, and each category's row counts for a part of it
        by = {d: Window.partitionBy(d) for d in dims}
        w = w.withColumns({f"_s_{d}": F.sum(drawn).over(by[d]) for d in dims} | {f"_n_{d}": F.count(F.lit(1)).over(by[d]) for d in dims})
        parts = [x for d in dims for x in (F.sum(F.abs(F.col(f"_s_{d}") - F.col(f"t_{d}")) / F.col(f"_n_{d}")), F.sum(F.col(f"t_{d}") / F.col(f"_n_{d}")))]
        found = list(w.agg(*parts).first())
        found = list(zip(found[::2], found[1::2]))
    else:
        found = [tuple(w.groupBy(d).agg(F.sum(drawn).alias("s"), F.first(f"t_{d}").alias("t")).agg(F.sum(F.abs(F.col("s") - F.col("t"))), F.sum("t")).first()) for d in dims]
    return max((off / t for off, t in found if t), default=0.0)


def rake(cells: DataFrame, dims: Sequence[str], exact: Sequence[str], rounds: int, few: bool) -> DataFrame:
    """cells (source, lang, topic, tokens, p, and t_ tokens to draw by dimension) with p, the probabilities of their tokens.

    The last of dims is met exactly. Where the exact ones exclude each other within the bounds, all probabilities are lowered until none is over 1.
    """
    w = plain = _rounds(cells, dims, rounds, False, few)
    top = plain.agg(F.max("p")).first()[0]
    if top is None or top <= 1:
        return plain
    off = _off(w, dims, few)
    while off > CALIBRATED:
        before = off
        w = _rounds(w, dims, 8, True, few)
        off = _off(w, dims, few)
        if off > 0.9 * before:
            break
    w = _rounds(w, dims[-1:], 4, True, few)
    if off > 0.01:
        log.warning("targets exclude each other within the bounds: %.1f %% of a dimension's tokens are not where its targets are", 100 * off)
    if exact and _off(w, exact, few) > 100 * CALIBRATED:
        w = plain.withColumn("p", F.col("p") / F.lit(top))
    return w.withColumn("p", F.least("p", F.lit(1.0)))


def mix(
    docs: DataFrame,
    *,
    topic: Column | None = None,
    tokens: Column | None = None,
    targets: dict[str, dict[str, float]] | None = None,
    temperature: float = 0.7,
    fraction: float = 0.5,
    rounds: int = 16,
    seed: str = "mix-1",
    id_col: str = "doc_id",
) -> DataFrame:
    """docs with topic_, n_tokens, probability and sampled.

    A null source or language is a category of its own, "(null)". Documents without tokens are in no
    one's way: they get the probability of their cell, or that of no cell (0) where a cell has no tokens.
    Equal ids draw alike, so repeated rows stay or go together. An empty table gives an empty result.
    targets: by dimension, shares by category (others count as OTHER and may be given under that
    name) and met exactly, if need be by a smaller sample; a dimension that is not named is tempered. Columns of docs named topic_, n_tokens, probability or
    sampled are replaced here; sample() keeps them.
    """
    targets = targets or {}
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], (topic if topic is not None else topic_of(F.col("text"))).alias("topic_"), (tokens if tokens is not None else n_words(F.col("text"))).cast("long").alias("n_tokens"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(null)"))
    keyed = inner.withColumns({"_source": text(own_name(docs, "source")), "_lang": text(own_name(docs, "lang")), "_topic": text("topic_")})
    for d in DIMS:
        keyed = keyed.withColumn(f"_{d}", F.when(F.col(f"_{d}").isin(*targets[d]), F.col(f"_{d}")).otherwise(OTHER) if d in targets else F.col(f"_{d}"))
    raw = durable(keyed.groupBy(*[F.col(f"_{d}").alias(d) for d in DIMS]).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"), "cells")
    found = raw.agg(F.sum("tokens"), F.count("*")).first()
    all_tokens, few = found[0] or 0, found[1] <= FEW_CELLS
    size, shares, w = float(min(fraction, 1.0) * all_tokens), {}, raw
    for d in DIMS if all_tokens else ():
        c = raw.groupBy(F.col(d).alias("category")).agg(F.sum("tokens").alias("n"))
        if d in targets:
            given = F.create_map(*[F.lit(x) for kv in targets[d].items() for x in kv])
            c = c.withColumn("s", F.coalesce(given[F.col("category")], F.lit(0.0)).cast("double"))
        else:
            c = c.withColumn("s", F.pow(F.col("n") / F.lit(float(all_tokens)), F.lit(temperature)))
        c = durable(c, f"categories-{d}")
        shares[d] = c.withColumn("share", F.try_divide(F.col("s"), F.lit(c.agg(F.sum("s")).first()[0])))
        if d in targets:
            size = min(size, shares[d].where("share > 0").agg(F.min(F.col("n") / F.col("share"))).first()[0] or 0.0)
    dims = [*[d for d in DIMS if d not in targets], *[d for d in DIMS if d in targets]]
    if shares and size:
        for d in DIMS:
            goals = shares[d].withColumn("goal", F.col("share") * F.lit(size)) if d in targets else _filled(shares[d], size)
            goals = goals.select(F.col("category").alias(d), F.col("goal").alias(f"t_{d}"))
            w = w.join(F.broadcast(goals) if few else goals, d)
        w = w.withColumn("p", F.lit(size / all_tokens))
        w = rake(w.coalesce(1) if few else durable(w, "raked"), dims, [d for d in DIMS if d in targets], rounds, few)
    else:
        w = w.withColumn("p", F.lit(0.0))
    probs = w.select(*[F.col(d).alias(f"_p_{d}") for d in DIMS], F.col("p").alias("probability"))
    at = [F.col(f"_{d}") == F.col(f"_p_{d}") for d in DIMS]
    out = keyed.join(F.broadcast(probs.coalesce(1)) if few else probs, reduce(Column.__and__, at), "left")
    out = out.withColumn("probability", F.coalesce("probability", F.lit(0.0))).withColumn("sampled", uniform(F.col(own_name(docs, id_col)), seed) < F.col("probability"))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in OWN], *OWN)


def sample(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that mix() draws, with their own columns as they are, whatever their names."""
    set_aside = docs.toDF(*[f"{i}-of-docs" if c.lower() in OWN else c for i, c in enumerate(docs.columns)])
    return mix(set_aside, **options).where("sampled").drop(*OWN).toDF(*docs.columns)


def mix_sql(*, temperature: float = 0.7, fraction: float = 0.5, rounds: int = 16, seed: str = "mix-1") -> str:
    """The same over the table documents, for DuckDB: goals in closed form over sorted categories, rakings as recursive tables."""
    quoted = lambda m: "'" + m.replace("\t", "' || chr(9) || '").replace("\n", "' || chr(10) || '") + "'"
    hits = {name: "(" + " + ".join(f"(strlen(t) - strlen(replace(t, {quoted(m)}, ''))) / {len(m.encode())}" for m in marks) + ")::BIGINT" for name, marks in TOPICS.items()}
    cases = " ".join(f"WHEN h_{name} = most THEN '{name}'" for name in hits)
    parts = [
        "d AS (SELECT doc_id, coalesce(source, '(null)') AS source, coalesce(lang, '(null)') AS lang, coalesce(text, '') AS t FROM documents)",
        f"h AS MATERIALIZED (SELECT doc_id, source, lang, len(regexp_extract_all(t, '{WORD}'))::BIGINT AS n, {', '.join(f'{x} AS h_{name}' for name, x in hits.items())} FROM d)",
        f"k AS MATERIALIZED (SELECT doc_id, source, lang, n, CASE WHEN most > 0 AND most * 100 >= n * {DENSITY!r} THEN CASE {cases} END ELSE '{PLAIN}' END AS topic FROM (SELECT *, greatest({', '.join(f'h_{name}' for name in hits)}) AS most FROM h))",
        "c AS MATERIALIZED (SELECT source, lang, topic, sum(n)::DOUBLE AS tokens FROM k GROUP BY ALL HAVING sum(n) > 0)",
        f"z AS (SELECT sum(tokens) AS total, {fraction!r} * sum(tokens) AS size FROM c)",
    ]
    for d in DIMS:
        # In the order of tokens to share, the categories that give all they have come first; the first that does not sets the scale of those behind it.
        parts += [
            f"s_{d} AS (SELECT *, n / share AS ratio FROM (SELECT {d} AS c, sum(tokens) AS n, pow(sum(tokens) / any_value(total), {temperature!r}) / sum(pow(sum(tokens) / any_value(total), {temperature!r})) OVER () AS share FROM c, z GROUP BY {d}))",
            f"f_{d} AS (SELECT *, (size - coalesce(sum(n) OVER (ORDER BY ratio, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(share) OVER (ORDER BY ratio, c ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale FROM s_{d}, z)",
            f"g_{d} AS MATERIALIZED (SELECT c, least(n, share * coalesce((SELECT min_by(scale, ratio) FROM f_{d} WHERE share * scale < n), 1e308)) AS t FROM f_{d})",
        ]
    parts.append(f"p0 AS MATERIALIZED (SELECT source, lang, topic, tokens, {', '.join(f'g_{d}.t AS t_{d}' for d in DIMS)}, {fraction!r}::DOUBLE AS p, 0 AS j FROM c {' '.join(f'JOIN g_{d} ON {d} = g_{d}.c' for d in DIMS)})")
    cat = "CASE j % 3 WHEN 0 THEN source WHEN 1 THEN lang ELSE topic END"
    goal_now = "CASE j % 3 WHEN 0 THEN t_source WHEN 1 THEN t_lang ELSE t_topic END"
    keep = "source, lang, topic, tokens, t_source, t_lang, t_topic"
    parts.append(f"plain AS (SELECT * FROM p0 UNION ALL SELECT {keep}, p * {goal_now} / sum(tokens * p) OVER (PARTITION BY {cat}) AS p, j + 1 AS j FROM plain WHERE j < {3 * rounds})")
    parts.append(f"p1 AS MATERIALIZED (SELECT {keep}, p, max(p) OVER () AS top FROM plain WHERE j = {3 * rounds})")

    def off(rows: str) -> str:
        by = lambda d: f"sum(tokens * least(p, 1)) OVER (PARTITION BY {d}) AS s_{d}, count(*) OVER (PARTITION BY {d}) AS n_{d}"
        return f"SELECT * EXCLUDE (s_source, s_lang, s_topic, n_source, n_lang, n_topic), greatest({', '.join(f'sum(abs(s_{d} - t_{d}) / n_{d}) OVER () / sum(t_{d} / n_{d}) OVER ()' for d in DIMS)}) AS off FROM (SELECT *, {', '.join(map(by, DIMS))} FROM {rows})"

    def bounded(now: str, category: str, rows: str) -> str:
        sums = f"SELECT *, {now} AS g, sum(tokens * p) OVER v AS a, sum(CASE WHEN p >= 1 THEN tokens ELSE 0 END) OVER v AS full_, sum(CASE WHEN p < 1 THEN tokens * p ELSE 0 END) OVER v AS free FROM {rows} WINDOW v AS (PARTITION BY {category})"
        return f"SELECT * EXCLUDE (g, a, full_, free) REPLACE (p * CASE WHEN free > 0 AND g > full_ THEN (g - full_) / free WHEN free <= 0 AND g >= full_ THEN 1 WHEN a > 0 THEN g / a ELSE 0 END AS p) FROM ({sums})"

    # A block is 8 rounds, 24 steps; whether another follows is decided at its end.
    step = bounded(goal_now, cat, "(SELECT * FROM tight WHERE NOT done)")
    ended = off(f"({step})")
    parts.append(f"t0 AS MATERIALIZED ({off('p1')})")
    parts.append(f"tight AS (SELECT {keep}, p, 0 AS j, off AS was, top <= 1 OR off <= {CALIBRATED!r} AS done FROM t0 UNION ALL SELECT {keep}, p, j + 1 AS j, CASE WHEN (j + 1) % 24 = 0 THEN off ELSE was END AS was, (j + 1) % 24 = 0 AND (off > 0.9 * was OR off <= {CALIBRATED!r}) AS done FROM ({ended}))")
    last = "(SELECT tight.*, top FROM tight, (SELECT any_value(top) AS top FROM p1) WHERE done)"
    for _ in range(4):
        last = f"({bounded('t_topic', 'topic', last)})"
    parts.append(f"p AS MATERIALIZED (SELECT source, lang, topic, least(1.0, p) AS p FROM {last} WHERE top > 1 UNION ALL SELECT source, lang, topic, p FROM p1 WHERE top <= 1)")
    draw = f"('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT / {float(1 << 48)!r}"
    return f"WITH RECURSIVE {', '.join(parts)} SELECT doc_id, topic, n AS n_tokens, round(coalesce(p, 0), 6) AS probability, {draw} < coalesce(p, 0) AS sampled FROM k LEFT JOIN p USING (source, lang, topic)"
