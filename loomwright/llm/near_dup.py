"""Near-duplicates: MinHash signatures joined by a multi-index Hamming join, links confirmed on whole shingle sets.

A document's set is its distinct 5-word shingles. Its signature has CHUNKS * CHUNK minhashes of 8 bits.

Join. Signatures are cut into CHUNKS chunks. If two differ in fewer than CHUNKS * (ERRORS + 1) symbols, some chunk differs in ERRORS
symbols at most (pigeonhole), so for each chunk all ways to leave out ERRORS of its symbols are enumerated as
keys: such a pair has a key in common, always. Pairs further apart often have one too; at a similarity
of 0.75 the chance of none is below 0.1 %, and it falls quickly above.

Work that grows with the square of a group's size is avoided in three ways:
* Equal sets are one class from the start; only class representatives are joined.
* For each key, every document is first compared with the key's smallest only, so a group of copies becomes a star. Links that hold
  make components (large-star and small-star rounds).
* What is left are pairs of different components under one key. Documents of which too few shingles occur in any other of these cannot have a
  link and are out. A key that more than HOT of the rest have (documents of one template) is split by rare shingles: in one order of all
  shingles, by how many open documents have them, two linked sets have one in common among the first n - ceil(percent * n) + 1 of each, so
  its documents meet under those only, and what a template repeats is not among them. In a bucket, documents of its largest component meet the
  others and not each other.
Bounds by sizes, by places in that order and by bitmaps of the hashed shingles discard candidates before texts are compared. A shingle whose bit the
other bitmap lacks is not in the other set, so the bits that two bitmaps share, and the shingles that fell on a bit already set, bound what
the sets share. No number of pairs is capped, and all bounds are exact. What grows with a square is left for shingles that are among the rarest of
many sets of different components.

Tables between the steps are written to the shared folder, so a lost executor repeats one step at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, durable, text_groups, tidy

WORDS = 5
CHUNKS = 12
CHUNK = 7
ERRORS = 1
SYMBOLS = CHUNKS * CHUNK
HOT = 32  # open documents of a key from which on it is split by rare shingles
BITMAP = 2048  # bits of the hashed sets that pairs are compared by
CACHE = 100_000  # words remembered by a worker, then forgotten all at once
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
_rng = np.random.default_rng(97)
_A = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Runs without space, tab, line feed, vertical tab, form feed and carriage return; A-Z lower-cased."""
    return (text or "").encode().translate(_LOWER).split()


def shingles(text: str | None) -> set[tuple[bytes, ...]]:
    """The set itself, for confirming links."""
    w = words_of(text)
    if len(w) < WORDS:
        return {tuple(w)} if w else set()
    return set(zip(*(w[i:] for i in range(WORDS))))


class Signer:
    """Of one worker; remembers hashes of words."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def shingle_hashes(self, text: str | None) -> np.ndarray:
        """Distinct 64-bit hashes of the shingles, sorted."""
        words = words_of(text)
        if not words:
            return np.zeros(0, dtype=np.uint64)
        if len(self.known) > CACHE:
            self.known.clear()
        for w in set(words):
            if w not in self.known:
                self.known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))
        n = max(1, len(h) - WORDS + 1)
        out = np.zeros(n, dtype=np.uint64)
        for k in range(min(WORDS, len(h))):
            out = (out ^ h[k : k + n]) * _POWERS[k]
            out ^= out >> np.uint64(29)
        if len(h) < WORDS:
            out = out * np.uint64(2 * len(h) + 1)
        return np.unique(out)

    def sign(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols are the last 8 bits of mixed minhashes; a chunk of them is one number. By blocks, so that a long text needs no more room."""
        least = np.full(SYMBOLS, np.iinfo(np.uint64).max, dtype=np.uint64)
        step = (1 << 18) // SYMBOLS
        for at in range(0, len(hashes), step):
            block = hashes[at : at + step, None] * _A + _B
            np.minimum(least, (block ^ (block >> np.uint64(32))).min(axis=0), out=least)
        symbols = (least * _MIX >> np.uint64(56)).astype(np.uint8)
        return np.pad(symbols.reshape(CHUNKS, CHUNK), ((0, 0), (0, 8 - CHUNK))).view("<i8").ravel()


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """The bits that hashed shingles fall on, as 64-bit numbers."""
    bits = np.zeros(BITMAP, dtype=np.uint8)
    bits[hashes >> np.uint64(64 - BITMAP.bit_length() + 1)] = 1
    return np.packbits(bits).view(np.int64)


def _digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    signer = Signer()
    for batch in batches:
        rows = []
        for text in (t for texts in text_groups(batch["text"]) for t in texts):
            hashes = signer.shingle_hashes(text)
            rows.append((len(hashes), _digest(hashes), signer.sign(hashes), bitmap(hashes)) if len(hashes) else (0, None, None, None))
        yield pd.concat([batch[["id"]], pd.DataFrame(rows, columns=["n", "same", "sig", "bits"], index=batch.index)], axis=1)


def keys(sig: Column) -> Column:
    """All keys of a signature, CHUNK of each chunk: a hash of the key's place in this array and the chunk without one symbol."""
    if ERRORS != 1:
        raise NotImplementedError("keys leave out one symbol")
    mask = lambda j: F.lit(~(0xFF << 8 * j) & ((1 << 8 * CHUNK) - 1))
    return F.array(*[F.xxhash64(F.lit(c * CHUNK + j), sig[c].bitwiseAND(mask(j))) for c in range(CHUNKS) for j in range(CHUNK)])


def errors(a: Column, b: Column) -> Column:
    """In how many symbols two chunks differ: bytes of their exclusive or that aren't zero."""
    low, high, x = F.lit(int("7F" * CHUNK, 16)), F.lit(int("80" * CHUNK, 16)), a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(x.bitwiseAND(low) + low).bitwiseAND(high))


def shares_key(a: Column, b: Column) -> Column:
    """Do two signatures have any key in common?"""
    return F.least(*[errors(a[c], b[c]) for c in range(CHUNKS)]) <= ERRORS


def is_first_key(place: Column, a: Column, b: Column) -> Column:
    """Is this the first of the keys that two signatures share? So that a pair comes from one key only."""
    chunk = F.floor(place / CHUNK).cast("int")
    first = F.least(*[F.when(errors(a[c], b[c]) <= ERRORS, c) for c in range(CHUNKS)])
    # Without an error in the chunk all its keys are shared, with one only the key that leaves it out.
    return ((place % CHUNK == 0) | (errors(F.get(a, chunk), F.get(b, chunk)) > 0)) & (chunk == first)


def ones(bits: Column | list[Column]) -> Column:
    """How many bits of a bitmap, or of two bitmaps both, are set."""
    first, *more = bits if isinstance(bits, list) else [bits]
    return sum((F.bit_count(first[i].bitwiseAND(more[0][i]) if more else first[i]) for i in range(BITMAP // 64)), F.lit(0))


def may_link(common: Column, percent: int) -> Column:
    """Can sets of sizes an and bn be linked if they have no more than this in common?"""
    return common * 100 >= (F.col("an") + F.col("bn") - common) * percent


def by_bitmaps(percent: int) -> Column:
    """Exact bound of a pair (an, bn, abits, bbits) by shared bits and the shingles that fell on bits set already."""
    fallen = F.least(F.col("an") - ones(F.col("abits")), F.col("bn") - ones(F.col("bbits")))
    return may_link(F.least("an", "bn"), percent) & may_link(ones([F.col("abits"), F.col("bbits")]) + fallen, percent)


def _hashed(texts: DataFrame) -> DataFrame:
    """(id, same, h): the set's digest and its shingle hashes. Rows with one id may be several sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = Signer()
        for batch in batches:
            at = 0
            for texts in text_groups(batch["text"]):
                hashes = [signer.shingle_hashes(t) for t in texts]
                yield pd.DataFrame({"id": batch["id"].iloc[at : at + len(texts)], "same": [_digest(h) for h in hashes], "h": [h.view(np.int64) for h in hashes]})
                at += len(texts)

    return texts.mapInPandas(tidy(run), "id bigint, same binary, h array<bigint>")


def _shared_counts(hashed: DataFrame) -> DataFrame:
    """(id, same, s): how many shingles of each set any other of these sets has too. Shingles that one set alone has are counted by it and taken away."""
    each = hashed.select(F.struct("id", "same").alias("of"), F.explode("h").alias("h"))
    held = each.groupBy("h").agg(F.min("of").alias("of"), F.max("of").alias("last"))
    alone = held.where("of = last").groupBy("of.id", "of.same").agg(F.count(F.lit(1)).alias("u"))
    return hashed.join(alone, ["id", "same"], "left").select("id", "same", (F.size("h") - F.coalesce("u", F.lit(0))).alias("s"))


def _rare(hashed: DataFrame, wanted: DataFrame, percent: int) -> DataFrame:
    """(h, id, rest) of the sets named by wanted (id, same): each one's rarest shingles that others have too, and how many come after it.

    Two sets that are linked have one of them in common, as both go by one order: how many of all these sets have a shingle, then its hash.
    Shingles of one set alone come first in it; they take their places and give no row.
    """
    held = hashed.select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    each = hashed.join(wanted, ["id", "same"], "left_semi").select("id", "same", F.size("h").alias("n"), F.explode("h").alias("h")).join(held, "h")
    last = Window.partitionBy("id", "same").orderBy(F.desc("df"), F.desc("h"))
    placed = each.withColumn("rest", F.row_number().over(last) - 1)
    # Of n places the first n - ceil(percent * n) + 1 count, so at least ceil(percent * n) - 1 come after.
    return placed.where(F.col("rest") >= F.ceil(F.col("n") * percent / F.lit(100)) - 1).select("h", "id", "same", "rest")


def _buckets(rows: DataFrame) -> DataFrame:
    """rows (bucket, component, ...) of buckets with several components; main: of the bucket's largest component, which need not meet each other."""
    sizes = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("k"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("k", "component")).alias("m"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    return rows.join(largest.select("bucket", F.col("m.component").alias("m")), "bucket").withColumn("main", F.col("component") == F.col("m")).drop("m")


def open_buckets(rows: DataFrame, hashed: DataFrame, percent: int) -> DataFrame:
    """Where open documents meet: (bucket, place, id, same, component, rest, main), of rows (key, place, id, same, n, component).

    A key of up to HOT rows is a bucket. The documents of other keys meet under their rare shingles instead (place is -1), however many keys they have.
    """
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("k"))
    sized = durable(rows.join(sizes, "key"), "sized-keys")
    few = sized.where(F.col("k") <= HOT).select(F.xxhash64(F.lit("key"), "key").alias("bucket"), "place", "id", "same", "component", F.col("n").alias("rest"))
    hot = durable(sized.where(F.col("k") > HOT).select("id", "same", "component").distinct(), "hot")
    rare = _rare(hashed, hot, percent).join(hot, ["id", "same"])
    split = rare.select(F.xxhash64(F.lit("shingle"), "h").alias("bucket"), F.lit(-1).alias("place"), "id", "same", "component", F.col("rest").cast("bigint").alias("rest"))
    return _buckets(durable(few.unionByName(split), "meetings"))


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ids with texts whose whole sets are similar enough. Texts come by two joins on the id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, set()
        for batch in batches:
            ok = []
            for ta, tb in zip(batch["ta"], batch["tb"]):
                if ta is not last and ta != last:
                    last, held = ta, shingles(ta)
                other = shingles(tb)
                common = len(held & other)
                ok.append(100 * common >= percent * (len(held) + len(other) - common) > 0)
            yield batch.loc[ok, ["a", "b"]]

    left = pairs.join(texts.withColumnsRenamed({"id": "a", "text": "ta"}), "a")
    both = left.join(texts.withColumnsRenamed({"id": "b", "text": "tb"}), "b").select("a", "b", "ta", "tb")
    return both.mapInPandas(tidy(run), "a bigint, b bigint")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every id that has a link: the smallest id reachable. links: (a, b), a bigint each.

    Large-star and small-star rounds: neighbours are tied to the smallest one, until nothing changes. Smallest neighbours come from
    an aggregation that is combined before its shuffle, so a hub with very many links is no larger task.
    """
    edges = durable(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        # Large star: every larger neighbour of u is tied to the smallest of u and its neighbours.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = durable(large, "large-star")
        # Small star: every smaller neighbour of u, and u itself, is tied to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = durable(tied.where("u <> v").distinct(), "small-star")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id").union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def near_groups(docs: DataFrame, *, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |common| >= percent * |union| of their shingle sets; component_id is the smallest id that links
    reach, and kept says that it is the document's own. A null or empty text, or one of white space, has an empty set, and is
    linked with nothing. Rows with one id are one document with several texts: a link of any is a link of the id, and
    each row has the component of its own set. A row without an id is linked with nothing, has no component and is kept. Ids are integers; other
    columns are ignored and an empty table gives an empty result. Texts are read whole.
    """
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    signed = durable(own.mapInPandas(tidy(_signed), "id bigint, n bigint, same binary, sig array<bigint>, bits array<bigint>"), "signed")
    # Equal sets: the class' smallest id stands for it.
    # Equal sets have equal signatures and bitmaps.
    classes = durable(signed.where("n > 0 AND id IS NOT NULL").groupBy("same").agg(F.min("id").alias("id"), *[F.max(c).alias(c) for c in ("n", "sig", "bits")]), "classes")
    every = classes.select("id", F.posexplode(keys(F.col("sig"))).alias("place", "key"))
    shared = durable(every.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("k")).where("k > 1").select("key", "rep"), "shared-keys")
    member = durable(every.join(shared, "key").select("key", "place", "id", "rep"), "members")
    a, b = (classes.select(F.col("id").alias(x), F.col("n").alias(f"{x}n"), F.col("bits").alias(f"{x}bits")) for x in "ab")
    # Whole texts cross the network once here; the joins below carry those of documents with a key in common only.
    texts = durable(own.where("id IS NOT NULL").join(member.select("id").distinct(), "id", "left_semi"), "texts")
    stars = member.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()
    stars = stars.join(a, "a").join(b, "b").where(by_bitmaps(percent)).select("a", "b").distinct()
    links = durable(_confirmed(stars, texts, percent), "links")
    # Pairs of different components under one key, but for those with the key's smallest, which are done.
    parts = durable(components(links), "parts")
    open_keys = member.where("id <> rep").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = open_keys.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    rows = durable(open_keys.join(several, "key", "left_semi").select("key", "place", "id", "component"), "open-keys")
    # A pair's common shingles are at most those that either shares with anyone else here; most open documents share too few.
    hashed = durable(_hashed(texts.join(rows.select("id").distinct(), "id", "left_semi")), "hashed")
    able = classes.join(_shared_counts(hashed).distinct(), ["id", "same"]).where(F.col("s") * 100 >= F.col("n") * percent)
    able = durable(able.select("id", "same", "n", "s", "sig", "bits"), "able")
    meet = durable(open_buckets(rows.join(able.select("id", "same", "n"), "id"), hashed, percent), "buckets").join(able, ["id", "same"])
    left, right = (meet.select("bucket", *[F.col(c).alias(x + c) for c in meet.columns if c != "bucket"]) for x in "ab")
    once = ~F.col("amain") & (F.col("bmain") | (F.col("aid") < F.col("bid")))  # each pair from one side; none inside the largest component
    same_key = F.when(F.col("aplace") >= 0, is_first_key(F.col("aplace"), F.col("asig"), F.col("bsig"))).otherwise(shares_key(F.col("asig"), F.col("bsig")))
    # The first shingle that two sets have in common bounds the rest by what comes after it in either.
    bounds = may_link(F.least("as", "bs"), percent) & may_link(F.least("arest", "brest") + 1, percent) & same_key & by_bitmaps(percent)
    crossed = left.join(right, "bucket").where((F.col("acomponent") != F.col("bcomponent")) & once & bounds)
    crossed = durable(crossed.select(F.least("aid", "bid").alias("a"), F.greatest("aid", "bid").alias("b")).distinct(), "crossed")
    links = links.union(_confirmed(crossed, texts, percent))
    found = classes.select("same", "id").join(components(links), "id", "left").select("same", F.coalesce("component", "id").alias("component"))
    # Rows without a set join by their id, each for itself, instead of meeting as nulls.
    out = signed.withColumn("same", F.coalesce("same", F.col("id").cast("string").cast("binary"), F.unhex(F.lit("00")))).join(found, "same", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, *, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that near_groups does not keep; columns stay as they are."""
    marks = near_groups(docs, percent=percent, id_col=id_col, text_col=text_col).where("NOT kept").select(F.col(id_col)).distinct()
    return docs.join(marks, id_col, "left_anti")
