"""Token counts with a digest cache.

The cache is a Parquet table (tokenizer, content, n_tokens): the digest of a tokenizer's file and library
version, the digest of a normalised text, and its count. Contents are joined to it by both digests;
only distinct contents without an entry are encoded, and their counts are appended. Content
is normalised by nothing but null to empty, as every other change could change a count.

Whole texts cross the network once, when distinct misses are gathered (equal texts of a task are combined before);
every later join carries digests. Two writers may append the same entry, so entries are combined on reading.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import sentencepiece
import tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, new_table, text_groups

CACHE = 300_000  # segments remembered by a worker, then forgotten all at once
SCHEMA = "tokenizer string, content string, n_tokens bigint"
SPACE = "▁"


def tokenizer_digest(path: str) -> str:
    """Of the file and of the library that reads it: either changing makes all cached counts stale."""
    with open(path, "rb") as f:
        file = hashlib.sha256(f.read()).hexdigest()
    library = f"tokenizers {tokenizers.__version__}" if path.endswith(".json") else f"sentencepiece {sentencepiece.__version__}"
    return hashlib.sha256(f"{file} {library}".encode()).hexdigest()


class PieceCounter:
    """Counts of a sentencepiece model.

    Where no piece has a space mark after another character, no merge crosses the border before a run
    of spaces, so a text's count is the sum of its segments' counts, and segments repeat. This is read from
    the model; models that differ (or that collapse spaces or have no dummy prefix) encode whole texts.
    """

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        encode = lambda t: self.model.encode(t, out_type=str)
        marks = {encode("  ")[0][:1], encode("a")[0][:1]} == {SPACE} and sum(map(len, encode("a  a"))) == 5
        self.apart = marks and not any(SPACE in p.lstrip(SPACE) for p in pieces) and SPACE in pieces
        self.cut = re.compile(f"{SPACE}+[^{SPACE}]*").findall
        self.known: dict[str, int] = {}

    def _parts(self, text: str) -> list[str]:
        """Segments without the space mark that the model puts before each."""
        if not text:
            return []
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            return [s[1:] for s in self.cut(SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def count_all(self, texts: list[str]) -> list[int]:
        if not self.apart:
            return [len(ids) for ids in self.model.encode(texts, num_threads=1)]
        found = [self._parts(t) for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        new = [p for p in set().union(*found) if p not in self.known]
        # A space mark alone is one piece.
        self.known.update((p, len(ids) if p else 1) for p, ids in zip(new, self.model.encode(new, num_threads=1)))
        return [sum(map(self.known.__getitem__, parts)) for parts in found]


class JsonCounter:
    """Counts of a tokenizers file, special strings in texts read as that library reads them by default."""

    def __init__(self, file: bytes):
        self.tokenizer = tokenizers.Tokenizer.from_buffer(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def count_all(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """An absent cache is an empty one."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMA)


def count_tokens(docs: DataFrame, *, tokenizer_path: str, cache_path: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens, over_limit (more than limit tokens).

    A null text counts as empty: no bytes, no tokens. Whole texts are encoded, whatever their length.
    Repeated rows give equal rows; ids may be null and other columns are ignored. An empty table gives an
    empty result. Without cache_path a new cache is begun in the shared folder. If a run fails after
    appending, the next one finds those entries; if before, it encodes again.
    """
    spark = docs.sparkSession
    cache_path = cache_path or new_table(spark, "token-counts")
    version = tokenizer_digest(tokenizer_path)
    with open(tokenizer_path, "rb") as f:
        shared = spark.sparkContext.broadcast((f.read(), tokenizer_path.endswith(".json")))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, is_json = shared.value
        counter = (JsonCounter if is_json else PieceCounter)(file)
        for batch in batches:
            yield pd.DataFrame({"tokenizer": version, "content": batch["content"], "n_tokens": [n for texts in text_groups(batch["text"]) for n in counter.count_all(texts)]})

    text = F.coalesce(F.col(text_col), F.lit(""))
    contents = docs.select(F.sha2(text.cast("binary"), 256).alias("content"), text.alias("text")).distinct()
    cached = read_cache(spark, cache_path).where(F.col("tokenizer") == version)
    misses = contents.join(cached.select("content"), "content", "left_anti")
    misses.mapInPandas(encode, SCHEMA).write.mode("append").parquet(cache_path)
    # Written, so that the join below has an exchange on either side and a hot content's rows can be split over tasks.
    counts = durable(read_cache(spark, cache_path).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("content"))
    return rows.join(counts, "content").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
