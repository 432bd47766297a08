"""A pipeline over documents: toxicity, exact copies, near copies, mixing, tokens.

Each stage is (name, function of spark, docs, sf_dir). Its result is written as Parquet and read again as the next one's docs. All
stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import byte_bpe, exact_dedup, mixture, near_dup, toxicity
from loomwright.llm.common import durable, held_out, own_name, renamed, restored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that are predicted toxic. A null or empty text has no words to be rejected for."""
    doc_id, text = own_name(docs, "doc_id"), own_name(docs, "text")
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", doc_id)
    scored = toxicity.detect(renamed(docs), labels, learn=~held_out(F.col(doc_id)), id_col=doc_id, text_col=text)
    return restored(scored.where(f"predicted = 0 OR coalesce(trim({text}), '') = ''"), docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id."""
    return exact_dedup.drop_exact_copies(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the one with the smallest id."""
    return near_dup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose expected tokens follow the raked source, language and topic weights."""
    return mixture.sample(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their digests."""
    return byte_bpe.encode_documents(docs, ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_tokens),
]

#: A trained model and a raking over its survivors are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = durable(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
