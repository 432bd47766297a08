"""The operators over the test tables, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, divergence, exact_dedup, html_main, lang_id, license_scan, media, merkle, mixture, near_dup, quality_rules, token_cache, toxicity
from .common import LOWER, UPPER, held_out, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_documents(table(spark, sf_dir, "documents"))
    spans = F.transform("matches", lambda m: F.format_string("%d-%d:%s:%.4f", m["first_line"], m["end_line"], m["license"], m["dice"]))
    return found.select("doc_id", "license", F.round("dice", 6).alias("dice"), "n_matches", F.array_join(spans, " ").alias("spans"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents")).select("doc_id", F.col("topic_").alias("topic"), "n_tokens", F.round("probability", 6).alias("probability"), "sampled")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=False)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out(F.col("doc_id"))
    predicted = lang_id.identify(table(spark, sf_dir, "documents"), learn=~out)
    return predicted.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op6_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out(F.col("doc_id"))
    scored = toxicity.detect(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), learn=~out)
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted")


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(table(spark, sf_dir, "pages"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_groups(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_cache.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path=public_tokenizers.path("piece_bpe_32k.model"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out(F.col("doc_id"), parts=5, part=0)
    scored = quality_rules.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), learn=~out)
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even, merkle.digest(*[F.replace(F.col("text"), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in merkle.FIELDS]))
    proofs = merkle.build(table(spark, sf_dir, "documents"), claimed=tampered).proofs()
    return merkle.verified(proofs).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_source_mixing": op2_source_mixing,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_language_id": op5_language_id,
    "op6_lossless_webp": op6_lossless_webp,
    "op7_toxicity": op7_toxicity,
    "op8_html_main_text": op8_html_main_text,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_quality_rules": op11_quality_rules,
    "op12_source_divergence": op12_source_divergence,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op2_source_mixing": mixture.mix_sql(),
    "op4_exact_dedup": f"""
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
    "op12_source_divergence": divergence.AUDIT_SQL,
    "op13_merkle_manifest": merkle.MANIFEST_SQL,
}
