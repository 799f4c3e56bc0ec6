"""Queries over the test tables, one for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audit, bpe, fingerprint, html, jaccard, langid, lm, mixing, outliers, quality, variants
from .text import fold


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.with_bpe(_documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), ids=False).drop("text")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rules = quality.learn(docs, labels.where(fold("doc_id", 5) != 0))
    return quality.with_quality(docs, rules).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    model = lm.learn(docs.where(fold("doc_id", 7) != 2))
    return lm.with_lm_score(docs, model).select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_groups(_documents(spark, sf_dir, "doc_id", "text"), words=3, num=90, den=100)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.with_token_counts(_documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024).drop("text")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir, False)


def _mixture(spark: SparkSession, sf_dir: str, capped: bool) -> DataFrame:
    rows = mixing.mixed(_documents(spark, sf_dir, "doc_id", "text", "source", "lang"), capped=capped)
    return rows.select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.round("probability", 6).alias("probability"), "kept")


def op6_mixing_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that give way where a group has too few tokens, so that more of the table stays."""
    return _mixture(spark, sf_dir, True)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text", "lang")
    model = langid.learn(docs.where(fold("doc_id", 3) != 1), bounds=False)
    return langid.with_language(docs.select("doc_id", "text"), model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_documents(spark, sf_dir, "doc_id", "text"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.with_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def op11_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.verdicts(_documents(spark, sf_dir, "doc_id", "text", "lang", "source"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_documents(spark, sf_dir, "doc_id", "text", "source"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(_documents(spark, sf_dir, "doc_id", "text"), damage=31)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_byte_bpe, op2_quality, op3_lm_score, op4_jaccard_join, op5_token_counts, op6_mixing, op6_mixing_bounded, op7_language, op8_nearest, op9_fingerprint, op10_main_text, op11_outliers, op12_filter_audit, op13_spelling_variants]
    return {f.__name__: f for f in own} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    """Only where SQL can say it; the others are tested against brute force, a round trip or held-out rows."""
    return {"op6_mixing": mixing.oracle(), "op6_mixing_bounded": mixing.oracle(capped=True), "op12_filter_audit": audit.oracle()}
