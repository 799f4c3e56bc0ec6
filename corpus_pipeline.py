"""From raw documents to encoded training rows.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns
of `documents`; run() writes each stage's rows as Parquet in the shared folder and reads them again. Without documents
every stage returns no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, jaccard, langid, mixing, quality
from quire.llm.text import fold, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: texts that the rules mark as label 0 go."""
    raw, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rules = quality.learn(raw, labels.where(fold("doc_id", 5) != 0))
    return quality.with_quality(docs, rules).where("predicted = 1").select(*COLUMNS)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: texts without letters, or in no learned language, go; a missing lang is filled in.

    A text is in no learned language if its score or its share of familiar words is below what the model holds
    against texts of the learned languages that it was not fitted to.
    """
    model = langid.learn(spark.read.parquet(f"{sf_dir}/documents.parquet").where(fold("doc_id", 3) != 1))
    rows = langid.with_language(docs, model)
    rows = rows.where((F.col("lang_pred") != "und") & (F.col("score") >= model.least_score) & (F.col("familiar") >= model.least_familiar))
    return rows.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each group of near duplicates the document of smallest id stays.

    Two documents are near duplicates if the Jaccard similarity of their sets of five-word shingles is 0.8 or more.
    Rows without an id stay, and rows of equal id stay or go together.
    """
    groups = jaccard.linked_groups(docs, words=5, num=80, den=100)
    stays = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    return docs.join(stays, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL")).select(*COLUMNS)


def keep_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: a sample by calibrated probabilities, of half the tokens or as many as the targets allow. Targets give
    way where a source, language or topic has too few tokens, else the scarcest of them would decide how much stays."""
    return mixing.mixed(docs, capped=True).where("kept").select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: ids, where pieces begin, and digests that prove the round trip."""
    rows = bpe.with_bpe(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return rows.drop("text")


STAGES = [("quality classifier", keep_quality), ("language ID", keep_language), ("n-gram Jaccard join", keep_one_of_each), ("mixing sources", keep_mixture), ("byte-level BPE", encoded)]
#: SQL cannot express the learned stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage{i}")
    return docs
