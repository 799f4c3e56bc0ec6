"""Readers of the test tables and of raw files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session may go without that setting; it gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bound the rows of an Arrow batch: a worker holds a whole batch of pages or texts with all that is made of them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_once(df: DataFrame, path: str) -> DataFrame:
    """df as Parquet in a folder, written unless it is there."""
    df.write.mode("ignore").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 1), line. A leading byte-order mark goes, CRLF and CR end lines; empty text has no lines."""
    plain = F.regexp_replace(F.regexp_replace(F.col(text), "^﻿", ""), "\r\n?", "\n")
    rows = df.where(F.length(text) > 0).select(key, F.posexplode(F.split(plain, "\n")).alias("pos", "line"))
    return rows.select(key, (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files with path, modification time, length and content."""
    return spark.read.format("binaryFile").load(path)


#: First bytes (hex) of image formats.
IMAGES = {"89504E470D0A1A0A": "image/png", "FFD8FF": "image/jpeg", "474946383761": "image/gif", "474946383961": "image/gif", "424D": "image/bmp"}


def image_type(content: Column) -> Column:
    """MIME type by the first bytes; null for anything else."""
    head = F.hex(F.substring(content, 1, 16))
    out = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    for magic, kind in IMAGES.items():
        out = out.when(head.startswith(magic), kind)
    return out
