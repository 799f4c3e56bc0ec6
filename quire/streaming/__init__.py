"""Structured Streaming forms of the queue, of sessions and of syncing, over the same functions as their batch forms."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared_root
from ..sources.snapshots import Snapshots


def events(spark: SparkSession, sf_dir: str, files: str = "events.parquet", late: str = "1 hour") -> DataFrame:
    """The events of a folder as a stream with a watermark; a file that comes later is read when it comes."""
    schema = spark.read.option("pathGlobFilter", files).parquet(sf_dir).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", 16).parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def sessions(rows: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user, which end when nothing comes for `gap`: user_id, begin, n. State is one row for each open
    session; the watermark closes it."""
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("begin"), "n")


def queued(rows: DataFrame, default: int = 100) -> DataFrame:
    """Jobs by user and kind, coalesced: the lowest (most urgent) priority asked for, the first time queued, how often
    asked. A request without a priority has the default one."""
    priority = F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(default))
    return rows.groupBy("user_id", F.col("event_type").alias("kind")).agg(F.min(priority).cast("bigint").alias("priority"), F.min("ts").alias("queued"), F.count(F.lit(1)).alias("asked"))


def deduplicated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys did not come before within the watermark, so that replayed files count once."""
    return rows.dropDuplicatesWithinWatermark(keys)


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the query that a checkpoint belongs to; a new checkpoint has a new one."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first().value)["id"]


def _published(table: str, checkpoint: str, change, append: bool = False) -> Callable[[DataFrame, int], None]:
    """A writer of batches that publishes change(old rows or None, batch) with the number of the batch, so that a batch
    that runs again is in the table once. Only the first batch of a checkpoint may find no table."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held, source = Snapshots(spark, table), _stream_id(spark, checkpoint)
        done = held.manifest()["notes"].get(source, -1)
        if number <= done:
            return
        if done < 0 and number > 0:
            raise ValueError(f"{table} has lost what batches before {number} brought")
        held.change(lambda old: change(old, batch), {source: number}, append=append)

    return write


def caught_up(rows: DataFrame, at: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now and give its result as a table in the folder `at`.

    complete: the last state of an aggregation; append: all rows. Called again with the same folder, also by another
    session, it goes on from its checkpoint and reads what has come since only.
    """
    spark, checkpoint = rows.sparkSession, f"{at}/checkpoint"
    together = lambda old, batch: batch if mode == "complete" or old is None else old.unionByName(batch)
    stream = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(_published(f"{at}/table", checkpoint, together)).trigger(availableNow=True).start()
    stream.awaitTermination()
    got = Snapshots(spark, f"{at}/table").read()
    return spark.createDataFrame([], rows.schema) if got is None else got


def upserted(rows: DataFrame, table: str, keys: list[str], version: str):
    """A writer that merges each batch into a table of snapshots: the newest version of each key stays. Read it with
    Snapshots(spark, table).read()."""
    from ..operators.entities import upsert

    checkpoint = f"{table}/_checkpoint"
    merge = lambda old, batch: upsert(batch.limit(0) if old is None else old, batch, keys, version)
    return rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(_published(table, checkpoint, merge))


def appended(rows: DataFrame, table: str):
    """A writer that puts what each batch changes beside what a table of snapshots holds, so that a batch costs its own
    rows and not the whole table. Readers merge."""
    checkpoint = f"{table}/_checkpoint"
    return rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(_published(table, checkpoint, lambda old, batch: batch, append=True))


def own_folder(spark: SparkSession, name: str, of: str) -> str:
    """A folder in the shared place for a stream over `of`, the same whenever this application asks."""
    return f"{shared_root(spark)}/{name}-{hashlib.sha256(of.encode()).hexdigest()[:16]}-{spark.sparkContext.applicationId}"
