"""The job queue as operations on tables: asking for jobs, claiming, failing and releasing them, and retries of failures.

Requests: keys, seq (their order), at, priority (lower is more urgent), content, payload. Jobs: keys, priority, enqueued,
available, content, payload, attempts, error. The requests of one key are read in order by a window, which sorts and
spills; it holds no group in memory. A null priority is the default one; null contents are equal to each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The priority of requests without one, attempts of a job, seconds of the first wait and of the longest,
#: and of a lease.
PRIORITY, ATTEMPTS, WAIT, LONGEST_WAIT, LEASE = 100, 3, 60, 1800, 360
#: Failures after which an item is given up, and seconds of the first wait, which doubles.
FAILURES, RETRY_WAIT = 5, 3600
#: Errors of a response that may be gone at the next attempt.
TRANSIENT = ["download_failed", "extraction_failed", "worker_unavailable"]


def enqueued(requests: DataFrame, keys: list[str]) -> DataFrame:
    """One job for each key: keys, priority, enqueued, available, content, payload, asked and since (seq of the request
    that last began it anew).

    The first request makes the job. Later ones lower priority and available to the least asked for and bring their
    content; one of another content than the job's, or of a lower priority, begins it anew: its payload counts, and
    attempts are counted from it on.
    """
    own = W.partitionBy(*keys).orderBy("seq")
    before = own.rowsBetween(W.unboundedPreceding, -1)
    rows = requests.withColumn("priority", F.coalesce("priority", F.lit(PRIORITY)))
    least = F.min("priority").over(before)
    anew = least.isNull() | ~F.lag("content").over(own).eqNullSafe(F.col("content")) | (F.col("priority") < least)
    rows = rows.withColumn("_anew", anew)
    at_begin = F.when(F.col("_anew"), F.col("seq"))
    return rows.groupBy(*keys).agg(
        F.min("priority").alias("priority"), F.min_by("at", "seq").alias("enqueued"), F.min("at").alias("available"), F.max_by("content", "seq").alias("content"),
        F.max_by("payload", at_begin).alias("payload"), F.count(F.lit(1)).alias("asked"), F.max(at_begin).alias("since"),
    )


def after(at: Column, seconds: Column) -> Column:
    return at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def wait(attempt: Column) -> Column:
    """Seconds until a job may be tried again after so many attempts: doubled each time, with a ceiling."""
    return F.least(F.lit(WAIT) * F.pow(F.lit(2), attempt - 1), F.lit(LONGEST_WAIT)).cast("bigint")


def head(jobs: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first n jobs: by priority, then by when they became available."""
    return jobs.orderBy("priority", "available", *keys).limit(n)


def claimed(jobs: DataFrame, keys: list[str], now: Column, n: int = 1, below: int | None = None) -> DataFrame:
    """The first n jobs that are available and, if asked, of a priority below a bound; a lease keeps them from others."""
    seen = jobs.where(F.col("available") <= now)
    seen = seen if below is None else seen.where(F.col("priority") < below)
    return head(seen, keys, n).withColumn("available", after(now, F.lit(LEASE)))


def failed(jobs: DataFrame, now: Column, error: Column) -> tuple[DataFrame, DataFrame]:
    """Jobs that failed once more: those that will be tried again, and those that are dead (with died)."""
    tried = jobs.withColumns({"attempts": F.col("attempts") + 1, "error": error})
    dead = F.col("attempts") >= ATTEMPTS
    return tried.where(~dead).withColumn("available", after(now, wait(F.col("attempts")))), tried.where(dead).drop("available", "priority").withColumn("died", now)


def released(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs given back without an attempt."""
    return jobs.withColumn("available", now)


def outcome(kind: Column, code: Column, phase: Column, message: Column) -> Column:
    """struct<action, reason> of a result: complete, release or fail, and what is told about it."""

    def told(action: str, reason: Column) -> Column:
        return F.struct(F.lit(action).alias("action"), reason.alias("reason"))

    out = F.when(kind == "ok", told("complete", F.lit("ok"))).when(kind == "external_abort", told("release", F.lit("external_abort")))
    out = out.when(kind == "cached_error", told("complete", F.concat(F.lit("cached_error:"), code))).when(kind == "timeout", told("fail", F.concat(F.lit("timeout:"), phase)))
    out = out.when((kind == "response_error") & code.isin(TRANSIENT), told("fail", F.concat(code, F.lit(": "), message)))
    return out.when(kind == "response_error", told("complete", F.concat(F.lit("terminal:"), code)))


def failures(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows: keys, at, error. Failures of each item: keys, failures, last_attempt, last_error, next_retry."""
    made = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("failures"), F.max("at").alias("last_attempt"), F.max_by("error", F.struct("at", "error")).alias("last_error"))
    return made.withColumn("next_retry", after(F.col("last_attempt"), retry_wait(F.col("failures"))))


def retry_wait(n: Column) -> Column:
    return (F.lit(RETRY_WAIT) * F.pow(F.lit(2), n - 1)).cast("bigint")


def refreshed(known: DataFrame, rows: DataFrame, keys: list[str], counted: bool = True) -> DataFrame:
    """known: failures(); rows: keys, at, error, one for each item that failed in this batch. What is known afterwards.
    Without `counted` a failure known before keeps its number and time, and a new one may be tried at once."""
    new = rows.select(*keys, F.col("at").alias("_at"), F.col("error").alias("_error"), F.lit(True).alias("_new"))
    both = known.join(new, keys, "full_outer")
    hit = F.col("_new").isNotNull()
    n = F.coalesce("failures", F.lit(0)) + F.when(hit & F.lit(counted), 1).otherwise(0)
    retry = F.when(hit & F.lit(counted), after(F.col("_at"), retry_wait(n))).otherwise(F.coalesce("next_retry", "_at"))
    return both.select(*keys, n.cast("bigint").alias("failures"), F.coalesce("_at", "last_attempt").alias("last_attempt"), F.coalesce("_error", "last_error").alias("last_error"), retry.alias("next_retry"))
