"""The job queue against requests taken one by one, and changes of a tree of collections."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import entities as E
from quire.operators import queue as Q

REQUEST = "k string, seq long, at timestamp_ntz, priority int, content string, payload string"
BEGIN = datetime.datetime(2024, 1, 1)


def one_by_one(rows):
    """Insert a job, or update it: least priority and time, the content that came, the payload where it begins anew."""
    jobs = {}
    for k, seq, at, priority, content, payload in sorted(rows, key=lambda r: r[1]):
        priority = 100 if priority is None else priority
        j = jobs.get(k)
        if j is None:
            jobs[k] = {"priority": priority, "enqueued": at, "available": at, "content": content, "payload": payload, "since": seq, "asked": 1}
            continue
        if content != j["content"] or priority < j["priority"]:
            j.update(payload=payload, since=seq)
        j.update(priority=min(j["priority"], priority), available=min(j["available"], at), content=content, asked=j["asked"] + 1)
    return jobs


@pytest.mark.parametrize("seed", range(3))
def test_requests_are_coalesced_as_one_by_one(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("abcde"), i, BEGIN + datetime.timedelta(minutes=rng.randint(0, 50)), rng.choice([None, 5, 50, 100, 200]), rng.choice(["pdf", "epub", None]), f"p{i}" if i % 4 else None) for i in range(120)]
    got = {r.k: {n: r[n] for n in ("priority", "enqueued", "available", "content", "payload", "since", "asked")} for r in Q.enqueued(spark.createDataFrame(rows, REQUEST), ["k"]).collect()}
    assert got == one_by_one(rows)


def _jobs(spark):
    rows = [("a", 50, 0, 0), ("b", 50, 1, 2), ("c", 10, 60, 1), ("d", 10, 5, 0), ("e", 120, 0, 1)]
    return spark.createDataFrame([(k, p, BEGIN + datetime.timedelta(minutes=m), n) for k, p, m, n in rows], "k string, priority int, available timestamp_ntz, attempts int")


def test_claims_take_the_most_urgent_that_is_there(spark):
    jobs, at = _jobs(spark), lambda m: F.lit(BEGIN + datetime.timedelta(minutes=m)).cast("timestamp_ntz")
    assert [r.k for r in Q.head(jobs, ["k"], 9).collect()] == ["d", "c", "a", "b", "e"]
    first = Q.claimed(jobs, ["k"], at(10)).collect()
    assert [r.k for r in first] == ["d"] and first[0].available == BEGIN + datetime.timedelta(minutes=16)
    assert [r.k for r in Q.claimed(jobs.where("k <> 'd'"), ["k"], at(10), 9, below=100).collect()] == ["a", "b"]
    assert Q.claimed(jobs, ["k"], at(-1)).count() == 0


def test_third_failure_is_the_last(spark):
    now = F.lit(BEGIN).cast("timestamp_ntz")
    again, dead = Q.failed(_jobs(spark), now, F.lit("x"))
    assert {r.k: (r.attempts, (r.available - BEGIN).seconds, r.error) for r in again.collect()} == {"a": (1, 60, "x"), "c": (2, 120, "x"), "d": (1, 60, "x"), "e": (2, 120, "x")}
    assert [(r.k, r.attempts, r.died, r.error) for r in dead.collect()] == [("b", 3, BEGIN, "x")]
    assert {r.w for r in spark.range(6, 9).select(Q.wait(F.col("id")).alias("w")).collect()} == {1800}
    assert {(r.attempts, r.available) for r in Q.released(_jobs(spark).where("k = 'b'"), now).collect()} == {(2, BEGIN)}


def test_retries_double_and_end(spark):
    rows = [("a", BEGIN, "x")] + [("b", BEGIN + datetime.timedelta(hours=i), f"e{i}") for i in range(3)] + [("c", BEGIN, "y")] * 5
    known = Q.failures(spark.createDataFrame(rows, "k string, at timestamp_ntz, error string"), ["k"])
    got = {r.k: (r.failures, r.last_error, r.next_retry - r.last_attempt) for r in known.collect()}
    hours = lambda n: datetime.timedelta(hours=n)
    assert got == {"a": (1, "x", hours(1)), "b": (3, "e2", hours(4)), "c": (5, "y", hours(16))}
    batch = spark.createDataFrame([("a", BEGIN + hours(9), "z"), ("n", BEGIN + hours(9), "z")], "k string, at timestamp_ntz, error string")
    more = {r.k: (r.failures, r.last_error, (r.next_retry - BEGIN) / hours(1)) for r in Q.refreshed(known, batch, ["k"]).collect()}
    assert more["a"] == (2, "z", 11) and more["n"] == (1, "z", 10) and more["b"] == (3, "e2", 6)
    lenient = {r.k: (r.failures, r.last_error, (r.next_retry - BEGIN) / hours(1)) for r in Q.refreshed(known, batch, ["k"], counted=False).collect()}
    assert lenient["a"] == (1, "z", 1) and lenient["n"] == (0, "z", 9)


def test_outcomes(spark):
    rows = [("ok", None), ("external_abort", None), ("cached_error", "encrypted"), ("timeout", None), ("response_error", "worker_unavailable"), ("response_error", "no_text"), ("else", None)]
    got = [tuple(r.o) if r.o else None for r in spark.createDataFrame(rows, "k string, c string").select(Q.outcome(F.col("k"), F.col("c"), F.lit("read"), F.lit("m")).alias("o")).collect()]
    assert got == [("complete", "ok"), ("release", "external_abort"), ("complete", "cached_error:encrypted"), ("fail", "timeout:read"), ("fail", "worker_unavailable: m"), ("complete", "terminal:no_text"), None]


TREE = [(1, None, "top", False), (2, 1, "a", False), (3, 2, "b", False), (4, 3, "c", False), (5, None, "other", False), (6, 5, "gone", True), (7, None, "x", False), (8, None, "y", False)]


def _managed(spark, actions):
    tree = spark.createDataFrame(TREE, "id long, parent long, name string, deleted boolean")
    new, said = E.managed(tree, spark.createDataFrame(actions, "id long, action string, name string, parent long"))
    return {r.id: (r.parent, r.name, r.deleted) for r in new.collect()}, {r.id: r.error for r in said.collect()}


def test_collections_are_renamed_moved_and_deleted(spark):
    new, said = _managed(spark, [(1, "rename", " new ", None), (4, "move", None, 5), (3, "delete", None, None), (5, "delete", None, None), (2, "move", None, None)])
    assert said == {1: None, 4: None, 3: "has collections in it", 5: None, 2: None}
    assert new[1] == (None, "new", False) and new[4] == (5, "c", False) and new[5][2] and new[2][0] is None and new[3] == (2, "b", False) and len(new) == len(TREE)


def test_moves_that_make_circles_are_refused(spark):
    _, said = _managed(spark, [(1, "move", None, 4), (2, "move", None, 2), (3, "move", None, 2), (5, "move", None, 6), (9, "rename", "n", None), (4, "rename", "  ", None), (7, "move", None, 8), (8, "move", None, 7)])
    assert said == {1: "below itself", 2: "into itself", 3: "already there", 5: "parent not found", 9: "not found", 4: "empty name", 7: "below itself", 8: "below itself"}
    _, said = _managed(spark, [(6, "rename", "n", None), (7, "sell", None, None), (1, "rename", "top", None)])
    assert said == {6: "not found", 7: "unsupported action", 1: "same name"}


def test_rows_deleted_only_as_they_were_read(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "k long, v string")
    read = spark.createDataFrame([(1, "a"), (2, "old"), (3, None), (9, "z")], "k long, v string")
    assert {r.k for r in E.delete_unchanged(now, read, ["k"]).collect()} == {2, 4}
