"""Reasons to compare an index, statuses of calls and boxes around boxes, rule by rule."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from quire.operators import entities as E
from quire.operators import layout as L
from quire.plans import catalog
from quire.streaming import folds

DAY = datetime.date(2024, 5, 20)


def test_first_reason_to_compare_an_index(spark):
    ago = lambda n: DAY - datetime.timedelta(days=n)
    now = [(k, 10, DAY if k != 9 else None, None if k == 1 else 5) for k in range(1, 11)]
    seen = [
        (3, ago(8), 1, ago(9), 1), (4, ago(7), 9, ago(9), 1), (5, ago(1), 10, ago(1), 1), (6, ago(1), 10, DAY, 4),
        (7, ago(1), 10, DAY, 5), (8, ago(1), 10, None, 5), (9, ago(1), 10, DAY, 5), (10, None, 10, DAY, 5), (77, ago(1), 1, DAY, 1),
    ]
    now = spark.createDataFrame(now, "k int, items int, newest date, embeddings int")
    seen = spark.createDataFrame(seen, "k int, last_scan date, items int, newest date, embeddings int")
    got = {r.k: r.reason for r in E.diff_reasons(now, seen, ["k"], F.lit(DAY)).collect()}
    assert got == {1: "first run", 2: "no state", 3: "old scan", 4: "items counted", 5: "items modified", 6: "embeddings counted", 7: None, 8: None, 9: None, 10: None}


def test_status_of_calls(spark):
    calls = [("a", c) for c in "12345"] + [("a", "1"), ("b", "1"), ("c", "1")]
    results = [
        ("a", "1", 0, "tool-return", "success"), ("a", "2", 0, "retry-prompt", None), ("a", "3", 0, "tool-return", "failed"), ("a", "4", 0, "retry-prompt", None),
        ("a", "4", 1, "tool-return", None), ("a", "9", 0, "tool-return", "success"),
    ]
    runs = spark.createDataFrame([("a", "in_progress"), ("b", "completed")], "run string, status string")
    got = folds.call_status(spark.createDataFrame(calls, "run string, call string"), spark.createDataFrame(results, "run string, call string, seq int, kind string, outcome string"), runs)
    assert sorted(tuple(r) for r in got.collect()) == [
        ("a", "1", "completed"), ("a", "2", "error"), ("a", "3", "error"), ("a", "4", "completed"), ("a", "5", "in_progress"), ("b", "1", "error"), ("c", "1", "error"),
    ]


def test_one_box_around_many(spark):
    rows = [(1, 0.0, 1.0, 2.0, 3.0), (1, -1.0, 2.0, 1.0, 9.0), (2, 5.0, 5.0, 6.0, 6.0), (3, None, 1.0, 2.0, 3.0)]
    got = L.united(spark.createDataFrame(rows, "k int, x0 double, y0 double, x1 double, y1 double"), ["k"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, -1.0, 1.0, 2.0, 9.0), (2, 5.0, 5.0, 6.0, 6.0)]


def test_times_far_ahead_are_written_as_sql_writes_them(spark, duck, tmp_path):
    import quire.plans.rules as rules

    made = spark.createDataFrame([(0,), (2_900_000,), (3_000_000,), (6_099_999,)], "event_id bigint")
    made.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    sql = catalog.oracle_sql()["ms_to_ts"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")
    got = {r["event_id"]: r["at"] for r in rules.ms_to_ts(spark, str(tmp_path)).collect()}
    assert got == dict(duck.execute(sql).fetchall())
    assert max(map(len, got.values())) == 20  # a year of five digits
