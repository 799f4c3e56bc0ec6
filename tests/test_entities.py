"""Operators over entities against plain Python."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from quire.operators import entities as E


def greedy(rows):
    """Item by item, as the rule says it."""
    out = {}
    for block in {r[1] for r in rows}:
        anchors = []
        for i, _, kind, year, preferred in sorted(r for r in rows if r[1] == block):
            a = next((a for a in anchors if a[0] == kind and a[1] is not None and year is not None and abs(a[1] - year) <= 1), None)
            if a is None:
                anchors.append(a := [kind, year, i, preferred, []])
            elif preferred and not a[3]:
                a[2:4] = i, True
            a[4].append(i)
        out |= {i: a[2] for a in anchors for i in a[4]}
    return out


def test_greedy_duplicates_replays_classes_only(spark):
    rng = random.Random(1)
    big = 1 << 60  # no float holds these ids
    rows = [(big + i, "hot" if i % 3 else f"t{i % 40}", rng.choice(["x", "y", None]), rng.choice([*range(2000, 2012), None]), rng.random() < 0.1) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, block string, type string, year long, preferred boolean")
    out = E.greedy_duplicates(df)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(rows) and dict(got) == greedy(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInPandas")
    assert len(plan) == 2 and re.search(r"Aggregate \[block#\w+, type#\w+, year#\w+\]", plan[1])


def test_whole_shingles_of_long_short_and_foreign_texts(spark, tmp_path):
    from quire.plans import catalog

    rows = [(1, "aaaa", "en"), (2, "aaab" + "c" * 5000, "en"), (3, "aaa", "en"), (4, "ab", "en"), (5, "xyz", "en"), (6, "xyz", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("n_chars", F.length("text")).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.retained for r in catalog.queries()["shingle_retained_whole"](spark, str(tmp_path)).collect()}
    assert got == {1: 0.5, 2: round(1 / 5002, 6), 3: 0.0, 4: 1.0}


def test_closure_holds_levels_against_roots_that_go_on_only(spark, monkeypatch):
    """A chain and a circle among many roots that end at once: what is met is written again for those two only."""
    edges = spark.createDataFrame([*[(k, k + 1) for k in range(6)], (100, 101), (101, 100), *[(k, 1000) for k in range(200, 300)]], "parent long, child long")
    roots = spark.createDataFrame([(r,) for r in (0, 100, *range(200, 300))], "root long")
    sizes, store = [], E.stored

    def counted(df, name):
        made = store(df, name)
        sizes.append((name, made.count()))
        return made

    monkeypatch.setattr(E, "stored", counted)
    got = {(r.root, r.node): r.depth for r in E.closure(edges, roots).collect()}
    assert got == {**{(0, k): k for k in range(7)}, (100, 100): 0, (100, 101): 1, **{(k, k): 0 for k in range(200, 300)}, **{(k, 1000): 1 for k in range(200, 300)}}
    assert [n for name, n in sizes if name == "met"] == [204, 3, 4, 5, 6, 7]
