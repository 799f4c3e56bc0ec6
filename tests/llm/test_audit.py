"""Operator 12 against its SQL and against every order walked over every row."""

from __future__ import annotations

from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from quire.llm import audit, registry

from ..conftest import DATA
from ..test_queries import sorted_rows


def test_audit_as_sql_gives_it(spark, duck):
    df = registry.op12_filter_audit(spark, str(DATA))
    asked = duck.execute(audit.oracle())
    names = [x[0] for x in asked.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(names, asked.fetchall())


def walked(rows, labels):
    """rows: id, text, source; every order over every row."""
    texts, out = {}, Counter()
    for i, t, _ in rows:
        if i is not None:
            texts[t or ""] = min(i, texts.get(t or "", i))
    parts = {s or "" for _, _, s in rows}
    for order in permutations("ABCDE"):
        for i, t, s in rows:
            t, s = t or "", s or ""
            w = [x for x in t.replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
            fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > texts[t]}
            gone = False
            for step, f in enumerate(order, 1):
                k = (s, "".join(order), step)
                out[k, "unique_fails"] += fails[f] and sum(fails.values()) == 1
                if gone:
                    out[k, "redundant"] += fails[f]
                elif fails[f]:
                    gone = True
                    out[k, "removed"] += 1
                    out[k, "good_lost"] += labels.get(i, (0, 0))[0] if i is not None else 0
                    out[k, "toxic_lost"] += labels.get(i, (0, 0))[1] if i is not None else 0
                    out[s, f, "shapley"] += 1
                else:
                    out[k, "kept"] += 1
    return parts, out


def test_audit_of_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and ids, other white space, repeated and null labels, clashing names."""
    long = "one Two three four " * 100
    rows = [(1, None, None), (2, "", "s"), (3, "", ""), (3, "", "s"), (3, "", "s"), (None, "", "s"), (None, long, "s"), (4, long, "s"), (5, long, "t"), (5, long, "t"), (6, "a#b\x0bc\x0cd", "s"), (7, " ".join(map(str, range(300))), "t"), (8, "ÄÖ A", None), (9, "x " * 20_000, "t")]
    labels = [(2, 1, None), (2, 0, 1), (3, 1, 1), (5, None, 1), (7, 1, 0), (None, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("kept", F.lit("clash")).withColumn("mask", F.lit("clash"))
    got = audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("source", F.lit(0))).collect()
    parts, want = walked(rows, {2: (1, 1), 3: (1, 1), 5: (0, 1), 7: (1, 0)})
    assert len(got) == 600 * len(parts) == len({(r.part, r.filter_order, r.step) for r in got})
    for r in got:
        k = (r.part, r.filter_order, r.step)
        for name in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
            assert r[name] == want[k, name], (k, name)
        assert r.shapley == want[r.part, r.filter_order[r.step - 1], "shapley"]


def test_audit_of_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "a", "s")], docs.schema)
    assert {(r.kept, r.removed) for r in audit.audit(one, labels).where("step = 5").collect()} <= {(0, 1), (0, 0)}


@pytest.mark.parametrize("k", [1, 3, 5])
def test_transform_is_inverted_exactly(spark, k):
    masks = [(m, (m * 7919 + 3) % 11 * 10**12) for m in range(1 << k)]
    rows = spark.createDataFrame([("p", m, n) for m, n in masks], "part string, mask int, rows long")
    got = audit.parity_sums(rows, ["part"], k).select(audit.inverted(F.col("sums"), k).alias("c")).first().c
    assert got == [n for _, n in masks]
