"""Operator 13 against plain counting and comparing all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm import registry, variants

from ..conftest import DATA

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def counted(rows, damage=31):
    n = Counter()
    for i, t in rows:
        for run in RUN.findall(t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def differ_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(n):
    """All words that can be one letter apart share what is left without one of theirs, or are that."""
    met = defaultdict(set)
    for w in n:
        for left in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            met[left].add(w)
    near = {w: {o for left in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))} for o in met[left] if differ_by_one(w, o)} for w in n}
    form = {}
    for w, others in near.items():
        top = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = top if top is not None and n[top] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def rows_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("at", ["sf0.001", "sf0.01"])
def test_query_as_brute_force_gives_it(spark, at):
    d = str(DATA.parent / at)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    df = registry.op13_spelling_variants(spark, d)
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"] and df.count() == len(got := rows_of(df))
    want = grouped(counted(docs))
    assert got == want and any(f for f, *_ in want.values())


def test_near_words_of_few_letters(spark):
    """Words of few letters have many anagrams, repeated letters and neighbours in the middle; all pairs are compared."""
    rng = random.Random(3)
    words = {"".join(rng.choices("abÿ", k=rng.choice([7, 8, 8, 9]))) for _ in range(500)} | {"a" * k for k in range(7, 40)} | {"a" * k + "b" for k in range(7, 40)} | {"ab" * 5000, "ab" * 4999 + "b", "ab" * 4999 + "aa"}
    for k in (61, 62, 63, 64, 65, 66):  # around the length from which words are looked up
        for i in range(0, k, 3):
            words |= {"ab" * 40 + "c", ("ab" * 40)[: k], ("ab" * 40)[:i] + "ÿ" + ("ab" * 40)[i : k - 1], ("ab" * 40)[:i] + "z" + ("ab" * 40)[i + 1 : k]}
    words = sorted(words)
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, r long")
    got = Counter((words[r.r_x], words[r.r_y]) for r in variants.near_pairs(df).collect())
    assert set(got.values()) == {1}
    assert set(got) == {(a, b) for a in words for b in words if abs(len(a) - len(b)) <= 1 and differ_by_one(a, b)}


def test_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, ties between forms, a chain of forms, clashing names."""
    rows = [(None, "Zeppelin zeppelin"), (1, None), (2, ""), (3, "12 -- ×÷ kurz"), (4, "zeppelin " * 30_000), (4, "zeppelin " * 30_000), (5, "zeppelyn " * 40 + "zeppelyx " * 2), (6, "A" * 9 + "Ä " + "A" * 9 + "Ä"), (7, "x" * 5_000 + " " + "x" * 5_000)]
    rows += [(8, "maximum " * 20 + "maximun " * 20 + "maximux " * 2), (9, "z" * (variants.STRETCH - 3) + "wxyz " * 2 + "." * variants.STRETCH)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("word", F.lit("clash"))
    assert rows_of(variants.variants(df, damage=31)) == grouped(counted(rows))
    got = rows_of(variants.variants(df))
    assert got == grouped(counted(rows, 0))
    assert got["zeppelyx"][:2] == ("zeppelyn", "zeppelin") and got["maximux"][0] == "maximum" and got["aaaaaaaaaÄ"][2:4] == (2, 0)
    assert variants.variants(df.limit(0)).count() == variants.variants(df.where("doc_id < 4")).count() == 0
