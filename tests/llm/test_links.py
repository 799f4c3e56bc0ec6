"""Operators 4, 8 and 9 against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import resource
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import ann, fingerprint, jaccard
from quire.llm.arrays import Arrays

from ..conftest import DATA


def shingles(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def groups(rows, words, num, den):
    """Smallest id reachable by links, by all pairs."""
    sets = [shingles(t, words) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[top(i)] = min(k, least.get(top(i), k))
    return {k: (len(sets[i]), least[top(i)]) for i, (k, _) in enumerate(rows)}


def planted():
    rng = random.Random(1)
    word = [f"w{i}" for i in range(400)]
    rows = [None, "", "  \n", "One two", "one TWO", "one"]
    for size in (8, 30, 90, 250):
        base = [rng.choice(word[: 40 if size < 50 else 400]) for _ in range(size)]
        for change in range(0, 12):
            new = list(base)
            for _ in range(change // 2):
                new[rng.randrange(size)] = rng.choice(word)
            rows.append(" ".join(new))
    rows += [" ".join(rng.choice(word[:6]) for _ in range(60)) for _ in range(60)] + ["same text of many copies here"] * 40
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("words, num", [(3, 90), (5, 80)])
def test_groups_as_all_pairs_give_them(spark, words, num):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked_groups(df, words=words, num=num, den=100).collect()}
    assert got == groups(rows, words, num, 100)


def test_a_pair_of_many_shared_keys_is_met_once(spark):
    work = spark.range(300).selectExpr("id AS key").crossJoin(spark.range(20)).where("key % 20 <> id")
    work = work.selectExpr("key", "id", "10L AS n", "id div 2 AS comp", "19L AS c", "true AS tries")
    got = [(r.id, r.hub) for r in jaccard.met(work).collect()]
    assert set(got) == {(i, j) for i in range(20) for j in range(20) if i // 2 != j // 2}
    assert len(got) == len(set(got))


def test_texts_of_a_key_that_cannot_link_make_no_rows(spark):
    """Sixty texts share half of their tokens and all keys; only neighbours of a pair can link."""
    rng = np.random.default_rng(7)
    shared = rng.integers(1 << 63, size=100, dtype=np.uint64)
    own = [rng.integers(1 << 63, size=100, dtype=np.uint64) for _ in range(30)]
    sketches = spark.createDataFrame([(i, jaccard.parity(np.concatenate([shared, own[i // 2][i % 2 :]])).tolist()) for i in range(60)], "id long, bits array<long>")
    work = spark.range(60).selectExpr("id", "200 - id % 2 AS n", "id AS comp").crossJoin(spark.range(3).selectExpr("id AS key", "60L AS c", "true AS tries"))
    assert sorted((r.id, r.hub) for r in jaccard.met(work, sketches, 90, 100).collect()) == [(i, i ^ 1) for i in range(60)]


def test_groups_of_long_texts_that_share_many_keys(spark):
    """A hundred texts around five that do not link with each other, but share most of their shingles."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(700)]
    rows = []
    for family in range(5):
        own = [f"f{family}" if rng.random() < 0.04 else w for w in base]
        for _ in range(20):
            new = list(own)
            for _ in range(rng.randrange(12)):
                new[rng.randrange(700)] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(new)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), words=5, num=80).collect()}
    assert got == groups(rows, 5, 80, 100)


def test_no_documents_no_groups(spark):
    assert jaccard.linked_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_recall_and_exact_scores(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    bad = spark.createDataFrame([(100000, None), (100020, [0.0] * 64), (100040, [float("nan")] * 64), (100060, [1.0])], "vec_id long, embedding array<float>")
    rows = df.select("vec_id", "embedding").unionByName(bad).withColumn("part", F.lit("clash"))
    got = ann.search(rows, F.col("vec_id") % 20 == 0).collect()
    ids = np.array([r[0] for r in df.select("vec_id").orderBy("vec_id").collect()])
    x = np.array([r[0] for r in df.orderBy("vec_id").select("embedding").collect()], np.float32).astype(float)
    at, hits = {v: i for i, v in enumerate(ids)}, 0
    asked = [v for v in ids if v % 20 == 0]
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
        assert r.vec_id != r.query_id and abs(r.score - x[at[r.query_id]] @ x[at[r.vec_id]]) < 1e-12
    assert sorted(by) == sorted(asked)
    for q, found in by.items():
        s = x @ x[at[q]]
        s[at[q]] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]])
        assert sorted(r.rank for r in found) == list(range(1, 21))
        hits += len(best & {r.vec_id for r in found})
    assert hits / (20 * len(asked)) >= 0.9


def test_no_vectors_no_neighbours(spark):
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_edited_texts_and_likeness(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()] + [(10**6, None), (10**6 + 1, ""), (10**6 + 7, "é🙂x")]
    rows.sort(key=lambda r: r[0])
    got = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = {}
    for i, (k, t) in enumerate(rows):
        t, after, r = t or "", rows[(i + 1) % len(rows)][1] or "", got[k]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
    assert len(set(prints.values())) == len(prints)


def test_order_does_not_count_and_paragraphs_come_and_go(spark):
    df = spark.createDataFrame([("a\nb\nc", "c\na\nb", "b", "a\nc")], "x string, y string, part string, rest string")
    df = df.select(*[fingerprint.hashes(F.col(c)).alias(c) for c in df.columns]).select(*[fingerprint.lanes(F.col(c)).alias(c) for c in df.columns])
    v = {c: F.col(c) for c in df.columns}
    r = df.select(v["x"] == v["y"], fingerprint.combine(v["x"], v["part"], -1) == v["rest"], fingerprint.combine(v["rest"], v["part"]) == v["x"]).first()
    assert all(r)


def test_fold_is_crc32_of_the_id():
    assert zlib.crc32(b"17") % 5 in range(5)


@pytest.mark.skipif(sys.version_info < (3, 13), reason="a map holds its file open")
def test_arrays_of_more_shards_than_files_may_be_open(tmp_path):
    arrays, most = Arrays(f"file://{tmp_path}/classes"), resource.getrlimit(resource.RLIMIT_NOFILE)
    for s in range(300):
        arrays.write(f"t{s}.key", np.arange(s, s + 5, dtype=np.uint64))
    resource.setrlimit(resource.RLIMIT_NOFILE, (256, most[1]))
    try:
        assert all(arrays.read(f"t{s}.key", np.uint64).tolist() == list(range(s, s + 5)) for s in range(300))
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, most)
