"""Operators 2, 3, 6, 7 and 10, and the pipeline: held-out rows, brute force, SQL and hand-made pages."""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import html, langid, lm, mixing, quality, registry

from ..conftest import DATA
from ..test_queries import sorted_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_quality_tells_held_out_labels_apart(spark):
    d = str(DATA.parent / "sf0.01")
    got = {r.doc_id: r for r in registry.op2_quality(spark, d).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect() if r.quality is not None}
    held = [(got[k].score, y) for k, y in labels.items() if fold(k, 5) == 0 and k in got]
    assert all(got[k].held_out == (fold(k, 5) == 0) and got[k].predicted == (got[k].score >= 0.3) for k in got)
    good, poor = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert np.mean([a > b for a in good for b in poor]) > 0.8


def test_quality_of_odd_rows(spark):
    rules = quality.fit(np.zeros((0, 1)), np.zeros(0), ["chars"])
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 200_000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    assert all(0 <= r.score <= 1 for r in quality.with_quality(df, rules).collect())
    assert quality.with_quality(df.limit(0), rules).count() == 0


def test_lm_counts_and_scores(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + [(10**6, None), (10**6 + 1, "")]
    words = {k: [w.encode() for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] + [b"\n"] for k, t in rows}
    c = Counter(w for k, ws in words.items() if fold(k, 7) != 2 for w in ws)
    n, v = c.total(), len(c)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lm.with_lm_score(df, lm.learn(df.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2))).collect()}
    better = 0
    for k, ws in words.items():
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r.score <= 0
        better += r.score > r.base_score
    assert better > 0.9 * len(rows)


def test_lm_without_training_rows(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lm.with_lm_score(df, lm.learn(df.limit(0))).count() == 1


def test_mixture_rakes_all_rounds_within_the_tokens():
    """Three steps, one for each margin, in each of twelve rounds."""
    assert mixing.oracle().count("scale_by * weight <= most") == 3 * 12


@pytest.mark.parametrize("capped", [False, True])
def test_mixture_as_sql_gives_it(spark, duck, capped):
    df = (registry.op6_mixing_bounded if capped else registry.op6_mixing)(spark, str(DATA))
    asked = duck.execute(mixing.oracle(capped=capped))
    names = [x[0] for x in asked.description]
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(names, asked.fetchall())


def test_mixture_meets_targets(spark):
    rows = [(i, "a b c", "s1" if i % 3 else "s2", "de" if i % 4 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = mixing.mixed(df, targets={"source": {"s1": 0.5, "s2": 0.5}}, keep=0.2)
    shares = out.groupBy("_source").agg(F.sum(F.col("probability") * F.col("_tokens")).alias("t")).collect()
    assert math.isclose(shares[0].t, shares[1].t, rel_tol=0.01)
    assert mixing.mixed(df.limit(0)).count() == 0


@pytest.mark.parametrize("whole", [False, True])
def test_mixture_meets_targets_on_skewed_tables(spark, docs, whole):
    """With the production defaults, where many cells have fewer tokens than they would need."""
    rows = [(i, "a b c" if i % 7 else "a | b", "s1" if i % 10 else "s2", "de" if i % 9 else "fr") for i in range(2000)]
    df = docs if whole else spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = mixing.mixed(df).select("_source", "_lang", "_topic", "_tokens", "probability").collect()
    assert all(0 <= r.probability <= 1 for r in got)
    total, taken, room = sum(r._tokens for r in got), sum(r._tokens * r.probability for r in got), []
    for m in ("_source", "_lang", "_topic"):
        have, kept = Counter(), Counter()
        for r in got:
            have[r[m]] += r._tokens / total
            kept[r[m]] += r._tokens * r.probability / taken
        want = {k: v**0.5 / sum(x**0.5 for x in have.values()) for k, v in have.items()}
        assert all(math.isclose(kept[k], want[k], rel_tol=0.001) for k in want)
        room += [have[k] / want[k] for k in want]
    assert taken / total <= min(0.5, *room) * 1.0001
    assert taken / total >= min(0.5, *room) * 0.5


def test_capped_targets_by_filling(spark):
    """Shares to the power 0.5 are filled up together, each to its cap at most, until they sum to 1."""
    rows = [(i, "a b c d", "s1" if i % 20 else "s2", "de" if i % 30 else "fr") for i in range(1800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = mixing.mixed(df, topic_of=F.lit("t"), capped=True).collect()
    total, taken = sum(r._tokens for r in got), sum(r._tokens * r.probability for r in got)
    for m in ("_source", "_lang"):
        have, kept = Counter(), Counter()
        for r in got:
            have[r[m]] += r._tokens / total
            kept[r[m]] += r._tokens * r.probability / taken
        low, high = 0.0, 100.0
        for _ in range(100):
            by = (low + high) / 2
            low, high = (by, high) if sum(min(by * v**0.5, v / 0.5) for v in have.values()) < 1 else (low, by)
        assert all(math.isclose(kept[k], min(low * v**0.5, v / 0.5), rel_tol=0.002) for k, v in have.items())
    assert math.isclose(taken / total, 0.5, rel_tol=0.01)


def test_forward_backward_as_all_paths_give_it():
    rng = np.random.default_rng(0)
    emit, moves, begin = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    bounds = np.array([0, 4, 4, 7])
    got = langid.posteriors(emit, bounds, moves, begin)
    for a, b in zip(bounds, bounds[1:], strict=False):
        want = np.zeros((b - a, 3))
        for path in itertools.product(range(3), repeat=b - a):
            if path:
                s = begin[path[0]] + sum(emit[a + t, y] for t, y in enumerate(path)) + sum(moves[x, y] for x, y in itertools.pairwise(path))
                want[np.arange(b - a), path] += np.exp(s)
        if b > a:
            assert np.allclose(got[a:b], want / want.sum(1, keepdims=True))


def test_language_of_held_out_texts(spark, docs):
    got = {r.doc_id: r for r in registry.op7_language(spark, str(DATA)).collect()}
    held = [(r.lang, got[r.doc_id].lang_pred) for r in docs.collect() if fold(r.doc_id, 3) == 1 and r.lang and got[r.doc_id].lang_pred != "und"]
    assert np.mean([a == b for a, b in held]) > 0.9
    model = langid.fit(["ab cd ef"] * 3, ["x"] * 3)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "ab " * 50_000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    by = {r.doc_id: r for r in langid.with_language(odd, model).collect()}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[4].lang_pred == "x"
    assert langid.with_language(odd.limit(0), model).count() == 0


@pytest.mark.parametrize("empty", ["", "123 45"])
def test_language_without_words_leaves_others_learned(spark, empty):
    rows = [(i, "der hund und die katze" if i % 2 else "the dog and the cat", "de" if i % 2 else "en") for i in range(20)]
    df = spark.createDataFrame([*rows, (20, empty, "aa")], "doc_id long, text string, lang string")
    model = langid.learn(df)
    got = langid.with_language(df, model).collect()
    assert model.labels == ["de", "en"]
    assert all(r.lang_pred == (r.lang if r.doc_id < 20 else "und") and (r.score > 0.9 or r.doc_id == 20) for r in got)
    assert langid.fit([""], ["x"]).labels == ["x"]


def test_language_is_learned_from_all_texts(spark):
    """Each text has a word of its own; nearly five sixths of these, of 3,000 texts, must have left weights."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 9))
    rows = [(i, ("der hund und " if i % 2 else "the dog and ") + word(), "de" if i % 2 else "en") for i in range(3000)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    own = [t.split()[-1].encode() for _, t, _ in rows]
    buf, ends = np.frombuffer(b"".join(own), np.uint8), np.arange(1, 3001) * 9
    whole = langid.features(buf, ends - 9, ends)[1][-3000:]
    assert model.weights.any(1)[whole].mean() > 0.75
    assert model.least_score > 0 and model.least_familiar > 0


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>Home</a> <a href=y>News</a></nav>
<div id="cookie-notice">We use cookies.</div>
<div class="layout"><article><h1>The&nbsp;title &amp; more</h1><p>First   paragraph of the article, long enough to count as
text.<p>Second paragraph with <b>bold</b> words and a <a href=z>link</a> inside.<script>var a = "</p><p>no";</script><ul><li>one</li><li>two</li></ul></article>
<div class="sidebar"><p>Related</p></div></div><div class="comments"><p>Nice post!</p></div><footer>Copyright</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "The title & more\n\nFirst paragraph of the article, long enough to count as text.\n\nSecond paragraph with bold words and a link inside.\n\none\n\ntwo"
    assert html.main_text(None) == html.main_text("") == html.main_text("<p></p>") == html.main_text("<script>x") == ""


def test_main_text_of_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", "<p>" + "long " * 100_000)], "page_id long, url string, html string").withColumn("n_chars", F.lit("clash"))
    by = {r.page_id: r for r in html.with_main_text(df).collect()}
    assert by[2].text == "" and by[2].n_chars == 0 and by[3].n_chars == 499_999
    assert html.with_main_text(df.limit(0)).count() == 0


def test_pipeline_keeps_and_rejects(spark, docs):
    """Each stage is worked again over what the one before wrote, by plainer means where there are some."""
    from .test_links import groups

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "language ID", "n-gram Jaccard join", "mixing sources", "byte-level BPE"]
    now, sizes = docs.select(*corpus_pipeline.COLUMNS), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(DATA))
        if name == "n-gram Jaccard join":
            want = {c for _, c in groups([(r.doc_id, r.text) for r in now.collect()], 5, 80, 100).values()}
            assert {r.doc_id for r in out.select("doc_id").collect()} == want
        if name != "byte-level BPE":
            assert out.columns == corpus_pipeline.COLUMNS
            out = spark.createDataFrame(out.collect(), out.schema)
        sizes.append(out.count())
        now = out
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 0
    assert corpus_pipeline.run(spark, str(DATA)).count() == sizes[-1]


@pytest.mark.parametrize("sizes", [[700], [1, 96, 97, 0, 192, 193, 350], [95, 1000, 3, 0]])
def test_long_sequences_are_walked_in_blocks(sizes, monkeypatch):
    """The same posteriors as word by word, in steps that do not grow with the longest sequence."""
    rng, k = np.random.default_rng(len(sizes)), 3
    emit, moves, begin = rng.normal(0, 4, (sum(sizes), k)), rng.normal(0, 2, (k, k)), rng.normal(0, 1, k)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    calls, exp = [], np.exp
    got = langid.posteriors(emit, bounds, moves, begin)
    for a, b in zip(bounds, bounds[1:]):
        fwd, bwd = np.zeros((b - a, k)), np.ones((b - a, k))
        for t in range(b - a):
            fwd[t] = exp(emit[a + t]) * (exp(begin) if t == 0 else fwd[t - 1] @ exp(moves))
            fwd[t] /= fwd[t].sum()
        for t in range(b - a - 2, -1, -1):
            bwd[t] = exp(moves) @ (exp(emit[a + t + 1]) * bwd[t + 1])
            bwd[t] /= bwd[t].sum()
        want = fwd * bwd
        assert np.allclose(got[a:b], want / want.sum(1, keepdims=True), atol=1e-12)
    monkeypatch.setattr(langid, "_transfers", lambda e, first, sizes, m, f=langid._transfers: calls.append(int(sizes.max())) or f(e, first, sizes, m))
    langid.posteriors(emit, bounds, moves, begin)
    assert calls and max(calls) <= langid.BLOCK
