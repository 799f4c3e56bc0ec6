"""The operators' methods on small made tables: brute force, gradients, hand-made pages, odd rows."""

from __future__ import annotations

import itertools
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import ann, bpe, fingerprint, html, jaccard, langid, lm, mixing, quality

from ..conftest import DATA

# ---- 2 quality -----------------------------------------------------------------------------------------------------


def test_a_filter_does_not_repeat_statistics(spark):
    rules = quality.Rules(0.1, [((("repeats", True, 0.1), ("digits", False, k / 100)), 0.1) for k in range(20)])
    df = spark.createDataFrame([(1, "a a 1"), (1, "a a 1")], "doc_id long, text string").withColumn("_stats", F.lit("clash"))
    kept = quality.with_quality(df, rules).where("predicted = 1")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") + plan.count("regexp_count") <= 2 * len(quality.statistics(F.lit("")))
    assert kept.columns == ["doc_id", "text", "_stats", "score", "predicted"] and kept.count() == 2


def test_quality_as_rules_give_it(spark):
    """The column expression against the rules worked by hand over the collected statistics."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["word", "WORD", "12", "a,b", "!!", "x|y"]) for _ in range(rng.randrange(40))) for _ in range(60)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    x = df.select("doc_id", *[c.alias(n) for n, c in quality.statistics(F.col("text")).items()]).toPandas().set_index("doc_id")
    y = np.array([float(i % 3 > 0) for i in range(len(texts))])
    rules = quality.fit(x.to_numpy(float), y, list(x.columns))
    got = {r.doc_id: r.score for r in quality.with_quality(df, rules).collect()}
    for i, row in x.iterrows():
        total = rules.bias + sum(w for cs, w in rules.rules if all((row[n] <= b) == low for n, low, b in cs))
        assert math.isclose(got[i], 1 / (1 + math.exp(-total)), rel_tol=1e-9)


# ---- 3 language model ----------------------------------------------------------------------------------------------


def kneser_ney(train, texts):
    """log10 probabilities, counted plainly."""
    pairs, count = Counter(), Counter()
    for ws in train:
        pairs.update(zip(["<s>", *ws], ws, strict=False))
        count.update(ws)
    of = Counter(pairs.values())
    d = lm._discounts([of[k] for k in (1, 2, 3, 4)])
    typ = Counter(w for _, w in pairs)
    tw = Counter(typ.values())
    dw = lm._discounts([tw[k] for k in (1, 2, 3, 4)])
    left = dw[0] * tw[1] + dw[1] * tw[2] + dw[2] * sum(n for k, n in tw.items() if k > 2)
    seen, kinds = Counter(), defaultdict(lambda: [0, 0, 0])
    for (v, _), c in pairs.items():
        seen[v] += c
        kinds[v][min(c, 3) - 1] += 1
    cut = lambda c, ds: max(c - (0, *ds)[min(c, 3)], 0)
    out = []
    for ws in texts:
        s = 0.0
        for v, w in zip(["<s>", *ws], ws, strict=False):
            p = cut(typ[w], dw) / len(pairs) + left / len(pairs) / (len(count) + 1)
            if seen[v]:
                p = cut(pairs[v, w], d) / seen[v] + sum(a * b for a, b in zip(d, kinds[v], strict=True)) / seen[v] * p
            s += math.log10(p)
        out.append(s)
    return out


def test_scores_as_counted_plainly(spark):
    rng = random.Random(4)
    words = [f"w{int(rng.expovariate(0.1))}" for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(150)] + ["w1 " * 3000, "w1 w2", "w1 w2", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(4)
    model = lm.learn(df.where("doc_id % 3 <> 0"))
    got = {r.doc_id: r.score for r in lm.with_lm_score(df, model).collect()}
    tokens = [re.findall(r"\S+", t) + ["</s>"] for t in texts]
    want = kneser_ney([t for i, t in enumerate(tokens) if i % 3], tokens)
    assert all(math.isclose(got[i], w, rel_tol=1e-9) for i, w in enumerate(want))
    assert lm.with_lm_score(df.limit(0), model).count() == 0


# ---- 4 links -------------------------------------------------------------------------------------------------------


def test_rows_without_id_and_long_texts_in_links(spark):
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (None, long), (3, "a b c d"), (3, "a b c d"), (None, ""), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit(7))
    got = sorted(((r.doc_id or 0, r.component_id or 0) for r in jaccard.linked_groups(df).collect()))
    assert got == [(0, 0), (0, 0), (1, 1), (2, 1), (3, 3), (3, 3), (5, 5)]


# ---- 6 mixing ------------------------------------------------------------------------------------------------------


def test_mixing_of_odd_rows(spark):
    rows = [(i, None if i % 5 == 0 else "a b c", "s", None) for i in range(40)] + [(None, "a", None, "de"), (7, "a b c", "s", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("probability", F.lit("clash")).withColumn("_topic", F.lit(1))
    got = mixing.mixed(df, keep=1.0).collect()
    assert len(got) == 42 and all(isinstance(r.probability, float) for r in got)
    assert not any(r.kept for r in got if r.doc_id is None)
    assert len({r.kept for r in got if r.doc_id == 7}) == 1


# ---- 7 language ----------------------------------------------------------------------------------------------------


def test_gradients_as_finite_differences_give_them():
    rng = np.random.default_rng(1)
    emit, moves, begin, y = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), rng.integers(0, 3, 7)
    bounds = np.array([0, 4, 4, 7])

    def loss(emit, moves, begin):
        total = 0.0
        for a, b in itertools.pairwise(bounds):
            said = lambda p: begin[p[0]] + sum(emit[a + t, q] for t, q in enumerate(p)) + sum(moves[u, v] for u, v in itertools.pairwise(p))  # noqa: B023, E731
            if b > a:
                total += np.log(sum(np.exp(said(p)) for p in itertools.product(range(3), repeat=b - a))) - said(y[a:b])
        return total

    values = [emit, moves, begin]
    for k, grad in enumerate(langid.gradients(emit, bounds, moves, begin, y)):
        for at in np.ndindex(grad.shape):
            up, down = ([v.copy() for v in values] for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert abs((loss(*up) - loss(*down)) / 2e-5 - grad[at]) < 1e-6


POLISH = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem"


def test_texts_of_unlearned_languages_are_told(spark):
    rng = random.Random(2)
    bag = {"en": "the of and that with from have this which their would there about people water under house", "de": "der die und nicht eine sich werden haben auch über nach unter zwischen wasser straße gegen"}
    rows = [(i, " ".join(rng.choice(bag[n].split()) for _ in range(30)), n) for i, n in enumerate(["en", "de"] * 60)]
    model = langid.fit([r[1] for r in rows], [r[2] for r in rows])
    sums, words, familiar = model.label(pa.array([r[1] for r in rows] + [POLISH]))
    scores = sums.max(1) / words
    assert all(familiar[:-1] >= model.least_familiar) and all(scores[:-1] >= model.least_score)
    assert familiar[-1] < model.least_familiar


# ---- 8 neighbours --------------------------------------------------------------------------------------------------


def brute(x, ids, q, k=20):
    s = x @ x[q]
    s[ids == ids[q]] = -np.inf
    return set(ids[np.lexsort((ids, -s))[:k]].tolist())


@pytest.mark.parametrize("n", [3, 64, 100, 320])
def test_small_tables_give_all_they_can(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 8))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = Counter(r.query_id for r in ann.search(df, F.col("vec_id") % 20 == 0).collect())
    assert got == {q: min(20, n - 1) for q in range(0, n, 20) if n > 1}


def test_ties_and_repeated_ids(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(5, [1.0, 0.0]), (6, [2.0, 0.0]), (0, [1.0, 0.0])]
    got = sorted(tuple(r) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect())
    assert [(r[1], r[2], r[3]) for r in got] == [(1, 6, 2.0)] + [(k + 1, i, 1.0) for k, i in enumerate([i for i in range(1, 21) if i != 6], 1)]


def test_recall_on_vectors_that_were_not_fitted(spark):
    """50,000 vectors in 300 clusters: the router sees a part of them; recall is that of all queries."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(300, 32))
    x = centres[rng.integers(0, 300, 50_000)] + 0.5 * rng.normal(size=(50_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    parts = ann.parts_for(len(x))
    router = ann.fit(x[rng.permutation(len(x))[: 64 * parts]], parts)
    own = router.part(x)
    sizes = np.bincount(own, minlength=parts)
    asked = np.arange(0, len(x), 100)
    tried = router.probes(x[asked], sizes, 20)
    ids, hits = np.arange(len(x)), []
    for q, p in zip(asked, tried, strict=True):
        best = np.array(sorted(brute(x, ids, q)))
        hits.append(np.isin(own[best], p).mean())
    share = np.mean([sizes[p].sum() for p in tried]) / len(x)
    print(f"recall {np.mean(hits):.3f}, {share:.1%} of the rows probed")
    assert np.mean(hits) >= 0.9 and share < 0.3


def test_samples_come_from_the_whole_text(spark):
    text = "".join(f"{i:06d}" for i in range(5000))
    got = spark.createDataFrame([(text,), ("short",), (None,), ("x" * 4000,)], "t string").select(langid._spread(F.col("t"), langid.SAMPLE_CHARS).alias("s")).collect()
    parts = got[0].s.split("\n")
    assert len(parts) == langid.STRETCHES and len(got[0].s) <= langid.SAMPLE_CHARS and got[1].s == "short" and got[2].s is None and got[3].s == "x" * 4000
    assert text.startswith(parts[0]) and text.endswith(parts[-1]) and all(p in text for p in parts)
    gaps = np.diff([text.index(p) for p in parts])
    assert gaps.max() - gaps.min() <= 1


# ---- 9 fingerprints ------------------------------------------------------------------------------------------------


def test_likeness_of_very_long_repetitive_texts(spark):
    rows = [(1, "one line of it.\n" * 20_000), (2, "one line of it.\n" * 5_000), (3, ("one line of it.\n" + "quite another one.\n") * 40_000), (4, "quite another one.\n" * 10)]
    by = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert by[1].near_next > 0.999 and by[1].near_edited > 0.999
    assert 0.5 < by[3].near_next < 0.95 and by[2].fingerprint != by[1].fingerprint



def test_texts_without_spaces_and_rows_without_id(spark):
    han = [chr(0x4E00 + k) for k in np.random.default_rng(1).permutation(4000)[:600]]
    a, b = "".join(han[:400]), "".join(han[:200] + han[400:])
    rows = [(1, a), (2, b), (3, "x" * 1_000_000), (3, "x" * 1_000_000), (None, "q"), (None, None), (4, "One two. Three")]
    begin = time.time()
    got = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").withColumn("v", F.lit("clash"))).collect()
    assert len(got) == 7 and time.time() - begin < 120
    by = {r.doc_id: r for r in got}
    assert by[1].near_next > 0.3 and len({r.fingerprint for r in got if r.doc_id == 3}) == 1


# ---- 10 HTML -------------------------------------------------------------------------------------------------------

A = "<p>First paragraph of the article, which is long enough to count as text for readers.</p><p>Second paragraph, with words and more words, as articles have them.</p>"
TEXT = "First paragraph of the article, which is long enough to count as text for readers.\n\nSecond paragraph, with words and more words, as articles have them."


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<body><div class="page has-sidebar">{A}</div></body>', TEXT),
        (f'<div class="layout search-enabled">{A}</div>', TEXT),
        (f'<form id="aspnetForm">{A}</form>', TEXT),
        (f'<svg width="1" />{A}', TEXT),
        (f'<h1>Title here</h1><div class="content">{A}</div>', "Title here\n\n" + TEXT),
        (f"<main><section>{A}</section><section>{A}</section><section>{A}</section></main>", "\n\n".join([TEXT] * 3)),
        (f"<article><header><h1>Head</h1></header>{A}</article>", "Head\n\n" + TEXT),
        (f'<article><div class="article-header"><h1>Head</h1></div>{A}</article>', "Head\n\n" + TEXT),
        (f'<article>{A}</article><div class="comments">{A}{A}{A}</div>', TEXT),
        (f'<header><a href=x>Site</a></header><div id="cookie-notice">We use cookies.</div><div>{A}</div><footer>Imprint</footer>', TEXT),
        ("<p>a &lt;b&gt; c</p>", "a <b> c"),
        ("1 < 2 and no tag at all", "1 < 2 and no tag at all"),
        ('<p title="a>b">quoted</p><a href="', "quoted"),
        ("<p>one<p>two<br>three", "one\n\ntwo three"),
    ],
)
def test_pages(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize("piece", ["<a ", '<a ">"', "<b>", "<p>x", "</span>", "<svg>", "<!--", "<table><tr><td>"])
def test_parsing_is_linear(piece):
    took = []
    for n in (4_000, 32_000):
        begin = time.perf_counter()
        html.main_text(piece * n)
        took.append(time.perf_counter() - begin)
    assert took[1] < 24 * took[0] + 0.5


def test_densities_as_the_formula_gives_them():
    page = "<div><p>plain text of some length here</p><p>with <a href=x>a link</a> inside</p></div><ul><li><a>one</a></li><li><a>two</a></li></ul>"
    root = html.parse(page)
    threshold = html.measure(root)

    def walk(node, linked=False):
        """Characters, tags, and those in links, counted from each node down again."""
        linked = linked or node.tag == "a"
        c = t = lc = lt = 0
        for x in node.children:
            if isinstance(x, str):
                n = len(x.replace(" ", ""))
                c, lc = c + n, lc + n * linked
            else:
                c2, t2, lc2, lt2 = walk(x, linked)
                c, t, lc, lt = c + c2, t + t2 + 1, lc + lc2, lt + lt2 + (x.tag == "a")
        return c, t, lc, lt

    c0, _, lc0, _ = walk(root)
    seen = []
    stack = [(root, False)]
    while stack:
        node, linked = stack.pop()
        c, t, lc, lt = walk(node, linked)
        base = math.log(c / max(c - lc, 1) * lc + lc0 / c0 * c + math.e)
        want = c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1)) / (1 + math.log(base))
        assert math.isclose(node.density, want)
        seen.append(node)
        stack += [(x, linked or node.tag == "a") for x in node.children if not isinstance(x, str)]
    best = max(seen, key=lambda n: n.sum)
    assert best.tag == "div" and root.best is best and threshold == html.REACH * best.density


def _f1(got, want):
    a, b = Counter(got.split()), Counter(want.split())
    return 2 * (a & b).total() / max(a.total() + b.total(), 1)


def _pages(spark, bare):
    """(page, text of its article): bare pages have no names, and div elements for those that say what they are."""
    out = []
    for r in spark.read.parquet(f"{DATA.parent}/sf0.01/pages.parquet").collect():
        root = html.parse("<body>" + re.search(r"(?s)<article>(.*?)</article>", r.html)[1])
        root.keep, page = True, r.html
        if bare:
            page = re.sub(r"</?(?:article|nav|footer|header|main|aside|section)\b[^>]*>", lambda m: "</div>" if m[0][1] == "/" else "<div>", page)
            page = re.sub(r'\s(?:class|id|role)="[^"]*"', "", page)
        out.append((page, "\n\n".join(html.blocks(root))))
    return out


def test_main_text_without_names_and_roles(spark):
    """Density alone finds the article: no class, id or role, and no element that says what it is."""
    scores = [_f1(html.main_text(page), want) for page, want in _pages(spark, True)]
    assert np.mean(scores) >= 0.95 and np.mean([s == 1 for s in scores]) > 0.7
    assert np.mean([html.main_text(page) == want for page, want in _pages(spark, False)]) > 0.98


def test_density_decides(spark, monkeypatch):
    """Without the density step, or with names alone, far fewer bare pages are right; without names few change."""
    bare, named = _pages(spark, True), _pages(spark, False)
    own = np.mean([_f1(html.main_text(page), want) == 1 for page, want in bare])
    with monkeypatch.context() as m:
        m.setattr(html, "mark", lambda root, _: setattr(root, "keep", True))
        assert np.mean([_f1(html.main_text(page), want) == 1 for page, want in bare]) < 0.1 < own
    with monkeypatch.context() as m:
        m.setattr(html, "leave_out", lambda _: None)
        assert np.mean([html.main_text(page) == want for page, want in named]) > 0.7


def test_repeated_pages_and_clashing_text(spark):
    page = "<article><h1>Title</h1><p>Some words of the article that are kept.</p></article>"
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, "u", None)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((r.page_id, r.text, r.n_chars) for r in html.with_main_text(df).collect())
    assert got[0] == got[1] and got[0][1] == "Title\n\nSome words of the article that are kept." and got[2] == (2, "", 0)


# ---- 1, 5, pipeline ------------------------------------------------------------------------------------------------


def test_repeated_rows_and_clashing_names(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, None)], "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    a, b = bpe.with_bpe(df, path, ids=False).collect(), bpe.with_token_counts(df, path).collect()
    assert sorted(r.n_tokens for r in a) == sorted(r.n_tokens for r in b) == [0, 2, 2]
    assert bpe.with_token_counts(df.limit(0), path).count() == 0


def test_stages_take_odd_rows(spark, tmp_path):
    rng = random.Random(5)
    words = "the of and that with from have this which their would there about people water under house".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)) + ".", "en", f"s{i % 3}", 300) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", "en", "s1", 0), (None, "the house of water", "en", "s1", 18), (102, POLISH, "en", "s1", 100), (0, rows[0][1], "en", "s0", 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        out = stage(spark, docs.withColumn("score", F.lit("clash")), str(tmp_path))
        assert out.count() <= len(rows)


def test_pipeline_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_stage_rejects_what_it_has_not_learned(spark):
    """Planted texts of two languages that the table doesn't have go; nearly all of its own texts stay."""
    own = spark.read.parquet(f"{DATA.parent}/sf0.01/documents.parquet").select(*corpus_pipeline.COLUMNS)
    polish = "Wszyscy ludzie rodzą się wolni i równi w swojej godności i swoich prawach. Są obdarzeni rozumem i sumieniem i powinni postępować wobec siebie w duchu braterstwa. "
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. "
    planted = spark.createDataFrame([(10**9 + k, text * 3, None, "planted", 3 * len(text)) for k, text in enumerate((polish, finnish))], own.schema)
    kept = corpus_pipeline.keep_language(spark, own.unionByName(planted), f"{DATA.parent}/sf0.01").select("doc_id", "source").collect()
    assert not [r for r in kept if r.source == "planted"] and len(kept) > 0.98 * own.count()


def test_nearest_with_clashing_names(spark):
    rows = [(i, [float(i % 7), float(i % 3), 1.0], "q", 0, -1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id string, rank int, score double")
    got = ann.search(df, F.col("vec_id") % 20 == 0)
    assert got.columns[:4] == ["query_id", "rank", "vec_id", "score"] and got.where("query_id = 20").count() == 20
