"""Operator 11: counts against plain Python, estimates against concentration steps in memory, labelled rows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quire.llm import outliers, registry

from ..conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(t):
    t = t or ""
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    met = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {j for i in range(len(w) - 7) if met[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    stops, upper = sum(c in '.,;:!?"' for c in t), len(re.findall("[A-ZÀ-ÖØ-Þ]", t))
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), len(lines), len(set(w)), upper, stops]


ODD = ["", " \n\t\x0b\x0c\r ", "a", "a\na\n a\na\r\n\n\na", "x " * 7, "x " * 8, "x " * 9, "one two three four five six seven eight " * 2, "a b c d e f g h A b c d e f g h", "ÄÖ×÷ß # <b>&amp;</b> | 日本語。\n日本語。\n", "\n".join(["line of words"] * 50), "w" * 100_000, "z y z y", "long words and more " * 30_000]


def test_counts_as_plain_ones():
    for texts in (ODD, ODD[::-1], [ODD[1]], [ODD[0]], [], ["b c d e f g h i", "b c d e f g h i"], ["a\n", "a\n"]):
        got = outliers.counts(pa.array(texts, pa.string()))
        assert got.tolist() == [plain(t) for t in texts]


def test_stretches_hash_alike(monkeypatch):
    whole = outliers.counts(pa.array(ODD, pa.string())).tolist()
    monkeypatch.setattr(outliers, "CHUNK_BYTES", 5)
    assert outliers.counts(pa.array(ODD[:-1], pa.string())).tolist() == whole[:-1]


def concentrated(rows, steps=outliers.STEPS):
    """rows: lang, source, vector, passed. Squared distances by the same steps, all in memory."""
    p, spread, share, shrink = outliers.P, np.diag(np.square(outliers.SPREAD)), outliers.COVER, outliers.SHRINK
    groups, langs = defaultdict(list), defaultdict(list)
    for lang, source, x, passed in rows:
        if passed:
            groups[lang, source].append(x)
            langs[lang].append(x)
    groups = {g: np.array(v) for g, v in groups.items()}
    model = {}
    for g in groups:
        q = np.quantile(np.array(langs[g[0]]), [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
        model[g] = (q[1], np.linalg.inv(np.diag(((q[2] - q[0]) / 1.349) ** 2) + spread), 1.0)
    far = lambda x, m: np.einsum("ij,jk,ik->i", x - m[0], m[1], x - m[0])
    for _ in range(steps):
        near, cut = {}, {}
        for g, x in groups.items():
            b = np.floor(8 * np.log2(np.maximum(far(x, model[g]), 1e-9)))
            last = np.sort(b)[int(np.ceil(share * len(b))) - 1]
            near[g], cut[g] = x[b <= last], 2 ** ((last + 1) / 8)
        moments = lambda x: (len(x), x.mean(0), np.cov(x.T, bias=True).reshape(p, p))

        def drawn(own, above):
            part = own[0] / (own[0] + shrink)
            return own[0], part * own[1] + (1 - part) * above[1], part * own[2] + (1 - part) * above[2]

        top = moments(np.concatenate(list(near.values())))
        mid = {lang: drawn(moments(np.concatenate([x for g, x in near.items() if g[0] == lang])), top) for lang in {g[0] for g in near}}
        for g, x in near.items():
            _, mean, cov = drawn(moments(x), mid[g[0]])
            model[g] = (mean, np.linalg.inv(cov + spread), max(1.0, cut[g] / outliers.chi2(share)))
    return [far(np.array([x]), model[lang, source])[0] / model[lang, source][2] if (lang, source) in model else None for lang, source, x, _ in rows]


def test_distances_as_steps_in_memory_give_them(spark):
    d = str(DATA.parent / "sf0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    got = {r.doc_id: r for r in registry.op11_outliers(spark, d).collect()}
    assert set(got) == set(rows)
    base = {i: plain(r.text) for i, r in rows.items()}
    x = {i: [np.log((c[1] + 100) / (c[0] + 20)), *np.sqrt([c[2] / (c[1] + 100), c[7] / (c[1] + 100), c[8] / (c[1] + 100), c[3] / (c[5] + 10), c[4] / (c[0] + 20)]), np.log(c[6] + 1) / np.log(c[0] + 2)] for i, c in base.items()}
    passed = {i: not (c[0] < 20 or 100 * c[4] > 30 * c[0]) for i, c in base.items()}
    want = concentrated([(r.lang or "", r.source or "", x[i], passed[i]) for i, r in rows.items()])
    for i, far in zip(rows, want, strict=True):
        g = got[i]
        assert [g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words] == base[i][:5] and g.base_failed == (not passed[i])
        assert (g.distance is None) == (far is None) and (far is None or np.isclose(g.distance, far, rtol=0.05))
        assert g.kept == (passed[i] and g.distance <= outliers.chi2(1 - outliers.TAIL))


def test_labelled_rows(spark):
    """Texts of label 1 that pass the base rules stay, those of label 0 go."""
    d = str(DATA.parent / "sf0.01")
    rows = registry.op11_outliers(spark, d).where("NOT base_failed").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    share = {r.quality: r.kept for r in rows.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] == 1.0 and share[0] < 0.1


def test_small_groups_nulls_and_repeats(spark):
    prose = "Some plain words stand here, and others follow them in the same way, so that nothing of it is odd at all. "
    texts = [(i, prose + f"Number {i} says more. ", "en" if i % 2 else None, "s" if i % 3 else None) for i in range(60)]
    rows = [*texts, (100, None, "en", "s"), (101, "", None, None), (None, prose, "en", "s"), (None, prose, "en", "s"), (102, "# $ % & | < > * " * 9 + prose, "en", "s"), (103, prose, "xx", "lone"), (104, "word", "yy", "failed"), (0, texts[0][1], None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("kept", F.lit("clash")).withColumn("d2", F.lit("clash"))
    got = outliers.verdicts(df).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert len(got) == len(rows) and len(by[None]) == len(by[0]) == 2 and by[0][0] == by[0][1]
    assert all(r.kept for i in [*range(60), None, 103] for r in by[i])
    assert not any(r.kept for i in (100, 101, 102, 104) for r in by[i]) and by[104][0].distance is None and by[102][0].distance > 50
    assert outliers.verdicts(df.limit(0)).count() == 0 and not any(r.kept for r in outliers.verdicts(df.where("doc_id = 104")).collect())


def test_one_contaminated_group_moves_no_bound(spark):
    """A fifth of a group's rows lie together far off: they go, the others stay."""
    rng = random.Random(1)
    words = ["".join(rng.choices("etaoinsr", k=rng.randint(2, 8))) for _ in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=40 + i % 90)) + "." + (" A | B & C #" * 2).join(rng.choices(words, k=0 if i % 5 else 12)), "en", "s") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    odd = [r for r in outliers.verdicts(df).collect() if not r.base_failed]
    assert odd and all(r.kept == bool(r.doc_id % 5) for r in odd)
