"""Edits of long texts, suggestions against all pairs, scores of page markers."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from quire.operators import matching as M
from quire.plans import pages, pdf

EDITS = "text string, edits array<struct<start: int, end: int, new: string>>"


def test_edits_keep_their_places(spark):
    rows = [("abcdef", [(1, 2, "XX"), (2, 2, "+"), (4, 6, "")]), ("é日本", [(1, 3, "nihon")]), ("same", []), ("none", None), (None, [(0, 0, "x")]), ("", [(0, 0, "new")])]
    df = spark.createDataFrame(rows, EDITS)
    got = df.select(M.edited("text", "edits").alias("t"), M.moved("edits").alias("m")).collect()
    assert [r.t for r in got] == ["aXX+cd", "énihon", "same", "none", None, "new"]
    for (text, edits), r in zip(rows, got, strict=True):
        if text is not None and edits:
            assert [r.t[m.start : m.end] for m in r.m] == [new for _, _, new in edits]


def test_long_texts_are_edited_and_set_in_seconds(spark, tmp_path):
    """20,000 lines, and one text of a million characters: work grows with the text, not with its square."""
    begin = time.monotonic()
    spark.createDataFrame([(1, "twelve chars\n" * 20_000)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = pages.apply_edits(spark, str(tmp_path)).first()
    assert got.edits == 20_000 and got.text == "<tw>!ve chars\n" * 20_000
    spark.createDataFrame([(1, "0123456789" * 100_000)], "doc_id long, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert pdf._spans(spark, f"{tmp_path}/b").where("i >= 0").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("c")).first() == (25_000, 1_000_000)
    assert time.monotonic() - begin < 60


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def suggested(needle, names):
    n, out = needle.lower(), []
    if not n:
        return []
    most = 1 if len(n) <= 4 else min(3, len(n) // 3)
    for name in {x for x in names if x is not None}:
        t = name.lower()
        if t == n:
            continue
        d = 0 if len(n) >= 3 and (n in t or t in n) else distance(n, t)
        if t == "" and d == 0:
            continue  # an empty name is held by everything
        if d <= most:
            out.append((d, abs(len(t) - len(n)), name))
    return [(k, name, d) for k, (d, _, name) in enumerate(sorted(out)[:3], 1)]


@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_suggestions_as_all_pairs_give_them(spark, letters):
    rng = random.Random(len(letters))
    word = lambda: "".join(rng.choices(letters, k=rng.choice([1, 2, 3, 4, 5, 6, 7, 9, 12, 15])))
    names = [*{word() for _ in range(80)}, "Economics", "economics", "Wirtschaft", "a", "é", None]
    asked = [*{word() for _ in range(60)}, "Econimics", "econ", "ECONOMICS of it", "x", "", None, *[n[:2] + "zz" + n[3:] for n in names if n and len(n) > 8][:20]]
    got = {}
    for r in M.suggestions(spark.createDataFrame([(x,) for x in asked], "needle string"), spark.createDataFrame([(x,) for x in names * 2], "name string")).collect():
        got.setdefault(r.needle, []).append((r.rank, r.name, r.distance))
    assert {k: sorted(v) for k, v in got.items()} == {n: s for n in asked if n and (s := suggested(n, names))}


def test_bounded_distance_stops(spark):
    rows = [("abc", "abd", 1), ("abc", "xyz", 1), ("abc", "abc", 2), ("kitten", "sitting", 2), ("kitten", "sitting", 3)]
    for a, b, most in rows:
        assert spark.range(1).select(M.bounded_distance(F.lit(a), F.lit(b), most).alias("d")).first().d == min(distance(a, b), most + 1)


def scores(spark, by, total):
    """by: labels of each matcher, one for each section."""
    rows = [("d", m, i, 0, label) for m, labels in enumerate(by) for i, label in enumerate(labels) if label is not None]
    df = spark.createDataFrame(rows, "doc string, matcher int, section int, offset int, label string")
    r = M.page_markers(df, spark.createDataFrame([("d", total)], "doc string, total int")).first()
    return r and (r.matcher, r.markers, r.score)


@pytest.mark.parametrize(
    "labels, want",
    [
        (["1", "2", "3", "4"], 4.0),
        (["1", "3", "2", "4"], 1.0),  # falls
        (["1", "2", "9", "10"], 2.0),  # skips
        (["1", "9", "2", "3"], 2.0),  # skips before it falls
        (["5", "2", "9", "10"], 1.0),  # falls before it skips
        (["1", "2", "2", "3"], 2.0),  # a number again
        (["1", "3", "1", "4"], 0.5),  # falls, and a number again
        (["ii", "iii", "iv", "v"], 4.0),
        (["ii", "iii", "ii", "iii"], None),  # no number again
        (["x", "y", "x", "z"], 2.0),  # one sign only
        (["4a", "5a", "6b", "7"], 4.0),
        (["1", None, None, None], None),  # in a quarter of the sections
    ],
)
def test_penalties_of_page_markers(spark, labels, want):
    got = scores(spark, [labels], 4)
    assert (got and got[2]) == want


def test_best_matcher_has_most_markers(spark):
    few, many = ["1", "2", "3", None, None, None], ["9", "8", "7", "6", "5", None]
    assert scores(spark, [few, many], 6) == (1, 5, 1.25)
    assert scores(spark, [few, few], 6) == (0, 3, 3.0)
    assert scores(spark, [many, ["aa", "aa", "bb", "cc", "dd", "ee"]], 6) == (0, 5, 1.25)


NOTE = 'He said: “Yes”, &amp; left.\nTwo  words&nbsp;here <p>plain</p> <h2>Head</h2> <strong>bold</strong> and <em>soft</em> (1) end, <p><em>x</em> y</p> &quot;q&quot; a < b'


@pytest.mark.parametrize(
    "quote, way, found",
    [
        ("said: “Yes”", "exact", "said: “Yes”"),
        ("&lt; b", "entity_decoded", "< b"),
        ("& left", "entity_encoded", "&amp; left"),
        ("（1） end", "nfkc", "(1) end"),
        ('said: "Yes"', "quotes", "said: “Yes”"),
        ("left.\n\n", "trailing_newline", "left."),
        ("left.\\nTwo", "json_unescaped", "left.\nTwo"),
        ('span class="x">plain</p', "partial_element", "plain"),
        ("<div>plain</div>", "spurious_wrap", "plain"),
        ('<p class="x">plain</p>', "tag_attributes", "<p>plain</p>"),
        ("## Head", "markdown", "<h2>Head</h2>"),
        ("**bold** and", "markdown", "<strong>bold</strong> and"),
        ("Two words here", "relaxed_space", "Two  words&nbsp;here"),
        ("*x* y", "markdown_rendered", "<p><em>x</em> y</p>"),
        ("not there", None, None),
        ("", None, None),
    ],
)
def test_every_way_gives_a_range_of_the_text(quote, way, found):
    got = M.located(NOTE, quote)
    assert (got and got[0]) == way
    assert found is None or [NOTE[a:b] for a, b in got[1]][0] == found


def test_rewritten_texts_know_where_they_came_from():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choices("ab \n&nbsp;“", k=rng.randint(0, 30)))
        form = M.Form(text).rewritten(r"(?:\s|&nbsp;)+", " ").rewritten("[“]", '"').rewritten("aa", "A")
        for k in range(len(form.text)):
            (a, b), *_ = [r for r in form.ranges(form.text[k : k + 1])]
            assert M.Form(text[a:b]).rewritten(r"(?:\s|&nbsp;)+", " ").rewritten("[“]", '"').rewritten("aa", "A").text == form.text[k]
    assert M.Form("a a a").ranges("a") == [(0, 1), (2, 3), (4, 5)] and M.Form("aaa").ranges("aa") == [(0, 2)] and M.Form("a").ranges("") == []


def test_ranges_of_rows(spark):
    rows = [("x  y x y", "x y"), (None, "x"), ("x", None), ("a x\ny x y", "x  y")]
    got = [tuple(r.m) for r in spark.createDataFrame(rows, "t string, q string").select(M.match_range("t", "q").alias("m")).collect()]
    assert got == [("exact", 5, 8, 1), (None,) * 4, (None,) * 4, ("relaxed_space", 2, 5, 2)]
