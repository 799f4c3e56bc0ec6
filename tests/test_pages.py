"""Sentences, HTML, edits, matching and markers against written-out answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quire.functions import dom
from quire.functions import sentences as S
from quire.operators import entities as E
from quire.operators import matching as M


def each(spark, f, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[1] for r in sorted(df.select("i", f(F.col("t")).alias("v")).collect())]


@pytest.mark.parametrize(
    "text, want",
    [
        ("One. Two! Three? Four", ["One.", "Two!", "Three?", "Four"]),
        ("Written by Marvin A. Sweeney in vol. 2 of it. Next one.", ["Written by Marvin A. Sweeney in vol. 2 of it.", "Next one."]),
        ("The sample size was 42. It grew.", ["The sample size was 42.", "It grew."]),
        ("1. First point. 2. Second point.", ["1. First point.", "2. Second point."]),
        ("See Dr. B. Smith et al. for more... Then stop.", ["See Dr. B. Smith et al. for more...", "Then stop."]),
        ("  spaces \n and lines.\n\nEnd ", ["spaces and lines.", "End"]),
        ("1. 2. 3. Three", ["1. 2.", "3. Three"]),
        ("0 of them came in 2010", ["0 of them came in 2010"]),
        ("One came. 1 of them left in 1991", ["One came.", "1 of them left in 1991"]),
        ("", []),
        (None, []),
    ],
)
def test_split(spark, text, want):
    assert each(spark, S.sentences_regex, [text]) == [want]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Here. Figure 1. The map shows it. End.", ["Here.", "Figure 1. The map shows it.", "End."]),
        ("As said. Abbildung 12. Tabelle 3. Beides.", ["As said.", "Abbildung 12. Tabelle 3. Beides."]),
        ("It had 1413. 74 kt of it. Good.", ["It had 1413. 74 kt of it.", "Good."]),
        ("He said so. ]. Then went.", ["He said so. ].", "Then went."]),
        ("Three things: (1) The first. (2) The second.", ["Three things:", "(1) The first.", "(2) The second."]),
        ("Wait . . . and go. Done.", ["Wait . . . and go.", "Done."]),
        (". Bullet text here. More.", ["Bullet text here.", "More."]),
        ("Ends in Figure 1.", ["Ends in Figure 1."]),
    ],
)
def test_put_right(spark, text, want):
    assert each(spark, S.sentences, [text]) == [want]


def test_other_scripts(spark):
    assert each(spark, S.sentences_simple, ["見た。聞いた。end. next"]) == [["見た。", "聞いた。", "end.", "next"]]


PAGE = """<html><head><title>no</title><style>p{}</style></head><body><h1>Head</h1>loose <b>text</b><p>one<p>two &amp; <script>var a="</p>";</script>three
<ul><li>a<li>b</ul><table><caption>Cap</caption><tr><th>x<th>y</tr><tr><td>1</td><td></td></tr><tr><td></td><td> </td></tr><tr><td><table><tr><td>in<td>ner</table></td><td>3</td></tr></table><noscript><p>hidden</p></noscript>"""


def test_page(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "i int, h string")
    rows = {r.i: r for r in df.select("i", dom.items("h").alias("items"), dom.table_rows("h").alias("rows"), dom.visible_text("h").alias("text")).collect()}
    got = [(x.kind, x.text) for x in rows[1]["items"]]
    assert got == [("heading", "Head"), ("p", "loose text"), ("p", "one"), ("p", "two & three"), ("list", "a"), ("list", "b"), ("table", "Cap\nx | y\n1 | \nin ner | 3")]
    assert rows[1].rows == [["x | y", "1 | ", "in ner | 3"]]
    assert rows[1].text.startswith("Headloose textonetwo & three ab") and "hidden" not in rows[1].text and "var" not in rows[1].text
    assert rows[2]["items"] == [] and rows[2].text is None and rows[3].text == ""


def test_layout_tables_are_walked(spark):
    page = f"<table><tr><td>{'long words ' * 30}</td><td>side</td></tr></table>"
    df = spark.createDataFrame([(page,)], "h string")
    assert [x.kind for x in df.select(dom.items("h").alias("v")).first().v] == ["p", "p"]


def test_cleaning(spark):
    page = '<head><BASE href="x"><meta http-equiv="Content-Security-Policy" content="a"><meta charset=utf-8></head><noscript>\n<p>x</p></noscript ><p>y'
    assert each(spark, dom.clean, [page]) == ["<head><meta charset=utf-8></head><p>y"]


def test_edits(spark):
    df = spark.createDataFrame([("abcdef", [(0, 1, "X"), (2, 4, ""), (6, 6, "!!")]), ("abc", []), ("é🙂z", [(1, 2, "ok")])], "t string, e array<struct<start: int, end: int, new: string>>")
    got = df.select(M.edited(F.col("t"), F.col("e")).alias("t"), M.moved(F.col("e")).alias("m")).collect()
    assert [r.t for r in got] == ["Xbef!!", "abc", "éokz"]
    assert [(m.start, m.end) for m in got[0].m] == [(0, 1), (2, 2), (4, 6)]


@pytest.mark.parametrize(
    "text, quote, want",
    [
        ("plain words", "plain", "exact"), ("a < b", "a &lt; b", "entity_decoded"), ("a &lt; b", "a < b", "entity_encoded"), ("it’s", "it's", "quotes"), ("end", "end\n", "trailing_newline"),
        ("two\nlines", "two\\nlines", "json_unescaped"), ("two  lines", "two lines", "relaxed_space"), ("none", "other", None),
    ],
)
def test_ways_to_find_a_quotation(spark, text, quote, want):
    df = spark.createDataFrame([(text, quote)], "t string, q string")
    assert df.select(M.match_range("t", "q")["way"]).first()[0] == want


def test_references(spark):
    rows = [
        (1, "a", 2000, None, ["x"]), (2, "a", 2001, None, ["y", "x"]), (3, "a", 2003, None, ["x"]), (4, "a", None, "d1", ["x"]), (5, "a", None, "d2", ["x"]), (6, "a", None, None, None),
        (7, "b", None, None, ["x"]), (8, "a", None, None, []),
    ]
    got = {r.id: r.found for r in M.first_match(spark.createDataFrame(rows, "id int, title string, year int, doi string, creators array<string>")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 1, 6: 6, 7: 7, 8: 6}


def test_usage_of_chains(spark):
    runs = spark.createDataFrame([("a", (1, None), 0.5), ("a", None, None), ("a", (2, 3), None), ("b", None, None)], "chain string, usage struct<requests: long, tokens: long>, cost double")
    got = {r.chain: tuple(r)[1:] for r in E.chain_usage(runs, ["requests", "tokens"]).collect()}
    assert got == {"a": (3, 3, 0.5), "b": (None, None, None)}


def test_closure_ends_in_cycles_and_has_no_depth_limit(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(12)] + [("n12", "n0")], "parent string, child string")
    got = {r.node: r.depth for r in E.closure(edges, spark.createDataFrame([("n0",)], "root string")).collect()}
    assert got == {f"n{i}": i for i in range(13)}


def test_duplicate_classes(spark):
    rows = [(i, "t", "x", 2000, None) for i in range(1, 5)] + [(9, "t", "x", 2001, None), (10, "t", "x", 2005, None)]
    got = sorted(tuple(r) for r in E.duplicate_pairs(spark.createDataFrame(rows, "id int, type string, title string, year int, doi string")).collect())
    assert got == [(1, 2), (1, 3), (1, 4), (1, 9)]


#: Texts that were cut within a reference, and references of every form.
CUT = ["<html><head><title>a &amp; b</title></head><body><h1>Far&amp</h1><p>one &lt two &lt;b&gt; &am</p></body></html>", "<html><head><title>t&amp</title></head><body><p>x &#39;y&#x27; &copy z & w</p></body></html>", None]


@pytest.fixture(scope="module")
def cut_pages(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cut"))
    spark.createDataFrame([(k, h) for k, h in enumerate(CUT)], "page_id bigint, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    return path


def _as_sql(spark, duck, path, name):
    from quire.plans import catalog

    asked = duck.execute(catalog.oracle_sql()[name].replace("FROM pages", f"FROM '{path}/pages.parquet/*.parquet'"))
    names = [c[0] for c in asked.description]
    got = [tuple(r[c] for c in names) for r in catalog.queries()[name](spark, path).collect()]
    assert sorted(got, key=repr) == sorted(asked.fetchall(), key=repr)


def test_visible_text_of_references_without_semicolon_is_that_of_sql(spark, duck, cut_pages):
    _as_sql(spark, duck, cut_pages, "visible_text")


@pytest.mark.parametrize("name", ["section_label", "text_coverage", "synthetic_pages", "citation_index", "dom_items", "dom_kind"])
def test_sections_of_references_without_semicolon_are_those_of_sql(spark, duck, cut_pages, name):
    _as_sql(spark, duck, cut_pages, name)
