"""Column functions over text against written-out answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quire.functions import citations
from quire.functions import text as T


def each(spark, f, said):
    df = spark.createDataFrame(list(enumerate(said)), "i int, t string")
    return [r[1] for r in sorted(df.select("i", f(F.col("t")).alias("v")).collect(), key=lambda r: r[0])]


def test_addresses(spark):
    yes = ["https://x.com/some-article", "10.1234/abc-def", "a-b@x.com", "www.broken-windows.org", "/usr/some-bin", "report-final.pdf", "bbc.co.uk", "../up", "C:\\x", "mailto:me"]
    no = ["inequality/stratification", "and/or", "sentence.Next", "COVID-19", "plain", "10.12/x"]
    assert each(spark, T.urlish, [*yes, *no]) == [True] * len(yes) + [False] * len(no)


def test_page_numbers(spark):
    said = ["Page 12", "see p. 3", "pp. 4-5", "Seite 7 von 9", "página ٤", "стр. 8", "ページ 9", "chapter 4", "stop. 5", None]
    assert each(spark, T.page_number, said) == [12, 3, 4, 7, 4, 8, 9, None, None, None]


def test_normal_forms(spark):
    assert each(spark, T.normalize_title, ["  Über: das Leben! ", "A-B  c", None]) == ["uber  das leben", "a b  c", None]
    assert each(spark, T.normalize_search, ["Éclair, 2nd!", "a--b"]) == ["eclair 2nd", "a b"]
    assert each(spark, T.canonical_tag, [" “To  Read” ", "to\u00a0do"]) == ['"to read"', "to do"]
    assert each(spark, T.strip_marks, ["Ångström", "Ἀθῆναι"]) == ["Angstrom", "Αθηναι"]


def test_hashes(spark):
    """FNV-1a of 'a' and of nothing are published values."""
    assert each(spark, T.fnv1a, ["a", "foobar"]) == [0xE40C292C, 0xBF9CF968]


def test_errors(spark):
    assert each(spark, T.sanitize_error, ["no such file /home/me/x/y.txt", "e" * 400]) == ["no such file <path>", "e" * 300 + "..."]


@pytest.mark.parametrize(
    "attrs, want",
    [
        ({"id": "u-ABC"}, ("item", "u-ABC", None, None)), ({"item_id": "g12-K", "loc": "p3"}, ("item", "g12-K", "p3", None)), ({"att_id": "user-content-5-K", "sid": "s1"}, ("item", "5-K", "s1", None)),
        ({"id": "ext-ab12cd34"}, ("file", "AB12CD34", None, None)), ({"external_id": "doi:1", "page": "4"}, ("external", "doi:1", "4", None)), ({"id": "u-A", "external_id": "x"}, (None, None, None, "conflicting_identity")),
        ({"id": "0-K"}, (None, None, None, "invalid_item_id")), ({"external_id": "  "}, (None, None, None, "invalid_external_id")), ({"loc": "s1"}, (None, None, None, "missing_identity")),
    ],
)
def test_citations(spark, attrs, want):
    assert tuple(spark.createDataFrame([(attrs,)], "a map<string, string>").select(citations.reference(F.col("a")).alias("r")).first().r) == want


def test_rewrites(spark):
    df = spark.createDataFrame([("a" * 599, ""), ("abcdef" * 100, "abcdef" * 70), ("abcdef" * 100, "uvwxyz" * 100), ("abcdef" * 100, "abcdef" * 90)], "old string, new string")
    assert [r[0] for r in df.select(T.rewrite_reason("old", "new")).collect()] == [None, "shrunk", "replaced", None]
