"""Documents of sections against written-out answers and a plain walk."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import dom
from quire.operators import sections as X
from quire.plans import catalog

from .conftest import DATA

PAGES = [
    ("a", 0, "<title>Book</title><body><h1>One <b>more</b></h1><p>First. Second.</p><ul><li>item</ul>"),
    ("a", 1, "<head><title> Book\n two </title></head><body><h2> </h2><h3>late</h3><p>Third.<table><tr><th>x<th>y<tr><td>1<td>2</table><p>Last"),
    ("a", 2, None),
    ("a", 3, "<p>only"),
    ("b", 0, ""),
    ("b", 7, "<style>p{}</style><script>var x = '<h1>';</script>"),
]


@pytest.fixture(scope="module")
def read(spark):
    return X.parsed(spark.createDataFrame(PAGES, "doc string, section int, html string"), interval=10)


def test_labels(read):
    got = {(r.doc, r.section): r.label for r in X.labels(read).collect()}
    assert got == {("a", 0): "One more", ("a", 1): "Book two", ("a", 2): None, ("a", 3): None, ("b", 0): None, ("b", 7): None}


def test_ids_go_on_over_sections(read):
    got = [(r.section, r.id, r.kind, r.text, [(s.id, s.text) for s in r.sentences]) for r in X.items(read).orderBy("section", "pos").collect()]
    assert got == [
        (0, "heading1", "heading", "One more", []),
        (0, "p1", "p", "First. Second.", [("s1", "First."), ("s2", "Second.")]),
        (0, "list1", "list", "item", [("s3", "item")]),
        (1, "heading2", "heading", "late", []),
        (1, "p2", "p", "Third.", [("s4", "Third.")]),
        (1, "table1", "table", "x | y\n1 | 2", [("s5", "x | y"), ("s6", "1 | 2")]),
        (1, "p3", "p", "Last", [("s7", "Last")]),
        (3, "p4", "p", "only", [("s8", "only")]),
    ]


def test_pages(read):
    """Section 0: texts of 4, 4, 14 and 4 characters; six of the third end the first page, and its other
    eight do not count."""
    got = sorted((r.section, r.offset, r.label) for r in X.markers(read).where("doc = 'a'").collect())
    assert got == [(0, 0, 1), (0, 14, 2), (1, 0, 3), (1, 14, 4), (3, 0, 5)]
    page = {r.id: r.page for r in X.items(read).collect()}
    assert page == {"heading1": 1, "p1": 1, "list1": 2, "heading2": 3, "p2": 3, "table1": 3, "p3": 4, "p4": 5}


def test_breaks_against_a_walk_by_characters():
    rng = random.Random(5)
    for _ in range(300):
        sizes, interval = [rng.randint(1, 40) for _ in range(rng.randint(0, 12))], rng.randint(1, 30)
        want, left, offset, nodes = [], 0, 0, []
        for size in sizes:
            nodes.append((offset, size))
            broke = False
            for k in range(size):
                if left == 0:
                    want.append(offset + k)
                    left, broke = interval, True
                left -= 1
            offset += size
            left = interval if broke else left
        assert dom.breaks(nodes, interval) == want


def test_index_resolves_items_and_sentences(spark, read):
    index = X.citation_index(X.items(read))
    assert index.groupBy("doc", "id").count().where("count > 1").count() == 0
    asked = spark.createDataFrame([("a", "p2"), ("a", "s6"), ("a", "s99"), ("b", "p1"), ("a", None)], "doc string, id string")
    got = {(r.doc, r.id): (r.kind, r.section, r.item, r.sentence) for r in X.resolved(index, asked).collect()}
    assert got == {("a", "p2"): ("item", 1, "p2", None), ("a", "s6"): ("sentence", 1, "table1", "s6"), ("a", "s99"): (None,) * 4, ("b", "p1"): (None,) * 4, ("a", None): (None,) * 4}


def test_coverage(read):
    got = {r.doc: (r.extracted, r.source, r.coverage) for r in X.coverage(read).collect()}
    assert got["b"] == (0, 0, None)
    n, source = 8 + 14 + 4 + 4 + 6 + 11 + 4 + 4, len("One moreFirst. Second.item") + len("lateThird.xy12Last") + 4
    assert got["a"] == (n, source, round(n / source, 3))


def test_splitter_can_be_chosen(read):
    from pyspark.sql import functions as F

    got = {r.id: [s.text for s in r.sentences] for r in X.items(read, lambda c: F.split(c, " ")).collect()}
    assert got["p1"] == ["First.", "Second."] and got["table1"] == ["x | y", "1 | 2"] and got["heading1"] == []


def test_empty_table(spark):
    read = X.parsed(spark.createDataFrame([], "doc string, section int, html string"))
    assert [f(read).count() for f in (X.labels, X.markers, X.items, X.coverage)] == [0] * 4


@pytest.mark.parametrize("name", ["dom_items", "html_extract", "synthetic_pages", "snippet_candidates", "apply_edits"])
def test_workers_get_few_rows_at_once(spark, name):
    """A worker's memory follows the rows of its batches, which must not grow with the table."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "10000")
    try:
        catalog.queries()[name](spark, str(DATA))
        rows = spark.range(0, 3000, 1, 1).select(F.pandas_udf(lambda x: x * 0 + len(x), "long")("id").alias("n"))
        assert rows.agg(F.max("n")).first()[0] <= 500
    finally:
        spark.conf.set(setting, before)
