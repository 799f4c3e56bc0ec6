"""Page layout against written-out pages."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import layout as L

SPANS = "doc long, page long, i int, x0 double, y0 double, x1 double, y1 double, text string"


def span(i, x, y, text, page=0, width=100):
    return (1, page, i, float(x), float(y), float(x + width), float(y + 10), text)


def test_spans_of_a_band_are_lines_parted_at_wide_gaps(spark):
    rows = [span(0, 50, 100, "a"), span(1, 152, 102, "b"), span(2, 320, 99, "far"), span(3, 50, 114, "next"), span(4, 50, 100, "p2", 1)]
    got = sorted((r.page, r.line, r.text) for r in L.lines(spark.createDataFrame(rows, SPANS)).collect())
    assert got == [(0, 0, "a b"), (0, 1, "far"), (0, 2, "next"), (1, 0, "p2")]


def test_columns_and_reading_order(spark):
    spans = [span(k, 50 if k % 2 == 0 else 300, 100 + 14 * (k // 2), f"{k}") for k in range(6)] + [span(9, 50, 60, "title", width=350)]
    rows = L.lines(spark.createDataFrame(spans, SPANS))
    text = {r.line: r.text for r in rows.collect()}
    assert sorted((r.col, r.x0, r.lines) for r in L.columns(rows).collect()) == [(0, 50, 1), (1, 50, 3), (2, 300, 3)]  # the title bridges both columns
    order = [text[r.line] for r in sorted(L.xy_cut(rows).collect(), key=lambda r: r.place)]
    assert order == ["title", "0", "2", "4", "1", "3", "5"]


def test_wide_boxes_part_columns_above_and_below():
    two = lambda y, n: [(50, y + 12 * k, 150, y + 12 * k + 10, n + k) for k in range(3)] + [(250, y + 12 * k, 350, y + 12 * k + 10, n + 10 + k) for k in range(3)]
    figure = (50, 137, 350, 160, 99)
    got = [[b[4] for b in g] for g in L.column_boxes([*two(100, 0), figure, *two(163, 20)])]
    assert got == [[0, 1, 2], [10, 11, 12], [99], [20, 21, 22], [30, 31, 32]]
    assert len(L.column_boxes([(50, 100 + 12 * k, 150 if k % 3 else 90, 110 + 12 * k, k) for k in range(9)])) == 1  # ragged lines are one column


def test_shaded_box_across_columns_is_read_once_and_in_place(spark):
    """Two columns, and below their first lines a box over both: without it the order would go down the left column
    through the box. The lines of the box stand in two columns of their own."""
    spans = [span(0, 50, 100, "a1"), span(1, 300, 100, "b1"), span(2, 50, 112, "a2"), span(3, 300, 112, "b2")]
    spans += [span(10, 50, 140, "z1"), span(11, 300, 140, "z3"), span(12, 50, 152, "z2"), span(13, 300, 152, "z4")]
    spans += [span(20, 50, 180, "c1"), span(21, 300, 180, "d1"), span(22, 50, 192, "c2"), span(23, 300, 192, "d2")]
    rows = L.lines(spark.createDataFrame(spans + [span(30, 50, 100, "alone", page=1)], SPANS))
    text = {(r.page, r.line): r.text for r in rows.collect()}
    zones = spark.createDataFrame([(1, 0, 40.0, 135.0, 410.0, 168.0), (1, 5, 0.0, 0.0, 1.0, 1.0)], "doc long, page long, x0 double, y0 double, x1 double, y1 double")
    said = lambda z: [text[r.page, r.line] for r in sorted(L.xy_cut(rows, z).collect(), key=lambda r: (r.page, r.place))]
    assert said(None) == ["a1", "a2", "z1", "z2", "c1", "c2", "b1", "b2", "z3", "z4", "d1", "d2", "alone"]
    assert said(zones) == ["a1", "a2", "b1", "b2", "z1", "z2", "z3", "z4", "c1", "c2", "d1", "d2", "alone"]


STYLED = "doc long, page long, i int, x0 double, y0 double, x1 double, y1 double, text string, size double, font string, bold boolean, italic boolean"


def styled(i, x, y, text, page=0, size=10.0, font="A", bold=False, italic=False, width=None, doc=1):
    return (doc, page, i, float(x), float(y), float(x + (width or 5 * len(text))), float(y + size), text, size, font, bold, italic)


def test_overlapping_lines_are_one_until_none_overlap(spark):
    """A superscript and a subscript join their line; a letter three lines high and more does not."""
    rows = [styled(0, 100, 100, "E = mc"), styled(1, 131, 96.5, "2", size=8.0), styled(2, 138, 104, "i", size=6.0), styled(3, 100, 114, "next line"), styled(4, 60, 88, "D", size=42.0, width=30), styled(5, 100, 128, "last")]
    got = sorted((r.line, r.text, r.y0, r.y1) for r in L.lines(spark.createDataFrame(rows, STYLED)).collect())
    assert sorted(t for _, t, _, _ in got) == ["D", "E = mc 2 i", "last", "next line"]
    assert next(g for g in got if g[1].startswith("E"))[2:] == (96.5, 110)


def test_merged_lines_as_a_fixpoint_over_all_pairs():
    """Small random pages: afterwards no two lines overlap so that they would be one, and no span is lost."""
    rng = random.Random(2)
    for _ in range(200):
        spans = [{"x0": float(x), "y0": float(y), "x1": float(x + rng.randint(5, 40)), "y1": float(y + h), "i": k} for k, (x, y, h) in enumerate((rng.randint(0, 60), rng.randint(0, 60), rng.choice([4, 8, 10, 40])) for _ in range(rng.randint(1, 9)))]
        got = L.merged_lines([[s] for s in spans])
        assert sorted(s["i"] for g in got for s in g) == list(range(len(spans)))
        box = [(min(s["x0"] for s in g), min(s["y0"] for s in g), max(s["x1"] for s in g), max(s["y1"] for s in g)) for g in got]
        for k, a in enumerate(box):
            for b in box[k + 1 :]:
                low, high = sorted((a[3] - a[1], b[3] - b[1]))
                over = (min(a[3], b[3]) - max(a[1], b[1])) / low
                assert over <= 0.5 or high > 3 * low or max(a[0], b[0]) - min(a[2], b[2]) > 5 * low


def test_tolerance_grows_with_the_size(spark):
    rows = [styled(0, 50, 100, "big", size=20.0), styled(1, 120, 104.5, "words", size=20.0), styled(2, 50, 400, "end", size=20.0)]
    assert sorted(r.text for r in L.lines(spark.createDataFrame(rows, STYLED)).collect()) == ["big words", "end"]


def _margins(spark, pages, extra=()):
    """Body text on each page, and what pages(p) gives."""
    rows = [r for p in range(8) for r in [styled(0, 100, 300, "words of the body stand here", p), *pages(p)]] + list(extra)
    kept = L.margin_filter(L.lines(spark.createDataFrame(rows, STYLED)), 612, 792)
    return sorted({(r.page, r.text) for r in kept.collect()} - {(p, "words of the body stand here") for p in range(8)})


ROMAN = ["i", "ii", "iii", "iv"]
ARABIC = "٠١٢٣٤٥٦٧٨٩"


def test_page_numbers_go_by_their_sequence(spark):
    assert _margins(spark, lambda p: [styled(1, 300, 750, ROMAN[p] if p < 4 else str(p - 3), p)]) == []
    assert _margins(spark, lambda p: [styled(1, 300, 750, f"{p + 1} of 9", p)]) == []
    assert _margins(spark, lambda p: [styled(1, 300, 750, ARABIC[p + 1], p)]) == []
    assert _margins(spark, lambda p: [styled(1, 300, 50, f"Seite {p + 1} von 8", p), styled(2, 300, 750, str(p + 10), p)]) == []
    assert len(_margins(spark, lambda p: [styled(1, 300, 750, str(20 - p), p)])) == 8  # they fall
    assert len(_margins(spark, lambda p: [styled(1, 300, 750, str(7 * p), p)] if p < 2 else [])) == 2  # on two pages of eight


def test_repeats_headings_and_body_in_margins(spark):
    head = lambda p: [styled(1, 100, 50, "The Running Head", p)]
    assert _margins(spark, head) == []
    big = [styled(3, 100, 45, "The Running Head", 9, size=20.0)]
    assert _margins(spark, head, big) == [(9, "The Running Head")]
    assert _margins(spark, lambda p: [styled(1, 30, 20, "a line of text in the body's style", p)] if p == 1 else []) == [(1, "a line of text in the body's style")]
    assert _margins(spark, lambda p: [styled(1, 30, 20, "17", p)] if p == 1 else []) == []
    assert _margins(spark, lambda p: [styled(1, 100, 60, "https://example.org/paper", p)] if p == 3 else []) == []
    assert _margins(spark, lambda p: [styled(1, 100, 60, "see https://example.org/paper for more", p)] if p == 3 else []) == [(3, "see https://example.org/paper for more")]
    assert len(_margins(spark, lambda p: [styled(1, 30, 400, "the", p, width=20)])) == 8  # a word at the side says too little


def test_short_documents_need_two_pages(spark):
    rows = [r for p in range(3) for r in (styled(0, 100, 300, "words of the body", p), *([styled(1, 100, 60, "Head", p), styled(2, 30, 400, "side note here", p, width=20)] if p < 2 else []))]
    kept = L.margin_filter(L.lines(spark.createDataFrame(rows, STYLED)), 612, 792)
    assert sorted(r.text for r in kept.collect()) == ["side note here", "side note here", "words of the body", "words of the body", "words of the body"]


def test_kinds_of_paragraphs(spark):
    """Larger, bold after a gap, section numbers in another font and capitals are headings; captions and numbers are not."""
    body = lambda y, t="plain words that make the body of this page go on": styled(int(y), 50, y, t)
    rows = [styled(1, 50, 60, "A Large Title", size=16.0, font="T"), styled(2, 50, 78, "that wraps", size=16.0, font="T"), *[body(100 + 12 * k) for k in range(4)]]
    rows += [styled(3, 50, 170, "Bold words", font="B", bold=True), *[body(182 + 12 * k) for k in range(3)], styled(4, 50, 218, "Bold without a gap", font="B", bold=True), body(230)]
    rows += [styled(5, 50, 262, "3.1 Results", font="C"), body(274), styled(6, 50, 306, "ALL IN CAPITALS"), body(318)]
    rows += [styled(7, 50, 350, "Figure 2 shows it", size=12.0, font="T"), styled(8, 50, 380, "1234 5678", size=12.0, font="T"), styled(9, 50, 410, "(see page 3)", size=12.0, font="T")]
    rows += [body(440, "• one"), body(452, "• two"), body(464, "goes on")]
    got = [(r.kind, r.text) for r in sorted(L.paragraphs(L.lines(spark.createDataFrame(rows, STYLED))).collect(), key=lambda r: r.paragraph)]
    assert [t for k, t in got if k == "heading"] == ["A Large Title that wraps", "Bold words", "3.1 Results", "ALL IN CAPITALS"]
    assert [t for k, t in got if k == "list"] == ["• one", "• two goes on"]
    assert any(t.endswith("Bold without a gap plain words that make the body of this page go on") for k, t in got if k == "text")


def test_body_in_capitals_has_no_headings_of_them(spark):
    rows = [styled(k, 50, 100 + 30 * k, "EVERY LINE SHOUTS", font="A") for k in range(4)]
    assert {r.kind for r in L.paragraphs(L.lines(spark.createDataFrame(rows, STYLED))).collect()} == {"text"}


def test_labels_of_figures(spark):
    """Three short labels side by side on one page go; a column of text, and two labels elsewhere, stay."""
    label = lambda i, x, y, p: styled(i, x, y, "ab", p, size=8.0)
    rows = [styled(k, 50, 300 + 12 * k, "a line of the text of the body", p) for p in range(2) for k in range(5)]
    rows += [label(20, 60, 100, 0), label(21, 180, 104, 0), label(22, 300, 100, 0), label(20, 60, 100, 1), label(21, 300, 100, 1)]
    made = L.lines(spark.createDataFrame(rows, STYLED)).withColumn("col", F.when(F.col("size") < 9, (F.col("x0") / 10).cast("int") + 10).otherwise(0))
    assert sorted((r.page, r.col) for r in L.figure_text(made, L.body_style(made)).collect()) == [(0, 16), (0, 28), (0, 40)]


def test_cuts_need_room():
    assert [b[4] for b in L.reading_order([(0, 0, 10, 10, 0), (17, 0, 27, 10, 1), (0, 11, 10, 20, 2)])] == [0, 1, 2]
    assert [b[4] for b in L.reading_order([(0, 0, 10, 10, 0), (18, 0, 28, 10, 1), (0, 11, 10, 20, 2)])] == [0, 2, 1]


def test_margins(spark):
    pages = [row for p in range(3) for row in (span(0, 100, 60, f"Page {p}", p), span(1, 100, 300, "body", p), span(2, 100, 20, f"crop {p}", p))] + [span(3, 100, 45, "once", 2)]
    kept = L.margin_filter(L.lines(spark.createDataFrame(pages, SPANS)), 612, 792)
    assert sorted(r.text for r in kept.collect()) == ["body", "body", "body", "once"]


def test_paragraphs_part_at_wide_gaps(spark):
    rows = [span(k, 50, 100 + 12 * k + (20 if k > 2 else 0), f"l{k}") for k in range(5)]
    got = [(r.paragraph, r.lines, r.text) for r in sorted(L.paragraphs(L.lines(spark.createDataFrame(rows, SPANS))).collect())]
    assert sorted((a, b, c) for a, b, c in got) == [(0, 3, "l0 l1 l2"), (1, 2, "l3 l4")]


def test_boxes_of_sentences(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 100.0, 10.0, 0, 10), (1, 0, 1, 0.0, 14.0, 50.0, 24.0, 10, 15)], "doc long, page long, line long, x0 double, y0 double, x1 double, y1 double, start int, end int")
    said = spark.createDataFrame([(1, 0, 0, 0, 4), (1, 0, 1, 4, 12)], "doc long, page long, sentence long, begins int, stops int")
    got = sorted((r.sentence, r.line, r.x0, r.x1) for r in L.sentence_boxes(rows, said).collect())
    assert got == [(0, 0, 0.0, 40.0), (1, 0, 40.0, 100.0), (1, 1, 0.0, 20.0)]


def _page_plan(spark, f):
    rows = spark.createDataFrame([(1, p, k, 10.0 * (k % 2) * 30, 20.0 * k, 10.0 * (k % 2) * 30 + 100, 20.0 * k + 10) for p in range(3) for k in range(6)], "doc bigint, page bigint, line bigint, x0 double, y0 double, x1 double, y1 double")
    made = f(rows)
    return made, made._jdf.queryExecution().optimizedPlan().toString()


def test_reading_order_takes_many_pages_in_one_batch(spark):
    made, plan = _page_plan(spark, L.xy_cut)
    assert "FlatMapGroups" not in plan
    assert sorted((r.page, r.place, r.line) for r in made.collect()) == [(p, k, line) for p in range(3) for k, line in enumerate((0, 2, 4, 1, 3, 5))]


def test_columns_take_many_pages_in_one_batch(spark):
    made, plan = _page_plan(spark, L.columns)
    assert "FlatMapGroups" not in plan
    assert sorted((r.page, r.col, r.x0, r.x1, r.lines) for r in made.collect()) == [(p, c, 300.0 * c, 300.0 * c + 100, 3) for p in range(3) for c in (0, 1)]


@pytest.mark.parametrize("f", [lambda rows: L.margin_filter(rows, 612, 792), L.paragraphs])
def test_lines_are_worked_out_once(spark, f):
    """What comes after reads lines that are stored, however often it needs them."""
    rows = spark.createDataFrame([(1, p, k, 72.0, 100.0 + 14 * k, 300.0, 110.0 + 14 * k, f"line {k} of the text") for p in range(2) for k in range(4)], "doc bigint, page bigint, line bigint, x0 double, y0 double, x1 double, y1 double, text string")
    made = f(rows)
    assert "LogicalRDD" not in made._jdf.queryExecution().optimizedPlan().toString() and made.count() in (2, 8)


def test_boxes_of_sentences_need_no_join(spark):
    """Lines are worked out once and joined with nothing."""
    from quire.plans import pdf

    from .conftest import DATA

    for query in (pdf.sentence_boxes, pdf.bbox_union):
        assert "Join" not in query(spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
