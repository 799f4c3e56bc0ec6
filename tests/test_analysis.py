"""OCR decisions by their samples, hyphens at line ends, windows of lines against all windows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import analysis as A

GOOD = "These are words of a page that was read well, and there are more than a hundred signs of them on it, as it should be."


def decided(spark, docs):
    """docs: name -> texts of pages (None: the page can't be read)."""
    rows = [(d, k, t) for d, texts in docs.items() for k, t in enumerate(texts) if t is not None]
    pages = spark.createDataFrame(rows, "doc string, page long, text string")
    got = A.ocr_decisions(pages, spark.createDataFrame([(d, len(t)) for d, t in docs.items()], "doc string, pages int")).collect()
    return {r.doc: (r.sampled, r.issues, r.needed) for r in got}


def test_samples_widen_only_where_it_is_unclear(spark):
    rng = random.Random(1)
    docs = {
        "clean": [GOOD] * 60, "scan": [""] * 60, "some": [rng.choice([GOOD, GOOD, ""]) for _ in range(60)], "most": [rng.choice(["", "", GOOD]) for _ in range(60)],
        "short": [GOOD, ""], "one": [""], "two": [GOOD, GOOD, ""], "front": ["", *[GOOD] * 30],
    }
    got = decided(spark, docs)
    assert got["clean"] == (6, 0, False) and got["scan"] == (6, 6, True)
    grid = [1 + (k * 59) // 20 for k in range(20)]
    for d in ("some", "most"):
        few = [grid[(k * 20) // 6] for k in range(6)]
        share = sum(docs[d][k] == "" for k in few) / 6
        read = grid if 0.1 <= share < 0.8 else few
        bad = sum(docs[d][k] == "" for k in read)
        assert got[d] == (len(read), bad, 2 * bad > len(read) or 2 * bad == len(read) and len(GOOD) < 100)
    assert any(got[d][0] == 20 for d in ("some", "most"))
    assert got["short"] == (2, 1, False) and got["one"] == (1, 1, True) and got["two"] == (3, 1, False)
    assert got["front"] == (6, 0, False)  # the first page is no sample of a long document


def test_near_empty_documents_need_it(spark):
    got = decided(spark, {"few": ["12"] * 5, "pair": ["12"] * 2, "tables": ["short line of a table here"] * 9})
    assert got["few"][2] and got["pair"][2] and got["tables"] == (6, 6, True)


def test_missing_pages_are_made_up_for(spark):
    got = decided(spark, {"holes": [GOOD if k % 2 else None for k in range(30)], "none": [None] * 5})
    assert got["holes"][0] == 6 and "none" not in got


def test_only_sampled_pages_are_worked_on(spark):
    """A page beside the sample would make the work fail."""
    grid = [1 + (k * 59) // 20 for k in range(20)]
    few = [grid[(k * 20) // 6] for k in range(6)]
    strict = lambda t: F.when(t == "not sampled", F.raise_error(F.lit("worked on")).cast("array<string>")).otherwise(A.page_issues(t))
    pages = spark.createDataFrame([("d", k, GOOD if k in few else "not sampled") for k in range(60)], "doc string, page long, text string")
    assert A.ocr_decisions(pages, spark.createDataFrame([("d", 60)], "doc string, pages int"), strict).first() == ("d", 6, 0, False)


@pytest.mark.parametrize("text, want", [(GOOD, []), ("", ["insufficient_text"]), (None, ["insufficient_text"]), (GOOD + " " * 400, ["high_whitespace_ratio"]), (GOOD + "\n" * 200, ["high_newline_ratio"]), ("#$%&" * 100, ["low_alphanumeric_ratio"]), (GOOD + "." * 900, []), (GOOD + "�" * 99, ["invalid_characters"])])
def test_issues_of_a_page(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(A.page_issues(F.col("t")).alias("i")).first().i
    assert [w for w in want if w not in got] == [] and (want or got == [])


def test_hyphens_at_line_ends(spark):
    rows = ["The broken-windows theory of co-", "operation says that broken-", "windows are re-", "paired; see www.my-", "site.org/a-", "b or end-", "", "dash -", "next A-", "Level"]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(rows)] + [(2, 0, "broken-"), (2, 1, "windows")], "doc long, pos long, line string")
    got = {(r.doc, r.pos): r.decision for r in A.line_break_hyphens(df).collect()}
    assert got == {(1, 0): "join", (1, 1): "keep", (1, 2): "join", (1, 3): "keep", (1, 4): "keep", (1, 8): "join", (2, 0): "join"}
    assert {r.compound for r in A.compounds(spark.createDataFrame([(1, "a-b-c and X-ray, -no no-")], "doc long, line string")).collect()} == {"a-b", "b-c", "x-ray"}


def all_windows(text, quote):
    wanted = {w for w in quote.lower().split() if len(w) > 2}
    if len(wanted) < 3:
        return None
    lines, most, best = text.split("\n"), 1.5 * len(" ".join(quote.split())), (0, 0, 0)
    for i in range(len(lines)):
        met, size = set(), 0
        for j in range(i, len(lines)):
            met |= wanted & set(lines[j].lower().split())
            size += len(lines[j]) + 1
            if len(met) > best[0]:
                best = (len(met), i, j)
            if size >= most:
                break
    return (best[1], best[2], best[0] / len(wanted)) if best[0] >= 0.35 * len(wanted) else None


def test_best_window_as_all_windows_give_it(spark):
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "to", "epsilon", "zeta", "eta"]
    rows = []
    for _ in range(300):
        text = "\n".join(" ".join(rng.choices(words, k=rng.randint(0, 5))) for _ in range(rng.randint(1, 12)))
        rows.append((text, " ".join(rng.choices([*words, "unknown", "other"], k=rng.randint(1, 8)))))
    rows += [(None, "alpha beta gamma"), ("alpha", None), ("", "alpha beta gamma"), ("x\n" * 50_000 + "alpha beta\ngamma", "alpha beta gamma delta")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, t string, q string")
    got = {r.k: (r.w.first, r.w.last, r.w.score) for r in df.select("k", A.best_window("t", "q").alias("w")).collect()}
    for k, (t, q) in enumerate(rows[:-1]):
        assert got[k] == ((None, None, None) if t is None or q is None else all_windows(t, q) or (None, None, None)), rows[k]
    assert got[len(rows) - 1] == all_windows(t := rows[-1][0], rows[-1][1]) and t.count("\n") == 50_001


def test_line_windows(spark):
    df = spark.createDataFrame([("a\nb\nc",), ("a",), (None,)], "t string").select(T.line_window(F.col("t"), 2, 2).alias("w"))
    assert [tuple(r.w) if r.w.text is not None else None for r in df.collect()] == [("b\nc", 3, False, None), ("", 1, False, None), None]
    assert spark.createDataFrame([("a\nb\nc",)], "t string").select(T.line_window(F.col("t"), 1, 2).alias("w")).first().w == ("a\nb", 3, True, 3)


@pytest.mark.parametrize("text, want", [("12", (12, False, False)), ("Page 3", (3, False, True)), ("3 of 9", (3, False, False)), ("p. 4 - 9", (4, False, True)), ("xii", (12, True, False)), ("٣", (3, False, False)), ("第 5 页", (5, False, True)), ("·42·", (42, False, True)), ("no page", None), ("", None), ("3-9", None)])
def test_page_labels(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").select(T.page_label(F.col("t")).alias("p")).first().p
    assert (None if r.value is None else (r.value, r.roman, r.set)) == want


def test_snippets_are_the_lines_with_most_words(spark):
    text = "nothing here\n<p>alpha beta</p> gamma delta\nalpha beta gamma\n" + "x " * 300 + "alpha beta gamma delta " + "y " * 300 + "\nalpha beta gamma"
    got = A.snippets_of(text, "alpha beta gamma delta of")
    assert [(k, s) for k, s, _ in got] == [(1, 1.0), (3, 1.0), (2, 0.75)]
    assert got[1][2].startswith("…") and got[1][2].endswith("…") and "alpha beta gamma delta" in got[1][2] and len(got[1][2]) == A.SNIPPET + 2
    assert A.snippets_of(text, "of to") == A.snippets_of("", "alpha beta") == []
    rows = spark.createDataFrame([(text, "gamma"), (None, "x"), ("x", None)], "t string, q string").select(A.snippets("t", "q").alias("s")).collect()
    assert [r.s and len(r.s) for r in rows] == [3, None, None]


def test_overlaps_by_cells_as_all_pairs_give_them(spark):
    from quire.operators import entities as E

    rng = random.Random(3)
    rows = [(rng.choice("aab"), i, float(a := rng.randint(-40, 200)), float(a + rng.choice([0, 1, 5, 60]))) for i, _ in enumerate(range(150))]
    df = spark.createDataFrame(rows, "k string, i int, a double, b double")
    for closed in (False, True):
        over = lambda x, y: x[2] <= y[3] and y[2] <= x[3] if closed else x[2] < y[3] and y[2] < x[3]  # noqa: B023, E731
        want = sorted((x[0], x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[1] != y[1] and over(x, y))
        assert sorted(tuple(r) for r in E.overlapping(df, ["k"], "i", "a", "b", 7.5, closed).collect()) == want


def test_pages_that_know_their_document_are_chosen_without_a_join(spark, monkeypatch):
    """Texts of pages are not shuffled to find a few of them; the decisions are those with counts from elsewhere."""
    docs = [(d, k, n, "word " * (60 if (d + k) % 3 else 2)) for d, n in enumerate((1, 5, 30, 90)) for k in range(n)]
    pages = spark.createDataFrame(docs, "doc bigint, page bigint, pages bigint, text string")
    counts = pages.select("doc", "pages").distinct()
    want = {tuple(r) for r in A.ocr_decisions(pages.drop("pages"), counts).collect()}
    plans, stored = [], A.stored
    monkeypatch.setattr(A, "stored", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df, name))
    assert {tuple(r) for r in A.ocr_decisions(pages, counts).collect()} == want and len(want) == 4
    assert "Join" not in plans[0]
