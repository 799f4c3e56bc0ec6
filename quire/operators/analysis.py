"""Decisions about documents and their lines: whether pages need OCR, hyphens at line ends, where a quotation may stand."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from ..functions import text as T
from ..sources import stored

#: Characters of a page, the mean of a document, pages of the first and of the whole sample, shares of pages
#: with issues between which the sample is widened, and the share that asks for OCR.
PAGE_TEXT, MEAN_TEXT, SAMPLE, WIDE_SAMPLE, UNSURE, ENOUGH = 100, 24, 6, 20, (0.1, 0.8), 0.5
#: Most white space, most line breaks, least letters and digits, most unknown signs (shares), and so many
#: letters and digits that the last two are forgiven. Documents of so many pages may be near empty as a whole.
SPACES, BREAKS, SIGNS, UNKNOWN, FORGIVEN, GUARDED = 0.7, 0.6, 0.3, 0.3, 1000, 3


def page_issues(text: Column) -> Column:
    """array<string> of what is wrong with the text of a page."""
    t = F.coalesce(text, F.lit(""))
    n, bare = F.length(t), F.regexp_replace(t, r"\s", "")
    short = F.regexp_replace(bare, r"([^\p{L}\p{N}])\1{3,}", "$1")  # leaders count once
    signs, unknown = F.regexp_count(short, F.lit(r"[\p{L}\p{N}]")), F.regexp_count(t, F.lit("[�\x00]"))
    held = [
        F.when(n < PAGE_TEXT, "insufficient_text"), F.when((n > 0) & ((n - F.length(bare)) > SPACES * n), "high_whitespace_ratio"),
        F.when((n > 0) & (F.regexp_count(t, F.lit("\n")) > BREAKS * n) & (F.regexp_count(t, F.lit("\n")) < n), "high_newline_ratio"),
        F.when((F.length(short) > 0) & (signs < SIGNS * F.length(short)) & (signs < FORGIVEN), "low_alphanumeric_ratio"),
        F.when((F.length(bare) > 0) & (unknown > UNKNOWN * F.length(bare)) & (F.length(bare) - unknown < FORGIVEN), "invalid_characters"),
    ]
    return F.array_compact(F.array(*held))


def _spread(begin: Column, of: Column, n: Column) -> Column:
    """n places evenly spread over `of` places from begin on."""
    n = F.least(n, of)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda k: begin + F.floor(k * of / n))).otherwise(F.array().cast("array<bigint>"))


def ocr_decisions(pages: DataFrame, counts: DataFrame, issues: Callable[[Column], Column] = page_issues) -> DataFrame:
    """pages: doc, page (from 0), text and, if it is known, pages (of the document); counts: doc, pages. doc, sampled,
    issues (pages that have some), needed.

    A few pages, evenly spread behind the first one, decide. Only where some but not most of them have issues the rest of
    a wider sample counts too, and where pages are missing, others from the front. OCR is needed where the
    document has hardly any text, or where enough pages have issues and less than half of them have text enough.
    Documents of which no page can be read are left out. issues: what is wrong with a text, as an array.
    """
    total = F.col("_total").cast("bigint")
    begin = F.when(total > 3, 1).otherwise(0).cast("bigint")
    wide = _spread(begin, total - begin, F.lit(WIDE_SAMPLE).cast("bigint"))
    count = F.least(F.lit(WIDE_SAMPLE).cast("bigint"), total - begin)
    few = F.transform(_spread(F.lit(0).cast("bigint"), count, F.lit(SAMPLE).cast("bigint")), lambda k: begin + F.floor(k * (total - begin) / count))
    counts = counts.select("doc", F.col("pages").alias("_total"))
    # pages that know how many their document has are chosen where they are; others meet the counts first
    told = pages.withColumnRenamed("pages", "_total") if "pages" in pages.columns else pages.join(counts, "doc")

    def looked(rows: DataFrame) -> DataFrame:
        return rows.select("doc", "page", F.length(F.coalesce("text", F.lit(""))).alias("n"), (F.size(issues(F.col("text"))) > 0).alias("bad"))

    def summed(seen: DataFrame) -> DataFrame:
        return seen.groupBy("doc").agg(F.count(F.lit(1)).alias("sampled"), F.count_if("bad").alias("issues"), F.sum("n").alias("n"), F.sum(F.when(~F.col("bad"), F.col("n"))).alias("clean_n"))

    near = told.where(F.array_contains(wide, F.col("page"))).select("doc", "page", "text", F.array_contains(few, F.col("page")).alias("early"))
    near = stored(near, "sample")  # WIDE_SAMPLE pages of a document at most
    first = stored(looked(near.where("early")), "pages")
    share = F.col("issues") / F.col("sampled")
    unsure = summed(first).where((share >= UNSURE[0]) & (share < UNSURE[1])).select("doc")
    seen = stored(first.unionByName(looked(near.where("NOT early").join(unsure, "doc", "left_semi"))), "pages")
    # missing pages: as many more from the front as the first sample lacks
    grid = counts.select("doc", "_total", begin.alias("begin"), F.size(few).alias("wanted"))
    sizes = seen.groupBy("doc").agg(F.count(F.lit(1)).alias("sampled"))
    lack = stored(grid.join(sizes, "doc", "left").withColumn("lack", F.col("wanted") - F.coalesce("sampled", F.lit(0))).where("lack > 0").select("doc", "begin", "lack"), "lack")
    if not lack.isEmpty():
        others = pages.select("doc", "page").join(lack, "doc").where("page >= begin").join(seen.select("doc", "page"), ["doc", "page"], "left_anti")
        others = others.withColumn("k", F.row_number().over(W.partitionBy("doc").orderBy("page"))).where("k <= lack").select("doc", "page")
        seen = seen.unionByName(looked(told.join(others, ["doc", "page"], "left_semi")))
    got = summed(seen).join(counts.select("doc", F.col("_total").alias("pages")), "doc")
    clean = F.col("sampled") - F.col("issues")
    usable = (2 * clean >= F.col("sampled")) & (F.coalesce(F.col("clean_n") / clean, F.lit(0.0)) >= PAGE_TEXT)
    empty = (F.col("pages") >= GUARDED) & (F.col("n") < MEAN_TEXT * F.col("sampled"))
    return got.select("doc", "sampled", "issues", (empty | ((share >= ENOUGH) & ~usable)).alias("needed"))


def compounds(rows: DataFrame) -> DataFrame:
    """rows: doc, line. doc, compound: neighbours joined by a hyphen inside a line of the document, in small letters."""
    words = rows.select("doc", F.explode(F.regexp_extract_all("line", F.lit(r"\p{L}+(?:-\p{L}+)+"), F.lit(0))).alias("w"))
    parts = F.split(F.lower("w"), "-")
    pairs = F.zip_with(parts, F.slice(parts, 2, 1 << 20), lambda a, b: F.concat(a, F.lit("-"), b))
    return words.select("doc", F.explode(F.filter(pairs, lambda p: p.isNotNull())).alias("compound")).distinct()


def line_break_hyphens(rows: DataFrame) -> DataFrame:
    """rows: doc, pos, line. doc, pos, decision of each line that ends in letters and a hyphen before one that begins with
    letters: `keep` the hyphen, in an address or where the document writes the compound inside a line too, else `join`."""
    down = W.partitionBy("doc").orderBy("pos")
    end = F.regexp_replace("line", r"\s+$", "")
    after = F.regexp_replace(F.lead("line").over(down), r"^\s+", "")
    cut = rows.select("doc", "pos", end.alias("end"), after.alias("after"))
    head, tail = F.regexp_extract("end", r"(\p{L}+)-$", 1), F.regexp_extract("after", r"^(\p{L}+)", 1)
    cut = cut.select("*", head.alias("head"), tail.alias("tail")).where("head <> '' AND tail <> ''")
    address = T.urlish(F.regexp_extract("end", r"\S+$", 0)) | T.urlish(F.regexp_extract("after", r"^\S+", 0))
    cut = cut.select("doc", "pos", address.alias("address"), F.lower(F.concat("head", F.lit("-"), "tail")).alias("compound"))
    known = compounds(rows.select("doc", "line")).withColumn("known", F.lit(True))
    return cut.join(known, ["doc", "compound"], "left").select("doc", "pos", F.when(F.col("address") | F.col("known"), "keep").otherwise("join").alias("decision"))


#: How many times as long as the quotation a window is, the least share of its words, letters of a word more
#: than which count, and words that a quotation has at least.
WINDOW, LEAST_SHARE, WORD, LEAST_WORDS = 1.5, 0.35, 2, 3


def window_of(text: str, quote: str) -> tuple[int, int, float] | None:
    """The first and last line (from 0) and the share of words of the shortest run of lines that has most of the quote's
    words; the first of equal ones. A run ends with the line by which it is WINDOW times as long as the quote."""
    wanted = {w for w in quote.lower().split() if len(w) > WORD}
    if len(wanted) < LEAST_WORDS:
        return None
    lines = text.split("\n")
    words = [[w for w in line.lower().split() if w in wanted] for line in lines]
    most, best = WINDOW * max(len(" ".join(quote.split())), 1), (0, 0, 0)
    held: Counter[str] = Counter()
    end, size = 0, 0  # the window is lines[i:end]
    for i in range(len(lines)):
        while end < len(lines) and size < most:
            held.update(words[end])
            size += len(lines[end]) + 1
            end += 1
        if len(held) > best[0]:
            met: set[str] = set()
            for j in range(i, end):  # at most once for each word of the quote
                met.update(words[j])
                if len(met) == len(held):
                    best = (len(held), i, j)
                    break
        for w in words[i]:
            held[w] -= 1
            if not held[w]:
                del held[w]
        size -= len(lines[i]) + 1
    return (best[1], best[2], best[0] / len(wanted)) if best[0] >= LEAST_SHARE * len(wanted) else None


@F.pandas_udf(StructType([StructField("first", LongType()), StructField("last", LongType()), StructField("score", DoubleType())]))
def best_window(text: pd.Series, quote: pd.Series) -> pd.DataFrame:
    """window_of() for each row; nulls where no window has words enough."""
    made = [None if t is None or q is None else window_of(t, q) for t, q in zip(text, quote, strict=True)]
    return pd.DataFrame([x or (None, None, None) for x in made], columns=["first", "last", "score"]).astype({"first": "Int64", "last": "Int64", "score": "float64"})


#: Snippets for a quotation, the least share of its words that a line has, and characters of a snippet.
SNIPPETS, LEAST_LINE, SNIPPET = 3, 0.5, 200


def snippets_of(text: str, quote: str) -> list[tuple[int, float, str]]:
    """line (from 0), score, snippet: the lines that have most of the quote's words, tags aside, first the best and of
    equal ones the first; of longer lines what stands around the first of these words, with an ellipsis where it is cut."""
    wanted = {w for w in quote.lower().split() if len(w) > WORD}
    scored = []
    for k, line in enumerate(text.split("\n")):
        words = set(re.sub(r"<[^>]+>", "", line).lower().split())
        score = len(words & wanted) / len(wanted) if wanted else 0.0
        if score >= LEAST_LINE:
            scored.append((-score, k, line.strip(), min(line.strip().lower().find(w) for w in words & wanted)))
    out = []
    for score, k, line, at in heapq.nsmallest(SNIPPETS, scored):
        begin = max(0, min(max(at, 0) - SNIPPET // 2, len(line) - SNIPPET))
        cut = line[begin : begin + SNIPPET]
        out.append((k, -score, ("…" if begin else "") + cut + ("…" if begin + SNIPPET < len(line) else "")))
    return out


@F.pandas_udf(ArrayType(StructType([StructField("line", LongType()), StructField("score", DoubleType()), StructField("snippet", StringType())])))
def snippets(text: pd.Series, quote: pd.Series) -> pd.Series:
    """snippets_of() for each row; null without a text or quote."""
    return pd.Series([None if t is None or q is None else [{"line": k, "score": s, "snippet": x} for k, s, x in snippets_of(t, q)] for t, q in zip(text, quote, strict=True)], dtype=object)
