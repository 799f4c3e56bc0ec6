"""Edits and matches: applying edits to texts, finding quotations, matching references to items."""

from __future__ import annotations

import html
import re
import unicodedata
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..functions import text as T


@F.pandas_udf(StringType())
def edited(text: pd.Series, edits: pd.Series) -> pd.Series:
    """text with edits: array<struct<start, end, new>>, by start and not overlapping; places are code points from 0.

    The text is the parts between the edits and their new texts, so no edit moves another, and each part is cut once.
    A null text stays null; null edits are none.
    """

    def one(t: str | None, own) -> str | None:
        if t is None:
            return None
        out, at = [], 0
        for e in [] if own is None else own:
            out += [t[at : e["start"]], e["new"] or ""]
            at = e["end"]
        return "".join([*out, t[at:]])

    return pd.Series([one(t, e) for t, e in zip(text, edits, strict=True)], dtype=object)


@F.pandas_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])))
def moved(edits: pd.Series) -> pd.Series:
    """Where each edit's new text begins and ends afterwards."""

    def one(own) -> list[dict] | None:
        if own is None:
            return None
        out, shift = [], 0
        for e in own:
            begin, size = int(e["start"]) + shift, len(e["new"] or "")
            out.append({"start": begin, "end": begin + size})
            shift += size - int(e["end"] - e["start"])
        return out

    return edits.map(one)


@F.pandas_udf(ArrayType(IntegerType()))
def line_starts(text: pd.Series) -> pd.Series:
    """Where each line of a text begins, in code points."""
    return text.map(lambda t: None if t is None else [0, *accumulate(len(x) + 1 for x in t.split("\n")[:-1])])


class Form:
    """A text as it is rewritten step by step, with the places that each of its characters came from, so that what is found
    in the rewritten text is a range of the first one."""

    def __init__(self, text: str):
        self.text, self._from, self._to = text, range(len(text)), range(1, len(text) + 1)

    def rewritten(self, pattern: str, by) -> Form:
        """Every match replaced by a string, or by(match). All of a new string stands for all of its match."""
        out, begin, end, at = [], [], [], 0
        for m in re.finditer(pattern, self.text):
            new = by(m) if callable(by) else by
            out += [self.text[at : m.start()], new]
            begin += [*self._from[at : m.start()], *[self._from[m.start()] if m.end() > m.start() else 0] * len(new)]
            end += [*self._to[at : m.start()], *[self._to[m.end() - 1] if m.end() > m.start() else 0] * len(new)]
            at = m.end()
        made = Form("".join([*out, self.text[at:]]))
        made._from, made._to = [*begin, *self._from[at:]], [*end, *self._to[at:]]
        return made

    def ranges(self, part: str) -> list[tuple[int, int]]:
        """Where part stands in the first text, without overlaps."""
        out, at = [], self.text.find(part) if part else -1
        while at >= 0:
            out.append((self._from[at], self._to[at + len(part) - 1]))
            at = self.text.find(part, at + len(part))
        return out


_SPACE = r"(?:\s|&nbsp;)+"
_ENTITIES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;"}
_ESCAPES = {"\\n": "\n", "\\t": "\t", '\\"': '"', "\\\\": "\\"}
_FOLDED = str.maketrans(T.QUOTES, T.ASCII_QUOTES)


def _markdown(quote: str) -> str:
    """Headings and strong words of lines, outside of tags."""

    def plain(part: str) -> str:
        part = re.sub(r"(?m)^ {0,3}(#{1,6})[ \t]+(.+?)(?:[ \t]+#+)?[ \t]*\r?$", lambda m: f"<h{len(m[1])}>{m[2]}</h{len(m[1])}>", part)
        return re.sub(r"\*\*([^\n*]+?)\*\*|__([^\n_]+?)__", lambda m: f"<strong>{m[1] or m[2]}</strong>", part)

    return "".join(x if k % 2 else plain(x) for k, x in enumerate(re.split(r"(<[^>]*>)", quote)))


def _rendered(quote: str) -> str:
    """Also emphasis, code, links and lines as paragraphs."""
    quote = re.sub(r"`([^`\n]+)`", r"<code>\1</code>", _markdown(quote))
    quote = re.sub(r"\[([^\]\n]+)\]\(([^)\s]+)\)", r'<a href="\2">\1</a>', quote)
    quote = re.sub(r"(?<![*\w])\*([^*\n]+)\*(?![*\w])|(?<![_\w])_([^_\n]+)_(?![_\w])", lambda m: f"<em>{m[1] or m[2]}</em>", quote)
    parts = [x for x in re.split(r"\n{2,}", quote.strip()) if x]
    return "\n".join(x if re.match(r"<(?:h[1-6]|ul|ol|p|blockquote|pre)\b", x) else f"<p>{x}</p>" for x in parts)


def _replaced(text: str, pairs: dict[str, str]) -> str:
    return re.sub("|".join(map(re.escape, pairs)), lambda m: pairs[m[0]], text)


def located(text: str, quote: str) -> tuple[str, list[tuple[int, int]]] | None:
    """The first way in which text holds quote, and the ranges of text that hold it: as it is; with character references
    decoded or encoded; in compatibility form; with plain quotation marks; without a trailing newline; with JSON escapes
    undone; without a tag that is cut off at its ends; without a bare tag put around it; without attributes of block tags;
    with Markdown headings and strong words as HTML; with any white space; with all of its Markdown as HTML."""
    if not quote:
        return None
    whole = Form(text)
    spaced = lambda f: f.rewritten(_SPACE, " ")
    bare = lambda q: re.sub(_SPACE, " ", q).strip()
    unescaped = _replaced(quote, _ESCAPES)
    wrapped = re.fullmatch(r"(?s)\s*<([a-zA-Z][a-zA-Z0-9]*)>(.*)</\1>\s*", quote)
    ways = [
        ("exact", whole, quote), ("entity_decoded", whole, html.unescape(quote)), ("entity_encoded", whole, _replaced(quote, _ENTITIES)), ("nfkc", whole, unicodedata.normalize("NFKC", quote)),
        ("quotes", lambda: whole.rewritten(f"[{T.QUOTES}]", lambda m: m[0].translate(_FOLDED)), quote.translate(_FOLDED)), ("trailing_newline", whole, quote.rstrip("\n")),
        ("json_unescaped", (lambda: spaced(whole)) if unescaped != quote else None, bare(unescaped)), ("partial_element", whole, re.sub(r"^[^<>]*>|<[^<>]*$", "", quote)),
        ("spurious_wrap", whole, wrapped[2] if wrapped else ""), ("tag_attributes", whole, re.sub(r"(?i)<(p|h[1-6]|blockquote)\s+[^>]*?(/?)>", lambda m: f"<{m[1].lower()}{m[2]}>", quote)),
        ("markdown", whole, _markdown(quote)), ("relaxed_space", lambda: spaced(whole), bare(quote)), ("markdown_rendered", whole, _rendered(quote)),
    ]
    for name, form, part in ways:
        if form is None or form is whole and part == quote and name != "exact":
            continue
        found = (form if form is whole else form()).ranges(part)
        if found:
            return name, found
    return None


@F.pandas_udf(StructType([StructField("way", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("n", LongType())]))
def match_range(text: pd.Series, quote: pd.Series) -> pd.DataFrame:
    """located() for each row: the way, the first range and how many there are; nulls where there is none."""
    made = [None if t is None or q is None else located(t, q) for t, q in zip(text, quote, strict=True)]
    rows = [(None, None, None, None) if x is None else (x[0], *x[1][0], len(x[1])) for x in made]
    return pd.DataFrame(rows, columns=["way", "start", "end", "n"]).astype({"start": "Int64", "end": "Int64", "n": "Int64"})


def first_match(items: DataFrame) -> DataFrame:
    """items: id, title, year, doi, creators (array). id and found: the smallest id of an item of equal title whose DOI
    and year (at most one apart) do not conflict and whose creators overlap, or both have none.

    Items that agree in all of these match alike, so classes are compared, and a title that very many items share
    costs no more than its classes.
    """
    key = ["title", "year", "doi", "creators"]
    rows = items.withColumn("creators", F.array_sort(F.coalesce("creators", F.array().cast("array<string>"))))
    classes = rows.groupBy(*key).agg(F.min("id").alias("id"))
    a, b = (classes.select(*[F.col(c).alias(f"{c}_{s}") for c in ("id", *key)]) for s in "ab")
    no_doi = F.col("doi_a").isNull() | F.col("doi_b").isNull() | (F.col("doi_a") == F.col("doi_b"))
    no_year = F.col("year_a").isNull() | F.col("year_b").isNull() | (F.abs(F.col("year_a") - F.col("year_b")) <= 1)
    creators = ((F.size("creators_a") == 0) & (F.size("creators_b") == 0)) | F.arrays_overlap("creators_a", "creators_b")
    found = a.join(b, F.col("title_a") == F.col("title_b")).where(no_doi & no_year & creators).groupBy("id_a").agg(F.min("id_b").alias("found"))
    named = classes.join(found, classes["id"] == found["id_a"]).select(*[F.col(c).alias(f"_{c}") for c in key], "found")
    same = (F.col("title") == F.col("_title")) & F.col("year").eqNullSafe(F.col("_year")) & F.col("doi").eqNullSafe(F.col("_doi")) & (F.col("creators") == F.col("_creators"))
    return rows.join(named, same).select("id", "found")


#: Suggestions for a name, letters from which on names are compared by containment, the longest name that may
#: be off by one letter only, and the most letters that any name may be off.
SUGGESTIONS, CONTAINED, ONE_OFF, MOST_OFF = 3, 3, 4, 3


def bounded_distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance, most + 1 where it is more; no more of it is worked out than that."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def _grams(c: Column, n: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substr(c, i, F.lit(n))))


def _contained(asked: DataFrame, named: DataFrame) -> DataFrame:
    """Pairs where one holds the other. The shorter one's first letters (three, or all that it has) are among the runs of
    as many letters of the longer one, which is the key they meet by."""
    keys = lambda df, of: df.select("*", F.explode(F.concat(*[F.when(F.length(of) >= n, _grams(F.col(of), n)).otherwise(F.array().cast("array<string>")) for n in (1, 2, 3)])).alias("key"))
    begin = lambda of: F.left(F.col(of), F.lit(3)).alias("key")
    ask = asked.where(F.length("needle") >= CONTAINED)
    inner = ask.select("needle", begin("needle")).join(keys(named, "tag"), "key").where(F.contains("tag", "needle"))
    outer = named.where(F.length("tag") > 0).select("tag", begin("tag")).join(keys(ask, "needle"), "key").where(F.contains("needle", "tag"))
    return inner.select("needle", "tag").unionByName(outer.select("needle", "tag")).where("needle <> tag").distinct()


def _misspelt(asked: DataFrame, named: DataFrame) -> DataFrame:
    """Pairs within the distance of the needle's length. A name in k + 1 parts keeps one of them whole under k edits, at
    most k places away: names are indexed by their parts, needles by what could be one."""
    most = F.when(F.length("needle") <= ONE_OFF, 1).otherwise(F.least(F.lit(MOST_OFF), F.floor(F.length("needle") / 3).cast("int")))
    cut = lambda n, k, i: F.floor(i * n / (k + 1)).cast("int")
    n, k = F.length("tag"), F.col("k")
    parts = F.transform(F.sequence(F.lit(0), k), lambda i: F.struct(i.alias("i"), F.substr(F.col("tag"), cut(n, k, i) + 1, cut(n, k, i + 1) - cut(n, k, i)).alias("part")))
    index = named.select("tag", n.alias("size"), F.explode(F.array(*map(F.lit, range(1, MOST_OFF + 1)))).alias("k")).select("tag", "size", "k", F.explode(parts).alias("p")).select("tag", "size", "k", "p.*")
    size = F.col("size")
    probe = asked.withColumn("k", most).withColumn("size", F.explode(F.sequence(F.greatest(F.length("needle") - k, F.lit(0)), F.length("needle") + k)))
    probe = probe.withColumn("i", F.explode(F.sequence(F.lit(0), k))).withColumn("shift", F.explode(F.sequence(-k, k)))
    at, own = cut(size, k, F.col("i")) + F.col("shift"), cut(size, k, F.col("i") + 1) - cut(size, k, F.col("i"))
    probe = probe.withColumns({"at": at, "own": own}).where("at >= 0 AND at + own <= length(needle)").select("needle", "k", "size", "i", F.substr(F.col("needle"), F.col("at") + 1, F.col("own")).alias("part")).distinct()
    met = probe.join(index, ["k", "size", "i", "part"]).select("needle", "tag", "k").distinct()
    near = [F.when(F.col("k") == x, F.levenshtein("needle", "tag", x)) for x in range(1, MOST_OFF + 1)]
    return met.withColumn("distance", F.coalesce(*near)).where("distance > 0").select("needle", "tag", "distance")


def suggestions(asked: DataFrame, tags: DataFrame) -> DataFrame:
    """asked: needle; tags: name. needle, rank (from 1), name, distance: the SUGGESTIONS names most like each needle in any
    case of letters, first those of which one holds the other, then by edit distance, difference in length and name. A
    name that is the needle but for case is none. Empty and null needles get nothing."""
    names = tags.where("name IS NOT NULL").select("name", F.lower("name").alias("tag")).distinct()
    ask = asked.select(F.lower("needle").alias("needle")).where("needle <> ''").distinct()
    named = names.select("tag").distinct()
    held = _contained(ask, named).withColumn("distance", F.lit(0))
    # each pair once; a contained one counts as such
    pairs = held.unionByName(_misspelt(ask, named)).groupBy("needle", "tag").agg(F.min("distance").alias("distance"))
    order = W.partitionBy("needle").orderBy("distance", F.abs(F.length("tag") - F.length("needle")), "name")
    ranked = pairs.join(names, "tag").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SUGGESTIONS)
    return asked.select("needle").where("needle IS NOT NULL").distinct().select(F.col("needle").alias("_own"), F.lower("needle").alias("needle")).join(ranked, "needle").select(F.col("_own").alias("needle"), "rank", "name", "distance")


def page_markers(markers: DataFrame, sections: DataFrame) -> DataFrame:
    """markers: doc, matcher (its number), section, offset, label; sections: doc, total. doc, matcher, markers, score: of
    the matchers that can be trusted the one with most markers, the first of equal ones.

    A matcher must be found in half of the sections at least. Read in order, the first number below the one before it
    quarters its score, or the first one more than 3 above halves it, whichever comes first. The first label that comes
    again halves it too, or, if it is two signs or more without a digit, ends it.
    """
    key = ["doc", "matcher"]
    order = W.partitionBy(*key).orderBy("section", "offset", "label")
    number = F.nullif(F.regexp_extract("label", r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("bigint")
    rows = markers.where("label <> ''").withColumns({"place": F.row_number().over(order), "number": number, "before": F.lag(number).over(order)})
    again = F.row_number().over(W.partitionBy(*key, "label").orderBy("section", "offset")) > 1
    rows = rows.withColumns({"again": again, "less": F.col("number") < F.col("before"), "skips": F.col("number") > F.col("before") + 3})
    breaks = F.coalesce(F.col("less"), F.lit(False)) | F.coalesce(F.col("skips"), F.lit(False))
    first = lambda value, when: F.min_by(value, F.when(when, F.col("place")))
    made = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("markers"), F.count_distinct("section").alias("covered"), first(F.when(F.col("less"), 0.25).otherwise(0.5), breaks).alias("order"),
        first(F.when(F.col("label").rlike(r"^\D{2,}$"), 0.0).otherwise(0.5), F.col("again")).alias("repeat"),
    )
    scored = made.join(sections, "doc").where(2 * F.col("covered") >= F.greatest("total", F.lit(1)))
    scored = scored.withColumn("score", F.col("markers") * F.coalesce("order", F.lit(1.0)) * F.coalesce("repeat", F.lit(1.0))).where("score > 0")
    best = scored.groupBy("doc").agg(F.min_by(F.struct("matcher", "markers", "score"), F.struct(-F.col("markers"), "matcher")).alias("best"))
    return best.select("doc", "best.*")
