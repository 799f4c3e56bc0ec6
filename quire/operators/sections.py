"""Documents of HTML sections: items and sentences with ids over the whole document, page numbers, index, coverage.

A document may be long, so nothing is numbered in one group of all its rows: rows are numbered within their section, and
sections, which are few and narrow rows, carry how many came before them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import dom
from ..functions import sentences as S
from ..sources import small_batches, stored

#: Fixed value: characters of a synthetic page.
INTERVAL = 1800
KEY = ["doc", "section"]


def parsed(sections: DataFrame, interval: int = INTERVAL) -> DataFrame:
    """sections: doc, section (its place in the document), html. doc, section, label, chars, breaks, items, each page read
    once and stored. A null page has no items and no label."""
    small_batches(sections.sparkSession)
    read = sections.select(*KEY, dom.section(dom.clean(F.col("html")), interval).alias("read"))
    return stored(read.select(*KEY, "read.*"), "sections")


def _before(counts: DataFrame, count: str, keys: list[str]) -> DataFrame:
    """counts: doc, section, keys and a count. How many the sections before have; one narrow row for each section."""
    earlier = W.partitionBy("doc", *keys).orderBy("section").rowsBetween(W.unboundedPreceding, -1)
    return counts.select(*KEY, *keys, F.coalesce(F.sum(count).over(earlier), F.lit(0)).alias(f"{count}_before"))


def labels(read: DataFrame) -> DataFrame:
    return read.select(*KEY, "label")


def markers(read: DataFrame) -> DataFrame:
    """doc, section, offset, label: where synthetic pages begin. Labels count over the document."""
    before = _before(read.select(*KEY, F.size("breaks").alias("n")), "n", [])
    rows = read.select(*KEY, F.posexplode("breaks").alias("k", "offset")).join(before, KEY)
    return rows.select(*KEY, "offset", (F.col("n_before") + F.col("k") + 1).alias("label"))


def items(read: DataFrame, splitter: Callable[[Column], Column] = S.sentences) -> DataFrame:
    """doc, section, pos, id, kind, text, page, sentences (array<struct<id, text>>).

    Ids count each kind's prefix, and sentences, from 1 over the document. Headings have no sentences, rows of a table are
    its sentences, and all other text is cut by the splitter. page: how many synthetic pages have begun at the item, at
    least 1.
    """
    prefix = F.element_at(F.create_map(*[F.lit(x) for kv in dom.KINDS.items() for x in kv]), F.col("i.kind"))
    said = F.when(F.col("i.kind") == "heading", F.array().cast("array<string>")).when(F.col("i.rows").isNotNull(), F.col("i.rows")).otherwise(splitter(F.col("i.text")))
    begun = F.size(F.filter("breaks", lambda b: b <= F.col("i.offset")))
    rows = read.select(*KEY, "breaks", F.posexplode("items").alias("pos", "i")).select(*KEY, "pos", prefix.alias("prefix"), "i.kind", "i.text", begun.alias("begun"), said.alias("said"))
    inside = W.partitionBy(*KEY).orderBy("pos")
    rows = rows.withColumns({
        "n": F.row_number().over(W.partitionBy(*KEY, "prefix").orderBy("pos")),
        "s": F.coalesce(F.sum(F.size("said")).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
    })
    rows = stored(rows, "items")
    kinds = _before(rows.groupBy(*KEY, "prefix").agg(F.count(F.lit(1)).alias("items")), "items", ["prefix"])
    told = _before(rows.groupBy(*KEY).agg(F.sum(F.size("said")).alias("told")), "told", [])
    pages = _before(read.select(*KEY, F.size("breaks").alias("pages")), "pages", [])
    rows = rows.join(kinds, [*KEY, "prefix"]).join(told, KEY).join(pages, KEY)
    number = lambda k: (F.col("told_before") + F.col("s") + k + 1).cast("string")
    return rows.select(
        *KEY, F.col("pos").cast("bigint").alias("pos"), F.concat("prefix", (F.col("items_before") + F.col("n")).cast("string")).alias("id"), "kind", "text",
        F.greatest(F.lit(1), F.col("pages_before") + F.col("begun")).cast("bigint").alias("page"),
        F.transform("said", lambda t, k: F.struct(F.concat(F.lit("s"), number(k)).alias("id"), t.alias("text"))).alias("sentences"),
    )


def citation_index(made: DataFrame) -> DataFrame:
    """made: rows of items. doc, id, kind (item or sentence), section, item, sentence, page: where each id stands."""
    own = F.array(F.struct(F.col("id").alias("id"), F.lit("item").alias("kind"), F.lit(None).cast("string").alias("sentence")))
    inner = F.transform("sentences", lambda s: F.struct(s["id"].alias("id"), F.lit("sentence").alias("kind"), s["id"].alias("sentence")))
    rows = made.select(*KEY, F.col("id").alias("item"), "page", F.explode(F.concat(own, inner)).alias("e"))
    return rows.select("doc", "e.id", "e.kind", "section", "item", "e.sentence", "page")


def resolved(index: DataFrame, asked: DataFrame) -> DataFrame:
    """asked: doc, id. All of them, with the place of those that the index knows."""
    return asked.join(index, ["doc", "id"], "left")


def coverage(read: DataFrame) -> DataFrame:
    """doc, extracted, source (characters), coverage: the share to three digits, null if there is no visible text."""
    size = F.aggregate("items", F.lit(0).cast("bigint"), lambda n, i: n + F.length(i["text"]))
    sums = read.groupBy("doc").agg(F.sum(size).alias("extracted"), F.sum("chars").alias("source"))
    return sums.withColumn("coverage", F.round(F.try_divide("extracted", "source"), 3))
