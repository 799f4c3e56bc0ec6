"""Page layout: lines, columns, reading order, margins, figure text, paragraphs and boxes of sentences.

Input are spans: doc, page, i (in the order of the file), x0, y0, x1, y1 (points, from the top left), text, and where
they are known size, font, bold and italic (else the height, '' and false). Most steps are windows over a page; only the
recursive cut of the reading order, and lines of pages on which some overlap, are small Python functions for each page.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..sources import stored

PAGE = ["doc", "page"]
#: Points within which tops are one line, and the gap between spans, in heights, that parts two lines.
TOLERANCE, GAP_HEIGHTS = 3.0, 5.0
#: The least width of a cut, and how deep cuts go.
CUT, DEPTH = 8.0, 250
#: Margins of the content area and of the zones in which text may repeat (left, top, right, bottom).
CONTENT, ZONE = (25, 40, 25, 40), (60, 80, 60, 80)


def _islands(df: DataFrame, keys: list[str], order: list, begins: Column, name: str) -> DataFrame:
    """Number of the island (from 0) that each row is in; begins: whether a row begins one (null: the first row)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_begins", F.coalesce(begins, F.lit(False)).cast("int")).withColumn(name, F.sum("_begins").over(w)).drop("_begins")


#: The share of the lower of two lines that must overlap, and how many times as high the other may be.
OVERLAP, TALLER = 0.5, 3.0


def _styled(spans: DataFrame) -> DataFrame:
    """spans with size, font, bold and italic, filled in where they are missing."""
    have = {c for c in spans.columns}
    height, kinds = F.col("y1") - F.col("y0"), {"size": "double", "font": "string", "bold": "boolean", "italic": "boolean"}
    given = {c: F.col(c) if c in have else F.lit(None) for c in kinds}
    rest = {"size": height, "font": F.lit(""), "bold": F.lit(False), "italic": F.lit(False)}
    return spans.select(*PAGE, "i", "x0", "y0", "x1", "y1", "text", *[F.coalesce(given[c].cast(t), rest[c].cast(t)).alias(c) for c, t in kinds.items()])


_SPAN = ["x0", "i", "text", "y0", "x1", "y1", "size", "font", "bold", "italic"]


def merged_lines(rows: list[list[dict]]) -> list[list[dict]]:
    """Lines (lists of spans) of one page, where those that overlap are one: a mark above or below its line, say, but not
    a letter many lines high. Goes on until no two lines overlap, since a merged line is higher than its parts."""

    def box(spans: list[dict]) -> tuple[float, float, float, float]:
        return min(x["x0"] for x in spans), min(x["y0"] for x in spans), max(x["x1"] for x in spans), max(x["y1"] for x in spans)

    def one(a: tuple, b: tuple) -> bool:
        low, high = sorted((a[3] - a[1], b[3] - b[1]))
        apart = max(a[0], b[0]) - min(a[2], b[2])
        return low > 0 and min(a[3], b[3]) - max(a[1], b[1]) > OVERLAP * low and high <= TALLER * low and apart <= GAP_HEIGHTS * low

    changed = True
    while changed:
        changed, kept = False, []
        for spans in sorted(rows, key=lambda r: (box(r)[1], box(r)[0])):
            home = next((k for k in kept if one(box(k), box(spans))), None)
            if home is None:
                kept.append(list(spans))
            else:
                home += spans
                changed = True
        rows = kept
    return rows


def lines(spans: DataFrame) -> DataFrame:
    """doc, page, line, x0, y0, x1, y1, text, size, font, bold, italic, dominance: spans whose tops are near are a line,
    parted at wide gaps; lines that overlap are joined.

    Near is within a quarter of the page's median size, but TOLERANCE at least and twice that at most. The style is that
    of most of the line's characters, dominance their share.
    """
    rows = _styled(spans)
    near = F.greatest(F.lit(TOLERANCE), F.least(0.25 * F.percentile("size", F.lit(0.5)).over(W.partitionBy(*PAGE)), F.lit(2 * TOLERANCE)))
    w = W.partitionBy(*PAGE).orderBy("y0", "x0", "i")
    rows = _islands(rows.withColumn("near", near), PAGE, ["y0", "x0", "i"], F.col("y0") - F.lag("y0").over(w) > F.col("near"), "band")
    across = W.partitionBy(*PAGE, "band").orderBy("x0", "i")
    far = F.max("x1").over(across.rowsBetween(W.unboundedPreceding, -1))
    rows = _islands(rows, [*PAGE, "band"], ["x0", "i"], F.col("x0") - far > GAP_HEIGHTS * (F.col("y1") - F.col("y0")), "part")
    made = rows.groupBy(*PAGE, "band", "part").agg(F.array_sort(F.collect_list(F.struct(*_SPAN))).alias("spans"))  # the spans of one line
    edge = lambda f, c: f(F.transform("spans", lambda x: x[c]))
    boxed = lambda df: df.withColumns({"x0": edge(F.array_min, "x0"), "y0": edge(F.array_min, "y0"), "x1": edge(F.array_max, "x1"), "y1": edge(F.array_max, "y1")})
    made = boxed(made)
    # a page where a line begins above the end of one before it in its stripe may have lines to join
    stripe = W.partitionBy(*PAGE).orderBy("x0", "band", "part")
    made = _islands(made, PAGE, ["x0", "band", "part"], F.col("x0") - F.max("x1").over(stripe.rowsBetween(W.unboundedPreceding, -1)) >= CUT, "stripe")
    above = F.max("y1").over(W.partitionBy(*PAGE, "stripe").orderBy("y0", "band", "part").rowsBetween(W.unboundedPreceding, -1))
    made = made.withColumn("meets", F.coalesce(F.col("y0") < above, F.lit(False))).withColumn("meets", F.max("meets").over(W.partitionBy(*PAGE)))

    def joined(page: pd.DataFrame) -> pd.DataFrame:
        ready = merged_lines([list(x) for x in page["spans"]])
        out = [sorted(x, key=lambda s: (s["x0"], s["i"])) for x in ready]
        return pd.DataFrame({"doc": page["doc"].iloc[0], "page": page["page"].iloc[0], "band": range(len(out)), "part": 0, "spans": out})

    kept = stored(made.select(*PAGE, "band", "part", "spans", "meets"), "lines")  # read twice here, and by what builds on lines
    schema = kept.drop("meets").schema
    again = kept.where("meets").drop("meets").groupBy(*PAGE).applyInPandas(joined, schema)
    made = boxed(kept.where("NOT meets").drop("meets").unionByName(again))
    size = lambda x: F.length(x["text"])
    style = lambda x: F.struct(*[x[c].alias(c) for c in ("size", "font", "bold", "italic")])
    top = F.aggregate("spans", F.get("spans", F.lit(0)), lambda acc, x: F.when(size(x) > size(acc), x).otherwise(acc))
    made = made.withColumn("style", style(top))
    total = F.aggregate("spans", F.lit(0), lambda acc, x: acc + size(x))
    alike = F.aggregate("spans", F.lit(0), lambda acc, x: acc + F.when(style(x) == F.col("style"), size(x)).otherwise(0))
    n = F.row_number().over(W.partitionBy(*PAGE).orderBy("band", "part")) - 1
    text = F.array_join(F.transform("spans", lambda x: x["text"]), " ")
    return made.select(*PAGE, n.cast("bigint").alias("line"), "x0", "y0", "x1", "y1", text.alias("text"), "style.*", F.when(total > 0, alike / total).otherwise(1.0).alias("dominance"))


def column_boxes(boxes: list[tuple], depth: int = 0) -> list[list[tuple]]:
    """Boxes (x0, y0, x1, y1, id) of a page in columns: side by side if white stripes part them from top to bottom, else
    one above the other; what no stripe parts any more is a column. Boxes above one another that all stay whole are one
    column, not one each; a wide one among them, as a title across columns, parts what stands above and below it."""
    groups = _cut(boxes, 0)
    if len(groups) > 1 and depth < DEPTH:
        return [c for g in groups for c in column_boxes(g, depth + 1)]
    left, right = min(b[0] for b in boxes), max(b[2] for b in boxes)
    bands: list[list[tuple]] = []  # runs of wide and of narrow boxes, from top to bottom
    for box in sorted(boxes, key=lambda b: (b[1], b[4])):
        wide = box[2] - box[0] > WIDE * (right - left)
        if not bands or wide != (bands[-1][0][2] - bands[-1][0][0] > WIDE * (right - left)):
            bands.append([])
        bands[-1].append(box)
    parted = [c for g in bands for c in (column_boxes(g, depth + 1) if len(bands) > 1 and len(_cut(g, 0)) > 1 and depth < DEPTH else [g])]
    return parted if len(parted) > len(bands) else [boxes]


#: A box of more than this share of what it stands in crosses its columns.
WIDE = 0.55


def columns(rows: DataFrame) -> DataFrame:
    """doc, page, col, x0, x1, lines: what white stripes of at least CUT points part; a line across them parts what
    stands above it and below it, in the order of reading."""

    def of(boxes: list[tuple]) -> list[tuple]:
        return [(k, min(b[0] for b in g), max(b[2] for b in g), len(g)) for k, g in enumerate(column_boxes(boxes))]

    return _by_page(rows, of, "col bigint, x0 double, x1 double, lines bigint")


def _by_page(rows: DataFrame, of: Callable[[list[tuple]], list[tuple]], made: str) -> DataFrame:
    """doc, page and the rows that `of` makes from all boxes (x0, y0, x1, y1, line) of a page. A page is one row, and many
    pages are one Arrow batch, so that a page costs no call of its own between Spark and Python."""
    boxes = rows.groupBy(*PAGE).agg(F.collect_list(F.struct("x0", "y0", "x1", "y1", "line")).alias("boxes"))
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in boxes.schema if f.name in PAGE)}, rows array<struct<{made.replace(' ', ':').replace(',:', ',')}>>"
    names = [x.split()[0] for x in made.split(", ")]

    def run(batches):
        kinds = pa.list_(pa.struct([(n, pa.int64() if x.endswith("bigint") else pa.float64()) for n, x in zip(names, made.split(", "), strict=True)]))
        for batch in batches:
            for k in range(0, len(batch), PAGES):
                part = batch.slice(k, PAGES)
                col = part.column(2)
                flat = list(zip(*[x.to_pylist() for x in col.flatten().flatten()], strict=True))
                ends, at, out = col.value_lengths().to_pylist(), 0, []
                for n in ends:
                    out.append([dict(zip(names, r, strict=True)) for r in of(flat[at : at + n])])
                    at += n
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, kinds)], [*PAGE, "rows"])

    return boxes.mapInArrow(run, schema).select(*PAGE, F.explode("rows").alias("r")).select(*PAGE, "r.*")


#: Pages that are worked on at once.
PAGES = 500


def _cut(boxes: list[tuple], axis: int) -> list[list[tuple]]:
    """Boxes in groups that a white stripe parts along an axis (0: side by side, 1: one above the other)."""
    groups: list[list[tuple]] = []
    far = 0.0
    for box in sorted(boxes, key=lambda b: (b[axis], b[4])):
        if not groups or box[axis] - far >= CUT:
            groups.append([])
            far = box[axis + 2]
        groups[-1].append(box)
        far = max(far, box[axis + 2])
    return groups


def reading_order(boxes: list[tuple], depth: int = 0) -> list[tuple]:
    """Boxes (x0, y0, x1, y1, id) column by column, each cut again; what cannot be cut goes from top to bottom."""
    if depth < DEPTH and len(boxes) > 1:
        for axis in (0, 1):
            groups = _cut(boxes, axis)
            if len(groups) > 1:
                return [b for g in groups for b in reading_order(g, depth + 1)]
    return sorted(boxes, key=lambda b: (b[1], b[0], b[4]))


def zoned_order(boxes: list[tuple], zones: list[tuple]) -> list[tuple]:
    """The reading order where zones (x0, y0, x1, y1), as shaded boxes, are read as a whole: what lies in one stands as
    one box for the order of the page, and is put in order by itself."""
    inside: dict[int, list[tuple]] = {}
    outer: list[tuple] = []
    for b in boxes:
        x, y = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
        k = next((k for k, z in enumerate(zones) if z[0] <= x <= z[2] and z[1] <= y <= z[3]), None)
        if k is None:
            outer.append(b)
        else:
            inside.setdefault(k, []).append(b)
    for k, own in inside.items():
        outer.append((*[f(b[i] for b in own) for i, f in enumerate((min, min, max, max))], ("zone", k)))
    named = {("box", n): b for n, b in enumerate(outer)}
    out: list[tuple] = []
    for _, _, _, _, n in reading_order([(*b[:4], n) for n, b in enumerate(outer)]):
        place = named["box", n][4]
        out += reading_order(inside[place[1]]) if isinstance(place, tuple) else [named["box", n]]
    return out


def xy_cut(rows: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """doc, page, line, place: the reading order of each page's lines. zones: doc, page, x0, y0, x1, y1, what is read as a
    whole. A page is one group; pages are small."""
    made, box = "doc bigint, page bigint, line bigint, place bigint", ["x0", "y0", "x1", "y1"]

    def order(page: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        if not len(page):
            return pd.DataFrame({c: [] for c in ("doc", "page", "line", "place")})
        boxes = list(page[[*box, "line"]].itertuples(index=False, name=None))
        ids = [b[4] for b in zoned_order(boxes, list(of[box].itertuples(index=False, name=None)))]
        return pd.DataFrame({"doc": page["doc"].iloc[0], "page": page["page"].iloc[0], "line": ids, "place": range(len(ids))})

    if zones is None:
        return _by_page(rows, lambda boxes: [(b[4], k) for k, b in enumerate(reading_order(boxes))], "line bigint, place bigint")
    pages = rows.select(*PAGE, "line", *box).groupBy(*PAGE)
    return pages.cogroup(zones.select(*PAGE, *box).groupBy(*PAGE)).applyInPandas(order, made)


#: Pages of a short document; pages on which text at the top or bottom repeats there, and elsewhere.
SHORT, FEW, SOME = 6, 2, 3
#: Letters and digits, and words, that a line of text has at least; words and size of a heading.
LEAST_SIGNS, LEAST_WORDS, HEADING_WORDS, HEADING_SIZE = 8, 2, 3, 1.5


def _signs(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}]"))


def _words(c: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda x: x.rlike(r"[\p{L}\p{N}]")))


def body_style(rows: DataFrame) -> DataFrame:
    """doc, body (struct<size, font, bold, italic>): the style of most of a document's characters; body_caps: whether most
    letters in it are capitals."""
    style = F.struct("size", "font", "bold", "italic")
    letters, capitals = F.regexp_count("text", F.lit(r"\p{L}")), F.regexp_count("text", F.lit(r"\p{Lu}"))
    sums = rows.groupBy("doc", style.alias("style")).agg(F.sum(F.length("text")).alias("n"), (2 * F.sum(capitals) > F.sum(letters)).alias("caps"))
    top = F.max_by(F.struct("style", "caps"), F.struct("n", "style"))
    return sums.groupBy("doc").agg(top.alias("top")).select("doc", F.col("top.style").alias("body"), F.col("top.caps").alias("body_caps"))


def margin_texts(rows: DataFrame, width: float, height: float) -> DataFrame:
    """doc, page, position, key, reason: what is to go from the margin zones, by its text in lower case.

    - repeat: on SOME pages, or at the top or bottom of a short document on FEW. Page numbers in a set form ("page 3 of
      9") repeat by their form; text at the sides only if it has something to say.
    - number: page numbers, one for each page, which grow from page to page; roman ones are a sequence of their own.
    - identifier: an address that stands alone, however seldom.
    """
    left, top, right, bottom = ZONE
    position = F.when(F.col("y1") <= top, "top").when(F.col("y0") >= height - bottom, "bottom").when(F.col("x1") <= left, "left").when(F.col("x0") >= width - right, "right")
    number = T.page_label(F.col("text"))
    zone = rows.select(*PAGE, position.alias("position"), F.lower(F.trim("text")).alias("key"), number.alias("number")).where("position IS NOT NULL")
    zone = zone.withColumn("form", F.when(F.col("number.set"), F.concat(F.lit("#"), T.template_key(T.digits(F.col("key"))))).otherwise(F.concat(F.lit("="), F.col("key"))))
    pages = rows.groupBy("doc").agg(F.count_distinct("page").alias("pages"))
    need = F.when(F.col("position").isin("top", "bottom") & (F.col("pages") <= SHORT), FEW).otherwise(SOME)
    often = zone.groupBy("doc", "position", "form").agg(F.count_distinct("page").alias("on"), F.min("key").alias("some")).join(pages, "doc").where(F.col("on") >= need)
    often = often.where(F.col("position").isin("top", "bottom") | (_signs(F.col("some")) >= LEAST_SIGNS) | (_words(F.col("some")) >= LEAST_WORDS))
    repeat = zone.join(often.select("doc", "position", "form"), ["doc", "position", "form"], "left_semi").select(*PAGE, "position", "key", F.lit("repeat").alias("reason"))
    alone = zone.where(T.lone_address(F.col("key"))).select(*PAGE, "position", "key", F.lit("identifier").alias("reason"))
    told = repeat.select("doc", "key").unionByName(alone.select("doc", "key")).distinct()
    rest = zone.where("number.value IS NOT NULL").join(told, ["doc", "key"], "left_anti").withColumn("roman", F.col("number.roman"))
    kind = ["doc", "position", "roman"]
    least = rest.groupBy(*kind, "page").agg(F.min("number.value").alias("value"))
    step = F.col("value") - F.lag("value").over(W.partitionBy(*kind).orderBy("page"))
    grows = least.withColumn("step", step).groupBy(*kind).agg(F.count(F.lit(1)).alias("on"), F.min("step").alias("step")).join(pages, "doc").where((F.col("on") >= need) & (F.col("step") > 0))
    numbers = rest.join(grows.select(*kind), kind, "left_semi").select(*PAGE, "position", "key", F.lit("number").alias("reason"))
    return repeat.unionByName(alone).unionByName(numbers).distinct()


def margin_filter(rows: DataFrame, width: float, height: float) -> DataFrame:
    """Lines without those outside the content area, unless they look like body text, and without margin_texts in the
    zones, but a heading stays where its words repeat as a running head."""

    def beyond(left: float, top: float, right: float, bottom: float) -> Column:
        return (F.col("x1") < left) | (F.col("y1") < top) | (F.col("x0") > width - right) | (F.col("y0") > height - bottom)

    rows = stored(rows, "rows")  # read four times
    held = _with_style(rows).join(body_style(_with_style(rows)), "doc", "left")
    text = F.col("text")
    like_body = (F.struct("size", "font", "bold", "italic") == F.col("body")) & (_signs(text) >= LEAST_SIGNS) & (_words(text) >= LEAST_WORDS)
    heading = (F.col("size") > HEADING_SIZE * F.col("body.size")) & (_signs(text) >= LEAST_SIGNS) & (_words(text) >= HEADING_WORDS)
    left, top, right, bottom = ZONE
    zone = (F.col("y1") <= top) | (F.col("y0") >= height - bottom) | (F.col("x1") <= left) | (F.col("x0") >= width - right)
    kept = held.where(~beyond(*CONTENT) | like_body).withColumns({"key": F.when(zone, F.lower(F.trim("text"))), "heading": heading})
    # each key and page once; a number or address goes also where its text is a repeat
    gone = margin_texts(_with_style(rows).where(~beyond(*CONTENT)), width, height).groupBy(*PAGE, "key").agg(F.max(F.col("reason") != "repeat").alias("always"))
    both = kept.join(gone, [*PAGE, "key"], "left")
    return both.where(F.col("always").isNull() | (F.col("heading") & ~F.col("always"))).select(*rows.columns)


def _with_style(rows: DataFrame) -> DataFrame:
    """Lines with the columns of a style, for lines from elsewhere."""
    rest = {"size": F.col("y1") - F.col("y0"), "font": F.lit(""), "bold": F.lit(False), "italic": F.lit(False), "dominance": F.lit(1.0)}
    return rows.withColumns({c: v for c, v in rest.items() if c not in rows.columns})


#: How many small columns beside or above one another make a page of figures, how near they are for that
#: (points across and down), and the most lines and share of the page's width of a small one.
FIGURE_COLUMNS, BESIDE, ABOVE, SMALL_LINES, SMALL_WIDTH = 3, 100, 30, 3, 0.25


def figure_text(rows: DataFrame, cols: DataFrame) -> DataFrame:
    """rows: lines with col; cols: body_style. doc, page, col of the columns that are labels of a figure: small, without a
    line that looks like body text, on a page where FIGURE_COLUMNS of them stand near one another."""
    styled = _with_style(rows).join(cols, "doc", "left")
    like_body = (F.struct("size", "font", "bold", "italic") == F.col("body")) & (_signs(F.col("text")) >= LEAST_SIGNS) & (_words(F.col("text")) >= LEAST_WORDS)
    wide = W.partitionBy(*PAGE)
    styled = styled.withColumn("across", F.max("x1").over(wide) - F.min("x0").over(wide)).withColumn("like_body", like_body)
    made = styled.groupBy(*PAGE, "col").agg(F.count(F.lit(1)).alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("across").alias("across"), F.max("like_body").alias("like_body"))
    small = made.where(~F.coalesce("like_body", F.lit(False)) & (F.col("n") <= SMALL_LINES) & (F.col("x1") - F.col("x0") <= SMALL_WIDTH * F.col("across")))

    def near(axis: str, within: int) -> Column:
        """How many begin within so many points from this one on."""
        return F.count(F.lit(1)).over(W.partitionBy(*PAGE).orderBy(axis).rangeBetween(0, within))

    small = small.withColumns({"beside": near("y0", BESIDE), "above": near("x0", ABOVE)})
    small = small.withColumn("crowd", F.greatest(F.max("beside").over(wide), F.max("above").over(wide)))
    return small.where(F.col("crowd") >= FIGURE_COLUMNS).select(*PAGE, "col")


#: What a paragraph's kind is told by: bullets and numbers of list items, numbers and names of sections,
#: labels that are no headings, letters of a heading at least, and the share of its characters in one style.
BULLET = r"^(?:[•◦▪‣●○■□–—*·-]|\(?[0-9]{1,3}[.)]|\(?[a-zA-Z][.)])\s+\S"
SECTION = r"^(?:[0-9]{1,2}(?:\.[0-9]{1,2})*\.?|[IVX]{1,5}\.|[A-Z]\.)\s+\p{Lu}"
LABEL = r"(?i)^\s*(?:fig(?:ure)?|tab(?:le)?|eq(?:uation)?)\s*\.?\s+[A-Z]?\d{1,3}"
LEAST_HEADING, DOMINANT = 3, 0.9


def line_kinds(rows: DataFrame, body: DataFrame, gap: Column) -> DataFrame:
    """rows with kind: heading, list or text. gap: whether a wide gap, or nothing, stands above a line.

    A heading is of one style, not the body's: larger; or, after a gap, of the body's size in bold, italic or with the
    number of a section in another font, or smaller in bold; or all in capitals in any font, where the body isn't. It is no
    label of a figure or table, not mostly numbers, and not in brackets.
    """
    styled = _with_style(rows).join(body, "doc", "left")
    text, b = F.trim("text"), F.col("body")
    letters, capitals = F.regexp_count(text, F.lit(r"\p{L}")), F.regexp_count(text, F.lit(r"\p{Lu}"))
    shouts = (letters >= 4) & (capitals == letters) & (_words(text) >= 2)
    other, same = F.col("font") != b["font"], F.abs(F.col("size") - b["size"]) < 0.5
    unlike = F.struct("size", "font", "bold", "italic") != b
    after_gap = (same & F.col("bold") & ~b["bold"] & other) | (same & F.col("italic") & ~b["italic"] & other) | ((F.col("size") < b["size"]) & F.col("bold") & ~b["bold"] & other) | (same & other & text.rlike(SECTION))
    caps = shouts & ~F.col("body_caps") & (F.col("size") <= b["size"] + 0.5) & ~F.col("italic")
    heading = (F.col("size") > b["size"]) | (gap & after_gap) | (gap & caps)
    numeric = F.regexp_count(text, F.lit(r"\p{N}")) * 2 > F.length(F.regexp_replace(text, r"\s", ""))
    never = text.rlike(LABEL) | (F.length(text) < LEAST_HEADING) | (F.startswith(text, F.lit("(")) & F.endswith(text, F.lit(")")) & text.rlike(r"\d")) | numeric
    heading = heading & (unlike | caps) & (F.col("dominance") >= DOMINANT) & ~never
    return styled.withColumn("kind", F.when(F.coalesce(heading, F.lit(False)), "heading").when(text.rlike(BULLET), "list").otherwise("text")).drop("body", "body_caps")


def paragraphs(rows: DataFrame) -> DataFrame:
    """doc, page, paragraph, kind, lines, text: lines of a column, from top to bottom, parted where the gap above is wide,
    at each item of a list, and where headings begin and end. A heading that wraps is one while its style goes on.

    Wide is more than the largest of 5 points, the median gap and a twelfth of a line's height (1 point at least), 1.25
    median gaps, and 0.4 heights; gaps of -5 to 50 points count for the median; without any, 0.6 heights.
    """
    far = F.max("x1").over(W.partitionBy(*PAGE).orderBy("x0", "line").rowsBetween(W.unboundedPreceding, -1))
    flow = _islands(_with_style(rows), PAGE, ["x0", "line"], F.col("x0") - far >= CUT, "col")
    down = W.partitionBy(*PAGE, "col").orderBy("y0", "line")
    flow = flow.withColumn("gap", F.col("y0") - F.lag("y1").over(down)).withColumn("tall", F.col("y1") - F.col("y0"))
    usual = F.when((F.col("gap") > -5) & (F.col("gap") < 50), F.col("gap"))
    sizes = flow.groupBy(*PAGE).agg(F.percentile(usual, F.lit(0.5)).alias("g"), F.percentile("tall", F.lit(0.5)).alias("h"))
    wide = F.when(F.col("g").isNull(), F.greatest(F.lit(5.0), 0.6 * F.col("h"))).otherwise(
        F.greatest(F.lit(5.0), F.col("g") + F.greatest(F.lit(1.0), 0.08 * F.col("h")), 1.25 * F.col("g"), 0.4 * F.col("h"))
    )
    flow = stored(flow.join(sizes.select(*PAGE, wide.alias("wide")), PAGE), "flow")  # read twice
    flow = line_kinds(flow, body_style(flow), F.coalesce(F.col("gap") > F.col("wide"), F.lit(True)))
    style = F.struct("kind", "size", "font", "bold", "italic")
    turns = (F.col("kind") != F.lag("kind").over(down)) & F.array_contains(F.array("kind", F.lag("kind").over(down)), "heading") | (F.col("kind") == "heading") & (style != F.lag(style).over(down)) | (F.col("kind") == "list")
    flow = _islands(flow, [*PAGE, "col"], ["y0", "line"], (F.col("gap") > F.col("wide")) | turns, "part")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "line", "text"))), lambda s: s["text"]), " ")  # the lines of one paragraph
    made = flow.groupBy(*PAGE, "col", "part").agg(F.count(F.lit(1)).alias("lines"), text.alias("text"), F.min_by("kind", F.struct("y0", "line")).alias("kind"))
    n = F.row_number().over(W.partitionBy(*PAGE).orderBy("col", "part")) - 1
    return made.withColumn("paragraph", n.cast("bigint")).select(*PAGE, "paragraph", "kind", "lines", "text")


def sentence_boxes(rows: DataFrame, sentences: DataFrame) -> DataFrame:
    """rows: lines with start and end (places of their text in the page's text); sentences: doc, page, sentence, begins,
    stops. doc, page, sentence, line and the box of the line's part that the sentence covers, by equal character widths.

    Lines meet their page's sentences as one list, so that a join makes no row for each line and sentence of a page."""
    said = sentences.groupBy(*PAGE).agg(F.collect_list(F.struct("sentence", "begins", "stops")).alias("said"))
    return boxes_of_said(rows.join(said, PAGE))


def boxes_of_said(rows: DataFrame) -> DataFrame:
    """sentence_boxes of lines that hold said: the sentences of their page (or those that may cover the line), in a list."""
    covers = F.filter("said", lambda s: (F.col("start") < s["stops"]) & (s["begins"] < F.col("end")))
    both = rows.select(*PAGE, "line", "x0", "y0", "x1", "y1", "start", "end", F.explode(covers).alias("s")).select("*", "s.*")
    each = (F.col("x1") - F.col("x0")) / F.greatest(F.col("end") - F.col("start"), F.lit(1))
    left = F.col("x0") + each * (F.greatest("start", "begins") - F.col("start"))
    right = F.col("x0") + each * (F.least("end", "stops") - F.col("start"))
    return both.select(*PAGE, "sentence", "line", left.alias("x0"), "y0", right.alias("x1"), "y1")


def united(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The smallest box around all boxes of each key. Boxes without a side are left out."""
    whole = boxes.dropna(subset=["x0", "y0", "x1", "y1"])
    return whole.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
