"""Queries of rules: citations, markdown, versions, layout measures, row edits and state decisions, as column expressions.

Where the test tables hold no citations, tags or styles, strings of that form are made from their keys.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..operators import matching as M
from ..sources import table
from .catalog import query

# ---- rendering ----------------------------------------------------------------------------------------------------


def markdown(kind: Column, level: Column, text: Column) -> Column:
    """An item as Markdown: headings of level 1 to 6, list items, captions and footnotes."""
    marks = F.repeat(F.lit("#"), F.least(F.greatest(level, F.lit(1)), F.lit(6)))
    return (
        F.when(kind == "heading", F.concat(marks, F.lit(" "), text))
        .when(kind == "list", F.concat(F.lit("- "), text))
        .when(kind == "caption", F.concat(F.lit("_"), text, F.lit("_")))
        .when(kind == "footnote", F.concat(F.lit("[^] "), text))
        .otherwise(text)
    )


_KIND_SQL = "CASE p_size % 5 WHEN 0 THEN 'heading' WHEN 1 THEN 'list' WHEN 2 THEN 'caption' WHEN 3 THEN 'footnote' ELSE 'text' END"


@query(
    f"SELECT p_partkey, CASE kind WHEN 'heading' THEN repeat('#', least(greatest(p_size // 5, 1), 6)) || ' ' || p_name WHEN 'list' THEN '- ' || p_name WHEN 'caption' THEN '_' || p_name || '_' WHEN 'footnote' THEN '[^] ' || p_name ELSE p_name END AS markdown FROM (SELECT *, {_KIND_SQL} AS kind FROM part)"
)
def item_markdown(spark, d):
    m = F.col("p_size") % 5
    kind = F.when(m == 0, "heading").when(m == 1, "list").when(m == 2, "caption").when(m == 3, "footnote").otherwise("text")
    return table(spark, d, "part").select("p_partkey", markdown(kind, F.floor(F.col("p_size") / 5).cast("int"), F.col("p_name")).alias("markdown"))


@query(
    "SELECT o_orderkey AS page, coalesce(body, '') AS body FROM orders LEFT JOIN (SELECT l_orderkey, string_agg('Line ' || l_linenumber || ': part ' || l_partkey, chr(10) || chr(10) ORDER BY l_linenumber, l_partkey) AS body FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey"
)
def render_pages(spark, d):
    """Items of a page in order with a blank line between; pages without items stay. A page holds few items."""
    item = F.concat(F.lit("Line "), F.col("l_linenumber"), F.lit(": part "), F.col("l_partkey"))
    pages = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", item.alias("s")))).alias("items"))
    joined = F.array_join(F.transform("items", lambda x: x["s"]), "\n\n")
    return table(spark, d, "orders").join(pages, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("page"), F.coalesce(joined, F.lit("")).alias("body"))


# ---- joins of items with their fields -----------------------------------------------------------------------------


@query("SELECT p_partkey, p_name FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_size = 1)")
def match_title_exact(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", "p_name").join(p.where("p_size = 1").select("p_name"), "p_name", "left_semi")


@query("SELECT l_orderkey, a, n, r, coalesce(a, n, r) AS best FROM (SELECT l_orderkey, max(l_shipdate) FILTER (l_returnflag = 'A') AS a, max(l_shipdate) FILTER (l_returnflag = 'N') AS n, max(l_shipdate) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)")
def eav_pivot(spark, d):
    """Fields as columns; the base field wins over mapped ones, in their order."""
    wide = table(spark, d, "lineitem").groupBy("l_orderkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.max("l_shipdate"))
    return wide.select("l_orderkey", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"), F.coalesce("A", "N", "R").alias("best"))


@query("SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY 1")
def ordered_collect(spark, d):
    listed = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(listed, lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL) AS found FROM customer")
def reference_check(spark, d):
    seen = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.lit(True).alias("_seen"))
    return table(spark, d, "customer").select("c_custkey").join(seen, "c_custkey", "left").select("c_custkey", F.col("_seen").isNotNull().alias("found"))


@query("SELECT c_custkey, sha256(json_object('c_custkey', c_custkey, 'c_mktsegment', c_mktsegment, 'c_name', c_name)::VARCHAR) AS digest FROM customer")
def object_hash(spark, d):
    """SHA-256 of the row as JSON, keys in order, nulls kept."""
    row = F.to_json(F.struct("c_custkey", "c_mktsegment", "c_name"), {"ignoreNullFields": "false"})
    return table(spark, d, "customer").select("c_custkey", F.sha2(row, 256).alias("digest"))


# ---- citations ----------------------------------------------------------------------------------------------------

_TAGS_SQL = "(SELECT p_partkey, '<cite id=\"' || p_partkey || '\" loc=\"page' || p_size || '\"/> and <cite id=\"' || p_size || '\"/> and <cite id=\"' || p_partkey || '\"/>' AS s FROM part)"


def _cited(spark, d):
    def tag(c):
        return F.concat(F.lit('<cite id="'), F.col(c), F.lit('"'))

    p = table(spark, d, "part")
    return p.select("p_partkey", "p_size", F.concat(tag("p_partkey"), F.lit(' loc="page'), F.col("p_size"), F.lit('"/> and '), tag("p_size"), F.lit("/> and "), tag("p_partkey"), F.lit("/>")).alias("s"))


def attributes(tag: Column) -> Column:
    """Attributes of a tag's text as a map; of a repeated name the first value counts."""
    names = F.regexp_extract_all(tag, F.lit(r'(\w+)="[^"]*"'), F.lit(1))
    values = F.regexp_extract_all(tag, F.lit(r'\w+="([^"]*)"'), F.lit(1))
    pairs = F.arrays_zip(names.alias("n"), values.alias("v"))
    first = F.filter(pairs, lambda x, i: F.array_position(names, x["n"]) == i + 1)
    return F.map_from_entries(first)


@query(f"SELECT p_partkey, regexp_extract(s, 'id=\"([^\"]*)\"', 1) AS id, regexp_extract(s, 'loc=\"([^\"]*)\"', 1) AS loc FROM {_TAGS_SQL}")
def attr_map(spark, d):
    rows = _cited(spark, d).withColumn("m", attributes(F.col("s")))
    return rows.select("p_partkey", F.col("m")["id"].alias("id"), F.col("m")["loc"].alias("loc"))


@query(f"SELECT p_partkey, unnest(range(3)) AS pos, unnest(regexp_extract_all(s, 'id=\"([^\"]*)\"', 1)) AS id FROM {_TAGS_SQL}")
def citation_extract(spark, d):
    return _cited(spark, d).select("p_partkey", F.posexplode(F.regexp_extract_all("s", F.lit('id="([^"]*)"'), F.lit(1))).alias("pos", "id"))


@query("SELECT p_partkey, CASE WHEN p_partkey = p_size THEN p_partkey::VARCHAR ELSE p_partkey || ',' || p_size END AS refs FROM part")
def cited_refs(spark, d):
    ids = F.array_distinct(F.regexp_extract_all("s", F.lit('id="([^"]*)"'), F.lit(1)))
    return _cited(spark, d).select("p_partkey", F.array_join(ids, ",").alias("refs"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'external:' || c_nationkey WHEN 1 THEN 'file:' || c_name WHEN 2 THEN 'item:' || c_nationkey || '-' || c_custkey END AS key, CASE WHEN c_custkey % 4 = 3 THEN 'no identifier' END AS reason FROM customer")
def citation_key(spark, d):
    """The identity of a reference by what it names, or why there is none."""
    k, c = F.col("c_custkey") % 4, table(spark, d, "customer")
    key = F.when(k == 0, F.concat(F.lit("external:"), "c_nationkey")).when(k == 1, F.concat(F.lit("file:"), "c_name")).when(k == 2, F.concat(F.lit("item:"), "c_nationkey", F.lit("-"), "c_custkey"))
    return c.select("c_custkey", key.alias("key"), F.when(key.isNull(), "no identifier").alias("reason"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, kind, first, last FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 'page' WHEN 1 THEN 'section' END AS kind, l_linenumber::VARCHAR AS first, CASE WHEN l_linenumber % 2 = 0 THEN (l_linenumber + 2)::VARCHAR END AS last FROM lineitem)")
def parse_loc(spark, d):
    """<prefix><value>[-<value>]: kind by prefix (null if unknown), first and last value."""
    n = F.col("l_linenumber")
    prefix = F.when(n % 3 == 0, "p").when(n % 3 == 1, "s").otherwise("zz")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(prefix, n, F.when(n % 2 == 0, F.concat(F.lit("-"), n + 2)).otherwise("")).alias("s"))
    part = [F.regexp_extract("s", r"^([a-z]+)(\d+)(?:-(\d+))?$", i) for i in (1, 2, 3)]
    kinds = F.create_map(F.lit("p"), F.lit("page"), F.lit("s"), F.lit("section"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.try_element_at(kinds, part[0]).alias("kind"), part[1].alias("first"), F.nullif(part[2], F.lit("")).alias("last"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'user' WHEN c_custkey % 3 = 1 THEN 'group' END AS kind, CASE WHEN c_custkey % 3 = 1 THEN c_nationkey::BIGINT END AS group_id FROM customer")
def parse_ref(spark, d):
    """u is the user's library, g<id> a group's; all else is none."""
    k = F.col("c_custkey") % 3
    rows = table(spark, d, "customer").select("c_custkey", F.when(k == 0, "u").when(k == 1, F.concat(F.lit("g"), "c_nationkey")).otherwise(F.concat(F.lit("x"), "c_nationkey")).alias("s"))
    group = F.nullif(F.regexp_extract("s", r"^g(\d+)$", 1), F.lit("")).cast("bigint")
    return rows.select("c_custkey", F.when(F.col("s") == "u", "user").when(group.isNotNull(), "group").alias("kind"), group.alias("group_id"))


# ---- versions, dates, pages ---------------------------------------------------------------------------------------


def version_order(v: Column) -> Column:
    """A column that orders as versions do: missing parts are 0, build metadata does not count, a release is above
    its pre-releases, and of pre-release identifiers numbers are below words."""
    plain = F.regexp_replace(v, r"\+.*$", "")
    parts = F.split(F.regexp_extract(plain, r"^v?([0-9.]+)", 1), r"\.")
    core = [F.coalesce(F.try_element_at(parts, F.lit(i)).try_cast("bigint"), F.lit(0)) for i in (1, 2, 3, 4)]
    before = F.regexp_extract(plain, r"^[^-]*-(.+)$", 1)
    idents = F.transform(F.split(before, r"\."), lambda x: F.struct(x.rlike(r"\D").alias("word"), F.when(x.rlike(r"^\d+$"), x.cast("bigint")).otherwise(0).alias("n"), F.when(x.rlike(r"\D"), x).otherwise("").alias("s")))
    return F.struct(F.array(*core).alias("core"), (before == "").alias("release"), idents.alias("before"))


@query(
    "SELECT c_custkey, CASE WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END AS order_of FROM (SELECT c_custkey, [c_custkey % 3, c_custkey % 4, CASE WHEN c_custkey % 5 = 3 THEN 1 ELSE 0 END, CASE WHEN c_custkey % 5 = 1 THEN 0 WHEN c_custkey % 5 = 4 THEN 1 ELSE 2 END, CASE WHEN c_custkey % 5 = 1 THEN c_custkey % 3 ELSE 0 END] AS a, [1, 2, 0, 0, 1] AS b FROM customer)"
)
def version_cmp(spark, d):
    """Versions such as 1.2, 1.2-beta.1, 1.2+b, 1.2.1 and 1.2-rc against 1.2-beta.1."""
    k = F.col("c_custkey")
    tail = F.when(k % 5 == 1, F.concat(F.lit("-beta."), k % 3)).when(k % 5 == 2, "+b").when(k % 5 == 3, ".1").when(k % 5 == 4, "-rc").otherwise("")
    rows = table(spark, d, "customer").select("c_custkey", version_order(F.concat(k % 3, F.lit("."), k % 4, tail)).alias("a"), version_order(F.lit("v1.2-beta.1")).alias("b"))
    return rows.select("c_custkey", F.when(F.col("a") < F.col("b"), -1).when(F.col("a") > F.col("b"), 1).otherwise(0).alias("order_of"))


@query("SELECT event_id, strftime(epoch_ms(event_id * 86461001), '%Y-%m-%d %H:%M:%S') AS at FROM events")
def ms_to_ts(spark, d):
    """Milliseconds since 1970 as YYYY-MM-DD HH:MM:SS in UTC, in any session time zone."""
    at = F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(floor(event_id * 86461001 / 1000) as decimal(18, 6)))")
    plain = F.regexp_replace(at.cast("string"), r"^\+", "")  # Spark puts a plus before years of five digits and more
    return table(spark, d, "events").select("event_id", plain.alias("at"))


@query("SELECT c_custkey, CASE WHEN r_regionkey IS NOT NULL THEN r_regionkey + 1 WHEN c_custkey % 3 = 1 THEN c_custkey END AS page FROM customer LEFT JOIN region ON c_custkey % 3 = 0 AND r_regionkey = c_nationkey % 7")
def page_resolve(spark, d):
    """A page given by label, else by positive number, else none. Labels are the names of regions."""
    k = F.col("c_custkey")
    labels = table(spark, d, "region").select(F.col("r_name").alias("s"), (F.col("r_regionkey") + 1).alias("_page"))
    asked = table(spark, d, "customer").withColumn("r_regionkey", F.col("c_nationkey") % 7).join(table(spark, d, "region"), "r_regionkey", "left")
    asked = asked.select("c_custkey", F.when(k % 3 == 0, F.coalesce("r_name", F.lit("?"))).when(k % 3 == 1, k.cast("string")).otherwise("-1").alias("s"))
    number = F.col("s").try_cast("bigint")
    return asked.join(labels, "s", "left").select("c_custkey", F.coalesce("_page", F.when(number > 0, number)).alias("page"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 4 < 3 THEN l_partkey END AS page FROM lineitem")
def page_number(spark, d):
    """The number after a word for page, in several languages."""
    m, n = F.col("l_linenumber") % 4, F.col("l_partkey").cast("string")
    said = F.when(m == 0, F.concat(F.lit("see p. "), n)).when(m == 1, F.concat(F.lit("Seite "), n, F.lit(" ff"))).when(m == 2, F.concat(F.lit("Page "), n)).otherwise(F.concat(F.lit("chapter "), n))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.page_number(said).alias("page"))


# ---- measures -----------------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, median(l_quantity) AS median FROM lineitem GROUP BY 1")
def median(spark, d):
    """Exact, from counts of distinct values (there are few), so a group's rows never meet in one task."""
    counts = table(spark, d, "lineitem").groupBy("l_returnflag", "l_quantity").count()
    return counts.groupBy("l_returnflag").agg(F.percentile("l_quantity", F.lit(0.5), F.col("count")).alias("median"))


@query("SELECT l_returnflag, mad(l_quantity) AS mad FROM lineitem GROUP BY 1")
def mad(spark, d):
    counts = table(spark, d, "lineitem").groupBy("l_returnflag", "l_quantity").count()
    middle = counts.groupBy("l_returnflag").agg(F.percentile("l_quantity", F.lit(0.5), F.col("count")).alias("_m"))
    return counts.join(middle, "l_returnflag").groupBy("l_returnflag").agg(F.percentile(F.abs(F.col("l_quantity") - F.col("_m")), F.lit(0.5), F.col("count")).alias("mad"))


#: The share of the primary style's characters from which a style is a body style, and the ratios to the
#: body's size above which a line is a heading, and below which a footnote or a caption.
BODY_SHARE, HEADING, FOOTNOTE, CAPTION = 0.15, 1.2, 0.85, 0.95


@query("SELECT p_brand, p_type, chars, chars = best AS is_primary, chars >= 0.15 * best AS is_body FROM (SELECT *, max(chars) OVER (PARTITION BY p_brand) AS best FROM (SELECT p_brand, p_type, sum(length(p_name))::BIGINT AS chars FROM part WHERE length(p_name) >= 4 GROUP BY 1, 2))")
def style_profile(spark, d):
    """Characters by style in a document; body styles have at least 15 % of the most used one's. Short lines do not count."""
    n = table(spark, d, "part").where(F.length("p_name") >= 4).groupBy("p_brand", "p_type").agg(F.sum(F.length("p_name")).alias("chars"))
    best = F.max("chars").over(W.partitionBy("p_brand"))
    return n.select("p_brand", "p_type", "chars", (F.col("chars") == best).alias("is_primary"), (F.col("chars") >= BODY_SHARE * best).alias("is_body"))


@query("SELECT p_partkey, CASE WHEN p_size > 1.2 * body THEN 'heading' WHEN p_size < 0.85 * body THEN 'footnote' WHEN p_size < 0.95 * body THEN 'caption' ELSE 'body' END AS role FROM part JOIN (SELECT p_brand, avg(p_size) AS body FROM part GROUP BY 1) USING (p_brand)")
def role(spark, d):
    p = table(spark, d, "part")
    size, body = F.col("p_size"), F.col("body")
    kind = F.when(size > HEADING * body, "heading").when(size < FOOTNOTE * body, "footnote").when(size < CAPTION * body, "caption").otherwise("body")
    return p.join(p.groupBy("p_brand").agg(F.avg("p_size").alias("body")), "p_brand").select("p_partkey", kind.alias("role"))


@query("SELECT l_orderkey, l_linenumber FROM (SELECT DISTINCT l_orderkey, l_linenumber, max(l_quantity > 45) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM lineitem) WHERE near")
def analysis_window(spark, d):
    """Lines at most one away from a target."""
    near = F.max(F.col("l_quantity") > 45).over(W.partitionBy("l_orderkey").orderBy("l_linenumber").rangeBetween(-1, 1))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", near.alias("near")).where("near").select("l_orderkey", "l_linenumber").distinct()


@query(
    "SELECT doc_id, concat_ws(',', CASE WHEN n = 0 THEN 'empty' END, CASE WHEN n > 0 AND spaces > 0.3 * n THEN 'spaces' END, CASE WHEN n > 0 AND breaks > 0.05 * n THEN 'breaks' END, CASE WHEN n > 0 AND alnum < 0.6 * n THEN 'symbols' END) AS reasons"
    " FROM (SELECT doc_id, length(t) AS n, length(t) - length(regexp_replace(t, '[ \\t\\n\\r]', '', 'g')) AS spaces, length(t) - length(replace(t, chr(10), '')) AS breaks, length(t) - length(regexp_replace(t, '[\\pL\\pN]', '', 'g')) AS alnum FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"
)
def text_quality(spark, d):
    """Why a text looks badly extracted: none, too much white space, too many breaks, too few letters and numbers."""
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    rows = rows.select("doc_id", F.length("t").alias("n"), *[F.regexp_count("t", F.lit(p)).alias(c) for c, p in (("spaces", r"[ \t\n\r]"), ("breaks", "\n"), ("alnum", r"[\p{L}\p{N}]"))])
    n = F.col("n")
    why = [F.when(n == 0, "empty"), F.when((n > 0) & (F.col("spaces") > 0.3 * n), "spaces"), F.when((n > 0) & (F.col("breaks") > 0.05 * n), "breaks"), F.when((n > 0) & (F.col("alnum") < 0.6 * n), "symbols")]
    return rows.select("doc_id", F.concat_ws(",", *why).alias("reasons"))


# ---- page labels ----------------------------------------------------------------------------------------------------


_LABELS_SQL = "m AS (SELECT l_suppkey AS doc, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS matcher, l_linenumber AS section, l_orderkey * 10 + l_linenumber AS place, CASE l_returnflag WHEN 'A' THEN (l_partkey % 40)::VARCHAR WHEN 'N' THEN 'page ' || l_orderkey ELSE (l_linenumber * 2 + (l_orderkey > 3000)::INT)::VARCHAR END AS label FROM lineitem)"


@query(
    f"WITH {_LABELS_SQL}, o AS (SELECT *, row_number() OVER w AS n, TRY_CAST(nullif(regexp_extract(label, '^[0-9]+'), '') AS BIGINT) AS v, lag(TRY_CAST(nullif(regexp_extract(label, '^[0-9]+'), '') AS BIGINT)) OVER w AS u, row_number() OVER (PARTITION BY doc, matcher, label ORDER BY section, place) > 1 AS again FROM m WINDOW w AS (PARTITION BY doc, matcher ORDER BY section, place, label)),"
    " s AS (SELECT doc, matcher, count(*) AS markers, count(DISTINCT section) AS covered, arg_min(CASE WHEN v < u THEN 0.25 ELSE 0.5 END, n) FILTER (v < u OR v > u + 3) AS f, arg_min(CASE WHEN regexp_matches(label, '^[^0-9]{2,}$') THEN 0 ELSE 0.5 END, n) FILTER (again) AS g FROM o GROUP BY 1, 2),"
    " r AS (SELECT *, markers * coalesce(f, 1) * coalesce(g, 1) AS score FROM s WHERE covered * 2 >= 7) SELECT doc, arg_min(matcher, (-markers, matcher))::INT AS matcher, max(markers)::BIGINT AS markers, arg_min(score, (-markers, matcher))::DOUBLE AS score FROM r WHERE score > 0 GROUP BY doc"
)
def marker_score(spark, d):
    """Which of three kinds of page labels a supplier's lines are numbered by, lines standing for sections."""
    flag, order = F.col("l_returnflag"), F.col("l_orderkey")
    label = F.when(flag == "A", (F.col("l_partkey") % 40).cast("string")).when(flag == "N", F.concat(F.lit("page "), order.cast("string"))).otherwise((F.col("l_linenumber") * 2 + (order > 3000).cast("int")).cast("string"))
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc"), F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("matcher"), F.col("l_linenumber").alias("section"), (order * 10 + F.col("l_linenumber")).alias("offset"), label.alias("label"))
    return M.page_markers(rows, rows.select("doc").distinct().withColumn("total", F.lit(7)))


# ---- state and row edits ------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cache_invalidate(spark, d):
    """Rows of payload that stay after the rows of changed sources are deleted."""
    changed = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(changed, "l_orderkey", "left_anti")


@query("SELECT c_custkey, coalesce(s_name, c_name) AS name, s_name IS NOT NULL AS edited, CASE WHEN s_name IS NOT NULL THEN c_name END AS undo FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def apply_updates(spark, d):
    """Edits replace old values, which are kept for undoing."""
    edits = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_name")
    rows = table(spark, d, "customer").join(edits, "c_custkey", "left")
    return rows.select("c_custkey", F.coalesce("s_name", "c_name").alias("name"), F.col("s_name").isNotNull().alias("edited"), F.when(F.col("s_name").isNotNull(), F.col("c_name")).alias("undo"))


@query("SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'restricted' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'unknown field' END, CASE WHEN c_nationkey % 5 = 0 THEN 'not valid for type' END) AS errors FROM customer")
def validate_edits(spark, d):
    """All that is wrong with an edit, in order."""
    errors = [F.when(F.col("c_acctbal") < 0, "restricted"), F.when(F.col("c_mktsegment") == "BUILDING", "unknown field"), F.when(F.col("c_nationkey") % 5 == 0, "not valid for type")]
    return table(spark, d, "customer").select("c_custkey", F.concat_ws(",", *errors).alias("errors"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type || ',' || p_brand ELSE p_type || ',new' END AS tags FROM part")
def tag_update(spark, d):
    """Tags added and removed: odd sizes lose the brand and get `new`, even ones get a tag that they have."""
    odd = F.col("p_size") % 2 == 1
    added, removed = F.array(F.when(odd, F.lit("new")).otherwise(F.col("p_brand"))), F.array(F.when(odd, F.col("p_brand")).otherwise(F.lit("none")))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_except(F.array_union(F.array("p_type", "p_brand"), added), removed), ",").alias("tags"))


@query("SELECT DISTINCT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'R' ELSE l_returnflag END AS tag FROM lineitem")
def tag_merge(spark, d):
    """A tag renamed to one that exists: rows that have both keep one."""
    tag = F.when(F.col("l_returnflag") == "A", "R").otherwise(F.col("l_returnflag"))
    return table(spark, d, "lineitem").select("l_orderkey", tag.alias("tag")).distinct()


# ---- forms of text ------------------------------------------------------------------------------------------------


@query("SELECT doc_id, translate(text, '‘’‚‛“”„‟', '''''''''\"\"\"\"') AS text FROM documents")
def fold_quotes(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fold_quotes(F.col("text")).alias("text"))


@query("SELECT c_custkey, 'a ' || c_name || ' b' AS s FROM customer")
def normalize_ws(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.normalize_space(F.concat(F.lit("a&nbsp; \t"), "c_name", F.lit("\n\n b"))).alias("s"))


@query("SELECT c_custkey, '漢' || c_custkey || '字 語' AS s FROM customer")
def cjk_spacing(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.cjk_spacing(F.concat(F.lit("漢 "), "c_custkey", F.lit("  字 語"))).alias("s"))


@query("SELECT o_orderkey, o_orderkey::VARCHAR AS s FROM orders")
def digits(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.digits(F.translate(F.col("o_orderkey").cast("string"), "0123456789", "٠١२३৪৫６７۸۹")).alias("s"))


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 14 WHEN 1 THEN 9 WHEN 2 THEN 50 END AS n FROM part")
def roman(spark, d):
    m = F.col("p_size") % 5
    said = F.when(m == 0, "xiv").when(m == 1, "IX").when(m == 2, " l ").when(m == 3, "iiii").otherwise("li")
    return table(spark, d, "part").select("p_partkey", T.roman(said).alias("n"))


@query("SELECT p_partkey, p_size % 4 <> 1 AS found FROM part")
def urlish(spark, d):
    m = F.col("p_size") % 4
    said = F.when(m == 0, "www.example").when(m == 1, "plain").when(m == 2, "10.1234/x").otherwise("a@b.org")
    return table(spark, d, "part").select("p_partkey", T.urlish(said).alias("found"))


@query("SELECT o_orderkey, year(o_orderdate)::INT AS y FROM orders")
def year_bounded(spark, d):
    """Longer runs of digits before the year are passed over."""
    return table(spark, d, "orders").select("o_orderkey", T.year_bounded(F.concat(F.lit("20201, "), F.year("o_orderdate"))).alias("y"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN c_name WHEN 2 THEN c_name || ' & ' || c_mktsegment WHEN 3 THEN c_name || ' et al.' END AS names FROM customer")
def creators_fmt(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.slice(F.array("c_name", "c_mktsegment", F.lit("Z")), F.lit(1), (F.col("c_custkey") % 4).cast("int")).alias("a"))
    return rows.select("c_custkey", T.creators(F.col("a")).alias("names"))
