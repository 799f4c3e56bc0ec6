"""Queries of the library: scans, filters, joins, counts, hierarchy, paging.

Test tables stand for entities: documents are items (library = source), customer - orders - lineitem are
parent - attachment - annotation, region - nation - customer is a tree of collections, labels.toxic marks the trash.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import entities as E
from ..sources import stored, table
from .catalog import query

_TITLE = "split_part(text, chr(10), 1)"


def _docs(spark, d, *also):
    return table(spark, d, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), "lang", "source", "n_chars", *also)


# ---- scans ------------------------------------------------------------------------------------------------------


@query("SELECT vec_id, label, len(embedding)::BIGINT AS dims FROM embeddings")
def scan_embeddings(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.size("embedding").cast("bigint").alias("dims"))


@query("SELECT vec_id, label FROM embeddings WHERE label = 3")
def scan_by_library(spark, d):
    return table(spark, d, "embeddings").where("label = 3").select("vec_id", "label")


@query("SELECT vec_id, label FROM embeddings WHERE label IN (1, 4, 7)")
def scan_in_list(spark, d, labels=(1, 4, 7)):
    rows = table(spark, d, "embeddings")
    return rows.where(F.col("label").isin(list(labels)) if labels else F.lit(False)).select("vec_id", "label")  # no list means nothing


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'de')")
def semi_join_ids(spark, d):
    ids = table(spark, d, "documents").where("lang = 'de'").select(F.col("doc_id").alias("vec_id"))
    return table(spark, d, "embeddings").select("vec_id", "label").join(ids, "vec_id", "left_semi")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id = 17")
def point_lookup(spark, d):
    return table(spark, d, "embeddings").where("vec_id = 17").select("vec_id", "label").limit(1)


@query(f"SELECT doc_id, {_TITLE} AS title, lang FROM documents WHERE source NOT IN ('src1', 'src2') AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND toxic = 1)")
def item_scan(spark, d):
    trash = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return _docs(spark, d).where("source NOT IN ('src1', 'src2')").join(trash, "doc_id", "left_anti").select("doc_id", "title", "lang")


@query("SELECT o_orderkey, o_orderstatus = 'F' AS deleted FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01'")
def incremental_scan(spark, d):
    """Rows after the watermark, deleted ones included so that deletions reach the other side."""
    return table(spark, d, "orders").where("o_orderdate > timestamp_ntz '1998-01-01 00:00:00'").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("deleted"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1996-06-30'")
def range_scan(spark, d):
    return table(spark, d, "orders").where("o_orderdate > timestamp_ntz '1996-01-01 00:00:00' AND o_orderdate <= timestamp_ntz '1996-06-30 00:00:00'").select("o_orderkey")


@query("SELECT page_id, CASE WHEN url LIKE '%?%' THEN 'linked_url' WHEN url LIKE '%.pdf' THEN 'pdf' WHEN url LIKE '%.epub' THEN 'epub' WHEN regexp_matches(url, '\\.(png|jpe?g|gif)$') THEN 'image' WHEN html IS NOT NULL THEN 'snapshot' END AS kind FROM pages")
def content_kind(spark, d):
    url = F.col("url")
    kind = F.when(url.contains("?"), "linked_url").when(url.endswith(".pdf"), "pdf").when(url.endswith(".epub"), "epub").when(url.rlike(r"\.(png|jpe?g|gif)$"), "image").when(F.col("html").isNotNull(), "snapshot")
    return table(spark, d, "pages").select("page_id", kind.alias("kind"))


# ---- filters ----------------------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars > 2000 AND contains(lower(text), 'the')")
def conditions_all(spark, d):
    return E.compile_conditions(table(spark, d, "documents"), [("lang", "is", "en"), ("n_chars", "isGreaterThan", 2000), ("text", "contains", "the"), ("nope", "is", "x")])[0].select("doc_id")


@query("SELECT doc_id FROM documents WHERE lang = 'de' OR n_chars > 9000")
def conditions_any(spark, d):
    return E.compile_conditions(table(spark, d, "documents"), [("lang", "is", "de"), ("n_chars", "isGreaterThan", 9000)], "any")[0].select("doc_id")


@query("SELECT doc_id FROM documents WHERE (lang = 'de' OR n_chars > 9000) AND source IN ('src0', 'src3')")
def category_filter(spark, d):
    """The category is required after the alternatives, not one of them."""
    return E.compile_conditions(table(spark, d, "documents"), [("lang", "is", "de"), ("n_chars", "isGreaterThan", 9000)], "any")[0].where(F.col("source").isin("src0", "src3")).select("doc_id")


@query(f"SELECT doc_id, {_TITLE} AS title FROM documents WHERE contains(lower({_TITLE}), 'the') AND lang IN ('en', 'fr') AND n_chars BETWEEN 500 AND 4000 ORDER BY doc_id LIMIT 50")
def metadata_search(spark, d):
    return _docs(spark, d).where(F.lower("title").contains("the") & F.col("lang").isin("en", "fr") & F.col("n_chars").between(500, 4000)).orderBy("doc_id").limit(50).select("doc_id", "title")


@query(f"SELECT min(doc_id) AS doc_id, {_TITLE} AS title, count(*)::BIGINT AS copies FROM documents WHERE lang = 'en' GROUP BY 2 ORDER BY 1 LIMIT 100")
def metadata_search_dedup(spark, d):
    return _docs(spark, d).where("lang = 'en'").groupBy("title").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).orderBy("doc_id").limit(100).select("doc_id", "title", "copies")


@query(f"WITH m AS (SELECT doc_id FROM documents WHERE contains(lower({_TITLE}), 'tion') OR contains(lower(source), 'src7')) SELECT doc_id, (SELECT count(*) FROM m)::BIGINT AS match_count, (SELECT count(*) FROM m) > 40 AS truncated FROM m ORDER BY doc_id LIMIT 40")
def quick_search(spark, d):
    m = _docs(spark, d).where(F.lower("title").contains("tion") | F.lower("source").contains("src7")).select("doc_id")
    n = m.agg(F.count(F.lit(1)).alias("match_count"))
    return m.orderBy("doc_id").limit(40).join(F.broadcast(n)).select("doc_id", "match_count", (F.col("match_count") > 40).alias("truncated"))


_SCORE_SQL = f"""s AS (SELECT doc_id, lang, n_chars, t, [list_position_of for list_position_of in [strpos(t, 'the'), strpos(t, 'ing')] if list_position_of > 0] AS hit
 FROM (SELECT doc_id, lang, n_chars, lower({_TITLE}) AS t FROM documents)),
 scored AS (SELECT doc_id, CASE WHEN len(hit) = 0 THEN 0 ELSE (CASE WHEN len(hit) = 2 THEN 2000000000 ELSE 10000000 * len(hit) END) + (100000 - least(list_min(hit) - 1, 100000)) * 10000 + (1990 + n_chars % 30) + (lang = 'en')::INT END::BIGINT AS score FROM s)"""


def _score(title, terms, when, regular):
    """All terms 2e9, else 1e7 each; earlier hits, later years and regular items first. No hit is 0."""
    at = F.filter(F.array(*[F.locate(t, title) for t in terms]), lambda p: p > 0)
    base = F.when(F.size(at) == len(terms), F.lit(2_000_000_000).cast("bigint")).otherwise(F.size(at).cast("bigint") * 10_000_000)
    near = (F.lit(100_000) - F.least(F.array_min(at) - 1, F.lit(100_000))).cast("bigint") * 10_000
    return F.when(F.size(at) == 0, F.lit(0).cast("bigint")).otherwise(base + near + when + regular.cast("bigint"))


def _scored(spark, d):
    return _docs(spark, d).select("doc_id", "source", _score(F.lower("title"), ["the", "ing"], (F.col("n_chars") % 30 + 1990).cast("bigint"), F.col("lang") == "en").alias("score"))


@query(f"WITH {_SCORE_SQL} SELECT doc_id, score FROM scored")
def score(spark, d):
    return _scored(spark, d).select("doc_id", "score")


@query(f"WITH {_SCORE_SQL} SELECT doc_id, score FROM scored WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20 OFFSET 20")
def quick_search_ranked(spark, d):
    return _scored(spark, d).where("score > 0").orderBy(F.desc("score"), "doc_id").offset(20).limit(20).select("doc_id", "score")


@query("SELECT o_orderkey AS id, 'direct' AS via FROM orders WHERE o_custkey % 20 = 0 UNION SELECT l_orderkey * 10 + l_linenumber, 'parent' FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 20 = 0 AND l_returnflag = 'R' ORDER BY id, via LIMIT 200")
def list_items(spark, d):
    parents = table(spark, d, "orders").where("o_custkey % 20 = 0")
    direct = parents.select(F.col("o_orderkey").alias("id"), F.lit("direct").alias("via"))
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R'").join(parents, F.col("l_orderkey") == F.col("o_orderkey"))
    return direct.union(lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.lit("parent"))).distinct().orderBy("id", "via").limit(200)


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 7) AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) ORDER BY c_custkey LIMIT 1000")
def population(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    rows = table(spark, d, "customer").where("c_nationkey IN (3, 7) AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
    return rows.join(orders, "c_custkey", "left_semi").orderBy("c_custkey").limit(1000).select("c_custkey")


@query("SELECT doc_id, coalesce(toxic = 1, false) AS in_trash, coalesce(toxic = 1, true) AS treated_as_trash FROM documents LEFT JOIN labels USING (doc_id)")
def trash_filter(spark, d):
    """Unlabelled is unknown; callers that cannot know treat unknown as trashed."""
    t = F.col("toxic") == 1
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce(t, F.lit(False)).alias("in_trash"), F.coalesce(t, F.lit(True)).alias("treated_as_trash"))


@query("SELECT event_id, user_id FROM events WHERE event_type IN (SELECT event_type FROM events GROUP BY 1 ORDER BY 1 LIMIT 2) AND value > 10 ORDER BY ts DESC, event_id LIMIT 25")
def find_annotations(spark, d):
    e = table(spark, d, "events")
    kinds = e.groupBy("event_type").count().orderBy("event_type").limit(2).select("event_type")
    return e.where("value > 10").join(F.broadcast(kinds), "event_type", "left_semi").orderBy(F.desc("ts"), "event_id").limit(25).select("event_id", "user_id")


@query("SELECT l_orderkey, l_linenumber, count(*) OVER ()::BIGINT AS total FROM lineitem WHERE l_returnflag = 'R' ORDER BY l_orderkey, l_linenumber LIMIT 25 OFFSET 25")
def annotation_page(spark, d):
    rows = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy("l_orderkey", "l_linenumber").offset(25).limit(25).join(F.broadcast(total))


@query("SELECT p_partkey, replace(replace(replace(p_name, '\\', '\\\\'), '%', '\\%'), '_', '\\_') AS escaped FROM part")
def like_escape(spark, d):
    n = F.col("p_name")
    for c in ("\\", "%", "_"):
        n = F.replace(n, F.lit(c), F.lit("\\" + c))
    return table(spark, d, "part").select("p_partkey", n.alias("escaped"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 6 MONTH")
def modified_in_last(spark, d):
    last = table(spark, d, "orders").agg((F.max("o_orderdate") - F.expr("interval 6 months")).alias("since"))
    return table(spark, d, "orders").join(F.broadcast(last), F.col("o_orderdate") >= F.col("since")).select("o_orderkey")


#: The annotation palette; earlier colours win ties.
PALETTE = {"yellow": "ffd400", "red": "ff6666", "green": "5fb236", "blue": "2ea8e5", "purple": "a28ae5", "magenta": "e56eee", "orange": "f19837", "gray": "aaaaaa"}
_HEX_SQL = "substr(md5(event_id::VARCHAR), 1, 6)"


def _channel(c, k):
    return F.conv(F.substring(c, 2 * k + 1, 2), 16, 10).cast("int")


@query(f"SELECT event_id, ('0x' || substr({_HEX_SQL}, 1, 2))::INT AS r, ('0x' || substr({_HEX_SQL}, 3, 2))::INT AS g, ('0x' || substr({_HEX_SQL}, 5, 2))::INT AS b FROM events")
def hex_rgb(spark, d):
    h = F.substring(F.md5(F.col("event_id").cast("string")), 1, 6)
    return table(spark, d, "events").select("event_id", *[_channel(h, k).alias(n) for k, n in enumerate("rgb")])


@query("SELECT event_id, CASE WHEN h NOT SIMILAR TO '[0-9a-f]+' THEN NULL WHEN length(h) = 6 THEN h WHEN length(h) = 3 THEN substr(h,1,1)||substr(h,1,1)||substr(h,2,1)||substr(h,2,1)||substr(h,3,1)||substr(h,3,1) END AS hex FROM (SELECT event_id, substr(md5(event_id::VARCHAR), 1, (CASE event_id % 3 WHEN 0 THEN 6 WHEN 1 THEN 3 ELSE 4 END)::INT) AS h FROM events)")
def hex_normalize(spark, d):
    raw = F.concat(F.lit("#"), F.expr("left(md5(cast(event_id AS string)), CASE event_id % 3 WHEN 0 THEN 6 WHEN 1 THEN 3 ELSE 4 END)"))
    h = F.regexp_replace(F.lower(raw), "^#", "")
    hexed = F.when(h.rlike("^[0-9a-f]{6}$"), h).when(h.rlike("^[0-9a-f]{3}$"), F.regexp_replace(h, "(.)", "$1$1"))
    return table(spark, d, "events").select("event_id", hexed.alias("hex"))


@query(
    "WITH e AS (SELECT event_id, substr(md5(event_id::VARCHAR), 1, 6) AS h FROM events), p(i, name, x) AS (VALUES "
    + ", ".join(f"({i}, '{n}', '{x}')" for i, (n, x) in enumerate(PALETTE.items()))
    + ") SELECT event_id, arg_min(name, pow(('0x'||substr(h,1,2))::INT - ('0x'||substr(x,1,2))::INT, 2) * 100 + pow(('0x'||substr(h,3,2))::INT - ('0x'||substr(x,3,2))::INT, 2) * 100 + pow(('0x'||substr(h,5,2))::INT - ('0x'||substr(x,5,2))::INT, 2) * 100 + i) AS color FROM e, p GROUP BY event_id"
)
def nearest_color(spark, d):
    h = F.substring(F.md5(F.col("event_id").cast("string")), 1, 6)
    rows = table(spark, d, "events").select("event_id", *[_channel(h, k).alias(n) for k, n in enumerate("rgb")])
    options = [F.struct(sum((F.col(n) - int(x[2 * k : 2 * k + 2], 16)) * (F.col(n) - int(x[2 * k : 2 * k + 2], 16)) for k, n in enumerate("rgb")).alias("far"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, x) in enumerate(PALETTE.items())]
    return rows.select("event_id", F.array_min(F.array(*options))["name"].alias("color"))


@query("SELECT doc_id, lang, n_chars FROM documents")
def project_fields(spark, d):
    """Fields that cannot be read are left out."""
    rows = table(spark, d, "documents")
    return rows.select(*[c for c in ("doc_id", "lang", "n_chars", "unreadable") if c in rows.columns])


@query("SELECT n_nationkey, n_name FROM nation WHERE lower(n_name) LIKE '%an%' OR n_nationkey = 5")
def resolve_collections(spark, d):
    asked = spark.createDataFrame([("an",), ("5",), ("zzz",)], "ask string")
    hit = (F.col("n_nationkey").cast("string") == F.col("ask")) | (~F.col("ask").rlike("^[0-9]+$") & F.lower("n_name").contains(F.col("ask")))
    return table(spark, d, "nation").join(F.broadcast(asked), hit, "left_semi").select("n_nationkey", "n_name")


@query("SELECT DISTINCT o_orderpriority AS tag FROM orders WHERE lower(o_orderpriority) IN ('1-urgent', '5-low', 'none')")
def resolve_tags(spark, d):
    asked = spark.createDataFrame([("1-urgent",), ("5-LOW",), ("none",)], "ask string").select(F.lower("ask").alias("ask"))
    tags = table(spark, d, "orders").select(F.col("o_orderpriority").alias("tag")).distinct()
    return tags.join(F.broadcast(asked), F.lower("tag") == F.col("ask"), "left_semi")


@query("SELECT 'item' AS kind, c_custkey AS id, NULL::BIGINT AS parent FROM customer UNION ALL SELECT 'attachment', o_orderkey, o_custkey FROM orders")
def get_metadata(spark, d):
    items = table(spark, d, "customer").select(F.lit("item").alias("kind"), F.col("c_custkey").alias("id"), F.lit(None).cast("bigint").alias("parent"))
    return items.unionByName(table(spark, d, "orders").select(F.lit("attachment").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent")))


@query("SELECT ref, c_name, c_custkey IS NOT NULL AS found FROM (SELECT DISTINCT unnest([1, 5, 5, 999999999]) AS ref) LEFT JOIN customer ON c_custkey = ref")
def lookup_refs(spark, d):
    refs = spark.createDataFrame([(1,), (5,), (5,), (999999999,)], "ref int").distinct()
    return refs.join(table(spark, d, "customer"), F.col("ref") == F.col("c_custkey"), "left").select("ref", "c_name", F.col("c_custkey").isNotNull().alias("found"))


@query("SELECT source, count(*)::BIGINT AS items, count(DISTINCT lang)::BIGINT AS langs FROM documents GROUP BY source")
def list_libraries(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("items"), F.countDistinct("lang").alias("langs"))


# ---- joins ------------------------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)")
def anti_join(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").where("toxic = 1"), "doc_id", "left_anti")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def anti_join_three(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    return rows.join(table(spark, d, "supplier").where("s_acctbal > 9000"), F.col("c_nationkey") == F.col("s_nationkey"), "left_anti").select("c_custkey")


@query("SELECT l_orderkey AS id FROM lineitem WHERE l_partkey % 50 = 0 UNION SELECT l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 50 = 0")
def union_membership(spark, d):
    lines = table(spark, d, "lineitem")
    inside = table(spark, d, "orders").where("o_custkey % 50 = 0")
    return lines.where("l_partkey % 50 = 0").select(F.col("l_orderkey").alias("id")).union(lines.join(inside, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey")).distinct()


def _tree(spark, d):
    nations = table(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"))
    return nations.unionByName(table(spark, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.concat(F.lit("c"), "c_custkey").alias("child")))


_TREE_SQL = "edges AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"


@query(f"WITH RECURSIVE {_TREE_SQL}, walk AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS depth FROM region UNION ALL SELECT root, child, depth + 1 FROM walk JOIN edges ON node = parent) SELECT root, node, depth FROM walk")
def closure(spark, d):
    roots = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("root"))
    return E.closure(_tree(spark, d), roots)


@query(f"WITH RECURSIVE {_TREE_SQL}, walk AS (SELECT 'r1' AS node, 0 AS depth UNION ALL SELECT child, depth + 1 FROM walk JOIN edges ON node = parent) SELECT node, depth FROM walk")
def hierarchy_bfs(spark, d):
    return E.closure(_tree(spark, d), spark.createDataFrame([("r1",)], "root string")).select("node", "depth")


@query("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 AND o_orderstatus <> 'F'")
def collection_scope(spark, d):
    scope = E.closure(_tree(spark, d), spark.createDataFrame([("r1",)], "root string")).where("depth = 2").select(F.substring("node", 2, 20).cast("bigint").alias("o_custkey"))
    return table(spark, d, "orders").where("o_orderstatus <> 'F'").join(scope, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT o_orderpriority AS tag, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS finished, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS open, count(*)::BIGINT AS total FROM orders GROUP BY 1 HAVING count(*) >= 2 ORDER BY total DESC, tag LIMIT 50")
def list_tags(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("tag")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count(F.lit(1)).alias("total"))
    return n.where("total >= 2").orderBy(F.desc("total"), "tag").limit(50)


@query("SELECT n.n_name AS name, r.r_name AS parent, coalesce(k, 0)::BIGINT AS members FROM nation n LEFT JOIN region r ON n_regionkey = r_regionkey LEFT JOIN (SELECT c_nationkey, count(*) AS k FROM customer GROUP BY 1) ON c_nationkey = n_nationkey")
def collection_counts_parent(spark, d):
    members = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("members"))
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").join(members, "n_nationkey", "left")
    return rows.select(F.col("n_name").alias("name"), F.col("r_name").alias("parent"), F.coalesce("members", F.lit(0)).alias("members"))


@query("SELECT l_orderkey, l_linenumber, o_custkey, c_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey")
def parent_attach(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select("l_orderkey", "l_linenumber", "o_custkey", "c_name")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'F') AS has_attachments FROM customer")
def has_attachments(spark, d):
    live = table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(True))
    return table(spark, d, "customer").join(live, "c_custkey", "left").select("c_custkey", F.coalesce("has", F.lit(False)).alias("has_attachments"))


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'O'")
def expand_children(spark, d):
    return table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").join(table(spark, d, "orders").where("o_orderstatus = 'O'"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey")


@query("SELECT event_id, (SELECT count(*) FROM events m WHERE m.user_id = e.user_id AND m.event_type = 'purchase' AND m.event_id <= e.event_id)::BIGINT AS page FROM events e")
def asof_page(spark, d):
    """The number of markers at or before a position; Spark orders markers and positions in one window."""
    w = W.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, d, "events").withColumn("page", F.count_if(F.col("event_type") == "purchase").over(w))
    return rows.select("event_id", "page")


@query("SELECT event_id, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS label FROM events")
def asof_label(spark, d):
    marker = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return table(spark, d, "events").select("event_id", F.last(marker, ignorenulls=True).over(W.partitionBy("user_id").orderBy("event_id")).alias("label"))


@query("WITH b AS (SELECT l_orderkey AS k, l_linenumber AS i, l_partkey % 100 AS x0, l_partkey % 100 + 10 AS x1 FROM lineitem) SELECT a.k, a.i, min(b.i) AS hit FROM b a JOIN b ON a.k = b.k AND a.i <> b.i AND a.x0 <= b.x1 + 2 AND b.x0 <= a.x1 + 2 GROUP BY ALL")
def bbox_join(spark, d):
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), (F.col("l_partkey") % 100).alias("x0"), (F.col("l_partkey") % 100 + 10).alias("x1"))
    near = E.overlapping(b.withColumn("x1", F.col("x1") + 2), ["k"], "i", "x0", "x1", 16, closed=True)
    return near.groupBy("k", F.col("i_x").alias("i")).agg(F.min("i_y").alias("hit"))


@query("WITH e AS (SELECT l_orderkey AS doc, l_linenumber AS i, l_partkey % 60 AS a, l_partkey % 60 + l_quantity::INT AS b FROM lineitem) SELECT x.doc, x.i, y.i AS j FROM e x JOIN e y ON x.doc = y.doc AND x.i < y.i AND x.a < y.b AND y.a < x.b")
def interval_overlap(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("i"), (F.col("l_partkey") % 60).alias("a"), (F.col("l_partkey") % 60 + F.col("l_quantity").cast("int")).alias("b"))
    return E.overlapping(e, ["doc"], "i", "a", "b", 16).where("i_x < i_y").select("doc", F.col("i_x").alias("i"), F.col("i_y").alias("j"))


# ---- counts -----------------------------------------------------------------------------------------------------


@query("SELECT c_nationkey AS collection, count(*) FILTER (c_mktsegment = 'BUILDING')::BIGINT AS items, count(*) FILTER (c_mktsegment = 'MACHINERY')::BIGINT AS attachments, count(*) FILTER (c_acctbal < 0)::BIGINT AS notes FROM customer GROUP BY 1")
def collection_counts(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("collection")).agg(F.count_if(F.col("c_mktsegment") == "BUILDING").alias("items"), F.count_if(F.col("c_mktsegment") == "MACHINERY").alias("attachments"), F.count_if(F.col("c_acctbal") < 0).alias("notes"))


@query("SELECT n_regionkey AS parent, count(*)::BIGINT AS n FROM nation GROUP BY 1")
def subcollection_counts(spark, d):
    return table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("parent")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name AS name, coalesce(k, 0)::BIGINT AS items FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS k FROM customer GROUP BY 1) ON c_nationkey = n_nationkey ORDER BY name LIMIT 10 OFFSET 5")
def list_collections(spark, d):
    return collection_counts_parent(spark, d).select("name", F.col("members").alias("items")).orderBy("name").offset(5).limit(10)


@query("SELECT source, count(*)::BIGINT AS items, count(*) FILTER (n_chars < 500)::BIGINT AS notes, count(DISTINCT lang)::BIGINT AS tags, sum(n_chars)::BIGINT AS size FROM documents GROUP BY source")
def library_summary(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("n_chars") < 500).alias("notes"), F.countDistinct("lang").alias("tags"), F.sum("n_chars").alias("size"))


@query("SELECT count(*)::BIGINT AS size, count(DISTINCT lang)::BIGINT AS tags, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))::BIGINT AS unfiled FROM documents")
def library_shape(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id").distinct().withColumn("filed", F.lit(1))
    return docs.select("doc_id", "lang").join(labels, "doc_id", "left").agg(F.count(F.lit(1)).alias("size"), F.countDistinct("lang").alias("tags"), F.count_if(F.col("filed").isNull()).alias("unfiled"))


@query("SELECT count(*) FILTER (p_type LIKE 'STANDARD%')::BIGINT AS standard, count(*) FILTER (p_type LIKE '%STEEL')::BIGINT AS steel, count(*)::BIGINT AS parts FROM part")
def library_stats(spark, d):
    t = F.col("p_type")
    return table(spark, d, "part").agg(F.count_if(t.startswith("STANDARD")).alias("standard"), F.count_if(t.endswith("STEEL")).alias("steel"), F.count(F.lit(1)).alias("parts"))


@query("SELECT source, sum(n)::BIGINT AS total FROM (SELECT source, md5(text) AS h, max(n_chars) AS n FROM documents GROUP BY 1, 2) GROUP BY source")
def distinct_sum(spark, d):
    """Sizes summed once for each distinct content in a library."""
    return table(spark, d, "documents").groupBy("source", F.md5(F.col("text").cast("binary")).alias("h")).agg(F.max("n_chars").alias("n")).groupBy("source").agg(F.sum("n").alias("total"))


@query("SELECT o_orderstatus, max(o_orderdate) AS last, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def index_state(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.max("o_orderdate").alias("last"), F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT label FROM embeddings", name="distinct")
def distinct_(spark, d):
    return table(spark, d, "embeddings").select("label").distinct()


@query("SELECT user_id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, max(ts) AS last FROM (SELECT user_id, 'view' AS kind, ts FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, 'buy', ts FROM events WHERE event_type = 'purchase' UNION ALL SELECT user_id, 'big', ts FROM events WHERE value > 50) GROUP BY 1 ORDER BY last DESC, user_id LIMIT 15")
def active_items(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_type", "value")
    feeds = [e.where(c).select("user_id", F.lit(k).alias("kind"), "ts") for c, k in (("event_type = 'view'", "view"), ("event_type = 'purchase'", "buy"), ("value > 50", "big"))]
    rows = feeds[0].unionByName(feeds[1]).unionByName(feeds[2]).groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.max("ts").alias("last"))
    return rows.orderBy(F.desc("last"), "user_id").limit(15)


@query("SELECT event_type AS kind, event_id FROM events UNION ALL SELECT 'big', event_id FROM events WHERE value > 90 UNION ALL SELECT 'small', event_id FROM events WHERE value < 1")
def union_all(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("kind"), "event_id").unionByName(e.where("value > 90").select(F.lit("big").alias("kind"), "event_id")).unionByName(e.where("value < 1").select(F.lit("small").alias("kind"), "event_id"))


_TOP_SQL = "c AS (SELECT n_name, count(*)::BIGINT AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1), t AS (SELECT n_name, n FROM c ORDER BY n DESC, n_name LIMIT 5)"


@query(f"WITH {_TOP_SQL} SELECT * FROM t UNION SELECT * FROM c WHERE n_name = (SELECT max(n_name) FROM c)")
def top_collections(spark, d):
    """The five largest, and the current one in any case."""
    c = table(spark, d, "nation").join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))
    current = c.orderBy(F.desc("n_name")).limit(1)
    return c.orderBy(F.desc("n"), "n_name").limit(5).union(current).distinct()


@query("WITH s AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) SELECT c_custkey FROM s WHERE n <= 4 OR pos IN (0, floor((n - 1) / 3.0 + 0.5), floor(2 * (n - 1) / 3.0 + 0.5), n - 1)")
def even_sample(spark, d):
    w = W.partitionBy("c_nationkey")
    s = table(spark, d, "customer").select("c_custkey", (F.row_number().over(w.orderBy("c_custkey")) - 1).cast("bigint").alias("pos"), F.count(F.lit(1)).over(w).alias("n"))
    return s.where(F.array_contains(E.even_positions(F.col("n"), 4), F.col("pos"))).select("c_custkey")


@query("SELECT event_type, CASE WHEN value < 5 THEN 'low' ELSE 'ok' END AS message, count(*)::BIGINT AS n FROM events GROUP BY 1, 2 ORDER BY n DESC, event_type, message LIMIT 20")
def error_histogram(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.when(F.col("value") < 5, "low").otherwise("ok").alias("message")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type", "message").limit(20)


# ---- windows, top-k, paging -------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'R') DESC, (l_linestatus = 'O') DESC, l_shipdate, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def best_child(spark, d):
    order = [F.desc(F.col("l_returnflag") == "R"), F.desc(F.col("l_linestatus") == "O"), F.asc("l_shipdate"), F.asc("l_linenumber")]
    return E.latest(table(spark, d, "lineitem"), ["l_orderkey"], order).select("l_orderkey", "l_linenumber")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def latest_version(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", "o_orderkey").alias("o_orderkey"))


_LATEST = "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1"


@query(_LATEST)
def latest_date(spark, d):
    best = table(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("b"))
    return best.select("o_custkey", "b.o_orderkey", "b.o_orderdate")


@query(f"SELECT * FROM ({_LATEST}) ORDER BY o_orderdate DESC, o_custkey LIMIT 100")
def dedup_latest(spark, d):
    return E.latest(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_custkey").limit(100)


@query("SELECT event_id, coalesce(event_type = lag(event_type) OVER w, false) AS same_as_before, event_id - lag(event_id) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def lag_consecutive(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.coalesce(F.col("event_type") == F.lag("event_type").over(w), F.lit(False)).alias("same_as_before"), (F.col("event_id") - F.lag("event_id").over(w)).alias("gap"))


@query("WITH f AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) SELECT user_id, event_type, dense_rank() OVER (PARTITION BY user_id ORDER BY first) AS marker FROM f")
def first_seen_rank(spark, d):
    f = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    return f.select("user_id", "event_type", F.dense_rank().over(W.partitionBy("user_id").orderBy("first")).alias("marker"))


@query("SELECT l_orderkey, count(*) >= 2 AND coalesce(min(step) > 0, false) AS increasing FROM (SELECT l_orderkey, l_partkey - lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS step FROM lineitem) GROUP BY 1")
def monotonic(spark, d):
    step = F.col("l_partkey") - F.lag("l_partkey").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    return table(spark, d, "lineitem").select("l_orderkey", step.alias("step")).groupBy("l_orderkey").agg(((F.count(F.lit(1)) >= 2) & F.coalesce(F.min("step") > 0, F.lit(False))).alias("increasing"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag || row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS id FROM lineitem")
def running_ids(spark, d):
    w = W.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", F.row_number().over(w)).alias("id"))


@query("SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM conversations")
def running_offset(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).cast("bigint").alias("off"))


@query("SELECT least(count(*), 300)::BIGINT AS n FROM documents")
def capped_count(spark, d):
    return table(spark, d, "documents").select("doc_id").limit(300).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, role = lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS joins FROM conversations")
def lead_join(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", (F.col("role") == F.lead("role").over(W.partitionBy("conv_id").orderBy("turn"))).alias("joins"))


_SIM_SQL = "(SELECT e.vec_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS sim FROM embeddings e)"


def _similar(spark, d):
    e = table(spark, d, "embeddings").withColumn("x", F.transform("embedding", lambda v: v.cast("double")))
    q = e.where("vec_id = 0").select(F.col("x").alias("q")).limit(1)

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda p, r: p * r), F.lit(0.0), lambda s, p: s + p)

    rows = e.join(F.broadcast(q))  # one query vector
    norm = F.sqrt(dot("x", "x")) * F.sqrt(dot("q", "q"))
    return rows.select("vec_id", "label", F.round(F.when(norm > 0, dot("x", "q") / norm).otherwise(0.0), 6).alias("sim"))


@query(f"SELECT vec_id, sim FROM {_SIM_SQL} WHERE sim >= 0.1")
def cosine_scan(spark, d):
    return _similar(spark, d).where("sim >= 0.1").select("vec_id", "sim")


@query(f"SELECT vec_id, sim FROM {_SIM_SQL} WHERE sim >= 0.1 AND vec_id <> 0 ORDER BY sim DESC, vec_id LIMIT 20")
def find_similar(spark, d):
    return _similar(spark, d).where("sim >= 0.1 AND vec_id <> 0").orderBy(F.desc("sim"), "vec_id").limit(20).select("vec_id", "sim")


@query(f"SELECT vec_id, sim FROM {_SIM_SQL} WHERE sim >= 0.1 AND vec_id % 7 <> 0 ORDER BY sim DESC, vec_id LIMIT 20")
def semantic_topk(spark, d):
    trash = table(spark, d, "embeddings").where("vec_id % 7 = 0").select("vec_id")
    return _similar(spark, d).where("sim >= 0.1").join(trash, "vec_id", "left_anti").orderBy(F.desc("sim"), "vec_id").limit(20).select("vec_id", "sim")


@query(f"SELECT vec_id, sim, lang FROM {_SIM_SQL} JOIN documents ON doc_id = vec_id WHERE sim >= 0.05 AND (n_chars % 40 + 1990 >= 2000 OR n_chars % 40 = 0) AND source <> 'src0' ORDER BY sim DESC, vec_id LIMIT 10 OFFSET 5")
def topic_search(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source", F.nullif(F.col("n_chars") % 40, F.lit(0).cast("bigint")).alias("y"))
    rows = _similar(spark, d).where("sim >= 0.05").join(docs, "vec_id").where("(y IS NULL OR y + 1990 >= 2000) AND source <> 'src0'")  # a missing year passes
    return rows.orderBy(F.desc("sim"), "vec_id").offset(5).limit(10).select("vec_id", "sim", "lang")


_Q8 = "list_transform(embedding, lambda x: greatest(-128, least(127, floor(x::DOUBLE * 127 + 0.5)))::INT)"


def _int8(c="embedding"):
    return F.transform(c, lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), F.floor(x.cast("double") * 127 + 0.5))).cast("int"))


@query(f"SELECT vec_id, array_to_string({_Q8}, ',') AS q FROM embeddings")
def quantize_int8(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.array_join(F.transform(_int8(), lambda x: x.cast("string")), ",").alias("q"))


_DOT_SQL = f"WITH q AS (SELECT vec_id, {_Q8} AS x FROM embeddings), p AS (SELECT a.vec_id, a.x, b.x AS y FROM q a, (SELECT x FROM q WHERE vec_id = 0) b), s AS (SELECT vec_id, list_sum(list_transform(list_zip(x, y), lambda z: z[1] * z[2])) AS dot, list_sum(list_transform(x, lambda v: v * v)) AS xx, list_sum(list_transform(y, lambda v: v * v)) AS yy, len(x) AS n FROM p)"


def _dots(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", _int8().alias("x"))
    rows = e.join(F.broadcast(e.where("vec_id = 0").select(F.col("x").alias("y")).limit(1)))

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda p, r: p * r), F.lit(0), lambda s, p: s + p).cast("double")

    return rows.select("vec_id", dot("x", "y").alias("dot"), dot("x", "x").alias("xx"), dot("y", "y").alias("yy"), F.size("x").alias("n"))


@query(_DOT_SQL + " SELECT vec_id, round(CASE WHEN xx * yy = 0 THEN 0 ELSE dot / (sqrt(xx) * sqrt(yy)) END, 6) AS sim FROM s")
def cosine(spark, d):
    return _dots(spark, d).select("vec_id", F.round(F.when(F.col("xx") * F.col("yy") == 0, 0.0).otherwise(F.col("dot") / (F.sqrt("xx") * F.sqrt("yy"))), 6).alias("sim"))


@query(_DOT_SQL + " SELECT vec_id, round((dot + 128 * 127 * n) / (127 * 127 * n + 128 * 127 * n), 6) AS sim FROM s")
def dot_scaled(spark, d):
    low, high = F.col("n") * (-128 * 127), F.col("n") * (127 * 127)
    return _dots(spark, d).select("vec_id", F.round((F.col("dot") - low) / (high - low), 6).alias("sim"))


@query("SELECT o_orderkey, lpad(o_custkey::VARCHAR, 12, '0') || ':' || o_orderkey AS sort_key FROM orders ORDER BY sort_key LIMIT 100")
def annotation_sort(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.concat(F.lpad(F.col("o_custkey").cast("string"), 12, "0"), F.lit(":"), "o_orderkey").alias("sort_key")).orderBy("sort_key").limit(100)


@query("SELECT doc_id, (SELECT count(*) FROM documents) > 30 AS has_more FROM documents ORDER BY doc_id LIMIT 20 OFFSET 10")
def page_has_more(spark, d):
    return E.page(table(spark, d, "documents").select("doc_id"), [F.asc("doc_id")], 10, 20)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def recent_items(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10).select("o_orderkey")


@query("SELECT conv_id, n, list_transform(range(0, least(n, 3)), lambda k: floor(k * n / least(n, 3))::BIGINT)[-1] AS last_sampled FROM (SELECT conv_id, count(*)::BIGINT AS n FROM conversations GROUP BY 1)")
def spread_sample(spark, d):
    n = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    count = F.least(F.col("n"), F.lit(3))
    picks = F.transform(F.sequence(F.lit(0).cast("bigint"), count - 1), lambda k: F.floor(k * F.col("n") / count))
    return n.select("conv_id", "n", F.element_at(picks, -1).alias("last_sampled"))


# ---- sets -------------------------------------------------------------------------------------------------------


@query("WITH t AS (SELECT c_custkey FROM customer WHERE c_custkey % 50 = 0), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT * FROM t)) SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT * FROM o)")
def cascade_trash(spark, d):
    trash = table(spark, d, "customer").where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("o_custkey"))
    gone = table(spark, d, "orders").join(trash, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(gone, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


def _snapshots(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "n_chars")
    old = docs.where("doc_id % 11 <> 0").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    new = docs.where("doc_id % 13 <> 0 AND n_chars >= 40").select("doc_id", F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary")).alias("h"))
    return old, new


_SNAP_SQL = "WITH o AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 11 <> 0), n AS (SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 13 <> 0 AND n_chars >= 40)"


@query(_SNAP_SQL + " SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'add' WHEN n.doc_id IS NULL THEN 'delete' ELSE 'update' END AS change FROM o FULL JOIN n USING (doc_id) WHERE o.h IS DISTINCT FROM n.h")
def index_diff(spark, d):
    return E.snapshot_diff(*_snapshots(spark, d), "doc_id", "h").where("change <> 'same'")


@query(_SNAP_SQL + " SELECT n.doc_id FROM n LEFT JOIN o USING (doc_id) WHERE o.h IS NULL OR o.h <> n.h")
def changed_only(spark, d):
    old, new = _snapshots(spark, d)
    return new.join(old.select("doc_id", F.col("h").alias("was")), "doc_id", "left").where("was IS NULL OR was <> h").select("doc_id")


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def orphans(spark, d):
    """Vectors of documents that are not labelled."""
    return table(spark, d, "embeddings").select("vec_id").join(table(spark, d, "labels").select("doc_id"), F.col("vec_id") == F.col("doc_id"), "left_anti")


@query("SELECT DISTINCT label FROM embeddings WHERE label NOT IN (0, 1, 2)")
def partition_prune(spark, d):
    allowed = spark.createDataFrame([(0,), (1,), (2,)], "label int")
    return table(spark, d, "embeddings").select("label").distinct().join(F.broadcast(allowed), "label", "left_anti")


@query("SELECT doc_id FROM documents WHERE lang = 'fr' INTERSECT SELECT doc_id FROM labels WHERE quality = 1", name="intersect")
def intersect_(spark, d):
    return table(spark, d, "documents").where("lang = 'fr'").select("doc_id").intersect(table(spark, d, "labels").where("quality = 1").select("doc_id"))


@query(_SNAP_SQL + " SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'delete_remote' WHEN n.doc_id IS NULL THEN 'add_remote' WHEN o.h = n.h THEN 'same' WHEN doc_id % 2 = 0 THEN 'update_remote' ELSE 'keep' END AS action FROM o FULL JOIN n USING (doc_id)")
def sync_diff(spark, d):
    """Local against remote: missing here goes there, only here is added, changed goes if the version here is newer."""
    change = F.col("change")
    action = F.when(change == "add", "delete_remote").when(change == "delete", "add_remote").when(change == "same", "same").when(F.col("doc_id") % 2 == 0, "update_remote").otherwise("keep")
    return E.snapshot_diff(*_snapshots(spark, d), "doc_id", "h").select("doc_id", action.alias("action"))


@query("SELECT o_orderkey, (o_custkey % 5 > o_orderkey % 5) OR (o_custkey % 5 = o_orderkey % 5 AND o_orderdate >= TIMESTAMP '1996-01-01') AS goes FROM orders")
def sync_should_update(spark, d):
    a, b = F.col("o_custkey") % 5, F.col("o_orderkey") % 5
    return table(spark, d, "orders").select("o_orderkey", ((a > b) | ((a == b) & (F.col("o_orderdate") >= F.expr("timestamp_ntz '1996-01-01 00:00:00'")))).alias("goes"))


@query("SELECT vec_id FROM embeddings LEFT JOIN documents ON doc_id = vec_id LEFT JOIN labels USING (doc_id) WHERE documents.doc_id IS NULL OR toxic = 1")
def stale_keys(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lit(1).alias("there"))
    rows = table(spark, d, "embeddings").select("vec_id").join(docs, F.col("vec_id") == F.col("doc_id"), "left").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return rows.where("there IS NULL OR toxic = 1").select("vec_id")


_LINKS_SQL = "l AS (SELECT event_id AS id, CASE WHEN event_id % 97 = 0 THEN event_id + 7 WHEN event_type IN ('click', 'view') OR event_id % 97 = 7 THEN event_id - 7 END AS before FROM events)"


@query(
    f"WITH RECURSIVE {_LINKS_SQL}, e AS (SELECT id FROM l WHERE id NOT IN (SELECT before FROM l WHERE before IS NOT NULL)),"
    " w AS (SELECT e.id AS run, e.id AS id, 0 AS depth, [e.id] AS met FROM e UNION ALL SELECT run, n.id, depth + 1, list_append(met, n.id) FROM w JOIN l ON l.id = w.id JOIN l n ON n.id = l.before WHERE NOT list_contains(met, n.id)) SELECT run, id, depth::INT AS depth FROM w"
)
def chain_walk(spark, d):
    """The runs that each last run continues, by links to the one before; some links are circles, some lead nowhere."""
    e, k = table(spark, d, "events"), F.col("event_id") % 97
    before = F.when(k == 0, F.col("event_id") + 7).when(F.col("event_type").isin("click", "view") | (k == 7), F.col("event_id") - 7)
    links = e.select(F.col("event_id").alias("parent"), before.alias("child"))
    there = stored(links.where("child IS NOT NULL").join(e.select(F.col("event_id").alias("child")), "child", "left_semi"), "links")  # read for every level
    last = links.select(F.col("parent").alias("root")).join(there.select(F.col("child").alias("root")), "root", "left_anti")
    return E.closure(there, last).select(F.col("root").alias("run"), F.col("node").alias("id"), "depth")
