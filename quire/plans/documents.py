"""Queries of documents: lines, sentences, repeated lines, in-document search, matching, duplicates, HTML, scalars.

Test tables stand for entities: documents are items whose title is the first line, benchmark is a list of references,
pages are HTML snapshots, parts carry tags.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sentences as S
from ..functions import text as T
from ..operators import analysis as A
from ..operators import duplicates as D
from ..operators import matching as M
from ..sources import small_batches, table
from ..sources import text_lines as plain_lines
from .catalog import query

_ASCII = "lower(trim(regexp_replace({c}, '[^a-zA-Z0-9]+', ' ', 'g')))"
_FIRST = "split_part(text, chr(10), 1)"


def _key(c):
    """A text key for matching: letters A-Z and digits, one space between, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, "[^a-zA-Z0-9]+", " ")))


def _lines(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.split("text", "\n").alias("parts"))
    return docs.select("doc_id", "source", F.posexplode("parts").alias("pos", "line"))


# ---- lines and sentences -------------------------------------------------------------------------------------------


@query("WITH t AS (SELECT doc_id, string_split(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN chr(65279) || replace(text, chr(10), chr(13) || chr(10)) ELSE text END, '^\ufeff', '').replace(chr(13) || chr(10), chr(10)).replace(chr(13), chr(10)), chr(10)) AS lines FROM documents WHERE length(text) > 0) SELECT doc_id, pos AS line_no, line FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM t)")
def text_lines(spark, d):
    """Lines of plain files; each third one begins with a byte-order mark and ends lines as DOS does."""
    dos = F.concat(F.lit("\ufeff"), F.replace("text", F.lit("\n"), F.lit("\r\n")))
    files = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, dos).otherwise(F.col("text")).alias("text"))
    return plain_lines(files, "doc_id", "text")


_WINDOW = 3, 4
_WINDOW_SQL = "t AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)"


@query(f"WITH {_WINDOW_SQL} SELECT doc_id, array_to_string(lines[3:6], chr(10)) AS text, len(lines)::INT AS total, len(lines) > 6 AS has_more, CASE WHEN len(lines) > 6 THEN 7 END::INT AS next_offset FROM t")
def line_window(spark, d):
    """Lines 3 to 6 of each text, how many there are, whether some follow and where to go on."""
    return table(spark, d, "documents").select("doc_id", T.line_window(F.col("text"), *_WINDOW).alias("w")).select("doc_id", "w.*")


@query("WITH l AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT line, count(*)::BIGINT AS docs FROM l WHERE length(trim(line)) >= 3 GROUP BY 1 HAVING count(*) >= 3")
def repeated_lines(spark, d):
    """Lines in three documents or more, each counted once for a document."""
    seen = _lines(spark, d).where(F.length(F.trim("line")) >= 3).select("doc_id", "line").distinct()
    return seen.groupBy("line").agg(F.count(F.lit(1)).alias("docs")).where("docs >= 3")


@query(
    r"SELECT doc_id, pos - 1 AS pos, sentence FROM (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'), '([。！？])', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+', '')), lambda x: x <> '') AS s FROM documents))"
)
def sentences_simple(spark, d):
    """Sentences up to terminal punctuation before white space, or to a terminator of a script without spaces."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(S.sentences_simple(F.col("text"))).alias("pos", "sentence"))
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "sentence")


#: Texts as they would be set: some words cut at line ends, some of the same joined by a hyphen inside a line.
_SET = "replace(replace(text, 'er ', 'er-' || chr(10)), ' the', '-the')"
_SET_SQL = f"t AS (SELECT doc_id, string_split({_SET}, chr(10)) AS ls FROM documents), l AS (SELECT doc_id AS doc, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM t)"
_COMPOUND_SQL = r"w AS (SELECT DISTINCT doc, unnest(regexp_extract_all(line, '\p{L}+(?:-\p{L}+)+')) AS w FROM l), k AS (SELECT doc, string_split(lower(w), '-') AS p FROM w), c AS (SELECT DISTINCT doc, compound FROM (SELECT doc, unnest(list_transform(range(1, len(p)), lambda i: p[i] || '-' || p[i + 1])) AS compound FROM k))"
_URL_SQL = "(?i)" + "|".join(f"(?:{x})" for x in T.url_signs())


def _set_lines(spark, d):
    text = F.replace(F.replace("text", F.lit("er "), F.lit("er-\n")), F.lit(" the"), F.lit("-the"))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return rows.select("doc", F.col("pos").cast("bigint").alias("pos"), "line")


@query(
    f"WITH {_SET_SQL}, {_COMPOUND_SQL}, e AS (SELECT doc, pos, regexp_replace(line, '\\s+$', '') AS a, regexp_replace(lead(line) OVER (PARTITION BY doc ORDER BY pos), '^\\s+', '') AS b FROM l),"
    " h AS (SELECT *, regexp_extract(a, '(\\p{L}+)-$', 1) AS x, regexp_extract(b, '^(\\p{L}+)', 1) AS y FROM e), j AS (SELECT *, lower(x || '-' || y) AS compound FROM h WHERE x <> '' AND y <> '')"
    f" SELECT j.doc, j.pos, CASE WHEN regexp_matches(regexp_extract(a, '\\S+$'), '{_URL_SQL}') OR regexp_matches(regexp_extract(b, '^\\S+'), '{_URL_SQL}') OR c.doc IS NOT NULL THEN 'keep' ELSE 'join' END AS decision FROM j LEFT JOIN c ON c.doc = j.doc AND c.compound = j.compound"
)
def dehyphenate(spark, d):
    """What to do with each hyphen at a line's end, by the compounds that the document writes inside lines."""
    return A.line_break_hyphens(_set_lines(spark, d))


@query(f"WITH {_SET_SQL}, {_COMPOUND_SQL} SELECT doc, compound FROM c")
def compound_vocab(spark, d):
    """Compounds inside the lines of each document."""
    return A.compounds(_set_lines(spark, d))


@query("SELECT doc_id, coalesce(list_max(list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: length(x))), 0)::BIGINT AS size FROM documents")
def longest_word(spark, d):
    sizes = F.transform(F.regexp_extract_all("text", F.lit("([A-Za-z]+)")), F.length)
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.array_max(sizes), F.lit(0)).cast("bigint").alias("size"))


#: Pages of 300 characters; in three documents of four some are as a scanner leaves them, without text.
_OCR_SQL = (
    "d AS (SELECT doc_id AS doc, text, ((length(text) + 299) // 300)::BIGINT AS pages FROM documents WHERE length(text) > 0), p AS (SELECT doc, pages, page, CASE WHEN doc % 4 > 0 AND (page * 7 + doc) % 4 < doc % 4 THEN '' ELSE substr(text, page * 300 + 1, 300) END AS t FROM d, range(0, pages) r(page)),"
    r" q AS (SELECT doc, pages, page, length(t) AS n, regexp_replace(t, '\s', '', 'g') AS bare, t, length(t) - length(replace(t, chr(10), '')) AS nl FROM p),"
    r" v AS (SELECT *, list_aggregate(list_transform(string_split(bare, ''), lambda c: regexp_matches(c, '[\p{L}\p{N}]')::INT), 'sum') AS alnum FROM q),"
    " b AS (SELECT doc, pages, page, n, n < 100 OR (n - length(bare)) > 0.7 * n OR (nl > 0.6 * n AND nl < n) OR (length(bare) > 0 AND alnum < 0.3 * length(bare) AND alnum < 1000) AS bad FROM v),"
    " g AS (SELECT doc, pages, (pages > 3)::BIGINT AS s, pages - (pages > 3)::BIGINT AS av FROM d), w AS (SELECT doc, list_transform(range(0, least(20, av)), lambda k: s + (k * av) // least(20, av)) AS grid FROM g),"
    " i AS (SELECT doc, grid, list_transform(range(0, least(6, len(grid))), lambda k: grid[(k * len(grid)) // least(6, len(grid)) + 1]) AS few FROM w),"
    " a AS (SELECT i.doc, grid, few, avg(bad::INT) AS share FROM i JOIN b ON b.doc = i.doc AND list_contains(few, page) GROUP BY ALL),"
    " z AS (SELECT a.doc, any_value(pages) AS pages, count(*) AS sampled, count(*) FILTER (bad) AS issues, sum(n) AS n, sum(CASE WHEN NOT bad THEN n END) AS clean_n FROM a JOIN b ON b.doc = a.doc AND list_contains(CASE WHEN share >= 0.1 AND share < 0.8 THEN grid ELSE few END, page) GROUP BY 1)"
)


@query(f"WITH {_OCR_SQL} SELECT doc, sampled, issues, (pages >= 3 AND n < 24 * sampled) OR (issues >= 0.5 * sampled AND NOT (2 * (sampled - issues) >= sampled AND coalesce(clean_n / nullif(sampled - issues, 0), 0) >= 100)) AS needed FROM z")
def ocr_needed(spark, d):
    """Whether documents need OCR, from a few of their pages, or more where these leave it open."""
    docs = table(spark, d, "documents").where("length(text) > 0").select(F.col("doc_id").alias("doc"), "text", F.ceil(F.length("text") / 300).cast("bigint").alias("pages"))
    pages = docs.select("doc", "pages", F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,300}"), F.lit(0))).alias("page", "text")).withColumn("page", F.col("page").cast("bigint"))
    scanned = (F.col("doc") % 4 > 0) & ((F.col("page") * 7 + F.col("doc")) % 4 < F.col("doc") % 4)
    return A.ocr_decisions(pages.withColumn("text", F.when(scanned, "").otherwise(F.col("text"))), docs.select("doc", "pages"))


@query()
def window_candidates(spark, d):
    """The lines of each text where a quotation of its twelve words from the middle, some of them wrong, may stand."""
    small_batches(spark)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    rows = table(spark, d, "documents").select("doc_id", A.best_window("text", _misquoted(words)).alias("w"))
    return rows.select("doc_id", "w.*")


def _misquoted(words):
    """Twelve words from the middle, each fourth of them wrong."""
    begin = F.greatest(F.floor(F.size(words) / 2).cast("int"), F.lit(1))
    return F.array_join(F.transform(F.slice(words, begin, 12), lambda w, i: F.when(i % 4 == 3, F.concat(w, F.lit("zz"))).otherwise(w)), " ")


@query()
def snippet_candidates(spark, d):
    """The lines of each text that are most like such a quotation."""
    small_batches(spark)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(A.snippets("text", _misquoted(words))).alias("rank", "s"))
    return rows.select("doc_id", F.col("rank").cast("bigint").alias("rank"), "s.*")


# ---- search --------------------------------------------------------------------------------------------------------

#: Weights of roles in a search.
WEIGHTS = {"heading": 3.0, "body": 1.0, "caption": 0.7, "footnote": 0.3, "unknown": 0.5}
_ROLE_SQL = "CASE WHEN pos = 1 THEN 'heading' WHEN length(line) >= 80 THEN 'body' WHEN length(line) >= 40 THEN 'caption' WHEN length(line) > 0 THEN 'footnote' ELSE 'unknown' END"
_HITS_SQL = f"h AS (SELECT doc_id, line, {_ROLE_SQL} AS role, (length(lower(line)) - length(replace(lower(line), 'the', ''))) / 3 AS hits FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)), s AS (SELECT doc_id, sum(hits)::BIGINT AS hits, round(100 * sum(hits * CASE role WHEN 'heading' THEN 3 WHEN 'body' THEN 1 WHEN 'caption' THEN 0.7 WHEN 'footnote' THEN 0.3 ELSE 0.5 END) / sqrt(greatest(sum(length(line)), 200)), 4)::DOUBLE AS score FROM h GROUP BY 1 HAVING sum(hits) > 0)"


def _scores(spark, d, term="the"):
    n = F.length("line")
    role = F.when(F.col("pos") == 0, "heading").when(n >= 80, "body").when(n >= 40, "caption").when(n > 0, "footnote").otherwise("unknown")
    low = F.lower("line")
    hits = (F.length(low) - F.length(F.replace(low, F.lit(term), F.lit("")))) / len(term)
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("role"))
    rows = _lines(spark, d).select("doc_id", "line", role.alias("role"), hits.alias("hits"))
    score = F.round(F.sum(F.col("hits") * weight) * 100 / F.sqrt(F.greatest(F.sum(n), F.lit(200))), 4)
    return rows.groupBy("doc_id").agg(F.sum("hits").cast("bigint").alias("hits"), score.alias("score")).where("hits > 0")


@query(f"WITH {_HITS_SQL} SELECT doc_id, hits, score FROM s")
def page_score(spark, d):
    return _scores(spark, d)


@query(f"WITH {_HITS_SQL} SELECT doc_id, hits, score FROM s ORDER BY score DESC, doc_id LIMIT 20")
def doc_search(spark, d):
    return _scores(spark, d).orderBy(F.desc("score"), "doc_id").limit(20)


@query("SELECT doc_id, ((length(lower(text)) - length(replace(lower(text), 'ing', ''))) // 3)::BIGINT AS n FROM documents")
def occurrences(spark, d):
    low = F.lower("text")
    return table(spark, d, "documents").select("doc_id", F.floor((F.length(low) - F.length(F.replace(low, F.lit("ing"), F.lit("")))) / 3).alias("n"))


# ---- matching and duplicates ---------------------------------------------------------------------------------------


_TITLE_SQL = r"lower(trim(regexp_replace(strip_accents({c}), '[!-/:-@\[-`{{-~]+', ' ', 'g')))"


@query(
    f"WITH r AS (SELECT doc_id AS ref, {_TITLE_SQL.format(c=f'lower({_FIRST})' + " || ' !'")} AS k FROM documents JOIN (SELECT DISTINCT doc_id FROM labels) USING (doc_id)), t AS (SELECT doc_id, {_TITLE_SQL.format(c=_FIRST)} AS k FROM documents), f AS (SELECT k, min(doc_id) AS doc_id, count(*) AS n FROM t WHERE k <> '' GROUP BY 1)"
    " SELECT ref, f.doc_id, f.n::BIGINT AS n FROM r JOIN f USING (k)"
)
def match_title_norm(spark, d):
    """References, written in small letters with a mark behind them, and the first of the documents that have their title in
    normal form. Each title is one row before the join, however many documents have it."""
    first = F.substring_index("text", "\n", 1)
    docs = table(spark, d, "documents").select("doc_id", first.alias("title"))
    refs = docs.join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id").select(F.col("doc_id").alias("ref"), T.normalize_title(F.concat(F.lower("title"), F.lit(" !"))).alias("k"))
    known = docs.select("doc_id", T.normalize_title(F.col("title")).alias("k")).where("k <> ''").groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    return refs.join(known, "k").select("ref", "doc_id", "n")


#: Documents as items: a third has a DOI (some blank, in either case of letters), a quarter an ISBN (some wrong), years
#: are missing in a fifth, creators are two of seven.
_SIGN_SQL = (
    "d AS (SELECT doc_id AS id, lang AS type, split_part(text, chr(10), 1) AS raw, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 15 = 0 THEN '  ' ELSE ' 10.1/' || (CASE WHEN doc_id % 2 = 0 THEN 'AB' ELSE 'ab' END) || (doc_id % 41) END END AS doi,"
    " CASE WHEN doc_id % 4 = 0 THEN CASE WHEN doc_id % 8 = 0 THEN '0-306-40615-2' ELSE '0-306-40615-3' END END AS isbn, CASE WHEN doc_id % 5 > 0 THEN 2000 + doc_id % 5 END AS y FROM documents),"
    " g AS (SELECT id, type, doi IS NOT NULL AS has_doi, upper(trim(coalesce(doi, ''))) AS doi, isbn IS NOT NULL AS has_isbn, CASE isbn WHEN '0-306-40615-2' THEN '0306406152' ELSE '' END AS isbn,"
    r" lower(trim(regexp_replace(strip_accents(coalesce(raw, '')), '[ !-/:-@\[-`{-~]+', ' ', 'g'))) AS title, y::INT AS year, list_sort(list_distinct(['muller|' || chr((97 + id % 7)::INT), 'li|' || chr((97 + id % 3)::INT)])) AS creators FROM d)"
)


def _signatures(spark, d):
    k = F.col("doc_id")
    doi = F.when(k % 3 == 0, F.when(k % 15 == 0, "  ").otherwise(F.concat(F.lit(" 10.1/"), F.when(k % 2 == 0, "AB").otherwise("ab"), (k % 41).cast("string"))))
    isbn = F.when(k % 4 == 0, F.when(k % 8 == 0, "0-306-40615-2").otherwise("0-306-40615-3"))
    first = lambda n: F.chr(97 + k % n)
    people = F.array(F.struct(F.lit("Müller").alias("last"), first(7).alias("first")), F.struct(F.lit("Li").alias("last"), F.upper(first(3)).alias("first")))
    items = table(spark, d, "documents").select(k.alias("id"), F.col("lang").alias("type"), doi.alias("doi"), isbn.alias("isbn"), F.substring_index("text", "\n", 1).alias("title"), F.when(k % 5 > 0, 2000 + k % 5).alias("year"), people.alias("creators"), (k % 3 == 1).alias("preferred"))
    return D.signatures(items)


@query(f"WITH {_SIGN_SQL} SELECT id, type, has_doi, doi, has_isbn, isbn, title, year, array_to_string(creators, ',') AS creators FROM g")
def dup_signature(spark, d):
    return _signatures(spark, d).drop("preferred").withColumn("creators", F.array_join("creators", ","))


#: Duplicates told by groups: pairs of those that share an ISBN or a title grow with the square of a group.
_DUP_SQL = (
    _SIGN_SQL + ", c AS (SELECT type, has_doi, doi, has_isbn, isbn, title, year, creators, min(id) AS id FROM g WHERE doi <> '' OR isbn <> '' OR title <> '' GROUP BY ALL),"
    " m AS (SELECT c.id AS id_a, g.id AS id_b FROM g JOIN c ON (g.type, g.has_doi, g.doi, g.has_isbn, g.isbn, g.title, g.creators) = (c.type, c.has_doi, c.doi, c.has_isbn, c.isbn, c.title, c.creators) AND g.year IS NOT DISTINCT FROM c.year WHERE g.id > c.id),"
    " k AS (SELECT *, CASE WHEN NOT has_doi THEN 'n' WHEN doi = '' THEN 'b' ELSE 'l' END AS d, CASE WHEN NOT has_isbn THEN 'n' WHEN isbn = '' THEN 'b' ELSE 'l' END AS i FROM c),"
    " e AS (SELECT id, type, 'doi' AS field, '' AS title, doi AS value, '' AS d, '' AS i FROM k WHERE doi <> '' UNION ALL SELECT id, type, 'isbn', '', isbn, d, '' FROM k WHERE isbn <> ''"
    " UNION ALL SELECT id, type, 'year', title, year::VARCHAR, d, i FROM k WHERE title <> '' AND year IS NOT NULL UNION ALL SELECT id, type, 'creator', title, unnest(creators), d, i FROM k WHERE title <> ''),"
    " o AS (SELECT type, field, title, value, d, i, count(*) AS n, field || CASE WHEN field = 'creator' THEN ':' || value ELSE '' END || ':' || min(id) AS name FROM e GROUP BY type, field, title, value, d, i),"
    " p AS (SELECT a.name AS a, b.name AS b FROM o a JOIN o b ON (a.type, a.field, a.title) = (b.type, b.field, b.title) WHERE (a.d = 'n' OR b.d = 'n' OR (a.d <> 'l' AND b.d <> 'l')) AND (a.i = 'n' OR b.i = 'n' OR (a.i <> 'l' AND b.i <> 'l'))"
    " AND ((a.value = b.value AND (a.d || a.i < b.d || b.i OR (a.name = b.name AND a.n > 1))) OR (a.field = 'year' AND try_cast(a.value AS INT) + 1 = try_cast(b.value AS INT))))"
)


@query(
    f"WITH {_DUP_SQL} SELECT 'same' AS kind, id_a::VARCHAR AS a, id_b::VARCHAR AS b FROM m UNION ALL SELECT 'member', o.name, e.id::VARCHAR FROM e JOIN o ON (e.type, e.field, e.title, e.value, e.d, e.i) = (o.type, o.field, o.title, o.value, o.d, o.i) UNION ALL SELECT 'pair', a, b FROM p"
)
def dup_pairs(spark, d):
    """Every pair of duplicates, as pairs of groups with their members and the copies of these."""
    return D.duplicate_groups(_signatures(spark, d))


@query()
def dedup_greedy(spark, d):
    """One of each group of duplicates by DOI, ISBN or title, preferred items first."""
    return D.greedy_survivors(_signatures(spark, d))


#: References to labelled documents: without their DOI if their id is even, without their ISBN in a third, the year one off.
_REF_SQL = (
    _SIGN_SQL + ", r AS (SELECT id, CASE WHEN id % 2 = 1 THEN doi ELSE '' END AS doi, CASE WHEN id % 3 > 0 THEN isbn ELSE '' END AS isbn, CASE WHEN id % 11 = 0 THEN '' ELSE title END AS title, year + 1 AS year, creators FROM g WHERE id IN (SELECT doc_id FROM labels)),"
    " i AS (SELECT id, (SELECT min(g.id) FROM g WHERE g.doi = r.doi AND r.doi <> '') AS a, (SELECT min(g.id) FROM g WHERE g.isbn = r.isbn AND r.isbn <> '') AS b FROM r)"
)


def _references(spark, d):
    s = _signatures(spark, d)
    k = F.col("id")
    held = s.join(table(spark, d, "labels").select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi")
    held = held.withColumns({"doi": F.when(k % 2 == 1, F.col("doi")).otherwise(""), "isbn": F.when(k % 3 > 0, F.col("isbn")).otherwise(""), "title": F.when(k % 11 == 0, "").otherwise(F.col("title")), "year": F.col("year") + 1})
    return held, s


@query(f"WITH {_REF_SQL} SELECT id, coalesce(a, b) AS found, CASE WHEN a IS NOT NULL THEN 'doi' ELSE 'isbn' END AS by FROM i WHERE coalesce(a, b) IS NOT NULL")
def match_identifier(spark, d):
    """References by DOI or ISBN."""
    return D.match_identifiers(*_references(spark, d))


@query(
    f"WITH {_REF_SQL}, t AS (SELECT r.id, min(g.id) AS c FROM r JOIN i ON i.id = r.id AND a IS NULL AND b IS NULL JOIN g ON g.title = r.title AND r.title <> '' AND (g.doi = '' OR r.doi = '' OR g.doi = r.doi) AND coalesce(abs(g.year - r.year) <= 1, true) AND list_has_any(g.creators, r.creators) GROUP BY 1)"
    " SELECT i.id, coalesce(a, b, c) AS found, CASE WHEN a IS NOT NULL THEN 'doi' WHEN b IS NOT NULL THEN 'isbn' WHEN c IS NOT NULL THEN 'title' END AS by FROM i LEFT JOIN t USING (id)"
)
def match_references(spark, d):
    """Every reference with the first item that it is, by identifier or else by title, also without one."""
    return D.match_references(*_references(spark, d))


@query("SELECT DISTINCT p_brand AS tag, least(levenshtein(p_brand, 'Brand#11'), 2)::INT AS distance FROM part")
def edit_distance(spark, d):
    """Distance of at most 1, else 2."""
    return table(spark, d, "part").select(F.col("p_brand").alias("tag")).distinct().select("tag", M.bounded_distance(F.col("tag"), F.lit("Brand#11"), 1).alias("distance"))


#: Names as they might be asked for: a letter missing, two letters wrong, the first word, and the name in small letters.
_ASKED = ["overlay(p_type placing '' from 4 for 1)", "overlay(p_type placing 'qq' from 2 for 2)", "split_part(p_type, ' ', 1)", "lower(p_type)", "left(p_type, 2)"]
_ASKED_SQL = "SELECT DISTINCT unnest([substr(p_type, 1, 3) || substr(p_type, 5), substr(p_type, 1, 1) || 'qq' || substr(p_type, 4), split_part(p_type, ' ', 1), lower(p_type), substr(p_type, 1, 2)]) AS needle FROM part"


@query(
    f"WITH a AS ({_ASKED_SQL}), t AS (SELECT DISTINCT p_type AS name FROM part), p AS (SELECT needle, name, lower(needle) AS n, lower(name) AS t, CASE WHEN length(needle) <= 4 THEN 1 ELSE least(3, length(needle) // 3) END AS most FROM a, t WHERE lower(needle) <> lower(name)),"
    " s AS (SELECT needle, name, CASE WHEN length(n) >= 3 AND (contains(t, n) OR contains(n, t)) THEN 0 ELSE levenshtein(n, t) END AS distance, abs(length(n) - length(t)) AS gap, most FROM p),"
    " r AS (SELECT needle, name, distance, row_number() OVER (PARTITION BY needle ORDER BY distance, gap, name) AS rank FROM s WHERE distance <= most) SELECT needle, rank::INT AS rank, name, distance::INT AS distance FROM r WHERE rank <= 3"
)
def tag_suggest(spark, d):
    """Three names of types for each name that is asked for wrongly, all against all."""
    types = table(spark, d, "part").select("p_type").distinct()
    asked = types.select(F.explode(F.array(*map(F.expr, _ASKED))).alias("needle"))
    return M.suggestions(asked, types.select(F.col("p_type").alias("name")))


_RETAINED_SQL = (
    "d AS (SELECT doc_id, lang, string_split(coalesce(text, ''), '') AS w FROM documents), p AS (SELECT a.doc_id FROM d a JOIN d b ON b.doc_id = a.doc_id + 1 AND a.lang = b.lang),"
    " s AS (SELECT doc_id, x || y || z AS g, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x, unnest(w[2:]) AS y, unnest(w[3:]) AS z FROM d) WHERE z IS NOT NULL GROUP BY ALL),"
    " o AS (SELECT a.doc_id, sum(least(a.n, coalesce(b.n, 0))) / sum(a.n) AS r FROM s a LEFT JOIN s b ON b.doc_id = a.doc_id + 1 AND b.g = a.g GROUP BY 1)"
)


def _rewrites(spark, d):
    """doc_id, old and new text: each document beside the next one of equal language."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), "lang", F.col("text").alias("new"))
    return docs.withColumnRenamed("text", "old").join(after, ["doc_id", "lang"]).select("doc_id", "old", "new")


@query(f"WITH {_RETAINED_SQL} SELECT doc_id, round(coalesce(r, 1), 6)::DOUBLE AS retained FROM p LEFT JOIN o USING (doc_id)")
@query(f"WITH {_RETAINED_SQL} SELECT doc_id, round(coalesce(r, 1), 6)::DOUBLE AS retained FROM p LEFT JOIN o USING (doc_id)", name="shingle_retained_whole")
def shingle_retained(spark, d):
    """Share of a text's three-character shingles, each as often as it occurs, that the next text of equal language holds too."""
    return _rewrites(spark, d).select("doc_id", F.round(T.retained("old", "new"), 6).alias("retained"))


@query(
    f"WITH {_RETAINED_SQL}, r AS (SELECT p.doc_id, length(coalesce(a.text, '')) AS n, length(coalesce(b.text, '')) AS m, coalesce(o.r, 1) AS kept FROM p JOIN documents a USING (doc_id) JOIN documents b ON b.doc_id = p.doc_id + 1 LEFT JOIN o ON o.doc_id = p.doc_id)"
    " SELECT doc_id, CASE WHEN n < 600 THEN NULL WHEN (n - m) / n >= 0.25 THEN 'shrunk' WHEN kept < 0.6 THEN 'replaced' END AS reason FROM r"
)
def rewrite_risk(spark, d):
    """Whether a rewrite destroys a text: it shrinks much, or keeps few of its shingles; short texts are not protected."""
    return _rewrites(spark, d).select("doc_id", T.rewrite_reason("old", "new").alias("reason"))


# ---- HTML and scalars ----------------------------------------------------------------------------------------------


@query("SELECT page_id, nullif(regexp_extract(html, 'charset=\"?([A-Za-z0-9_-]+)', 1), '') AS charset FROM pages")
def html_charset(spark, d):
    return table(spark, d, "pages").select("page_id", F.nullif(F.regexp_extract("html", 'charset="?([A-Za-z0-9_-]+)', 1), F.lit("")).alias("charset"))


@query("SELECT page_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&[a-zA-Z#0-9]+;', ' ', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g'))) AS text FROM pages")
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query("SELECT doc_id, nullif(regexp_extract(text, '([0-9]{4})', 1), '')::INT AS year FROM documents")
def year(spark, d):
    return table(spark, d, "documents").select("doc_id", T.year(F.col("text")).alias("year"))


@query("SELECT doc_id, regexp_replace(text, '[0-9]+', '§N', 'g') AS text FROM documents")
def template_key(spark, d):
    return table(spark, d, "documents").select("doc_id", T.template_key(F.col("text")).alias("text"))


@query(
    "WITH f AS (SELECT doc_id, list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(text, ''), lambda c: ord(c)::BIGINT)), lambda h, c: xor(h * 33, c) & 4294967295) AS h FROM documents)"
    " SELECT doc_id, ltrim(array_to_string(list_transform(range(6, -1, -1), lambda i: substr('0123456789abcdefghijklmnopqrstuvwxyz', ((h // (36 ** i)::BIGINT) % 36 + 1)::INT, 1)), ''), '0') AS hash FROM f"
)
def content_hash(spark, d):
    """The 32-bit hash by which an index knows that a text has changed."""
    return table(spark, d, "documents").select("doc_id", T.quick_hash(F.col("text")).alias("hash"))


@query()
def normalize_title(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize_title(F.substring_index("text", "\n", 1)).alias("title"))


@query()
def normalize_search(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize_search(F.substring_index("text", "\n", 1)).alias("title"))


@query()
def canonical_tag(spark, d):
    return table(spark, d, "part").select(T.canonical_tag(T.compose(F.col("p_type"))).alias("tag")).distinct()


@query()
def fnv1a(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fnv1a(F.substring_index("text", "\n", 1)).alias("hash"))
