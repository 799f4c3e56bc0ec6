"""Column functions over text: normal forms, identifiers, references, hashes.

Three case rules live side by side and each function says which it uses: ASCII (only A-Z fold), Unicode lower, exact.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: ASCII punctuation that normal forms of titles replace by a space.
PUNCTUATION = r"[!-/:-@\[-`{-~]+"
#: Latin letters with marks and the letters without them.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
#: Typographic quotes and their ASCII forms.
QUOTES, ASCII_QUOTES = "‘’‚‛“”„‟", "''''\"\"\"\""


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold_marks(c: Column) -> Column:
    """Without the marks of Latin letters; in the JVM. Use strip_marks for other scripts."""
    return F.translate(c, MARKED, PLAIN)


@F.pandas_udf(StringType())
def strip_marks(c: pd.Series) -> pd.Series:
    """Canonical decomposition without combining marks, any script."""
    return c.map(lambda s: None if s is None else "".join(x for x in unicodedata.normalize("NFD", s) if not unicodedata.combining(x)))


def normalize_title(c: Column) -> Column:
    """Marks go, ASCII punctuation becomes a space, trimmed, Unicode lower case."""
    return F.lower(F.trim(F.regexp_replace(fold_marks(c), PUNCTUATION, " ")))


def normalize_search(c: Column) -> Column:
    """Lower case without marks, all but letters and numbers is one space."""
    return F.trim(F.regexp_replace(fold_marks(F.lower(c)), r"[^\p{L}\p{N}]+", " "))


def fold_quotes(c: Column) -> Column:
    return F.translate(c, QUOTES, ASCII_QUOTES)


def normalize_space(c: Column) -> Column:
    """Runs of white space, no-break spaces and &nbsp; are one space."""
    return F.regexp_replace(c, r"(?:[\s ]|&nbsp;)+", " ")


def canonical_tag(c: Column) -> Column:
    """Quotes folded, spaces collapsed, trimmed, lower case. Text is expected in composed form (see compose)."""
    return F.lower(F.trim(normalize_space(fold_quotes(c))))


@F.pandas_udf(StringType())
def compose(c: pd.Series) -> pd.Series:
    return c.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def cjk_spacing(c: Column) -> Column:
    """Spaces between a CJK character and an ASCII letter or digit go."""
    cjk = r"[぀-ヿ㐀-鿿가-힯]"
    return F.regexp_replace(F.regexp_replace(c, rf"({cjk}) +(?=[A-Za-z0-9])", "$1"), rf"([A-Za-z0-9]) +(?={cjk})", "$1")


def year(c: Column) -> Column:
    """The first four digits in a row, also inside a longer run."""
    return F.nullif(F.regexp_extract(c, r"(\d{4})", 1), F.lit("")).cast("int")


def year_bounded(c: Column) -> Column:
    """The first four digits that stand alone."""
    return F.nullif(F.regexp_extract(c, r"\b(\d{4})\b", 1), F.lit("")).cast("int")


def html_text(c: Column) -> Column:
    """Comparable text: tags and entities are spaces, spaces collapsed, lower case."""
    plain = F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"&[a-zA-Z#0-9]+;", " ")
    return F.lower(F.trim(F.regexp_replace(plain, r"\s+", " ")))


def creators(names: Column) -> Column:
    """Null, `A`, `A & B` or `A et al.`"""
    return F.when(F.size(names) == 1, names[0]).when(F.size(names) == 2, F.concat(names[0], F.lit(" & "), names[1])).when(F.size(names) > 2, F.concat(names[0], F.lit(" et al.")))


def sanitize_error(c: Column) -> Column:
    """Paths become <path>; at most 300 characters and an ellipsis."""
    s = F.regexp_replace(c, r"(?:[A-Za-z]:)?(?:[/\\][\w.\- ]+){2,}", "<path>")
    return F.when(F.length(s) > 300, F.concat(F.substring(s, 1, 300), F.lit("..."))).otherwise(s)


def quick_hash(c: Column) -> Column:
    """A 32-bit xor-multiply hash over characters, as base 36."""
    points = F.transform(F.split(c, ""), lambda x: F.ascii(x).cast("bigint"))
    h = F.aggregate(points, F.lit(5381).cast("bigint"), lambda acc, x: F.pmod((acc * 33).bitwiseXOR(x), F.lit(1 << 32)))
    return F.lower(F.conv(h.cast("string"), 10, 36))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over the characters of text in the basic plane."""
    points = F.transform(F.split(c, ""), lambda x: F.ascii(x).cast("bigint"))
    return F.aggregate(points, F.lit(0x811C9DC5).cast("bigint"), lambda acc, x: F.pmod(acc.bitwiseXOR(x) * 0x01000193, F.lit(1 << 32)))


def date_group(at: Column, now: Column) -> Column:
    """Today, Yesterday, This Week (from Sunday on), This Month or Older; both in the session's time."""
    day, today = at.cast("date"), now.cast("date")
    sunday = lambda d: F.date_sub(d, F.dayofweek(d) - 1)
    out = F.when(day == today, "Today").when(day == F.date_sub(today, 1), "Yesterday").when(sunday(day) == sunday(today), "This Week")
    return out.when(F.trunc(day, "month") == F.trunc(today, "month"), "This Month").otherwise("Older")


def clean_isbn(c: Column) -> Column:
    """The first ISBN of ten or thirteen digits whose check digit is right, without hyphens and spaces; else null."""
    bare = F.regexp_replace(F.upper(c), "[-‐‑–— ]", "")
    value = lambda x: F.when(x == "X", 10).otherwise(x.try_cast("int"))
    ten = lambda s: F.aggregate(F.transform(F.split(s, ""), lambda x, i: value(x) * (10 - i)), F.lit(0), lambda a, x: a + x) % 11 == 0
    thirteen = lambda s: F.aggregate(F.transform(F.split(s, ""), lambda x, i: value(x) * (1 + 2 * (i % 2))), F.lit(0), lambda a, x: a + x) % 10 == 0
    found = F.regexp_extract_all(bare, F.lit(r"(?<![0-9])(97[89][0-9]{10}|[0-9]{9}[0-9X])(?![0-9])"), F.lit(1))
    return F.get(F.filter(found, lambda s: F.when(F.length(s) == 13, thirteen(s)).otherwise(ten(s))), F.lit(0))


def digits(c: Column) -> Column:
    """Digits of five other scripts as ASCII digits."""
    rows = ["٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹", "०१२३४५६७८९", "০১২৩৪৫৬৭৮৯", "０１２３４５６７８９"]
    return F.translate(c, "".join(rows), "0123456789" * len(rows))


def template_key(c: Column) -> Column:
    """Text with its numbers replaced, so that running headers match."""
    return F.regexp_replace(c, r"\d+", "§N")


def roman(c: Column) -> Column:
    """Value of a roman numeral from 1 to 50, else null."""
    tens = ["", "x", "xx", "xxx", "xl"]
    ones = ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"]
    known = {t + o: 10 * i + j for i, t in enumerate(tens) for j, o in enumerate(ones) if i or j} | {"l": 50}
    return F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.lower(F.trim(c)))


#: Endings of hosts and of files by which an address is known.
HOST_ENDINGS = "com org net edu gov mil int io co info biz us uk ca eu de fr au nl jp cn in ru br gov.uk ac.uk".split()
FILE_ENDINGS = "pdf html htm php aspx asp jsp xml json csv tsv txt docx doc xlsx xls pptx ppt zip tar gz png jpeg jpg gif svg".split()


def url_signs() -> list[str]:
    """Patterns of what looks like an address."""
    hosts, files = ("|".join(e.replace(".", r"\.") for e in x) for x in (HOST_ENDINGS, FILE_ENDINGS))
    return ["://", "^mailto:", r"@[a-z0-9.-]+\.[a-z]{2,}", r"\bwww\.", rf"[a-z0-9-]+\.(?:{hosts})\b", rf"\.(?:{files})\b", r"\b10\.\d{4,}/", r"^\.{0,2}/", r"\\"]


def urlish(c: Column) -> Column:
    """Looks like an address: a scheme, mail, www, a host or file of a known ending, a DOI, or a path."""
    return c.rlike("(?i)" + "|".join(f"(?:{x})" for x in url_signs()))


def line_window(c: Column, offset: int, limit: int) -> Column:
    """struct<text, total, has_more, next_offset>: `limit` lines from line `offset` (from 1) on."""
    lines = F.split(c, "\n")
    total, end = F.size(lines), offset - 1 + limit
    shown = F.array_join(F.slice(lines, offset, limit), "\n")
    return F.struct(shown.alias("text"), total.alias("total"), (total > end).alias("has_more"), F.when(total > end, end + 1).cast("int").alias("next_offset"))


#: Words and short forms for a page.
PAGE_WORDS = "page página pagina seite strona страница sayfa صفحة ページ 페이지".split()
PAGE_SHORT = "p. pp. pág. pag. str. стр.".split()


def page_number(c: Column) -> Column:
    """The number after a word for page, in any case of letters, else null."""
    words = "|".join(w.replace(".", r"\.") for w in [*PAGE_WORDS, *PAGE_SHORT])
    return F.nullif(F.regexp_extract(digits(c), rf"(?iu)(?<!\p{{L}})(?:{words})\s*(\d+)", 1), F.lit("")).cast("bigint")


#: Words between a page's number and the number of pages, and signs that stand for them after a page word.
PAGE_OF = "of / von de di van z из から".split()
PAGE_DASH = ["-", "—", "–"]


def page_label(c: Column) -> Column:
    """struct<value, roman, set> of a whole text that is a page number: 12, `page 3`, `3 of 9`, `p. 3 - 9`, `第3页`, `3쪽`,
    `·12·` or a roman numeral, in any digits. set: its form has more than a number. Else value is null."""
    t = F.lower(F.trim(digits(c)))
    words = "|".join(w.replace(".", r"\.") for w in [*PAGE_WORDS, *PAGE_SHORT])
    of, dashed = "|".join(PAGE_OF), "|".join([*PAGE_OF, *PAGE_DASH])
    plain, ranged = r"^(\d+)$", rf"^(\d+)\s*(?:{of})\s*\d+$"
    forms = [rf"^(?:{words})\s*(\d+)(?:\s*(?:{dashed})\s*\d+)?$", r"^第\s*(\d+)\s*[页頁]$", r"^(\d+)\s*(?:页|頁|쪽|ページ)$", r"^[·・‧]\s*(\d+)\s*[·・‧]$"]
    found = [F.nullif(F.regexp_extract(t, f"(?iu){p}", 1), F.lit("")) for p in (plain, ranged, *forms)]
    value = F.coalesce(*[x.try_cast("bigint") for x in found], roman(t).cast("bigint"))
    is_roman = F.coalesce(*found).isNull() & roman(t).isNotNull()
    return F.struct(value.alias("value"), is_roman.alias("roman"), F.coalesce(*found[2:]).isNotNull().alias("set"))


#: Endings of hosts that stand alone in margins.
LONE_ENDINGS = "edu gov org com net io ac uk".split()


def lone_address(c: Column) -> Column:
    """A web address, DOI or arXiv number that is the whole text."""
    ends = "|".join(LONE_ENDINGS)
    signs = [r"(?:https?://|www\.)\S+", rf"\S+\.(?:{ends})(?:/\S*)?", r"(?:doi:?\s*)?(?:https?://(?:dx\.)?doi\.org/)?10\.\d{4,9}/\S+", r"arxiv:\s*\d{4}\.\d{4,5}(?:v\d+)?(?:\s.*)?"]
    return F.trim(c).rlike("(?i)^(?:" + "|".join(signs) + ")$")


def parse_ref(c: Column) -> Column:
    """`u` or `g<id>`, else null."""
    return F.nullif(F.regexp_extract(c, r"^(u|g[1-9][0-9]*)$", 1), F.lit(""))


def _shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Runs of three characters, each as one number, with counts."""
    c = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.unique(c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:], return_counts=True)


@F.pandas_udf(DoubleType())
def retained(old: pd.Series, new: pd.Series) -> pd.Series:
    """Share of the three-character shingles of `old`, each as often as it occurs, that `new` holds too; 1 without any."""

    def share(a: str | None, b: str | None) -> float:
        (x, n), (y, m) = _shingles(a), _shingles(b)
        _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        return float(np.minimum(n[i], m[j]).sum() / n.sum()) if len(x) else 1.0

    return pd.Series([share(a, b) for a, b in zip(old, new, strict=True)], dtype=float)


#: From when on a text is protected, and what of it a rewrite may remove and must keep.
PROTECTED_CHARS, REMOVED, KEPT = 600, 0.25, 0.6


def rewrite_reason(old: str, new: str) -> Column:
    """Why a rewrite (names of two columns) destroys a text: `shrunk`, `replaced` or null."""
    n = F.length(old)
    gone = (n - F.length(new)) / n
    return F.when(n < PROTECTED_CHARS, F.lit(None)).when(gone >= REMOVED, "shrunk").when(retained(old, new) < KEPT, "replaced")


#: Kinds of documents that can be extracted.
EXTRACTED = ["pdf", "epub", "text", "snapshot"]


def document_metadata(kind: Column, json: Column) -> Column:
    """struct<content_kind, pages>, or null if the JSON is broken, not of this kind, or of a kind that isn't extracted."""
    read = F.from_json(json, "content_kind string, pages bigint", {"mode": "PERMISSIVE"})
    return F.when(kind.isin(EXTRACTED) & (read["content_kind"] == kind) & F.try_parse_json(json).isNotNull(), read)
