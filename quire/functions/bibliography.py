"""Lists of references in a text, as column expressions.

An entry begins with a number or a name and ends where it was published. A text that begins like an entry and says where
it was published is a list, and so is one that goes on with an entry from the column before; it is cut where entries
begin. White space is taken to be collapsed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\x01"
#: A list is no shorter, publishers are looked for in the last characters, years of plain names in the first.
SHORTEST, LAST, FIRST = 30, 120, 80
#: Months, whole and short.
MONTHS = """
January February March April May June July August September October November December
Jan Feb Mar Apr Jun Jul Aug Sept Sep Oct Nov Dec
""".split()
#: What stands for the number of an issue.
ISSUES = "Spring Summer Fall Autumn Winter Suppl Supplement Pt Part No".split()
#: Publishers and kinds of reports.
PUBLISHERS = ["Press", "Publisher", "Publishers", "Publishing", "Wiley", "Springer", "Elsevier", "Routledge", "Sage", "Oxford", "Cambridge", "MIT", "Working Paper", "Technical Report", r"Retrieved\s+from"]

_TO = r"\s*[-–]\s*"
_PAGES = rf"\d{{1,4}}(?:{_TO}\d{{1,4}})?"
#: A capitalised word that has small letters.
_NAME = r"\p{Lu}(?=[\p{Lu}'’\-]*+\p{Ll})[\p{L}'’\-]++"
_NUMBER = r"(?:\[\d{1,3}\]|\d{1,3}[.)])\s+\p{Lu}"
_SURNAME_FIRST = rf"(?:{_NAME},\s+(?:\p{{Lu}}\.|{_NAME})|\p{{Lu}}[\p{{Lu}}'’\-]++,\s+\p{{Lu}}\.)"
_INITIALS_FIRST = rf"(?:\p{{Lu}}\.\s?){{1,4}}(?:and\s+(?:\p{{Lu}}\.\s?){{1,4}})?{_NAME}"
_LINK = r"(?i:\bdoi\.org/|\bhttps?://)\S+"

#: Journal, year;volume(issue):pages at the end.
_YEAR_VOLUME = rf"\b\p{{Lu}}[\p{{L}}&.'\-]+\s+(?:19|20)\d\d;\d{{1,5}}(?:\s*\({_PAGES}\))?\s*:\s*\d{{1,7}}(?:{_TO}\d{{1,7}})?\.?$"
_IDENTIFIER = r"(?i)\bdoi\.org/\S+|\b10\.\d{4,9}/\S+|\bpmid:\s*\d{4,}"
#: Signs of a place of publication, anywhere in a text or at its end.
_SIGNS = [
    _IDENTIFIER,
    r"(?i)\bhttps?://\S{6,}",
    rf"\b\d{{1,4}}\s*\(\d{{1,3}}\)\s*[:,]\s*{_PAGES}",
    rf"\b\d{{1,4}}\s*\((?:{'|'.join(MONTHS + ISSUES)})\.?(?:\s+\d{{1,3}})?\)\s*[:,]\s*\d{{1,4}}{_TO}\d{{1,4}}",
    rf"\b\d{{1,4}}\s*:\s*\d{{1,4}}{_TO}\d{{1,4}}\b",
    rf"(?i)\bpp?\.\s+{_PAGES}\b",
    rf"(?:\b\p{{Lu}}\p{{L}}*\.\s+){{2}}\d{{1,3}}\s+\d{{1,7}}(?:{_TO}\d{{1,5}})?\.?$",
    _YEAR_VOLUME,
    rf"\b\p{{Lu}}[\p{{L}}&.'\-]+\s+\((?:19|20)\d\d\s+(?:{'|'.join(MONTHS)})\s+\d{{1,2}}\)\.?$",
]
#: Two shortened words of a journal, a volume and a range of pages, inside of a numbered list.
_SHORT_JOURNAL = rf"(?:\b\p{{Lu}}\p{{L}}{{2,}}\.\s+){{2}}\d{{1,3}}\s+\d{{1,5}}{_TO}\d{{1,5}}"


def starts(c: Column) -> Column:
    """Whether a text begins like an entry: a number, a surname before initials or a first name, initials before a
    surname, or two names before a year."""
    named = c.rlike(rf"^{_NAME}\s+{_NAME}\s*[.,]") & F.substring(c, 1, FIRST).rlike(r"\b(?:19|20)\d\d\b")
    return c.rlike(rf"^(?:{_NUMBER}|{_SURNAME_FIRST}|{_INITIALS_FIRST})") | named


def published(c: Column) -> Column:
    """Whether a text says where it was published."""
    signs = [c.rlike(p) for p in _SIGNS] + [F.substring(c, -LAST, LAST).rlike(rf"\b(?:{'|'.join(PUBLISHERS)})\b")]
    return reduce(Column.__or__, signs)


def identified(c: Column) -> Column:
    """Whether a text holds what only references hold: an identifier, or journal, year and volume at its end."""
    return c.rlike(_IDENTIFIER) | c.rlike(_YEAR_VOLUME)


def _numbers_inside(c: Column) -> Column:
    return c.rlike(rf"\s{_NUMBER}")


def is_list(c: Column) -> Column:
    """Whether a text is a list of references, or one of them."""
    numbered = c.rlike(f"^{_NUMBER}") & _numbers_inside(c) & c.rlike(_SHORT_JOURNAL)
    goes_on = (_numbers_inside(c) & identified(c)) | (c.rlike(r"^\p{Ll}") & c.rlike(_YEAR_VOLUME))
    return (F.length(c) >= SHORTEST) & F.when(starts(c), published(c) | numbered).otherwise(goes_on)


def entries(c: Column) -> Column:
    """array<string>: the entries of a list of references, else null.

    Entries of a numbered list begin at numbers, since names of authors look like beginnings there; those of another list
    after a full stop that ends no initial. A link ends an entry in both. If the first entry neither begins like one nor
    has an identifier, the text counts as no list.
    """
    cut = lambda c, pattern, by: F.regexp_replace(c, F.lit(pattern), F.lit(by))
    linked = cut(c, rf"({_LINK})\s+(?={_NUMBER}|{_SURNAME_FIRST}|{_INITIALS_FIRST})", f"$1{MARK}")
    numbers = cut(linked, rf"\s+(?={_NUMBER})", MARK)
    names = cut(linked, rf"(?<!\s\p{{Lu}})\.\s+(?={_NUMBER}|{_SURNAME_FIRST})", f".{MARK}")
    parts = F.split(F.when(c.rlike(f"^{_NUMBER}") | (~starts(c) & _numbers_inside(c)), numbers).otherwise(names), MARK)
    good = F.filter(F.array(parts), lambda p: starts(p[0]) | (~starts(c) & identified(p[0])))
    return F.when(is_list(c), F.get(good, F.lit(0)))
