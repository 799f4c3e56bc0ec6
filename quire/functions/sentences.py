"""Sentence splitting as column expressions.

A text is one string in which each boundary is a mark. Rules only set or take away marks by patterns that look at what
stands on both sides, so every step runs in the JVM over whole texts, and the array of sentences is cut at the end.
Rules of headings and of references hold for a paragraph, which ends at an empty line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import bibliography

MARK, LINE = "\x01", "\x02"
#: A heading has no more characters, and words of so many letters decide whether it is one.
HEADING, CONTENT = 200, 4
#: Words before a dot that doesn't end a sentence.
ABBREVIATIONS = """
mr mrs ms dr prof st rev fr sr jr hon
vol vols ed eds trans ch chs p pp no nos v vv n nn col cols fig figs cf viz vs al ibid op cit etc ca approx esp cap sec
i.e e.g i.e. e.g. c ad bc ce bce
cm mm km kg lit
""".split()
#: Words that make a label with the number after them.
LABELS = """
Figure Fig Table Tab Section Sec Chapter Ch Equation Eq Appendix App Box Note Algorithm Alg
Abbildung Abb Tabelle Kapitel Kap Gleichung Gl Abschnitt Abs Anhang Anh Algorithmus
Tableau Chapitre Chap Équation Éq Annexe Ann Algorithme
Figura Tabla Capítulo Cap Ecuación Ec Sección Apéndice Ap Algoritmo
Tabella Capitolo Equazione Sezione Appendice
Tabela Equação Seção Secção Apêndice
Figuur Tabel Hoofdstuk Hfst Vergelijking Vgl Sectie Bijlage Bijl Algoritme
Рисунок Рис Таблица Табл Глава Гл Раздел Уравнение Ур Приложение Прил Алгоритм
図 表 章 節 式 付録 图 圖 节 節 公式 附录 附錄
الشكل الجدول الفصل القسم المعادلة الملحق
""".split()


def _one_of(words: list[str]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def _replace(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def normalized(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(_replace(F.coalesce(c, F.lit("")), r"[\s \x01]+", " "))


def _let(c: Column, then) -> Column:
    """then(c), where c is worked out once however often it is read."""
    return F.get(F.transform(F.array(c), then), F.lit(0))


def marked(c: Column) -> Column:
    """A mark after terminal punctuation before white space, but for initials, abbreviations and leading numbers."""
    t = _replace(normalized(c), r"([.!?]+) ", f"$1{MARK}")
    t = _replace(t, rf"(?<![^ {MARK}])((?:[A-Z]|(?iu:{_one_of(ABBREVIATIONS)}))\.+){MARK}", "$1 ")
    return numbered(t)


def numbered(t: Column) -> Column:
    """Leading numbers joined with what follows."""
    return _replace(t, rf"(^|{MARK})(\d+(?:\.\d+)*\.+){MARK}", "$1$2 ")


def is_heading(c: Column) -> Column:
    """Whether a text reads like a heading: short, no full stop at its end, and at least half of its long words, of which
    there are two, begin with a capital."""
    long = F.filter(F.split(F.trim(c), r"\s+"), lambda w: F.length(w) >= CONTENT)
    capital = F.filter(long, lambda w: w.rlike(r"^\p{Lu}"))
    return (F.length(F.trim(c)) <= HEADING) & ~F.trim(c).rlike(r"[.!?]$") & (F.size(long) >= 2) & (2 * F.size(capital) >= F.size(long))


def with_headings(c: Column) -> Column:
    """Marked text of a paragraph. The number of a subsection at the beginning of a line, before a heading that ends the
    paragraph, goes to that heading instead of the line before it."""
    lines = _replace(F.replace(F.coalesce(c, F.lit("")), F.lit(LINE), F.lit(" ")), r"[ \t]*[\r\n]\s*(?=\d+(?:\.\d+)+\.\s)", f" {LINE}")
    title = rf" {LINE}(?=\d+(?:\.\d+)+\.{MARK}[^{MARK}]+$)"
    moved = lambda t: F.when(t.rlike(title) & is_heading(F.element_at(F.split(t, MARK), -1)), _replace(t, title, MARK)).otherwise(t)
    return _let(marked(lines), lambda t: F.when(t.contains(LINE), numbered(F.replace(moved(t), F.lit(LINE), F.lit("")))).otherwise(t))


def cut(marked_text: Column) -> Column:
    return F.filter(F.transform(F.split(marked_text, MARK), lambda s: F.trim(s)), lambda s: s != "")


def sentences_regex(c: Column) -> Column:
    """array<string>. Empty text has none."""
    return cut(marked(c))


def post_processed(marked_text: Column) -> Column:
    """Labels join what follows; a lone leading dot goes; numbered items split at sentence ends; a list after a colon
    begins a sentence; decimals join what stands before; a list of references is cut at its entries instead; closing
    marks and lower-case text after a spaced ellipsis join what stands before."""
    t = _let(marked_text, lambda m: F.coalesce(F.array_join(_let(F.replace(m, F.lit(MARK), F.lit(" ")), bibliography.entries), MARK), _by_items(m)))
    t = _replace(t, rf"{MARK}(?=\p{{P}}+(?:{MARK}|$))", " ")
    return _replace(t, rf"((?:^|[\s{MARK}])\.\s+\.\s+\.){MARK}(?=\p{{Ll}})", "$1 ")


def _by_items(marked_text: Column) -> Column:
    label = rf"(?:\d+(?:\.\d+)*\.?|(?iu:{_one_of(LABELS)})\.?\s*\d+(?:\.\d+)*[.:]?)"
    t = _replace(marked_text, rf"(?<![^{MARK}])({label}){MARK}(?=[^{MARK}])", "$1 ")
    t = _replace(t, rf"^\.{MARK}", "")
    item, leader = r"^\d{1,3}[.)] \p{Lu}", r"^(\d{1,3}[.)] )"
    inner = lambda s: _replace(F.substr(s, F.length(F.regexp_extract(s, leader, 1)) + 1), r"""([.!?]["'”’)]?) (?=["'“‘(]?\p{Lu})""", f"$1{MARK}")
    parts = F.transform(F.split(t, MARK), lambda s: F.when(s.rlike(item), F.concat(F.regexp_extract(s, leader, 1), inner(s))).otherwise(s))
    t = F.array_join(parts, MARK)
    t = _replace(t, r": (?=\(\d+\) \p{Lu})", f":{MARK}")
    return _replace(t, rf"(\d\.){MARK}(?=\d)", "$1 ")


def sentences(c: Column) -> Column:
    """array<string>: each paragraph split and put right. Null and empty texts have none."""
    paragraphs = F.split(F.coalesce(c, F.lit("")), r"\n[^\S\n]*\n")
    return F.flatten(F.transform(paragraphs, lambda p: cut(post_processed(with_headings(p)))))


#: Terminators of other scripts, which end a sentence without white space after them.
OTHER_ENDS = "。！？؟।॥።"


def sentences_simple(c: Column) -> Column:
    """array<string>: up to terminal punctuation before white space, or to a terminator of another script."""
    t = _replace(F.coalesce(c, F.lit("")), MARK, " ")
    t = _replace(t, rf"([.!?](?=\s)|[{OTHER_ENDS}])", f"$1{MARK}")
    return F.filter(F.transform(F.split(t, MARK), lambda s: _replace(s, r"^\s+", "")), lambda s: s != "")
