"""HTML snapshots: a small reader over the standard parser, called for each page inside tasks."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

_ITEM = StructType([StructField("kind", StringType()), StructField("text", StringType())])
_PLACED = StructType([*_ITEM.fields, StructField("offset", LongType()), StructField("rows", ArrayType(StringType()))])
_SECTION = StructType([StructField("label", StringType()), StructField("chars", LongType()), StructField("breaks", ArrayType(LongType())), StructField("items", ArrayType(_PLACED))])

#: Elements by their role in a document.
HIDDEN = frozenset("style script template noscript".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()) | HEADINGS
#: A table cell of so much text marks a layout table, whose cells are walked like other blocks.
LAYOUT_CHARS = 200
KINDS = {"heading": "heading", "p": "p", "list": "list", "table": "table", "caption": "caption", "quote": "p", "code": "p"}


def collapsed(text: str) -> str:
    return " ".join(text.split())


class Reader(HTMLParser):
    """Collects the visible text, items (kind, text, offset, rows) in page order, rows of tables, the page's title and its
    first heading. Offsets count the code points of text nodes that are not only white space."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.visible: list[str] = []
        self.items: list[tuple[str, str, int, list[str] | None]] = []
        self.tables: list[list[list[str]]] = []
        self._hidden, self._head = 0, False
        self._text: list[str] = []
        self._kind = "p"
        self._lists = 0
        self._open: list[dict] = []  # tables
        self.nodes: list[tuple[int, int]] = []  # offset and length of each text node
        self._node: list[str] = []
        self._offset = self._at = 0
        self.title: str | None = None
        self.heading: str | None = None
        self._named: tuple[str, list[str]] | None = None  # the title or heading that is being read

    def _end_node(self) -> None:
        text = "".join(self._node)
        if text.strip():
            self.nodes.append((self._offset, len(text)))
            self._offset += len(text)
        self._node = []

    def _end_item(self, kind: str = "p") -> None:
        text = collapsed("".join(self._text))
        if text and not self._open:
            self.items.append((self._kind, text, self._at, None))
        self._text, self._kind, self._at = [], kind, self._offset

    def _begin_name(self, tag: str) -> None:
        if self._named is None and (tag == "title" and self.title is None or tag in HEADINGS and self.heading is None and not self._head):
            self._named = (tag, [])

    def _end_name(self, tag: str) -> None:
        if self._named is not None and tag == self._named[0]:
            text = collapsed("".join(self._named[1]))
            if tag == "title":
                self.title = text
            else:
                self.heading = text
            self._named = None

    def handle_comment(self, data):
        self._end_node()

    def handle_starttag(self, tag, attrs):
        self._end_node()
        self._begin_name(tag)
        if tag in HIDDEN:
            self._hidden += 1
        elif tag == "head":
            self._head = True
        elif tag == "body":
            self._head = False
        elif tag == "table":
            if not self._open:
                self._end_item()
            self._open.append({"rows": [], "cells": None, "text": None, "head": False, "at": self._offset})
        elif self._open and tag in ("tr", "td", "th", "caption"):
            own = self._open[-1]
            if tag == "tr":
                own["rows"].append([])
                own["text"] = None
            elif tag == "caption":
                own["text"] = own["caption"] = []
            else:
                own["head"] |= tag == "th"
                if not own["rows"]:
                    own["rows"].append([])
                own["text"] = []
                own["rows"][-1].append(own["text"])
        elif tag == "br":
            self._add(" ")
        elif tag in BLOCKS and not self._open:
            self._lists += tag in ("ul", "ol")
            kind = "heading" if tag in HEADINGS else "caption" if tag == "figcaption" else "quote" if tag == "blockquote" else "code" if tag == "pre" else "list" if tag in ("li", "dt", "dd") or self._lists else "p"
            self._end_item(kind)

    def handle_endtag(self, tag):
        self._end_node()
        self._end_name(tag)
        if tag in HIDDEN:
            self._hidden = max(0, self._hidden - 1)
        elif tag == "head":
            self._head = False
        elif tag == "table" and self._open:
            self._close_table()
        elif self._open and tag in ("td", "th", "caption"):
            self._open[-1]["text"] = None
        elif tag in BLOCKS and not self._open:
            self._lists = max(0, self._lists - (tag in ("ul", "ol")))
            self._end_item("list" if self._lists else "p")

    def _close_table(self) -> None:
        own = self._open.pop()
        cells = [[collapsed("".join(c)) for c in r] for r in own["rows"]]
        rows = [r for r in cells if any(r)]
        if self._open:  # a nested table is text of its cell
            text = self._open[-1]["text"]
            if text is not None:
                text.append(" " + " ".join(c for r in cells for c in r))
            return
        layout = not own["head"] and any(len(c) >= LAYOUT_CHARS for r in rows for c in r)
        if layout:
            self.items += [("p", c, own["at"], None) for r in rows for c in r if c]
        elif rows:
            self.tables.append(rows)
            caption = collapsed("".join(own.get("caption", [])))
            lines = [" | ".join(r) for r in rows]
            self.items.append(("table", "\n".join(([caption] if caption else []) + lines), own["at"], lines))
        self._at = self._offset

    def _add(self, text: str) -> None:
        if self._open:
            if self._open[-1]["text"] is not None:
                self._open[-1]["text"].append(text)
        else:
            self._text.append(text)

    def handle_data(self, data):
        if self._named is not None and not self._hidden:
            self._named[1].append(data)
            if self._named[0] == "title":  # a title belongs to the head, wherever it stands
                return
        if not self._hidden and not self._head:
            self.visible.append(data)
            self._node.append(data)
            self._add(data)

    def read(self, page: str | None) -> Reader:
        self.feed(page or "")
        self.close()
        self._end_node()
        if self._named is not None:
            self._end_name(self._named[0])
        while self._open:
            self._close_table()
        self._end_item()
        return self


@F.pandas_udf(StringType())
def visible_text(c: pd.Series) -> pd.Series:
    """Text of the body without styles and scripts, white space collapsed. Null has none."""
    return c.map(lambda h: None if h is None else collapsed("".join(Reader().read(h).visible)))


@F.pandas_udf(ArrayType(_ITEM))
def items(c: pd.Series) -> pd.Series:
    """Headings, paragraphs, list items, tables and captions in page order."""
    return c.map(lambda h: [{"kind": k, "text": t} for k, t, *_ in Reader().read(h).items])


def breaks(nodes: list[tuple[int, int]], interval: int) -> list[int]:
    """Where pages of so many characters begin, from text nodes (offset, length): at the first text, and then whenever the
    interval has passed. What a node has left behind its last break does not count."""
    at: list[int] = []
    left = 0
    for start, size in nodes:
        if size <= left:
            left -= size
        else:
            at += range(start + left, start + size, interval)
            left = interval
    return at


def section(c: Column, interval: int) -> Column:
    """struct<label, chars, breaks, items> of a page in one reading: its first heading or else its title (null if it has
    neither), the length of its visible text, where synthetic pages begin, and its items with the rows of tables."""

    @F.pandas_udf(_SECTION)
    def read(pages: pd.Series) -> pd.DataFrame:
        out = []
        for page in pages:
            r = Reader().read(page)
            items = [{"kind": k, "text": t, "offset": o, "rows": rows} for k, t, o, rows in r.items]
            out.append((r.heading or r.title or None, len(collapsed("".join(r.visible))), breaks(r.nodes, interval), items))
        return pd.DataFrame(out, columns=["label", "chars", "breaks", "items"])

    return read(c)


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def table_rows(c: pd.Series) -> pd.Series:
    """Of each data table its rows, cells joined by ` | `; empty rows go, empty cells stay."""
    return c.map(lambda h: [[" | ".join(r) for r in t] for t in Reader().read(h).tables])


def clean(c: Column) -> Column:
    """Without base addresses, content-security rules and noscript elements."""
    c = F.regexp_replace(c, r"(?is)<noscript\b.*?</noscript\s*>", "")
    c = F.regexp_replace(c, r"(?i)<base\b[^>]*>", "")
    return F.regexp_replace(c, r"""(?i)<meta\b[^>]*http-equiv\s*=\s*["']?content-security-policy[^>]*>""", "")




def ended(c: Column) -> Column:
    """The page with every `&` written out that begins no reference with a semicolon. The parser, as HTML has it, reads
    `&amp` without one too; where only ended references count, these stay as they are written."""
    return F.regexp_replace(c, r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)", "&amp;")
