"""Operator 10: main text of HTML pages by composite text density.

The page becomes a DOM. Composite text density of a node is its characters per tag, adjusted by how much of the text
is linked, against the share of links in the whole body. A node's sum is the sum of the densities of its blocks; what
stands between blocks (text, links, bold words) counts as one more. The node of the largest sum is the core, or what
inside it has at least CORE of its sum and text: a page of few paragraphs has a larger sum than its article, since
each notice beside it adds to it. Threshold is the lowest density on the path from the body, which itself counts only if
it is the core, to the core, times REACH. From the body down, in every subtree that reaches the threshold the node of the
largest sum is kept whole, so siblings of the core stay too, and paragraphs, lists and tables beside kept blocks stay
however short they are. Headings that lead to kept text stay.

Density selects; tags and names only leave things out of what it has selected: menus, headers, footers, sidebars,
notices, adverts and forms that hold at most half of the kept text and no main element or first-level heading; a header
inside an article or main element stays. Scripts, styles, form controls, hidden elements and reader comments never
count: comments are as dense as an article, so they are known by name only.

The scan is linear in the page: quotes that never close are found once, and open elements are found by their tag, not
by walking up. Null and empty pages, and pages without text, give an empty string. Whole pages are read, nothing is
cut. Repeated rows give repeated results; other columns are left alone, and columns named as a result are replaced.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import _with
from .text import small_batches, text_chunks

#: HTML element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math object canvas".split())
TO_THE_END = frozenset("script style xmp iframe".split())  # without an end tag they take the rest of the page
NEVER = RAW | frozenset("head button select option audio video map".split())
ROLES = frozenset("nav header footer aside form dialog menu fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CELLS = ("td", "th", "table", "caption")
#: An element that begins: the open ones it ends, and the open ones beyond which it ends none.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir", *_CELLS)),
    "dt": (("dt", "dd"), ("dl", *_CELLS)),
    "dd": (("dt", "dd"), ("dl", *_CELLS)),
    "option": (("option",), ("select",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (("tbody", "thead", "tfoot"), ("table",))),
}
_STATE = r"(?!-(?:enabled|disabled|open|closed|on|off|visible|layout|page)(?:$|[^a-z]))(?:$|[^a-z])"
_BEFORE = r"(?:^|(?<!has)(?<!no)(?<!is)(?<!with)[^a-z])"
#: Words of class, id, role or label values that mark what isn't the article.
ASIDE = re.compile(
    _BEFORE + r"(?:ad|ads|adv|advert\w*|adbox|adslot|adsense|banners?|sponsor\w*|promo\w*|nav|navbar|navigation|menus?|breadcrumbs?|footer|sidebars?|aside|widgets?|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|toolbar|pagination|pager|search|skip|hidden|complementary|contentinfo)" + _STATE
)
HEADER = re.compile(_BEFORE + r"(?<!article-)(?<!entry-)(?<!post-)(?<!story-)(?<!content-)(?:header|masthead)" + _STATE)
COMMENTS = re.compile(_BEFORE + r"(?:comments?|commentlist|disqus|replies|respond|discussion)" + _STATE)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTRS = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTR = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'=<>`]++)))?")


class Node:
    __slots__ = ("tag", "children", "kind", "drop", "keep", "chars", "tags", "link_chars", "link_tags", "density", "sum", "best", "holds", "block")

    def __init__(self, tag: str, kind: str = ""):
        self.tag, self.kind, self.drop, self.keep = tag, kind, tag in NEVER, False
        self.children: list[Node | str] = []
        self.density = self.sum = 0.0
        self.best, self.holds, self.block = self, False, False


def kind_of(tag: str, attrs: str) -> str:
    """What an element is by tag and names: aside, header, comments, hidden, or ''."""
    if tag in ("html", "body", "main"):
        return ""
    if attrs:
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), (a or b or c).lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                return "hidden"
            if name in ("class", "id", "role", "aria-label"):
                value = value.replace("_", "-")
                if COMMENTS.search(value):
                    return "comments"
                if tag != "article" and ASIDE.search(value):
                    return "aside"
                if tag != "article" and HEADER.search(value):
                    return "header"
    return "header" if tag == "header" else "aside" if tag in ROLES else ""


def parse(page: str) -> Node:
    """A forgiving DOM: unclosed elements end with their parent, paragraphs and list items end where the next begins."""
    root = Node("body")
    stack, open_at = [root], {}  # open_at: places in the stack of open elements, by tag
    at, size, quotes, unended = 0, len(page), True, set()

    def nearest(tags) -> int:
        return max([open_at[t][-1] for t in tags if open_at.get(t)], default=0)

    def close(place: int) -> None:
        while len(stack) > place:
            open_at[stack.pop().tag].pop()

    while at < size:
        lt = page.find("<", at)
        if lt != at:
            text = page[at : lt if lt >= 0 else size]
            stack[-1].children.append(entities.unescape(text) if "&" in text else text)
            if lt < 0:
                break
        after = page[lt + 1 : lt + 2]
        if after in ("!", "?"):
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4 if page[lt + 4 : lt + 5] != ">" else lt + 2)
                at = end + 3 if end >= 0 else size
            else:
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else size
            continue
        ends = after == "/"
        m = _NAME.match(page, lt + 1 + ends)
        if m is None:  # no tag
            if ends:
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else size
            else:
                stack[-1].children.append("<")
                at = lt + 1
            continue
        tag = m[0].lower()
        whole = _ATTRS.match(page, m.end()) if quotes else None
        if whole is None:  # a quote never closes: from here on the first > ends a tag
            quotes = False
            end = page.find(">", m.end())
            if end < 0:
                break
            attrs, at = page[m.end() : end], end + 1
        else:
            attrs, at = whole[0][:-1], whole.end()
        if tag in ("html", "body"):
            continue
        if ends:
            place = nearest((tag,))
            if place and (tag in _CELLS or place > nearest(_CELLS if tag in BLOCK else (*_CELLS, "article", "main"))):
                close(place)
            continue
        if tag in ENDS_P:
            place = nearest(("p",))
            if place > nearest(_CELLS):
                close(place)
        if tag in _ENDS:
            alike, beyond = _ENDS[tag]
            place = nearest(alike)
            if place > nearest(beyond):
                close(place)
        made = Node(tag, kind_of(tag, attrs))
        stack[-1].children.append(made)
        if tag in RAW:
            if not attrs.endswith("/") and tag not in unended:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif tag in TO_THE_END:
                    break
                else:
                    unended.add(tag)
        elif tag not in VOID:
            open_at.setdefault(tag, []).append(len(stack))
            stack.append(made)
    return root


def _nodes(root: Node) -> list[tuple[Node, bool, bool]]:
    """Nodes that count, parents first: whether they are in a link, and in an article or main element."""
    out, stack = [], [(root, False, False)]
    while stack:
        node, linked, inside = stack.pop()
        linked, inside = linked or node.tag == "a", inside or node.tag in ("article", "main")
        out.append((node, linked, inside))
        stack += [(c, linked, inside) for c in reversed(node.children) if not isinstance(c, str) and not c.drop]
    return out


def _size(text: str) -> int:
    return len(text) - text.count(" ") - text.count("\n")


#: The share of the sum and text of the densest node that a node inside it needs to be the core instead, and the share of
#: the threshold that others must reach.
CORE, REACH = 0.5, 0.6
#: Elements that stand beside kept ones as parts of the same text.
PARTS = HEADINGS | frozenset("p ul ol dl blockquote pre table figure".split())


def leave_out(root: Node) -> None:
    """Mark menus, headers, sidebars and the like inside kept nodes as dropped, by what they hold of the kept text."""
    nodes = _nodes(root)
    kept = 0
    for node, _, _ in reversed(nodes):
        inner = [c for c in node.children if not isinstance(c, str) and not c.drop]
        node.holds = any(c.holds or c.tag == "main" or c.tag == "h1" and node.kind != "header" for c in inner)
    stack = [root]
    while stack:
        node = stack.pop()
        if node.keep:
            kept += node.chars
        else:
            stack += [c for c in node.children if not isinstance(c, str) and not c.drop]
    for node, _, inside in nodes:
        if node.kind and not node.holds and not (node.kind == "header" and inside) and 2 * node.chars <= kept:
            node.drop = True


def hide(root: Node) -> None:
    """Drop reader comments and what is not shown."""
    for node, _, _ in _nodes(root):
        if node.kind in ("comments", "hidden"):
            node.drop = True


def measure(root: Node) -> float:
    """Densities and sums, bottom up; sets the core as root.best and returns the threshold."""
    nodes = _nodes(root)
    for node, linked, _ in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for c in node.children:
            if isinstance(c, str):
                n = _size(c)
                node.chars += n
                node.link_chars += n * linked
            elif not c.drop:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
    share = root.link_chars / root.chars if root.chars else 0.0

    def density(c: int, t: int, lc: int, lt: int) -> float:
        """Characters per tag by the logarithm of characters and tags per linked ones, to a base that grows with links.

        The base is multiplied by e, so that pages with next to no links have no base close to 1.
        """
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        return c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0)) / (1.0 + math.log(base))

    above: dict[int, Node] = {}
    for node, linked, _ in reversed(nodes):
        node.density, node.sum, node.best = density(node.chars, node.tags, node.link_chars, node.link_tags), 0.0, node
        node.block = node.tag in BLOCK
        run = [0, 0, 0, 0]  # characters, tags and linked ones between blocks
        for c in [*node.children, None]:
            if c is None or not isinstance(c, str) and not c.drop and c.block:
                node.sum += density(*run)
                run = [0, 0, 0, 0]
                if c is not None:
                    node.sum += c.density
                    node.block = True
            elif isinstance(c, str):
                n = _size(c)
                run = [run[0] + n, run[1], run[2] + n * linked, run[3] + (linked and n > 0 and not run[3])]
            elif not c.drop:
                run = [run[0] + c.chars, run[1] + c.tags + 1, run[2] + c.link_chars, run[3] + c.link_tags + (c.tag == "a")]
        for c in node.children:
            if not isinstance(c, str) and not c.drop:
                above[id(c)] = node
                if c.block and c.best.sum > node.best.sum:  # words in bold are no core
                    node.best = c.best
    core = whole = root.best
    node = core
    while True:  # down the child of most text
        inner = [c for c in node.children if not isinstance(c, str) and not c.drop]
        node = max(inner, key=lambda c: c.chars, default=None)
        if node is None or node.chars < CORE * whole.chars:
            break
        if node.sum >= CORE * whole.sum and any(not isinstance(c, str) and not c.drop and c.block for c in node.children):
            core = node
    root.best, threshold, node = core, core.density, core
    while node is not root and (node := above[id(node)]) is not root:
        threshold = min(threshold, node.density)
    return threshold * REACH


def mark(root: Node, threshold: float) -> None:
    """Keep the core, the node of the largest sum of every subtree that is reached from the body by the threshold, and
    parts of the same text beside them."""
    if not root.chars:
        return
    root.best.keep = True
    stack = [c for c in root.children if not isinstance(c, str) and not c.drop]
    while stack:
        node = stack.pop()
        if node.chars and node.density >= threshold:
            if node.block:
                node.best.keep = True
            stack += [c for c in node.children if not isinstance(c, str) and not c.drop]
    for node, _, _ in _nodes(root):
        inner = [c for c in node.children if not isinstance(c, str) and not c.drop]
        if any(c.keep for c in inner):
            for c in inner:
                if c.tag in PARTS and 2 * c.link_chars < max(c.chars, 1):
                    c.keep = True


def blocks(root: Node) -> list[str]:
    """Texts of kept nodes, and headings that lead to them, in page order."""
    out: list[list[str]] = [[]]
    waiting: list[tuple[str, list[list[str]]]] = []  # headings outside what is kept, until kept text follows
    stack: list = [(root, root.keep)]
    while stack:
        x, kept = stack.pop()
        if x is None:
            out.append([])
        elif isinstance(x, str):
            if kept:
                if waiting and x.strip():
                    for _, texts in waiting:
                        out[-1:-1] = [[], *texts]
                    waiting.clear()
                out[-1].append(x)
            elif x.strip():
                waiting[:] = [w for w in waiting if w[0] == "h1"]
        elif x.tag == "br":
            out[-1].append(" ")
        elif not x.drop:
            kept = kept or x.keep
            if not kept and x.tag in HEADINGS:
                x.keep = True
                waiting.append((x.tag, blocks_of(x)))
                continue
            inner = [(c, kept) for c in reversed(x.children)]
            if x.tag in BLOCK:
                out.append([])
                inner = [(None, kept), *inner]
            stack += inner
    texts = [" ".join("".join(b).split()) for b in out if b]
    return [t for t in texts if t]


def blocks_of(node: Node) -> list[list[str]]:
    return [[t] for t in blocks(node)]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    hide(root)
    mark(root, measure(root))
    leave_out(root)
    return "\n\n".join(blocks(root))


def with_main_text(df: DataFrame, html: str = "html") -> DataFrame:
    """Adds text (the main text) and n_chars (its code points); the html column goes."""
    small_batches(df.sparkSession)
    kept, schema = _with(df, "text string, n_chars bigint")

    def run(batches):
        for batch in batches:
            texts: list[str] = []
            for _, part in text_chunks(batch.column(batch.schema.get_field_index(html))):
                texts += [main_text(x).encode("utf-8", "replace").decode() for x in part.to_pylist()]
            own = [c for i, c in enumerate(batch.columns) if batch.schema.names[i] in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*(n for n in batch.schema.names if n in names), "text", "n_chars"])

    names = [c for c in kept.columns if c != html]
    slim = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != html] + ["text string, n_chars bigint"])
    return kept.mapInArrow(run, slim)
