"""Main text of HTML pages by tag-path ratios.

A page is read as blocks: stretches of text between block-level tags, each with
the path of block-level elements (and their classes) from the root to it. For
each path, text length and punctuation are added up and divided by its number
of blocks; links count against a path. Both ratios are smoothed over the blocks
in page order, averaged by path and fused into their geometric mean; paths at
or above the deviation of the fused ratio are content. The element that holds
nearly all of the content's text is the article (the innermost article or main
element that does, if there is one, and all of it): its other blocks (headings,
short lists) belong to it. Outside it a block of a content path stays if its own
ratio reaches the threshold too. Where no element below the body holds the
content, other blocks than headings must stand between blocks of it. Elements
that are never main text (menus, page headers and footers, sidebars, notices,
adverts, forms, scripts, styles, comments of readers) are left out by tag, role,
class or id before that.

What a browser shows inside an article stays: formulas, buttons within a
sentence, fallbacks of canvas, object and noscript (but for notices that scripts
are off). Drawings, option lists, templates, text areas and frames are no text.
A tag closed in itself holds nothing; a script, drawing or the like that is
never closed ends with the element around it.

Work is linear in the page: elements are nodes with a parent, paths are numbered
as they appear, and open tags are counted, so depth costs nothing.

Defined results: null or empty html, and pages without main text, give an empty
text; tags that are never closed, or closed twice, are mended; repeated rows
keep theirs; other columns are left alone, those named like results replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, extended, table, tune_batches

# HTML's element names by kind.
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address "
    "aside nav header footer form fieldset details summary hgroup search menu dialog center hr head legend".split()
)
NEVER = frozenset("nav aside footer form menu dialog head search".split())
CLOSES_P = BLOCKS - {"html", "body", "head"}
# What a start tag ends, if it is open within the same list or table.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
WITHIN = {"ul", "ol", "dl", "table"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset({"article", "main"})
# What they hold is read to the end tag, not as markup; of these only xmp is shown.
RAW = frozenset("script style textarea title iframe xmp".split())
# Markup that is not shown as text; a block's start tag ends all but the template.
HIDDEN = frozenset("svg select template".split())
# Classes, ids and roles of what is not main text; whole names, or compounds with words that say where or what it is.
_BOILER = (
    r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice|popup|modal|nav|navbar|navigation|menu|breadcrumbs?|sidebar|widget|"
    r"footer|masthead|topbar|site-header|page-header|comments?|commentlist|respond|disqus|replies|share|sharing|social|related|recommended|newsletter|subscribe|"
    r"signup|login|search|contentinfo|complementary|pagination|pager|skip|toolbar)"
)
_BEFORE = r"(?:site|page|main|primary|secondary|top|bottom|global|mobile|post|entry|user|reader)"
_AFTER = r"(?:ads?|bar|box|area|lists?|links?|buttons?|icons?|block|slot|posts|form|items?|text|message)"
BOILER = re.compile(rf"(?:^|\s)(?:{_BEFORE}[_-]+)*{_BOILER}(?:[_-]+{_BOILER})*(?:[_-]+{_AFTER})*(?:$|\s)", re.I)
LABEL = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SENDS = re.compile(r"""\btype\s*=\s*["']?(?:submit|reset)\b""", re.I)
#: Comments, declarations and tags; a quote counts only after an equals sign.
TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^<>]*+>|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""", re.S)
SLASH = re.compile(r"=[^\s\"'=]*/$")  # a slash that ends a value without quotes
NOTICE = re.compile(r"\bjava\s?script\b|\bcookies\b", re.I)
PUNCTUATION = re.compile(r"[.,;:!?¡¿…。、，；：！？]")
KERNEL = (0.25, 0.5, 0.25)
COVER = 0.9  # of the content's text, what the article's element must hold
LINKED = 0.5  # blocks of which a larger share is link text are no content by themselves


class Node:
    """An element: its parent, tag and path; whether it or what is around it is no main text."""

    __slots__ = ("parent", "tag", "path", "boiler", "weight", "own", "inside")

    def __init__(self, parent: "Node | None", tag: str, path: int, boiler: bool):
        self.parent, self.tag, self.path, self.boiler = parent, tag, path, boiler
        self.weight = self.own = 0
        self.inside = False


class Block:
    __slots__ = ("node", "text", "links")

    def __init__(self, node: Node, text: str, links: int):
        self.node, self.text, self.links = node, text, links


class Page:
    """Reads a page: ``blocks`` of text in order, ``nodes`` (parents first)."""

    def __init__(self, page: str):
        self.page, self.blocks = page, []
        self.root = Node(None, "", 0, False)
        self.nodes, self.stack = [self.root], [self.root]
        self.paths: dict[tuple[int, str], int] = {}
        self.open: Counter = Counter()  # tags on the stack
        self.scopes: list[Counter] = [Counter()]  # the same within the innermost list or table
        self.hidden: list[tuple[str, int]] = []  # open elements that are not shown, and the stack's length there
        self.parts: list[str] = []
        self.links = self.pressed = 0
        self.in_link = self.in_button = False
        self.ends: dict[str, int] = {}
        self.read()

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            # Nothing but buttons is a control.
            if text and self.pressed < len(text.replace(" ", "")):
                self.blocks.append(Block(self.stack[-1], text, self.links))
            self.parts = []
        self.links = self.pressed = 0

    def add(self, raw: str, plain: bool = False) -> None:
        if raw and not self.hidden:
            text = html.unescape(raw) if "&" in raw and not plain else raw
            self.parts.append(text)
            if self.in_link:
                self.links += len(text)
            if self.in_button:
                self.pressed += len("".join(text.split()))

    def pop(self) -> None:
        tag = self.stack.pop().tag
        self.open[tag] -= 1
        if tag in WITHIN:
            self.scopes.pop()
        self.scopes[-1][tag] -= 1
        while self.hidden and self.hidden[-1][1] > len(self.stack):
            self.hidden.pop()

    def push(self, tag: str, rest: str) -> None:
        label = " ".join(x[2] or x[3] or x[4] or "" for x in LABEL.finditer(rest)) if "=" in rest else ""
        top = self.stack[-1]
        boiler = (
            top.boiler or bool(self.hidden) or tag in NEVER or (tag == "header" and not (self.open["article"] or self.open["main"]))
            or (tag not in ("html", "body", "article", "main") and bool(label and BOILER.search(label)))
        )
        key = (top.path, f"{tag}.{label}" if label else tag)
        node = Node(top, tag, self.paths.setdefault(key, len(self.paths) + 1), boiler)
        self.nodes.append(node)
        self.stack.append(node)
        self.open[tag] += 1
        self.scopes[-1][tag] += 1
        if tag in WITHIN:
            self.scopes.append(Counter())

    def end_of(self, tag: str, at: int) -> int:
        """Place of the next end tag, or the page's length; each part of the page is searched once a tag."""
        if self.ends.get(tag, -1) < at:
            m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(self.page, at)
            self.ends[tag] = m.start() if m else len(self.page)
        return self.ends[tag]

    def after_raw(self, tag: str, at: int) -> int:
        """Where what a raw element holds ends: at its end tag or, without one, where an element around it ends."""
        end = self.end_of(tag, at)
        return end if end < len(self.page) else min((self.end_of(x, at) for x, n in self.open.items() if n > 0), default=end)

    def read(self) -> None:
        page, at = self.page, 0
        while m := TOKEN.search(page, at):
            if m.start() > at:
                self.add(page[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag, closing, rest = m[2].lower(), bool(m[1]), m[3]
            bare = rest.rstrip()
            empty = bare.endswith("/") and not SLASH.search(bare[-200:])
            if tag in BLOCKS:
                self.block(tag, closing, rest, empty)
            elif tag in RAW:
                if not closing and not empty:
                    end = self.after_raw(tag, at)
                    if tag == "xmp":
                        self.add(page[at:end], plain=True)
                    at = end
            elif tag in HIDDEN:
                if closing:
                    k = next((i for i in range(len(self.hidden) - 1, -1, -1) if self.hidden[i][0] == tag), None)
                    if k is not None:
                        while len(self.stack) > self.hidden[k][1]:
                            self.pop()
                        del self.hidden[k:]
                elif not empty:
                    self.hidden.append((tag, len(self.stack)))
            elif tag == "a":
                self.in_link = not (closing or empty)
            elif tag == "br":
                self.parts.append(" ")
            elif tag == "button":
                # A button that sends a form or shares a page is no text.
                if not closing and not empty and (SENDS.search(rest) or any(BOILER.search(x[2] or x[3] or x[4] or "") for x in LABEL.finditer(rest))):
                    at = self.after_raw(tag, at)
                else:
                    self.in_button = not (closing or empty)
            elif tag == "noscript" and not closing and not empty:
                end = self.after_raw(tag, at)
                if NOTICE.search(page, at, end):
                    at = end
        self.add(page[at:])
        self.flush()

    def block(self, tag: str, closing: bool, rest: str, empty: bool) -> None:
        while not closing and self.hidden and self.hidden[-1][0] != "template":
            self.hidden.pop()
        self.flush()
        self.in_link = self.in_button = False
        if closing:
            if self.open[tag]:
                while self.stack[-1].tag != tag:
                    self.pop()
                self.pop()
            return
        if tag in CLOSES_P and self.stack[-1].tag == "p":
            self.pop()
        if tag == "hr":
            return
        ends = ENDS.get(tag)
        while ends and any(self.scopes[-1][x] > 0 for x in ends):
            self.pop()
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.pop()
        if not empty:
            self.push(tag, rest)


def smoothed(values: list[float]) -> list[float]:
    padded = [values[0], *values, values[-1]]
    return [sum(k * padded[i + j] for j, k in enumerate(KERNEL)) for i in range(len(values))]


def content_paths(blocks: list[Block]) -> tuple[set[int], list[float], float]:
    """Paths whose fused ratio reaches the threshold; each block's own ratio; the threshold."""
    total: dict[int, list[float]] = {}
    for b in blocks:
        t = total.setdefault(b.node.path, [0, 0, 0])
        t[0] += max(0, len(b.text) - 2 * b.links)
        t[1] += len(PUNCTUATION.findall(b.text)) if b.links * 2 <= len(b.text) else 0
        t[2] += 1
    length = smoothed([total[b.node.path][0] / total[b.node.path][2] for b in blocks])
    marks = smoothed([total[b.node.path][1] / total[b.node.path][2] for b in blocks])
    fused = [math.sqrt(a * (c + 0.1)) for a, c in zip(length, marks, strict=True)]
    by: dict[int, list[float]] = {}
    for b, f in zip(blocks, fused, strict=True):
        v = by.setdefault(b.node.path, [0.0, 0])
        v[0] += f
        v[1] += 1
    mean = sum(fused) / len(fused)
    limit = min(math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused)), max(fused) / 2)
    own = [math.sqrt(max(0, len(b.text) - 2 * b.links) * (len(PUNCTUATION.findall(b.text)) + 0.1)) for b in blocks]
    # What only its neighbours lift is no content.
    raw = {p: math.sqrt(t[0] / t[2] * (t[1] / t[2] + 0.1)) for p, t in total.items()}
    return {p for p, (s, n) in by.items() if total[p][0] > 0 and s / n >= limit and raw[p] >= limit / 2}, own, limit


def article_of(nodes: list[Node], blocks: list[Block], paths: set[int]) -> Node:
    """The deepest element that holds COVER of the text of the content paths, up to its innermost article or main element if it has one."""
    for b in blocks:
        if b.node.path in paths:
            b.node.own += len(b.text)
    for n in reversed(nodes):  # children come after their parents
        n.weight += n.own
        if n.parent:
            n.parent.weight += n.weight
    best, named, total = nodes[0], None, nodes[0].weight
    for n in nodes[1:]:
        # A block's own element is not its article.
        if n.parent is best and n.weight - n.own >= COVER * total:
            best = n
            named = n if n.tag in MAIN else named
    return named or best


def main_text(page: str | None) -> str:
    read = Page(page) if page else None
    blocks = [b for b in read.blocks if not b.node.boiler] if read else []
    if not blocks:
        return ""
    paths, own, limit = content_paths(blocks)
    if not paths:
        return ""
    article = article_of(read.nodes, blocks, paths)
    for n in read.nodes:
        n.inside = n is article or bool(n.parent and n.parent.inside)
    whole = article.tag in MAIN
    loose = article.tag in ("", "html", "body")
    content = [i for i, b in enumerate(blocks) if b.node.path in paths]
    first, last = content[0], content[-1]
    out = []
    for i, b in enumerate(blocks):
        keep = b.node.path in paths and (b.node.inside or own[i] >= limit)
        if b.node.inside and not keep:
            keep = whole or b.node.tag in HEADINGS or (b.links <= LINKED * len(b.text) and (not loose or first < i < last))
        if keep:
            out.append(b.text)
    return "\n".join(out)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with text and n_chars."""
    tune_batches(pages.sparkSession, 500)
    pages, schema = extended(pages, "text string, n_chars long")
    at = pages.columns.index(column)

    def run(frames):
        for b in batches(frames):
            texts = [main_text(p) for p in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*b.schema.names, "text", "n_chars"]
            )

    return pages.mapInArrow(run, schema)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
