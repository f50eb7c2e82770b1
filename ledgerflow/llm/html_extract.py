"""Main text of web pages by composite text density.

A page becomes a light DOM. Menus, headers, footers, sidebars, notices, adverts, forms, comments of readers, scripts and
styles go by element name, role or class names. Every node left has
its characters per tag, adjusted for characters and tags in links; a node's sum is that of its children's densities. The subtree with
the largest sum is the main text. The smallest density on its path to the body is the threshold: what
stands beside the path joins if its density reaches it. Every block of a page competes; article and main elements are blocks like any other.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import by_bytes, spread

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>|[^>]*>)", re.S)
#: One attribute with its value, so that no name is looked for inside a value or another name.
_ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: The words of a class name or id: main-nav, main_nav and mainNav are main and nav.
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag closes an open one of these, up to the nearest element of the second set.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)), "option": (("option",), ("select",))}
#: What never belongs to the main text.
DROP = frozenset("head nav footer aside form button select input menu dialog iframe object applet".split()) | RAW
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adslot adsense sponsor sponsored promo promotion banner sidebar sidebars menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments disqus reply replies widget widgets toolbar login search pagination pager skip".split()
)
#: Words that may stand beside those of DROP_WORDS in one name. Any other word (has-sidebar, no-ads, social-contract) says that the name isn't about what the element is.
BESIDE = frozenset(
    "a area bar block body bottom box btn button buttons card cell center col column container content feed fixed first form global group header heading holder icon icons inline inner item items js last left link links list main module of outer page panel post posts primary region right row secondary section single site slot small stack sticky tab tabs text title to top unit us view web wide wrap wrapper".split()
)
#: Any other element closes an open head.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
KEPT_CUES = frozenset("html body article main".split())


class Node:
    __slots__ = ("tag", "parent", "dropped", "outer", "items", "below", "count", "own", "density", "total")
    #: ``count`` and ``own``: characters, tags, and those in links, of all below and of the text outside the blocks below.

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent = tag, parent
        #: In an unwanted element: open like any other, but not in its parent's items.
        self.dropped = False
        #: The outermost article or main around this node, itself included: a header in there is the article's own.
        self.outer: Node | None = parent.outer if parent and parent.outer else self if tag in ("article", "main") else None
        #: Texts and nodes in page order.
        self.items: list[str | Node] = []


def _names_unwanted(value: str) -> bool:
    """Whether one of the names in a class or id attribute says that its element is no main text."""
    for name in value.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if not DROP_WORDS.isdisjoint(words) and all(w in DROP_WORDS or w in BESIDE or w.isdigit() for w in words):
            return True
    return False


def _unwanted(tag: str, attributes: str, parent: Node) -> bool:
    if tag in DROP:
        return True
    if len(attributes) < 4 or tag in KEPT_CUES:
        return tag == "header" and not parent.outer
    for m in _ATTRIBUTE.finditer(attributes):
        name, whole = m[1].lower(), m[2] or m[3] or m[4] or ""
        value = whole.lower()
        if name in ("class", "id"):
            if _names_unwanted(whole):
                return True
        elif name == "role":
            if value.strip() in DROP_ROLES:
                return True
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return tag == "header" and not parent.outer


def parse(page: str) -> Node:
    """The page's tree without what never belongs to the main text."""
    root = node = Node("html", None)
    at, n = 0, len(page)

    def text(part: str) -> None:
        nonlocal node
        if node.tag == "head" and part.strip():
            node = node.parent
        if not node.dropped:
            node.items.append(part)

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text(html.escape(m[0][9:-3]))
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW and not closing:
            end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if closing:
            if tag in ("body", "html"):
                while node.dropped:
                    node = node.parent
                continue
            up = node
            while up.parent and up.tag != tag:
                up = up.parent
            if up.parent:
                node = up.parent
            continue
        if node.tag == "head" and tag not in HEAD:
            node = node.parent
        if tag in ("html", "body"):
            continue
        if tag in BLOCK:
            up = node
            while up.parent and up.tag not in ("p", "table", "td", "th", "div", "section", "article", "main", "li", "blockquote"):
                up = up.parent
            if up.tag == "p":
                node = up.parent
        if tag in CLOSES:
            names, stops = CLOSES[tag]
            up = node
            while up.parent and up.tag not in names and up.tag not in stops:
                up = up.parent
            if up.tag in names and up.parent:
                node = up.parent
        dropped = node.dropped or _unwanted(tag, m[3][:-1], node)
        new = Node(tag, node)
        new.dropped = dropped
        if not dropped:
            node.items.append(new)
        if tag not in VOID and not (m[3].endswith("/>") and (dropped or tag not in BLOCK)):
            node = new
    if at < n:
        text(page[at:])
    return root


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters per tag, adjusted for characters and tags in links; ``share`` is that of link characters in the whole page."""
    if not chars:
        return 0.0
    tags = max(tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e)
    return chars / tags * math.log(chars / max(link_chars, 1) * tags / max(link_tags, 1) + 1e-9) / math.log(base + 1e-9) if base > 1 + 1e-6 else chars / tags


def _measure(root: Node) -> list[Node]:
    """Densities and density sums of all nodes, children before parents.

    A sum takes the blocks right below a node, through elements that are no blocks, and the text that stands between them as one
    child more. So a paragraph's bold words are part of it and never outweigh the paragraphs around them.
    """
    line, stack = [], [root]
    while stack:
        node = stack.pop()
        line.append(node)
        stack.extend(x for x in node.items if isinstance(x, Node))
    line.reverse()
    for node in line:
        count, own = [0, 0, 0, 0], [0, 0, 0, 0]
        node.below = []
        for x in node.items:
            if isinstance(x, str):
                n = len("".join(x.split()))
                count[0] += n
                own[0] += n
                continue
            for k, n in enumerate(x.count):
                count[k] += n
            count[1] += 1
            if x.tag in BLOCK:
                node.below.append(x)
            else:
                node.below += x.below
                for k, n in enumerate(x.own):
                    own[k] += n
                own[1] += 1
        if node.tag == "a":
            count[2:] = count[0], count[1] + 1
            own[2:] = own[0], own[1] + 1
        node.count, node.own = count, own
    share = root.count[2] / root.count[0] if root.count[0] else 0.0
    for node in line:
        node.density = composite_density(*node.count, share)
        node.total = sum(x.density for x in node.below) + composite_density(*node.own, share) if node.below else node.density
        node.below = []
    return line


def _render(node: Node, out: list[str], only: frozenset[int] | None = None) -> None:
    """Append the texts below ``node``; a line break stands at the edge of a block, a space for <br>."""
    stack: list[str | Node] = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "br":
            out.append(" ")
        else:
            if x.tag in BLOCK:
                out.append("\n")
                stack.append("\n")
            stack.extend(reversed(x.items))


def extract(page: str | None) -> str:
    """The main text of one page; empty if it has none."""
    if not page:
        return ""
    root = parse(page)
    line = _measure(root)
    if not root.count[0]:
        return ""
    best = max((x for x in reversed(line) if x.count[0] and (x.tag in BLOCK or x is root)), key=lambda x: x.total)
    path, low = {id(best)}, best.density
    up = best
    while up.parent:
        up = up.parent
        path.add(id(up))
        low = min(low, up.density)
    out: list[str] = []
    stack: list[str | Node] = [root]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x is best or id(x) not in path:
            if x is best or x.density >= low or x.tag not in BLOCK:
                _render(x, out)
        else:
            out.append("\n")
            stack.extend(reversed([*x.items, "\n"]))
    return " ".join(html.unescape("".join(out)).split())


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text (empty if none), n_chars (code points of the text).

    Null and empty html give an empty text. Whole pages are read, broken markup included. Repeated rows are extracted row by
    row, other columns are ignored, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "html"):
                texts = [extract(x) for x in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    read = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return spread(read).mapInArrow(run, "id long, url string, text string, n_chars long")
