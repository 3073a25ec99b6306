"""The main text of web pages, by composite text density.

A page becomes a tree of its block elements; formatting inside a block is not a node, links are counted. Every node gets its
characters a tag, adjusted for links: with C characters and T tags below the node, LC and LT of these in links, and the
body's share r of link characters,

    density = C / T * log(C / LC * T / LT) to the base ln(C / (C - LC) * LC + r * C + e), zero denominators as one,

and a node's sum is that of its children's densities. The node with the largest sum is the article; the smallest density on its
way up to the body is the threshold that a neighbour of its kind must reach to be taken in with it, under their common
parent. What pages mark as something else than text (navigation, footers, adverts, forms, comments and the like, by
element, role or name) is no candidate and is left out of the article, as are lists that consist of links.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from stayline.llm.common import fresh, map_batches, row_bytes

# Element names of HTML.
RAW = frozenset("script style textarea title iframe noframes xmp noembed".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hgroup hr html li legend main menu nav noscript ol optgroup option p pre search section
    select summary table tbody td template tfoot th thead tr ul head button svg object canvas audio video""".split()
)
NOT_TEXT = frozenset(
    "head nav footer aside form button select menu dialog template noscript svg object canvas audio video search fieldset".split()
)
WHOLE = frozenset("html body main article".split())
# Roles and names by which pages mark parts that are not the article.
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
NAMES = re.compile(
    r"(?:(?:site|page|main|global|top|bottom|left|right|post|article)[-_]?)?"
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|sidebar|footer|comments?|"
    r"commentlist|respond|repl(?:y|ies)|disqus\w*|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|"
    r"signup|login|share|sharing|social|related|recommended|widget|toolbar|masthead|skip-?link)(?:[-_].*|\d+)?"
)
#: Header names count only outside of the article, which may have a header of its own.
HEADERS = re.compile(r"(?:(?:site|page|main|global|top)[-_]?)?header(?:[-_].*)?")
#: Elements that a new element of these kinds ends, up to the container that holds it.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
LINK_SHARE, LINKS = 0.8, 3
NEIGHBOUR_SHARE = 1 / 3

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
#: White space by Unicode, non-breaking blanks included.
SPACE = re.compile(r"\s+")


class Node:
    """A block element: its pieces of text (with whether they are links) and blocks in page order, and counts over all that it holds."""

    __slots__ = ("tag", "parent", "children", "skip", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, skip: bool):
        self.tag, self.parent, self.skip = tag, parent, skip
        self.children: list[Node | tuple[str, bool]] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def marked_off(tag: str, rest: str, in_article: bool) -> bool:
    """Whether an element says of itself that it is not part of the article's text."""
    if tag in NOT_TEXT or (tag == "header" and not in_article):
        return True
    if not rest or tag in WHOLE:
        return False
    for name, *values in ATTRIBUTE.findall(rest):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value in ROLES:
            return True
        if name in ("class", "id") and any(NAMES.fullmatch(v) or (not in_article and HEADERS.fullmatch(v)) for v in value.split()):
            return True
    return False


def parse(page: str) -> list[Node]:
    """The block elements of a page, parents before children; the first is the root, whatever the page is like."""
    root = Node("html", None, False)
    nodes, node = [root], root
    article, link, links = 0, False, []
    at = 0

    def leave(upto: Node) -> None:
        """Closes blocks until `upto` is closed."""
        nonlocal node, link, article
        while True:
            closed = node
            article -= closed.tag in ("article", "main")
            node, link = closed.parent, links.pop()
            if closed is upto:
                return

    def enclosing(tags: tuple[str, ...], stop: tuple[str, ...]) -> Node | None:
        seen, found = node, None
        while seen.parent is not None and seen.tag not in stop:
            if seen.tag in tags:
                found = seen
            seen = seen.parent
        return found

    while at < len(page):
        match = TOKEN.search(page, at)
        text = page[at : match.start() if match else len(page)]
        if text:
            node.children.append((html.unescape(text), link))
        if match is None:
            break
        at = match.end()
        if match["tag"] is None:
            continue
        tag = match["tag"].lower()
        if match["end"]:
            if tag == "a":
                link = False
            elif tag in BLOCKS and tag not in ("html", "body") and (opened := enclosing_tag(node, tag)):
                leave(opened)
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "a":
            link = True
            node.link_tags += 1
        if tag not in BLOCKS:
            node.tags += 1
            if tag == "br":
                node.children.append((" ", link))
            continue
        if tag in ("html", "body", "hr"):
            node.children.append(Node("hr", None, True))
            if tag == "body":
                # What a page opens before its body, such as an unclosed head, ends here.
                while node is not root:
                    leave(node)
            continue
        if node.tag == "p":
            leave(node)
        if tag in ENDS and (opened := enclosing(*ENDS[tag])):
            leave(opened)
        if tag in ("article", "main") and (opened := enclosing_tag(node, "nav")):
            leave(opened)
        child = Node(tag, node, marked_off(tag, match["rest"], article > 0))
        node.children.append(child)
        nodes.append(child)
        links.append(link)
        article += tag in ("article", "main")
        node = child
    return nodes


def enclosing_tag(node: Node, tag: str) -> Node | None:
    while node.parent is not None and node.tag != tag:
        node = node.parent
    return node if node.parent is not None else None


def weigh(nodes: list[Node]) -> None:
    """Counts, densities and sums of all nodes, children before parents."""
    for node in reversed(nodes):
        for child in node.children:
            if isinstance(child, Node):
                if child.parent is not None:
                    node.chars += child.chars
                    node.tags += child.tags + 1
                    node.link_chars += child.link_chars
                    node.link_tags += child.link_tags
            else:
                size = len(SPACE.sub(" ", child[0]).strip(" "))
                node.chars += size
                node.link_chars += size if child[1] else 0
    share = nodes[0].link_chars / max(nodes[0].chars, 1)
    for node in reversed(nodes):
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, max(node.link_tags, 1)
        node.density = c / t
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        if c and base > 1:
            node.density *= math.log(max(c / max(lc, 1) * t / lt, 1)) / math.log(base)
        if node.parent is not None:
            node.parent.total += node.density


def chosen(nodes: list[Node]) -> list[Node]:
    """The nodes that hold the article, in page order; none if no text is left to choose from."""
    candidates = [n for n in nodes if not n.skip and n.chars]
    if not candidates:
        return []
    best = max(candidates, key=lambda n: (n.total, n.density))
    path, node = [], best
    while node is not None:
        path.append(node.density)
        node = node.parent
    least = min(path)
    while best.parent is not None and best.tag not in WHOLE:
        alike = [n for n in best.parent.children if isinstance(n, Node) and n.tag == best.tag and not n.skip and n.density >= least]
        if sum(n.chars for n in alike if n is not best) < NEIGHBOUR_SHARE * best.chars:
            break
        if best.parent.parent is None:
            return alike
        best = best.parent
    return [best]


def blocks(node: Node) -> Iterator[str]:
    """The blocks of text of a node in page order, white space as one space."""
    pieces: list[str] = []
    stack: list = [iter(node.children)]
    while stack:
        child = next(stack[-1], None)
        if isinstance(child, tuple):
            pieces.append(child[0])
            continue
        text = SPACE.sub(" ", "".join(pieces)).strip(" ")
        pieces.clear()
        if text:
            yield text
        if child is None:
            stack.pop()
        elif not child.skip and not menu(child):
            stack.append(iter(child.children))


def menu(node: Node) -> bool:
    """A list or box of links."""
    return node.tag in ("ul", "ol", "div", "table", "section", "dl") and node.link_tags >= LINKS and node.link_chars >= LINK_SHARE * node.chars


def main_text(page: str) -> str:
    """The article of a page: its blocks joined by line breaks; empty if there is none."""
    nodes = parse(page)
    weigh(nodes)
    for node in nodes[1:]:
        # A form around most of the page is its frame and not a form to fill in.
        frame = node.tag == "form" and 2 * node.chars > nodes[0].chars
        node.skip = node.parent.skip or (node.skip and not frame)
    return "\n".join(text for node in chosen(nodes) for text in blocks(node))


def main_texts(pages: DataFrame, html_column: str = "html", name: str = "text") -> DataFrame:
    """The rows of `pages` with the article's text in a new column `name` (with an underscore in front if that is taken).

    Blocks are joined by one line break; inside a block character references are decoded and white space is one space. Null and
    empty pages, and pages without text, give the empty text. A page that is no HTML is one block. Every row stays,
    repeated ones too; no rows give no rows.
    """
    at = pages.columns.index(html_column)
    added = fresh(pages, name)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.decode("utf-8", "replace")) for page in row_bytes(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, added])

    return map_batches(pages, scan, [*pages.schema.fields, StructField(added, StringType())])


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; n_chars counts code points."""
    plain = pages.select("page_id", "url", "html")
    return main_texts(plain).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
