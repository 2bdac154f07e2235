"""Main text of web pages by composite text density.

A page becomes a light tree of elements. Parts that are no running text by their element or role are
cut off. Each remaining node gets the composite text density: characters per tag, weighted by a
logarithm that lowers it as links make up more of the text; below a class or id that holds a word of
boilerplate it counts a fifth. The node whose children's densities sum highest is the content. The
lowest density on its path up to the body is the threshold: beside the path, parts of the body that
reach it add their own highest-sum subtrees, and so do a lone paragraph and a title. Where the path
lies in an article or main element, the whole of that element belongs to it. A name made of words of
boilerplate and layout alone (``cookie-notice``, ``post-comments``) also keeps its element out of the
text, unless the chosen node lies in it; a name with any other word (``share-price``) may be the
article's own subject and is only a weight.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import free_name, slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that start and end a block of text.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that never hold main text.
DROPPED = frozenset("head script style noscript template nav footer aside form button select textarea iframe object svg canvas menu dialog label input option".split())
#: An open paragraph ends where one of these starts.
ENDS_P = BLOCKS - {"br", "body", "head", "html", "option", "title", "td", "th", "tr", "caption", "legend", "tbody", "tfoot", "thead"}
#: An element of the key ends where one of its values starts.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table select article section div body html main td th".split())
#: Elements that hold paragraphs, headings and the like.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: What densities count below a class or id that holds one of these words (cut at anything but letters).
MARKED_WEIGHT = 0.2
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pagination paging popup promo promoted promotion related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar widget".split()
)
#: Words of layout, which say nothing of the subject beside one of the words above.
LAYOUT = frozenset(
    "area article block body bottom box button buttons card col column container content desktop div entry first form global group holder icon icons inner item items large last left link links list main mobile module outer page panel part post posts primary right row secondary section single site slot small sticky story text thread title top unit user users view wrap wrapper zone".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search".split())
#: Share of link characters from which a part with several links is a list of links.
LINKED = 0.6
WORDS = re.compile(r"[a-z]+")
CUT_TAG = re.compile(r"<[A-Za-z/!?]")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "parent", "items", "dropped", "marked", "hinted", "main", "weight", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, marked: bool = False, hinted: bool = False):
        self.tag, self.parent, self.dropped, self.marked, self.main = tag, parent, dropped, marked, tag in ("article", "main")
        self.hinted = hinted
        self.items: list[Node | str] = []
        self.weight = 1.0
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


class TreeBuilder(HTMLParser):
    """Builds the tree; unclosed and stray tags are settled as browsers do for the common cases."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None)
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body", "head"):
            if tag == "body":
                while self.at.tag == "head" or self.at.dropped and self.at.parent is not None and self.at.tag in ("title", "head"):
                    self.at = self.at.parent
                return
            if tag == "html" or self.at is not self.root:
                return
        if tag in ENDS_P:
            self._close("p", SCOPES)
        if tag in SIBLINGS:
            for other in SIBLINGS[tag]:
                self._close(other, SCOPES)
        inside = self._inside_main()
        given = dict(attrs)
        dropped = tag in DROPPED or tag == "header" and not inside or (given.get("role") or "").strip().lower() in ROLES or "hidden" in given or given.get("aria-hidden") == "true"
        marked, hinted = self._named(given, inside or tag == "article") if attrs and tag != "main" else (False, False)
        node = Node(tag, self.at, dropped, marked, hinted)
        if tag in ("main", "h1") or tag == "article" and not marked:  # a wrapper named after its sidebar or header is no boilerplate
            self._clear_wrappers()
        self.at.items.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        if tag == "br":
            self.handle_starttag("br", [])
        elif tag not in ("html", "body"):
            self._close(tag, SCOPES if tag not in SCOPES else frozenset())

    def handle_data(self, data):
        self.at.items.append(data)

    def _inside_main(self) -> bool:
        node = self.at
        while node is not None and not node.main:
            node = node.parent
        return node is not None

    def _clear_wrappers(self) -> None:
        node = self.at
        while node is not None and node.tag not in DROPPED:
            node.marked = node.marked and node.tag == "article"
            node.hinted = node.hinted and node.tag == "article"
            node = node.parent

    def _close(self, tag: str, scopes: frozenset) -> None:
        """Closes the nearest open ``tag``, unless one of ``scopes`` is nearer."""
        node = self.at
        while node is not self.root and node.tag != tag:
            if node.tag in scopes:
                return
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    @staticmethod
    def _named(attrs: dict, inside: bool) -> tuple[bool, bool]:
        """Whether a class or id is one of boilerplate, and whether one holds such a word beside words of another kind."""
        marked = hinted = False
        for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
            words = {w for w in WORDS.findall(CAMEL.sub(" ", name).lower()) if len(w) > 1}
            found = words & MARKED
            if found and not (inside and found == {"header"}):
                marked = marked or words <= MARKED | LAYOUT
                hinted = hinted or not words <= MARKED | LAYOUT
        return marked, hinted


def composite(chars: int, tags: int, link_chars: int, link_tags: int, ratio: float) -> float:
    """The published density of a node; counts that are 0 are taken as 1, ``ratio`` is the body's share of link characters."""
    if not chars:
        return 0.0
    t, lc, lt, rest = max(tags, 1), max(link_chars, 1), max(link_tags, 1), max(chars - link_chars, 1)
    base = math.log(chars / rest * lc + ratio * chars + math.e)
    return chars / t * math.log(max(chars / lc * t / lt, 1.0)) / math.log(base)


def _measure(root: Node) -> None:
    """Sums of characters and tags, and the density of every node, from the leaves up."""
    order, stack = [], [(root, False)]
    while stack:
        node, linked = stack.pop()
        linked = linked or node.tag == "a"
        order.append(node)
        for item in node.items:
            if isinstance(item, str):
                n = len(item) - item.count(" ") - item.count("\n")
                node.chars += n
                node.link_chars += n if linked else 0
            elif not item.dropped:
                item.weight = node.weight * (MARKED_WEIGHT if item.marked or item.hinted else 1.0)
                stack.append((item, linked))
    for node in reversed(order):
        if node.parent is not None and node is not root:
            up = node.parent
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.tags += node.tags + 1
            up.link_tags += node.link_tags + (node.tag == "a")
    ratio = root.link_chars / max(root.chars, 1)
    for node in order:
        node.density = node.weight * composite(node.chars, node.tags, node.link_chars, node.link_tags, ratio)
    for node in order:
        node.total = sum(item.density for item in node.items if isinstance(item, Node) and not item.dropped)


def _below(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        node = stack.pop()
        yield node
        stack += [x for x in reversed(node.items) if isinstance(x, Node) and not x.dropped]


def _lone(node: Node) -> bool:
    """Whether all of the node's text stands in one paragraph, or in paragraphs with a title; less than ``LINKED`` of it in links.

    A title or an ending that stands alone is short, and so less dense than the path; several paragraphs
    are judged by their density.
    """
    if not node.chars or node.link_chars >= LINKED * node.chars:
        return False
    parts, title, stack = 0, False, [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            if item.strip():
                return False
        elif item.dropped or item.marked:
            continue
        elif item.hinted:
            return False
        elif item.tag in PROSE:
            parts, title = parts + (item.chars > 0), title or item.tag == "h1"
        else:
            stack += item.items
    return parts == 1 or title


def _content(root: Node) -> set[int]:
    """The chosen subtrees, as ids of their nodes or strings."""
    _measure(root)
    best = max(_below(root), key=lambda x: x.total)
    if best.total <= 0:
        return {id(root)}
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(node.density for node in path)
    for node in path:
        node.marked = node.hinted = False
    # Lists of links are no text, but for those within an article.
    stack = [root]
    while stack:
        node = stack.pop()
        node.dropped = node.dropped or node.link_tags >= 2 and node.link_chars >= LINKED * node.chars and node not in path
        if not node.dropped and not node.main:
            stack += [x for x in node.items if isinstance(x, Node)]
    top = max((i for i, node in enumerate(path) if node.main), default=0)
    chosen = {id(path[top])}
    # Beside the path above the chosen node, parts as dense as the path, lone paragraphs and titles.
    for below, node in zip(path[top:], path[top + 1 :]):
        for item in node.items:
            if item is below:
                continue
            if isinstance(item, str):
                n = len(item) - item.count(" ") - item.count("\n")
                if n and composite(n, 0, 0, 0, root.link_chars / max(root.chars, 1)) >= threshold:
                    chosen.add(id(item))
            elif not item.dropped and not item.marked:
                if _lone(item):
                    chosen.add(id(item))
                elif item.density >= threshold:
                    own = max(_below(item), key=lambda x: x.total)
                    chosen.add(id(own if own.total > 0 else item))
    return chosen


def _blocks(root: Node, chosen: set[int]) -> list[str]:
    """The text blocks of the chosen subtrees in page order, white space settled."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    stack: list[tuple[Node | str | None, bool]] = [(root, False)]
    while stack:
        item, inside = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            if inside or id(item) in chosen:
                run.append(item)
        elif not item.dropped and not item.marked:
            inside = inside or id(item) in chosen
            block = item.tag in BLOCKS
            if block:
                flush()
                stack.append((None, inside))
            stack += [(x, inside) for x in reversed(item.items)]
    flush()
    return out


def main_text(page: str | None) -> str:
    """The main text of a page: blocks in page order, joined by newlines; empty if there is none."""
    if not page:
        return ""
    builder = TreeBuilder()
    builder.feed(page)
    if CUT_TAG.match(builder.rawdata):  # the page ends within a tag or comment
        builder.rawdata = ""
    builder.close()
    return "\n".join(_blocks(builder.root, _content(builder.root)))


def extract_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """Adds ``text`` and ``n_chars`` (code points) to every row.

    Null, empty and text-free pages give "" and 0. Pages are taken whole, whatever their length and
    however broken their markup; repeated rows are extracted each. Input columns are kept; an added
    column whose name clashes ends in an underscore.
    """
    names = [free_name(pages, n) for n in ("text", "n_chars")]
    schema = T.StructType([*pages.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            texts = [main_text(x) for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*batch.schema.names, *names])

    return pages.mapInArrow(run, schema)
