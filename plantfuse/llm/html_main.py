"""Main text of web pages by scores that paragraphs pass up the element tree.

1. The page becomes a tree. Elements that never hold the article (navigation,
   headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader
   comments) are left out, by name, by role, or by a word of their class or id.
   An element that contains ``article`` or ``main`` is never left out, nor is a
   header of the article that holds a heading. "has-sidebar", "no-ads" and the
   like say what an element has, not what it is. On a page without ``article``
   and ``main`` a word of a class or id does not leave out what holds most of
   the page's points, unless it names reader comments.
2. Each paragraph has points for its length and its commas, less the share of
   its text that is links. Its parent gets all of them, the grandparent half,
   each further ancestor a third, a quarter and so on.
3. The container with most points is the main one, or the ``article`` or
   ``main`` around it; other articles stay too if they are not mostly links.
   Without these all of the page stays but what stands beside the container or
   beside an element around it and is mostly links; headings stay.
4. What is kept becomes blocks: character references decoded, white space
   within a block one space, trimmed, empty ones left out, joined by a newline.

A line break counts as white space within its block. A NULL or empty page, and
one without an article, has the empty text. Ties go to the container that
begins first. A tag cut off at the end of the page is no text. Rows are
independent: repeated rows and other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plantfuse.llm.shared import slices

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption "
    "figure h1 h2 h3 h4 h5 h6 hgroup hr html li main ol p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
PARAGRAPHS = frozenset("p pre blockquote".split())
NEVER_TEXT = frozenset(
    "aside audio button canvas dialog footer form head iframe input math menu nav noscript object "
    "option script select style svg template textarea title video".split()
)
#: What a start tag closes, if it is open: a paragraph, or the item before it.
CLOSES = {name: ("p",) for name in BLOCKS | {"aside", "footer", "form", "header", "nav"}} | {
    "li": ("p", "li"),
    "dt": ("p", "dt", "dd"),
    "dd": ("p", "dt", "dd"),
    "tr": ("p", "td", "th", "tr"),
    "td": ("p", "td", "th"),
    "th": ("p", "td", "th"),
    "option": ("option",),
}
#: Nothing outside these is closed by a tag within them.
SCOPES = frozenset("article aside body div footer header html main nav section table td th".split())
LIST_SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}}

# Words of a class, id or role that mark what is not the article.
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense alert alertdialog banner breadcrumb "
    "breadcrumbs comment comments complementary consent contentinfo cookie cookies dialog disqus "
    "footer gdpr header masthead menu modal nav navbar navigation newsletter notice notification "
    "pagination paywall popup promo promoted promotion recommended related replies responses "
    "search share sharing sidebar signup skyscraper social sponsor sponsored subscribe toolbar widget".split()
)
#: Of these, words of texts by readers, which may be more than the article.
READER_WORDS = frozenset("comment comments disqus replies responses".split())
#: Words beside which they say what an element has, or has not.
QUALIFIERS = frozenset("has no non not with without enabled disabled".split())
#: Words beside which "header" is the header of an article.
ENTRY_WORDS = frozenset("article entry post story".split())
ARTICLE = frozenset(("article", "main"))


class Node:
    __slots__ = ("name", "parent", "children", "side", "header", "holds", "points")

    def __init__(self, name: str, parent: Node | None, side: bool, header: bool = False):
        self.name, self.parent, self.side = name, parent, side
        self.children: list[Node | str] = []
        #: Left out only as long as no heading is in it.
        self.header = header
        self.holds = False
        self.points = 0.0


def _words(value: str) -> set[str]:
    """The side words of a class, id or role, and the words that stand beside "header"."""
    found: set[str] = set()
    for name in value.split():
        parts = re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower())
        words = SIDE_WORDS.intersection(parts)
        if words and QUALIFIERS.isdisjoint(parts):
            found |= words
            if "header" in words:
                found |= ENTRY_WORDS.intersection(parts)
    return found


def _side(name: str, attributes: list[tuple[str, str | None]], in_article: bool) -> str:
    """Why an element is left out: "always", "class", "header" if without a heading, or ""."""
    if name in NEVER_TEXT:
        return "always"
    if name == "main":
        return ""
    words: set[str] = set()
    side = ""
    for key, value in attributes:
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return "always"
        if key == "style" and value and re.search(r"display\s*:\s*none", value, re.I):
            return "always"
        if key in ("class", "id", "role") and value and (found := _words(value)):
            words |= found
            side = "always" if key == "role" or side == "always" else "class"
    entry = in_article or not ENTRY_WORDS.isdisjoint(words)
    words -= ENTRY_WORDS
    if name == "header" and not entry:
        return "always"
    if not words or name in HEADINGS and in_article:
        return ""
    if entry and words == {"header"}:
        return "header"
    return "always" if side == "always" or not READER_WORDS.isdisjoint(words) else "class"


class Tree(HTMLParser):
    """Builds the tree, closing what HTML lets stand open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None, False)
        self.in_article = 0
        #: Left out by a word of the class or id.
        self.by_class: list[Node] = []
        #: Headers without a heading so far.
        self.headers = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body"):
            return
        for closed in CLOSES.get(tag, ()):
            self._close(closed, SCOPES | LIST_SCOPES.get(closed, set()))
        side = _side(tag, attrs, self.in_article > 0)
        node = Node(tag, self.at, side != "", side == "header")
        self.at.children.append(node)
        if side == "class":
            self.by_class.append(node)
        self.headers += node.header
        if self.headers and tag in HEADINGS and not node.side:
            above = self.at
            while above and (above.header or not above.side):
                self.headers -= above.header
                above.side = above.header = False
                above = above.parent
        if tag in ARTICLE and not node.side:
            above = self.at
            while above and not above.holds:
                above.holds = True
                above = above.parent
        if tag not in VOID:
            self.at = node
            self.in_article += tag in ARTICLE

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag not in ("html", "body"):
            self._close(tag, frozenset())

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)

    def _close(self, tag: str, scopes: frozenset[str] | set[str]) -> None:
        node = self.at
        while node.parent and node.name != tag:
            if node.name in scopes:
                return
            node = node.parent
        if node.parent:
            left = self.at
            while left is not node.parent:
                self.in_article -= left.name in ARTICLE
                left = left.parent
            self.at = node.parent


def _walk(root: Node) -> Iterator[tuple[Node | str, bool]]:
    """Kept nodes and texts in page order, each node again at its end.

    Without recursion: a page may nest deeper than Python's stack.
    """
    stack: list[tuple[Node | str, bool]] = [(root, False)]
    while stack:
        node, ends = stack.pop()
        if not ends and isinstance(node, Node):
            if node.side and not node.holds:
                continue
            stack.append((node, True))
            stack += [(child, False) for child in reversed(node.children)]
        yield node, ends


def _blocks(root: Node) -> list[str]:
    blocks, text = [], []
    for node, _ in _walk(root):
        if isinstance(node, str):
            text.append(node)
        elif node.name in BLOCKS:
            blocks.append("".join(text))
            text = []
        elif node.name == "br":
            text.append(" ")
    blocks.append("".join(text))
    return [block for block in (" ".join(block.split()) for block in blocks) if block]


def _sizes(node: Node) -> tuple[int, int, int]:
    """Characters of text, of those in links, and commas."""
    chars = linked = commas = links = 0
    for part, ends in _walk(node):
        if isinstance(part, str):
            size = len(" ".join(part.split()))
            chars += size
            linked += size if links else 0
            commas += part.count(",")
        elif part.name == "a":
            links += -1 if ends else 1
    return chars, linked, commas


def _points(root: Node) -> Iterator[tuple[Node, float]]:
    """The points of each paragraph or text of its own, and the container that it is in."""
    path: list[Node] = []
    closed = 0  # open paragraphs, headings and links: their text is no container's own
    for node, ends in _walk(root):
        if isinstance(node, str):
            if closed or not node.strip():
                continue
            chars, linked, commas = len(" ".join(node.split())), 0, node.count(",")
            above: Node | None = path[-1]
        else:
            if ends:
                path.pop()
            else:
                path.append(node)
            if node.name in PARAGRAPHS or node.name in HEADINGS or node.name == "a":
                closed += -1 if ends else 1
            if ends or closed != 1 or node.name not in PARAGRAPHS:
                continue
            chars, linked, commas = _sizes(node)
            above = node.parent
        if chars and above:
            yield above, (1 + commas + chars / 100) * (1 - linked / chars)


def _score(root: Node) -> Node | None:
    """Gives all containers their points and returns the one with most."""
    scored: list[Node] = []
    for above, points in _points(root):
        depth = 1
        while above:
            if not above.points:
                scored.append(above)
            above.points += points / depth
            above = above.parent
            depth += 1
    return max(scored, key=lambda node: node.points, default=None)


def _keep_most(root: Node, by_class: list[Node]) -> None:
    """Takes back what a class or id leaves out if it holds most of the page's points."""
    for node in by_class:
        node.side = False
    held: dict[Node, float] = {}
    for above, points in _points(root):
        held[above] = held.get(above, 0.0) + points
    for node, ends in _walk(root):
        if ends and node.parent and node in held:
            held[node.parent] = held.get(node.parent, 0.0) + held[node]
    for node in by_class:
        node.side = 2 * held.get(node, 0.0) <= held.get(root, 0.0)


def _is_links(nodes: list[Node | str]) -> bool:
    """Whether half of the text and more is in links."""
    chars = linked = 0
    for node in nodes:
        if isinstance(node, str):
            chars += len(" ".join(node.split()))
        elif not node.side or node.holds:
            size = _sizes(node)
            chars, linked = chars + size[0], linked + size[1]
    return chars > 0 and 2 * linked >= chars


def _drop_links_beside(best: Node) -> None:
    """Drops blocks that are mostly links beside the container and beside all around it.

    Texts and elements within a line that follow each other are a block.
    """
    inside = best
    while above := inside.parent:
        kept: list[Node | str] = []
        line: list[Node | str] = []
        for node in [*above.children, None]:
            if isinstance(node, str) or node and node is not inside and node.name not in BLOCKS:
                line.append(node)
                continue
            kept += [] if _is_links(line) else line
            line = []
            if node and (node is inside or node.name in HEADINGS or not _is_links([node])):
                kept.append(node)
        above.children = kept
        inside = above


def _articles(root: Node, around: Node) -> list[Node]:
    """The article with most points and the others outside it, in page order."""
    path = set()
    node: Node | None = around
    while node:
        path.add(node)
        node = node.parent
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.side and node not in path:
            continue
        if node is around or node.name == "article":
            if node in path or not _is_links([node]):
                found.append(node)
            continue
        stack += [child for child in reversed(node.children) if isinstance(child, Node)]
    return found


def main_text(html: str | None) -> str:
    """The article's blocks, joined by newlines."""
    tree = Tree()
    tree.feed(re.sub(r"<[/!a-zA-Z][^<>]*\Z", "", html or ""))
    tree.close()
    if tree.by_class and not tree.root.holds:
        _keep_most(tree.root, tree.by_class)
    best = _score(tree.root)
    if best is None:
        return "\n".join(_blocks(tree.root)) if tree.root.holds else ""
    around = best
    while around.parent and around.name not in ARTICLE:
        around = around.parent
    if around.name in ARTICLE:
        while around.parent and around.parent.name in ARTICLE:
            around = around.parent
        return "\n".join(block for node in _articles(tree.root, around) for block in _blocks(node))
    _drop_links_beside(best)
    return "\n".join(_blocks(tree.root))


def extract_pages(
    pages: DataFrame, columns: tuple[str, ...] = ("page_id", "url"), html_column: str = "html"
) -> DataFrame:
    """The named columns of every page and its main text."""
    schema = T.StructType(
        [pages.schema[name] for name in columns] + [T.StructField("text", T.StringType())]
    )

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(html) for html in batch.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(columns)], pa.array(texts, pa.string())],
                names=schema.fieldNames(),
            )

    return pages.select(*columns, html_column).mapInArrow(extracted, schema)
