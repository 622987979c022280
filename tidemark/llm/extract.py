"""Main text of web pages by composite text density.

A small tolerant tree is built from the page; menus, page headers, footers, sidebars, adverts, notices, forms, comments and
code are cut out by what their tags, roles and class names say. A name or a form does not cut what holds the page's article
or most of its text. Of the rest every node gets its composite text density:
characters per tag, scaled down where links hold the characters. The node with the largest sum of its children's densities
is the article's core; the lowest density on its path from the body is the threshold that lets it grow to its ancestors.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import binary_lists, ready, text_bytes

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Starting one of these ends an open paragraph.
ENDS_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot caption".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("table ul ol dl select body html".split())
NO_TEXT = frozenset("head title script style noscript template iframe object svg canvas audio video button select textarea nav footer aside dialog".split())
NO_ROLE = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
NO_NAME = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disqus footer login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo "
    "promoted recommended related share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
WHOLE = frozenset(("html", "body", "article", "main"))
#: Readers' own texts may be longer than the article; their length does not keep them.
READERS = frozenset(("comment", "comments", "disqus"))


class Node:
    __slots__ = ("tag", "parent", "items", "dropped", "chars", "tags", "link_chars", "link_tags", "density", "names", "plain", "mains", "articles")

    def __init__(self, tag: str, parent: Node | None, dropped: bool) -> None:
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.items: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = 0.0
        self.names: frozenset[str] = frozenset()
        self.plain = self.mains = self.articles = 0


class Tree(HTMLParser):
    """Builds nodes; unclosed paragraphs, items and cells end where HTML ends them, stray end tags are ignored."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("#root", None, False)
        self.doubtful = False

    def _close(self, tags: tuple[str, ...], stop: frozenset[str]) -> None:
        node = self.now
        while node.parent is not None and node.tag not in stop:
            if node.tag in tags:
                self.now = node.parent
                return
            node = node.parent

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ENDS_P:
            self._close(("p",), SCOPE | {"td", "th"})
        if tag in SAME:
            self._close(SAME[tag], SCOPE)
        given = dict(attrs)
        inside = any(n.tag in ("article", "main") for n in self._path())
        names = set() if tag in WHOLE else set(re.findall(r"[a-z0-9]+", f"{given.get('class') or ''} {given.get('id') or ''}".lower()))
        role = (given.get("role") or "").lower()
        dropped = (
            tag in NO_TEXT or (tag == "header" and not inside) or "hidden" in given or given.get("aria-hidden") == "true"
            or role in NO_ROLE)
        node = Node(tag, self.now, dropped or self.now.dropped)
        if not node.dropped:
            node.names = frozenset(names & NO_NAME) | (frozenset(("form",)) if "form" in (tag, role) else frozenset())
            self.doubtful = self.doubtful or bool(node.names)
        self.now.items.append(node)
        if tag not in VOID:
            self.now = node

    def _path(self) -> Iterator[Node]:
        node = self.now
        while node is not None:
            yield node
            node = node.parent

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        node = self.now
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.now = node.parent

    def handle_data(self, data: str) -> None:
        if not self.now.dropped:
            self.now.items.append(data)


def _cut(root: Node) -> None:
    """Drops what a name or a form marks, except what holds the page's article or most of its text outside links."""
    order, stack = [], [(root, False)]
    while stack:
        node, linked = stack.pop()
        linked = linked or node.tag == "a"
        order.append(node)
        if not linked:
            node.plain = sum(len("".join(x.split())) for x in node.items if isinstance(x, str))
        stack += [(x, linked) for x in node.items if isinstance(x, Node) and not x.dropped]
    for node in reversed(order):
        if node.plain:
            node.mains += node.tag == "main"
            node.articles += node.tag == "article"
        if node.parent is not None:
            node.parent.plain += node.plain
            node.parent.mains += node.mains
            node.parent.articles += node.articles
    for node in order:
        if not node.names:
            continue
        above, around = [], node.parent
        while around is not None:
            above.append(around.tag)
            around = around.parent
        inside = node.mains + node.articles
        beside = root.mains + root.articles - inside - above.count("main") - above.count("article")
        most = 2 * node.plain > root.plain and not node.names & READERS and (inside > 0 or beside == 0)
        node.dropped = not (node.mains or (inside and not beside and "article" not in above) or most)


def _measure(root: Node) -> list[Node]:
    """Fills the counts bottom-up; returns the kept nodes in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.dropped:
            continue
        order.append(node)
        stack += [x for x in reversed(node.items) if isinstance(x, Node)]
    for node in reversed(order):
        node.chars += sum(len("".join(x.split())) for x in node.items if isinstance(x, str))
        for x in node.items:
            if isinstance(x, Node) and not x.dropped:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.chars if x.tag == "a" else x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
    return order


def _density(node: Node, body: Node) -> float:
    """Composite text density: characters per tag, less where many characters and tags are links'."""
    chars, tags = node.chars, max(node.tags, 1)
    if not chars:
        return 0.0
    links, link_tags = max(node.link_chars, 1), max(node.link_tags, 1)
    plain = max(chars - node.link_chars, 1)
    base = math.log(chars / plain * node.link_chars + body.link_chars / max(body.chars, 1) * chars + math.e)
    return chars / tags * max(math.log(max(chars / links * tags / link_tags, 1.0)), 1e-9) / base


def _article(order: list[Node]) -> Node:
    body = next((n for n in order if n.tag == "body"), order[0])
    for node in order:
        node.density = _density(node, body)
    inside = {id(body)}
    best, most = body, -1.0
    for node in order:
        if node is not body and id(node.parent) not in inside:
            continue
        inside.add(id(node))
        total = sum(x.density for x in node.items if isinstance(x, Node) and not x.dropped)
        if total > most:
            best, most = node, total
    path, node = [], best
    while node is not None:
        path.append(node)
        if node is body:
            break
        node = node.parent
    for node in path:
        if node.tag in ("article", "main"):
            return node
    threshold = min(n.density for n in path)
    while best is not body and best.parent is not None:
        others = [x for x in best.parent.items if isinstance(x, Node) and not x.dropped and x is not best and x.chars]
        loose = any(isinstance(x, str) and x.strip() for x in best.parent.items)
        if best.parent is body or not (loose or all(x.density >= threshold for x in others)):
            if best.tag not in BLOCKS:
                best = best.parent
                continue
            break
        best = best.parent
    return best


def _blocks(node: Node) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag == "br":
            run.append(" ")
        elif not x.dropped:
            if x.tag in BLOCKS:
                end()
                stack.append(None)
            stack += list(reversed(x.items))
    end()
    return out


def main_text(html: str) -> str:
    """Blocks of the article, joined by blank lines; empty if there is no text."""
    tree = Tree()
    tree.feed(html)
    tree.close()
    if tree.doubtful:
        _cut(tree.root)
    order = _measure(tree.root)
    return "\n\n".join(_blocks(_article(order))) if order and tree.root.chars else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(raw.decode("utf-8", "replace")) for raw in binary_lists(batch.column("html"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``, each page read whole in one narrow pass.

    Null, empty and text-free pages give the empty text; markup that is cut off or wrongly nested is read as far as it goes;
    repeated rows give repeated results.
    """
    ready(pages.sparkSession)
    rows = pages.select("page_id", "url", text_bytes("html").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
