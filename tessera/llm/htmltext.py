"""Main-text extraction by tree scoring.

A tolerant scanner turns the page into a tree of block elements (inline tags
only join text; paragraphs, list items, cells and headings close each other as
browsers do). What the contract leaves out is cut first: elements whose tag,
role, class or id says menu, header, footer, sidebar, notice, advert, form or
reader comments. Then every paragraph gives points for its length and commas
to its ancestors, all to the nearest, half to the next, a third of that
beyond; a container's sum is discounted by its link density. The best
container is kept whole (the first in the page of equal ones) with those of
its siblings that are not mostly links; if it lies in an ``article`` or
``main``, that element is the container. Nothing inside is dropped but the
elements cut before.

All passes are linear in the page: a tag is read once, elements carry what
they may close, and sums go from children to parents once.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._words import slices, text_array
from tessera.llm._worker import task

SLICE_BYTES = 1 << 22
#: A sibling of the best container with a greater share of its text in links is no text.
MOST_LINKS = 0.33

#: Elements whose content is never text of the page.
RAW = frozenset("script style noscript template textarea svg math iframe object title xmp noembed noframes".split())
BLOCKS = frozenset(
    "html body article section main aside nav header footer div p ul ol li dl dt dd table thead tbody tfoot tr td th caption pre blockquote "
    "h1 h2 h3 h4 h5 h6 form fieldset figure figcaption address details summary dialog center menu hgroup search select option button label legend video audio canvas head".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre blockquote li dd dt td th".split())
#: Blocks that an open paragraph may hold; any other ends it.
IN_P = frozenset("option button label legend".split())
#: What an element ends: the outermost open one of the first kinds, looked for up to the nearest of the second.
CLOSES = (
    (frozenset({"li"}), frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    (frozenset({"dt", "dd"}), frozenset({"dt", "dd"}), frozenset({"dl"})),
    (frozenset({"td", "th"}), frozenset({"td", "th"}), frozenset({"table", "tr"})),
    (frozenset({"tr"}), frozenset({"tr", "td", "th"}), frozenset({"table"})),
    (frozenset({"tbody", "thead", "tfoot"}), frozenset({"tbody", "thead", "tfoot", "tr", "td", "th"}), frozenset({"table"})),
    (frozenset({"option"}), frozenset({"option"}), frozenset({"select"})),
)
_CLOSING = {tag: k for k, (tags, _, _) in enumerate(CLOSES) for tag in tags}
_SCOPED = frozenset(tag for _, kinds, stops in CLOSES for tag in kinds | stops)
CUT_TAGS = frozenset("nav aside footer form menu dialog button select fieldset search head video audio canvas".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that name what the contract leaves out, compared with whole words.
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies respond".split())
CUT_WORDS = COMMENT_WORDS | frozenset(
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager toolbar "
    "header masthead topbar footer footers colophon sidebar sidebars aside "
    "cookie cookies consent gdpr notice notices notification notifications popup modal paywall "
    "ad ads advert adverts advertisement advertisements advertising adsense adbox adslot banner banners sponsor sponsored sponsors promo promos "
    "form search searchbox login signup signin subscribe newsletter".split()
)
#: Words that say that an element holds the article, whatever else its name says.
ARTICLE_WORDS = frozenset("article content post story entry".split())
#: A class that begins so describes a container by what it holds or lacks.
MODIFIERS = frozenset("has with without no is".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*(?:([^\s=/>][^\s=/>]*)(\s*=\s*(?:(["'])|([^\s>"'][^\s>]*))?)?|(=))""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[a-z0-9]+|[A-Z][a-z0-9]*")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "items", "cut", "near", "next", "far", "link", "chars", "in_article", "in_header", "inside", "p", "scope")

    def __init__(self, tag: str, parent: Node | None, cut: bool = False):
        self.tag, self.parent, self.cut = tag, parent, cut
        self.items: list = []  # nodes, and (text, is_link) runs
        self.near = self.next = self.far = 0.0  # points of own paragraphs, of children's, of those beyond
        self.link = self.chars = 0
        self.inside = False
        self.in_article = tag in ("article", "main") or (parent is not None and parent.in_article)
        self.in_header = tag == "header" or (parent is not None and tag != "article" and parent.in_header)
        # the open paragraph that a block would end, and for each row of CLOSES what it would end
        self.p = self if tag == "p" else parent.p if parent is not None and tag in IN_P else None
        if parent is None:
            self.scope: tuple = (None,) * len(CLOSES)
        elif tag not in _SCOPED:
            self.scope = parent.scope
        else:
            self.scope = tuple(None if tag in stops else s if s is not None else self if tag in kinds else None for s, (_, kinds, stops) in zip(parent.scope, CLOSES, strict=True))

    @property
    def score(self) -> float:
        return self.near + self.next + self.far

    @property
    def density(self) -> float:
        return self.link / max(1, self.chars)


def _boilerplate(tag: str, attributes: list[tuple[str, str]], parent: Node, by_name: bool) -> bool:
    if tag in CUT_TAGS or tag == "header" and not parent.in_article:
        return True
    if tag in ("html", "body", "main"):
        return False
    for name, value in attributes:
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            return True
        if name == "role" and value.lower().strip() in CUT_ROLES and tag != "article":
            return True
        if by_name and name in ("class", "id") and tag not in HEADINGS and tag != "header":
            each = [[w.lower() for w in _WORD.findall(part)] for part in value.split()]
            named = {w for ws in each if ws and ws[0] not in MODIFIERS for w in ws}
            if tag == "article" and named & COMMENT_WORDS or tag != "article" and named & CUT_WORDS and (not named & ARTICLE_WORDS or named & (COMMENT_WORDS | {"sidebar", "footer", "ad", "ads", "nav", "menu"})):
                return True
    return False


class _Tags:
    """Reads tags of a page; a quote that never closes is looked for once."""

    def __init__(self, page: str):
        self.page = page
        self.open = {'"': False, "'": False}

    def read(self, at: int) -> tuple[str, list[tuple[str, str]], bool, int] | None:
        """Name, attributes, whether it closes itself, and the end of the tag whose name begins at ``at``; None if the page breaks off in it."""
        page = self.page
        m = _NAME.match(page, at)
        name, at = m[0].lower(), m.end()
        attributes: list[tuple[str, str]] = []
        while True:
            m = _ATTRIBUTE.match(page, at)
            if m is None:
                break
            at = m.end()
            value = m[4] or ""
            if m[3]:
                close = -1 if self.open[m[3]] else page.find(m[3], at)
                if close < 0:  # read on as if it had no quote
                    self.open[m[3]] = True
                else:
                    value, at = page[at:close], close + 1
            if m[1]:
                attributes.append((m[1].lower(), value))
        end = page.find(">", at)
        return None if end < 0 else (name, attributes, page[at:end].endswith("/"), end + 1)


def parse(page: str, by_name: bool = True) -> list[Node]:
    """The page as a tree of block elements with text runs, all elements in page order (the first is the root); ``by_name``: classes and ids can name boilerplate."""
    root = Node("#root", None)
    nodes, here, at, links, end = [root], root, 0, 0, len(page)
    opened: dict[str, int] = {}
    tags = _Tags(page)
    lowered = None

    def close_to(node: Node) -> Node:
        """Close elements up to and with ``node``."""
        inner = here
        while inner is not node:
            opened[inner.tag] -= 1
            inner = inner.parent
        opened[node.tag] -= 1
        return node.parent

    while at < end:
        less = page.find("<", at)
        if less < 0:
            here.items.append((page[at:], links > 0))
            break
        after = page[less + 1 : less + 2]
        closing = after == "/"
        if closing:
            after = page[less + 2 : less + 3]
        if not (after.isascii() and after.isalpha()) and not (after in ("!", "?") and after and not closing):
            here.items.append((page[at : less + 1], links > 0))  # a sign in the text
            at = less + 1
            continue
        if less > at:
            here.items.append((page[at:less], links > 0))
        if after in ("!", "?"):
            stop = page.find("-->", less + 4) if page.startswith("<!--", less) else page.find(">", less)
            if stop < 0:
                break
            at = stop + (3 if page.startswith("<!--", less) else 1)
            continue
        found = tags.read(less + 1 + closing)
        if found is None:  # a tag that the page breaks off in
            break
        tag, attributes, closed, at = found
        if closing:
            if tag == "a":
                links = 0
            elif tag == "br":
                here.items.append((" ", False))
            elif opened.get(tag):
                node = here
                while node.tag != tag:
                    node = node.parent
                here, links = close_to(node), 0
            continue
        if tag in RAW and not (closed and tag in ("svg", "math")):
            if lowered is None:
                lowered = page.lower()
                if len(lowered) != len(page):
                    lowered = "".join(c.lower() if c < "\x80" else c for c in page)
            close = lowered.find(f"</{tag}", at)
            if close < 0:
                break
            close = page.find(">", close)
            at = end if close < 0 else close + 1
        elif tag == "a":
            links = 1  # links don't nest
        elif tag == "br":
            here.items.append((" ", False))
        elif tag == "hr" or tag in BLOCKS:
            if tag not in IN_P:
                if here.p is not None:
                    here, links = close_to(here.p), 0
                if tag in HEADINGS and here.tag in HEADINGS:
                    here = close_to(here)
            if tag in _CLOSING and here.scope[_CLOSING[tag]] is not None:
                here = close_to(here.scope[_CLOSING[tag]])
            if tag in ("html", "body") and opened.get(tag):
                continue
            node = Node(tag, here, tag != "hr" and _boilerplate(tag, attributes, here, by_name))
            here.items.append(node)
            nodes.append(node)
            if tag != "hr":
                here = node
                opened[tag] = opened.get(tag, 0) + 1
                if tag != "p":
                    links = 0
    return nodes


def _clean(text: str) -> str:
    return _SPACE.sub(" ", html.unescape(text) if "&" in text else text).strip()


def _blocks(node: Node, out: list[tuple[str, Node, int]]) -> None:
    """Blocks of text below a node in page order: text, the node that holds it, characters in links. Iterative: pages may nest deeply."""
    run: list[tuple[str, bool]] = []

    def flush(owner: Node) -> None:
        if run:
            text = _clean("".join(t for t, _ in run))
            if text:
                out.append((text, owner, sum(len(_clean(t)) for t, x in run if x)))
            run.clear()

    stack: list[tuple[Node, Iterator]] = [(node, iter(node.items))]
    while stack:
        owner, items = stack[-1]
        item = next(items, None)
        if item is None:
            flush(owner)
            stack.pop()
        elif isinstance(item, tuple):
            run.append(item)
        else:
            flush(owner)
            if not item.cut:
                stack.append((item, iter(item.items)))


def points(text: str, link: int) -> float:
    """What a paragraph is worth: one, its commas, its length (3,000 characters count most), less its links."""
    return (1 + text.count(",") + text.count("、") + text.count("，") + min(len(text) / 100, 30)) * (1 - min(1.0, link / max(1, len(text))))


def score(nodes: list[Node], blocks: list[tuple[str, Node, int]]) -> None:
    """Points, characters and link characters of all elements."""
    for text, owner, link in blocks:
        owner.chars += len(text)
        owner.link += link
        if owner.tag not in HEADINGS:
            base = owner.parent if owner.tag in PARAGRAPHS and owner.parent is not None else owner
            base.near += points(text, link)
    for node in reversed(nodes[1:]):  # children come after their parents
        up = node.parent
        up.chars += node.chars
        up.link += node.link
        up.next += node.near / 2
        up.far += (node.next + node.far) / 3


def main_text(page: str | None) -> str:
    """Blocks of the main text, joined by a blank line; empty if there is none."""
    if not page:
        return ""
    blocks: list[tuple[str, Node, int]] = []
    nodes = parse(page)
    _blocks(nodes[0], blocks)
    if not blocks:  # perhaps a wrapper of the whole page has a name like boilerplate
        nodes = parse(page, by_name=False)
        _blocks(nodes[0], blocks)
    if not blocks:
        return ""
    score(nodes, blocks)
    best = max(nodes, key=lambda n: n.score * (1 - n.density))
    top = node = best
    while node is not None:
        if node.tag in ("article", "main"):
            top = node
            if node.tag == "article":
                break
        node = node.parent
    top.inside = True
    if top.tag not in ("article", "main") and top.parent is not None:
        for item in top.parent.items:
            if isinstance(item, Node) and not item.cut and (item.tag in HEADINGS or item.density <= MOST_LINKS):
                item.inside = True
    for node in nodes[1:]:
        node.inside = node.inside or node.parent.inside
    # the parent's own text stands beside the best container like a sibling
    beside = top.parent if top.tag not in ("article", "main", "#root") else None
    out = []
    for text, owner, link in blocks:
        # of an article's header the titles stay, the rest is no text
        if (owner.inside or owner is beside and link <= MOST_LINKS * len(text)) and (owner.tag in HEADINGS or not owner.in_header):
            out.append(text)
    return "\n\n".join(out)


def extract(pages: DataFrame, page: str = "html") -> DataFrame:
    """``pages`` with ``text`` (empty if there is none) and ``n_chars``; the page itself is left out.

    A null page is empty. Rows are independent: repeated rows give repeated
    results, an empty table an empty one; of equally good containers the first
    in the page is taken. A very long page is taken whole, in time linear in
    it. Columns of the input called as the results are replaced.
    """
    carried = [c for c in pages.columns if c not in {page, "text", "n_chars"}]
    schema = pages.select(*carried).withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, page, SLICE_BYTES):
                texts = [main_text(p) for p in text_array(part.column(page)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*carried, "text", "n_chars"])

    return pages.select(*carried, page).mapInArrow(task("htmltext", run), schema)
