"""HTML extraction: the main text of a page by composite text density."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stand in a line of text; all others begin and end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup td th time tt u var wbr".split())
#: Elements whose text no reader sees, and controls of forms.
UNSEEN = frozenset("script style noscript template head title meta link iframe object svg canvas audio video map button select option textarea input dialog".split())
#: Elements whose content is no mark-up: it ends with their own end tag only.
RAW = frozenset("script style textarea title iframe noframes noembed".split())
#: Elements that lay out a page around its article.
LAYOUT = frozenset("nav aside footer menu form".split())
#: Words of a class, id or role that name something other than the article.
NOISE = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer "
    "comment comments commentlist discussion disqus respond replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social related recommended recommendations widget widgets pagination pager copyright disclaimer toolbar masthead topbar complementary contentinfo search".split()
)
#: Words that a hyphenated class may have beside those: it names noise only if all of its words are of these two kinds.
PLACE = frozenset("site page top bottom left right main block box wrapper wrap container section area bar list item inner outer global primary secondary header links buttons button icons form policy panel region col column row".split())
#: Words that are never the article's own, whatever part of the page they hold.
READERS = frozenset("comment comments commentlist discussion disqus respond replies".split())
#: Beside the word header these say that it is the article's own.
OWN_HEADER = frozenset("article post entry story content".split())
#: Opening one of these ends an open element of the set beside it.
_FLOW = "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
CLOSES = {t: frozenset({"p"}) for t in _FLOW} | {"li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}
#: An element that ends implicitly does so no farther out than the nearest of these.
SCOPE = frozenset("ul ol dl table tbody thead tfoot div section article main body html td th blockquote form".split())
_ENDED = frozenset().union(*CLOSES.values())
#: Part of a block's characters that are in links from which on it counts as a menu, outside articles.
LINKED = 0.8
#: Something named noise is the article after all if what is left of the page has less than this part of its plain text.
LEFT = 0.2

#: Comments, declarations and tags; what the page's end cuts off is read to the end. No repetition gives back what it took, so reading is linear.
_MARKUP = re.compile(r"""<(?:!--(?:-?>|(?:[^-]++|-(?!->|-!>))*+(?:--!?>)?+)|(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"?+|'[^']*+'?+)?+)*+)>?+|[!?/][^>]*+>?+)""")
_NAMED = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*+=\s*+(?:"([^"]*+)|'([^']*+)|([^\s>]++))""", re.IGNORECASE)


class Node:
    __slots__ = ("block", "chars", "children", "density", "ended", "inline", "kept", "link_chars", "link_tags", "noise", "parent", "sum", "tag", "tags", "words")

    def __init__(self, tag: str, parent: Node | None, words: frozenset[str] = frozenset()):
        self.tag, self.parent, self.words, self.children = tag, parent, words, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0
        self.noise = self.kept = False
        # the nearest block, the inline elements open in a block, the nearest element that can end implicitly or bounds that
        self.block = parent.block if parent is not None and tag in INLINE else self
        self.inline: dict[str, int] | None = None
        self.ended = self if parent is None or tag in _ENDED or tag in SCOPE else parent.ended


class _Tree:
    """The tree of a page, read in one pass whose cost is in proportion to the page, however broken it is."""

    def __init__(self, html: str):
        self.root = self.at = Node("html", None)
        self.open: dict[str, int] = {}
        at = 0
        while True:
            found = _MARKUP.search(html, at)
            if found is None:
                break
            if found.start() > at:
                self._text(html[at : found.start()])
            at = found.end()
            tag = (found[2] or "").lower()
            if found[1]:
                self._close(tag)
            elif tag and tag not in ("html", "body"):
                self._start(tag, found[3])
                if tag in RAW:
                    end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(html, at)
                    at = end.end() if end else len(html)
                    self._close(tag)
        self._text(html[at:])

    def _text(self, text: str) -> None:
        if text:
            self.at.children.append(unescape(text))

    def _start(self, tag: str, attributes: str) -> None:
        closes = CLOSES.get(tag)
        if closes and any(self.open.get(t) for t in closes):
            at = self.at.ended
            while at.parent is not None and at.tag not in closes and at.tag not in SCOPE:
                at = at.parent.ended
            if at.parent is not None and at.tag in closes:
                self._up(at.parent)
        words = " ".join(m[2] or m[3] or m[4] or "" for m in _NAMED.finditer(attributes)) if attributes else ""
        node = Node(tag, self.at, frozenset(words.lower().split()))
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1
            if node.block is not node:
                inline = node.block.inline = node.block.inline or {}
                inline[tag] = inline.get(tag, 0) + 1

    def _up(self, to: Node) -> None:
        """Ends all open elements inside ``to``."""
        while self.at is not to:
            self.open[self.at.tag] -= 1
            if self.at.block is not self.at:
                self.at.block.inline[self.at.tag] -= 1
            self.at = self.at.parent

    def _close(self, tag: str) -> None:
        if not self.open.get(tag) or tag in INLINE and not (self.at.block.inline or {}).get(tag):
            return  # nothing to end, or an inline element that a block inside it keeps open
        at = self.at
        while at.tag != tag:
            at = at.parent
        self._up(at.parent)


def _ordered(root: Node) -> list[Node]:
    """All nodes, each before its children."""
    out = [root]
    for node in out:
        out.extend(c for c in node.children if isinstance(c, Node))
    return out


def _named(words: frozenset[str]) -> bool:
    """Whether a class, id or role names noise: a whole word of NOISE, or a compound of such words and places alone."""
    for word in words:
        parts = [p for p in re.split(r"[-_:]+", word) if p and not p.isdigit()]
        if any(p in NOISE for p in parts) and all(p in NOISE or p in PLACE for p in parts) or len(parts) > 1 and parts[-1] in READERS:
            return True
    return False


def _mark_noise(nodes: list[Node]) -> None:
    """Marks what cannot be article by its element or its class, id and role; see also _release."""
    titled: set[int] = set()
    for node in reversed(nodes):
        if (node.tag in ("h1", "article", "main") or id(node) in titled) and node.parent is not None:
            titled.add(id(node.parent))
    for node in nodes:
        if node.parent is None:
            continue
        inside = node.parent.tag in ("article", "main", "section") and id(node) in titled
        readers = any(READERS & set(re.split(r"[-_:]+", w)) for w in node.words) if node.words else False
        node.noise = node.parent.noise or node.tag in UNSEEN
        if not node.noise and not node.kept:
            node.noise = (
                node.tag in LAYOUT
                or (node.tag == "header" or any(p == "header" for w in node.words for p in re.split(r"[-_:]+", w)) and not any(set(re.split(r"[-_:]+", w)) & OWN_HEADER for w in node.words)) and not inside
                or bool(node.words) and _named(node.words) and (id(node) not in titled or readers)
            )


def _plain(node: Node) -> int:
    """Characters outside links of all that can be seen at or below ``node``, noise or not."""
    total, stack = 0, [(node, node.tag == "a")]
    while stack:
        at, linked = stack.pop()
        for child in at.children:
            if isinstance(child, str):
                total += 0 if linked else len("".join(child.split()))
            elif child.tag not in UNSEEN:
                stack.append((child, linked or child.tag == "a"))
    return total


def _release(nodes: list[Node]) -> bool:
    """Takes the largest part of the page that only a name or a layout element makes noise as article after all, if almost nothing
    is left without it: a page that stands in one form, or an article in a class that means something else. Readers' words stay noise."""
    tops = [n for n in nodes if n.noise and n.parent is not None and not n.parent.noise and n.tag not in UNSEEN and not any(READERS & set(re.split(r"[-_:]+", w)) for w in n.words)]
    sizes = [_plain(n) for n in tops]
    best = max(range(len(tops)), key=sizes.__getitem__, default=None)
    root = nodes[0]
    if best is None or not sizes[best] or root.chars - root.link_chars >= LEFT * sizes[best]:
        return False
    if tops[best].tag in ("nav", "footer", "menu", "aside") and not any(n.tag in ("p", "h1", "article", "main") for n in _ordered(tops[best])):
        return False
    tops[best].kept = True
    return True


def _density(chars: int, link_chars: int, tags: int, link_tags: int, ratio: float) -> float:
    """Composite text density; ``ratio`` is the part of the page's characters that are in links."""
    plain = max(chars - link_chars, 1)
    base = math.log(chars / plain * link_chars + ratio * chars + math.e)
    weight = math.log(max(chars / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1), 1.0) + 1) / base
    return chars / max(tags, 1) * weight


def _measure(nodes: list[Node]) -> None:
    """Counts and composite text densities of what is not noise, children first."""
    links: dict[int, bool] = {}
    for node in nodes:
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.density = node.sum = 0.0
        links[id(node)] = node.tag == "a" or node.parent is not None and links[id(node.parent)]
    for node in reversed(nodes):
        if node.noise:
            continue
        for child in node.children:
            if isinstance(child, str):
                n = len("".join(child.split()))
                node.chars += n
                node.link_chars += n * links[id(node)]
            elif not child.noise:
                node.chars += child.chars
                node.link_chars += child.link_chars
                node.tags += child.tags + (child.tag not in INLINE or child.tag == "br")
                node.link_tags += child.link_tags + (child.tag == "a")
    body = nodes[0]
    ratio = body.link_chars / max(body.chars, 1)
    for node in nodes:
        if not node.noise and node.chars:
            node.density = _density(node.chars, node.link_chars, node.tags, node.link_tags, ratio)
    for node in reversed(nodes):
        blocks = [c for c in node.children if isinstance(c, Node) and not c.noise and c.tag not in INLINE]
        node.sum = sum(c.density for c in blocks)
        # the text that stands in the node itself counts like one more child
        own = [getattr(node, n) - sum(getattr(c, n) for c in blocks) for n in ("chars", "link_chars", "link_tags")]
        if own[0] and not node.noise:
            node.sum += _density(own[0], own[1], 0, own[2], ratio)


def _mark_menus(nodes: list[Node]) -> bool:
    """Marks blocks of links outside article and main elements as noise and tells whether there are any."""
    found = False
    inside: dict[int, bool] = {}
    for node in nodes:
        inside[id(node)] = node.tag in ("article", "main") or node.parent is not None and inside[id(node.parent)]
        if node.noise or node.parent is None or node.tag == "body" or inside[id(node)]:
            continue
        menu = node.tag not in INLINE and node.link_chars > LINKED * node.chars and node.link_tags > 1
        node.noise = menu or node.parent.noise
        found = found or menu
    return found


def _densest(nodes: list[Node]) -> dict[int, Node]:
    """For each node the block at or below it with the largest density sum, the outermost and first of equal ones."""
    best: dict[int, Node] = {}
    for node in reversed(nodes):
        own = node
        for child in node.children:
            if isinstance(child, Node) and not child.noise and child.tag not in INLINE and best[id(child)].sum > own.sum:
                own = best[id(child)]
        best[id(node)] = own
    return best


def _select(nodes: list[Node]) -> list[Node]:
    """The subtrees that are the article, in no order.

    The block with the largest density sum and what is as dense: the threshold is the least density on the path from it to the body,
    and of each subtree of the body that reaches it the part with the largest sum is taken. An element that holds
    all the text of the page counts as body; it is not itself compared. Headings before the article beside that path are its
    own. If the body itself has the largest sum, all of it stays. An article element is a unit: it is taken
    whole if it is the only one of the page or lies around the block with the largest sum.
    """
    inside: dict[int, bool] = {}
    outer = []
    for node in nodes:
        above = node.parent is not None and inside[id(node.parent)]
        inside[id(node)] = above or node.tag == "article" and not node.noise and node.chars > node.link_chars
        if inside[id(node)] and not above:
            outer.append(node)
    if len(outer) == 1:
        return outer
    densest = _densest(nodes)
    best = densest[id(nodes[0])]
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    around = [n for n in path if n.tag == "article"]
    if around:
        return [around[-1]]
    pages = [n for n in path[1:] if n.parent is None or n.tag == "body" or n.chars == nodes[0].chars]
    if not pages:
        return [best]
    page = pages[0]
    own = path[: path.index(page)]
    threshold = min(n.density for n in [*own, page])
    chosen, on_path = {id(best): best}, {id(n) for n in own}
    stack = [page]
    while stack:
        node = stack.pop()
        before = True
        for child in node.children:
            if not isinstance(child, Node) or child.noise or child.tag in INLINE or not child.chars:
                continue
            if id(child) in on_path:
                before = False
                if child is not best:
                    stack.append(child)
            elif before and child.tag in ("h1", "h2") and (node is page or id(node) in on_path):
                chosen[id(child)] = child
            elif child.density >= threshold:
                dense = densest[id(child)]
                chosen[id(dense)] = dense
                if dense is not child:
                    stack.append(child)
    return list(chosen.values())


def _blocks(root: Node, only: list[Node]) -> list[str]:
    """The text of each block of the subtrees ``only`` below ``root`` in page order."""
    blocks: list[list[str]] = [[]]
    chosen, above = {id(n) for n in only}, set()
    for n in only:
        while n is not None and id(n) not in above:
            above.add(id(n))
            n = n.parent
    stack: list[tuple[object, bool]] = [(root, False)]
    while stack:
        x, taken = stack.pop()
        if x is None:
            if blocks[-1]:
                blocks.append([])
        elif isinstance(x, str):
            if taken:
                blocks[-1].append(x)
        elif not x.noise and (taken or id(x) in above):
            taken = taken or id(x) in chosen
            inline = x.tag in INLINE
            if x.tag in ("br", "td", "th"):
                blocks[-1].append(" ")
            if not inline:
                if blocks[-1]:
                    blocks.append([])
                stack.append((None, taken))
            stack.extend((c, taken) for c in reversed(x.children))
    return [t for t in (" ".join("".join(b).split()) for b in blocks) if t]


def main_text(html: str | None) -> str:
    """The article of one page; empty if there is none."""
    tree = _Tree(html or "")
    nodes = _ordered(tree.root)
    _mark_noise(nodes)
    _measure(nodes)
    if _release(nodes):
        _mark_noise(nodes)
        _measure(nodes)
    if _mark_menus(nodes):
        _measure(nodes)
    return "\n\n".join(_blocks(tree.root, _select(nodes)))


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with ``text_col``: the main text of the whole ``html_col``.

    Elements and class names that cannot be article are set aside, unless that leaves next to nothing of the page; of the other
    nodes the composite text density (characters a tag, less for links) is computed, and the subtree with the
    largest sum of child densities is the article, with the other subtrees that are as dense (see _select). Blocks of at least two
    links with over LINKED of their characters are menus and left out, except in article and main elements. White space
    inside a block becomes one blank, blocks are joined by two newlines in page order. Broken mark-up is read as browsers do in
    the usual cases (open paragraphs and list items end by themselves), at a cost in proportion to the page.

    A null or empty page, and one without text, gives the empty text. Rows are independent and none is
    dropped; a column named ``text_col`` is replaced, the others pass through.
    """
    names = [c for c in pages.columns if c != text_col]
    schema = T.StructType([*[pages.schema[c] for c in names], T.StructField(text_col, T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = frame[names].copy()
            out[text_col] = [main_text(x) for x in frame[html_col]]
            yield out

    return pages.mapInPandas(run, schema)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
