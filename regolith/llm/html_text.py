"""Main text of web pages by composite text density.

Every DOM node's characters and tags are counted over its subtree, those under links apart. Its density
is characters per tag, weighed by a logarithm that shrinks with the share of linked characters and
tags; a node's density sum adds those of its children. The threshold is the smallest density on the
path from the body to the node of the largest sum; every node at or above it marks the node of the largest
sum in its subtree. The lowest node around all marked ones is the article, taken whole, so an article in
several containers is not cut to one of them. Navigation, forms and the like never count, and what is named after
them (an advert, a sidebar, comments) counts only where it is all that the page has.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("img a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
PRUNED = frozenset("nav header footer aside form script style noscript iframe template button select option textarea input svg canvas object dialog menu title head math audio video".split())
PRUNED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())
PRUNED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements sponsor sponsored promo promotion banner sidebar side nav navbar navigation menu menubar breadcrumb breadcrumbs footer header masthead comment comments disqus respond reply replies cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe signup share sharing social related recommended widget pagination pager toolbar login".split()
)
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An open element of the set ends where one of the key begins, up to an element of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}

#: Parts of compound names that say where or what for something stands, and nothing of what it is.
PLAIN_PARTS = frozenset(
    "list box wrap wrapper container holder inner outer area section block slot unit zone bar row col column panel group top bottom left right main site page global primary secondary links link buttons button icons items item form text title posts articles stories content js".split()
)
COMMENTS = frozenset("comment comments disqus respond reply replies".split())

_OPEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)|</>|<(/?)([a-zA-Z][^\s/>]*)", re.S)
#: One attribute as browsers read it: an unquoted value may hold quotes; a quote that never closes is part of a name.
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|((?![\"'])[^\s>]*)))?")
_TAG_END = re.compile(r"[\s/]*(?:>|\Z)")
_NAMES = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("name", "parent", "kids", "pruned", "inside", "named", "chars", "tags", "link_chars", "link_tags", "density", "total", "depth")

    def __init__(self, name: str, parent: Node | None, pruned: bool):
        self.name, self.parent, self.pruned, self.named = name, parent, pruned, ""
        self.kids: list = []  # nodes and pieces of text in page order
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.inside = name in ("article", "main") or (parent is not None and parent.inside)
        self.depth = parent.depth + 1 if parent else 0


#: Blocks of running text, of which a name says little.
PROSE = frozenset("p li dt dd td th blockquote pre h1 h2 h3 h4 h5 h6 figure figcaption".split())


def attributes(page: str, at: int) -> tuple[dict[str, str], int, bool]:
    """Attributes of a tag (the first of a name counts), where it ends, and whether a slash closes it."""
    found: dict[str, str] = {}
    while not (end := _TAG_END.match(page, at)):
        m = _ATTRIBUTE.match(page, at)
        found.setdefault(m[1].lower(), m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or "")
        at = m.end()
    return found, end.end(), "/" in end[0]


def _hidden(name: str, given: dict[str, str]) -> bool:
    return name in PRUNED or "hidden" in given or given.get("aria-hidden", "").lower() == "true" or given.get("role", "").strip().lower() in PRUNED_ROLES


def named(name: str, given: dict[str, str]) -> str:
    """What an element's class or id calls it: "comments", "extra" (other boilerplate) or nothing.

    A name counts as a whole: each part of it has to be a word for boilerplate or a plain one, so side-by-side,
    share-price or notice-board say nothing.
    """
    if name in ("body", "html", "article", "main"):
        return ""
    for one in f"{given.get('class', '')} {given.get('id', '')}".lower().split():
        parts = _NAMES.findall(one)
        said = [p for p in parts if p in PRUNED_NAMES]
        if said and all(p in PRUNED_NAMES or p in PLAIN_PARTS for p in parts):
            return "comments" if COMMENTS & set(said) else "extra"
    return ""


def parse(page: str) -> Node:
    """DOM of a page; stray end tags are passed over, missing ones implied, unclosed markup ends with the page."""
    root = Node("#root", None, False)
    open_: list[Node] = [root]
    places: dict[str, list[int]] = {}  # where in open_ the elements of a name are
    walls = [0]  # where those are that are not inline

    def close(down_to: int):
        while len(open_) > down_to:
            node = open_.pop()
            places[node.name].pop()
            if node.name not in INLINE:
                walls.pop()

    at, size, raw = 0, len(page), ""
    while at < size:
        if raw:  # text up to the element's own end tag
            m = re.compile(rf"</{raw}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if open_[-1].name == raw:
                if not open_[-1].pruned:
                    open_[-1].kids.append(page[at : m.start() if m else size])
                close(len(open_) - 1)
            at, raw = (m.end() if m else size), ""
            continue
        m = _OPEN.search(page, at)
        if m is None:
            open_[-1].kids.append(page[at:])
            break
        if m.start() > at:
            open_[-1].kids.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        given, at, closed = attributes(page, at)
        if m[1]:
            at_name = places.get(name)
            # a block is not closed by the end of what surrounds it inline
            if at_name and not (name in INLINE and walls[-1] > at_name[-1]):
                close(at_name[-1])
            continue
        if name in CLOSES_P and open_[walls[-1]].name == "p":
            close(walls[-1])
        if name in ENDS:
            ends, until = ENDS[name]
            top = max((places[u][-1] for u in until if places.get(u)), default=0)
            cut = min((p[i] for e in ends if (p := places.get(e)) and (i := bisect_right(p, top)) < len(p)), default=0)
            if cut:
                close(cut)
        parent = open_[-1]
        node = Node(name, parent, parent.pruned or _hidden(name, given))
        node.named = named(name, given)
        parent.kids.append(node)
        if name not in VOID and not closed:
            places.setdefault(name, []).append(len(open_))
            if name not in INLINE:
                walls.append(len(open_))
            open_.append(node)
            raw = name if name in RAW else ""
    return root


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, shared: float) -> float:
    """Characters per tag, times the log of the unlinked share, to a base that grows with linked text.

    shared is the body's share of linked characters; the base is e for a page without links.
    """
    if not chars:
        return 0.0
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + shared * chars + math.e) + math.e - 1
    gain = math.log(chars / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1))
    return chars / max(tags, 1) * max(gain, 0.0) / math.log(base)


def _nodes(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(k for k in n.kids if isinstance(k, Node))
    return out


def prune_named(root: Node) -> None:
    """Prunes what its name calls boilerplate, where the rest of the page agrees.

    Outside of an article with text, names decide. Elsewhere a named element goes if half of its characters are linked,
    if it holds comments and there is other text, or if it holds no more than the unlinked text around it that has no
    such name: within the article, or in a page without one. The largest of them is taken for content, whatever its
    name, if it holds more than that text. Running text goes for its links alone.
    """
    nodes = [n for n in _nodes(root) if not n.pruned]
    for n in reversed(nodes):
        n.chars += sum(sum(map(len, k.split())) for k in n.kids if isinstance(k, str))
        if n.name == "a":
            n.link_chars = n.chars
        if n.parent is not None:
            n.parent.chars += n.chars
            n.parent.link_chars += n.link_chars
    largest: dict[Node, Node] = {}
    scope, around = {root: root}, {root: root.chars - root.link_chars}
    for n in nodes:  # parents first: the outermost article or main around each node, and the unnamed text in it
        if n.parent is not None:
            up = scope[n.parent]
            scope[n] = n if up is root and n.name in ("article", "main") else up
            if scope[n] is n:
                around[n] = n.chars - n.link_chars
    for n in nodes:
        up = n.parent
        if n.named and scope[n] is not n and n.name not in PROSE and n.name not in INLINE:
            while up is not None and not up.named:
                up = up.parent
            if up is None or scope[up] is not scope[n]:
                for where in {scope[n], root}:
                    around[where] -= n.chars - n.link_chars
                if n.named == "extra" and 2 * n.link_chars < n.chars > getattr(largest.get(scope[n]), "chars", 0):
                    largest[scope[n]] = n
    has_article = any(n is not root and n.chars > n.link_chars for n in around)
    for where, n in largest.items():  # more than all that has no such name: the content itself
        if n.chars > around[where] and not (has_article and where is root):
            n.named, around[where] = "", around[where] + n.chars - n.link_chars
    for n in nodes:
        if n.parent is not None and n.parent.pruned:
            n.pruned = True
        elif n.named and n.chars and not n.pruned:
            left, links = around[scope[n]], 2 * n.link_chars >= n.chars
            if n.name in PROSE or n.name in INLINE:
                n.pruned = links and left > 0
            else:
                n.pruned = links or (has_article and scope[n] is root) or (left > 0 if n.named == "comments" else n.chars <= left)
    for n in nodes:
        n.chars = n.link_chars = 0


def measure(root: Node) -> list[Node]:
    """Counts and densities of all nodes, children before parents."""
    nodes = [n for n in _nodes(root) if not n.pruned]
    body = next((n for n in nodes if n.name == "body"), root)
    for n in reversed(nodes):
        n.chars += sum(sum(map(len, k.split())) for k in n.kids if isinstance(k, str))
        if n.name == "a":
            n.link_chars, n.link_tags = n.chars, n.tags + 1
        if n.parent is not None:
            p = n.parent
            p.chars += n.chars
            p.tags += n.tags + 1
            p.link_chars += n.link_chars
            p.link_tags += n.link_tags
    shared = body.link_chars / max(body.chars, 1)
    for n in nodes:
        n.density = composite_density(n.chars, n.tags, n.link_chars, n.link_tags, shared)
    for n in reversed(nodes):
        if n.parent is not None and n.name not in INLINE:  # markup inside a block does not make it a container
            n.parent.total += n.density
    return nodes


def article(root: Node) -> Node | None:
    """The lowest node around the largest-sum nodes of all subtrees at or above the body path's threshold."""
    nodes = measure(root)
    outer = ("#root", "html") if any(n.name == "body" for n in nodes) else ()
    inside = [n for n in nodes if n.chars and n.name not in INLINE and n.name not in outer] or [n for n in nodes if n.chars]
    if not inside:
        return None
    rank = lambda n: (n.total > 0, n.total or n.density, n.depth)  # noqa: E731  # containers before blocks, deeper ones win ties
    best = max(inside, key=rank)
    least, up = best.density, best
    while up is not None and up.name not in ("html", "#root"):
        least = min(least, up.density)
        up = up.parent
    top = {n: n for n in inside}  # of a node's subtree, the node of the largest sum
    for n in reversed(nodes):
        if n in top and n.parent is not None:
            top[n.parent] = max(top.get(n.parent, top[n]), top[n], key=rank)
    marked = {top[n] for n in inside if n.density >= least} | {best}
    held = dict.fromkeys(marked, 1)
    for n in reversed(nodes):
        if n in held and n.parent is not None:
            held[n.parent] = held.get(n.parent, 0) + held[n]
    return max((n for n in nodes if held.get(n) == len(marked)), key=lambda n: n.depth)


def blocks(node: Node) -> Iterator[str]:
    """Texts of the blocks below a node in page order, references decoded and white space made one blank."""
    held: list[str] = []
    stack: list = [iter([node])]

    def flush():
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        return [text] if text else []

    marks: list[bool] = [False]
    while stack:
        k = next(stack[-1], None)
        if k is None:
            stack.pop()
            if marks.pop():
                yield from flush()
        elif isinstance(k, str):
            held.append(k)
        elif not k.pruned:
            block = k.name not in INLINE
            if block:
                yield from flush()
            stack.append(iter(k.kids))
            marks.append(block)
    yield from flush()


def main_text(page: str) -> str:
    root = parse(page)
    prune_named(root)
    best = article(root)
    return "" if best is None else " ".join(blocks(best))


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars. A null or empty html, or one without text, gives an empty text.

    Repeated rows, null ids and urls are kept as they are; further columns are ignored.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(h or "") for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
