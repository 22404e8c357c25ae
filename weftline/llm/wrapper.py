"""Main text of web pages by wrapper induction.

Pages of one host are parsed to small trees of block elements, gathered by layout and aligned by simple tree matching with
the largest page of their layout.  A slot whose text is the same on the aligned pages belongs to the template and is dropped
there, and only there; slots whose text varies are content.  Elements that say by name that they are menus, adverts,
comments and the like are left out on every page, so hosts with too few different pages to align still lose them.
"""

from __future__ import annotations

import html
import re
import sys

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches

#: Pages of a host that are aligned together, different pages of a layout needed to call a slot's text a template (it must
#: be on all of them, or on the share of at least twice as many), and how much of the larger tree two pages of a layout have
#: in common.
GROUP_PAGES, LEAST_PAGES, TEMPLATE_SHARE, LAYOUT = 48, 4, 0.9, 0.6
#: Hosts whose page counts may be broadcast; with more, pages are shuffled to the counts.
FEW_HOSTS = 200_000

#: Fixed word lists: elements that hold blocks of text, elements whose content isn't text, elements without an end tag,
#: elements that are no article text, and words of class, id and role that mark such elements.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
RAW = "script style title textarea noscript iframe template svg math object noembed noframes xmp"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_ARTICLE = frozenset("nav header footer aside form dialog menu search button select label fieldset head".split())
MARKS = frozenset(
    "ad ads adv advert advertisement advertising adverts sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar aside header masthead footer comment comments reply replies disqus respond discussion notice notices cookie cookies "
    "consent gdpr alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "widget toolbar pagination pager complementary contentinfo search form".split()
)
#: Words that say nothing beside one of these. Inside an article, a class counts only if it has no other words.
PLAIN_MARKS = frozenset("box block list section area container wrapper unit slot inner outer item items bar text body thread row cell".split())
#: Elements that a new element of the same group ends if they are still open.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    rf"|<({RAW.replace(' ', '|')})\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-z][^\s/>]*)([^>]*)>",
    re.I | re.S,
)
_MARKING = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


class Node:
    """A block element. ``parts`` holds its own texts and its child elements in page order."""

    __slots__ = ("name", "skip", "parts", "children", "shape", "size", "inline")

    def __init__(self, name: str, skip: bool = False, inline: bool = False):
        self.name, self.skip, self.inline = name, skip, inline
        self.parts: list = []
        self.children: list[Node] = []
        self.shape, self.size = 0, 1


def _marked(attributes: str, inside: bool = False) -> bool:
    found = ["".join(x).lower() for x in _MARKING.findall(attributes)]
    if not inside:
        return any(not MARKS.isdisjoint(_WORD.findall(x)) for x in found)
    names = [set(_WORD.findall(name)) for x in found for name in x.split()]
    return any(not MARKS.isdisjoint(x) and x <= MARKS | PLAIN_MARKS and x != {"discussion"} for x in names)


def parse(source: str) -> Node:
    """The tree of block elements, and of inline elements that are marked as no article text."""
    root = Node("html")
    stack, at = [root], 0
    for m in _TOKEN.finditer(source):
        if m.start() > at:
            stack[-1].parts.append(source[at : m.start()])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        if m[2] or m[5]:  # an end tag closes the nearest open element of its name
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
            if depth:
                del stack[depth:]
            elif name in BLOCKS:
                stack[-1].parts.append(None)
            continue
        if name == "br":
            stack[-1].parts.append(" ")
            continue
        attributes = m[4] or m[7] or ""
        block = name in BLOCKS
        inside = any(x.name in ("article", "main") for x in stack)
        marked = bool(attributes) and _marked(attributes, inside)
        if not block and not marked and name not in NOT_ARTICLE or name in ("html", "body"):
            continue
        if block:
            while stack[-1].name == "p" or stack[-1].inline and len(stack) > 1 and stack[-2].name == "p":
                stack.pop()  # a block ends an open paragraph
        ends = SIBLINGS.get(name, ())
        while ends and stack[-1].name in ends:
            stack.pop()
        skip = name in NOT_ARTICLE and not (name == "header" and inside) or marked and not (name in ("article", "main") and not inside)
        node = Node(name, skip, not block)
        stack[-1].parts.append(node)
        stack[-1].children.append(node)
        if name not in VOID and not attributes.endswith("/"):
            stack.append(node)
    if at < len(source):
        stack[-1].parts.append(source[at:])
    return root


def _settle(node: Node) -> None:
    """Sizes and shapes (a hash of the tree of names), bottom up and without recursion."""
    order = [node]
    for x in order:
        order.extend(x.children)
    for x in reversed(order):
        x.size = 1 + sum(c.size for c in x.children)
        x.shape = hash((x.name, x.skip, *(c.shape for c in x.children)))


def blocks(root: Node) -> list[tuple[Node, str]]:
    """The texts of article blocks in page order, each with the element that it is in."""
    out: list[tuple[Node, str]] = []
    held: list[str] = []
    owner = root

    def end() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            out.append((owner, text))
        held.clear()

    todo: list = [(root, 0)]
    while todo:
        node, i = todo.pop()
        while i < len(node.parts):
            part = node.parts[i]
            i += 1
            if isinstance(part, str):
                if not held:
                    owner = node
                held.append(part)
            elif part is None:
                end()
            elif part.skip:
                if not part.inline:
                    end()
            else:
                if not part.inline:
                    end()
                todo.append((node, i))
                node, i = part, 0
        if not node.inline:
            end()
    return out


def region(root: Node) -> list[Node]:
    """The outermost article or main elements that aren't left out; the whole page if there are none."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.skip:
            continue
        if node.name in ("article", "main"):
            found.append(node)
        else:
            todo.extend(reversed(node.children))
    return found or [root]


def match(a: Node, b: Node, pairs: list[tuple[Node, Node]] | None = None, known: dict | None = None) -> int:
    """Simple tree matching: the most nodes that can be paired with names, ancestors and order kept. ``pairs`` gets them;
    ``known`` keeps what pairs of shapes are worth, so that deep trees are gone through once."""
    if a.name != b.name or a.skip != b.skip:
        return 0
    known = {} if known is None else known
    if pairs is not None:
        pairs.append((a, b))
    elif (a.shape, b.shape) in known:
        return known[a.shape, b.shape]
    x, y = a.children, b.children
    low, m, n = 0, len(x), len(y)
    total = 1
    while low < m and low < n and x[low].shape == y[low].shape:
        total += match(x[low], y[low], pairs, known) if pairs is not None else x[low].size
        low += 1
    while m > low and n > low and x[m - 1].shape == y[n - 1].shape:
        m, n = m - 1, n - 1
        total += match(x[m], y[n], pairs, known) if pairs is not None else x[m].size
    if low < m and low < n:
        best = [[0] * (n - low + 1) for _ in range(m - low + 1)]
        for i in range(low, m):
            above, row = best[i - low], best[i - low + 1]
            for j in range(low, n):
                row[j - low + 1] = max(above[j - low + 1], row[j - low], above[j - low] + match(x[i], y[j], None, known))
        total += best[-1][-1]
        i, j = m, n
        while pairs is not None and i > low and j > low:
            here = best[i - low][j - low]
            if here == best[i - low - 1][j - low]:
                i -= 1
            elif here == best[i - low][j - low - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                match(x[i], y[j], pairs, known)
    known[a.shape, b.shape] = total
    return total


def _layouts(trees: list[Node], pages: list[int]) -> list[list[int]]:
    """Pages by layout, each with its largest page first. Pages of like trees share most nodes with that page."""
    out: list[list[int]] = []
    for i in sorted(pages, key=lambda i: -trees[i].size):
        own = next((x for x in out if match(trees[x[0]], trees[i]) >= LAYOUT * trees[x[0]].size), None)
        out.append([i]) if own is None else own.append(i)
    return out


def extract(pages: list[str], least: int = LEAST_PAGES, share: float = TEMPLATE_SHARE) -> list[str]:
    """Main texts of pages of one host."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))  # trees may be as deep as pages are long
    trees = [parse(x) for x in pages]
    found = [blocks(x) for t in trees for x in [_joined(region(t))]]
    if len(pages) < least:
        return ["\n".join(text for _, text in own) for own in found]
    seen: set[str] = set()
    different = set()  # pages of which at least half of the blocks are new: copies say nothing about the template
    for i, own in enumerate(found):
        texts = [t for _, t in own]
        if texts and 2 * sum(t not in seen for t in texts) >= len(texts):
            different.add(i)
            seen.update(texts)
    for t in trees:
        _settle(t)
    out = [""] * len(pages)
    for layout in _layouts(trees, list(range(len(pages)))):
        base = trees[layout[0]]
        slot = {id(n): k for k, n in enumerate(_all(base))}
        texts_of: dict[int, dict[int, str]] = {}  # by page: the text of each slot that is aligned
        place: dict[int, int] = {}
        for i in layout:
            own: dict[int, list[str]] = {}
            for node, text in found[i]:
                own.setdefault(id(node), []).append(text)
            pairs: list[tuple[Node, Node]] = []
            match(base, trees[i], pairs)
            place.update((id(b), slot[id(a)]) for a, b in pairs)
            texts_of[i] = {slot[id(a)]: "\n".join(own[id(b)]) for a, b in pairs if id(b) in own}
        votes: dict[tuple[int, str], int] = {}
        among = [i for i in layout if i in different]
        for i in among:
            for key in texts_of[i].items():
                votes[key] = votes.get(key, 0) + 1
        enough = share * len(among) if len(among) >= 2 * least else len(among)
        template = {key for key, n in votes.items() if n >= least and n >= enough}
        for i in layout:
            drop = {k for k, text in texts_of[i].items() if (k, text) in template}
            out[i] = "\n".join(text for node, text in found[i] if place.get(id(node)) not in drop)
    return out


def _joined(nodes: list[Node]) -> Node:
    if len(nodes) == 1:
        return nodes[0]
    root = Node("html")
    root.parts = list(nodes)
    return root


def _all(root: Node) -> list[Node]:
    order = [root]
    for x in order:
        order.extend(x.children)
    return order


def main_text(pages: DataFrame, group_pages: int = GROUP_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages`` (page_id, url, html; other columns are ignored).

    Blocks are joined by a line end; white space in a block is one space; character references are decoded.  A null or
    empty html gives an empty text.  Pages whose url is null or has no host are aligned with each other.  A host's pages
    are spread over groups of about ``group_pages`` by a hash, so no host is gathered in one task; a repeated row comes
    back as often.  Very long and very deep pages are taken whole; the larger of two layouts' pages of equal size is the one that
    comes first by page_id and html.  An empty table gives no rows.
    """
    bounded_batches(pages.sparkSession)
    name = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), name.alias("host"))
    groups = pages.select(name.alias("host")).groupBy("host").agg(F.ceil(F.count("*") / F.lit(group_pages)).alias("groups"))
    few = groups.count() <= FEW_HOSTS
    rows = rows.join(F.broadcast(groups) if few else groups, "host").withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.col("groups")))

    def group(own: pa.Table) -> pa.Table:
        own = own.sort_by([("page_id", "ascending"), ("html", "ascending")])
        texts = extract(own["html"].to_pylist())
        return pa.table({"page_id": own["page_id"], "url": own["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())})

    return rows.groupBy("host", "part").applyInArrow(group, "page_id long, url string, text string, n_chars long")
