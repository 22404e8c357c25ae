"""Pages as node tables. A page becomes rows with pre-order ids, so that ancestor tests are comparisons of ranges."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import xpath as X
from ..sources import kept_large

#: Elements without an end tag, and those that a start tag of the same kind ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDED_BY_SAME = frozenset("p li tr td th dt dd option".split())

NODES = "page_id long, url string, node_id int, parent_id int, last_id int, tag string, xpath string, text string, attrs map<string,string>, height int, size int, exact string, template string, shape string"


def _hash(*parts: str) -> str:
    return hashlib.sha1("\x1f".join(parts).encode("utf-8", "surrogatepass")).hexdigest()[:16]


class _Tree(HTMLParser):
    """Rows of one page: [parent, tag, xpath, texts, attrs, children, last]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = [[-1, "#document", "", [], {}, [], 0]]
        self.open, self.ordinals = [0], [{}]

    def updatepos(self, i: int, j: int) -> int:  # lines aren't counted
        return j

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ENDED_BY_SAME and self.rows[self.open[-1]][1] == tag:
            self._close(len(self.open) - 1)
        up, counts = self.open[-1], self.ordinals[-1]
        counts[tag] = counts.get(tag, 0) + 1
        me = len(self.rows)
        self.rows.append([up, tag, f"{self.rows[up][2]}/{tag}[{counts[tag]}]", [], {k: v or "" for k, v in attrs}, [], me])
        self.rows[up][5].append(me)
        if tag not in VOID:
            self.open.append(me)
            self.ordinals.append({})

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.rows[self.open[depth]][1] == tag:
                self._close(depth)
                return

    def handle_data(self, data: str) -> None:
        if data.strip() and self.rows[self.open[-1]][1] not in ("script", "style"):
            self.rows[self.open[-1]][3].append(data)

    def _close(self, depth: int) -> None:
        del self.open[depth:], self.ordinals[depth:]


#: Templates and shapes repeat within and across pages; long lists of children aren't remembered.
_seen = functools.lru_cache(1 << 15)(_hash)


#: The hashes of a subtree.
HASHES = ("exact", "template", "shape")


def _page_columns(page_id, url, html: str | None, hashes: tuple[str, ...] = HASHES) -> list[list]:
    """A page's rows as columns in the order of ``_SCHEMA``; of the last three only ``hashes`` are made."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    parents, tags, paths, texts, attrs, kids, lasts = map(list, zip(*tree.rows))
    n = len(tags)
    texts = [" ".join(" ".join(t).split()) if t else "" for t in texts]
    height, size = [1] * n, [1] * n
    for i in range(n - 1, -1, -1):  # children come after their parent
        below = kids[i]
        height[i] = 1 + max([height[c] for c in below]) if below else 0
        if below:
            size[i] += sum([size[c] for c in below])
            lasts[i] = max([lasts[c] for c in below])
    columns = [[page_id] * n, [url] * n, list(range(n)), parents, lasts, tags, paths, texts, [list(a.items()) for a in attrs], height, size]
    if not hashes:
        return columns
    exact, template, shape = [""] * n, [""] * n, [""] * n
    for i in range(n - 1, -1, -1):
        below, tag = kids[i], tags[i]
        named = _seen if len(below) <= 32 else _hash
        if "exact" in hashes:
            exact[i] = _hash(tag, texts[i], *[f"{k}={v}" for k, v in sorted(attrs[i].items())], *[exact[c] for c in below])
        if "template" in hashes:
            template[i] = named(tag, *sorted({template[c] for c in below}))  # kinds of children, not how many
        if "shape" in hashes:
            shape[i] = named(tag, *[shape[c] for c in below])
    return [*columns, *(column for name, column in zip(HASHES, (exact, template, shape)) if name in hashes)]


def _page_rows(page_id, url, html: str | None) -> list[dict]:
    return [dict(zip(_SCHEMA.names, row)) for row in zip(*_page_columns(page_id, url, html))]


_SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("last_id", pa.int32()), ("tag", pa.string()), ("xpath", pa.string()),
    ("text", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("height", pa.int32()), ("size", pa.int32()), ("exact", pa.string()), ("template", pa.string()), ("shape", pa.string()),
])


def _parse(hashes: tuple[str, ...]):
    schema = pa.schema([f for f in _SCHEMA if f.name not in HASHES or f.name in hashes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[] for _ in schema]
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                for column, more in zip(columns, _page_columns(page_id, url, html, hashes)):
                    column += more
                if len(columns[0]) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
                    columns = [[] for _ in schema]
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def nodes(pages: DataFrame, hashes: bool | tuple[str, ...] = True) -> DataFrame:
    """One row per element of each page (page_id, url, html), with content hashes. Null html gives the document node alone.

    ``last_id`` is the last node of the subtree; ``exact`` covers tags, attributes and texts; ``template`` the kinds of
    children only, so repeated cards share it; ``shape`` the tags of the subtree in order. Of these three only those in
    ``hashes`` (all or none for True and False) are made and given."""
    hashes = HASHES if hashes is True else hashes or ()
    held = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return held.mapInArrow(_parse(hashes), NODES[: NODES.index(", exact")] + "".join(f", {name} string" for name in HASHES if name in hashes))


def content(rows: DataFrame) -> DataFrame:
    """Nodes with text, a link or an image."""
    return rows.where("text <> '' or attrs['href'] is not null or attrs['src'] is not null")


def tagged(rows: DataFrame) -> DataFrame:
    """(page_id, node_id, tag kind, value): text, url, media and interactive values of each node."""
    pairs = [("text", F.when(F.col("text") != "", F.col("text"))), ("url", F.col("attrs")["href"]), ("media", F.col("attrs")["src"]), ("interactive", F.when(F.col("tag").isin("a", "button", "input", "select", "textarea"), F.col("tag")))]
    entries = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("kind"), v.alias("value"))) for k, v in pairs]))
    return rows.select("page_id", "node_id", F.explode(entries).alias("e")).select("page_id", "node_id", "e.kind", "e.value")


def templates(rows: DataFrame, least: int = 2, least_height: int = 1) -> DataFrame:
    """(page_id, template, n, tag, size): templates that repeat in a page, those inside others too (``templates.template_groups`` leaves these out)."""
    groups = rows.where(F.col("height") >= least_height).groupBy("page_id", "template").agg(F.count("*").alias("n"), F.first("tag").alias("tag"), F.max("size").alias("size"), F.min("node_id").alias("first_id"))
    return groups.where(F.col("n") >= least)


def sibling_duplicates(rows: DataFrame) -> DataFrame:
    """Nodes whose subtree repeats an earlier sibling's exactly."""
    w = Window.partitionBy("page_id", "parent_id", "exact").orderBy("node_id")
    return rows.where("parent_id >= 0").withColumn("rn", F.row_number().over(w)).where("rn > 1").select("page_id", "node_id", "parent_id", "tag")


def chunks(rows: DataFrame, budget: int) -> DataFrame:
    """(page_id, node_id, xpath, n_chars, text): the largest subtrees with at most ``budget`` signs of text.

    A node's text size is a running sum over its interval, looked up at the interval's last node by an equality join."""
    run = rows.withColumn("until", F.sum(F.length("text")).over(Window.partitionBy("page_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)))
    ends = run.select("page_id", F.col("node_id").alias("last_id"), F.col("until").alias("end"))
    sized = run.join(ends, ["page_id", "last_id"]).withColumn("n_chars", F.col("end") - F.col("until") + F.length("text"))
    parents = sized.select("page_id", F.col("node_id").alias("parent_id"), F.col("n_chars").alias("above"))
    top = sized.join(parents, ["page_id", "parent_id"], "left").where((F.col("n_chars") > 0) & (F.col("n_chars") <= budget) & F.coalesce(F.col("above") > budget, F.lit(True)))
    return top.select("page_id", "node_id", "xpath", "n_chars")


def pattern_counts(rows: DataFrame) -> DataFrame:
    """Per page and generalised path: nodes, templates among them, text."""
    return rows.where("parent_id >= 0").groupBy("page_id", X.generalise(F.col("xpath")).alias("gx")).agg(F.count("*").alias("n"), F.countDistinct("template").alias("templates"), F.sum(F.length("text")).alias("n_chars"))


def repeated_across_pages(rows: DataFrame, least_size: int = 3) -> DataFrame:
    """Exact subtrees that occur on several pages."""
    return rows.where(F.col("size") >= least_size).groupBy("exact").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("n_pages"), F.first("tag").alias("tag")).where("n_pages >= 2")


def without_repeats(rows: DataFrame) -> DataFrame:
    """Nodes outside subtrees that repeat an earlier subtree of the page (Merkle pruning)."""
    w = Window.partitionBy("page_id", "exact").orderBy("node_id")
    marked = rows.withColumn("again", (F.row_number().over(w) > 1) & (F.col("size") > 1))
    reach = F.max(F.when(F.col("again"), F.col("last_id"))).over(Window.partitionBy("page_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("masked", F.coalesce(reach >= F.col("node_id"), F.lit(False))).where("not masked").drop("again", "masked")


def cross_page_matches(rows: DataFrame, least_size: int = 3) -> DataFrame:
    """(exact, url, xpath, n, n_urls, first_url): subtrees of at least ``least_size`` nodes that several urls hold.

    One row per subtree and url with its first path there and the number of its places; each url is tied to the smallest
    url of the group, so a subtree of all pages gives one row a page and not one a pair of pages."""
    own = rows.where((F.col("size") >= least_size) & F.col("url").isNotNull()).groupBy("exact", "url").agg(F.min_by("xpath", F.struct("page_id", "node_id")).alias("xpath"), F.count("*").alias("n"))
    groups = own.groupBy("exact").agg(F.count("*").alias("n_urls"), F.min("url").alias("first_url")).where("n_urls >= 2")
    return own.join(groups, "exact").select("exact", "url", "xpath", "n", "n_urls", "first_url")


def containment(rows: DataFrame, least: int = 2, least_height: int = 1) -> DataFrame:
    """(src, dst): distinct edges from the template of each node's nearest marked ancestor to its own, both repeating in their page.

    Nodes are marked if their template repeats. The edge needs a higher ancestor, and a template fixes its height, so the
    edges are acyclic. A template also fixes the templates of the children, so all that is high enough below a marked node repeats
    with it: the nearest marked ancestor is the parent, or there is none."""
    n = F.sum((F.col("height") >= least_height).cast("long")).over(Window.partitionBy("page_id", "template"))
    marked = rows.select("page_id", "node_id", "parent_id", "template", "height").withColumn("n", n).where((F.col("n") >= least) & (F.col("parent_id") >= 0))
    marked = kept_large(marked.drop("n"))
    tops = marked.select("page_id", F.col("node_id").alias("parent_id"), F.col("template").alias("src"), F.col("height").alias("top"))
    return marked.join(tops, ["page_id", "parent_id"]).where("top > height").select("src", F.col("template").alias("dst")).distinct()
