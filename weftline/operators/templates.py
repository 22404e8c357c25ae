"""Repeating structure of pages beyond the template hash: which templates matter, what they leave uncovered, and what
their instances hold in common.  Input are node tables (``pages.nodes``); all steps are joins on the page and a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import xpath as X
from ..sources import kept_large

#: Elements that hold no template, the page's frame, and drawing elements whose parts are no sub-templates.
SKIPPED = "script style noscript template meta link".split()
FRAME = "#document html head body".split()
DRAWING = "svg canvas video audio defs g filter fecolormatrix fegaussianblur femerge feoffset fecomponenttransfer style noscript template".split()

_KEY = ["page_id", "node_id"]


def framed(rows: DataFrame) -> DataFrame:
    """Elements within the frame."""
    return rows.where(_framed())


def outlined(rows: DataFrame) -> DataFrame:
    """Node tables with what templates need of a node instead of its texts and attributes: ``is_link`` (has an href), ``is_content`` (own text, href or src, within the frame), ``is_anchor`` (a link by its tag) and ``chars``.

    ``elements`` and what builds on it make these where they are missing."""
    href, src = F.col("attrs")["href"].isNotNull(), F.col("attrs")["src"].isNotNull()
    return rows.select(*_KEY, "parent_id", "last_id", "tag", "xpath", "height", "template", href.alias("is_link"), (~F.col("tag").isin(*SKIPPED, *FRAME) & ((F.col("text") != "") | href | src)).alias("is_content"),
        (href & (F.col("tag") == "a")).alias("is_anchor"), F.length("text").cast("long").alias("chars"))


def _outlined(rows: DataFrame) -> DataFrame:
    return rows if "is_anchor" in rows.columns else outlined(rows)


def _framed() -> Column:
    return ~F.col("tag").isin(*SKIPPED, *FRAME)


def _scanned(rows: DataFrame, tops: DataFrame | None = None) -> DataFrame:
    """``outlined`` nodes with ``in_link`` (strictly inside one), ``holds`` (content in the subtree), ``until`` (signs of text in the frame so far) and ``free`` (neither one of ``tops`` nor below one).

    Tops lie between the nodes as rows of their own, so a page is moved once and read in order: nothing is joined."""
    own = _outlined(rows)
    own = own.withColumn("end", F.lit(None).cast("int"))
    if tops is not None:
        own = own.unionByName(tops.select(*_KEY, F.col("last_id").alias("end")), allowMissingColumns=True)
    page = Window.partitionBy("page_id")
    order, back = page.orderBy("node_id"), page.orderBy(F.desc("node_id")).rowsBetween(Window.unboundedPreceding, 0)
    link = F.max(F.when(F.col("is_anchor"), F.col("last_id"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    until = F.sum(F.when(_framed(), F.col("chars"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    seen = own.withColumns({"in_link": F.coalesce(link >= F.col("node_id"), F.lit(False)), "until": F.coalesce(until, F.lit(0)), "free": F.coalesce(F.max("end").over(order) < F.col("node_id"), F.lit(True))})
    ahead = F.min(F.when(F.col("is_content"), F.col("node_id"))).over(back)
    return seen.withColumn("holds", F.coalesce(ahead <= F.col("last_id"), F.lit(False))).where("tag is not null").drop("end")


def above(rows: DataFrame, tops: DataFrame, *kept: str, own: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, node_id, top_id, ...): each node of ``rows`` with each of ``tops`` that lies strictly above it; ``own`` are further columns of rows, ``kept`` of tops."""
    up = rows.select(*_KEY, *own, F.explode(X.ancestors(F.col("xpath"))).alias("path"))
    return up.join(tops.select("page_id", F.col("xpath").alias("path"), F.col("node_id").alias("top_id"), *kept), ["page_id", "path"]).drop("path")


def nearest(rows: DataFrame, tops: DataFrame) -> DataFrame:
    """(page_id, node_id, top_id): the lowest of ``tops`` strictly above each node that has one."""
    return above(rows, tops).groupBy(*_KEY).agg(F.max("top_id").alias("top_id"))


def template_groups(rows: DataFrame, least: int = 2, least_height: int = 1) -> DataFrame:
    """Instances of the templates of each page that stand for themselves: their nodes with ``is_link``, ``in_link`` and ``freq``, the instances of their template.

    A template has ``least`` instances of at least that height, each with content of its own or below it.  It is left out if all its instances lie inside instances of a higher template, or inside links."""
    own = Window.partitionBy("page_id", "template")
    held = _scanned(rows).where(_framed() & F.col("holds") & (F.col("height") >= least_height)).select(*_KEY, "parent_id", "last_id", "tag", "xpath", "height", "template", "is_link", "is_content", "in_link")
    held = kept_large(held.withColumns({"freq": F.count("*").over(own), "linked": F.bool_and("in_link").over(own)}).where(F.col("freq") >= least))
    tops = held.withColumnsRenamed({"template": "top_template", "height": "top_height"})
    inside = above(held, tops, "top_template", "top_height", own=("template", "height", "freq")).where("top_height > height")
    # a template fixes its height, so an instance lies in one instance of another at most
    inside = inside.groupBy("page_id", "template", "top_template", "freq").agg(F.count("*").alias("n")).where("n = freq").select("page_id", "template").distinct()
    return held.where("not linked").drop("linked").join(inside, ["page_id", "template"], "left_anti")


def singleton_sections(rows: DataFrame, groups: DataFrame, least_chars: int = 150, least_nodes: int = 3) -> DataFrame:
    """(page_id, node_id, last_id, tag, xpath, n, n_chars): parents of at least so many content elements with so much text that no template covers.

    The parent itself isn't covered and is no part of the frame; of sections inside each other the outermost stays.
    An element's text is that of its subtree: a difference of running sums at both ends of its interval."""
    read = kept_large(_scanned(rows, groups).select(*_KEY, "parent_id", "last_id", "tag", "xpath", "is_content", "chars", "until", "free"))
    ends = read.select("page_id", F.col("node_id").alias("last_id"), F.col("until").alias("end"))
    free = read.where(_framed() & F.col("free"))
    said = free.where("is_content").select("page_id", "parent_id", "last_id", (F.col("chars") - F.col("until")).alias("less")).join(ends, ["page_id", "last_id"]).withColumn("n_chars", F.col("end") + F.col("less")).where("n_chars > 0")
    kids = said.groupBy("page_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars")).where((F.col("n") >= least_nodes) & (F.col("n_chars") >= least_chars))
    parents = kept_large(free.select(*_KEY, "last_id", "tag", "xpath").join(kids, _KEY))
    return parents.join(above(parents, parents).select(*_KEY).distinct(), _KEY, "left_anti")


def orphan_groups(rows: DataFrame, groups: DataFrame, sections: DataFrame, least: int = 2) -> DataFrame:
    """(page_id, parent_id, kind, n, first_id): content elements that neither a template nor a section covers, by parent and kind (link or text)."""
    tops = groups.select(*_KEY, "last_id").union(sections.select(*_KEY, "last_id"))
    free = _scanned(rows, tops).where(F.col("is_content") & F.col("free"))
    return free.groupBy("page_id", "parent_id", F.when(F.col("is_link"), "link").otherwise("text").alias("kind")).agg(F.count("*").alias("n"), F.min("node_id").alias("first_id")).where(F.col("n") >= least)


def promoted_instances(rows: DataFrame, groups: DataFrame, least: int = 2) -> DataFrame:
    """(page_id, template, node_id, promoted): instances once those inside links are dealt with.

    A template with ``least`` instances outside links keeps these; otherwise the nearest links around its instances
    stand for it, if they are that many, and else it goes."""
    links = _outlined(rows).where(F.col("is_link") & ~F.col("tag").isin(*FRAME))
    at = groups.select(*_KEY, "template", "is_link").join(nearest(groups, links), _KEY, "left")
    at = at.withColumn("inside", ~F.col("is_link") & F.col("top_id").isNotNull())
    counts = at.groupBy("page_id", "template").agg(F.sum((~F.col("inside")).cast("long")).alias("free"), F.max("inside").alias("any"), F.countDistinct("top_id").alias("tops"))
    at = at.join(counts, ["page_id", "template"])
    own = at.where(~F.col("inside") & (~F.col("any") | (F.col("free") >= least))).select("page_id", "template", "node_id", F.lit(False).alias("promoted"))
    up = at.where((F.col("free") < least) & F.col("any") & (F.col("tops") >= least) & F.col("top_id").isNotNull()).select("page_id", "template", F.col("top_id").alias("node_id"), F.lit(True)).distinct()
    return own.union(up)


def composites(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(page_id, template, freq) of templates with an instance that holds two different addresses or has three element children."""
    hrefs = rows.where("attrs['href'] is not null").select(*_KEY, "xpath", F.col("attrs")["href"].alias("href"))
    own = groups.select("page_id", F.col("node_id").alias("top_id"), "template", "freq")
    held = above(hrefs, groups).join(hrefs.select(*_KEY, "href"), _KEY).select("page_id", "top_id", "href").union(hrefs.select("page_id", "node_id", "href"))
    several = held.join(own, ["page_id", "top_id"]).groupBy("page_id", "template", "freq", "top_id").agg(F.countDistinct("href").alias("n")).where("n >= 2")
    kids = rows.where(~F.col("tag").isin(*SKIPPED)).groupBy("page_id", F.col("parent_id").alias("top_id")).agg(F.count("*").alias("n")).where("n >= 3")
    wide = kids.join(own, ["page_id", "top_id"])
    return several.select("page_id", "template", "freq").union(wide.select("page_id", "template", "freq")).distinct()


def sub_templates(rows: DataFrame, groups: DataFrame, least: int = 2, least_height: int = 2) -> DataFrame:
    """(page_id, template, shape, tag, height, n, first_id): shapes that recur inside the instances of a composite template at least as often as it has instances.

    The instances' descendants are pooled by shape. Only those count that have siblings, that are no instance of a
    template and hold none, and that lie in no other instance between; one of them has an address."""
    groups = groups.join(composites(rows, groups).select("page_id", "template", F.lit(True).alias("composite")), ["page_id", "template"], "left")
    barred = kept_large(groups.select(*_KEY, "xpath", "template", "composite", "freq"))
    # what holds an instance is barred as well: an element's nearest barred ancestor must be the composite instance
    holds = barred.select("page_id", F.explode(X.prefixes(X.parent(F.col("xpath")))).alias("xpath")).distinct()
    plain = rows.where(~F.col("tag").isin(*SKIPPED)).withColumn("siblings", F.count("*").over(Window.partitionBy("page_id", "parent_id")))
    free = plain.join(barred.select(*_KEY), _KEY, "left_anti").join(holds, ["page_id", "xpath"], "left_anti")
    stops = rows.select(*_KEY, "xpath").join(holds, ["page_id", "xpath"]).select(*_KEY, "xpath").union(barred.select(*_KEY, "xpath")).distinct()
    free = free.join(nearest(free, stops), _KEY)
    owner = barred.where("composite").select("page_id", F.col("node_id").alias("top_id"), F.col("template").alias("owner"), "freq")
    hrefs = rows.where(F.col("attrs")["href"].isNotNull() | F.col("attrs")["src"].isNotNull())
    pool = free.where((F.col("siblings") >= 2) & (F.col("height") >= least_height) & ~F.col("tag").isin(*DRAWING)).join(owner, ["page_id", "top_id"])
    with_url = above(hrefs, pool).select("page_id", F.col("top_id").alias("node_id")).union(hrefs.select(*_KEY)).distinct().withColumn("url_there", F.lit(True))
    pool = pool.join(with_url, _KEY, "left")
    found = pool.groupBy("page_id", F.col("owner").alias("template"), "freq", "shape").agg(F.first("tag").alias("tag"), F.first("height").alias("height"), F.count("*").alias("n"), F.min("node_id").alias("first_id"), F.max("url_there").alias("url_there"))
    return found.where((F.col("n") >= F.greatest("freq", F.lit(least))) & F.col("url_there")).drop("freq", "url_there")


def template_edges(groups: DataFrame) -> DataFrame:
    """(page_id, src, dst): the template of each instance's nearest instance above, and its own, if that one is higher."""
    near = nearest(groups, groups).join(groups.select(*_KEY, F.col("template").alias("dst"), "height"), _KEY)
    near = near.join(groups.select("page_id", F.col("node_id").alias("top_id"), F.col("template").alias("src"), F.col("height").alias("top")), ["page_id", "top_id"])
    return near.where("top > height").select("page_id", "src", "dst").distinct()


def trees(rows: DataFrame, roots: DataFrame, depth: int = 4) -> DataFrame:
    """(page_id, root_id, labels, depths): the tags of the subtrees of ``roots`` (page_id, node_id, xpath) down to a depth, in page order.

    A node looks for roots at its own path and at those of the ``depth`` nodes above it, so how far up one lies is its depth."""
    own = rows.where(~F.col("tag").isin(*SKIPPED, "#document")).select(*_KEY, "tag", "xpath", F.regexp_count("xpath", F.lit("/")).alias("level"))
    up = own.select(*_KEY, "tag", "xpath", "level", F.explode(F.sequence(F.lit(0), F.least(F.lit(depth), F.col("level") - 1))).alias("depth"))
    up = up.select(*_KEY, "tag", "depth", F.call_function("substring_index", "xpath", F.lit("/"), F.col("level") + 1 - F.col("depth")).alias("path"))
    pairs = up.join(roots.select("page_id", F.col("xpath").alias("path"), F.col("node_id").alias("root_id")).distinct(), ["page_id", "path"])
    held = F.array_sort(F.collect_list(F.struct("node_id", "tag", "depth")))
    return pairs.groupBy("page_id", "root_id").agg(held.alias("x")).select("page_id", "root_id", F.col("x.tag").alias("labels"), F.col("x.depth").alias("depths"))
