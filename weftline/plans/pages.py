"""Structure of pages. DuckDB can't parse html, so these have SQL only where counts can be taken from the raw text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages
from ..sources import table


def _nodes(spark, sf):
    return pages.nodes(table(spark, sf, "pages"))


def html_nodes(spark, sf):
    """Per page: nodes, leaves, depth, text."""
    rows = _nodes(spark, sf)
    return rows.groupBy("page_id").agg(F.count("*").alias("n"), F.sum((F.col("height") == 0).cast("long")).alias("leaves"), F.max("height").alias("height"), F.sum(F.length("text")).alias("n_chars"))


def html_tags(spark, sf):
    """Values of each kind per page."""
    return pages.tagged(_nodes(spark, sf)).groupBy("page_id", "kind").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_distinct"))


def html_links(spark, sf):
    """Links of pages: how many nodes have each target."""
    return _nodes(spark, sf).where("tag = 'a'").groupBy(F.col("attrs")["href"].alias("href")).agg(F.count("*").alias("n"))


def html_chunks(spark, sf):
    return pages.chunks(_nodes(spark, sf), 600)


def html_patterns(spark, sf):
    return pages.pattern_counts(_nodes(spark, sf))


def wl_templates(spark, sf):
    return pages.templates(_nodes(spark, sf)).select("page_id", "template", "n", "tag")


def sibling_duplicates(spark, sf):
    return pages.sibling_duplicates(_nodes(spark, sf))


def merkle_repeats(spark, sf):
    return pages.repeated_across_pages(_nodes(spark, sf))


def merkle_pruned(spark, sf):
    """Nodes that stay per page when repeated subtrees go."""
    return pages.without_repeats(_nodes(spark, sf)).groupBy("page_id").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (html_nodes, html_tags, html_links, html_chunks, html_patterns, wl_templates, sibling_duplicates, merkle_repeats, merkle_pruned)}

SQL = {
    "html_links": """SELECT href, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages) GROUP BY href""",
}
