"""Cohorts of siblings and patterns of child tags, on customers' orders as pages. What follows from the orders has SQL; the
rest is tested against brute force on parsed pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohorts, pages, within
from ..sources import kept_large, order_pages, table


def sibling_cohorts(spark, sf):
    """How many siblings each branching element has, chains of only children contracted."""
    return within.cohort_sizes(order_pages(spark, sf))


def spectral_cohorts(spark, sf):
    """Clusters of siblings by spectral cuts of their structural terms."""
    found = cohorts.spectral_cohorts(kept_large(pages.nodes(table(spark, sf, "pages"))))
    return found.groupBy("page_id", "cohort_id", "cluster").agg(F.count("*").alias("n"), F.min("node_id").alias("first_id"))


def settled_signatures(spark, sf):
    """Groups of siblings by the signature at which their groups settle, over all cohorts of a page."""
    return within.settled_signatures(order_pages(spark, sf))


def pq_trees(spark, sf):
    """PQ-trees of the templates of all pages."""
    return within.pq_trees(within.instance_trees(order_pages(spark, sf)))


def pattern_matches(spark, sf):
    """How many elements match the compiled pattern of each template."""
    return within.pattern_matches(order_pages(spark, sf))


QUERIES = {f.__name__: f for f in (sibling_cohorts, spectral_cohorts, settled_signatures, pq_trees, pattern_matches)}

SQL = {
    # an article's cohort: its heading's link, its list and both sections' links; a list of one plain line is a chain down to that line
    "sibling_cohorts": """WITH l AS (SELECT o_custkey AS c, o_orderkey AS o, 2 + (l_returnflag = 'R')::INT AS parts FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
        o AS (SELECT c, o, count(*) AS lines FROM l GROUP BY ALL), n AS (SELECT c, count(*) AS n FROM o GROUP BY c),
        s AS (SELECT c, n FROM n WHERE n > 1 UNION ALL SELECT c, 4 FROM o UNION ALL SELECT c, lines FROM o WHERE lines > 1 UNION ALL SELECT c, parts FROM l)
        SELECT c AS page_id, n::BIGINT AS n, count(*) AS n_cohorts FROM s GROUP BY ALL""",
}
