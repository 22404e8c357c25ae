"""Template mining on pages and on customers' orders as pages. DuckDB can't parse html, so but for counts that follow from
the orders these are tested against brute force on parsed pages."""

from __future__ import annotations

from ..operators import pages, templates, within
from ..sources import kept_large, order_pages, table


def _nodes(spark, sf):
    return kept_large(templates.outlined(pages.nodes(table(spark, sf, "pages"), hashes=("template",))))


def _mined(rows):
    return rows, kept_large(templates.template_groups(rows))


def template_groups(spark, sf):
    """Templates that stand for themselves: not all inside a higher one, not all inside links."""
    return within.template_groups(order_pages(spark, sf))


def singleton_sections(spark, sf):
    """Text that no template covers, gathered by parent."""
    return templates.singleton_sections(*_mined(_nodes(spark, sf))).select("page_id", "node_id", "tag", "n", "n_chars")


def orphan_groups(spark, sf):
    """What neither templates nor sections cover."""
    rows, groups = _mined(_nodes(spark, sf))
    return templates.orphan_groups(rows, groups, kept_large(templates.singleton_sections(rows, groups)))


def anchor_promotion(spark, sf):
    """Instances of templates once those inside links have given way to the links."""
    return templates.promoted_instances(*_mined(_nodes(spark, sf)))


def sub_templates(spark, sf):
    """Shapes that recur inside composite templates."""
    return within.sub_templates(order_pages(spark, sf))


def tree_distances(spark, sf):
    """Templates of a page whose trees are at most three edits apart."""
    return within.tree_distances(order_pages(spark, sf))


def common_subtrees(spark, sf):
    """Templates of a page that have most of their smaller tree in common."""
    return within.common_subtrees(order_pages(spark, sf))


def merged_templates(spark, sf):
    """Templates joined by common subtrees: the highest and most frequent of each set, and how many instances it now has."""
    return within.merged_templates(order_pages(spark, sf))


QUERIES = {f.__name__: f for f in (template_groups, singleton_sections, orphan_groups, anchor_promotion, sub_templates, tree_distances, common_subtrees, merged_templates)}

SQL = {
    "template_groups": """WITH l AS (SELECT o_custkey AS c, o_orderkey AS o, l_returnflag = 'R' AS ret FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
        o AS (SELECT c, o, bool_or(ret)::INT + 2 * bool_or(NOT ret)::INT AS kind FROM l GROUP BY ALL), k AS (SELECT c, kind, count(*) AS kn FROM o GROUP BY ALL),
        li AS (SELECT l.c, ret, kind, count(*) AS n, max(kn) AS kn FROM l JOIN o USING (c, o) JOIN k USING (c, kind) GROUP BY ALL)
        SELECT c AS page_id, 'article' AS tag, 3 AS height, kn AS n FROM k WHERE kn >= 2
        UNION ALL SELECT c, 'h2', 1, sum(kn)::BIGINT FROM k GROUP BY c HAVING count(*) > 1
        UNION ALL SELECT c, 'section', 2, 2 * sum(kn)::BIGINT FROM k GROUP BY c HAVING NOT (count(*) = 1 AND max(kn) >= 2)
        UNION ALL SELECT c, 'li', 1, sum(n)::BIGINT FROM li GROUP BY c, ret HAVING sum(n) >= 2 AND NOT (count(*) = 1 AND max(kn) >= 2)""",
}
