"""XPath algebra, tries, containment and version diffs over the synthetic paths of customers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import xpath as X
from ..operators import trees
from ..sources import XPATHS_SQL, synthetic_xpaths, table

_GX = r"regexp_replace(xp, '\[[0-9]+\]', '', 'g')"
_PREFIXES = """pre AS (SELECT xp, size, nation, unnest(list_transform(range(1, len(string_split(xp, '/'))), lambda i: '/' || array_to_string(string_split(xp, '/')[2:i + 1], '/'))) AS p FROM xp)"""


def _paths(spark, sf):
    return synthetic_xpaths(spark, sf)


def _with_nations(spark, sf):
    """The paths, and each nation's and region's own path as larger rollup rows."""
    rows = _paths(spark, sf).select("xp", "size")
    up = rows.select(X.parent(F.col("xp")).alias("xp")).distinct().withColumn("size", F.lit(50).cast("long"))
    top = up.select(X.parent(F.col("xp")).alias("xp")).distinct().withColumn("size", F.lit(5).cast("long"))
    return rows.union(up).union(top)


def xpath_generalize(spark, sf):
    """Each path's pattern, parent and depth."""
    xp = F.col("xp")
    return _paths(spark, sf).select("c_custkey", X.generalise(xp).alias("gx"), X.parent(xp).alias("parent"), X.depth(xp).alias("depth"), X.last_segments(xp, 3).alias("tail"))


def pattern_groups(spark, sf):
    """Paths by pattern: members, parents, sizes."""
    rows = _paths(spark, sf).withColumn("gx", X.generalise(F.col("xp")))
    return rows.groupBy("gx").agg(F.count("*").alias("n"), F.countDistinct(X.parent(F.col("xp"))).alias("n_parents"), F.min("size").alias("min_size"), F.max("size").alias("max_size"))


def trie_counts(spark, sf):
    """Per prefix: paths that end there and paths in its subtree."""
    return trees.prefix_counts(_paths(spark, sf), "xp")


def trie_collapse(spark, sf):
    """Prefixes that stay when chains of single children are collapsed: ends of paths and forks."""
    return trees.collapsed_prefixes(_paths(spark, sf), "xp")


def rollup_prune(spark, sf):
    """Rows without those of a size over 10 that contain another row."""
    return trees.prune_rollups(_with_nations(spark, sf), "xp", "size", 10).select("xp", "size")


def nearest_parent(spark, sf):
    """Each row's longest strict prefix that is a row too."""
    return trees.nearest_ancestor(_with_nations(spark, sf).select("xp"), "xp")


def lca_by_group(spark, sf):
    """The longest common prefix of each nation's paths."""
    return trees.common_prefix(_paths(spark, sf), "nation", "xp")


def commutation(spark, sf):
    """Paths that share the pattern of the first customer's parent."""
    rows = _with_nations(spark, sf).withColumn("gx", X.generalise(F.col("xp")))
    source = rows.where(F.col("xp").endswith("customer[1]")).select(X.parent(F.col("gx")).alias("gx")).distinct()
    return rows.join(F.broadcast(source), "gx", "left_semi").select("xp")  # one row


def pattern_set_groups(spark, sf):
    """Nations with equal sets of customer sizes, as groups of two or more."""
    sets = _paths(spark, sf).groupBy("nation").agg(F.array_join(F.array_sort(F.collect_set("size")), ",").alias("sizes"))
    return sets.groupBy("sizes").agg(F.count("*").alias("n"), F.min("nation").alias("first")).where("n >= 2")


def homogeneous_parents(spark, sf):
    """Parents whose children all have one pattern."""
    rows = _with_nations(spark, sf).select(X.parent(F.col("xp")).alias("parent"), X.generalise(F.col("xp")).alias("gx"))
    return rows.groupBy("parent").agg(F.count("*").alias("n"), F.countDistinct("gx").alias("patterns")).where("patterns = 1")


def budget_chunks(spark, sf):
    """The largest subtrees whose sizes sum to at most 200."""
    return trees.within_budget(_paths(spark, sf), "xp", "size", 200)


def version_diff(spark, sf):
    """Two versions of each pattern's state: the old one without customers 0 modulo 5, the new without 1 modulo 5, sizes of 2 modulo 5 changed."""
    rows = _paths(spark, sf)
    old = rows.where("c_custkey % 5 <> 0").select("xp", "size")
    new = rows.where("c_custkey % 5 <> 1").select("xp", F.when(F.col("c_custkey") % 5 == 2, F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    return trees.diff(old, new, ["xp"], "size").groupBy("state").agg(F.count("*").alias("n"))


def lifecycle_diff(spark, sf):
    """States of (customer, priority) keys between finished and open orders, by their largest price."""
    orders = table(spark, sf, "orders")
    side = lambda s: orders.where(F.col("o_orderstatus") == s).groupBy("o_custkey", "o_orderpriority").agg(F.max("o_totalprice").alias("price"))
    return trees.diff(side("F"), side("O"), ["o_custkey", "o_orderpriority"], "price").select("o_custkey", "o_orderpriority", "state")


def cross_page_match(spark, sf):
    """Fingerprints of orders (priority and status) that occur for several customers."""
    hashed = table(spark, sf, "orders").withColumn("hash", F.concat_ws("|", "o_orderpriority", "o_orderstatus"))
    return hashed.groupBy("hash").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("n_urls")).where("n_urls >= 2")


def pattern_representative(spark, sf):
    """The largest member of each nation, ties to the smaller key."""
    w = Window.partitionBy("nation").orderBy(F.desc("size"), "c_custkey")
    return _paths(spark, sf).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("nation", "xp", "size")


QUERIES = {f.__name__: f for f in (xpath_generalize, pattern_groups, trie_counts, trie_collapse, rollup_prune, nearest_parent, lca_by_group, commutation, pattern_set_groups, homogeneous_parents, budget_chunks, version_diff, lifecycle_diff, cross_page_match, pattern_representative)}

_ALL = f"""WITH {XPATHS_SQL},
    up AS (SELECT DISTINCT regexp_replace(xp, '/[^/]*$', '') AS xp, 50::BIGINT AS size FROM xp),
    top AS (SELECT DISTINCT regexp_replace(xp, '/[^/]*$', '') AS xp, 5::BIGINT AS size FROM up),
    a AS (SELECT xp, size FROM xp UNION ALL SELECT * FROM up UNION ALL SELECT * FROM top)"""

SQL = {
    "xpath_generalize": f"WITH {XPATHS_SQL} SELECT c_custkey, {_GX} AS gx, regexp_replace(xp, '/[^/]*$', '') AS parent, 5 AS depth, '…/' || array_to_string(string_split(xp, '/')[4:6], '/') AS tail FROM xp",
    "pattern_groups": f"WITH {XPATHS_SQL} SELECT {_GX} AS gx, count(*) AS n, count(DISTINCT regexp_replace(xp, '/[^/]*$', '')) AS n_parents, min(size) AS min_size, max(size) AS max_size FROM xp GROUP BY 1",
    "trie_counts": f"WITH {XPATHS_SQL}, {_PREFIXES} SELECT p AS prefix, count(*) FILTER (p = xp) AS own, count(*) AS subtree FROM pre GROUP BY p",
    "trie_collapse": f"""WITH {XPATHS_SQL}, {_PREFIXES}, nx AS (SELECT p, bool_or(p = xp) AS ends, count(DISTINCT CASE WHEN p <> xp THEN string_split(substr(xp, length(p) + 2), '/')[1] END) AS forks FROM pre GROUP BY p)
        SELECT p AS prefix FROM nx WHERE ends OR forks <> 1""",
    "rollup_prune": f"{_ALL}, par AS (SELECT DISTINCT regexp_replace(xp, '/[^/]*$', '') AS p FROM a) SELECT xp, size FROM a WHERE NOT (size > 10 AND EXISTS (SELECT 1 FROM par WHERE starts_with(par.p || '/', a.xp || '/')))",
    "nearest_parent": f"""{_ALL} SELECT c.xp, p.xp AS parent FROM a c LEFT JOIN a p ON p.xp = regexp_replace(c.xp, '/[^/]*$', '')""",
    "lca_by_group": f"WITH {XPATHS_SQL}, {_PREFIXES}, n AS (SELECT nation, count(DISTINCT xp) AS n FROM xp GROUP BY nation) SELECT nation, max(p) AS lca FROM (SELECT nation, p, count(DISTINCT xp) AS c FROM pre GROUP BY ALL) JOIN n USING (nation) WHERE c = n AND n > 1 GROUP BY nation UNION ALL SELECT nation, max(regexp_replace(xp, '/[^/]*$', '')) FROM xp JOIN n USING (nation) WHERE n = 1 GROUP BY nation",
    "commutation": f"{_ALL} SELECT xp FROM up",
    "pattern_set_groups": f"WITH {XPATHS_SQL}, s AS (SELECT nation, array_to_string(list_sort(list(DISTINCT size)), ',') AS sizes FROM xp GROUP BY nation) SELECT sizes, count(*) AS n, min(nation) AS first FROM s GROUP BY sizes HAVING count(*) >= 2",
    "homogeneous_parents": f"{_ALL} SELECT regexp_replace(xp, '/[^/]*$', '') AS parent, count(*) AS n, 1::BIGINT AS patterns FROM a GROUP BY 1 HAVING count(DISTINCT {_GX}) = 1",
    "budget_chunks": f"""WITH {XPATHS_SQL}, {_PREFIXES}, t AS (SELECT p, sum(size) AS total FROM pre GROUP BY p)
        SELECT t.p AS prefix, t.total::BIGINT AS total FROM t LEFT JOIN t u ON u.p = regexp_replace(t.p, '/[^/]*$', '') WHERE t.total <= 200 AND coalesce(u.total > 200, true)""",
    "version_diff": f"""WITH {XPATHS_SQL}, o AS (SELECT xp, size FROM xp WHERE c_custkey % 5 <> 0), n AS (SELECT xp, CASE WHEN c_custkey % 5 = 2 THEN size + 1 ELSE size END AS size FROM xp WHERE c_custkey % 5 <> 1)
        SELECT CASE WHEN o.xp IS NULL THEN 'added' WHEN n.xp IS NULL THEN 'removed' WHEN o.size <> n.size THEN 'changed' ELSE 'stable' END AS state, count(*) AS n FROM o FULL JOIN n USING (xp) GROUP BY 1""",
    "lifecycle_diff": """WITH f AS (SELECT o_custkey, o_orderpriority, max(o_totalprice) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), o AS (SELECT o_custkey, o_orderpriority, max(o_totalprice) AS p FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL)
        SELECT o_custkey, o_orderpriority, CASE WHEN f.p IS NULL THEN 'added' WHEN o.p IS NULL THEN 'removed' WHEN f.p <> o.p THEN 'changed' ELSE 'stable' END AS state FROM f FULL JOIN o USING (o_custkey, o_orderpriority)""",
    "cross_page_match": "SELECT o_orderpriority || '|' || o_orderstatus AS hash, count(*) AS n, count(DISTINCT o_custkey) AS n_urls FROM orders GROUP BY 1 HAVING count(DISTINCT o_custkey) >= 2",
    "pattern_representative": f"WITH {XPATHS_SQL} SELECT nation, xp, size FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY size DESC, c_custkey) AS rn FROM xp) WHERE rn = 1",
}
