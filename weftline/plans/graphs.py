"""Graph queries over regions, nations, customers and orders, and over part suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..sources import table


def _edges(spark, sf):
    """region -> nation -> customer -> order, by prefixed names."""
    t = lambda n: table(spark, sf, n)
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [
        t("nation").select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst")),
        t("customer").select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst")),
        t("orders").select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst")),
    ]
    return parts[0].union(parts[1]).union(parts[2])


def _regions(spark, sf):
    return table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("origin"))


def bfs_khop(spark, sf):
    """Nodes within three steps of each region, with their distance."""
    return graph.reach(_edges(spark, sf), _regions(spark, sf), 3)


def forward_reachable(spark, sf):
    """How many nodes each region reaches, at which depth."""
    return bfs_khop(spark, sf).groupBy("origin", "distance").agg(F.count("*").alias("n"))


def upstream_walk(spark, sf):
    """Ancestors of the nations' first customers, deepest first by distance."""
    edges = _edges(spark, sf).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    first = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("k"))
    return graph.reach(edges, first.select(F.concat(F.lit("c"), F.col("k").cast("string")).alias("origin")), 4)


def degree_peripheral(spark, sf):
    """Nodes without in- or out-edges, by kind."""
    d = graph.degrees(_edges(spark, sf)).where("n_in = 0 or n_out = 0")
    return d.groupBy(F.substring("node", 1, 1).alias("kind")).agg(F.count("*").alias("n"), F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"))


def incident_edges(spark, sf):
    """Edges at nation 0, either end."""
    return _edges(spark, sf).where("src = 'n0' or dst = 'n0'")


def sources_sinks(spark, sf):
    """Customers without orders (sinks that aren't orders)."""
    e = _edges(spark, sf)
    ends = e.select(F.col("dst").alias("node")).distinct().join(e.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
    return ends.where("node like 'c%'")


def candidate_targets(spark, sf):
    """Nations without an edge from region 0, as candidates for one."""
    near = _edges(spark, sf).where("src = 'r0'").select(F.col("dst").alias("node"))
    every = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"))
    return every.join(near, "node", "left_anti")


def _both_ways(spark, sf):
    """Nations and customers, edges both ways."""
    c = table(spark, sf, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("src"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("dst"))
    return c.union(c.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def pagerank(spark, sf):
    """PageRank of nations and customers after ten rounds, edges both ways, dangling mass dropped."""
    return graph.pagerank(_both_ways(spark, sf), rounds=10).select("node", F.round("rank", 8).alias("rank"))


def pagerank_settled(spark, sf):
    """The same after thirty rounds, as many as the original makes."""
    return graph.pagerank(_both_ways(spark, sf), rounds=30).select("node", F.round("rank", 8).alias("rank"))


def causal_chain(spark, sf):
    """Each conversation's chain of turns, root first, as text."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role")))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(ordered.alias("t"))
    return rows.select("conv_id", F.array_join(F.transform("t", lambda x: F.concat(x.turn.cast("string"), F.lit(":"), x.role)), ">").alias("chain"), F.size("t").alias("n"))


def two_step_suppliers(spark, sf):
    """Pairs of region and part over suppliers: how many suppliers and lines link them."""
    lines = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    return lines.join(s, lines.l_suppkey == s.s_suppkey).groupBy("n_regionkey", "l_partkey").agg(F.count("*").alias("n_suppliers"), F.sum("n").alias("n_lines"))


QUERIES = {f.__name__: f for f in (bfs_khop, forward_reachable, upstream_walk, degree_peripheral, incident_edges, sources_sinks, candidate_targets, pagerank, pagerank_settled, causal_chain, two_step_suppliers)}

_E = """e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""
_W = f"""{_E}, w AS (SELECT 'r' || r_regionkey AS origin, 'r' || r_regionkey AS node, 0 AS distance FROM region UNION ALL SELECT origin, dst, distance + 1 FROM w JOIN e ON node = src WHERE distance < 3),
    m AS (SELECT origin, node, min(distance)::INT AS distance FROM w GROUP BY ALL)"""


def _pagerank_sql(rounds: int = 10) -> str:
    steps = ["p0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nd) AS rank FROM nd)"]
    for i in range(1, rounds + 1):
        steps.append(f"g{i} AS (SELECT dst, sum(rank / deg) AS gain FROM l JOIN p{i - 1} ON l.src = node GROUP BY dst), p{i} AS (SELECT node, (1 - 0.85) / (SELECT count(*) FROM nd) + 0.85 * coalesce(gain, 0) AS rank FROM nd LEFT JOIN g{i} ON node = dst)")
    return f"""WITH c AS (SELECT 'n' || c_nationkey AS a, 'c' || c_custkey AS b FROM customer), e AS (SELECT a AS src, b AS dst FROM c UNION ALL SELECT b, a FROM c),
        nd AS (SELECT DISTINCT src AS node FROM e UNION SELECT dst FROM e), o AS (SELECT src, count(*) AS deg FROM e GROUP BY src), l AS (SELECT e.src, dst, deg FROM e JOIN o USING (src)), {', '.join(steps)}
        SELECT node, round(rank, 8) AS rank FROM p{rounds}"""


SQL = {
    "bfs_khop": f"WITH RECURSIVE {_W} SELECT * FROM m",
    "forward_reachable": f"WITH RECURSIVE {_W} SELECT origin, distance, count(*) AS n FROM m GROUP BY ALL",
    "upstream_walk": """WITH f AS (SELECT c_nationkey, min(c_custkey) AS k FROM customer GROUP BY ALL)
        SELECT 'c' || k AS origin, 'c' || k AS node, 0 AS distance FROM f UNION ALL SELECT 'c' || k, 'n' || c_nationkey, 1 FROM f UNION ALL SELECT 'c' || k, 'r' || n_regionkey, 2 FROM f JOIN nation ON c_nationkey = n_nationkey""",
    "degree_peripheral": f"""WITH {_E}, d AS (SELECT node, sum(i) AS n_in, sum(o) AS n_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY node)
        SELECT node[1] AS kind, count(*) AS n, sum(n_in)::BIGINT AS n_in, sum(n_out)::BIGINT AS n_out FROM d WHERE n_in = 0 OR n_out = 0 GROUP BY 1""",
    "incident_edges": f"WITH {_E} SELECT * FROM e WHERE src = 'n0' OR dst = 'n0'",
    "sources_sinks": "SELECT 'c' || c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "candidate_targets": "SELECT 'n' || n_nationkey AS node FROM nation WHERE n_regionkey <> 0",
    "pagerank": _pagerank_sql(),
    "pagerank_settled": _pagerank_sql(30),
    "causal_chain": "SELECT conv_id, string_agg(turn || ':' || role, '>' ORDER BY turn) AS chain, count(*)::INT AS n FROM conversations GROUP BY conv_id",
    "two_step_suppliers": """SELECT n_regionkey, l_partkey, count(*) AS n_suppliers, sum(n)::BIGINT AS n_lines FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL)
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""",
}
