"""Graphs as edge tables (src, dst): reachability, degrees, components, PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(origin, node, distance): nodes within ``depth`` steps of each seed (origin), nearest distance, the seed at 0.

    Each step joins only the frontier, and nodes that were seen don't come back, so cycles end."""
    seen = seeds.select(F.col("origin"), F.col("origin").alias("node"), F.lit(0).alias("distance"))
    frontier = seen
    for step in range(1, depth + 1):
        more = frontier.join(edges, frontier.node == edges.src).select("origin", F.col("dst").alias("node")).distinct()
        frontier = more.join(seen, ["origin", "node"], "left_anti").withColumn("distance", F.lit(step))
        if _checkpointed(edges):  # it is read twice: by the next step and by the result
            frontier = frontier.checkpoint()
        seen = seen.union(frontier)
    return seen


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out)."""
    flat = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    return flat.groupBy("x.node").agg(F.sum("x.i").alias("n_in"), F.sum("x.o").alias("n_out"))


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 30, n: int | None = None, checkpoint_every: int = 5) -> DataFrame:
    """(node, rank) after fixed rounds from a uniform start. Parallel edges count; mass of nodes without out-edges is dropped."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    n = n or nodes.count()
    out = edges.groupBy("src").agg(F.count("*").alias("deg"))
    links = edges.join(out, "src")
    if _checkpointed(edges):  # every round reads both
        nodes, links = nodes.checkpoint(), links.checkpoint()
    rank = nodes.withColumn("rank", F.lit(1.0 / n))
    for i in range(1, rounds + 1):
        gain = links.join(rank, links.src == rank.node).groupBy("dst").agg(F.sum(F.col("rank") / F.col("deg")).alias("gain"))
        rank = nodes.join(gain, nodes.node == gain.dst, "left").select("node", (F.lit((1 - damping) / n) + damping * F.coalesce("gain", F.lit(0.0))).alias("rank"))
        if i % checkpoint_every == 0 and i < rounds and _checkpointed(edges):
            rank = rank.checkpoint()
    return rank


def personalised_pagerank(edges: DataFrame, prior: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """(node, rank) after fixed rounds, started from and drawn back to ``prior`` (node, weight), which is scaled to one.

    Repeated edges count once, edges from or to nodes without a prior lose their share, and the mass of nodes without
    out-edges goes back by the prior. An empty prior gives no rows. Nodes without out-edges give nothing but their common mass, one
    number, so that only the last round looks at each of them."""
    total = prior.agg(F.sum("weight")).first()[0]
    nodes = prior.select("node", (F.col("weight") / F.lit(float(total or 1))).alias("prior"))
    links = edges.select("src", "dst").distinct()
    out = links.groupBy("src").agg(F.count("*").alias("deg"))
    nodes = nodes.join(out.withColumnRenamed("src", "node"), "node", "left")
    if _checkpointed(edges):
        nodes, links = nodes.checkpoint(), links.checkpoint()
    if rounds < 1:
        return nodes.select("node", F.col("prior").alias("rank"))
    ends = links.join(nodes.select(F.col("node").alias("dst"), F.col("deg").isNull().alias("idle")), "dst")
    to_idle = ends.where("idle").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("to_idle"))
    inner, within = nodes.where("deg is not null").join(to_idle, "node", "left"), ends.where("not idle").select("src", "dst")
    if _checkpointed(edges):
        inner, within = inner.checkpoint(), within.checkpoint()
    idle = mass = nodes.where("deg is null").agg(F.sum("prior")).first()[0] or 0.0
    gained = lambda over, rank: over.join(rank, over.src == rank.node).groupBy("dst").agg(F.sum(F.col("rank") / F.col("deg")).alias("gain"))
    drawn = lambda: (1 - damping) * F.col("prior") + damping * (F.coalesce("gain", F.lit(0.0)) + F.lit(idle) * F.col("prior"))
    rank = inner.withColumn("rank", F.col("prior"))
    for _ in range(rounds - 1):
        caught = rank.agg(F.sum(F.col("rank") * F.col("to_idle") / F.col("deg"))).first()[0] or 0.0
        gain = gained(within, rank)
        rank = inner.join(gain, inner.node == gain.dst, "left").select("node", "prior", "deg", "to_idle", drawn().alias("rank"))
        if _checkpointed(edges):
            rank = rank.checkpoint()
        idle = (1 - damping) * mass + damping * (caught + idle * mass)
    gain = gained(links, rank)
    return nodes.join(gain, nodes.node == gain.dst, "left").select("node", drawn().alias("rank"))


def component_of(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(origin, node): everything connected with each seed (origin), directions ignored, the seed included.

    Each round joins the frontier alone and is written, so the work is in proportion to the component's edges."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = frontier = seeds.select("origin", F.col("origin").alias("node"))
    while not frontier.isEmpty():
        more = frontier.join(both, frontier.node == both.src).select("origin", F.col("dst").alias("node")).distinct()
        frontier = more.join(seen, ["origin", "node"], "left_anti")
        if _checkpointed(edges):
            frontier = frontier.checkpoint()
        seen = seen.union(frontier)
    return seen


def components_of(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node connected with each node of an edge, directions ignored.

    Each round every node takes the smallest name among its own, its neighbours' and that of the node it is named after,
    so names travel twice as far each time."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    names = both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("node")).alias("component"))
    while True:
        if _checkpointed(edges):
            names = names.checkpoint()
        seen = both.join(names, both.dst == names.node).groupBy(F.col("src").alias("node")).agg(F.min("component").alias("seen"))
        jump = names.select(F.col("node").alias("component"), F.col("component").alias("far"))
        new = names.join(seen, "node").join(jump, "component").select("node", F.least("component", "seen", "far").alias("component"))
        if _checkpointed(edges):
            new = new.checkpoint()
        if new.join(names, ["node", "component"], "left_anti").isEmpty():
            return new
        names = new


def reduced(edges: DataFrame) -> DataFrame:
    """(src, dst): distinct edges without those that a longer path, of any length, makes needless.

    Each round looks one edge further from the pairs that the round before found first, so the rounds are as many as the
    longest path has edges, and cycles end."""
    links = edges.select("src", "dst").distinct()
    path = links.withColumnsRenamed({"src": "origin", "dst": "node"})
    far = None
    while True:
        path = path.join(links, path.node == links.src).select("origin", F.col("dst").alias("node")).distinct()
        if far is not None:
            path = path.join(far, ["origin", "node"], "left_anti")
        if _checkpointed(edges):
            path, links = path.checkpoint(), links.checkpoint()
        if path.isEmpty():
            return links
        far = path if far is None else far.union(path)
        links = links.join(path.withColumnsRenamed({"origin": "src", "node": "dst"}), ["src", "dst"], "left_anti")
        path = path.where("origin <> node")


def depths(edges: DataFrame) -> DataFrame:
    """(node, depth): 0 for nodes without in-edges, else one more than the smallest depth of the nodes before it.

    That is the fewest edges from such a node; nodes that none reaches, as on and below closed cycles, have depth 0."""
    links = edges.select("src", "dst").distinct()
    nodes = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    inner = links.select(F.col("dst").alias("node")).distinct()
    level = nodes.join(inner, "node", "left_anti").withColumn("depth", F.lit(0))
    held, i = level, 0
    while not level.isEmpty():
        i += 1
        more = level.join(links, level.node == links.src).select(F.col("dst").alias("node")).distinct()
        level = more.join(held, "node", "left_anti").withColumn("depth", F.lit(i))
        if _checkpointed(edges):
            level = level.checkpoint()
        held = held.union(level)
    return nodes.join(held, "node", "left").select("node", F.coalesce("depth", F.lit(0)).alias("depth"))


def circuits(edges: DataFrame) -> DataFrame:
    """(path, least): every elementary circuit of (src, dst, n) once, from its smallest node, with the least n on it; loops are circuits of one node.

    Paths grow by a join until none is left. Edges are distinct; their nodes are not null."""
    e = edges.select("src", "dst", "n")
    found = e.where("src = dst").select(F.array("src").alias("path"), F.col("n").alias("least"))
    paths = e.where("src < dst").select(F.col("src").alias("start"), F.col("dst").alias("node"), F.array("src", "dst").alias("path"), F.col("n").alias("least"))
    while True:
        if _checkpointed(edges):
            paths = paths.checkpoint()
        if paths.isEmpty():
            return found
        more = paths.join(e, paths.node == e.src).withColumn("least", F.least("least", "n"))
        found = found.union(more.where("dst = start").select("path", "least"))
        paths = more.where("dst > start and not array_contains(path, dst)").select("start", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"), "least")


def _checkpointed(df: DataFrame) -> bool:
    return df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined()
