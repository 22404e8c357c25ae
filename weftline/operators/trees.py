"""Trees given as paths. Ancestors are found by exploding each path into its prefixes, so every join is on equality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import xpath as X


def prefix_rows(paths: DataFrame, xp: str) -> DataFrame:
    """All columns, and one row per prefix of the path, itself included."""
    return paths.withColumn("prefix", F.explode(X.prefixes(F.col(xp))))


def prefix_counts(paths: DataFrame, xp: str) -> DataFrame:
    rows = prefix_rows(paths.select(xp), xp)
    own = F.sum((F.col("prefix") == F.col(xp)).cast("long"))
    return rows.groupBy("prefix").agg(own.alias("own"), F.count("*").alias("subtree"))


def collapsed_prefixes(paths: DataFrame, xp: str) -> DataFrame:
    rows = prefix_rows(paths.select(xp), xp)
    step = F.element_at(X.segments(X.relative(F.col(xp), F.col("prefix"))), 1)
    seen = rows.groupBy("prefix").agg(F.max(F.col("prefix") == F.col(xp)).alias("ends"), F.countDistinct(step).alias("forks"))
    return seen.where("ends or forks <> 1").select("prefix")


def prune_rollups(rows: DataFrame, xp: str, size: str, gate: int) -> DataFrame:
    """Drops rows of a size over ``gate`` that are a strict ancestor of another row."""
    above = prefix_rows(rows.select(xp), xp).where(F.col("prefix") != F.col(xp)).select(F.col("prefix").alias(xp)).distinct()
    marked = rows.join(above.withColumn("covers", F.lit(True)), xp, "left")
    return marked.where(~(F.coalesce("covers", F.lit(False)) & (F.col(size) > gate))).drop("covers")


def nearest_ancestor(paths: DataFrame, xp: str) -> DataFrame:
    """(path, parent): the longest strict prefix that is a path too, else null."""
    there = paths.select(F.col(xp).alias("prefix")).distinct()
    above = prefix_rows(paths.select(xp), xp).where(F.col("prefix") != F.col(xp)).join(there, "prefix")
    best = above.groupBy(xp).agg(F.max_by("prefix", F.length("prefix")).alias("parent"))
    return paths.select(xp).join(best, xp, "left")


def common_prefix(paths: DataFrame, group: str, xp: str) -> DataFrame:
    """(group, lca): the longest common prefix of several paths; of a single path its parent."""
    n = paths.groupBy(group).agg(F.countDistinct(xp).alias("n"))
    rows = prefix_rows(paths.select(group, xp).distinct(), xp).groupBy(group, "prefix").agg(F.count("*").alias("c"), F.first(X.parent(F.col(xp))).alias("parent"))
    full = rows.join(n, group).where("c = n")
    return full.groupBy(group).agg(F.max_by(F.when(F.col("n") == 1, F.col("parent")).otherwise(F.col("prefix")), F.length("prefix")).alias("lca"))


def within_budget(paths: DataFrame, xp: str, size: str, budget: int) -> DataFrame:
    """(prefix, total): subtrees of at most ``budget`` whose parent's subtree is larger."""
    total = prefix_rows(paths.select(xp, size), xp).groupBy("prefix").agg(F.sum(size).alias("total"))
    above = total.select(F.col("prefix").alias("up"), F.col("total").alias("above"))
    joined = total.join(above, X.parent(F.col("prefix")) == F.col("up"), "left")
    return joined.where((F.col("total") <= budget) & F.coalesce(F.col("above") > budget, F.lit(True))).select("prefix", "total")


def diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each key's state between two versions: added, removed, changed or stable."""
    o, n = old.select(*keys, F.col(value).alias("old"), F.lit(True).alias("o")), new.select(*keys, F.col(value).alias("new"), F.lit(True).alias("n"))
    state = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed").otherwise("stable")
    return o.join(n, keys, "full").withColumn("state", state)


def lineage(versions: DataFrame, key: str, version: str, order: str) -> DataFrame:
    """Each version's parent: the one before it."""
    return versions.withColumn("parent_version", F.lag(version).over(Window.partitionBy(key).orderBy(order, version)))
