"""Layouts in space as joins on grid cells."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import kept

_AXES = ("x", "y", "z")


def near_pairs(points: DataFrame, limit: float) -> DataFrame:
    """(a, b, dx, dy, dz, d2): pairs of points (id, x, y, z) nearer than ``limit``, a < b, d from b to a.

    Only points of neighbouring cells of a grid of that width meet, so all pairs are never formed."""
    cell = [F.floor(F.col(c) / F.lit(limit)).alias(f"c{c}") for c in _AXES]
    home = points.select(F.col("id").alias("a"), *[F.col(c).alias(f"a{c}") for c in _AXES], *cell)
    around = F.array(*[F.struct(*[F.lit(i).alias(f"s{c}") for c, i in zip(_AXES, steps)]) for steps in product((-1, 0, 1), repeat=3)])
    there = points.select(F.col("id").alias("b"), *[F.col(c).alias(f"b{c}") for c in _AXES], *cell, F.explode(around).alias("s"))
    there = there.select("b", *[f"b{c}" for c in _AXES], *[(F.col(f"c{c}") + F.col(f"s.s{c}")).alias(f"c{c}") for c in _AXES])
    both = home.join(there, [f"c{c}" for c in _AXES]).where("a < b").select("a", "b", *[(F.col(f"a{c}") - F.col(f"b{c}")).alias(f"d{c}") for c in _AXES])
    both = both.withColumn("d2", sum((F.col(f"d{c}") * F.col(f"d{c}") for c in _AXES), F.lit(0.0)))
    return both.where(F.col("d2") < F.lit(limit * limit))


def repelled(points: DataFrame, limit: float, sweeps: int) -> DataFrame:
    """(id, x, y, z): points pushed apart until no two are nearer than ``limit``, or for so many sweeps.

    In a sweep each pair that is too near asks each of its points to go half of what lacks along the line between them; a
    point goes the sum of what is asked. Points at the same place don't push each other."""
    points = points.select("id", *_AXES)
    for _ in range(sweeps):
        pairs = near_pairs(points, limit).where("d2 >= 1e-12")
        half = (F.lit(limit) - F.sqrt("d2")) / 2 / F.sqrt("d2")
        ways = F.array(*[F.struct(F.col(n).alias("id"), *[(half * F.col(f"d{c}") * sign).alias(f"p{c}") for c in _AXES]) for n, sign in (("a", 1), ("b", -1))])
        pushes = kept(pairs.select(F.explode(ways).alias("w")).groupBy("w.id").agg(*[F.sum(f"w.p{c}").alias(f"p{c}") for c in _AXES]))
        if pushes.isEmpty():
            break
        points = kept(points.join(pushes, "id", "left").select("id", *[(F.col(c) + F.coalesce(f"p{c}", F.lit(0.0))).alias(c) for c in _AXES]))
    return points
