"""Layout of vectors in space."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout
from ..sources import table

LIMIT, SWEEPS = 0.1, 3


def collision_layout(spark, sf):
    """Vectors by their first three components, pushed apart in three sweeps."""
    points = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")]).dropna()
    return layout.repelled(points, LIMIT, SWEEPS).select("id", *[F.round(c, 6).alias(c) for c in "xyz"])


def _sql() -> str:
    steps = ["p0 AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings WHERE embedding[1] + embedding[2] + embedding[3] IS NOT NULL)"]
    for i in range(SWEEPS):
        steps.append(f"""d{i} AS MATERIALIZED (SELECT a.id, a.x - b.x AS dx, a.y - b.y AS dy, a.z - b.z AS dz, sqrt(dx * dx + dy * dy + dz * dz) AS d FROM p{i} a JOIN p{i} b ON a.id <> b.id AND abs(a.x - b.x) < {LIMIT}),
            g{i} AS (SELECT id, sum(dx / d * ({LIMIT} - d) / 2) AS gx, sum(dy / d * ({LIMIT} - d) / 2) AS gy, sum(dz / d * ({LIMIT} - d) / 2) AS gz FROM d{i} WHERE d < {LIMIT} AND d * d >= 1e-12 GROUP BY id),
            p{i + 1} AS MATERIALIZED (SELECT p.id, x + coalesce(gx, 0) AS x, y + coalesce(gy, 0) AS y, z + coalesce(gz, 0) AS z FROM p{i} p LEFT JOIN g{i} g ON p.id = g.id)""")
    return f"WITH {', '.join(steps)} SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM p{SWEEPS}"


QUERIES = {"collision_layout": collision_layout}
SQL = {"collision_layout": _sql()}
