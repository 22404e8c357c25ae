"""Vector retrieval, pooling and layout over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import vectors
from ..operators.search import top_per
from ..sources import table


def _rows(spark, sf):
    return table(spark, sf, "embeddings")


def _focal(rows):
    """The vector of vec_id 0: one row."""
    return F.broadcast(rows.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1))


def _scored(spark, sf):
    rows = _rows(spark, sf)
    return rows.join(_focal(rows), F.lit(True)).where("vec_id <> 0").select("vec_id", "label", "embedding", F.round(V.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))


def vector_topk(spark, sf):
    """The 20 vectors nearest to vec_id 0."""
    return _scored(spark, sf).select("vec_id", "score").orderBy(F.desc("score"), "vec_id").limit(20)


def vector_gate(spark, sf):
    """Each vector's gated cosine with vec_id 0."""
    rows = _rows(spark, sf)
    return rows.join(_focal(rows), F.lit(True)).select("vec_id", F.round(V.cosine_gate(F.col("embedding"), F.col("q")), 6).alias("gate"))


def similar_to(spark, sf):
    """Up to 10 neighbours within a label, cosine 0.1 or more."""
    return vectors.neighbours(_rows(spark, sf), "label", "vec_id", "embedding", 10, 0.1)


def mean_pool_label(spark, sf):
    """Unit mean vector of each label."""
    return vectors.mean_vectors(_rows(spark, sf), "label", "embedding").select("label", "pos", F.round("value", 6).alias("value"))


def vector_pages(spark, sf):
    """Labels by the cosine of their mean vector with vec_id 0."""
    pages = vectors.as_arrays(vectors.mean_vectors(_rows(spark, sf), "label", "embedding"), "label")
    return pages.join(_focal(_rows(spark, sf)), F.lit(True)).select("label", F.round(V.cosine(F.col("vector"), F.col("q")), 6).alias("score"))


def vector_drilldown(spark, sf):
    """The three best labels, and the five best vectors of each."""
    best = vector_pages(spark, sf).orderBy(F.desc("score"), "label").limit(3).select("label")
    inside = _scored(spark, sf).join(F.broadcast(best), "label", "left_semi").select("label", "vec_id", "score")
    return top_per(inside, "label", 5, F.desc("score"), F.col("vec_id"))


def minmax_panel_rank(spark, sf):
    """Per label: a weight times the larger of two scores that are normalised within the label."""
    rows = _scored(spark, sf).withColumn("other", F.round(F.element_at("embedding", 1).cast("double"), 6)).withColumn("weight", 1 + F.col("vec_id") % 3)
    a, b = vectors.min_max("score", "label"), vectors.min_max("other", "label")
    return rows.select("vec_id", "label", F.round(F.col("weight") * F.greatest(a, b), 5).alias("panel"))


def triple_product(spark, sf):
    """Weight times two cosines; a weight of zero counts as one."""
    rows = _scored(spark, sf).withColumn("weight", F.col("vec_id") % 3)
    weight = F.when(F.col("weight") <= 0, 1).otherwise(F.col("weight"))
    return rows.select("vec_id", F.round(weight * F.col("score") * F.greatest(F.col("score"), F.lit(0.0)) + 0.0, 6).alias("rank_score"))


def sphere_fit(spark, sf):
    """Dimensions 1 to 3 around their mean, scaled by the largest distance from it in any of them; 4 to 6 as colours from 0 to 1."""
    d = [F.element_at("embedding", i).cast("double").alias(f"d{i}") for i in range(1, 7)]
    rows = _rows(spark, sf).select("vec_id", *d)
    mean = rows.agg(*[F.avg(f"d{i}").alias(f"m{i}") for i in (1, 2, 3)], *[F.min(f"d{i}").alias(f"lo{i}") for i in (4, 5, 6)], *[F.max(f"d{i}").alias(f"hi{i}") for i in (4, 5, 6)])
    rows = rows.join(F.broadcast(mean), F.lit(True))  # one row
    scale = rows.agg(F.max(F.greatest(*[F.abs(F.col(f"d{i}") - F.col(f"m{i}")) for i in (1, 2, 3)])).alias("scale"))
    rows = rows.join(F.broadcast(scale), F.lit(True))
    place = [F.round((F.col(f"d{i}") - F.col(f"m{i}")) / F.col("scale"), 6).alias(n) for i, n in ((1, "x"), (2, "y"), (3, "z"))]
    colour = [F.round(F.when(F.col(f"hi{i}") > F.col(f"lo{i}"), (F.col(f"d{i}") - F.col(f"lo{i}")) / (F.col(f"hi{i}") - F.col(f"lo{i}"))).otherwise(0.5), 6).alias(n) for i, n in ((4, "r"), (5, "g"), (6, "b"))]
    return rows.select("vec_id", *place, *colour)


def label_translation(spark, sf):
    """Centroid and bounding radius of each label in the first three dimensions."""
    d = [F.element_at("embedding", i).cast("double").alias(f"d{i}") for i in (1, 2, 3)]
    rows = _rows(spark, sf).select("label", *d)
    centre = rows.groupBy("label").agg(*[F.avg(f"d{i}").alias(f"c{i}") for i in (1, 2, 3)])
    far = F.sqrt(sum((F.col(f"d{i}") - F.col(f"c{i}")) ** 2 for i in (1, 2, 3)))
    out = rows.join(centre, "label").groupBy("label").agg(*[F.round(F.first(f"c{i}"), 6).alias(f"c{i}") for i in (1, 2, 3)], F.round(F.max(far), 6).alias("radius"))
    return out


def manifold_nearest(spark, sf):
    """The ten nearest points to vec_id 0 in the first three dimensions; similarity falls from 1 to 0 over them."""
    d = lambda c: [F.element_at(c, i).cast("double") for i in (1, 2, 3)]
    rows = _rows(spark, sf)
    rows = rows.join(_focal(rows), F.lit(True)).where("vec_id <> 0")
    far = F.round(F.sqrt(sum((a - b) ** 2 for a, b in zip(d("embedding"), d("q")))), 6)
    near = rows.select("vec_id", far.alias("distance")).orderBy("distance", "vec_id").limit(10)
    most = near.agg(F.max("distance").alias("most"))
    return near.join(F.broadcast(most), F.lit(True)).select("vec_id", "distance", F.round(F.when(F.col("most") > 0, 1 - F.col("distance") / F.col("most")).otherwise(1.0), 5).alias("similarity"))


QUERIES = {f.__name__: f for f in (vector_topk, vector_gate, similar_to, mean_pool_label, vector_pages, vector_drilldown, minmax_panel_rank, triple_product, sphere_fit, label_translation, manifold_nearest)}

_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT v AS q FROM e WHERE vec_id = 0)"
_S = f"{_E}, s AS (SELECT vec_id, label, v, round(list_cosine_similarity(v, q), 6) AS score FROM e, q WHERE vec_id <> 0)"
_M = "f AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM e), m AS (SELECT label, pos, avg(x) AS m FROM f GROUP BY ALL), z AS (SELECT label, sqrt(sum(m * m)) AS size FROM m GROUP BY label), u AS (SELECT label, pos, m / size AS value FROM m JOIN z USING (label))"
_P = "p AS (SELECT label, round(list_cosine_similarity(vector, q), 6) AS score FROM (SELECT label, list(value ORDER BY pos) AS vector FROM u GROUP BY label), q)"

SQL = {
    "vector_topk": f"WITH {_S} SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 20",
    "vector_gate": f"WITH {_E} SELECT vec_id, round(greatest(0.0, least(1.0, list_cosine_similarity(v, q))), 6) AS gate FROM e, q",
    "similar_to": f"""WITH {_E}, p AS (SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, other)::INT AS rank FROM p WHERE score >= 0.1) WHERE rank <= 10""",
    "mean_pool_label": f"WITH {_E}, {_M} SELECT label, pos::INT AS pos, round(value, 6) AS value FROM u",
    "vector_pages": f"WITH {_E}, {_M}, {_P} SELECT * FROM p",
    "vector_drilldown": f"""WITH {_S}, {_M}, {_P}, b AS (SELECT label FROM p ORDER BY score DESC, label LIMIT 3)
        SELECT * FROM (SELECT label, vec_id, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id)::INT AS rank FROM s SEMI JOIN b USING (label)) WHERE rank <= 5""",
    "minmax_panel_rank": f"""WITH {_S}, t AS (SELECT vec_id, label, score, round(v[1], 6) AS other, 1 + vec_id % 3 AS weight FROM s),
        w AS (SELECT *, min(score) OVER p AS a0, max(score) OVER p AS a1, min(other) OVER p AS b0, max(other) OVER p AS b1 FROM t WINDOW p AS (PARTITION BY label))
        SELECT vec_id, label, round(weight * greatest(CASE WHEN a1 > a0 THEN (score - a0) / (a1 - a0) ELSE 1 END, CASE WHEN b1 > b0 THEN (other - b0) / (b1 - b0) ELSE 1 END), 5) AS panel FROM w""",
    "triple_product": f"WITH {_S} SELECT vec_id, round((CASE WHEN vec_id % 3 <= 0 THEN 1 ELSE vec_id % 3 END) * score * greatest(score, 0.0) + 0.0, 6) AS rank_score FROM s",
    "sphere_fit": f"""WITH {_E}, m AS (SELECT avg(v[1]) m1, avg(v[2]) m2, avg(v[3]) m3, min(v[4]) l4, max(v[4]) h4, min(v[5]) l5, max(v[5]) h5, min(v[6]) l6, max(v[6]) h6 FROM e),
        s AS (SELECT max(greatest(abs(v[1] - m1), abs(v[2] - m2), abs(v[3] - m3))) AS s FROM e, m)
        SELECT vec_id, round((v[1] - m1) / s, 6) AS x, round((v[2] - m2) / s, 6) AS y, round((v[3] - m3) / s, 6) AS z,
               round((v[4] - l4) / (h4 - l4), 6) AS r, round((v[5] - l5) / (h5 - l5), 6) AS g, round((v[6] - l6) / (h6 - l6), 6) AS b FROM e, m, s""",
    "label_translation": f"""WITH {_E}, c AS (SELECT label, avg(v[1]) AS a, avg(v[2]) AS b, avg(v[3]) AS c FROM e GROUP BY label)
        SELECT label, round(any_value(a), 6) AS c1, round(any_value(b), 6) AS c2, round(any_value(c), 6) AS c3, round(max(sqrt((v[1] - a) ^ 2 + (v[2] - b) ^ 2 + (v[3] - c) ^ 2)), 6) AS radius FROM e JOIN c USING (label) GROUP BY label""",
    "manifold_nearest": f"""WITH {_E}, d AS (SELECT vec_id, round(sqrt((v[1] - q[1]) ^ 2 + (v[2] - q[2]) ^ 2 + (v[3] - q[3]) ^ 2), 6) AS distance FROM e, q WHERE vec_id <> 0 ORDER BY distance, vec_id LIMIT 10)
        SELECT vec_id, distance, round(1 - distance / max(distance) OVER (), 5) AS similarity FROM d""",
}
