"""Typed values, hashes, fingerprints of groups, order patterns and small graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, search
from ..sources import table


def typed_props(spark, sf):
    """Events' JSON properties as numbers, by user: count, sum, values that don't parse."""
    k = F.get_json_object("props", "$.k")
    rows = table(spark, sf, "events").select("user_id", k.alias("raw"), k.try_cast("long").alias("k"))
    return rows.groupBy("user_id").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.sum((F.col("raw").isNotNull() & F.col("k").isNull()).cast("long")).alias("bad"))


def name_hashes(spark, sf):
    """32-bit multiplicative hash of each customer's name (times 33, from 5381), and its place on a ring of 64."""
    signs = F.filter(F.split("c_name", ""), lambda c: c != "")
    h = F.aggregate(signs, F.lit(5381).cast("long"), lambda s, c: (s * 33 + F.ascii(c)) % 4294967296)
    return table(spark, sf, "customer").select("c_custkey", h.alias("hash"), (h % 64).alias("slot"))


def order_kinds(spark, sf):
    """Conversations by number of turns: Q if all have the roles in one order, P if only the bag of roles is the same, else M."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role")))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(ordered, lambda x: x.role).alias("seq"))
    rows = rows.select(F.size("seq").alias("n_turns"), F.array_join("seq", ">").alias("seq"), F.array_join(F.array_sort("seq"), ">").alias("bag"))
    groups = rows.groupBy("n_turns").agg(F.count("*").alias("n"), F.countDistinct("seq").alias("seqs"), F.countDistinct("bag").alias("bags"))
    return groups.withColumn("kind", F.when(F.col("seqs") == 1, "Q").when(F.col("bags") == 1, "P").otherwise("M"))


def cluster_features(spark, sf):
    """Per language: the five tokens with the largest share of its documents times idf, of those in at least a fifth of them."""
    docs = table(spark, sf, "documents")
    rows = search.token_sets(docs.withColumn("k", F.struct("lang", "doc_id")), "k", "text").select("k.lang", "token")
    n, total = docs.groupBy("lang").agg(F.count("*").alias("n")), docs.count()
    df = rows.groupBy("token").agg(F.count("*").alias("df"))
    local = rows.groupBy("lang", "token").agg(F.count("*").alias("c")).join(n, "lang").where("c >= 0.2 * n").join(df, "token")
    score = F.round(F.col("c") / F.col("n") * search.smoothed_idf(F.lit(float(total)), F.col("df")), 6)
    return search.top_per(local.select("lang", "token", score.alias("score")), "lang", 5, F.desc("score"), F.col("token"))


def group_fingerprints(spark, sf):
    """Sources by the tokens that at least nine tenths of their documents have; sources with equal sets are one group."""
    docs = table(spark, sf, "documents")
    rows = search.token_sets(docs.withColumn("k", F.struct("source", "doc_id")), "k", "text").select("k.source", "token")
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    common = rows.groupBy("source", "token").agg(F.count("*").alias("c")).join(n, "source").where("c >= 0.9 * n")
    prints = n.select("source").join(common.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("token")), " ").alias("f")), "source", "left")
    return prints.groupBy(F.coalesce("f", F.lit("")).alias("fingerprint")).agg(F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources"))


def perimeter_rescale(spark, sf):
    """The first three dimensions on the sphere of radius 2."""
    d = [F.element_at("embedding", i).cast("double") for i in (1, 2, 3)]
    size = F.sqrt(sum(x * x for x in d))
    return table(spark, sf, "embeddings").select("vec_id", *[F.round(F.when(size > 0, 2 * x / size).otherwise(0.0), 6).alias(n) for x, n in zip(d, "xyz")])


def transitions(spark, sf):
    """Moves between event types of a user, with counts and share of the moves from the first."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    moves = table(spark, sf, "events").withColumn("next", F.lead("event_type").over(w)).where("next is not null")
    counts = moves.groupBy("event_type", "next").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("event_type")), 6))


def simple_cycles(spark, sf):
    """Circuits of two or three event types in the moves of users, each once from its smallest type, with the rarest move's count."""
    e = transitions(spark, sf).where("event_type <> next").select(F.col("event_type").alias("a"), F.col("next").alias("b"), "n")
    second, third = e.toDF("b", "c", "n2"), e.toDF("c", "d", "n3")
    two = e.join(second, "b").where("c = a and a < b").select(F.concat_ws(">", "a", "b").alias("cycle"), F.least("n", "n2").alias("least"))
    three = e.join(second, "b").join(third, "c").where("d = a and a < b and a < c and b <> c").select(F.concat_ws(">", "a", "b", "c").alias("cycle"), F.least("n", "n2", "n3").alias("least"))
    return two.union(three)


def elementary_circuits(spark, sf):
    """All circuits of event types in the moves of users, of any length and loops too, as in simple_cycles."""
    e = transitions(spark, sf).where("event_type is not null").select(F.col("event_type").alias("src"), F.col("next").alias("dst"), "n")
    return graph.circuits(e).select(F.array_join("path", ">").alias("cycle"), "least")


def transitive_reduction(spark, sf):
    """Order of part sizes within a brand: of all pairs a < b, those that no size lies between."""
    sizes = table(spark, sf, "part").select("p_brand", "p_size").distinct()
    e = sizes.select("p_brand", F.col("p_size").alias("a")).join(sizes.select("p_brand", F.col("p_size").alias("b")), "p_brand").where("a < b")
    longer = e.join(e.select("p_brand", F.col("a").alias("b"), F.col("b").alias("c")), ["p_brand", "b"]).select("p_brand", "a", F.col("c").alias("b")).distinct()
    return e.join(longer, ["p_brand", "a", "b"], "left_anti")


def numbers_in_text(spark, sf):
    """Numbers with an optional K, M or B in documents: how many, and the longest."""
    found = F.regexp_extract_all("text", F.lit(r"([0-9][0-9,.]*[KMB]?)"))
    rows = table(spark, sf, "documents").select("doc_id", found.alias("f")).where(F.size("f") > 0)
    return rows.select("doc_id", F.size("f").alias("n"), F.array_max(F.transform("f", lambda x: F.length(x))).alias("longest"))


QUERIES = {f.__name__: f for f in (typed_props, name_hashes, order_kinds, cluster_features, group_fingerprints, perimeter_rescale, transitions, simple_cycles, elementary_circuits, transitive_reduction, numbers_in_text)}

_T = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}_]+')"
_MOVES = """m AS (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events), c AS (SELECT event_type, next, count(*) AS n FROM m WHERE next IS NOT NULL GROUP BY ALL)"""

SQL = {
    "typed_props": "SELECT user_id, count(k) AS n, sum(k)::BIGINT AS total, count(*) FILTER (raw IS NOT NULL AND k IS NULL) AS bad FROM (SELECT user_id, props->>'$.k' AS raw, try_cast(props->>'$.k' AS BIGINT) AS k FROM events) GROUP BY user_id",
    "name_hashes": "SELECT c_custkey, h AS hash, h % 64 AS slot FROM (SELECT c_custkey, list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT)), lambda s, c: (s * 33 + c) % 4294967296) AS h FROM customer)",
    "order_kinds": """WITH s AS (SELECT conv_id, count(*)::INT AS n_turns, string_agg(role, '>' ORDER BY turn, role) AS seq, string_agg(role, '>' ORDER BY role) AS bag FROM conversations GROUP BY conv_id)
        SELECT n_turns, count(*) AS n, count(DISTINCT seq) AS seqs, count(DISTINCT bag) AS bags, CASE WHEN count(DISTINCT seq) = 1 THEN 'Q' WHEN count(DISTINCT bag) = 1 THEN 'P' ELSE 'M' END AS kind FROM s GROUP BY n_turns""",
    "cluster_features": f"""WITH r AS (SELECT DISTINCT lang, doc_id, unnest({_T}) AS token FROM documents), n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), d AS (SELECT token, count(*) AS df FROM r GROUP BY token),
        c AS (SELECT lang, token, count(*) AS c FROM r GROUP BY ALL), s AS (SELECT lang, token, round(c / n * (ln(((SELECT count(*) FROM documents) + 1.0) / (df + 1.0)) + 1.0), 6) AS score FROM c JOIN n USING (lang) JOIN d USING (token) WHERE c >= 0.2 * n)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, token)::INT AS rank FROM s) WHERE rank <= 5""",
    "group_fingerprints": f"""WITH r AS (SELECT DISTINCT source, doc_id, unnest({_T}) AS token FROM documents), n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
        c AS (SELECT source, token, count(*) AS c FROM r GROUP BY ALL), f AS (SELECT source, string_agg(token, ' ' ORDER BY token) AS f FROM c JOIN n USING (source) WHERE c >= 0.9 * n GROUP BY source)
        SELECT coalesce(f, '') AS fingerprint, string_agg(source, ',' ORDER BY source) AS sources FROM n LEFT JOIN f USING (source) GROUP BY 1""",
    "perimeter_rescale": "SELECT vec_id, round(CASE WHEN s > 0 THEN 2 * a / s ELSE 0 END, 6) AS x, round(CASE WHEN s > 0 THEN 2 * b / s ELSE 0 END, 6) AS y, round(CASE WHEN s > 0 THEN 2 * c / s ELSE 0 END, 6) AS z FROM (SELECT *, sqrt(a * a + b * b + c * c) AS s FROM (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings))",
    "transitions": f"WITH {_MOVES} SELECT event_type, next, n, round(n / sum(n) OVER (PARTITION BY event_type), 6) AS share FROM c",
    "simple_cycles": f"""WITH {_MOVES}, e AS (SELECT event_type AS a, next AS b, n FROM c WHERE event_type <> next)
        SELECT x.a || '>' || x.b AS cycle, least(x.n, y.n) AS least FROM e x JOIN e y ON x.b = y.a AND y.b = x.a WHERE x.a < x.b
        UNION ALL SELECT x.a || '>' || x.b || '>' || y.b, least(x.n, y.n, z.n) FROM e x JOIN e y ON x.b = y.a JOIN e z ON y.b = z.a AND z.b = x.a WHERE x.a < x.b AND x.a < y.b AND x.b <> y.b""",
    "elementary_circuits": f"""WITH RECURSIVE {_MOVES}, e AS (SELECT event_type AS a, next AS b, n FROM c WHERE event_type IS NOT NULL),
        p AS (SELECT a AS start, b AS node, [a, b] AS path, n AS lo FROM e WHERE a < b
              UNION ALL SELECT start, e.b, list_append(path, e.b), least(lo, e.n) FROM p JOIN e ON node = e.a WHERE e.b > start AND NOT list_contains(path, e.b))
        SELECT a AS cycle, n AS least FROM e WHERE a = b UNION ALL SELECT array_to_string(path, '>'), least(lo, e.n) FROM p JOIN e ON node = e.a AND e.b = start""",
    "transitive_reduction": "SELECT p_brand, a, b FROM (SELECT p_brand, p_size AS a, lead(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) AS b FROM (SELECT DISTINCT p_brand, p_size FROM part)) WHERE b IS NOT NULL",
    "numbers_in_text": "SELECT doc_id, len(f)::INT AS n, list_max(list_transform(f, lambda x: length(x)))::INT AS longest FROM (SELECT doc_id, regexp_extract_all(text, '[0-9][0-9,.]*[KMB]?') AS f FROM documents) WHERE len(f) > 0",
}
