"""Upserts, label joins, thresholds and schema merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import sinks, synthetic_xpaths, table, XPATHS_SQL


def _orders(spark, sf, status):
    return table(spark, sf, "orders").where(F.col("o_orderstatus") == status)


def upsert_prices(spark, sf):
    """Largest price per customer: finished orders, replaced by open ones where there are any."""
    side = lambda s: _orders(spark, sf, s).groupBy("o_custkey").agg(F.max("o_totalprice").alias("price"))
    return sinks.upsert(side("F"), side("O"), ["o_custkey"]).select("o_custkey", "price")


def first_last_seen(spark, sf):
    """First and last sighting of each user and type over two loads of events."""
    rows = table(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("first_seen"), F.col("event_id").alias("last_seen"))
    old, new = rows.where("first_seen % 2 = 0"), rows.where("first_seen % 2 = 1")
    return sinks.upsert_keeping_first(old, new, ["user_id", "event_type"], "first_seen", "last_seen")


def purge_sources(spark, sf):
    """Documents of sources that no labelled toxic document has."""
    bad = table(spark, sf, "documents").join(table(spark, sf, "labels").where("toxic = 1"), "doc_id", "left_semi").select("source").distinct()
    return sinks.remove(table(spark, sf, "documents").select("doc_id", "source"), bad, "source")


def changed_documents(spark, sf):
    """Documents whose length class differs from the one their label's quality would give."""
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") > 500, "long").otherwise("short").alias("digest"))
    old = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "long").otherwise("short").alias("digest"))
    return sinks.changed_only(old, docs, "doc_id", "digest")


def label_groups(spark, sf):
    """Labelled documents by quality and language: count, share of toxic ones, longest."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return rows.groupBy("quality", "lang").agg(F.count("*").alias("n"), F.round(F.avg("toxic"), 6).alias("toxic_share"), F.max_by("doc_id", F.struct("n_chars", "doc_id")).alias("longest"))


def unlabelled(spark, sf):
    """Documents without a label, by language."""
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("n"))


def label_spread(spark, sf):
    """Labels of every seventh customer, spread to all paths of the same nation; conflicts go to the smaller customer."""
    rows = synthetic_xpaths(spark, sf)
    seeds = rows.where("c_custkey % 7 = 0").groupBy("nation").agg(F.min("c_custkey").alias("label"))
    return rows.join(seeds, "nation", "left").select("c_custkey", "label")


def entropy_threshold(spark, sf):
    """Per type: the cut of values into two classes with the least squared deviations within them (Jenks)."""
    rows = table(spark, sf, "events").where("value is not null").select("event_type", F.round("value", 2).alias("v")).groupBy("event_type", "v").agg(F.count("*").alias("c"))
    w = Window.partitionBy("event_type").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("event_type")
    n, s = F.col("c"), F.col("c") * F.col("v")
    sums = rows.select("event_type", "v", F.sum(n).over(w).alias("n1"), F.sum(s).over(w).alias("s1"), F.sum(n).over(whole).alias("n"), F.sum(s).over(whole).alias("s"), F.sum(s * F.col("v")).over(whole).alias("q"))
    cost = F.col("q") - F.col("s1") ** 2 / F.col("n1") - (F.col("s") - F.col("s1")) ** 2 / (F.col("n") - F.col("n1"))
    cuts = sums.where("n1 < n").withColumn("cost", F.round(cost, 4))
    return cuts.groupBy("event_type").agg(F.min_by("v", F.struct("cost", "v")).alias("threshold"), F.round(F.min("cost"), 2).alias("cost"))


def pattern_schema(spark, sf):
    """Per type of part: its largest member, and up to three sampled names."""
    w = Window.partitionBy("p_type").orderBy("p_name", "p_partkey")
    rows = table(spark, sf, "part").withColumn("rn", F.row_number().over(w))
    names = F.array_sort(F.collect_list(F.when(F.col("rn") <= 3, F.col("p_name"))))
    return rows.groupBy("p_type").agg(F.max_by("p_partkey", F.struct("p_size", "p_partkey")).alias("representative"), F.array_join(names, "|").alias("samples"), F.count("*").alias("n"))


def schema_merge(spark, sf):
    """Brands of two halves of the parts: sizes united, the newer largest price, the first key kept."""
    half = lambda k: table(spark, sf, "part").where(F.col("p_partkey") % 2 == k).groupBy("p_brand").agg(F.collect_set("p_size").alias("sizes"), F.max("p_retailprice").alias("price"), F.min("p_partkey").alias("first"))
    a, b = half(0).alias("a"), half(1).alias("b")
    rows = a.join(b, "p_brand", "full")
    none = F.array().cast("array<int>")
    sizes = F.array_sort(F.array_union(F.coalesce("a.sizes", none), F.coalesce("b.sizes", none)))
    return rows.select("p_brand", F.array_join(F.transform(sizes, lambda x: x.cast("string")), ",").alias("sizes"), F.coalesce("b.price", "a.price").alias("price"), F.least("a.first", "b.first").alias("first"))


def keyword_fallback(spark, sf):
    """Parts by how many of four words their name, type and brand hold."""
    text = F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    hits = sum(F.when(text.contains(w), 1).otherwise(0) for w in ("steel", "large", "brand#1", "blue"))
    return table(spark, sf, "part").select("p_partkey", hits.alias("hits")).where("hits > 0")


def order_profile(spark, sf):
    """Revenue by nation, year and priority, with the share of the nation."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_nationkey", F.year("o_orderdate").alias("year"), "o_orderpriority").agg(F.sum("o_totalprice").alias("revenue"), F.count("*").alias("n"))
    total = F.sum("revenue").over(Window.partitionBy("c_nationkey"))
    return rows.select("c_nationkey", "year", "o_orderpriority", "n", F.round("revenue", 2).alias("revenue"), F.round(F.col("revenue") / total, 6).alias("share"))


QUERIES = {f.__name__: f for f in (upsert_prices, first_last_seen, purge_sources, changed_documents, label_groups, unlabelled, label_spread, entropy_threshold, pattern_schema, schema_merge, keyword_fallback, order_profile)}

SQL = {
    "upsert_prices": """WITH f AS (SELECT o_custkey, max(o_totalprice) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), o AS (SELECT o_custkey, max(o_totalprice) AS p FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL)
        SELECT o_custkey, coalesce(o.p, f.p) AS price FROM f FULL JOIN o USING (o_custkey)""",
    "first_last_seen": "SELECT user_id, event_type, min(event_id) AS first_seen, max(event_id) AS last_seen FROM events GROUP BY ALL",
    "purge_sources": "SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT source FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id))",
    "changed_documents": """SELECT doc_id, d.digest FROM (SELECT doc_id, CASE WHEN n_chars > 500 THEN 'long' ELSE 'short' END AS digest FROM documents) d
        LEFT JOIN (SELECT doc_id, CASE WHEN quality = 1 THEN 'long' ELSE 'short' END AS old FROM labels) USING (doc_id) WHERE old IS NULL OR old <> d.digest""",
    "label_groups": "SELECT quality, lang, count(*) AS n, round(avg(toxic), 6) AS toxic_share, arg_max(doc_id, (n_chars, doc_id)) AS longest FROM documents JOIN labels USING (doc_id) GROUP BY ALL",
    "unlabelled": "SELECT lang, count(*) AS n FROM documents ANTI JOIN labels USING (doc_id) GROUP BY lang",
    "label_spread": f"WITH {XPATHS_SQL}, s AS (SELECT nation, min(c_custkey) AS label FROM xp WHERE c_custkey % 7 = 0 GROUP BY nation) SELECT c_custkey, label FROM xp LEFT JOIN s USING (nation)",
    "entropy_threshold": """WITH r AS (SELECT event_type, round(value, 2) AS v, count(*) AS c FROM events WHERE value IS NOT NULL GROUP BY ALL),
        s AS (SELECT event_type, v, sum(c) OVER w AS n1, sum(c * v) OVER w AS s1, sum(c) OVER p AS n, sum(c * v) OVER p AS s, sum(c * v * v) OVER p AS q FROM r
              WINDOW w AS (PARTITION BY event_type ORDER BY v ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY event_type)),
        k AS (SELECT event_type, v, round(q - s1 ^ 2 / n1 - (s - s1) ^ 2 / (n - n1), 4) AS cost FROM s WHERE n1 < n)
        SELECT event_type, arg_min(v, (cost, v)) AS threshold, round(min(cost), 2) AS cost FROM k GROUP BY event_type""",
    "pattern_schema": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_name, p_partkey) AS rn FROM part)
        SELECT p_type, arg_max(p_partkey, (p_size, p_partkey)) AS representative, string_agg(p_name, '|' ORDER BY p_name) FILTER (rn <= 3) AS samples, count(*) AS n FROM r GROUP BY p_type""",
    "schema_merge": """SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_size)), ',') AS sizes, coalesce(max(p_retailprice) FILTER (p_partkey % 2 = 1), max(p_retailprice)) AS price, min(p_partkey) AS first FROM part GROUP BY p_brand""",
    "keyword_fallback": """SELECT * FROM (SELECT p_partkey, (SELECT count(*)::INT FROM (SELECT unnest(['steel', 'large', 'brand#1', 'blue']) AS w) WHERE contains(lower(concat_ws(' ', p_name, p_type, p_brand)), w)) AS hits FROM part) WHERE hits > 0""",
    "order_profile": """WITH r AS (SELECT c_nationkey, year(o_orderdate)::INT AS year, o_orderpriority, sum(o_totalprice) AS revenue, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
        SELECT c_nationkey, year, o_orderpriority, n, round(revenue, 2) AS revenue, round(revenue / sum(revenue) OVER (PARTITION BY c_nationkey), 6) AS share FROM r""",
}
