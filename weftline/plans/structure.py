"""Depths, components, personalised ranks, rollbacks, index changes and hashed vectors; structure that pages share."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, logs, pages, search
from ..sources import kept, shuffled_into, side, table
from .graphs import _E, _edges


def _nodes(spark, sf):
    return pages.nodes(table(spark, sf, "pages"))


def cross_page_matches(spark, sf):
    """Subtrees that several urls hold, with their first place in each."""
    return pages.cross_page_matches(_nodes(spark, sf))


def containment_dag(spark, sf):
    """Which repeating templates lie next inside which others, without edges that longer paths imply."""
    rows = pages.nodes(table(spark, sf, "pages"), hashes=("template",))
    return graph.reduced(kept(pages.containment(rows, least_height=0)))


def containment_depth(spark, sf):
    """Depth of repeating templates in the containment graph."""
    return graph.depths(kept(containment_dag(spark, sf)))


def _shortcuts(spark, sf):
    """The edges of regions, nations, customers and orders, and one from each region to its customers."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    short = c.join(n, c.c_nationkey == n.n_nationkey).select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("src"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("dst"))
    return _edges(spark, sf).union(short)


def dag_depth(spark, sf):
    """The depth of each node of a graph whose shortcuts are taken out first."""
    return graph.depths(kept(graph.reduced(_shortcuts(spark, sf))))


def component_of_seed(spark, sf):
    """Everything that is connected with each region's first nation."""
    seeds = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.min("n_nationkey").alias("k"))
    return graph.component_of(_edges(spark, sf), seeds.select(F.concat(F.lit("n"), F.col("k").cast("string")).alias("origin")))


def personalised_rank(spark, sf):
    """Personalised PageRank of regions, nations, customers and orders after twenty rounds, the prior one more than a node's edges."""
    edges = _edges(spark, sf)
    prior = graph.degrees(edges).select("node", (F.col("n_in") + F.col("n_out") + 1).cast("double").alias("weight"))
    return graph.personalised_pagerank(edges, prior).select("node", F.round("rank", 9).alias("rank"))


def _edits(spark, sf):
    """Events as edits of users: the type of the event replaces that of the user's event before it."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf, "events").select("event_id", "ts", "event_type", F.col("event_id").alias("edit_id"), F.col("user_id").alias("target"), before.alias("before"), F.col("event_type").alias("after"))


def rollback_range(spark, sf):
    """What users are at once the edits of some days are reversed; users that only began then are gone."""
    undone = (F.col("ts") >= F.lit("2024-01-10").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-20").cast("timestamp"))
    return logs.rolled_back(_edits(spark, sf), undone).where("state is not null")


def rollback_actor_since(spark, sf):
    """The same with all edits of one type since a day."""
    return logs.rolled_back(_edits(spark, sf), (F.col("event_type") == "purchase") & (F.col("ts") >= F.lit("2024-01-05").cast("timestamp")))


def index_upsert(spark, sf):
    """Document frequencies once one language's documents have new texts and one source's are removed."""
    docs = table(spark, sf, "documents")
    low, high = docs.agg(F.min("lang").alias("lang")), docs.agg(F.max("source").alias("source"))
    fresh = docs.join(F.broadcast(low), "lang").withColumn("text", F.concat_ws(" ", "source", "lang", "source"))
    out = docs.join(F.broadcast(high), "source").select(F.col("doc_id").alias("doc"))
    parts = search.tasks_for(docs, "text")
    old = search.term_counts(docs, "doc_id", "text", parts=parts).withColumnRenamed("doc_id", "doc")
    new = kept(search.term_counts(fresh, "doc_id", "text").withColumnRenamed("doc_id", "doc"))
    gone = out.union(fresh.select("doc_id")).distinct().withColumnRenamed("doc", "doc_id")
    changed = search.term_counts(docs.join(side(gone), "doc_id", "left_semi"), "doc_id", "text", parts=parts).withColumnRenamed("doc_id", "doc")
    with shuffled_into(spark, parts):  # frequencies of all postings and those that leave and arrive are summed at once
        return kept(search.document_frequencies_after(old.select("term", F.lit(1).alias("df")), changed, out, new))


def _weights(spark, sf):
    """TF-IDF weights of the single tokens of conversations, one document each turn's conversation."""
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.explode(T.tokens(F.col("text"))).alias("term"))
    tf = turns.groupBy("doc", "term").agg(F.count("*").alias("tf"))
    n = tf.select("doc").distinct().count()
    idf = tf.groupBy("term").agg(search.smoothed_idf(F.lit(float(n)), F.count("*")).alias("idf"))
    return tf.join(idf, "term").select("doc", "term", (F.col("tf") * F.col("idf")).alias("weight"))


def signed_hash_tfidf(spark, sf):
    """Each conversation as a signed-hash TF-IDF vector of 1,024 dimensions, in sparse rows."""
    return search.signed_hash_vectors(_weights(spark, sf)).select("doc", "dim", F.round("weight", 6).alias("weight"))


def projected_tfidf(spark, sf):
    """Each conversation's TF-IDF vector projected to sixteen numbers."""
    return search.random_projection(_weights(spark, sf)).select("doc", "dim", F.round("weight", 6).alias("weight"))


QUERIES = {f.__name__: f for f in (cross_page_matches, containment_dag, containment_depth, dag_depth, component_of_seed, personalised_rank, rollback_range, rollback_actor_since, index_upsert, signed_hash_tfidf, projected_tfidf)}

_LOG = """l AS (SELECT event_id, ts, event_type, user_id AS target, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)"""
_STATE = """SELECT target, CASE WHEN count(*) FILTER (undone) > 0 THEN (list(before ORDER BY event_id) FILTER (undone))[1] ELSE arg_max(event_type, event_id) END AS state, count(*) FILTER (undone) AS n_undone"""
_TERMS = r"""w AS (SELECT doc, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}_]+') AS w FROM x),
    f AS (SELECT DISTINCT doc, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w)"""
_WEIGHTS = r"""t AS (SELECT conv_id AS doc, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}_]+')) AS term FROM conversations), tf AS (SELECT doc, term, count(*) AS tf FROM t GROUP BY ALL),
    i AS (SELECT term, ln(((SELECT count(DISTINCT doc) FROM tf) + 1.0) / (count(*) + 1.0)) + 1 AS idf FROM tf GROUP BY term), wt AS (SELECT doc, term, ('0x' || md5(term)[:8])::BIGINT AS h, md5(term)[9] < '8' AS plus, tf * idf AS weight FROM tf JOIN i USING (term))"""


def _ranks_sql(rounds: int = 20) -> str:
    steps = ["p0 AS (SELECT node, prior, deg, prior AS rank FROM nd)"]
    for i in range(1, rounds + 1):
        steps.append(f"g{i} AS MATERIALIZED (SELECT dst, sum(rank / deg) AS gain FROM e JOIN p{i - 1} ON src = node GROUP BY dst), p{i} AS MATERIALIZED (SELECT node, prior, deg, 0.15 * prior + 0.85 * (coalesce(gain, 0) + prior * (SELECT coalesce(sum(rank), 0) FROM p{i - 1} WHERE deg IS NULL)) AS rank FROM nd LEFT JOIN g{i} ON node = dst)")
    return f"""WITH {_E}, dg AS (SELECT node, count(*) + 1.0::DOUBLE AS weight, nullif(sum(o), 0) AS deg FROM (SELECT src AS node, 1 AS o FROM e UNION ALL SELECT dst, 0 FROM e) GROUP BY node),
        nd AS MATERIALIZED (SELECT node, deg, weight / (SELECT sum(weight) FROM dg) AS prior FROM dg), {', '.join(steps)} SELECT node, round(rank, 9) AS rank FROM p{rounds}"""


SQL = {
    "dag_depth": f"""WITH RECURSIVE {_E}, s AS (SELECT * FROM e UNION SELECT 'r' || n_regionkey, 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
        p AS (SELECT src, dst, 1 AS len FROM s UNION SELECT p.src, s.dst, len + 1 FROM p JOIN s ON p.dst = s.src WHERE len < 10),
        k AS (SELECT src, dst FROM s WHERE (src, dst) NOT IN (SELECT (src, dst) FROM p WHERE len > 1)),
        r AS (SELECT DISTINCT src AS node, 0 AS depth FROM k WHERE src NOT IN (SELECT dst FROM k) UNION SELECT dst, depth + 1 FROM r JOIN k ON node = src) SELECT node, min(depth)::INT AS depth FROM r GROUP BY node""",
    "component_of_seed": f"""WITH RECURSIVE {_E}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT DISTINCT 'n' || min(n_nationkey) AS origin, 'n' || min(n_nationkey) AS node FROM nation GROUP BY n_regionkey
        UNION SELECT origin, dst FROM r JOIN b ON node = src) SELECT origin, node FROM r""",
    "personalised_rank": _ranks_sql(),
    "rollback_range": f"WITH {_LOG}, u AS (SELECT *, ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AS undone FROM l) SELECT * FROM ({_STATE} FROM u GROUP BY target) WHERE state IS NOT NULL",
    "rollback_actor_since": f"WITH {_LOG}, u AS (SELECT *, event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-05' AS undone FROM l) {_STATE} FROM u GROUP BY target",
    "index_upsert": f"""WITH x AS (SELECT doc_id AS doc, CASE WHEN lang = (SELECT min(lang) FROM documents) THEN concat_ws(' ', source, lang, source) ELSE text END AS text FROM documents
        WHERE source IS DISTINCT FROM (SELECT max(source) FROM documents)), {_TERMS} SELECT term, count(*) AS df FROM f GROUP BY term""",
    "signed_hash_tfidf": f"""WITH {_WEIGHTS}, b AS (SELECT doc, (h % 1024)::INT AS dim, sum(CASE WHEN plus THEN weight ELSE -weight END) AS weight FROM wt GROUP BY ALL)
        SELECT doc, dim, round(weight / coalesce(nullif(sqrt(sum(weight * weight) OVER (PARTITION BY doc)), 0), 1), 6) AS weight FROM b""",
    "projected_tfidf": f"""WITH {_WEIGHTS}, b AS (SELECT doc, dim::INT AS dim, sum(CASE WHEN (h >> dim) & 1 = 1 THEN weight ELSE -weight END) AS weight FROM wt, range(16) d(dim) GROUP BY ALL)
        SELECT doc, dim, round(weight / coalesce(nullif(sqrt(sum(weight * weight) OVER (PARTITION BY doc)), 0), 1), 6) AS weight FROM b""",
}
