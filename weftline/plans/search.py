"""Retrieval and deduplication over documents, benchmark texts and part names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup, search
from ..sources import kept, shuffled_into, table

TERMS_SQL = r"""tok AS (SELECT doc_id, source, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}_]+') AS w FROM documents),
    trm AS (SELECT doc_id, source, unnest(w) AS term FROM tok
            UNION ALL SELECT doc_id, source, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM tok),
    tf AS (SELECT doc_id, source, term, count(*) AS tf FROM trm GROUP BY ALL),
    st AS (SELECT term, count(*) AS df, ln(((SELECT count(*) FROM documents) + 1.0) / (count(*) + 1.0)) + 1.0 AS idf FROM tf GROUP BY term)"""
QUERY_SQL = r"""bt AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}_]+') AS w FROM benchmark),
    bq AS (SELECT item_id, unnest(w) AS term FROM bt
           UNION ALL SELECT item_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM bt),
    q AS (SELECT item_id, term, count(*) AS qtf, any_value(idf) AS qidf FROM bq JOIN st USING (term) GROUP BY item_id, term),
    qn AS (SELECT item_id, sqrt(greatest(sum(qtf * qidf * qtf * qidf), 1e-12)) AS qnorm FROM q GROUP BY item_id),
    dn AS (SELECT doc_id, sqrt(greatest(sum(tf * idf * tf * idf), 1e-12)) AS norm FROM tf JOIN st USING (term) GROUP BY doc_id),
    sc AS (SELECT item_id, doc_id, source, sum(tf * qtf * idf * qidf) / (any_value(norm) * any_value(qnorm)) AS score
           FROM tf JOIN st USING (term) JOIN q USING (term) JOIN dn USING (doc_id) JOIN qn USING (item_id) GROUP BY ALL)"""


def _docs(spark, sf):
    return table(spark, sf, "documents")


def term_df_idf(spark, sf):
    """Documents with each term, and its smoothed inverse document frequency."""
    docs = _docs(spark, sf)
    parts = search.tasks_for(docs, "text")
    with shuffled_into(spark, parts):
        stats = kept(search.term_stats(search.term_counts(docs, "doc_id", "text", parts=parts), docs.count()))
    return stats.select("term", "df", F.round("idf", 6).alias("idf"))


def doc_l2_norm(spark, sf):
    norms = search.build_index(_docs(spark, sf), "doc_id", "text").norms
    return norms.select(F.col("doc").alias("doc_id"), F.round("norm", 6).alias("norm"))


def term_frequency(spark, sf):
    """Per document: terms in all, distinct ones, and the largest count."""
    tf = search.term_counts(_docs(spark, sf), "doc_id", "text")
    return tf.groupBy("doc_id").agg(F.sum("tf").alias("n_terms"), F.count("*").alias("n_distinct"), F.max("tf").alias("max_tf"))


def sublinear_norm(spark, sf):
    """Norm of each document's vector of (1 + ln tf) idf."""
    index = search.build_index(_docs(spark, sf), "doc_id", "text")
    w = (1 + F.log("tf")) * F.col("idf")
    return index.postings.groupBy(F.col("doc").alias("doc_id")).agg(F.round(F.sqrt(F.sum(w * w)), 6).alias("norm"))


def _scores(spark, sf):
    index = search.build_index(_docs(spark, sf), "doc_id", "text")
    return search.search(index, table(spark, sf, "benchmark"), "item_id", "text").select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


def tfidf_search(spark, sf):
    """The ten best documents of each benchmark text."""
    return search.top_per(_scores(spark, sf), "item_id", 10, F.desc("score"), F.col("doc_id"))


def tfidf_pages(spark, sf):
    """The three best sources of each benchmark text, by the mean of their five best documents."""
    scored = _scores(spark, sf).join(_docs(spark, sf).select("doc_id", "source"), "doc_id")
    best = scored.withColumn("page", F.struct("item_id", "source"))
    best = search.top_per(best, "page", 5, F.desc("score"), F.col("doc_id"), rank="rn")
    pages = best.groupBy("item_id", "source").agg(F.round(F.avg("score"), 7).alias("score"), F.count("*").alias("n_docs"))
    return search.top_per(pages, "item_id", 3, F.desc("score"), F.col("source"))


def _sets(spark, sf):
    left = search.token_sets(table(spark, sf, "benchmark"), "item_id", "text").select(F.col("item_id").alias("l"), "token")
    right = search.token_sets(_docs(spark, sf), "doc_id", "text").select(F.col("doc_id").alias("r"), "token")
    return left, right


def jaccard_pairs(spark, sf):
    """Benchmark texts and documents with a Jaccard similarity of token sets of at least 0.2."""
    pairs = search.jaccard(*_sets(spark, sf))
    return pairs.where("score >= 0.2").select(F.col("l").alias("item_id"), F.col("r").alias("doc_id"), F.round("score", 6).alias("score"))


def idf_jaccard(spark, sf):
    """The same with tokens weighted by ln(1 + N / df)."""
    left, right = _sets(spark, sf)
    n = _docs(spark, sf).count()
    weight = kept(right.groupBy("token").agg(F.log(1 + F.lit(float(n)) / F.count("*")).alias("w")))
    pairs = search.jaccard(left, right, weight)
    return pairs.where("score >= 0.15").select(F.col("l").alias("item_id"), F.col("r").alias("doc_id"), F.round("score", 6).alias("score"))


def content_hash_merge(spark, sf):
    """One row per text, with its first document and all sources."""
    merged = dedup.merge_by_content(_docs(spark, sf), "doc_id", "source", "text")
    return merged.select("hash", "doc_id", F.array_join("urls", ",").alias("urls"), "n")


def content_collisions(spark, sf):
    """Texts that several documents hold."""
    return content_hash_merge(spark, sf).where("n > 1").select("hash", "n")


def tokenbag_dedup(spark, sf):
    """Documents whose set of tokens and pairs no earlier document has."""
    return dedup.first_per_bag(_docs(spark, sf), "doc_id", "text").select("doc_id")


def cross_url_collapse(spark, sf):
    """Per language and text: the shallowest source, and the largest size."""
    rows = _docs(spark, sf).withColumn("hash", T.short_sha1(F.col("text")))
    return dedup.collapse_across_urls(rows, ["lang", "hash"], "source", "doc_id", "n_chars").select("lang", "hash", "source", "doc_id", F.col("best").alias("score"))


def token_subsumption(spark, sf):
    """Benchmark texts whose token set another one contains."""
    return dedup.subsumed(table(spark, sf, "benchmark"), "item_id", "text").select(F.col("k").alias("item_id"))


def text_search(spark, sf):
    """Documents that hold "and the": exact 1.0, in any case 0.8; 0.1 more for long ones; with a snippet."""
    phrase, text = "and the", F.col("text")
    exact, loose = F.locate(phrase, text), F.locate(phrase, F.lower(text))
    score = F.least(F.lit(1.0), F.when(exact > 0, 1.0).otherwise(0.8) + F.when(F.col("n_chars") > 1000, 0.1).otherwise(0.0))
    at = F.when(exact > 0, exact).otherwise(loose)
    return _docs(spark, sf).where(loose > 0).select("doc_id", F.round(score, 2).alias("score"), T.snippet(text, at, F.lit(len(phrase))).alias("snippet"))


def completions(spark, sf):
    """Names of parts for a typed prefix: those that start with it, then those that contain it; shortest first, twelve at most."""
    name = F.lower("p_name")
    rank = F.when(name.startswith("pa"), 0).when(name.contains("pa"), 1)
    names = table(spark, sf, "part").select("p_name").distinct().withColumn("tier", rank).where("tier is not null")
    return names.orderBy("tier", F.length("p_name"), "p_name").limit(12).select("p_name", "tier")


def text_profile(spark, sf):
    """Per document: normalised length, slug of its first 40 signs, distinct ASCII tokens, words with spaced digits."""
    text = F.col("text")
    return _docs(spark, sf).select("doc_id", F.length(T.normalised(text)).alias("n_normal"), T.slug(F.substring(text, 1, 40)).alias("slug"), F.size(T.lexical_tokens(text)).alias("n_lexical"), F.length(T.letter_digit_spaced(text)).alias("n_spaced"))


def token_entropy(spark, sf):
    """Shannon entropy of the signs of each distinct ASCII token."""
    token = _docs(spark, sf).select(F.explode(T.lexical_tokens(F.col("text"))).alias("token")).distinct()
    signs = token.select("token", F.explode(F.split("token", "")).alias("c")).where("c <> ''").groupBy("token", "c").agg(F.count("*").alias("n"))
    p = F.col("n") / F.length("token")
    return signs.groupBy("token").agg((F.round(-F.sum(p * F.log2(p)), 6) + 0.0).alias("entropy"))


def discriminative_tokens(spark, sf):
    """Per source: the five tokens that most of its documents have and few others."""
    rows = search.token_sets(_docs(spark, sf).withColumn("k", F.struct("source", "doc_id")), "k", "text").select("k.source", "token")
    n = _docs(spark, sf).groupBy("source").agg(F.count("*").alias("n"))
    local = rows.groupBy("source", "token").agg(F.count("*").alias("c"))
    total = rows.groupBy("token").agg(F.count("*").alias("g"))
    all_docs = _docs(spark, sf).count()
    scored = local.join(n, "source").join(total, "token").where("c >= 2")
    scored = scored.select("source", "token", F.round(F.col("c") / F.col("n") - F.col("g") / F.lit(float(all_docs)), 6).alias("lift"))
    return search.top_per(scored, "source", 5, F.desc("lift"), F.col("token"))


QUERIES = {f.__name__: f for f in (term_df_idf, doc_l2_norm, term_frequency, sublinear_norm, tfidf_search, tfidf_pages, jaccard_pairs, idf_jaccard, content_hash_merge, content_collisions, tokenbag_dedup, cross_url_collapse, token_subsumption, text_search, completions, text_profile, token_entropy, discriminative_tokens)}

_SETS = r"""l AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}_]+')) AS token FROM benchmark),
    r AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}_]+')) AS token FROM documents)"""

SQL = {
    "term_df_idf": f"WITH {TERMS_SQL} SELECT term, df, round(idf, 6) AS idf FROM st",
    "doc_l2_norm": f"WITH {TERMS_SQL} SELECT doc_id, round(sqrt(greatest(sum(tf * idf * tf * idf), 1e-12)), 6) AS norm FROM tf JOIN st USING (term) GROUP BY doc_id",
    "term_frequency": f"WITH {TERMS_SQL} SELECT doc_id, sum(tf)::BIGINT AS n_terms, count(*) AS n_distinct, max(tf) AS max_tf FROM tf GROUP BY doc_id",
    "sublinear_norm": f"WITH {TERMS_SQL} SELECT doc_id, round(sqrt(sum(((1 + ln(tf)) * idf) ^ 2)), 6) AS norm FROM tf JOIN st USING (term) GROUP BY doc_id",
    "tfidf_search": f"""WITH {TERMS_SQL}, {QUERY_SQL}, s AS (SELECT item_id, doc_id, round(score, 6) AS score FROM sc)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s) WHERE rank <= 10""",
    "tfidf_pages": f"""WITH {TERMS_SQL}, {QUERY_SQL}, s AS (SELECT item_id, doc_id, source, round(score, 6) AS score FROM sc),
        b AS (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) AS rn FROM s),
        p AS (SELECT item_id, source, round(avg(score), 7) AS score, count(*) AS n_docs FROM b WHERE rn <= 5 GROUP BY ALL)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, source)::INT AS rank FROM p) WHERE rank <= 3""",
    "jaccard_pairs": f"""WITH {_SETS}, s AS (SELECT item_id, doc_id, count(*) AS s FROM l JOIN r USING (token) GROUP BY ALL),
        a AS (SELECT item_id, count(*) AS a FROM l GROUP BY ALL), b AS (SELECT doc_id, count(*) AS b FROM r GROUP BY ALL)
        SELECT item_id, doc_id, round(s / (a + b - s), 6) AS score FROM s JOIN a USING (item_id) JOIN b USING (doc_id) WHERE s / (a + b - s) >= 0.2""",
    "idf_jaccard": f"""WITH {_SETS}, w AS (SELECT token, ln(1 + (SELECT count(*) FROM documents) / count(*)) AS w FROM r GROUP BY token),
        s AS (SELECT item_id, doc_id, sum(w) AS s FROM l JOIN r USING (token) JOIN w USING (token) GROUP BY ALL),
        a AS (SELECT item_id, sum(w) AS a FROM l JOIN w USING (token) GROUP BY ALL), b AS (SELECT doc_id, sum(w) AS b FROM r JOIN w USING (token) GROUP BY ALL)
        SELECT item_id, doc_id, round(s / (a + b - s), 6) AS score FROM s JOIN a USING (item_id) JOIN b USING (doc_id) WHERE s / (a + b - s) >= 0.15""",
    "content_hash_merge": "SELECT substr(sha1(text), 1, 16) AS hash, min(doc_id) AS doc_id, array_to_string(list_sort(list(DISTINCT source)), ',') AS urls, count(*) AS n FROM documents GROUP BY 1",
    "content_collisions": "SELECT substr(sha1(text), 1, 16) AS hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "tokenbag_dedup": f"WITH {TERMS_SQL}, bag AS (SELECT doc_id, string_agg(term, chr(31) ORDER BY term) AS bag FROM tf GROUP BY doc_id) SELECT min(doc_id) AS doc_id FROM documents LEFT JOIN bag USING (doc_id) GROUP BY coalesce(bag, '')",
    "cross_url_collapse": """SELECT lang, hash, source, doc_id, score FROM (
        SELECT lang, source, doc_id, substr(sha1(text), 1, 16) AS hash, max(n_chars) OVER (PARTITION BY lang, sha1(text)) AS score,
               row_number() OVER (PARTITION BY lang, sha1(text) ORDER BY len(string_split(source, '/')), length(source), source, doc_id) AS rn FROM documents) WHERE rn = 1""",
    "token_subsumption": r"""WITH s AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')) AS w FROM benchmark)
        SELECT DISTINCT a.item_id FROM s a JOIN s b ON a.item_id <> b.item_id AND len(a.w) > 0 AND list_has_all(b.w, a.w)
        AND (len(b.w) > len(a.w) OR (len(b.w) = len(a.w) AND b.item_id < a.item_id))""",
    "text_search": """WITH h AS (SELECT *, strpos(text, 'and the') AS e, strpos(lower(text), 'and the') AS i FROM documents),
        p AS (SELECT *, CASE WHEN e > 0 THEN e ELSE i END AS pos FROM h WHERE i > 0),
        b AS (SELECT *, greatest(pos - 80, 1) AS a, least(pos + 87, length(text) + 1) AS z FROM p)
        SELECT doc_id, round(least(1.0, (CASE WHEN e > 0 THEN 1.0 ELSE 0.8 END) + (CASE WHEN n_chars > 1000 THEN 0.1 ELSE 0.0 END))::DOUBLE, 2) AS score,
               (CASE WHEN a > 1 THEN '…' ELSE '' END) || substring(text, a, z - a) || (CASE WHEN z <= length(text) THEN '…' ELSE '' END) AS snippet FROM b""",
    "completions": """SELECT p_name, tier FROM (SELECT DISTINCT p_name, CASE WHEN starts_with(lower(p_name), 'pa') THEN 0 WHEN contains(lower(p_name), 'pa') THEN 1 END AS tier FROM part)
        WHERE tier IS NOT NULL ORDER BY tier, length(p_name), p_name LIMIT 12""",
    "text_profile": r"""SELECT doc_id, length(trim(regexp_replace(text, '\s+', ' ', 'g')))::INT AS n_normal,
        regexp_replace(regexp_replace(lower(trim(substr(text, 1, 40))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
        len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))::INT AS n_lexical,
        length(regexp_replace(regexp_replace(text, '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g'))::INT AS n_spaced FROM documents""",
    "token_entropy": r"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents),
        c AS (SELECT token, ch, count(*) AS n FROM (SELECT token, unnest(string_split(token, '')) AS ch FROM t) WHERE ch <> '' GROUP BY ALL)
        SELECT token, round(-sum(n / length(token) * log2(n / length(token))), 6) + 0.0 AS entropy FROM c GROUP BY token""",
    "discriminative_tokens": r"""WITH r AS (SELECT DISTINCT source, doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}_]+')) AS token FROM documents),
        n AS (SELECT source, count(*) AS n FROM documents GROUP BY ALL), c AS (SELECT source, token, count(*) AS c FROM r GROUP BY ALL),
        g AS (SELECT token, count(*) AS g FROM r GROUP BY ALL),
        s AS (SELECT source, token, round(c / n - g / (SELECT count(*) FROM documents), 6) AS lift FROM c JOIN n USING (source) JOIN g USING (token) WHERE c >= 2)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY lift DESC, token)::INT AS rank FROM s) WHERE rank <= 5""",
}
