"""Lookups, filters and deduplication within and across groups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup
from ..sources import table


def page_by_url(spark, sf):
    """Rows of one page, chosen by equality of its url: the first url in order."""
    pages = table(spark, sf, "pages")
    first = pages.agg(F.min("url").alias("url"))
    return pages.join(F.broadcast(first), "url").select("page_id", "url")


def registered_urls(spark, sf):
    """Urls that have a snapshot, each once, with the number of pages."""
    return table(spark, sf, "pages").where("html is not null and url is not null").groupBy("url").agg(F.count("*").alias("n"))


def log_filters(spark, sf):
    """The log of one actor since a time, one kind only, newest first, fifty entries."""
    rows = table(spark, sf, "events").where("user_id < 20 and event_type like 'p%' and ts >= timestamp '2024-01-10'")
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id")


def content_dedup_in_group(spark, sf):
    """Per source: the first document of each text; short texts and sources with a single text are left out."""
    return dedup.first_in_group(table(spark, sf, "documents"), "source", "doc_id", "text")


def cross_group_text(spark, sf):
    """Each text once, in the most specific of the sources that hold it: the one with the fewest different texts."""
    rows = table(spark, sf, "documents").withColumn("hash", T.short_sha1(F.col("text")))
    size = rows.groupBy("source").agg(F.countDistinct("hash").alias("n_texts"))
    own = rows.groupBy("hash", "source").agg(F.min("doc_id").alias("doc_id")).join(size, "source")
    return dedup.most_specific(own, "hash", "n_texts", "source", "doc_id").select("hash", "source", "doc_id")


def min_size_chunks(spark, sf):
    """Conversations as chunks: kept with at least two filled turns or 200 signs of text."""
    text = F.trim(F.coalesce("text", F.lit("")))
    sizes = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum((text != "").cast("long")).alias("n_fields"), F.sum(F.length(text)).alias("n_chars"))
    return sizes.where("n_fields >= 2 or n_chars >= 200")


def letter_digit_tokens(spark, sf):
    """Tokens of letters and digits, without underscores, per document: all and distinct ones."""
    rows = table(spark, sf, "documents").select("doc_id", T.letter_digit_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n"), F.size(F.array_distinct("t")).alias("n_distinct"))


def real_text(spark, sf):
    """Turns that say something once invisible signs are gone, and their length then."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", T.visible(F.col("text")).alias("seen"))
    return rows.where(F.col("seen").rlike(r"[\p{L}\p{N}]")).groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("seen")).alias("n_chars"))


def data_uris(spark, sf):
    """Values of src and href attributes, data URIs as their type alone, with their number."""
    rows = table(spark, sf, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('(?:src|href)="([^"]*)"'))).alias("value"))
    return rows.select(T.compact_data_uri(F.col("value")).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def revision_counts(spark, sf):
    """Per user and day: events, and how many of them were the first of their type for the user."""
    first = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    rows = table(spark, sf, "events").withColumn("fresh", (F.row_number().over(first) == 1).cast("long"))
    return rows.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum("fresh").alias("n_fresh"))


QUERIES = {f.__name__: f for f in (page_by_url, registered_urls, log_filters, content_dedup_in_group, cross_group_text, min_size_chunks, letter_digit_tokens, real_text, data_uris, revision_counts)}

SQL = {
    "page_by_url": "SELECT page_id, url FROM pages WHERE url = (SELECT min(url) FROM pages)",
    "registered_urls": "SELECT url, count(*) AS n FROM pages WHERE html IS NOT NULL AND url IS NOT NULL GROUP BY url",
    "log_filters": "SELECT event_id, user_id FROM events WHERE user_id < 20 AND event_type LIKE 'p%' AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id DESC LIMIT 50",
    "content_dedup_in_group": """WITH o AS (SELECT source, substr(sha1(text), 1, 16) AS hash, min(doc_id) AS doc_id FROM documents WHERE length(trim(text)) >= 3 GROUP BY ALL)
        SELECT source, doc_id, hash FROM o WHERE source IN (SELECT source FROM o GROUP BY source HAVING count(*) >= 2)""",
    "cross_group_text": """WITH h AS (SELECT *, substr(sha1(text), 1, 16) AS hash FROM documents), s AS (SELECT source, count(DISTINCT hash) AS n_texts FROM h GROUP BY source),
        o AS (SELECT hash, source, min(doc_id) AS doc_id FROM h GROUP BY ALL)
        SELECT hash, arg_min(source, (n_texts, source, doc_id)) AS source, arg_min(doc_id, (n_texts, source, doc_id)) AS doc_id FROM o JOIN s USING (source) GROUP BY hash""",
    "min_size_chunks": """SELECT conv_id, count(*) FILTER (trim(coalesce(text, '')) <> '') AS n_fields, sum(length(trim(coalesce(text, ''))))::BIGINT AS n_chars FROM conversations
        GROUP BY conv_id HAVING n_fields >= 2 OR n_chars >= 200""",
    "letter_digit_tokens": r"SELECT doc_id, len(t)::INT AS n, len(list_distinct(t))::INT AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS t FROM documents)",
    "real_text": r"""WITH s AS (SELECT conv_id, trim(translate(text, chr(8203) || chr(8204) || chr(8205) || chr(8288) || chr(65279), '')) AS seen FROM conversations)
        SELECT conv_id, count(*) AS n, sum(length(seen))::BIGINT AS n_chars FROM s WHERE regexp_matches(seen, '[\p{L}\p{N}]') GROUP BY conv_id""",
    "data_uris": """WITH v AS (SELECT unnest(regexp_extract_all(html, '(?:src|href)="([^"]*)"', 1)) AS value FROM pages)
        SELECT CASE WHEN value LIKE 'data:%' THEN 'data:' || coalesce(nullif(regexp_extract(value, '^data:([^;,]*)', 1), ''), 'inline') ELSE value END AS value, count(*) AS n FROM v GROUP BY 1""",
    "revision_counts": """WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS fresh FROM events)
        SELECT user_id, ts::DATE AS day, count(*) AS n, count(*) FILTER (fresh) AS n_fresh FROM f GROUP BY ALL""",
}
