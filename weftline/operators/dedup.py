"""Exact and token-bag deduplication, collapse across urls, subsumption."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def merge_by_content(rows: DataFrame, key: str, url: str, text: str) -> DataFrame:
    """One row per text: its hash, the first key, all urls."""
    hashed = rows.withColumn("hash", T.short_sha1(F.col(text)))
    return hashed.groupBy("hash").agg(F.min(key).alias(key), F.array_sort(F.collect_set(url)).alias("urls"), F.count("*").alias("n"))


def first_per_bag(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Keys of rows whose set of tokens and pairs no smaller key has. Texts without tokens are one bag."""
    words = rows.select(key, T.tokens(F.col(text)).alias("words"))
    pairs = F.zip_with("words", F.slice("words", F.lit(2), F.size("words")), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    terms = F.array_distinct(F.concat("words", F.filter(pairs, lambda x: x.isNotNull())))
    bag = F.sha2(F.array_join(F.array_sort(terms), "\x1f"), 256)
    return words.groupBy(bag.alias("bag")).agg(F.min(key).alias(key)).select(key)


def first_in_group(rows: DataFrame, group: str, key: str, text: str, shortest: int = 3, least: int = 2) -> DataFrame:
    """(group, key, hash): the first row of each text in a group; texts under ``shortest`` signs and groups that keep under ``least`` texts are left out."""
    own = rows.where(F.length(F.trim(text)) >= shortest).groupBy(group, T.short_sha1(F.col(text)).alias("hash")).agg(F.min(key).alias(key))
    large = own.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(group)
    return own.join(large, group, "left_semi").select(group, key, "hash")


def most_specific(rows: DataFrame, mark: str, *order) -> DataFrame:
    """One row for each ``mark``, the first by ``order``."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(mark).orderBy(*order))).where("rn = 1").drop("rn")


def collapse_across_urls(rows: DataFrame, group: list[str], url: str, key: str, score: str) -> DataFrame:
    """Per group: the shallowest url (segments, length, name), and the group's best score."""
    order = [F.size(F.split(url, "/")), F.length(url), F.col(url), F.col(key)]
    best = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    best = best.withColumn("best", F.max(score).over(Window.partitionBy(*group)))
    return best.where("rn = 1").drop("rn")


def subsumed(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Keys whose token set is a strict subset of another row's, or equal to that of a smaller key."""
    own = rows.select(F.col(key).alias("k"), F.array_distinct(T.tokens(F.col(text))).alias("set")).where(F.size("set") > 0)
    flat = own.select("k", F.size("set").alias("n"), F.explode("set").alias("token"))
    other = flat.select(F.col("k").alias("k2"), F.col("n").alias("n2"), "token")
    shared = flat.join(other, "token").where("k <> k2").groupBy("k", "k2", "n", "n2").agg(F.count("*").alias("c"))
    return shared.where("c = n and (n2 > n or (n2 = n and k2 < k))").select("k").distinct()
