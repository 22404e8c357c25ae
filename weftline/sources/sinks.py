"""Upserts and removals on tables without MERGE, as rewrites by joins on the key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key; the last of several new rows of a key by all columns stands."""
    one = new.groupBy(*keys).agg(*[F.max_by(c, F.struct(*new.columns)).alias(c) for c in new.columns if c not in keys])
    return old.join(one.select(*keys), keys, "left_anti").unionByName(one)


def upsert_keeping_first(old: DataFrame, new: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """Upsert of sightings: the earliest ``first`` and the latest ``last`` of each key stay."""
    both = old.select(*keys, first, last).unionByName(new.select(*keys, first, last))
    return both.groupBy(*keys).agg(F.min(first).alias(first), F.max(last).alias(last))


def remove(rows: DataFrame, ids: DataFrame, key: str, with_parts: bool = False) -> DataFrame:
    """Rows without those of the given ids; ``with_parts`` also removes ids of the form ``id_part``."""
    kept = rows.join(ids.select(key), key, "left_anti")
    if not with_parts:
        return kept
    head = F.regexp_extract(F.col(key), r"^(.*?)_", 1)
    return kept.withColumn("_head", head).join(ids.select(F.col(key).alias("_head")), "_head", "left_anti").drop("_head")


def changed_only(previous: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """Current rows whose digest differs from the previous one of their key."""
    old = previous.select(key, F.col(digest).alias("_old"))
    return current.join(old, key, "left").where(F.col("_old").isNull() | (F.col("_old") != F.col(digest))).drop("_old")
