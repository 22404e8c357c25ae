"""Streaming twins of the log operators: watermarked sessions, deduplicated events, and members by pattern; ``state`` has those with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark, folder: str, schema, per_trigger: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events and value of each user's session; a session is final when the watermark has passed it."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def first_seen(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Events without an equal key within the watermark (idempotency)."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def absorb(chunks: DataFrame) -> DataFrame:
    """Chunk states by pattern, from rows (pattern, member): an ``event`` per pattern and batch that changed it.

    New members of an unknown pattern are ``added``; a pattern that gains members is ``replaced``; others give nothing."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = set(state.get[0]) if state.exists else set()
        after = before.union(*(set(p["member"]) for p in parts))
        if after != before:
            state.update((sorted(after),))
            yield pd.DataFrame({"pattern": [key[0]], "event": ["replaced" if before else "added"], "members": [len(after)]})

    return chunks.groupBy("pattern").applyInPandasWithState(update, "pattern string, event string, members long", "members array<string>", "append", GroupStateTimeout.NoTimeout)
