"""Append-only logs: sessions, rates, replay, state as of a time, rollback."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts):
    """Microseconds since 1970 of a timestamp with or without a time zone."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def sequence(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``seq``: 1, 2, ... within each key."""
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def sessions(rows: DataFrame, key: str, ts: str, gap_seconds: int, *tie: str) -> DataFrame:
    """Runs of a key's rows with gaps of at most ``gap_seconds``."""
    w = Window.partitionBy(key).orderBy(ts, *tie)
    late = micros(ts) - micros(F.lag(ts).over(w)) > gap_seconds * 1_000_000
    marked = rows.withColumn("starts", F.coalesce(late, F.lit(True)).cast("int"))
    return marked.withColumn("session", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")


def over_rate(rows: DataFrame, key: str, ts: str, seconds: int, most: int) -> DataFrame:
    """Rows with more than ``most`` rows of the key in the window that ends with them."""
    w = Window.partitionBy(key).orderBy(micros(ts)).rangeBetween(-seconds * 1_000_000, 0)
    return rows.withColumn("recent", F.count("*").over(w)).where(F.col("recent") > most)


def newest(rows: DataFrame, key: str, n: int, *order: str) -> DataFrame:
    """The last n rows of each key, numbered in append order."""
    w = Window.partitionBy(key)
    down = rows.withColumn("back", F.row_number().over(w.orderBy(*[F.desc(c) for c in order]))).where(F.col("back") <= n)
    return down.withColumn("slot", F.row_number().over(w.orderBy(*order))).drop("back")


def state_as_of(rows: DataFrame, key: str, value: str, removed: str, until, *order: str) -> DataFrame:
    """The last value of each key among rows for which ``until`` holds; keys that were last removed are left out."""
    last = rows.where(until).groupBy(key).agg(F.max_by(F.struct(value, removed), F.struct(*order)).alias("s"))
    return last.where(~F.col(f"s.{removed}")).select(key, F.col(f"s.{value}").alias(value))


def latest_by(rows: DataFrame, key: list[str], n: int, *order: str) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]))).where(F.col("rn") <= n).drop("rn")


def first_within(rows: DataFrame, key: list[str], ts: str, seconds: int, *tie: str) -> DataFrame:
    """Rows that an idempotency window of ``seconds`` accepts: the first of a key opens it, rows inside are repeats and don't
    renew it, and the first row at its end or later opens the next one.

    A key's rows pass through one task in order of time, and only the end of its window is held."""
    micro = "weftline_micros"
    spans = rows.withColumn(micro, micros(ts)).repartition(*key).sortWithinPartitions(*key, micro, *tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, until = None, 0
        for batch in batches:
            keep = []
            for own, at in zip(zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in key)), batch.column(batch.schema.get_field_index(micro)).to_pylist()):
                keep.append(own != last or at is None or at >= until)
                if keep[-1]:
                    last, until = own, (at or 0) + seconds * 1_000_000
            yield batch.filter(pa.array(keep, pa.bool_()))

    return spans.mapInArrow(run, spans.schema).drop(micro)


def rolled_back(log: DataFrame, undone: Column) -> DataFrame:
    """(target, state, n_undone): the state of each target once the edits that ``undone`` marks are reversed, latest first.

    ``log`` has edit_id, target, before and after. Reversing an edit restores what was before it, so the earliest undone
    edit decides; targets without one keep what their last edit left. A null state is a deleted target."""
    rows = log.select("target", "edit_id", "before", "after", F.coalesce(undone, F.lit(False)).alias("undone"))
    first = F.min_by("before", F.when(F.col("undone"), F.col("edit_id")))
    both = rows.groupBy("target").agg(first.alias("before"), F.max_by("after", "edit_id").alias("after"), F.count_if("undone").alias("n_undone"))
    return both.select("target", F.when(F.col("n_undone") > 0, F.col("before")).otherwise(F.col("after")).alias("state"), "n_undone")
