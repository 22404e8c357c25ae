"""Vector ranking, pooling and layout."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..sources import kept_large, side

#: Rows of a block of ``neighbours``, and how many of them are scored at once.
BLOCK_ROWS, CHUNK_ROWS = 8192, 256


def mean_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, pos, value): the mean vector of each key, scaled to length 1 (a zero mean stays zero)."""
    flat = rows.select(key, F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    size = flat.groupBy(key).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("size"))
    return flat.join(size, key).select(key, "pos", F.when(F.col("size") > 0, F.col("m") / F.col("size")).otherwise(F.lit(0.0)).alias("value"))


def as_arrays(rows: DataFrame, key: str) -> DataFrame:
    """(key, vector) from (key, pos, value)."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return rows.groupBy(key).agg(F.transform(ordered, lambda x: x.value).alias("vector"))


def unit(rows: DataFrame, vector: str) -> DataFrame:
    """``u``: the vector scaled to length 1, once per row, so that a pair costs one inner product."""
    size = V.norm(F.col(vector))
    return rows.withColumn("size", size).withColumn("u", F.when(F.col("size") > 0, F.transform(vector, lambda x: x.cast("double") / F.col("size"))).otherwise(F.transform(vector, lambda x: F.lit(0.0)))).drop("size")


def _best_of_block(k: int, least: float):
    """The ``k`` best of a block of candidates for each row of a block of queries, by products of matrices."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if left.num_rows and right.num_rows:
            keys, others = left["key"].to_numpy(), right["other"].to_numpy()
            u, v = (np.asarray(t[c].combine_chunks().flatten()).reshape(t.num_rows, left["width"][0].as_py()) for t, c in ((left, "u"), (right, "u2")))
            same = left["i"][0] == left["j"][0]
            for at in range(0, len(keys), CHUNK_ROWS):
                own, raw = keys[at : at + CHUNK_ROWS], u[at : at + CHUNK_ROWS] @ v.T
                if np.isnan(raw.min()):
                    raw = np.where(np.isnan(raw), np.inf, raw)  # Spark takes NaN for the largest number; no cosine is infinite
                if same:
                    raw[own[:, None] == others] = -np.inf
                floor = np.full(len(own), least)
                if len(others) > k:
                    floor = np.maximum(np.partition(raw, len(others) - k, axis=1)[:, len(others) - k], least)
                row, column = np.nonzero((raw >= floor[:, None] - 2e-6) & (raw > -np.inf))  # ties after rounding too
                value = raw[row, column]
                value = np.where(np.isinf(value), value, np.copysign(np.floor(np.abs(value) * 1e6 + 0.5) / 1e6, value) + 0.0)  # half up, as Spark rounds
                order = np.lexsort((others[column], -value, row))
                row, column, value = row[order], column[order], value[order]
                good = (np.arange(len(row)) - np.searchsorted(row, row) < k) & (value >= least)
                row, column, value = row[good], column[good], value[good]
                found.append((own[row], others[column], np.where(np.isinf(value), np.nan, value)))
        return pa.table(dict(zip(("key", "other", "score"), map(np.concatenate, zip(*found)))))

    return run


def neighbours(rows: DataFrame, group: str, key: str, vector: str, k: int, least: float) -> DataFrame:
    """(key, other, score, rank): up to k rows of the same group with a cosine of at least ``least``. Keys are whole numbers.

    Every pair of a group is scored, block of rows by block of rows; only the k best of a block leave its task. Vectors that
    are null, hold nulls or differ in length give no pair."""
    kind = rows.schema[key].dataType
    own = unit(rows.select(F.col(group).alias("group"), F.col(key).cast("long").alias("key"), vector), vector)
    own = kept_large(own.where("group is not null and key is not null and u is not null and not exists(u, x -> x is null)").select("group", "key", "u", F.size("u").alias("width")))
    blocks = own.groupBy("group", "width").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("n"))
    own = own.join(side(blocks), ["group", "width"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("n")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    left = own.select("group", "width", F.col("block").alias("i"), each.alias("j"), "key", "u")
    right = own.select(F.col("group").alias("group2"), F.col("width").alias("width2"), each.alias("i2"), F.col("block").alias("j2"), F.col("key").alias("other"), F.col("u").alias("u2"))
    best = left.groupBy("group", "width", "i", "j").cogroup(right.groupBy("group2", "width2", "i2", "j2")).applyInArrow(_best_of_block(k, least), "key long, other long, score double")
    w = Window.partitionBy("key").orderBy(F.desc("score"), "other")
    best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select(F.col("key").cast(kind).alias(key), F.col("other").cast(kind).alias("other"), "score", "rank")


def min_max(value: str, *group: str):
    """A value between the least and the largest of its group as 0 to 1; 1 if all are equal."""
    w = Window.partitionBy(*group)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(F.lit(1.0))
