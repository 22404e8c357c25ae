"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Vectors are sparse integer rows: a dimension is a term and a non-zero component its weight.  A block of rows is held as
postings, one list of (row, weight) per term.  The queries of a chunk scatter their weights through the postings into
dense arrays of scores, one per query; the best k of each block are selected by partition and the blocks are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, stash

#: Queries that are broadcast at once (at 64 components of 8 bytes, 1 MB), and rows of a block of postings.
QUERY_CHUNK, BLOCK_ROWS = 2048, 4096


def quantised(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as long, computed in double; null if the vector is null or has a null or non-finite component."""
    scaled = F.transform(embedding, lambda x: F.lit(float(scale)) * x.cast("double"))
    sound = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(F.coalesce(sound, F.lit(False)), F.transform(scaled, lambda x: F.floor(x)))


def _scores(queries: np.ndarray, rows: np.ndarray, postings: list[np.ndarray | None]) -> np.ndarray:
    """Inner products of queries with the rows of a block (terms by rows), one term after another.

    ``postings`` has the rows that hold a term, or None if all do.  32 bits are used where no score can need more."""
    widest = sum(int(q) * int(r) for q, r in zip(np.abs(queries).max(0, initial=0), np.abs(rows).max(1, initial=0)))
    kind = np.int32 if widest < 2**31 else np.int64
    queries, rows = queries.astype(kind), rows.astype(kind)
    scores = np.zeros((len(queries), rows.shape[1]), kind)
    for q in range(len(queries)):
        own = scores[q]
        for term in np.flatnonzero(queries[q]).tolist():
            if postings[term] is None:
                own += queries[q, term] * rows[term]
            elif len(postings[term]):
                own[postings[term]] += queries[q, term] * rows[term, postings[term]]
    return scores


def _best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, postings: list[np.ndarray | None], k: int) -> tuple[np.ndarray, ...]:
    """The k best of a block for each query; rows with the query's own id take no part."""
    scores, out = _scores(queries, rows, postings), []
    for q in range(len(queries)):
        s, own = scores[q], np.count_nonzero(ids == query_ids[q])
        able = np.arange(len(s))
        if len(s) > k + own:  # with all that tie with the last one that can be needed
            able = np.flatnonzero(s >= np.partition(s, len(s) - k - own)[len(s) - k - own])
        able = able[ids[able] != query_ids[q]]
        able = able[np.lexsort((ids[able], -s[able].astype(np.int64)))[:k]]
        out.append((np.full(len(able), query_ids[q]), ids[able], s[able].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _search(held, k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                rows = _matrix(part.column(1), width).T.copy()
                postings = [None if rows[t].all() else np.flatnonzero(rows[t]) for t in range(width)]
                for q in range(0, len(queries), 256):
                    found = _best(query_ids[q : q + 256], queries[q : q + 256], ids, rows, postings, k)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["query_id", "vec_id", "score"])

    return run


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix: zero beyond their end, cut at ``width``, as no query has terms there."""
    out = np.zeros((len(vectors), width), dtype=np.int64)
    sizes, values = vectors.value_lengths().to_numpy(zero_copy_only=False), vectors.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(vectors)), sizes)
    term = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    held = term < width
    out[row[held], term[held]] = values[held]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, chunk: int = QUERY_CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products for each query row among all other rows.

    ``vectors`` has vec_id and embedding; other columns are ignored.  ``is_query`` chooses the query rows.  Ties go to the
    smaller vec_id.  Vectors that are null or hold a null, NaN or infinite component take no part, nor do rows with a null
    vec_id; shorter vectors count as zero beyond their end.  Rows with the query's own vec_id are never its results; other
    repeated rows each count.  A query row that repeats is one query.  Fewer than k other rows give that many.  Products
    are 64-bit integers: scaled components must stay under 2**28 for 64 dimensions.  Queries go to all rows in chunks of
    ``chunk``, one scan of the table for each; the results of several chunks are written before they are merged.
    """
    bounded_batches(vectors.sparkSession, BLOCK_ROWS)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("v"), is_query.alias("q")).where("vec_id is not null and v is not null")
    queries = rows.where("q").select("vec_id", "v").dropDuplicates(["vec_id"])
    spark = vectors.sparkSession
    bounds = _chunk_bounds(queries, chunk)
    parts = []
    for low, high in bounds:  # one chunk of queries after another, so that the driver and the workers hold one at a time
        few = queries.where((F.col("vec_id") >= low) & (F.col("vec_id") <= high)).toArrow()
        width = max(few.column("v").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max(initial=0), 0)
        held = spark.sparkContext.broadcast((few.column("vec_id").to_numpy(), _matrix(few.column("v").combine_chunks(), int(width))))
        part = rows.select("vec_id", "v").mapInArrow(_search(held, k, int(width)), "query_id long, vec_id long, score long")
        if len(bounds) > 1:
            part = stash(part, "found")
            held.destroy()
        parts.append(part)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for more in parts[1:]:
        found = found.union(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _chunk_bounds(queries: DataFrame, chunk: int) -> list[tuple[int, int]]:
    """Ranges of vec_id that hold about ``chunk`` queries each and cover all."""
    n, low, high = queries.agg(F.count("*"), F.min("vec_id"), F.max("vec_id")).first()
    if not n:
        return []
    parts = -(-n // chunk)
    if parts == 1:
        return [(low, high)]
    cuts = queries.approxQuantile("vec_id", [i / parts for i in range(1, parts)], 1 / (8 * parts))
    cuts = sorted({int(x) for x in cuts if low <= x < high})
    return list(zip([low, *(x + 1 for x in cuts)], [*cuts, high]))
