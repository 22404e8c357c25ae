"""Inverted index and TF-IDF retrieval."""

from __future__ import annotations

import functools
import itertools
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text as T
from ..sources import kept, shared_folder, side


#: Bytes of a lookup table up to which it is broadcast; beyond, joins shuffle.
BROADCAST_BYTES = 64 << 20
#: Bytes of text whose terms one task counts.
TASK_BYTES = 8 << 20
#: Queries that one chunk of ``search_in_chunks`` holds at most, and documents of one of its tasks.
CHUNK_QUERIES, TASK_DOCUMENTS = 2000, 1000


def smoothed_idf(n: Column | float, df: Column) -> Column:
    return F.log((n + F.lit(1.0)) / (df + F.lit(1.0))) + 1.0


@dataclass(frozen=True)
class Index:
    """``counts``: (doc, term, tf). ``stats``: (term, df, idf). ``size``: number of documents, those without terms too.

    ``lengths``: (doc, norm) where norms are stored; else they are computed from ``counts``. ``buckets``: where not 0,
    ``counts`` are stored in folders by ``bucket_of(term)``, and a search reads only those of its terms. ``parts``: where not 0,
    the partitions that suit the texts' size."""

    counts: DataFrame
    stats: DataFrame
    size: int
    lengths: DataFrame | None = None
    buckets: int = 0
    parts: int = 0

    @property
    def postings(self) -> DataFrame:
        """(doc, term, tf, idf)."""
        return self.counts.join(lookup(self.stats.select("term", "idf")), "term")

    @property
    def norms(self) -> DataFrame:
        """(doc, norm): lengths of the TF-IDF vectors. Terms of one document share an idf, so only the others' are looked up."""
        if self.lengths is not None:
            return self.lengths
        single = smoothed_idf(F.lit(float(self.size)), F.lit(1))
        rows = self.counts.join(lookup(self.stats.where("df > 1").select("term", "idf")), "term", "left")
        weight = F.col("tf") * F.coalesce("idf", single)
        return rows.groupBy("doc").agg(F.sqrt(F.greatest(F.sum(weight * weight), F.lit(1e-12))).alias("norm"))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def lookup(rows: DataFrame, term: str = "term") -> DataFrame:
    """``rows`` (term, ...) marked for a broadcast if their terms and a row's other columns take at most ``BROADCAST_BYTES``."""
    size = rows.agg(F.sum(F.octet_length(term) + 8 * len(rows.columns) + 24)).first()[0] or 0
    return F.broadcast(rows) if size <= BROADCAST_BYTES else rows.hint("shuffle_hash")


def tasks_for(rows: DataFrame, text: str) -> int:
    """Partitions for what is made of the terms of ``rows``: one for each ``TASK_BYTES`` of text, so that tasks don't grow with the input."""
    size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES + 1)


def _counted(keys: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 50):
                part = batch.slice(start, 50)
                found = []
                for texts in part.column("words").to_pylist():
                    n = Counter()
                    for words in texts:
                        n.update(words)
                        n.update(map(" ".join, itertools.pairwise(words)))
                    found.append(n)
                at = pa.array(np.repeat(np.arange(len(found)), [len(n) for n in found]))
                term, tf = [t for n in found for t in n], [c for n in found for c in n.values()]
                columns = [part.column(k).take(at) for k in keys]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(term, schema.field("term").type), pa.array(tf, pa.int64())], schema=schema)

    return run


def term_counts(docs: DataFrame, doc: str, text: str, *keep: str, parts: int | None = None) -> DataFrame:
    """(doc, term, tf, kept columns): single tokens and pairs. Texts of rows with the same id count together.

    Only texts are shuffled, by id, into ``parts`` tasks (by default of about ``TASK_BYTES``). Spark cuts texts into words; the terms of a
    document are counted in Arrow batches, so that no table of documents and terms is aggregated or spilled."""
    own = docs.select(doc, *keep, text).repartition(parts or tasks_for(docs, text), doc).groupBy(doc, *keep).agg(F.collect_list(F.coalesce(text, F.lit(""))).alias("texts"))
    words = own.select(doc, *keep, F.transform("texts", T.tokens).alias("words"))
    schema = StructType([words.schema[c] for c in (doc, *keep)]).add("term", "string").add("tf", "long")
    return words.mapInArrow(_counted([doc, *keep], to_arrow_schema(schema)), schema)


def term_stats(counts: DataFrame, size: int) -> DataFrame:
    """(term, df, idf) of postings (doc, term, ...)."""
    return counts.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", smoothed_idf(F.lit(float(size)), F.col("df")))


def build_index(docs: DataFrame, doc: str, text: str) -> Index:
    """Postings and document frequencies of ``docs``, in tables bucketed by term: frequencies and norms shuffle postings no more.

    The number of buckets follows the size of the texts."""
    parts, size = tasks_for(docs, text), docs.count()
    counts = _bucketed(term_counts(docs, doc, text, parts=parts).withColumnRenamed(doc, "doc"), parts, "term")
    return Index(counts, _bucketed(term_stats(counts, size), parts, "term"), size, parts=parts)


def search(index: Index, queries: DataFrame, query: str, text: str) -> DataFrame:
    """(query, doc, score): the TF-IDF cosine of every query with every document that shares a term.

    Query terms are a lookup table. Of postings bucketed by term, those of these terms alone are shuffled, by document; while the
    table is small they are multiplied and summed there, so that pairs of a query and a document are made and scored in the document's task."""
    q = term_counts(queries, query, text).withColumnRenamed(query, "query").withColumnRenamed("tf", "qtf")
    q = kept(index.stats.select("term", F.col("idf").alias("qidf")).join(lookup(q), "term"))
    qw = F.col("qtf") * F.col("qidf")
    qnorm = kept(q.groupBy("query").agg(F.sqrt(F.greatest(F.sum(qw * qw), F.lit(1e-12))).alias("qnorm")))
    sides = q.select("query", "term", (F.col("qtf") * F.col("qidf") * F.col("qidf")).alias("w"))
    counts = index.counts
    if index.buckets:
        read = q.select(bucket_of(F.col("term"), index.buckets).alias("bucket")).distinct().collect()  # numbers below index.buckets
        counts = counts.where(F.col("bucket").isin([r.bucket for r in read]))
    if index.parts:
        counts = counts.select("doc", "term", "tf").join(lookup(q.select("term").distinct()), "term", "left_semi").repartition(index.parts, "doc")
    hits = counts.join(lookup(sides), "term").groupBy("query", "doc").agg(F.sum(F.col("tf") * F.col("w")).alias("dot"))
    scored = hits.join(index.norms.hint("shuffle_hash"), "doc").join(side(qnorm), "query")
    return scored.select("query", "doc", (F.col("dot") / (F.col("norm") * F.col("qnorm"))).alias("score"))


def _bucketed(rows: DataFrame, parts: int, by: str) -> DataFrame:
    """``rows`` as a table bucketed by a column; joins of such tables and sums by this column shuffle nothing."""
    spark, name = rows.sparkSession, f"weftline_{uuid.uuid4().hex}"
    rows.repartition(parts, by).write.bucketBy(parts, by).option("path", f"{shared_folder(spark)}/{name}").format("parquet").saveAsTable(name)
    return spark.table(name)


def by_document(rows: DataFrame, size: int, doc: str = "doc") -> DataFrame:
    """``rows`` as a table bucketed by document, read in tasks of ``TASK_DOCUMENTS`` of ``size`` documents; joins of such tables by document shuffle and sort nothing."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // TASK_DOCUMENTS + 1)
    return _bucketed(rows, parts, doc).hint("shuffle_hash")


def search_in_chunks(index: Index, queries: DataFrame, query: str, text: str, best: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """``best`` of (query, doc, score) and the queries (query, qnorm) of one chunk after another, united.

    For queries that are a share of the documents: their pairs are quadratic, so they are neither shuffled nor kept.
    Postings lie by document and a chunk's terms are broadcast, so that each task sums up its documents' pairs; only what
    ``best`` keeps of them is written."""
    q = term_counts(queries, query, text).withColumnRenamed(query, "query").withColumnRenamed("tf", "qtf")
    q = kept(index.stats.select("term", F.col("idf").alias("qidf")).join(lookup(q), "term"))
    qw = F.col("qtf") * F.col("qidf")
    qnorms = kept(q.groupBy("query").agg(F.sqrt(F.greatest(F.sum(qw * qw), F.lit(1e-12))).alias("qnorm")))
    sides = q.select("query", "term", (qw * F.col("qidf")).alias("w"))
    size = sides.agg(F.sum(F.octet_length("term") + 48)).first()[0] or 0
    n = max(size // BROADCAST_BYTES, qnorms.count() // CHUNK_QUERIES) + 1
    counts, norms = by_document(index.counts, index.size), by_document(index.norms, index.size)
    found = []
    for i in range(n):
        chunk = F.pmod(F.xxhash64("query"), F.lit(n)) == i
        own = qnorms.where(chunk)
        hits = counts.join(F.broadcast(sides.where(chunk)), "term").groupBy("query", "doc").agg(F.sum(F.col("tf") * F.col("w")).alias("dot"))
        scored = hits.join(norms, "doc").join(F.broadcast(own), "query")
        found.append(kept(best(scored.select("query", "doc", (F.col("dot") / (F.col("norm") * F.col("qnorm"))).alias("score")), own)))
    return functools.reduce(DataFrame.union, found)


def top_per(rows: DataFrame, key: str, k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each key."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(rank) <= k)


def token_sets(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token): distinct tokens."""
    return rows.select(key, F.explode(F.array_distinct(T.tokens(F.col(text)))).alias("token"))


def jaccard(left: DataFrame, right: DataFrame, weight: DataFrame | None = None) -> DataFrame:
    """(l, r, score) of pairs that share a token: shared weight by the weight of the union. ``left``: (l, token), ``right``: (r, token).

    Weights and the tokens of ``left`` are looked up where the tokens of ``right`` are made, while they are small, so that only sums
    are shuffled; else tokens are."""
    if weight is not None:
        weight = lookup(weight, "token")
        left, right = left.join(weight, "token"), right.join(weight, "token")
    else:
        left, right = left.withColumn("w", F.lit(1.0)), right.withColumn("w", F.lit(1.0))
    shared = right.join(lookup(left.select("l", "token"), "token"), "token").groupBy("l", "r").agg(F.sum("w").alias("s"))
    a, b = left.groupBy("l").agg(F.sum("w").alias("a")), right.groupBy("r").agg(F.sum("w").alias("b"))
    return shared.join(b, "r").join(side(a), "l").select("l", "r", (F.col("s") / (F.col("a") + F.col("b") - F.col("s"))).alias("score"))


def document_frequencies_after(stats: DataFrame, postings: DataFrame, leaving: DataFrame, arriving: DataFrame) -> DataFrame:
    """(term, df) of an index once the documents ``leaving`` (doc) are out and the postings ``arriving`` (doc, term) are in.

    Documents that arrive replace their old postings. Only the changed documents' postings are counted; ``stats`` (term,
    df) holds the rest."""
    gone = leaving.select("doc").union(arriving.select("doc")).distinct()
    minus = postings.join(side(gone), "doc", "left_semi").select("term", F.lit(-1).alias("df"))
    kept = arriving.join(side(leaving.select("doc").distinct()), "doc", "left_anti").select("term", F.lit(1).alias("df"))
    return stats.select("term", "df").union(minus).union(kept).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")


def _hex(column: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(F.md5(column), start, length), 16, 10).cast("long")


def signed_hash_vectors(weights: DataFrame, dims: int = 1024) -> DataFrame:
    """(doc, dim, weight): rows (doc, term, weight) folded into signed hash buckets and scaled to length one.

    The first eight hex digits of the term's MD5 give the bucket, the ninth the sign. Buckets that cancel out stay, with 0;
    vectors of length 0 stay as they are."""
    sign = F.when(_hex(F.col("term"), 9, 1) < 8, 1.0).otherwise(-1.0)
    rows = weights.groupBy("doc", F.pmod(_hex(F.col("term"), 1, 8), F.lit(dims)).cast("int").alias("dim")).agg(F.sum(F.col("weight") * sign).alias("weight"))
    return _unit(rows)


def random_projection(weights: DataFrame, dims: int = 16) -> DataFrame:
    """(doc, dim, weight): rows (doc, term, weight) projected to ``dims`` (at most 32) dense numbers and scaled to length one.

    A term's row of the matrix is one sign a dimension, a bit of its MD5, so no matrix is kept and no vocabulary is
    needed (signs keep distances as normal numbers do). Sums are made once for all dimensions before rows are turned."""
    bits = weights.select("doc", "weight", _hex(F.col("term"), 1, 8).alias("bits"))
    sums = [F.sum(F.when(F.col("bits").bitwiseAND(1 << i) != 0, F.col("weight")).otherwise(-F.col("weight"))).alias(f"s{i}") for i in range(dims)]
    rows = bits.groupBy("doc").agg(*sums).select("doc", F.posexplode(F.array(*[f"s{i}" for i in range(dims)])).alias("dim", "weight"))
    return _unit(rows)


def _unit(rows: DataFrame) -> DataFrame:
    size = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("doc")))
    return rows.select("doc", "dim", (F.col("weight") / F.when(size > 0, size).otherwise(1.0)).alias("weight"))
