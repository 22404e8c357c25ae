"""Readers for tables and raw pages."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where none is set (local tests) a temporary one is taken."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="weftline-"))
    return sc._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that what reads it several times doesn't compute it again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def kept_large(df: DataFrame) -> DataFrame:
    """The same for tables as large as the input: joins with them shuffle.

    Spark takes a parsed or exploded table for about as large as what it came from, so by its own estimate it would gather
    millions of nodes in the driver for a broadcast."""
    return kept(df).hint("merge")


def side(df: DataFrame, most: int = 16 << 20) -> DataFrame:
    """``df`` as a side of a join with few keys: measured, and broadcast if its values take at most ``most`` bytes as JSON."""
    size = df.agg(F.sum(F.length(F.to_json(F.struct(*df.columns))))).first()[0] or 0
    return F.broadcast(df) if size <= most else df.hint("merge")


def written(df: DataFrame) -> DataFrame:
    """The same as a Parquet table, of which later plans read only the columns that they need."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffled_into(spark: SparkSession, parts: int) -> Iterator[None]:
    """What runs inside shuffles into ``parts`` partitions at least; Spark's own number doesn't follow the input."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(int(before), parts)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html): a page for each customer with orders, an article for each order, a list entry for each line and sections for priority and status; returned lines are marked."""
    o, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    mark = F.when(F.col("l_returnflag") == "R", "<em>returned</em>").otherwise("")
    entry = F.concat(F.format_string('<li><a href="/parts/%d">Part %d</a><span>%d</span>', "l_partkey", "l_partkey", F.col("l_quantity").cast("long")), mark, F.lit("</li>"))
    lists = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", entry.alias("entry")))), lambda x: x.entry), "").alias("entries"))
    section = lambda kind, name: F.format_string('<section><p><a href="/%s/%s">%s</a></p></section>', F.lit(kind), name, name)
    article = F.concat(F.format_string('<article><h2><a href="/orders/%d">Order %d</a></h2><ul>', "o_orderkey", "o_orderkey"), F.col("entries"), F.lit("</ul>"), section("priorities", "o_orderpriority"), section("status", "o_orderstatus"), F.lit("</article>"))
    # a fixed number of partitions: pages are small when packed, so that Spark would join them to a few and parse them there
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    own = o.join(lists.hint("merge"), o.o_orderkey == lists.l_orderkey).select("o_custkey", "o_orderkey", "entries", "o_orderpriority", "o_orderstatus").repartition(parts, "o_custkey").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", article.alias("article")))), lambda x: x.article), "").alias("articles"))
    html = F.concat(F.lit("<html><body><main>"), F.col("articles"), F.lit("</main></body></html>"))
    return own.select(F.col("o_custkey").alias("page_id"), F.format_string("/customers/%d", "o_custkey").alias("url"), html.alias("html"))


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """(url, html): one row per file, whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))


def synthetic_xpaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, nation, xp, size): an absolute path for each customer in the tree of regions and nations."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)  # 25 and 5 rows by the schema
    xp = F.format_string("/html/body/region[%d]/nation[%d]/customer[%d]", F.col("r_regionkey") + 1, F.col("n_nationkey") + 1, "c_custkey")
    return rows.select("c_custkey", F.col("n_nationkey").alias("nation"), xp.alias("xp"), (F.col("c_custkey") % 7 + 1).cast("long").alias("size"))


#: The same in DuckDB.
XPATHS_SQL = """xp AS (
    SELECT c_custkey, n_nationkey AS nation, (c_custkey % 7 + 1)::BIGINT AS size,
           '/html/body/region[' || (r_regionkey + 1) || ']/nation[' || (n_nationkey + 1) || ']/customer[' || c_custkey || ']' AS xp
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
