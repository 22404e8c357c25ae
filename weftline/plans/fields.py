"""Fields of repeating elements of pages. DuckDB can't parse html: these are tested against brute force on parsed pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fields, pages
from ..sources import kept_large, table


def _nodes(spark, sf):
    return kept_large(fields.readable(pages.nodes(table(spark, sf, "pages"), hashes=False)))


def summary_fields(spark, sf):
    """Each instance of each pattern of a page, with the distinct values of each accessor."""
    rows = _nodes(spark, sf)
    return fields.summary_fields(rows, fields.patterns(rows)).select("page_id", "pattern", "instance", F.to_json("fields").alias("fields"))


def extraction_trie(spark, sf):
    """The accessor trie of each pattern of a page, chains merged."""
    rows = _nodes(spark, sf)
    return fields.extraction_trie(kept_large(fields.learned(rows, fields.patterns(rows), "page_id")), "page_id")


def _routes(spark, sf, rows):
    """Accessors learned on the pages that repeat a pattern."""
    return kept_large(fields.learned(rows, fields.patterns(rows)))


def pattern_query(spark, sf):
    """All instances on all pages of the patterns that some page repeats, read by the accessors of all these pages."""
    rows = _nodes(spark, sf)
    return fields.pattern_query(rows, _routes(spark, sf, rows)).select("page_id", "pattern", "instance", F.to_json("fields").alias("fields"))


def instance_fields(spark, sf):
    """The same instances as one line of text and as content trees."""
    rows = _nodes(spark, sf)
    return fields.rendered_instances(rows, _routes(spark, sf, rows)).select("page_id", "pattern", "instance", "text", "lines")


def part_cards(spark, sf):
    """A card of each part as a content tree: repeated words, labels with colons and addresses made of its columns."""
    p = table(spark, sf, "part").repartition(2 * spark.sparkContext.defaultParallelism)  # a small file with much work in each row
    entries = [("/card/a/@href", F.concat(F.lit("/parts/"), F.col("p_partkey").cast("string"))), ("/card/h3/text()", F.col("p_name")), ("/card/h3/@title", F.upper("p_name")), ("/card/dt/text()", F.lit("<b>Maker</b>:")),
               ("/card/dd/text()", F.col("p_brand")), ("/card/p/text()", F.concat_ws(" ", "p_brand", "p_type")), ("/card/img/@src", F.lit("data:image/png;base64,AAAA")), ("/card/i/@class", F.col("p_type"))]
    held = F.map_from_arrays(F.array(*[F.lit(k) for k, _ in entries]), F.array(*[F.array(F.lit(" "), v) for _, v in entries]))
    return p.select("p_partkey", fields.content_tree(held).alias("lines"))


QUERIES = {f.__name__: f for f in (summary_fields, extraction_trie, pattern_query, instance_fields, part_cards)}

SQL = {
    "part_cards": r"""WITH u AS (SELECT p_partkey, i, v, list_distinct(regexp_extract_all(lower(v), '[\p{L}\p{N}]+')) AS w FROM (SELECT p_partkey,
            unnest([{'i': 1, 'v': p_name}, {'i': 2, 'v': upper(p_name)}, {'i': 3, 'v': 'Maker :'}, {'i': 4, 'v': p_brand}, {'i': 5, 'v': p_brand || ' ' || p_type}], recursive := true) FROM part)),
        k AS (SELECT * FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE a.p_partkey = b.p_partkey AND list_has_all(b.w, a.w) AND (len(b.w) > len(a.w) OR len(b.w) = len(a.w) AND b.i < a.i))),
        l AS (SELECT p_partkey, string_agg(v, chr(10) ORDER BY i) AS v FROM k GROUP BY p_partkey)
        SELECT p_partkey, '/parts/' || p_partkey || chr(10) || 'data:image/png' || chr(10) || replace(v, 'Maker :' || chr(10), 'Maker : ') AS lines FROM l""",
}
