"""What is found within a page equals what the steps on node tables find, and no node leaves the task that parses it."""

import pytest
from pyspark.sql import functions as F
from test_mining import HTML

from weftline import catalog
from weftline.operators import cohorts, content, graph, pages, templates, tree_match, within
from weftline.sources import kept, order_pages, table

FOLDER = "/root/testdata/sf0.001"
MORE = ["<div><a href='/a'><p>x</p></a></div>" * 3, "<div><p><b>a</b><i>b</i></p><template><p><b>c</b></p></template></div>" * 2, "<nav><ul><li>a<b>c</b></li><li>d</li><li><u><s><q><b>e</b></q></s></u></li></ul></nav>" * 2]


@pytest.fixture(scope="module")
def both(spark):
    """Pages and their node table."""
    own = spark.createDataFrame([(i, f"/{i}", h) for i, h in enumerate(HTML + MORE)], "page_id long, url string, html string")
    real = table(spark, FOLDER, "pages").select((F.col("page_id") + 1000).alias("page_id"), "url", "html")
    orders = order_pages(spark, FOLDER).where("page_id <= 40").select((F.col("page_id") + 5000).alias("page_id"), "url", "html")
    html = kept(own.union(real).union(orders))
    return html, kept(pages.nodes(html))


def same(found, expected):
    found, expected = ([tuple(r) for r in df.select(*sorted(df.columns)).collect()] for df in (found, expected))
    assert expected and sorted(found, key=repr) == sorted(expected, key=repr)


def roots(rows):
    first = F.min_by(F.struct("xpath", "height"), "node_id").alias("first")
    own = templates.framed(rows).where("height >= 1").groupBy("page_id", "template").agg(F.min("node_id").alias("node_id"), F.count("*").alias("n"), first)
    return kept(own.select("page_id", "node_id", "first.xpath", "first.height", "template", "n"))


def test_template_groups(both):
    html, rows = both
    same(within.template_groups(html), templates.template_groups(rows).groupBy("page_id", "template").agg(F.first("tag").alias("tag"), F.max("height").alias("height"), F.count("*").alias("n")).drop("template"))


def test_sub_templates(both):
    html, rows = both
    same(within.sub_templates(html), templates.sub_templates(rows, kept(templates.template_groups(rows))))


def test_pairs_of_trees(both):
    html, rows = both
    held = kept(templates.trees(rows, roots(rows)))
    same(within.tree_distances(html), tree_match.near_trees(held))
    same(within.common_subtrees(html), tree_match.similar_trees(held))


def test_merged_templates(both):
    html, rows = both
    own = roots(rows)
    pairs = tree_match.similar_trees(templates.trees(rows, own))
    name = lambda x: F.concat_ws(":", "page_id", F.lpad(F.col(x).cast("string"), 10, "0"))
    held = own.withColumn("node", name("node_id")).join(graph.components_of(kept(pairs.select(name("a").alias("src"), name("b").alias("dst")))), "node")
    expected = held.groupBy("page_id", "component").agg(F.max_by("node_id", F.struct("height", "n", -F.col("node_id"))).alias("base_id"), F.count("*").alias("n_templates"), F.sum("n").alias("n_instances")).drop("component")
    same(within.merged_templates(html), expected)


def test_cohorts_and_signatures(both):
    html, rows = both
    same(within.cohort_sizes(html), cohorts.cohorts(rows).groupBy("page_id", "cohort_id").agg(F.count("*").alias("n")).groupBy("page_id", "n").agg(F.count("*").alias("n_cohorts")))
    found = cohorts.settled_groups(rows).groupBy("page_id", "signature")
    same(within.settled_signatures(html), found.agg(F.count("*").alias("n"), F.countDistinct("cohort_id").alias("n_cohorts"), F.max("depth").alias("depth")))


def test_pq_trees_and_patterns(spark, both):
    shapes = ["<x><a></a><b><i></i></b></x>", "<x><b><i></i><u></u></b><a></a></x>", "<y><a></a></y>", "<y><p></p><a></a><p><i></i></p></y>", "<y></y>", "<div><z><a></a><b></b></z></div>", "<div><style></style><z><b></b><a></a></z></div>"]
    html = kept(both[0].union(spark.createDataFrame([(9000 + i, "", s * (i % 2 + 1)) for i, s in enumerate(shapes)], "page_id long, url string, html string")))
    rows = kept(pages.nodes(html))
    instances = rows.where(~F.col("tag").isin(*templates.FRAME)).where("height >= 1").select(F.col("template").alias("pattern"), "page_id", "node_id")
    expected = kept(cohorts.pq_trees(rows, instances))
    assert {r.kind for r in expected.select("kind").distinct().collect()} == {"leaf", "P", "Q"}
    same(within.pq_trees(within.instance_trees(html)), expected)
    heights = rows.groupBy(F.col("template").alias("pattern")).agg(F.min("height").alias("least_height"))
    patterns = kept(cohorts.compiled(cohorts.pq_trees(rows, instances, depth=1), heights))
    same(within.pattern_matches(html), cohorts.pattern_matches(rows, patterns).groupBy("pattern").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("n_pages")))


@pytest.mark.parametrize("name", ["template_groups", "sibling_cohorts", "tree_distances", "common_subtrees", "merged_templates", "settled_signatures", "sub_templates"])
def test_nodes_are_not_shuffled(spark, name):
    """Only lines and orders are: once by order, once by customer."""
    plan = catalog.queries()[name](spark, FOLDER)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan.split("MapInArrow")[0] and "Scan ExistingRDD" not in plan


@pytest.mark.parametrize("name", ["pq_trees", "pattern_matches"])
def test_nodes_are_neither_kept_nor_joined(spark, monkeypatch, name):
    kept_rows = []
    monkeypatch.setattr(within, "written", lambda df, f=within.written: kept_rows.append(f(df)) or kept_rows[-1])
    found = catalog.queries()[name](spark, FOLDER)
    nodes = pages.nodes(order_pages(spark, FOLDER), hashes=False).count()
    assert found.count() > 0 and sum(df.count() for df in kept_rows) * 2 < nodes


def test_pruned_sizes(spark, both):
    html, rows = both
    left = kept(content.without_empty_branches(rows))
    width = left.where("parent_id >= 0").groupBy("page_id", "parent_id").agg(F.count("*").alias("n")).groupBy("page_id").agg(F.max("n").alias("widest"))
    same(content.pruned_sizes(pages.nodes(html, hashes=False)), left.groupBy("page_id").agg(F.count("*").alias("n")).join(width, "page_id"))
    plan = catalog.queries()["pruned_order_pages"](spark, FOLDER)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "Exchange" not in plan.split("MapInArrow")[0] and "Exchange" not in plan.split("MapInArrow")[1]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # pages lie in several batches
    try:
        same(content.pruned_sizes(pages.nodes(html.where("page_id < 10"), hashes=False)), content.pruned_sizes(rows.where("page_id < 10").orderBy("page_id", "node_id").coalesce(1)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_empty_pages(spark):
    none = spark.createDataFrame([(1, "/1", None), (2, "/2", "")], "page_id long, url string, html string")
    for of in (within.template_groups, within.cohort_sizes, within.tree_distances, within.common_subtrees, within.merged_templates, within.settled_signatures, within.sub_templates):
        assert of(none).count() == of(none.limit(0)).count() == 0
