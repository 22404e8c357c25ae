"""Edge cases of operators and functions."""

import itertools

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import url as U
from weftline.functions import vector as V
from weftline.functions import xpath as X
from weftline.operators import dedup, graph, logs, pages, search, trees, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("a, d, expected", [("/a", "/a/b", True), ("/a", "/a", False), ("/div", "/divider", False), ("", "/a", False), ("/ul/li[3]", "/ul/li[30]", False), ("/a/b", "/a/c", False)])
def test_ancestor(spark, a, d, expected):
    assert one(spark, X.is_ancestor(F.lit(a), F.lit(d))) is expected


def test_paths(spark):
    assert one(spark, X.generalise(F.lit("/a[1]/b[22]"))) == "/a/b"
    assert one(spark, X.parent(F.lit("/a"))) == "/"
    assert one(spark, X.prefixes(F.lit("/a/b[2]"))) == ["/a", "/a/b[2]"]
    assert one(spark, X.relative(F.lit("/a/b/c"), F.lit("/a"))) == "b/c"
    assert one(spark, X.relative(F.lit("/ab/c"), F.lit("/a"))) is None


def test_text(spark):
    assert one(spark, T.tokens(F.lit("Ab cd_é ñx"))) == ["ab", "cd_é", "ñx"]
    assert one(spark, T.terms(F.array(F.lit("a"), F.lit("b")))) == ["a", "b", "a b"]
    assert one(spark, T.slug(F.lit("  Hello, World! "))) == "hello_world"
    assert one(spark, T.attribute_tokens(F.lit("navBar-item_2x btn"))) == ["nav", "bar", "item", "btn"]
    assert one(spark, T.snippet(F.lit("abcdef"), F.lit(3), F.lit(1), 1)) == "…bcd…"


def test_urls(spark):
    assert one(spark, U.canonical_href(F.lit(" http://a.b/Path/X?Q=1/ "))) == "http://a.b/path/x?Q=1"
    assert one(spark, U.classify(F.lit("data:image/png;base64,x"))) == "resource"
    assert one(spark, U.classify(F.lit("/a"))) == "internal"


def test_cosine(spark):
    zero, unit = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))
    assert one(spark, V.cosine(zero, unit)) == 0
    assert one(spark, V.cosine_gate(F.lit(None).cast("array<double>"), unit)) == 1
    assert one(spark, V.cosine_gate(F.array(F.lit(-1.0), F.lit(0.0)), unit)) == 0


def test_prune_rollups(spark):
    rows = spark.createDataFrame([("/r", 20), ("/r/c[1]", 3), ("/s", 20), ("/r/c[1]/d", 30), ("/t", 5), ("/t/u", 1)], "xp string, size int")
    assert {r.xp for r in trees.prune_rollups(rows, "xp", "size", 10).collect()} == {"/r/c[1]", "/s", "/r/c[1]/d", "/t", "/t/u"}
    assert trees.prune_rollups(rows.limit(0), "xp", "size", 10).count() == 0


def test_diff_without_prior(spark):
    new = spark.createDataFrame([("a", 1)], "k string, v int")
    assert [r.state for r in trees.diff(new.limit(0), new, ["k"], "v").collect()] == ["added"]


def test_common_prefix(spark):
    rows = spark.createDataFrame([(1, "/a/b/c"), (1, "/a/b/d"), (2, "/a/b/c")], "g int, xp string")
    assert dict(trees.common_prefix(rows, "g", "xp").collect()) == {1: "/a/b", 2: "/a/b"}


def test_subsumed(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "a b c"), (3, "b a"), (4, ""), (5, "x")], "k int, text string")
    assert {r.k for r in dedup.subsumed(rows, "k", "text").collect()} == {1, 3}


def test_search_null_and_empty(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, None), (3, "")], "doc_id int, text string")
    found = search.search(search.build_index(docs, "doc_id", "text"), spark.createDataFrame([(7, "fox")], "q int, text string"), "q", "text").collect()
    assert [(r["query"], r.doc) for r in found] == [(7, 1)] and 0 < found[0].score <= 1


def test_reach_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "origin string")
    assert {(r.node, r.distance) for r in graph.reach(edges, seeds, 6).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_pagerank_makes_thirty_rounds(spark):
    links = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "c")]
    rank = dict.fromkeys("abcd", 0.25)
    for _ in range(30):
        rank = {v: 0.15 / 4 + 0.85 * sum(rank[x] / sum(y == x for y, _ in links) for x, w in links if w == v) for v in rank}
    got = {r.node: r["rank"] for r in graph.pagerank(spark.createDataFrame(links, "src string, dst string")).collect()}
    assert got == pytest.approx(rank, abs=1e-9)


def test_circuits_of_any_length(spark):
    nodes = "abcde"
    edges = spark.createDataFrame([(x, y, 1 + 5 * nodes.index(x) + nodes.index(y)) for x in nodes for y in nodes], "src string, dst string, n long")
    n = lambda x, y: 1 + 5 * nodes.index(x) + nodes.index(y)
    every = [p for size in range(1, 6) for p in itertools.permutations(nodes, size) if p[0] == min(p)]
    got = [(tuple(r.path), r.least) for r in graph.circuits(edges).collect()]
    assert len(every) == 89 and sorted(got) == sorted((p, min(n(x, y) for x, y in zip(p, p[1:] + p[:1]))) for p in every)


def test_sessions_and_rate(spark):
    rows = spark.sql("SELECT 1 AS u, id AS e, timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 40) AS ts FROM range(3)")
    assert [r.session for r in logs.sessions(rows, "u", "ts", 1800, "e").orderBy("e").collect()] == [1, 2, 3]
    assert logs.over_rate(rows, "u", "ts", 3600, 1).count() == 2


def test_min_max_flat(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, 2.0)], "g int, v double")
    assert [r.x for r in rows.select(vectors.min_max("v", "g").alias("x")).collect()] == [1.0, 1.0]


def test_nodes(spark):
    html = "<ul><li><a href='/x'>one</a><li><a href='/y'>two</a></ul><script>var a='<p>'</script>"
    rows = {r.xpath: r for r in pages.nodes(spark.createDataFrame([(1, "u", html), (2, "u", None)], "page_id long, url string, html string")).collect()}
    assert rows["/ul[1]/li[2]/a[1]"].text == "two" and rows["/ul[1]/li[2]/a[1]"].attrs == {"href": "/y"}
    assert rows["/ul[1]/li[1]"].template == rows["/ul[1]/li[2]"].template and rows["/ul[1]/li[1]"].exact != rows["/ul[1]/li[2]"].exact
    assert rows["/ul[1]"].last_id - rows["/ul[1]"].node_id == 4


def test_streams(spark, tmp_path):
    from weftline import streaming

    (tmp_path / "in").mkdir()
    data = [("p", ["a", "b"]), ("p", ["a"]), ("p", ["b", "c"]), ("q", ["z"])]
    for i, (pattern, members) in enumerate(data):
        spark.createDataFrame([(pattern, m) for m in members], "pattern string, member string").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema("pattern string, member string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    run = streaming.absorb(stream).writeStream.format("memory").queryName("absorbed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    seen = spark.sql("SELECT pattern, max(members) AS m, count(*) AS n FROM absorbed GROUP BY pattern").collect()
    assert {r.pattern: r.m for r in seen} == {"p": 3, "q": 1}


def test_idempotency_window_is_not_renewed(spark):
    from pyspark.sql import functions as F

    from weftline.operators import logs

    hours = [0, 20, 23, 24, 40, 47, 49]
    rows = spark.createDataFrame([("a", 3600 * h, i) for i, h in enumerate(hours)] + [("b", 3600, 9), ("b", 3600, 10)], "k string, s long, i int")
    rows = rows.withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.i for r in logs.first_within(rows, ["k"], "ts", 86400, "i").collect()) == [0, 3, 6, 9]
    assert logs.first_within(rows.limit(0), ["k"], "ts", 86400, "i").count() == 0


def test_url_and_text_helpers(spark):
    from pyspark.sql import functions as F

    from weftline.functions import text as T
    from weftline.functions import url as U

    rows = spark.createDataFrame([("https://WWW.Site.org/Games/DOS_list-2/?Q=A",), ("/",), (" HTTP://a/B/// ",)], "u string")
    got = [tuple(r) for r in rows.select(U.canonical_href(F.col("u")), F.array_join(U.semantic_tokens(F.col("u")), " ")).collect()]
    assert got == [("https://www.site.org/games/dos_list-2/?Q=A", "site games dos list"), ("/", ""), ("http://a/b", " http")]
    values = spark.createDataFrame([("data:image/png;base64,AA",), ("data:,x",), ("/a.png",)], "v string")
    assert [r[0] for r in values.select(T.compact_data_uri(F.col("v"))).collect()] == ["data:image/png", "data:inline", "/a.png"]


def node_rows(spark, sf="/root/testdata/sf0.001"):
    """The nodes of the smallest pages, and of pages with cards within cards, as dicts and as a table."""
    card = "<li><p>{0}</p><ul><li>a</li><li>b</li></ul></li>"
    made = [(-i, f"made{i % 2}", "<ul>" + "".join(card.format(x) for x in ("x", "y", str(i))) + "</ul>") for i in range(1, 4)] + [(-9, None, None)]
    table = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").union(spark.createDataFrame(made, "page_id long, url string, html string"))
    rows = [x for r in table.collect() for x in pages._page_rows(r.page_id, r.url, r.html)]
    return rows, pages.nodes(table)


def test_cross_page_matches_equal_brute_force(spark):
    rows, table = node_rows(spark)
    places = {}
    for r in rows:
        if r["size"] >= 3 and r["url"] is not None:
            places.setdefault(r["exact"], {}).setdefault(r["url"], []).append((r["page_id"], r["node_id"], r["xpath"]))
    expected = {(e, u, min(p)[2], len(p), len(urls), min(urls)) for e, urls in places.items() if len(urls) > 1 for u, p in urls.items()}
    found = [tuple(r) for r in pages.cross_page_matches(table).collect()]
    assert expected and len(found) == len(expected) and set(found) == expected


def test_containment_equals_brute_force(spark):
    rows, table = node_rows(spark)
    by_page = {}
    for r in rows:
        by_page.setdefault(r["page_id"], []).append(r)
    expected = set()
    for own in by_page.values():
        kinds = [r["template"] for r in own]
        for r in own:
            up = r
            while r["parent_id"] >= 0 and kinds.count(r["template"]) > 1 and up["parent_id"] > 0:
                up = own[up["parent_id"]]
                if kinds.count(up["template"]) > 1:
                    if up["height"] > r["height"]:
                        expected.add((up["template"], r["template"]))
                    break
    found = pages.containment(table, least_height=0)
    assert expected and {tuple(r) for r in found.collect()} == expected
    depth = {r.node: r.depth for r in graph.depths(found).collect()}
    assert set(depth) == {x for e in expected for x in e} and all(depth[b] > depth[a] for a, b in expected)


def test_chunks_equal_brute_force(spark):
    rows, table = node_rows(spark)
    by_page, expected = {}, set()
    for r in rows:
        by_page.setdefault(r["page_id"], []).append(r)
    for own in by_page.values():
        size = [sum(len(x["text"]) for x in own[r["node_id"] : r["last_id"] + 1]) for r in own]
        expected |= {(r["page_id"], r["node_id"], size[i]) for i, r in enumerate(own) if 0 < size[i] <= 200 and (r["parent_id"] < 0 or size[r["parent_id"]] > 200)}
    assert {(r.page_id, r.node_id, r.n_chars) for r in pages.chunks(table, 200).collect()} == expected


def test_depths_follow_the_smallest_parent(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("a", "c"), ("x", "c"), ("c", "d"), ("p", "q"), ("q", "p"), ("q", "r")], "src string, dst string")
    assert {r.node: r.depth for r in graph.depths(edges).collect()} == {"a": 0, "x": 0, "b": 1, "c": 1, "d": 2, "p": 0, "q": 0, "r": 0}
    assert {tuple(r) for r in graph.reduced(edges).collect()} == {("a", "b"), ("b", "c"), ("x", "c"), ("c", "d"), ("p", "q"), ("q", "p"), ("q", "r")}
    assert {r.node: r.depth for r in graph.depths(graph.reduced(edges)).collect()}["c"] == 1
    assert graph.reduced(edges.limit(0)).count() == 0
    assert graph.depths(edges.limit(0)).count() == 0


def test_component_of_ignores_direction(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 3), (4, 5)], "src long, dst long")
    seeds = spark.createDataFrame([(1,), (5,), (9,)], "origin long")
    assert {tuple(r) for r in graph.component_of(edges, seeds).collect()} == {(1, 1), (1, 2), (1, 3), (5, 4), (5, 5), (9, 9)}


def test_personalised_ranks_keep_their_mass(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("b", "c")], "src string, dst string")
    prior = {"a": 0.5, "b": 0.25, "c": 0.25}
    rank = dict(prior)
    for _ in range(20):
        rank = {n: 0.15 * prior[n] + 0.85 * ({"a": 0.0, "b": rank["a"] / 2, "c": rank["a"] / 2 + rank["b"]}[n] + rank["c"] * prior[n]) for n in prior}
    found = graph.personalised_pagerank(edges, spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 1.0)], "node string, weight double"))
    found = {r.node: r["rank"] for r in found.collect()}
    assert sum(found.values()) == pytest.approx(1) and found == pytest.approx(rank)


def test_rollback_restores_what_was_before(spark):
    log = spark.createDataFrame([(1, "t", None, "a"), (2, "t", "a", "b"), (3, "t", "b", None), (4, "u", None, "x"), (5, "v", None, "y"), (6, "v", "y", "z")], "edit_id int, target string, before string, after string")
    assert {tuple(r) for r in logs.rolled_back(log, F.col("edit_id").between(2, 4)).collect()} == {("t", "a", 2), ("u", None, 1), ("v", "z", 0)}
    assert {r.target: r.state for r in logs.rolled_back(log, F.lit(None).cast("boolean")).collect()} == {"t": None, "u": "x", "v": "z"}


def test_frequencies_after_changes(spark):
    post = lambda rows: spark.createDataFrame(rows, "doc int, term string")
    old = post([(1, "a"), (1, "b"), (2, "b"), (3, "c")])
    stats = old.groupBy("term").agg(F.count("*").alias("df"))
    after = search.document_frequencies_after(stats, old, spark.createDataFrame([(3,), (8,)], "doc int"), post([(1, "a"), (1, "d"), (3, "e"), (4, "b")]))
    assert {tuple(r) for r in after.collect()} == {("a", 1), ("b", 2), ("d", 1)}


@pytest.mark.parametrize("fold", [search.signed_hash_vectors, search.random_projection])
def test_hashed_vectors_have_length_one(spark, fold):
    rows = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (2, "a", 4.0), (2, "b", 2.0), (3, "c", 0.0)], "doc int, term string, weight double")
    by = {}
    for r in fold(rows).collect():
        by.setdefault(r.doc, {})[r.dim] = r.weight
    assert sum(x * x for x in by[1].values()) == pytest.approx(1) and by[1] == pytest.approx(by[2]) and not any(by[3].values())
