"""Steps whose cost must grow no faster than their input, or, where pairs are the result, with small parts of it in a task."""

import numpy as np

from weftline.operators import fields, graph, search, vectors
from weftline.sources import kept, shuffled_into


def plan(df):
    return df._jdf.queryExecution().toString()


def test_neighbours_are_scored_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(1)
    data = [(i, i % 2, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(60)]
    data += [(60, 0, None), (61, 0, [1.0, None, 0.0, 0.0]), (62, None, [1.0, 0.0, 0.0, 0.0]), (63, 0, [1.0, 0.0]), (64, 1, [0.0] * 4), (65, 0, [2.0, 0.0])]
    rows = spark.createDataFrame(data, "id long, g int, v array<double>")
    found = vectors.neighbours(rows, "g", "id", "v", 3, 0.1)
    assert "CoGroups" in plan(found)  # no join makes a row of every pair
    expected = []
    for a, g, v in data:
        pairs = []
        for b, h, w in data:
            if a != b and g is not None and g == h and v and w and None not in v + w and len(v) == len(w):
                size = np.linalg.norm(v) * np.linalg.norm(w)
                pairs.append((-round(float(np.dot(v, w) / size) if size else 0.0, 6), b))
        expected += [(a, b, -s, i + 1) for i, (s, b) in enumerate(sorted(p for p in pairs if p[0] <= -0.1)[:3])]
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_norms_shuffle_no_postings(spark, monkeypatch):
    monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(search, "TASK_BYTES", 8)
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None), (4, "a b c d e f")], "doc long, text string")
    index = search.build_index(docs, "doc", "text")
    assert index.parts >= 4  # 24 bytes of text
    assert "hashpartitioning(term" not in plan(index.norms) and "hashpartitioning(term" not in plan(search.term_stats(index.counts, 4))
    single, double = 1 + np.log(5 / 2), 1 + np.log(5 / 3)
    got = {r.doc: r.norm for r in index.norms.collect()}
    assert set(got) == {1, 2, 4}
    three = 1 + np.log(5 / 4)
    assert abs(got[2] ** 2 - (three**2 + 2 * double**2)) < 1e-9  # b in three, c and "b c" in two documents
    assert abs(got[1] ** 2 - ((2 * double) ** 2 + three**2 + double**2 + single**2)) < 1e-9  # a twice, b, "a b", "b a"


def test_frequencies_of_a_changed_index_shuffle_no_postings_by_document(spark):
    postings = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "c")], "doc long, term string")
    stats = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("c", 1)], "term string, df int")  # need not be summed up
    out, new = spark.createDataFrame([(3,), (3,)], "doc long"), spark.createDataFrame([(1, "d"), (3, "e")], "doc long, term string")
    found = search.document_frequencies_after(stats, postings, out, new)
    assert set(map(tuple, found.collect())) == {("a", 1), ("d", 1)}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in plan(search.document_frequencies_after(stats, postings, out, new))
        left, right = spark.createDataFrame([(1, "x"), (1, "y")], "l int, token string"), spark.createDataFrame([(5, "x"), (5, "z"), (6, "w")], "r int, token string")
        weight = right.groupBy("token").count().select("token", (search.F.col("count") * 1.0).alias("w"))
        pairs = search.jaccard(left, right, weight)
        assert "SortMergeJoin" not in plan(pairs).split("== Physical Plan ==")[1].split("hashpartitioning(r")[-1]
        assert [(r.l, r.r, r.score) for r in pairs.collect()] == [(1, 5, 0.5)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_partitions_are_set_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with shuffled_into(spark, 77):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "77"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_content_trees_compute_a_value_once(spark):
    tree = fields.content_tree(search.F.create_map(search.F.lit("/a/text()"), search.F.array(search.F.lit(" "), search.F.lit("x y"))))
    df = spark.range(1).select(tree.alias("t"))
    assert df.first().t == "x y"
    assert df._jdf.queryExecution().analyzed().toString().count("map_entries") == 1


def test_ranks_of_idle_nodes_are_made_once(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "x"), ("b", "y"), ("b", "gone"), ("c", "c")], "src string, dst string")
    weights = {"a": 1.0, "b": 2.0, "c": 1.0, "x": 3.0, "y": 1.0}
    found = graph.personalised_pagerank(edges, spark.createDataFrame(list(weights.items()), "node string, weight double"), rounds=7)
    prior = {k: v / 8 for k, v in weights.items()}
    rank, deg = dict(prior), {"a": 2, "b": 3, "c": 1}
    for _ in range(7):
        idle = rank["x"] + rank["y"]
        gain = {k: sum(rank[s] / deg[s] for s, d in [("a", "b"), ("b", "a"), ("a", "x"), ("b", "y"), ("c", "c")] if d == k) for k in rank}
        rank = {k: 0.15 * prior[k] + 0.85 * (gain[k] + idle * prior[k]) for k in rank}
    got = {r.node: r["rank"] for r in found.collect()}
    assert got.keys() == rank.keys() and all(abs(got[k] - rank[k]) < 1e-12 for k in rank)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2  # the last round alone


PAGE = "<body><ul>" + "<li><a href='/x'>x</a><b>y</b></li>" * 40 + "</ul></body>"


def test_accessors_are_learned_from_paths_not_from_instances(spark):
    from weftline.operators import pages

    rows = fields.readable(pages.nodes(spark.createDataFrame([(1, "/1", PAGE), (2, "/2", None)], "page_id long, url string, html string"), hashes=False))
    found = fields.learned(rows, fields.patterns(rows), "page_id")
    assert "instance" not in plan(found) and "value" not in found.columns
    expected = {(1, "/body/ul/li", "/li/a/@href"), (1, "/body/ul/li", "/li/a/text()"), (1, "/body/ul/li", "/li/b/text()")}
    assert set(map(tuple, found.collect())) == expected
    assert set(map(tuple, fields.accessors(fields.instance_values(rows, fields.patterns(rows)), "page_id").collect())) == expected


def test_pattern_query_looks_up_each_path_of_all_pages_once(spark, monkeypatch):
    from weftline.operators import pages

    looked = []
    monkeypatch.setattr(fields, "side", lambda df: looked.append(sorted(map(tuple, df.select("gx", "address", "levels").collect()))) or df)
    rows = pages.nodes(spark.createDataFrame([(i, f"/{i}", PAGE) for i in range(3)], "page_id long, url string, html string"))
    found = fields.pattern_query(rows, fields.learned(rows, fields.patterns(rows)))
    assert looked == [[("/body/ul/li/a", "@href", [3]), ("/body/ul/li/a", "text()", [3]), ("/body/ul/li/b", "text()", [3])]]
    got = found.collect()
    assert len(got) == 120 and all(r.pattern == "/body/ul/li" and r.fields == {"/li/a/@href": ["/x"], "/li/a/text()": ["x"], "/li/b/text()": ["y"]} for r in got)


def test_orphans_and_templates_move_a_page_once(spark):
    from weftline.operators import pages, templates

    html = "<body><a href='/1'>a<br></a><i>b</i><i>c</i><div><p>d</p><b>e</b></div><div><p>f</p><b>g</b></div></body>"
    rows = templates.outlined(pages.nodes(spark.createDataFrame([(1, "/1", html), (2, "/2", None)], "page_id long, url string, html string"), hashes=("template",)))
    groups = templates.template_groups(rows.where("tag <> 'i'")).select("page_id", "node_id", "last_id", "tag")
    assert sorted((r.tag, r.node_id, r.last_id) for r in groups.collect()) == [("div", 6, 8), ("div", 9, 11)]
    found = templates.orphan_groups(rows, groups, groups.limit(0))
    scan = plan(templates.orphan_groups(rows, spark.createDataFrame([(1, 6, 8), (1, 9, 11)], "page_id long, node_id int, last_id int"), spark.createDataFrame([], "page_id long, node_id int, last_id int")))
    physical = scan.split("== Physical Plan ==")[1]
    assert "Join" not in physical and physical.count("Exchange hashpartitioning") == 1
    assert [tuple(r) for r in found.collect()] == [(1, 1, "text", 2, 4)]


def test_marked_ancestors_are_found_without_paths(spark):
    from weftline.operators import pages

    html = "<div><u><p>a</p></u></div><div><s><p>b</p></s></div><div><u><p>c</p></u></div><div><s><p>d</p></s></div><nav><q><p></p></q></nav><nav><q><p></p><h1></h1></q></nav>"
    rows = pages.nodes(spark.createDataFrame([(1, "/1", html)], "page_id long, url string, html string"), hashes=("template",))
    assert "exact" not in rows.columns and "shape" not in rows.columns
    kinds = {r.template: r.tag for r in rows.collect()}
    found = pages.containment(rows, least_height=0)
    assert "xpath" not in plan(found) and "Generate" not in plan(found)
    assert sorted((kinds[r.src], kinds[r.dst]) for r in found.collect()) == [("div", "s"), ("div", "u"), ("s", "p"), ("u", "p")]


def test_shortcuts_of_long_paths_go(spark):
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(13)]
    edges = spark.createDataFrame([*chain, ("n00", "n13"), ("n00", "n12"), ("p", "q"), ("q", "r"), ("r", "p")], "src string, dst string")
    found = graph.reduced(kept(edges))
    assert {tuple(r) for r in found.collect()} == {*chain, ("p", "q"), ("q", "r"), ("r", "p")}
    assert {r.node: r.depth for r in graph.depths(found).collect()}["n13"] == 13
