"""Triple products, panels and inverses on made rows: missing ranks, names and vectors, ties, repeats, empty tables."""

from weftline import catalog
from weftline.operators import ranking, search

FOLDER = "/root/testdata/sf0.001"


def _rows(spark):
    words = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.5), (1, 3, 0.4), (1, 4, 0.9), (1, 5, 0.2), (1, 6, 0.1), (2, 1, 0.5)], "query long, doc long, score double")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0]), (4, [1.0, 1.0]), (5, [2.0, 0.0])], "id long, vector array<double>")
    ranks = spark.createDataFrame([(2, 0.0), (3, 3.0), (5, 2.5), (6, -1.0), (1, None)], "id long, rank double")
    names = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three"), (4, " "), (5, "five"), (6, "six"), (7, None)], "id long, name string")
    return ranking.likeness(words, vectors, ranks, names)


def test_triple_product(spark):
    rows = _rows(spark)
    assert {(r.focal, r.id): (r.pagerank, r.tfidf, r.cosine) for r in rows.collect()} == {(1, 2): (1.0, 0.5, 1.0), (1, 3): (3.0, 0.4, -1.0), (1, 5): (2.5, 0.2, 1.0), (1, 6): (1.0, 0.1, 0.0), (2, 1): (1.0, 0.5, 1.0)}
    assert sorted((r.focal, r.rank, r.id, r.score) for r in ranking.triple_product(rows, 2).collect()) == [(1, 1, 2, 0.5), (1, 2, 5, 0.5), (2, 1, 1, 0.5)]
    assert sorted((r.focal, r.id) for r in ranking.triple_product(rows, 9, least=-9.0).collect()) == [(1, 2), (1, 3), (1, 5), (1, 6), (2, 1)]
    assert ranking.triple_product(rows.where("focal > 9"), 3).count() == 0


def test_panel(spark):
    got = {(r.focal, r.id): r.score for r in ranking.panel(_rows(spark), 9).collect()}
    assert got == {(1, 2): 1.0, (1, 3): 2.25, (1, 5): 2.5, (1, 6): 0.5, (2, 1): 0.0}  # 0.3 of 0.4 in words, all of the vectors' range, half of it


def test_inverse_and_ports(spark):
    recorded = spark.createDataFrame([(1, 8, 5), (1, 9, 7), (1, 8, 9), (1, 1, 99), (3, 4, None)], "focal long, id long, at int")
    similar = spark.createDataFrame([(1, 9, 0.9), (1, 2, 0.5), (1, 3, 0.5), (1, 1, 1.0), (2, 7, 0.1)], "focal long, id long, score double")
    inverse = ranking.closest_inverse(recorded, similar, 3)
    assert sorted((r.focal, r.rank, r.id, r.score, r.provenance) for r in inverse.collect()) == [(1, 1, 8, 1.0, "recorded"), (1, 2, 9, 1.0, "recorded"), (1, 3, 2, 0.5, "similar"), (2, 1, 7, 0.1, "similar"), (3, 1, 4, 1.0, "recorded")]
    assert [(r.id, r.provenance) for r in ranking.closest_inverse(recorded, similar, 1).where("focal = 1").collect()] == [(8, "recorded")]
    samples = spark.createDataFrame([(9, "text"), (2, "number"), (7, None)], "id long, kind string")
    ports = spark.createDataFrame([(1, "a", "number"), (1, "b", None), (1, "c", "image"), (2, "a", "text"), (2, "b", None)], "focal long, port string, kind string")
    assert sorted(tuple(r) for r in ranking.port_inputs(inverse, samples, ports).collect()) == [(1, "a", 2, 0.5), (1, "b", 9, 1.0), (2, "b", 7, 0.1)]
    assert ranking.closest_inverse(recorded.limit(0), similar.limit(0), 3).count() == 0


def test_pairs_are_not_shuffled_before_the_best_are_chosen(spark, monkeypatch):
    """Pairs of focal documents and others are quadratic: of each chunk only the best of a task may leave it, and chunks give the rows of one."""
    plans, keep, query = [], search.kept, catalog.queries()["triple_product_rank"]
    monkeypatch.setattr(search, "kept", lambda df: plans.append(df) or keep(df))
    whole = query(spark, FOLDER).collect()
    text = plans[-1]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    pairs = text[text.index("WindowGroupLimit", text.index("Exchange hashpartitioning")) :]
    assert " Partial" in pairs.split("\n")[0] and "Exchange hashpartitioning" not in pairs and "SortMergeJoin" not in pairs
    monkeypatch.setattr(search, "CHUNK_QUERIES", 1)
    assert sorted(query(spark, FOLDER).collect()) == sorted(whole) != []
