"""A stored index against one kept in dictionaries, over versions, nulls, repeats and ids with parts."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.operators import index_store, search

SCHEMA = "doc string, text string, url string, term string"


def _terms(text):
    words = re.findall(r"\w+", text.lower())
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])


class Plain:
    def __init__(self):
        self.text, self.urls = {}, {}

    def put(self, rows):
        one, seen = {}, {}
        for doc, text, url, _ in rows:
            if doc is not None:
                one[doc] = max(one.get(doc, ""), text or "")
                seen.setdefault(doc, set()).update([url] if url is not None else [])
        fresh, first = [d for d in one if d not in self.text], {}
        for doc in sorted(fresh):
            first.setdefault(one[doc], doc)
        owner = {d: first[one[d]] if d in fresh else d for d in one}
        for doc, to in owner.items():
            self.urls.setdefault(to, set()).update(seen[doc])
            self.text[to] = one[to]

    def take_out(self, ids, parts=False):
        for doc in list(self.text):
            if any(doc.startswith(f"{i}_") if parts else doc == i for i in ids):
                del self.text[doc], self.urls[doc]

    def scores(self, query):
        n, df = len(self.text), Counter(t for text in self.text.values() for t in _terms(text))
        idf = lambda t: math.log((n + 1) / (df[t] + 1)) + 1
        q = {t: c * idf(t) for t, c in _terms(query).items() if df[t]}
        out = {}
        for doc, text in self.text.items():
            w = {t: c * idf(t) for t, c in _terms(text).items()}
            if set(w) & set(q):
                out[doc] = sum(w[t] * q[t] for t in q if t in w) / math.sqrt(sum(x * x for x in w.values()) * sum(x * x for x in q.values()))
        return out


def _equal(spark, folder, plain):
    store = index_store.load(spark, folder)
    assert {r.doc for r in store.docs.collect()} == set(plain.text) and store.docs.count() == len(plain.text)
    assert {(r.doc, r.url) for r in store.sightings.collect()} == {(d, u) for d, us in plain.urls.items() for u in us}
    assert {(r.doc, r.term): r.tf for r in store.counts.collect()} == {(d, t): c for d, x in plain.text.items() for t, c in _terms(x).items()}
    assert {r.term: r.df for r in store.stats.collect()} == dict(Counter(t for x in plain.text.values() for t in _terms(x)))
    for query in ("red fox jumps", "", "nothing known"):
        rows = search.search(index_store.index(spark, folder), spark.createDataFrame([(1, query)], "q int, text string"), "q", "text").collect()
        assert {r.doc: pytest.approx(r.score) for r in rows} == plain.scores(query)


FIRST = [("a", "red fox jumps", "u1", "x"), ("b", "red fox jumps", "u2", "x"), ("c_1", "the fox", None, "x"), ("c_2", "a red red hen", "u1", None),
         ("c", "fox fox", "u3", "x"), (None, "red", "u9", "x"), ("d", None, "u1", "x"), ("e", "", "u4", "x"), ("f", "old", "u1", "x"), ("f", "young fox", "u5", "x"), ("c_1_2", "fox hen " * 400, "u1", "x")]
SECOND = [("a", "blue hen", "u6", "x"), ("b", "blue hen", "u7", "x"), ("g", "blue hen", "u8", "x"), ("d", "red fox", "u1", "x"), ("c", None, "u3", "x")]


def test_changes_equal_dictionaries(spark, tmp_path):
    folder, plain = str(tmp_path / "index"), Plain()
    with pytest.raises(FileNotFoundError):
        index_store.load(spark, folder)
    steps = [(FIRST, index_store.put, plain.put), (SECOND, index_store.put, plain.put)]
    store = index_store.empty(spark)
    for version, (rows, change, own) in enumerate(steps, 1):
        assert index_store.save(change(store, spark.createDataFrame(rows, SCHEMA)), spark, folder, 4, 2) == version
        own(rows)
        _equal(spark, folder, plain)
        store = index_store.load(spark, folder)
    for ids, parts in ((["c", "no"], False), (["c"], True), (["c_1"], False)):
        index_store.save(index_store.take_out(store, spark.createDataFrame([(i,) for i in [*ids, None]], "doc string"), parts), spark, folder, 4, 1)
        plain.take_out(ids, parts)
        _equal(spark, folder, plain)
        store = index_store.load(spark, folder)
    assert index_store.load(spark, folder, 1).docs.count() == 7  # b is one with a, e with d
    index_store.save(index_store.empty(spark), spark, folder, 4, 1)
    _equal(spark, folder, Plain())


def test_a_version_without_its_marker_is_not_read(spark, tmp_path):
    import shutil

    folder = str(tmp_path / "index")
    batch = lambda rows: index_store.put(index_store.empty(spark), spark.createDataFrame(rows, SCHEMA))
    index_store.save(batch(FIRST), spark, folder, 4, 1)
    index_store.save(batch(SECOND), spark, folder, 4, 1)
    shutil.rmtree(f"{folder}/v2/whole")
    assert index_store.load(spark, folder).docs.count() == index_store.load(spark, folder, 1).docs.count()
    assert index_store.save(batch(SECOND), spark, folder, 4, 1) == 2


def test_a_search_reads_only_the_buckets_of_its_terms(spark, tmp_path):
    folder = str(tmp_path / "index")
    index_store.save(index_store.put(index_store.empty(spark), spark.createDataFrame(FIRST, SCHEMA)), spark, folder, 16, 1)
    found = search.search(index_store.index(spark, folder), spark.createDataFrame([(1, "hen")], "q int, text string"), "q", "text")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(found.collect()) == 2
    (filtered,) = re.findall(r"Filter \(.*bucket#\d+ (?:=|IN|INSET) .*", plan)
    assert str(spark.range(1).select(search.bucket_of(F.lit("hen"), 16)).first()[0]) in filtered


def test_terms_are_counted_within_rows(spark):
    """No aggregate by document and term, which would spill; rows of an id count together, without pairs across texts."""
    docs = spark.createDataFrame([(1, "a b a b"), (1, "b c"), (2, None), (3, ""), (4, "x"), (None, "y y")], "doc long, text string")
    counts = search.term_counts(docs, "doc", "text")
    expected = {(1, "a", 2), (1, "b", 3), (1, "c", 1), (1, "a b", 2), (1, "b a", 1), (1, "b c", 1), (4, "x", 1), (None, "y", 2), (None, "y y", 1)}
    rows = [tuple(r) for r in counts.collect()]
    assert set(rows) == expected and len(rows) == len(expected)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate(key=" in line.replace("keys", "key") and "term" in line.split("functions")[0]]
