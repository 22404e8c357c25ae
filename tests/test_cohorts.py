"""Sibling cohorts, spectral cuts, settled signatures, PQ-trees and child-tag patterns against brute force."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F
from test_mining import made  # noqa: F401

from weftline.operators import cohorts, templates
from weftline.sources import kept


def kids_of(rows):
    out = {}
    for r in rows:
        if r.parent_id >= 0 and r.tag not in templates.SKIPPED:
            out.setdefault(r.parent_id, []).append(r)
    return out


def brute_cohorts(rows):
    kids, found = kids_of(rows), {}
    for r in rows:
        ends = []
        for k in kids.get(r.node_id, []) if r.tag not in templates.SKIPPED else []:
            while len(kids.get(k.node_id, [])) == 1:
                k = kids[k.node_id][0]
            ends.append(k.node_id)
        if len(ends) >= 2:
            found[r.node_id] = ends
    return found


def test_cohorts_and_settled_signatures_equal_brute_force(made):  # noqa: F811
    rows, by_page = made
    expected, groups = set(), set()
    for p, own in by_page.items():
        kids = kids_of(own)

        def signature(i, depth):
            return (own[i].tag, tuple(signature(k.node_id, depth - 1) for k in kids.get(i, [])) if depth else ())

        for c, ends in brute_cohorts(own).items():
            expected |= {(p, c, i) for i in ends}
            parts = [len({signature(i, d) for i in ends}) for d in range(7)]
            depth = next((max(1, d - 1) for d in range(1, 7) if parts[d] == parts[d - 1]), 6)
            groups |= {(p, c, i, depth, signature(i, depth)) for i in ends}
    assert {tuple(r) for r in cohorts.cohorts(rows).select("page_id", "cohort_id", "node_id").collect()} == expected
    got = [tuple(r) for r in cohorts.settled_groups(rows).select("page_id", "cohort_id", "node_id", "depth", "signature").collect()]
    assert {x[:4] for x in got} == {x[:4] for x in groups}
    name = {x[:3]: x[4] for x in groups}
    assert len({(name[x[:3]], x[4]) for x in got}) == len({x[4] for x in got}) == len({x[4] for x in groups})  # one to one


# ---- spectral cuts


def conductance(w, left):
    d = w.sum(1)
    return w[np.ix_(left, ~left)].sum() / min(d[left].sum(), d[~left].sum())


def whole(terms, counts):
    """The affinity of all nodes, like ones too, none with itself."""
    w = cohorts.affinity(terms, np.array(counts))
    at = np.repeat(np.arange(len(terms)), counts)
    out = w[np.ix_(at, at)].copy()
    np.fill_diagonal(out, 0)
    return out, at


def planted(rnd, blocks=2, each=3):
    """Term sets of blocks that share few terms, and how many nodes have each set."""
    sets = {tuple(sorted({"tag:x", *(f"b{b}:{rnd.randrange(4)}" for _ in range(3)), f"b{b}"})) for b in range(blocks) for _ in range(each)}
    return [list(s) for s in sorted(sets)], [rnd.randint(1, 3) for _ in sets]


def test_cuts_equal_exhaustive_cuts_on_few_nodes():
    rnd, seen = random.Random(4), 0
    for _ in range(40):
        terms, counts = planted(rnd)
        w, at = whole(terms, counts)
        if len(w) > 12 or (w.sum(1) <= 1e-10).any():
            continue
        left, cut, second = cohorts.cheeger_cut(cohorts.affinity(terms, np.array(counts)), np.array(counts))
        assert abs(conductance(w, left[at]) - cut) < 1e-9
        d = w.sum(1)
        values = np.linalg.eigvalsh(np.eye(len(w)) - w / np.sqrt(np.outer(d, d)))
        assert second > 1 or abs(values[1] - second) < 1e-8
        sides = (np.array(s) for s in itertools.product([False, True], repeat=len(w) - 1))
        best = min(conductance(w, np.append(s, False)) for s in sides if s.any())
        assert best - 1e-9 <= cut <= np.sqrt(2 * max(second, 0)) + 1e-6  # Cheeger's bound
        if cut < 0.2:
            seen += 1
            assert abs(best - cut) < 1e-9
    assert seen > 5


def test_planted_blocks_are_found():
    rnd = random.Random(9)
    for blocks in (2, 3):
        terms, counts = planted(rnd, blocks, 4)
        got = cohorts.spectral_clusters(terms, counts)
        names = {}
        for t, c in zip(terms, got):
            names.setdefault(c, set()).update(x for x in t if x in ("b0", "b1", "b2"))
        names.pop(-1, None)  # single nodes
        assert all(len(v) == 1 for v in names.values()), (names, terms, counts, got)
    assert cohorts.spectral_clusters([["a"], ["b"]], [1, 1]) == [0, 0] and cohorts.spectral_clusters([["a"]], [1]) == [-1]
    assert cohorts.spectral_clusters([["a"]], [9]) == [0] and cohorts.spectral_clusters([[], ["a"], ["b"], ["c"]], [1, 1, 1, 1]) == [0, 0, 0, 0]


def test_spectral_cohorts_cover_all_siblings(made):  # noqa: F811
    rows, by_page = made
    got = cohorts.spectral_cohorts(rows.where("page_id < 1020")).collect()
    assert {(r.page_id, r.cohort_id, r.node_id) for r in got} == {(p, c, i) for p, own in by_page.items() if p < 1020 for c, ends in brute_cohorts(own).items() for i in ends}
    terms = {(r.page_id, r.node_id): r.terms for r in cohorts.structural_terms(rows).collect()}
    cluster = {}
    for r in got:
        assert cluster.setdefault((r.page_id, r.cohort_id, tuple(terms[r.page_id, r.node_id])), r.cluster) == r.cluster
    first = next(r for r in by_page[0] if r.tag == "a")
    assert terms[0, first.node_id] == sorted(["tag:a", "@href", "children:0", "depth:5", "parent:tag:h2"])


# ---- PQ-trees and patterns


def brute_pq(kids, nodes, depth, place="", above=None, position=0):
    """Rows of the tree of nodes that share a tag."""
    orders = [tuple(k.tag for k in kids.get((n.page_id, n.node_id), [])) for n in nodes]
    full = [o for o in orders if o] if depth else []
    kind = "leaf" if not full else "Q" if len(set(full)) == 1 else "P" if len({tuple(sorted(o)) for o in full}) == 1 else "longest"
    yield place, above, position, "Q" if kind == "longest" else kind, nodes[0].tag, len(nodes)
    parts = {}
    longest = max(full, key=len, default=())
    for n in nodes if full else []:
        own = kids.get((n.page_id, n.node_id), [])
        if kind == "Q":
            for i, k in enumerate(own):
                parts.setdefault(i, []).append(k)
        elif kind == "P":
            for k in own:
                parts.setdefault(sorted(set(longest)).index(k.tag), []).append(k)
        else:
            for i, tag in enumerate(longest):
                parts.setdefault(i, []).extend([k for k in own if k.tag == tag][:1])
    for i in sorted(parts):
        yield from brute_pq(kids, parts[i], depth - 1, f"{place}/{i}", place, i)


def test_pq_trees_and_patterns_equal_brute_force(spark, made):  # noqa: F811
    rows, by_page = made
    shapes = ["<x><a></a><b><i></i></b></x>", "<x><b><i></i><u></u></b><a></a></x>", "<y><a></a></y>", "<y><p></p><a></a><p><i></i></p></y>", "<y></y>", "<z><a></a><b></b></z>", "<z><a></a><b></b></z>"]
    from weftline.operators import pages

    more = kept(pages.nodes(spark.createDataFrame([(9000 + i, "", s * (i % 2 + 1)) for i, s in enumerate(shapes)], "page_id long, url string, html string")))
    rows, by_page = kept(rows.union(more)), dict(by_page)
    for r in sorted(more.collect(), key=lambda r: (r.page_id, r.node_id)):
        by_page.setdefault(r.page_id, []).append(r)
    instances = rows.where("tag not in ('#document', 'html', 'head', 'body', 'script', 'style', 'meta', 'link')").selectExpr("tag as pattern", "page_id", "node_id")
    every = [r for own in by_page.values() for r in own]
    kids = {(p, n): k for p, own in by_page.items() for n, k in kids_of(own).items()}
    by_tag = {}
    for r in sorted(every, key=lambda r: (r.page_id, r.node_id)):
        if r.tag not in templates.SKIPPED + templates.FRAME:
            by_tag.setdefault(r.tag, []).append(r)
    expected = {(t, *row) for t, nodes in by_tag.items() for row in brute_pq(kids, nodes, 4)}
    got = cohorts.pq_trees(rows, instances)
    assert {(r.pattern, r.place, r.above, r.position, r.kind, r.tag, r.n) for r in got.collect()} == expected
    assert {k for _, _, _, _, k, _, _ in expected} == {"leaf", "P", "Q"} and max(p.count("/") for _, p, *_ in expected) >= 3

    heights = spark.createDataFrame([(t, min(r.height for r in nodes)) for t, nodes in by_tag.items()], "pattern string, least_height int")
    patterns = kept(cohorts.compiled(kept(got), heights))
    matched = set()
    for p in patterns.collect():
        for r in every:
            there = [k.tag for k in kids.get((r.page_id, r.node_id), [])]
            walk = iter(there)
            fits = all(t in walk for t in p.wanted) if p.kind == "Q" else all(there.count(t) >= p.wanted.count(t) for t in p.wanted)
            if r.tag == p.tag and r.height >= p.least_height and fits and r.tag not in templates.SKIPPED:
                matched.add((p.pattern, r.page_id, r.node_id))
    assert matched and {tuple(r) for r in cohorts.pattern_matches(rows, patterns).collect()} == matched


def test_pq_trees_write_each_level_twice_at_most(spark, made, monkeypatch):  # noqa: F811
    """A level's instances with their children, and its forms; before, the instances were written once more."""
    rows, _ = made
    instances, written = rows.where("height >= 1").select(F.col("template").alias("pattern"), "page_id", "node_id"), []
    monkeypatch.setattr(cohorts, "kept", lambda df, f=cohorts.kept: written.append(df) or f(df))
    monkeypatch.setattr(cohorts, "kept_large", lambda df, f=cohorts.kept_large: written.append(df) or f(df))
    assert cohorts.pq_trees(rows, instances, depth=3).count() > 0
    assert len(written) == 1 + 2 * 3 + 1
