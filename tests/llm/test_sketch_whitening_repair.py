"""HyperMinHash deduplication, whitening by spectrum slicing and conversation repair against brute force and edge cases."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from oracle import connect, same
from pyspark.sql import functions as F
from test_llm import DOCS, LONG, made, near_copies, shingles

from weftline.llm import conversation_repair as repair
from weftline.llm import hyperminhash, queries, whitening

FOLDER = "/root/testdata/sf0.001"


# ---- 13: HyperMinHash


def brute_components(rows, percent=80):
    sets = sorted((i, shingles(t, 4)) for i, t in rows)
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets}


def found(df, **options):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in hyperminhash.near_duplicates(df, **options).collect()}


def test_dedup_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert found(docs) == brute_components(docs.select("doc_id", "text").collect())


def test_dedup_of_groups_on_the_edge(spark):
    """Near copies around the threshold, whose keys aren't linked by their smallest text alone, in tiles of four."""
    texts = near_copies(1, 60, 80, 12) + near_copies(2, 30, 40, 5) + near_copies(3, 120, 60, 7)
    texts += ["one two", "One  two", "", None, " \n", LONG, LONG, "a b c d e", "a b c d f", "a b c d e f g h", "a b c d e f g h i"]
    df, expected = made(spark, texts), brute_components(list(enumerate(texts)))
    assert found(df) == expected
    assert found(df, tile=4) == expected


def test_dedup_of_odd_rows(spark):
    assert found(made(spark, []).limit(0)) == {}
    rows = [(None, "a b c d e"), (None, None), (3, "a b c d e"), (3, "a b c d e"), (1, "A b c d e"), (2, None)]
    df = spark.createDataFrame([(i, t, None, 7, 7, 7) for i, t in rows], DOCS).withColumns({x: F.lit(0) for x in ("rep", "key", "node", "sketch", "least")})
    got = sorted(((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in hyperminhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(-1, 2, None, True), (-1, 0, None, True), (3, 2, 1, False), (3, 2, 1, False), (1, 2, 1, True), (2, 0, 2, True)], key=str)


def test_registers_hold_zeros_and_mantissa():
    for h in (1, 2, 3, 2**63, 2**64 - 1, 2**40 + 5, 2**53 + 1, 12345678901234567):
        top = h >> 11
        bits = top.bit_length()
        after = top >> bits - 11 & 1023 if bits > 10 else top << 11 - bits & 1023
        assert int(hyperminhash.compressed(np.array([h], np.uint64))[0]) == ((53 - bits) << 10 | after)


def test_estimates_lie_around_the_similarity_and_collisions_are_corrected():
    rng = np.random.default_rng(3)
    for size, common in ((5, 4), (40, 32), (2000, 1600), (300, 90)):
        errors = []
        for _ in range(60):
            u = rng.integers(0, 2**64 - 1, size, dtype=np.uint64)
            a, b = np.sort(u[: (size + common) // 2]), np.sort(np.concatenate([u[:common], u[(size + common) // 2 :]]))
            r = hyperminhash.registers([a, b])
            errors.append(float(hyperminhash.estimate((r[0] == r[1]).sum(), hyperminhash.by_chance(len(a), len(b)))) - common / size)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    apart = hyperminhash.registers([rng.integers(0, 2**64 - 1, 100, dtype=np.uint64) for _ in range(300)])
    equal = np.mean([(x == y).mean() for x, y in itertools.combinations(apart, 2)])
    assert abs(equal - hyperminhash.by_chance(np.array([100]), np.array([100]))[0]) < 1e-4


def test_bands_miss_hardly_any_pair():
    assert (1 - 0.8**hyperminhash.ROWS) ** hyperminhash.BANDS < 1e-8
    assert math.isclose(hyperminhash.least_estimate(80), 0.632, abs_tol=0.001)


# ---- 11: whitening


def brute_whitening(rows, components=4, scale=256):
    """By a dense eigenvalue solver on exact integers."""
    held = [(i, [math.floor(scale * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(x) for _, x in held), default=0)
    held = [(i, x + [0] * (width - len(x))) for i, x in held]
    fit = np.array(sorted({tuple(x) for _, x in held}))
    n, sums = len(fit), fit.sum(0)
    d = (n * fit - sums) / n
    v = d.T @ d / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return {(i, k + 1): (n, sum((n * int(c) - int(s)) ** 2 for c, s in zip(x, sums)), (np.array(x) - sums / n) @ u[:, k] / e[k] ** 0.5, e[k] / np.trace(v)) for i, x in held for k in range(components)}


def test_whitening_equals_dense_solver(spark):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    expected = brute_whitening([(r.vec_id, r.embedding) for r in df.collect()])
    got = queries.op11_embedding_whitening(spark, FOLDER).collect()
    assert len(got) == len(expected)
    sign = {}
    for r in got:
        n, deviation, value, explained = expected[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert math.isclose(r.explained, explained, rel_tol=1e-9) and r.identity_error < 1e-9
        s = sign.setdefault(r.component, 1 if r.whitened * value > 0 else -1) if abs(value) > 1e-3 else None
        assert s is None or abs(s * r.whitened - value) < 1e-8


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 0.5]), (1, [1.0, 0.0, 0.5]), (2, [0.0, 1.0]), (3, None), (4, [1.0, None, 0.0]), (5, [nan, 0.0, 0.0]), (6, [0.0, inf, 0.0]), (None, [0.25, 0.5, -1.0]), (8, [-0.0, -0.5, 0.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "n": F.lit(2), "component": F.lit(3)})
    got = whitening.whiten(df).collect()
    expected = brute_whitening(rows, components=3)
    assert len(got) == 6 * 3  # three dimensions, all rows of sound vectors
    for r in got:
        n, deviation, value, explained = expected[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation) == (5, deviation)
        assert abs(abs(r.whitened) - abs(value)) < 1e-9 and math.isclose(r.explained, explained, rel_tol=1e-9)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id = 1")).count() == 0  # one distinct vector has no variance
    assert whitening.whiten(df.where("vec_id = 3 or vec_id = 9")).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(4)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(line).collect()} == {1}
    huge = spark.createDataFrame([(i, [1e12 * i, 1.0 * i * i]) for i in range(4)], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(huge).collect()} == {None}  # beyond 64 bits


def test_slicing_counts_and_certifies_eigenvalues():
    rng = np.random.default_rng(4)
    for trial in range(60):
        d = int(rng.integers(1, 24))
        a = rng.standard_normal((d, d))
        q = np.linalg.qr(a)[0]
        e = np.sort(rng.random(d))[::-1]
        e[1:3] = e[0] if trial % 3 == 0 else e[1:3]  # multiple eigenvalues
        e[d // 2 :] *= 0 if trial % 3 == 1 else 1  # and zeros
        v = q @ np.diag(e) @ q.T * 10.0 ** rng.integers(-6, 7)
        v = (v + v.T) / 2
        values = np.linalg.eigvalsh(v)[::-1]
        for s in rng.standard_normal(5) * values[0]:
            assert whitening.positive_pivots(v - s * np.eye(d)) == (values > s).sum()
        slicer, got = whitening.Slicer(v), []
        while len(got) < 4 and (pair := slicer.next()):
            got.append(pair[0])
        assert len(got) == min(4, (values > 1e-12 * values[0]).sum())
        assert np.allclose(got, values[: len(got)], rtol=1e-10, atol=1e-12 * values[0])
        u = slicer.vectors
        assert np.abs(u.T @ u - np.eye(len(got))).max(initial=0) < 1e-10 and np.abs(v @ u - u * np.array(got)).max(initial=0) <= 1e-11 * values[0]


# ---- 12: conversation repair

ALLOWED = ("", "ua", "sua", "uaua", "suaua", "uauaua", "suauaua", "uauauaua", "suauauaua")


def brute_edits(rows):
    """The least (cost, edits) over all targets, by an alignment table that holds whole strings."""
    best = None
    for target in ALLOWED:
        table = {(0, 0): (0, "")}
        for i, j in itertools.product(range(len(rows) + 1), range(len(target) + 1)):
            ways = [table[0, 0]] if i == j == 0 else []
            if j and target[j - 1] != "s":
                ways.append((table[i, j - 1][0] + 2, table[i, j - 1][1] + "I"))
            if i:
                initial, bad, cut = rows[i - 1]
                ways.append((table[i - 1, j][0] + 3, table[i - 1, j][1] + "D"))
                if j and not bad:
                    cost, edits = table[i - 1, j - 1]
                    if initial == target[j - 1]:
                        ways.append((cost + cut, edits + "K"))
                    if target[j - 1] != "s":
                        ways.append((cost + 2 + cut, edits + "R"))
            table[i, j] = min(ways) if ways else (10**9, "")
        best = min(x for x in (best, table[len(rows), len(target)]) if x)
    return best


def solved(rows, sizes):
    """Through segments of the given sizes, as the operator does."""
    cuts = [0, *itertools.accumulate(sizes)]
    parts = [rows[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]
    total, states = repair.chain([repair.summary(p) for p in parts])
    edits = [e for p, s, t in zip(parts, states, states[1:]) for e in repair.solve(p, s, t)]
    return total, "".join(edits) + "I" * repair._ENDING[states[-1]]


def test_edits_equal_brute_force():
    rnd = random.Random(8)
    for _ in range(1500):
        rows = [(rnd.choice("suaaux"), rnd.random() < 0.2, rnd.random() < 0.3) for _ in range(rnd.randrange(1, 8))]
        cut = rnd.randrange(len(rows) + 1)
        expected = brute_edits(rows)
        assert solved(rows, [len(rows)]) == expected
        assert solved(rows, [cut, len(rows) - cut]) == expected
        assert solved(rows, [1] * len(rows)) == expected


CONVERSATIONS = "conv_id long, turn long, role string, text string, segment int, pos int, edits string"


def hostile(spark, n=400, seed=2):
    rnd = random.Random(seed)
    rows = [(rnd.choice([None, 1, 2, 3, -4]), rnd.choice([None, *range(12)]), rnd.choice([None, "", "system", "user", "assistant", "assistant", "bot", "user"]), rnd.choice([None, "", " \t", "Yes.", "No", "Why? ", "é!", "…"]) or None, 1, 2, "x") for _ in range(n)]
    rows += [(5, i, ("user", "assistant")[i % 2], f"Turn {i}." + " x" * 30_000 * (i == 3), 1, 2, "x") for i in range(10)] + [(6, 0, "user", "Hi.", 1, 2, "x")] * 5
    return spark.createDataFrame(rows, CONVERSATIONS)


def test_repair_equals_duckdb_on_hostile_rows(spark, tmp_path):
    df = hostile(spark).cache()
    df.drop("segment", "pos", "edits").write.parquet(str(tmp_path / "t"))
    con = connect(FOLDER)
    con.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/t/*.parquet')")
    same(repair.damage_and_repair(df), con, queries.SQL["op12_conversation_repair"])
    same(repair.damage_and_repair(df, segment=3), con, queries.SQL["op12_conversation_repair"])


def test_repair_of_nothing(spark):
    df = hostile(spark)
    assert repair.damage_and_repair(df.limit(0)).count() == 0
    gone = next(i for i in range(100) if repair.damaged(spark.createDataFrame([(i, 0, "user", "x")], "conv_id long, turn long, role string, text string")).isEmpty())
    row = repair.damage_and_repair(df.limit(1).withColumns({"conv_id": F.lit(gone), "turn": F.lit(0)})).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


@pytest.mark.parametrize("name", ["op12_conversation_repair", "op13_minhash_near_dedup"])
def test_equals_duckdb(spark, name):
    same(queries.queries()[name](spark, FOLDER), connect(FOLDER), queries.SQL[name])
