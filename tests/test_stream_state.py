"""Streams with timers against their batch twins: rows out of order, late rows, restarts, and state that ends."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftline.operators import ordered
from weftline.streaming import state

MINUTE = 60_000_000
START = datetime(2024, 1, 1)
EVENTS = "k string, ts timestamp, id long"


@pytest.fixture
def no_idle_batches(spark, store):
    """State with a time to live asks for batches without end, so a run of what is available would not stop."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


@pytest.fixture
def store(spark):
    own = {**state.STORE, "spark.sql.shuffle.partitions": "1"}  # each batch starts a Python worker a partition
    before = {name: spark.conf.get(name, None) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value) if value else spark.conf.unset(name)


class Feed:
    """A folder of files that are read one a batch, and a query over it that can be started again."""

    def __init__(self, spark, path, schema, build):
        self.spark, self.path, self.schema, self.build, self.n = spark, path, schema, build, 0
        (path / "in").mkdir()

    def add(self, *batches):
        for rows in batches:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(str(self.path / "in" / f"{self.n:03}"))
            self.n += 1
            time.sleep(0.02)  # files are taken in order of their time

    def run(self):
        """Everything that is new; gives all rows so far."""
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(self.path / "in"))
        out = self.build(stream).writeStream.format("parquet").option("path", str(self.path / "out")).option("checkpointLocation", str(self.path / "c"))
        out.trigger(availableNow=True).start().awaitTermination()
        return [tuple(r) for r in self.spark.read.parquet(str(self.path / "out")).collect()]


def minutes(key, at, row):
    return (key, START + timedelta(minutes=at), row)


def made(seed, n=60):
    r = random.Random(seed)
    return [minutes(r.choice("ab"), r.randrange(0, 300) + r.random(), i) for i in range(n)]


def batch(spark, rows, rule):
    return sorted(tuple(r) for r in ordered.in_order(spark.createDataFrame(rows, EVENTS), "k", "ts", "id", rule).collect())


RULES = [ordered.Ticks(4 * MINUTE), ordered.Ticks(3 * MINUTE, 2, 30 * MINUTE), ordered.Admissions(3, 20 * MINUTE)]


def slow(rule, rows):
    """The rules by asking again, for each row, what all earlier ones had become."""
    out = []
    for key in sorted({k for k, *_ in rows}):
        own = sorted((t, i) for k, t, i in rows if k == key)
        if isinstance(rule, ordered.Admissions):
            taken = []
            for t, i in own:
                yes = sum(t - x < timedelta(microseconds=rule.window) for x in taken) < rule.most
                taken += [t] * yes
                out.append((key, "accepted" if yes else "rejected", t, i, 1))
            continue
        quiet, fires, armed = timedelta(microseconds=rule.quiet), [], []
        for t, i in [*own, (datetime(2100, 1, 1), None)]:
            if armed and armed[-1][0] + quiet <= t:
                fires.append(armed[-1][0] + quiet)
                out.append((key, "tick", fires[-1], armed[-1][1], len(armed)))
                armed = []
            if i is not None and rule.most is not None and sum(t - f < timedelta(microseconds=rule.window) for f in fires) >= rule.most:
                out.append((key, "rejected", t, i, 1))
            else:
                armed.append((t, i))
    return sorted(out)


@pytest.mark.parametrize("rule", RULES)
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rules_equal_brute_force(spark, rule, seed):
    rows = made(seed) + [minutes("c", 10, 900), minutes("c", 10, 901), minutes("c", 14, 902), minutes("c", 17, 903)]
    assert batch(spark, rows, rule) == slow(rule, rows)


def test_rules_on_nulls_and_empty_tables(spark):
    rows = [(None, START, 1), ("a", None, 2), ("a", START, None), ("a", START, 3)]
    for rule in RULES:
        assert {(r[0], r[3]) for r in map(tuple, ordered.in_order(spark.createDataFrame(rows, EVENTS), "k", "ts", "id", rule).collect())} == {(None, 1), ("a", 3)}
        assert ordered.in_order(spark.createDataFrame([], EVENTS), "k", "ts", "id", rule).count() == 0


@pytest.mark.parametrize("rule", RULES[1:])
def test_timers_equal_the_batch_twin_over_a_restart(spark, store, tmp_path, rule):
    """Rows come up to ten minutes out of order, and the query is stopped halfway."""
    rows = sorted(made(7, 40), key=lambda r: (r[1] + timedelta(minutes=random.Random(r[2]).random() * 9)))
    feed = Feed(spark, tmp_path, EVENTS, lambda s: state.in_order(s, "k", "ts", "id", rule, "10 minutes"))
    feed.add(rows[:12], rows[12:20])
    first = feed.run()
    feed.add(rows[20:], [minutes("z", 1000, 999)], [minutes("z", 1001, 1000)])
    got = [r for r in feed.run() if r[0] != "z"]
    assert len(first) < len(got)
    assert sorted(got) == batch(spark, rows, rule)


def test_late_rows_change_nothing(spark, store, tmp_path):
    rule = ordered.Ticks(5 * MINUTE)
    feed = Feed(spark, tmp_path, EVENTS, lambda s: state.in_order(s, "k", "ts", "id", rule, "10 minutes"))
    feed.add([minutes("a", 0, 1), minutes("a", 3, 2)], [minutes("b", 60, 3)], [minutes("b", 61, 4)])
    assert feed.run() == [("a", "tick", START + timedelta(minutes=8), 2, 2)]
    feed.add([minutes("a", 4, 5)], [minutes("b", 200, 6)], [minutes("b", 201, 7)])
    assert sorted(feed.run()) == [("a", "tick", START + timedelta(minutes=8), 2, 2), ("b", "tick", START + timedelta(minutes=66), 4, 2)]


CHUNKS = "seq long, pattern string, chunk_id string, members array<string>"
SEEN = [(0, "p", "c0", ["a", "b"]), (1, "p", "c1", ["a"]), (2, "p", "c2", ["b", "c"]), (3, "p", "c3", ["b", "a", "c", "a"]), (4, "p", "c4", ["c", "b", "a"]),
        (5, "q", "d0", None), (6, "q", "d1", ["z"]), (7, None, "e", ["x", "x"]), (8, "p", None, []), (9, "p", "c2", ["b", "d"])]
EXPECTED = [(0, "p", "p", "added", "c0", None, 2), (1, "p", "p", "unchanged", "c0", None, 2), (2, "p", "p::c2", "added", "c2", None, 2), (3, "p", "p", "replaced", "c3", "c0", 3),
            (4, "p", "p", "unchanged", "c3", None, 3), (5, "q", "q", "added", "d0", None, 0), (6, "q", "q", "replaced", "d1", "d0", 1),
            (7, None, None, "added", "e", None, 1), (8, "p", None, "added", None, None, 0), (9, "p", "p::c2", "added", "c2", None, 2)]


def test_absorbed_chunks(spark):
    found = ordered.absorbed(spark.createDataFrame(SEEN, CHUNKS).withColumn("kind", F.lit("own")))
    assert sorted(tuple(r) for r in found.collect()) == EXPECTED
    assert sorted(tuple(r) for r in ordered.ledger(found).collect()) == [("p", "c3", 3), ("p::c2", "c2", 2), ("q", "d1", 1)]
    assert ordered.absorbed(spark.createDataFrame([], CHUNKS)).count() == 0


def test_absorbing_stream_equals_the_batch_twin_over_a_restart(spark, no_idle_batches, tmp_path):
    feed = Feed(spark, tmp_path, CHUNKS, state.absorbed)
    feed.add(SEEN[:2], SEEN[2:3])
    assert sorted(feed.run()) == EXPECTED[:3]
    feed.add(SEEN[3:6], SEEN[6:])
    assert sorted(feed.run()) == EXPECTED


def test_forgotten_chunks_are_added_anew(spark, no_idle_batches, tmp_path):
    feed = Feed(spark, tmp_path, CHUNKS, lambda s: state.absorbed(s, 1))
    feed.add([(0, "p", "c0", ["a", "b"])])
    feed.run()
    time.sleep(1.5)
    feed.add([(1, "p", "c1", ["a"])])
    assert [r[3] for r in sorted(feed.run())] == ["added", "added"]


def test_frames_are_numbered_over_batches(spark, store, tmp_path):
    feed = Feed(spark, tmp_path, "workspace string, node string, seq long, payload string", state.readout_frames)
    feed.add([("w", "x", 2, "x2"), ("w", "y", 1, "y1"), ("w", "x", 1, "x1"), ("v", "x", 5, None)], [("w", "y", 3, "y3")])
    feed.run()
    feed.add([("w", "z", 4, "z4")])
    assert sorted(feed.run()) == [("v", 1, "x", 5, None), ("w", 1, "y", 1, "y1"), ("w", 2, "x", 2, "x2"), ("w", 3, "y", 3, "y3"), ("w", 4, "z", 4, "z4")]
