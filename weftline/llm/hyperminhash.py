"""Near-duplicate removal with HyperMinHash sketches.

A text's set of word shingles is sketched by ``BANDS * ROWS`` buckets.  Each bucket has a hash function of its own, so
that no bucket of a short text is empty; it keeps of the least hash how many zeros lead it (6 bits) and the 10 bits
after the first one.  Steps:

1. Texts with equal sets form a class, found by two 64-bit digests and the size of the set.  Its smallest doc_id stands for it.
2. Each band of ``ROWS`` registers is a key.  Two sets of a similarity of 0.8 share none of the 48 keys in 5 of 1e9 cases.
3. Pairs with a common key are estimated from their registers: the share of equal ones, less what registers of different
   hashes are equal by chance.  A pair goes on if the estimate is no more than ``SLACK`` standard deviations too low.
4. What is left is verified on the full sets.

All texts of a key are first compared with its smallest one only.  In most keys that links all of them.  In the others
the texts outside the largest component so far are compared, in tiles of bounded size, with all texts of the key that
they aren't linked with; only links leave a tile.  So a large group of near copies gives a pair for each text, not for each
two texts, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .ngram_join import _only, _texts, digests
from .shared import bounded_batches, components, stash

BANDS, ROWS, MANTISSA_BITS = 48, 5, 10
#: Standard deviations by which an estimate may fall short of the threshold; texts of a tile's left side; texts that are
#: verified with the same text in one go.
SLACK, TILE, TOGETHER = 6.5, 256, 256
#: Shingles of a tile's left side.
TILE_SHINGLES = 500_000
#: A class with more copies is joined by broadcast, if there are at most so many of them.
HOT_COPIES, FEW_CLASSES = 500, 100_000

_U = np.uint64
_RNG = np.random.default_rng(20260101)
_FACTORS = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * _U(2) + _U(1)
_OFFSETS = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * _U(2) + _RNG.integers(0, 2, BANDS * ROWS, dtype=np.uint64)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Sketches of non-empty sets of 64-bit hashes: a row of 16-bit registers each."""
    least = np.empty((BANDS * ROWS, len(sets)), np.uint64)
    if sets:
        values, start = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
        with np.errstate(over="ignore"):
            for j in range(BANDS * ROWS):
                hashed = values * _FACTORS[j]
                hashed += _OFFSETS[j]
                least[j] = np.minimum.reduceat(hashed, start)
    return compressed(least.T)


def compressed(hashes: np.ndarray) -> np.ndarray:
    """Leading zeros of 64-bit hashes and the bits after the first one, as 16-bit registers."""
    top = hashes >> _U(11)  # 53 bits, which a double holds exactly
    exponent = np.frexp(top.astype(np.float64))[1].astype(np.int64)
    after = np.where(exponent > MANTISSA_BITS, top >> np.maximum(exponent - 1 - MANTISSA_BITS, 0).astype(np.uint64), top << np.maximum(MANTISSA_BITS + 1 - exponent, 0).astype(np.uint64))
    return ((53 - exponent) << MANTISSA_BITS | (after.astype(np.int64) & (1 << MANTISSA_BITS) - 1)).astype(np.uint16)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each sketch."""
    with np.errstate(over="ignore"):
        out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15), (len(sketches), BANDS))
        for part in np.moveaxis(sketches.reshape(-1, BANDS, ROWS).astype(np.uint64), 2, 0):
            out = kernels.mix64(out ^ part)
    return out.view(np.int64)


_EDGES = np.log1p(-np.concatenate([[1 - 1e-16], 0.5 ** np.arange(1, 54), [0.0]]))  # hashes of i leading zeros lie between two of these


def zeros(n: np.ndarray) -> np.ndarray:
    """Probabilities of each number of leading zeros of the least of n hashes."""
    return np.diff(np.exp(np.multiply.outer(np.asarray(n, np.float64), _EDGES)), axis=-1)


def by_chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that the registers of two disjoint sets of n and m hashes are equal."""
    return (zeros(n) * zeros(m)).sum(-1) / (1 << MANTISSA_BITS)


def estimate(equal: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, corrected by the expected chance collisions."""
    return (equal / (BANDS * ROWS) - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    """Estimates under this don't come from sets of ``percent`` hundredths."""
    t = percent / 100
    return t - SLACK * (t * (1 - t) / (BANDS * ROWS)) ** 0.5


def _describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches):
            sets = list(kernels.shingle_sets(texts, k))
            n, full, at = np.array([len(x) for x in sets]), [], 0
            while at < len(sets):  # runs of about 32,768 hashes stay in the processor's cache
                to = at + max(1, int(np.searchsorted(np.cumsum(n[at:]), 32_768, "right")))
                full.append(registers([x for x in sets[at:to] if len(x)]))
                at = to
            full = iter(np.concatenate(full)) if full else iter(())
            marks = [digests(x) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array([a for a, _ in marks], pa.int64()), pa.array([b for _, b in marks], pa.int64()), pa.array([next(full).tobytes() if len(x) else None for x in sets], pa.binary())],
                ["doc_id", "n", "d1", "d2", "sketch"],
            )

    return run


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BANDS * ROWS)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(_sketches(batch.column("sketch")))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), BANDS))], ["key", "node"])


def _estimated(percent: int):
    """Keeps pairs whose estimate leaves room for a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "m"))
                fits = estimate((_sketches(batch.column("x")) == _sketches(batch.column("y"))).sum(1), by_chance(n, m)) >= least_estimate(percent)
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(fits)) for c in ("a", "b")], ["a", "b"])

    return run


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least ``percent`` hundredths."""
    few, many = sorted((x, y), key=len)
    if 100 * len(few) < percent * len(many):
        return False
    common = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())
    return 100 * common >= percent * (len(few) + len(many) - common)


def _verified(k: int, percent: int):
    """Reads (b, part, a, text) sorted by b and part, b's own text (a is null) first; gives the pairs that are links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, head = None, None
        for batch, texts in _texts(batches):
            found = []
            for b, part, a, own in zip(batch.column("b").to_pylist(), batch.column("part").to_pylist(), batch.column("a").to_pylist(), kernels.shingle_sets(texts, k)):
                if a is None:
                    cell, head = (b, part), own
                    continue
                assert (b, part) == cell
                if _similar(own, head, percent):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


class _Left:
    """The left side of a tile. Rows are (node, least, outside, n, sketch, text)."""

    def __init__(self, rows: list[tuple], percent: int, k: int):
        self.node, self.least, self.outside, self.n, self.sketch = (np.array([r[c] for r in rows]) for c in range(5))
        self.texts, self.sets, self.percent, self.k = [r[5] for r in rows], {}, percent, k
        self.keys, self.zeros = band_keys(self.sketch), zeros(self.n)

    def links(self, key: int, row: tuple, keys: np.ndarray, zeros: np.ndarray) -> list[tuple[int, int]]:
        """Verified links with a right row. A pair with several common keys is left to the first; two texts outside the largest component meet twice."""
        node, least, outside, n, sketch, text = row
        fits = (self.least != least) & (100 * np.minimum(self.n, n) >= self.percent * np.maximum(self.n, n))
        near = np.flatnonzero(fits & (self.node < node) if outside else fits)
        near = near[self.keys[near, (self.keys[near] == keys).argmax(1)] == key]
        near = near[estimate((self.sketch[near] == sketch).sum(1), self.zeros[near] @ zeros / (1 << MANTISSA_BITS)) >= least_estimate(self.percent)]
        if not len(near):
            return []
        own, found = next(kernels.shingle_sets([text], self.k)), []
        for x in near.tolist():
            if self.least[x] == least:  # linked meanwhile
                continue
            if x not in self.sets:
                self.sets[x] = next(kernels.shingle_sets([self.texts[x]], self.k))
            if _similar(own, self.sets[x], self.percent):
                found.append((int(self.node[x]), node))
                self.least[self.least == self.least[x]] = least
        return found


def _tiles(percent: int, k: int):
    """Reads (key, i, j, right, node, least, outside, n, sketch, text) sorted by tile, the left side first; gives the links between the two sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows, left = None, [], None
        for batch in batches:
            found = []
            if batch.num_rows:
                sketches = _sketches(batch.column("sketch"))
                columns = [batch.column(c).to_pylist() for c in ("key", "i", "j", "right", "node", "least", "outside", "n", "text")]
                for i, (*at, right, node, least, outside, n, text) in enumerate(zip(*columns)):
                    if at != tile:
                        tile, rows, left = at, [], None
                    row = (node, least, outside, n, sketches[i], text)
                    if not right:
                        rows.append(row)
                    elif rows:
                        left = left or _Left(rows, percent, k)
                        found += left.links(at[0], row, band_keys(sketches[i : i + 1])[0], zeros(n))
            yield pa.RecordBatch.from_arrays([pa.array([f(x) for x in found], pa.int64()) for f in (max, min)], ["a", "b"])

    return run


def _class_members(feats: DataFrame) -> DataFrame:
    """(doc_id, n, rep): the smallest doc_id with the same set. Classes of many copies are few and joined by broadcast, so no key of the shuffle is hot."""
    key = ["d1", "d2", "n"]
    copies = stash(feats.where("n > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1"), "copies")
    rows, hot = feats.select("doc_id", *key), copies.where(F.col("c") > HOT_COPIES).drop("c")
    if hot.count() <= FEW_CLASSES:
        hot, rest = F.broadcast(hot), copies.where(F.col("c") <= HOT_COPIES).drop("c")
        members = rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(rest, key, "left"))
    else:
        members = rows.join(copies.drop("c"), key, "left")
    return stash(members.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")), "members")


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80, tile: int = TILE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs`` (doc_id, text and any other columns, which are ignored).

    Two texts link if their sets of k-word shingles have a Jaccard similarity of at least ``percent`` hundredths;
    component_id is the smallest doc_id reachable by links, and kept says that it is the row's own.  Null, empty and blank
    texts have n_shingles 0 and are linked with nothing; a text of fewer than k words is one shingle.  doc_id is a key: rows
    that repeat it must repeat the text and are returned as often.  A row with a null doc_id has a null component and is
    kept.  An empty table gives no rows.  Shingles are compared by 64-bit hashes.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    feats = stash(docs.mapInArrow(_describe(k), "doc_id long, n long, d1 long, d2 long, sketch binary"), "sketches")
    members = _class_members(feats)
    others = members.where("rep <> doc_id").select("doc_id").distinct()
    reps = stash(_only(feats.where("n > 0 and doc_id is not null").select("doc_id", "n", "sketch"), others, "left_anti").dropDuplicates(["doc_id"]), "representatives")

    keys = reps.select("doc_id", "sketch").mapInArrow(_keys, "key long, node long")
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    rows = stash(keys.join(shared, "key"), "bands")
    sketch = lambda node, size, name: reps.select(F.col("doc_id").alias(node), F.col("n").alias(size), F.col("sketch").alias(name))

    def verify(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b), b the smaller, that are links by their full sets."""
        pairs = stash(pairs, "pairs")
        parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(TOGETHER)).cast("int").alias("parts"))
        cells = pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.col("a").alias("doc_id"))
        heads = parts.select(F.lit(None).cast("long").alias("a"), "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("b").alias("doc_id"))
        cells = cells.union(heads)
        texts = _only(docs.where("doc_id is not null"), stash(cells.select("doc_id").distinct(), "needed"), "left_semi").dropDuplicates(["doc_id"])
        cells = texts.join(cells, "doc_id").select("b", "part", "a", "text").repartition("b", "part").sortWithinPartitions("b", "part", F.asc_nulls_first("a"))
        return stash(cells.mapInArrow(_verified(k, percent), "a long, b long"), "links")

    pivot = rows.groupBy("key").agg(F.min("node").alias("b"))
    tied = rows.join(pivot, "key").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    tied = tied.join(sketch("a", "n", "x"), "a").join(sketch("b", "m", "y"), "b").where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    links = verify(tied.mapInArrow(_estimated(percent), "a long, b long"))

    # a key's texts outside its largest component meet all of its texts
    linked = stash(components(links).toDF("node", "least"), "linked")
    known = rows.join(linked, "node", "left").withColumn("least", F.coalesce("least", "node")).join(reps.select(F.col("doc_id").alias("node"), "n"), "node")
    groups = known.groupBy("key", "least").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    split = groups.groupBy("key").agg(F.max(F.struct("c", "least", "n")).alias("top"), F.sum("c").alias("c"), F.sum("n").alias("n")).where("c > top.c")
    parts = lambda c, n, size: F.ceil(F.greatest(c / F.lit(size), n / F.lit(size * TILE_SHINGLES // TILE))).cast("int")
    sizes = split.select("key", "top.least", parts(F.col("c") - F.col("top.c"), F.col("n") - F.col("top.n"), tile).alias("lefts"), parts(F.col("c"), F.col("n"), 16 * tile).alias("rights"))
    sides = stash(known.select("key", "node", "least").join(sizes.withColumnRenamed("least", "top"), "key").withColumn("outside", F.col("least") != F.col("top")), "sides")
    part = lambda name: F.pmod(F.xxhash64("node"), F.col(name)).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    left = sides.where("outside").select("key", part("lefts").alias("i"), every("rights").alias("j"), F.lit(False).alias("right"), "node", "least", "outside")
    right = sides.select("key", every("lefts").alias("i"), part("rights").alias("j"), F.lit(True).alias("right"), "node", "least", "outside")
    texts = _only(docs.where("doc_id is not null"), sides.select(F.col("node").alias("doc_id")).distinct(), "left_semi").dropDuplicates(["doc_id"])
    held = sketch("node", "n", "sketch").join(texts.withColumnRenamed("doc_id", "node"), "node")
    tiles = left.union(right).join(held, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "right", "node")
    links = links.union(tiles.mapInArrow(_tiles(percent, k), "a long, b long"))

    whole = components(links).toDF("rep", "least")
    found = members.join(whole, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "rep").alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
