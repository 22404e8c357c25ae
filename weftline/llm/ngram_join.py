"""N-gram Jaccard self-join with count-vector R-trees.

Two texts link when the Jaccard similarity of their sets of word shingles reaches a threshold t.  Steps:

1. Every text becomes a sorted set of 64-bit shingle hashes.  Equal sets form a class; one representative goes on.
2. Sets that reach t share a shingle among the first ``n - ceil(t n) + 1`` of each in any common order, so only those
   are shuffled.  The order puts shingles that occur in many texts last.  It affects speed, never the result.
3. Texts that meet in a small block become candidate pairs; a block of over ``SMALL_BLOCK`` texts only ties its
   texts to one cluster.  Pairs are kept if the count-vector bound allows a link: shingles are hashed into groups, and
   the sum of the smaller counts of all groups bounds the overlap from above.
4. Clusters of surviving candidates are indexed by R-trees over the count vectors (a node's bound uses its largest
   counts).  Pairs that pass are verified on the sets, unless both ends are already linked through others.
5. Links of all clusters are joined to components.

A cluster of over ``CELL_SHINGLES`` shingles is cut into chunks, and each pair of chunks is a task of its own: no task
holds an unbounded group and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .shared import bounded_batches, components, stash

#: Shingles for each group of a count vector, texts in a small block, shingles in an unsplit cluster, shingles whose order
#: is by frequency.
GROUP_SHINGLES, SMALL_BLOCK, CELL_SHINGLES, FREQUENT = 4, 64, 2_000_000, 100_000
#: Ids that may be broadcast (8 bytes each).
FEW_IDS = 500_000
#: Shingles among which one task counts repeats at a time.
COUNTED_TOGETHER = 4_000_000

_U = np.uint64


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column(batch.schema.get_field_index("text")).to_pylist()


def digests(values: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that identify a set of hashes."""
    with np.errstate(over="ignore"):
        a, b = kernels.mix64(values).sum(dtype=np.uint64), kernels.mix64(values ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def frequent_shingles(docs: DataFrame, k: int, limit: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that recur most among texts that one task reads, with their counts; at most ``limit`` reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own, size = set(), [], 0
        for _, texts in chain(_texts(batches), [(None, [])]):
            for x in kernels.shingle_sets(texts, k):
                mark = digests(x)
                if mark not in held:
                    held.add(mark)
                    own.append(x)
                    size += len(x)
            if own and (size >= COUNTED_TOGETHER or not texts):
                values = np.sort(np.concatenate(own))
                start = np.flatnonzero(np.diff(values, prepend=~values[:1]))
                seen = np.diff(np.append(start, len(values)))
                keep = seen >= 3
                yield pa.RecordBatch.from_arrays([pa.array(values[start[keep]].view(np.int64)), pa.array(seen[keep])], ["token", "seen"])
                held, own, size = set(), [], 0

    top = docs.select("text").mapInArrow(count, "token long, seen long").groupBy("token").agg(F.sum("seen").alias("seen"))
    rows = top.orderBy(F.desc("seen"), "token").limit(limit).toPandas()
    tokens, seen = rows["token"].to_numpy(np.int64).view(np.uint64), rows["seen"].to_numpy(np.int64)
    order = np.argsort(tokens)
    return tokens[order], seen[order]


def features(docs: DataFrame, k: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per text: set size n, digests d1 and d2 of the set, count vector ``points``, and the ``prefix`` to shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, seen = held.value
        for batch, texts in _texts(batches):
            n, d1, d2, points, prefix = [], [], [], [], []
            for x in kernels.shingle_sets(texts, k):
                n.append(len(x))
                a, b = digests(x)
                d1.append(a)
                d2.append(b)
                points.append(count_vector(x, groups_for(len(x))).astype(np.uint32).tobytes())
                if len(tokens) and len(x):
                    at = np.minimum(np.searchsorted(tokens, x), len(tokens) - 1)
                    x = x[np.argsort(np.where(tokens[at] == x, seen[at], 0), kind="stable")]
                prefix.append(x[: len(x) - -(-percent * len(x) // 100) + 1].view(np.int64))
            sizes = np.cumsum([0, *map(len, prefix)])
            lists = pa.LargeListArray.from_arrays(pa.array(sizes, pa.int64()), pa.array(np.concatenate(prefix))).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(points, pa.binary()), lists], ["doc_id", "n", "d1", "d2", "points", "prefix"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(describe, "doc_id long, n long, d1 long, d2 long, points binary, prefix array<long>")


def groups_for(n: int) -> int:
    """Groups of the count vector of n shingles: a power of two, as unrelated sets are told apart by about n / 4 groups."""
    return 1 << min(12, max(4, (max(n, 1) // GROUP_SHINGLES - 1).bit_length()))


def count_vector(values: np.ndarray, groups: int) -> np.ndarray:
    """How many of the hashes fall into each group."""
    return np.bincount((values & _U(groups - 1)).astype(np.int64), minlength=groups)


def folded(vector: np.ndarray, groups: int) -> np.ndarray:
    """A count vector of fewer groups."""
    return vector.reshape(-1, groups).sum(0)


def _prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text and prefix shingle."""
    for batch in batches:
        doc, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "n"))
        size = batch.column("prefix").value_lengths().to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([batch.column("prefix").flatten(), pa.array(np.repeat(doc, size)), pa.array(np.repeat(n, size))], ["token", "doc_id", "n"])


def _blocks(percent: int, small: int):
    """Reads rows sorted by token. Gives candidate pairs (a, b) of small blocks, and (block, a) for each text of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, large = [np.zeros(0, np.int64)] * 3, None
        for batch in chain(batches, [None]):
            new = [np.zeros(0, np.int64)] * 3 if batch is None else [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            token, doc, n = (np.concatenate(x) for x in zip(carry, new))
            if not len(token):
                continue
            start = np.flatnonzero(np.diff(token, prepend=~token[:1]))
            size = np.diff(np.append(start, len(token)))
            is_large = (size > small) | (token[start] == large if large is not None else False)
            if batch is None or is_large[-1]:
                carry, large = [np.zeros(0, np.int64)] * 3, token[-1] if is_large[-1] else None
            else:
                carry, large = [x[start[-1] :] for x in (token, doc, n)], None
                start, size, is_large = start[:-1], size[:-1], is_large[:-1]
            hot = np.repeat(is_large, size)
            end = len(hot)
            pairs = []
            for s in np.unique(size[~is_large & (size > 1)]).tolist():
                rows = start[~is_large & (size == s)][:, None] + np.arange(s)
                i, j = np.triu_indices(s, 1)
                i, j = rows[:, i].ravel(), rows[:, j].ravel()
                fits = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
                i, j = doc[i[fits]], doc[j[fits]]
                pairs.append(np.stack([np.minimum(i, j), np.maximum(i, j)], 1))
            pairs = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
            pairs = pairs[(np.diff(pairs, axis=0, prepend=-1) != 0).any(1) & (pairs[:, 0] != pairs[:, 1])]
            blocks, members = token[:end][hot], doc[:end][hot]
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(blocks)]), pa.array(np.concatenate([pairs[:, 0], members])), pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(len(members), pa.int64())])],
                ["block", "a", "b"],
            )

    return run


def _bounded(percent: int):
    """Keeps pairs whose summed coordinate minima leave room for a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = []
                for pair in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                    x, y = (np.frombuffer(v, np.uint32).astype(np.int64) for v in pair)
                    few = min(len(x), len(y))
                    bound = np.minimum(folded(x, few), folded(y, few)).sum()
                    keep.append(bool((100 + percent) * bound >= percent * (x.sum() + y.sum())))
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])

    return run


class CountVectorTree:
    """R-tree over count vectors, packed bottom up. A node keeps its largest count in each group and its least set size."""

    FANOUT = 16

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        tops, least = points, sizes
        self.levels = [(tops, least)]
        while len(tops) > self.FANOUT:
            cut = np.arange(0, len(tops), self.FANOUT)
            tops, least = np.maximum.reduceat(tops, cut), np.minimum.reduceat(least, cut)
            self.levels.append((tops, least))

    def search(self, point: np.ndarray, size: int, percent: int, after: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices from ``after`` on whose bound allows a link, and their bounds. Sizes ascend with the index."""
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            tops, least = self.levels[depth]
            if depth < len(self.levels) - 1:
                nodes = (nodes[:, None] * self.FANOUT + np.arange(self.FANOUT)).ravel()
                nodes = nodes[nodes < len(tops)]
            nodes = nodes[(nodes + 1) * self.FANOUT**depth > after]
            nodes = nodes[percent * np.maximum(least[nodes], size) <= 100 * size] if depth == 0 else nodes[percent * least[nodes] <= 100 * size]
            bound = np.minimum(tops[nodes], point).sum(1)
            fits = (100 + percent) * bound >= percent * (size + np.maximum(least[nodes], size))
            nodes, bound = nodes[fits], bound[fits]
        return nodes, bound


def link_cell(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (id, smallest linked id) that give the components of one cell."""
    sizes = np.array([len(x) for x in sets])
    order = np.lexsort((ids, sizes))
    ids, sets, sizes = ids[order], [sets[i] for i in order], sizes[order]
    groups = groups_for(int(np.median(sizes)))
    points = np.stack([count_vector(x, groups) for x in sets])
    tree, group = CountVectorTree(points, sizes), np.arange(len(ids))
    for q in range(len(ids) - 1):
        found, bound = tree.search(points[q], int(sizes[q]), percent, q + 1)
        found = found[np.argsort(-bound, kind="stable")]
        while len(found := found[group[found] != group[q]]):
            part, found = found[:64], found[64:]
            values = np.concatenate([sets[j] for j in part])
            at = np.minimum(np.searchsorted(sets[q], values), len(sets[q]) - 1)
            common = np.add.reduceat((sets[q][at] == values).astype(np.int64), np.cumsum(sizes[part]) - sizes[part])
            for j in part[100 * common >= percent * (sizes[q] + sizes[part] - common)].tolist():
                if group[j] != group[q]:
                    group[group == group[j]] = group[q]
    least = {}
    for g, i in zip(group.tolist(), ids.tolist()):
        least[g] = min(least.get(g, i), i)
    return [(i, least[g]) for g, i in zip(group.tolist(), ids.tolist()) if least[g] != i]


def _link_cells(k: int, percent: int):
    """Reads (cell, doc_id, text) sorted by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids, sets):
            links = link_cell(np.array(ids, np.int64), sets, percent) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

        cell, ids, sets = None, [], []
        for batch, texts in _texts(batches):
            for c, i, x in zip(batch.column("cell").to_pylist(), batch.column("doc_id").to_pylist(), kernels.shingle_sets(texts, k)):
                if c != cell:
                    yield out(ids, sets)
                    cell, ids, sets = c, [], []
                ids.append(i)
                sets.append(x)
        yield out(ids, sets)

    return run


def _only(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join with ids; they are broadcast if they are few, and both sides are shuffled otherwise."""
    return rows.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, "doc_id", how)


def ngram_jaccard_join(docs: DataFrame, k: int = 5, percent: int = 75, small_block: int = SMALL_BLOCK, cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) per row of ``docs`` (doc_id, text and any other columns).

    class_id is the smallest doc_id with the same set; component_id the smallest doc_id reachable by links of a
    similarity of at least ``percent`` hundredths.  Null, empty and blank texts have n_shingles 0 and are linked with
    nothing.  A text of fewer than k words is one shingle.  doc_id is a key: rows that repeat it must repeat the text
    and are returned as often; a row with a null doc_id is returned with null class and component.  Other columns are
    ignored.  An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    feats = stash(features(docs, k, percent, frequent_shingles(docs, k)), "features")
    full = feats.where("n > 0 and doc_id is not null")

    copies = full.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c")
    members = feats.select("doc_id", "n", "d1", "d2").join(copies, ["d1", "d2", "n"], "left")
    members = stash(members.select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "members")
    rep_of = members.where("n > 0").select("doc_id", "rep").dropDuplicates(["doc_id"])

    others = members.where("rep <> doc_id").select("doc_id")
    rows = _only(full, others, "left_anti").select("doc_id", "n", "prefix").mapInArrow(_prefix_rows, "token long, doc_id long, n long")
    rows = rows.repartition("token").sortWithinPartitions("token")
    found = stash(rows.mapInArrow(_blocks(percent, small_block), "block long, a long, b long"), "blocks")

    name = lambda side: rep_of.select(F.col("doc_id").alias(side), F.col("rep").alias(f"r{side}"))
    pairs = found.where("block is null").select("a", "b").distinct().join(name("a"), "a").join(name("b"), "b").where("ra <> rb")
    pairs = pairs.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
    point = feats.where("n > 0").select("doc_id", "points").dropDuplicates(["doc_id"])
    pairs = pairs.join(point.toDF("a", "x"), "a").join(point.toDF("b", "y"), "b").mapInArrow(_bounded(percent), "a long, b long")

    hot = stash(found.where("block is not null").join(name("a"), "a").select("block", F.col("ra").alias("a")).distinct(), "hot")
    ties = hot.join(hot.groupBy("block").agg(F.min("a").alias("b")), "block").select("a", "b")
    clusters = stash(components(pairs.union(ties)), "clusters")

    sizes = rep_of.select(F.col("rep").alias("node")).distinct().join(members.select(F.col("doc_id").alias("node"), "n").dropDuplicates(["node"]), "node")
    weight = clusters.join(sizes, "node").groupBy("component").agg(F.sum("n").alias("weight"))
    parts = F.ceil(F.col("weight") / F.lit(cell_shingles)).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    cells = clusters.join(weight, "component").withColumn("parts", parts).withColumn("own", own)
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select(F.col("node").alias("doc_id"), F.concat_ws("-", "component", F.least("own", "other"), F.greatest("own", "other")).alias("cell"))
    texts = docs.where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long"))
    texts = _only(texts, clusters.select(F.col("node").alias("doc_id")), "left_semi").join(cells, "doc_id").select("cell", "doc_id", "text")
    links = texts.repartition("cell").sortWithinPartitions("cell").mapInArrow(_link_cells(k, percent), "a long, b long")

    whole = components(links).withColumnsRenamed({"node": "rep", "component": "least"})
    return members.join(whole, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.col("rep").alias("class_id"), F.coalesce("least", "rep").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs``, with all their columns, without those linked to a smaller doc_id: one text of each component stays.

    Rows with a null doc_id stay; so do all rows that repeat the doc_id that stays.
    """
    linked = ngram_jaccard_join(docs, k, percent).where("doc_id <> component_id").select("doc_id").distinct()
    return _only(docs, stash(linked, "linked"), "left_anti")
