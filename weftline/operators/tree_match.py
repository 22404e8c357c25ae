"""Distances of small trees: Zhang and Shasha's edit distance, and the largest common subtree by assignments.

Trees are tags and depths in page order. Spark makes candidate pairs, which are pruned by counts of tags before Python sees
them; each pair is then worked off on its own."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import kept_large

#: Nodes of a pair of trees up to which a task remembers what it gave.
REMEMBERED = 200


def post_order(depths: Sequence[int]) -> tuple[list[int], list[int]]:
    """Of a tree in page order: its nodes in post-order, and for each of these the post-order place of its leftmost leaf."""
    order, left, stack = [], [], []
    for node, depth in enumerate([*depths, -1]):
        while stack and stack[-1][1] >= depth:
            done, _, first = stack.pop()
            place = len(order)
            order.append(done)
            left.append(place if first is None else first)
            if stack and stack[-1][2] is None:
                stack[-1][2] = left[-1]
        stack.append([node, depth, None])
    return order, left


def edit_distance(labels: Sequence[str], depths: Sequence[int], labels2: Sequence[str], depths2: Sequence[int]) -> int:
    """Fewest insertions, deletions and relabelings that turn one ordered tree into the other."""
    if not labels or not labels2:
        return len(labels) + len(labels2)
    (order, left), (order2, left2) = post_order(depths), post_order(depths2)
    tags, tags2 = [labels[i] for i in order], [labels2[i] for i in order2]
    roots, roots2 = ([i for i, x in enumerate(ls) if x not in ls[i + 1 :]] for ls in (left, left2))  # the last node of each leftmost leaf
    whole = np.zeros((len(tags), len(tags2)), dtype=np.int64)
    for x in roots:
        for y in roots2:
            a, b = left[x], left2[y]
            forest = np.zeros((x - a + 2, y - b + 2), dtype=np.int64)
            forest[:, 0], forest[0] = range(len(forest)), range(forest.shape[1])
            for i in range(a, x + 1):
                for j in range(b, y + 1):
                    step = min(forest[i - a, j - b + 1], forest[i - a + 1, j - b]) + 1
                    if left[i] == a and left2[j] == b:
                        whole[i, j] = forest[i - a + 1, j - b + 1] = min(step, forest[i - a, j - b] + (tags[i] != tags2[j]))
                    else:
                        forest[i - a + 1, j - b + 1] = min(step, forest[left[i] - a, left2[j] - b] + whole[i, j])
    return int(whole[-1, -1])


def assignment(gain: np.ndarray) -> int:
    """The largest sum of entries of which no two share a row or a column (shortest augmenting paths with potentials)."""
    if gain.shape[0] > gain.shape[1]:
        gain = gain.T
    n, m = gain.shape
    cost = gain.max(initial=0) - gain
    u, v, match = np.zeros(n + 1, np.int64), np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
    for row in range(1, n + 1):
        match[0], column = row, 0
        least, came, used = np.full(m + 1, np.iinfo(np.int64).max), np.zeros(m + 1, np.int64), np.zeros(m + 1, bool)
        while True:
            used[column] = True
            here = match[column]
            slack = cost[here - 1] - u[here] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better], came[1:][better] = slack[better], column
            free = np.flatnonzero(~used[1:]) + 1
            following = free[np.argmin(least[free])]
            delta = least[following]
            u[match[used]] += delta
            v[used] -= delta
            least[free] -= delta
            column = following
            if not match[column]:
                break
        while column:
            match[column] = match[came[column]]
            column = came[column]
    return int(sum(gain[match[j] - 1, j - 1] for j in range(1, m + 1) if match[j]))


def common_subtree(labels: Sequence[str], depths: Sequence[int], labels2: Sequence[str], depths2: Sequence[int]) -> int:
    """Nodes of the largest common subtree of two trees with the same root tag: children are matched in any order, equal tags only."""

    def children(ds: Sequence[int]) -> list[list[int]]:
        out, stack = [[] for _ in ds], []
        for i, d in enumerate(ds):
            while stack and ds[stack[-1]] >= d:
                stack.pop()
            if stack:
                out[stack[-1]].append(i)
            stack.append(i)
        return out

    if not labels or not labels2:
        return 0
    below, below2 = children(depths), children(depths2)
    size: dict[tuple[int, int], int] = {}
    for i in range(len(labels) - 1, -1, -1):  # children come after their parents, so bottom up
        for j in range(len(labels2) - 1, -1, -1):
            if depths[i] == depths2[j]:
                if labels[i] != labels2[j]:
                    size[i, j] = 0
                elif not below[i] or not below2[j]:
                    size[i, j] = 1
                else:
                    size[i, j] = 1 + assignment(np.array([[size[a, b] for b in below2[j]] for a in below[i]], dtype=np.int64))
    return size[0, 0]


def _common_tags(a: Column, b: Column) -> Column:
    """Elements that two bags (maps from tag to count) have in common."""
    return F.aggregate(F.map_entries(a), F.lit(0), lambda s, e: s + F.least(e.value, F.coalesce(F.try_element_at(b, e.key), F.lit(0))))


def _bag(labels: Column) -> Column:
    return F.map_from_entries(F.transform(F.array_distinct(labels), lambda t: F.struct(t, F.size(F.filter(labels, lambda x: x == t)))))


def _with(of, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = functools.lru_cache(1 << 13)(of)  # pages of one kind hold the same pairs
        for batch in batches:
            columns = [map(tuple, batch.column(c).to_pylist()) for c in ("labels", "depths", "labels2", "depths2")]
            found = [(seen if len(x[0]) + len(x[2]) <= REMEMBERED else of)(*x) for x in zip(*columns)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("page_id", "a", "b", "n", "n2")] + [pa.array(found, pa.int64())], ["page_id", "a", "b", "n", "n2", name])

    return run


def _compared(trees: DataFrame) -> DataFrame:
    """Trees with their size and tags, kept, as both sides of the pairs read them."""
    return kept_large(trees.select("page_id", "root_id", "labels", "depths", F.size("labels").alias("n"), _bag(F.col("labels")).alias("bag")))


def near_trees(trees: DataFrame, most: int = 3) -> DataFrame:
    """(page_id, a, b, n, n2, distance): pairs of trees of a page (page_id, root_id, labels, depths) whose edit distance is at most ``most``; a < b.

    Trees meet if their sizes differ by no more, and if enough of their tags are the same."""
    own = _compared(trees)
    left = own.select("page_id", F.col("root_id").alias("a"), "labels", "depths", "n", "bag", F.explode(F.sequence(F.col("n") - most, F.col("n") + most)).alias("n2"))
    right = own.select("page_id", F.col("root_id").alias("b"), F.col("labels").alias("labels2"), F.col("depths").alias("depths2"), F.col("n").alias("n2"), F.col("bag").alias("bag2"))
    pairs = left.join(right, ["page_id", "n2"]).where(F.col("a") < F.col("b")).where(F.greatest("n", "n2") - _common_tags(F.col("bag"), F.col("bag2")) <= most)
    pairs = pairs.select("page_id", "a", "b", "n", "n2", "labels", "depths", "labels2", "depths2")
    return pairs.mapInArrow(_with(edit_distance, "distance"), "page_id long, a int, b int, n int, n2 int, distance long").where(F.col("distance") <= most)


def similar_trees(trees: DataFrame, percent: int = 80, least: int = 3) -> DataFrame:
    """(page_id, a, b, n, n2, common): pairs of trees of a page with the same root tag whose common subtree has at least ``percent`` hundredths of the smaller one's nodes.

    Trees under ``least`` nodes and pairs whose heights differ by more than one take no part."""
    own = _compared(trees).where(F.col("n") >= least).withColumn("root", F.col("labels")[0]).withColumn("height", F.array_max("depths"))
    left = own.select("page_id", "root", F.col("root_id").alias("a"), "labels", "depths", "n", "bag", F.explode(F.sequence(F.col("height") - 1, F.col("height") + 1)).alias("height"))
    right = own.select("page_id", "root", "height", F.col("root_id").alias("b"), F.col("labels").alias("labels2"), F.col("depths").alias("depths2"), F.col("n").alias("n2"), F.col("bag").alias("bag2"))
    pairs = left.join(right, ["page_id", "root", "height"]).where(F.col("a") < F.col("b")).where(100 * _common_tags(F.col("bag"), F.col("bag2")) >= percent * F.least("n", "n2"))
    pairs = pairs.select("page_id", "a", "b", "n", "n2", "labels", "depths", "labels2", "depths2")
    return pairs.mapInArrow(_with(common_subtree, "common"), "page_id long, a int, b int, n int, n2 int, common long").where(100 * F.col("common") >= percent * F.least("n", "n2"))
