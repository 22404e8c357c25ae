"""Sets of siblings and how they fall apart: by spectral cuts of their terms, by signatures that are refined until they
settle, and by patterns of child tags (PQ-trees) that are induced from instances and matched everywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import xpath as X
from ..sources import kept, kept_large, side
from .templates import SKIPPED, nearest

#: Attributes that people read, whose words say nothing of structure.
READ_ATTRIBUTES = "title alt placeholder aria-label aria-labelledby aria-describedby aria-description aria-placeholder content label summary".split()
URL = r"^(https?:)?//|^/|^(data|blob|mailto|javascript):"

_KEY = ["page_id", "node_id"]


def _plain(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("tag").isin(*SKIPPED))


def children(rows: DataFrame) -> DataFrame:
    """(page_id, node_id, kids): the children of each node that has any, as (node_id, tag) in order."""
    kids = F.array_sort(F.collect_list(F.struct("node_id", "tag")))
    return _plain(rows).where("parent_id >= 0").groupBy("page_id", F.col("parent_id").alias("node_id")).agg(kids.alias("kids"))


def cohorts(rows: DataFrame) -> DataFrame:
    """(page_id, cohort_id, node_id): nodes by the nearest node above that has several children; chains of only children are one node, their last."""
    sized = kept_large(_plain(rows).join(children(rows).select(*_KEY, F.size("kids").alias("n_kids")), _KEY, "left").select(*_KEY, "xpath", F.coalesce("n_kids", F.lit(0)).alias("n_kids")))
    found = nearest(sized.where("n_kids <> 1"), sized.where("n_kids >= 2"))
    return found.select("page_id", F.col("top_id").alias("cohort_id"), "node_id")


def structural_terms(rows: DataFrame) -> DataFrame:
    """(page_id, node_id, terms): distinct, sorted terms of a node's tag, attributes, children and depth, and of its parent's tag and attributes."""
    held = F.filter(F.map_entries("attrs"), lambda e: ~F.lower(e.key).isin(*READ_ATTRIBUTES))
    words = lambda prefix, e: F.transform(F.when((e.value == "") | e.value.rlike(URL), F.array().cast("array<string>")).otherwise(T.attribute_tokens(e.value)), lambda w: F.concat(F.lit(prefix), F.lower(e.key), F.lit(":"), w))
    own = rows.withColumns({"names": F.transform(held, lambda e: F.concat(F.lit("@"), F.lower(e.key))), "words": F.flatten(F.transform(held, lambda e: words("@", e))), "relay": F.flatten(F.transform(held, lambda e: words("parent:@", e)))})
    own = own.join(children(rows), _KEY, "left").withColumn("kids", F.coalesce("kids", F.array().cast("array<struct<node_id:int,tag:string>>")))
    n = F.size("kids")
    count = F.concat(F.lit("children:"), F.when(n <= 3, n.cast("string")).when(n <= 8, "4-8").otherwise("9+"))
    leaves = F.when(n > 0, F.concat(F.lit("leafsig:"), F.array_join(F.col("kids.tag"), "|")))
    depth = F.concat(F.lit("depth:"), X.depth(F.col("xpath")).cast("string"))
    above = own.select("page_id", F.col("node_id").alias("parent_id"), F.when(F.col("tag").startswith("#"), F.array().cast("array<string>")).otherwise(F.array_append("relay", F.concat(F.lit("parent:tag:"), F.col("tag")))).alias("above"))
    own = own.join(above, ["page_id", "parent_id"], "left")
    single = F.array_compact(F.array(F.concat(F.lit("tag:"), F.col("tag")), count, leaves, depth))
    return own.select(*_KEY, F.array_sort(F.array_distinct(F.concat(single, "names", "words", F.coalesce("above", F.array().cast("array<string>"))))).alias("terms"))


# ---- spectral cuts


def affinity(terms: list[list[str]], counts: np.ndarray, least: float = 0.05) -> np.ndarray | None:
    """Cosines of binary TF-IDF vectors of distinct term sets that occur so often each; cosines under ``least`` are zero, None without a usable term.

    Terms of one node only or of all nodes are left out, unless that leaves none."""
    n, df = int(counts.sum()), {}
    for own, c in zip(terms, counts.tolist()):
        for t in own:
            df[t] = df.get(t, 0) + c
    used = {t for t, c in df.items() if 1 < c < n} or {t for t, c in df.items() if c > 1}
    if not used:
        return None
    place = {t: i for i, t in enumerate(sorted(used))}
    v = np.zeros((len(terms), len(place)))
    for i, own in enumerate(terms):
        for t in own:
            if t in place:
                v[i, place[t]] = np.log(1 + n / df[t])
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    v /= np.where(norm == 0, 1, norm)
    w = v @ v.T
    return np.where(w < least, 0, w)


def cheeger_cut(w: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(left, conductance, lambda2): the best cut of a sweep along the Fiedler vector of the normalised Laplacian.

    Row i stands for ``counts[i]`` like nodes. The vector is the same on all of them if its eigenvalue is under one, so the
    matrix over distinct rows has it."""
    own = counts - (np.diag(w) > 0)  # a node has no edge to itself
    between = w * counts[None, :]
    np.fill_diagonal(between, np.diag(w) * own)
    degree = between.sum(1)
    scale = np.sqrt(counts / degree)
    # similar to I - D^-1/2 W D^-1/2 on vectors that are constant on like nodes
    m = (w - np.diag(np.where(np.diag(w) > 0, np.diag(w) / counts, 0))) * scale[:, None] * scale[None, :]
    values, vectors = np.linalg.eigh(np.eye(len(w)) - (m + m.T) / 2)
    if len(values) < 2:
        return np.zeros(len(w), bool), 1.0, 2.0
    fiedler = vectors[:, 1] / np.sqrt(counts)
    volume, best, split = counts * degree, np.inf, 0
    order = np.lexsort((np.arange(len(w)), fiedler))
    inside = np.zeros(len(w), bool)
    for i, u in enumerate(order[:-1]):
        inside[u] = True
        cut = float((counts[inside][:, None] * between[np.ix_(inside, ~inside)]).sum())
        smaller = min(volume[inside].sum(), volume[~inside].sum())
        if smaller > 1e-10 and cut / smaller < best - 1e-12:
            best, split = cut / smaller, i + 1
    left = np.zeros(len(w), bool)
    left[order[:split]] = True
    return left, float(best), float(values[1])


def spectral_clusters(terms: list[list[str]], counts: list[int], most_cut: float = 0.5, most_lambda: float = 0.8, least: int = 2, depth: int = 12) -> list[int]:
    """A cluster for each distinct term set, -1 for what is in none: halves are cut again, weights anew for each, while the cut is good."""
    n = np.array(counts, dtype=np.int64)
    out, following = np.full(len(terms), -1), 0
    work = [(np.arange(len(terms)), 0)]
    while work:
        at, level = work.pop()
        size = int(n[at].sum())
        whole = size < 4 or level > depth
        w = None if whole else affinity([terms[i] for i in at], n[at])
        if w is not None:
            reach = (w * n[at][None, :]).sum(1) - np.diag(w) > 1e-10
            if not reach.all():
                work.append((at[reach], level + 1))
                if n[at[~reach]].sum() >= least:
                    out[at[~reach]], following = following, following + 1
                continue
            left, cut, second = cheeger_cut(w, n[at])
            if cut < most_cut and second < most_lambda and min(n[at[left]].sum(), n[at[~left]].sum()) >= least:
                work += [(at[left], level + 1), (at[~left], level + 1)]
                continue
        if size >= least:
            out[at], following = following, following + 1
    first = {}
    return [-1 if c < 0 else first.setdefault(c, len(first)) for c in out.tolist()]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [{"page_id": p, "cohort_id": c, "terms": t, "cluster": k} for p, c, sets in zip(*(batch.column(x).to_pylist() for x in ("page_id", "cohort_id", "sets"))) for t, k in zip([s["terms"] for s in sets], spectral_clusters([s["terms"] for s in sets], [s["n"] for s in sets]))]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("page_id", pa.int64()), ("cohort_id", pa.int32()), ("terms", pa.list_(pa.string())), ("cluster", pa.int32())]))


def spectral_cohorts(rows: DataFrame) -> DataFrame:
    """(page_id, cohort_id, node_id, cluster): siblings by recursive spectral cuts of their structural terms; -1: in no cluster.

    Only distinct term sets and how many siblings have each are gathered, so a cohort of many like siblings is small."""
    named = kept_large(cohorts(rows).join(structural_terms(rows), _KEY))
    sets = named.groupBy("page_id", "cohort_id", "terms").agg(F.count("*").alias("n"))
    cohort = sets.groupBy("page_id", "cohort_id").agg(F.array_sort(F.collect_list(F.struct("terms", "n"))).alias("sets"))
    cut = cohort.mapInArrow(_cut, "page_id long, cohort_id int, terms array<string>, cluster int")
    return named.join(cut, ["page_id", "cohort_id", "terms"]).select("page_id", "cohort_id", "node_id", "cluster")


# ---- signatures


def signatures(rows: DataFrame, depth: int = 6) -> DataFrame:
    """(page_id, node_id, s0 ... s<depth>): hashes of the subtree's tags in order, down to each depth. One join a level."""
    own = _plain(rows).select(*_KEY, "parent_id", "tag")
    digest = lambda kids: F.sha1(F.concat(F.col("tag"), F.lit("("), F.array_join(kids, ","), F.lit(")")))
    none = F.array().cast("array<string>")
    found = kept_large(own.withColumn("s0", digest(none)))
    for d in range(1, depth + 1):
        below = F.transform(F.array_sort(F.collect_list(F.struct("node_id", f"s{d - 1}"))), lambda x: x[f"s{d - 1}"])
        kids = found.groupBy("page_id", F.col("parent_id").alias("node_id")).agg(below.alias("below"))
        found = kept_large(found.join(kids, _KEY, "left").withColumn(f"s{d}", digest(F.coalesce("below", none))).drop("below"))
    return found.drop("parent_id", "tag")


def settled_groups(rows: DataFrame, depth: int = 6) -> DataFrame:
    """(page_id, cohort_id, node_id, depth, signature): siblings by the signature of the least depth, 1 at least, beyond which their groups don't change.

    Each depth refines the one before, so groups are the same if they are as many. Equal signatures of several cohorts are one group of the page."""
    named = kept_large(cohorts(rows).join(signatures(rows, depth), _KEY))
    counts = named.groupBy("page_id", "cohort_id").agg(*[F.countDistinct(f"s{d}").alias(f"c{d}") for d in range(depth + 1)])
    settled = F.coalesce(*[F.when(F.col(f"c{d}") == F.col(f"c{d - 1}"), F.lit(max(1, d - 1))) for d in range(1, depth + 1)], F.lit(depth))
    named = named.join(counts.select("page_id", "cohort_id", settled.alias("depth")), ["page_id", "cohort_id"])
    signature = F.element_at(F.array(*[F.col(f"s{d}") for d in range(depth + 1)]), F.col("depth") + 1)
    return named.select("page_id", "cohort_id", "node_id", "depth", signature.alias("signature"))


# ---- patterns of child tags


def pq_trees(rows: DataFrame, instances: DataFrame, depth: int = 4) -> DataFrame:
    """(pattern, place, above, position, kind, tag, n): PQ-trees of the instances (pattern, page_id, node_id) of each pattern.

    A node whose instances have their children all in one order is a Q node, of one bag in several orders a P node; its
    children are nodes again. Of different bags the longest (the first of these) is taken as order. Without children, or at
    ``depth``, it is a leaf. ``place`` is the path of positions from the root ('')."""
    kids = kept_large(children(rows))
    tags = lambda s: F.transform(s, lambda k: k.tag)
    at = instances.join(_plain(rows).select(*_KEY, "tag"), _KEY).select("pattern", *_KEY, "tag", F.lit("").alias("place"), F.lit(None).cast("string").alias("above"), F.lit(0).alias("position")).hint("merge")
    found, key = [], ["pattern", "place", "above", "position", "tag"]
    for level in range(depth + 1):
        # kept with its children, as it is read twice: for the forms and for the next level
        held = kept(at.join(kids, _KEY, "left")) if level < depth else at.withColumn("kids", F.lit(None).cast("array<struct<node_id:int,tag:string>>"))
        # a place has few orders of children and many instances: like ones are counted before orders are compared
        orders = held.groupBy(*key, tags(F.col("kids")).alias("order")).agg(F.count("*").alias("n"), F.max(F.struct(-F.col("page_id"), -F.col("node_id"))).alias("first"))
        forms = orders.groupBy(*key).agg(
            F.count("order").alias("orders"), F.count_distinct(F.array_sort("order")).alias("bags"), F.sum("n").alias("n"),
            F.max_by("order", F.struct(F.coalesce(F.size("order"), F.lit(0)), "first")).alias("order"),
        )
        forms = kept(forms.withColumn("kind", F.when(F.col("orders") == 0, "leaf").when(F.col("orders") == 1, "Q").when(F.col("bags") == 1, "P").otherwise("longest")))
        found.append(forms.select("pattern", "place", "above", "position", F.when(F.col("kind") == "longest", "Q").otherwise(F.col("kind")).alias("kind"), "tag", "n"))
        if level == depth:
            break
        wanted = F.when(F.col("kind") == "P", F.array_sort(F.array_distinct("order"))).when(F.col("kind") == "longest", F.col("order"))
        inner = held.where("kids is not null").select("pattern", "place", "page_id", "kids").join(side(forms.where("kind <> 'leaf'").select("pattern", "place", "kind", wanted.alias("wanted"))), ["pattern", "place"])  # few places, many instances of each
        at_place = lambda position, kid: F.struct(position.cast("int").alias("position"), kid.alias("kid"))
        in_order = F.transform("kids", lambda k, i: at_place(i, k))
        by_tag = F.transform("kids", lambda k: at_place(F.array_position("wanted", k.tag) - 1, k))
        first = F.filter(F.transform("wanted", lambda w, i: at_place(i, F.get(F.filter("kids", lambda k: k.tag == w), 0))), lambda x: x.kid.isNotNull())
        every = inner.select("pattern", "place", "page_id", F.explode(F.when(F.col("kind") == "Q", in_order).when(F.col("kind") == "P", by_tag).otherwise(first)).alias("x"))
        at = every.select("pattern", "page_id", F.col("x.kid.node_id").alias("node_id"), F.col("x.kid.tag").alias("tag"), F.concat("place", F.lit("/"), F.col("x.position").cast("string")).alias("place"), F.col("place").alias("above"), F.col("x.position").alias("position")).hint("merge")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def compiled(trees: DataFrame, heights: DataFrame) -> DataFrame:
    """(pattern, tag, kind, wanted, least_height): what the roots of PQ-trees ask of a node and its children.

    ``heights`` has (pattern, least_height)."""
    kids = trees.where("above = ''").groupBy("pattern").agg(F.array_sort(F.collect_list(F.struct("position", "tag"))).alias("kids"))
    roots = trees.where("above is null").select("pattern", "tag", "kind").join(kids, "pattern", "left").join(heights, "pattern")
    return roots.select("pattern", "tag", F.when(F.col("kind") == "Q", "Q").otherwise("P").alias("kind"), F.coalesce(F.transform("kids", lambda k: k.tag), F.array().cast("array<string>")).alias("wanted"), "least_height")


def _holds(kind: Column, wanted: Column, there: Column) -> Column:
    """Q: the wanted tags occur in this order, others between them; P: each at least as often."""
    step = lambda i, tag: F.when(F.get(wanted, i) == tag, i + 1).otherwise(i)
    in_order = F.aggregate(there, F.lit(0), step) == F.size(wanted)
    often = lambda tags, t: F.size(F.filter(tags, lambda x: x == t))
    return F.when(kind == "Q", in_order).otherwise(F.forall(wanted, lambda t: often(there, t) >= often(wanted, t)))


def fitting(bags: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows of ``bags`` (tag, there, height) with each pattern that such nodes match."""
    return bags.join(patterns, "tag").where((F.col("height") >= F.col("least_height")) & _holds(F.col("kind"), F.col("wanted"), F.col("there")))


def pattern_matches(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, page_id, node_id): all nodes that match each of ``patterns`` (``compiled``), found in one join on the tag.

    ``patterns`` has as many rows as there are templates; children are compared without leaving the JVM."""
    there = _plain(rows).join(children(rows), _KEY, "left").select(*_KEY, "tag", "height", F.coalesce(F.transform("kids", lambda k: k.tag), F.array().cast("array<string>")).alias("there"))
    bags = there.groupBy("tag", "there", "height").agg(F.count("*").alias("c")).drop("c")  # like nodes are compared once
    fits = fitting(bags, patterns).select("tag", "there", "height", "pattern")
    return there.join(fits, ["tag", "there", "height"]).select("pattern", *_KEY)
