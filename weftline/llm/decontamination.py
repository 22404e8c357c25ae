"""Benchmark decontamination with suffix arrays over the training texts.

Each task reads its texts in shards of some hundred kB and builds the suffix array of a shard: the positions of its words
in lexicographic order of what follows, by prefix doubling, as far as a window reaches.  Words that no benchmark item has
and the ends of texts are stops, at which any match ends.  Every suffix of every benchmark item is binary-searched there.
The ranges found give the words hit and the items, and their matches that can't grow to the left are extended to the
right: the longest verbatim matches with their places.

A window is 13 consecutive words of an item; an item of fewer words is one window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .shared import bounded_batches, stash

#: Words of a window, hundredths of a text's words that must be hit, and benchmark bytes that are broadcast at once.
WINDOW, PERCENT, CHUNK_BYTES = 13, 5, 32 << 20

MATCHES = "array<struct<item_id string, doc_start long, item_start long, length long>>"


@dataclass(frozen=True)
class Suffixes:
    """A chunk of the benchmark: items one after another as ranks of words in ``vocabulary``, each followed by a stop (0),
    and the places of all suffixes that begin a window, by window length."""

    items: list[str]
    vocabulary: np.ndarray
    words: np.ndarray
    owner: np.ndarray
    starts: np.ndarray
    by_length: dict[int, np.ndarray]


def _suffixes(rows: list[tuple[str, str | None]], window: int) -> Suffixes:
    items, parts = [], []
    with np.errstate(over="ignore"):
        for item, text in rows:
            words, _ = kernels.hash_words([(text or "").encode("utf-8", "surrogatepass")], kernels.WORD_ALNUM)
            if len(words):
                items.append(item)
                parts.append(words)
    size = np.array([len(x) for x in parts], np.int64)
    starts = np.cumsum(size + 1) - size - 1
    vocabulary, rank = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_inverse=True)
    by_length: dict[int, list[np.ndarray]] = {}
    for first, n in zip(starts.tolist(), size.tolist()):
        k = min(window, n)
        by_length.setdefault(k, []).append(np.arange(first, first + n - k + 1))
    words = np.insert(rank + 1, np.cumsum(size), 0)
    return Suffixes(items, vocabulary, words, np.repeat(np.arange(len(items)), size + 1), starts, {k: np.concatenate(x) for k, x in by_length.items()})


def _ranked(own: np.ndarray, test: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """One step of prefix doubling: from ranks of the next n words to those of the next n + step, in a shard and in a test
    text. 0 stands for a stop within these words, or for words that the shard doesn't have there."""

    def joined(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        if step < len(x):
            both = (x[:-step] > 0) & (x[step:] > 0)
            out[:-step] = np.where(both, (x[:-step] << 31) | x[step:], 0)
        return out

    own, test = joined(own), joined(test)
    at, sought = np.flatnonzero(own), np.flatnonzero(test)
    known, rank = np.unique(own[at], return_inverse=True)
    own[at] = rank + 1
    place = np.minimum(np.searchsorted(known, test[sought]), max(len(known) - 1, 0))
    test[sought] = np.where(known[place] == test[sought], place + 1, 0) if len(known) else 0
    return own, test


def _search(words: np.ndarray, test: Suffixes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each window length: (length, suffix array, test suffixes that occur, their ranges in the array: low, high)."""
    own, sought, n = words, test.words, 1
    levels = {1: (own, sought)}
    while 2 * n <= max(test.by_length, default=0):
        own, sought = _ranked(own, sought, n)
        n *= 2
        levels[n] = own, sought
    for k, suffixes in test.by_length.items():
        n = 1 << (k.bit_length() - 1)
        own, sought = _ranked(*levels[n], k - n) if k > n else levels[n]  # the same words, joined with an overlap
        at = np.flatnonzero(own)
        array = at[np.argsort(own[at], kind="stable")]
        suffixes = suffixes[sought[suffixes] > 0]
        low, high = (np.searchsorted(own[array], sought[suffixes], side) for side in ("left", "right"))
        there = high > low
        if there.any():
            yield k, array, suffixes[there], low[there], high[there]


def _longest(words: np.ndarray, test: Suffixes, k: int, array: np.ndarray, suffixes: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int, int]]:
    """Matches of at least k words that can't grow: (text position, test position, words)."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    order = np.argsort(low, kind="stable")
    start = np.flatnonzero(np.diff(low[order], prepend=-1))
    for a, b in zip(start.tolist(), [*start[1:].tolist(), len(order)]):
        own, tests = array[low[order[a]] : high[order[a]]], suffixes[order[a:b]]
        before = np.where(own > 0, words[own - 1], 0)
        ahead = np.where(tests > 0, test.words[tests - 1], 0)
        for symbol in np.unique(ahead).tolist():  # what stands before differs, or is a stop
            p, q = own[(before != symbol) | (before == 0)], tests[ahead == symbol]
            found.append((np.repeat(p, len(q)), np.tile(q, len(p))))
    if not found:
        return []
    p, q = (np.concatenate(x) for x in zip(*found))
    length, grows = np.full(len(p), k), np.arange(len(p))
    while len(grows):
        a, b = p[grows] + length[grows], q[grows] + length[grows]
        own = np.where(a < len(words), words[np.minimum(a, len(words) - 1)], 0)
        grows = grows[(own > 0) & (own == test.words[np.minimum(b, len(test.words) - 1)])]
        length[grows] += 1
    return list(zip(p.tolist(), q.tolist(), length.tolist()))


def _scan(held, keep_matches: bool):
    """For each text: its number of words, the spans of words hit, the items, and maximal matches."""

    def scan(texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int]], list[str], list[dict]]]:
        test: Suffixes = held.value
        for _, run in kernels.buffers(texts):
            with np.errstate(over="ignore"):
                words, bounds = kernels.hash_words(run, kernels.WORD_ALNUM)
            size = np.diff(bounds)
            first = bounds[:-1] + np.arange(len(run))  # a stop follows each text
            if not len(test.vocabulary):
                yield from ((n, [], [], []) for n in size.tolist())
                continue
            place = np.minimum(np.searchsorted(test.vocabulary, words), len(test.vocabulary) - 1)
            ranks = np.insert(np.where(test.vocabulary[place] == words, place + 1, 0), bounds[1:], 0)
            edge = np.zeros(len(ranks) + 1, np.int64)
            items: dict[int, set[str]] = {}
            matches: dict[int, list[dict]] = {}
            for k, array, suffixes, low, high in _search(ranks, test):
                cover = np.zeros(len(array) + 1, np.int64)
                np.add.at(cover, low, 1)
                np.add.at(cover, high, -1)
                p = array[np.cumsum(cover)[:-1] > 0]
                np.add.at(edge, p, 1)
                np.add.at(edge, p + k, -1)
                classes = np.unique(np.stack([low, high, test.owner[suffixes]]), axis=1)
                for a, b, owner in classes.T.tolist():
                    for i in np.unique(np.searchsorted(first, array[a:b], "right") - 1).tolist():
                        items.setdefault(i, set()).add(test.items[owner])
                for a, b, m in _longest(ranks, test, k, array, suffixes, low, high) if keep_matches else ():
                    i, owner = int(np.searchsorted(first, a, "right")) - 1, int(test.owner[b])
                    found = {"item_id": test.items[owner], "doc_start": a - int(first[i]), "item_start": b - int(test.starts[owner]), "length": m}
                    matches.setdefault(i, []).append(found)
            inside = np.cumsum(edge)[:-1] > 0
            for i, n in enumerate(size.tolist()):
                if i not in items:
                    yield n, [], [], []
                    continue
                step = np.diff(np.concatenate(([0], inside[first[i] : first[i] + n].astype(np.int8), [0])))
                yield n, list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist())), sorted(items[i]), matches.get(i, [])

    return scan


def _merged(spans: list[tuple[int, int]]) -> int:
    """Words in a union of spans."""
    total, reach = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def _facts(n: int, spans: list[tuple[int, int]], items: list[str], percent: int) -> tuple[int, int, int, str, bool]:
    hit = _merged(spans)
    return n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0 and 100 * hit >= percent * n


def _parts(benchmark: DataFrame, chunk_bytes: int) -> int:
    return 1 + int((benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // chunk_bytes)


def _chunks(benchmark: DataFrame, window: int, parts: int) -> Iterator[Suffixes]:
    """The benchmark in chunks; the driver holds one at a time."""
    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    for i in range(parts):
        own = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == i).collect()
        yield _suffixes([(x["item_id"], x["text"]) for x in own], window)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = PERCENT, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, matches) per row of ``docs`` (doc_id, text; other columns are ignored).

    ``benchmark`` has item_id and text; items with a null id or without words are left out, and items that share an id
    are one.  A text is contaminated if it has a hit and at least ``percent`` hundredths of its words are hit.
    ``matches`` are the maximal verbatim matches.  Null and empty texts have no words.  Either table may be empty.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = _hits(rows, benchmark, window, chunk_bytes)
    merged = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("reach")),
        lambda s, x: F.struct((s.total + F.greatest(F.lit(0), x[1] - F.greatest(x[0], s.reach))).cast("long").alias("total"), F.greatest(s.reach, x[1]).alias("reach")),
        lambda s: s.total,
    )
    n_hit = merged
    out = out.withColumn("n_hit", n_hit)
    joined = F.array_join("items", ",")
    contaminated = (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(joined, "UTF-8"), 256).alias("items_sha256"), contaminated.alias("contaminated"), "matches")


def _hits(rows: DataFrame, benchmark: DataFrame, window: int, chunk_bytes: int) -> DataFrame:
    """(row, doc_id, n_words, spans, items, matches) for each of ``rows`` (doc_id, text). A benchmark of several chunks is
    searched chunk after chunk, and what they hit is put together by row."""
    spark = rows.sparkSession
    bounded_batches(spark)
    schema = f"row long, doc_id long, n_words long, spans array<array<long>>, items array<string>, matches {MATCHES}"
    parts = _parts(benchmark, chunk_bytes)
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = stash(rows, "rows") if parts > 1 else rows
    found = []
    for test in _chunks(benchmark, window, parts):
        held = spark.sparkContext.broadcast(test)
        part = rows.mapInArrow(_rows(held), schema)
        if parts == 1:
            return part
        found.append(stash(part if not found else part.where("size(spans) > 0"), "hits"))
        held.destroy()
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.groupBy("row").agg(
        F.min("doc_id").alias("doc_id"), F.min("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("matches")).alias("matches"),
    )


def _rows(held):
    names = ["row", "doc_id", "n_words", "spans", "items", "matches"]
    match = pa.list_(pa.struct([("item_id", pa.string()), ("doc_start", pa.int64()), ("item_start", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scan(held, True)
        for batch in batches:
            if batch.num_rows:
                n, spans, items, matches = zip(*scan(batch.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string())), pa.array(matches, match)], names
                )

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = PERCENT, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of ``docs`` (with all their columns) that aren't contaminated; see ``contamination``. Each row is judged by
    its own text, whatever its doc_id is, and however many chunks the benchmark has."""
    bounded_batches(docs.sparkSession)
    parts = _parts(benchmark, chunk_bytes)
    if parts == 1:
        held = docs.sparkSession.sparkContext.broadcast(next(_chunks(benchmark, window, 1)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scan = _scan(held, False)
            for batch in batches:
                found = scan(batch.column(batch.schema.get_field_index("text")).to_pylist())
                yield batch.filter(pa.array([not _facts(n, spans, items, percent)[-1] for n, spans, items, _ in found], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)
    key = "weftline_row"
    rows = stash(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    bad = contamination(rows.select(F.col(key).alias("doc_id"), "text"), benchmark, window, percent, chunk_bytes).where("contaminated")
    return rows.join(bad.select(F.col("doc_id").alias(key)), key, "left_anti").drop(key).select(docs.columns)
