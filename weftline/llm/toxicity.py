"""Toxicity by a subsequence-kernel support vector machine with Nyström landmarks.

A text is a bag of words (runs without white space; a run of single letters counts as one word, so spelt-out insults are
words), each with a mark at its start.  Two words are compared by the gap-weighted subsequence kernel: every choice of
four bytes within ``SPAN`` bytes of a word weighs DECAY to the power of the span, so inserted characters lower the kernel
but don't break it (subsequences are hashed to 21 bits, which is a kernel too).  Words are mapped to the kernel values with a few landmark strings and whitened (Nyström); a linear
SVM is trained there.

Labels hold for whole texts, while a few words make a text toxic.  So training alternates (multiple-instance learning): a
first machine takes every word of every text (one Newton step from zero, whose sums Spark adds up); then each text is
represented by its ``WITNESSES`` worst words, against the sums of all clean words, and the SVM is trained again on them.
A text's score is a logistic function of the values of its worst words and of the share of its words beyond the
machine's boundary.  Virtual examples, toxic texts whose worst words have a character inserted, help to place that curve.

An SVM over landmarks is linear in the subsequences of the landmarks, so the trained model is one table of weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .shared import bounded_batches, stash

#: Length and decay of the kernel's gaps; landmarks; labelled texts of each class that training reads at most; rounds of
#: training; worst words of a text.
SPAN, DECAY, LANDMARKS, SAMPLE_TOXIC, SAMPLE_CLEAN, ROUNDS, WITNESSES = 6, 0.9, 192, 4000, 8000, 4, 3
#: Strings among which landmarks are chosen, and the kernel beyond which a string adds nothing to one that is chosen.
CANDIDATES, ALIKE = 1500, 0.8
#: The least value of a word that counts among a text's facts (texts of few words are not set apart by it), and the weight of
#: texts with inserted characters beside those as they stand.
FLOOR, INSERTED = -0.5, 0.6

#: Codes of bytes, the one that marks the start of a word, and hashed subsequences.
_CODES, _START, _HASHES = 128, 61, 1 << 21


def _code_table() -> np.ndarray:
    """Bytes to codes: 0 for white space, one for each letter, one for all digits, for each other ASCII sign, each continuation byte, and one for all other bytes."""
    table = np.full(256, 1, dtype=np.int32)
    table[97:123] = np.arange(2, 28)
    table[48:58] = 28
    signs = [i for i in range(256) if i < 128 and not (48 <= i < 58 or 97 <= i < 123 or 65 <= i < 91 or i <= 32 or i == 127)]
    table[signs] = np.arange(29, 29 + len(signs))
    table[128:192] = np.arange(64) + 64
    table[[9, 10, 11, 12, 13, 32]] = 0
    return table


CODE = _code_table()
PATTERNS = [(a, b, c) for c in range(3, SPAN) for b in range(2, c) for a in range(1, b)]
#: Random bits of each code at each place of a subsequence.
_BITS = np.random.default_rng(20240608).integers(0, _HASHES, (4, _CODES), dtype=np.int32)


def _joined_letters(raw: bytes) -> bytes:
    """Single letters in a row, as in "a b c", become one word."""
    words = raw.split()
    if sum(len(w) == 1 for w in words) < 3:
        return raw
    out: list[bytes] = []
    run = 0
    for w in words:
        if len(w) == 1 and run:
            out[-1] += w
        else:
            out.append(w)
        run = run + 1 if len(w) == 1 else 0
    return b" ".join(out)


def _words(run: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Codes of the joined texts with bounds of words, the mark before each included: (codes, starts, ends, word bounds of
    each text, bytes)."""
    run = [_joined_letters(x) for x in run]
    raw = b" " + b" ".join(run) + b" "
    codes = CODE[kernels.LOWER[np.frombuffer(raw, np.uint8)]]
    starts, ends = kernels.spans(codes > 0)
    bounds = np.concatenate(([0], np.searchsorted(starts, 1 + np.cumsum([len(x) + 1 for x in run]))))
    codes[starts - 1] = _START
    return codes, starts - 1, ends, bounds, raw


def _norm(size: np.ndarray) -> np.ndarray:
    """Length of a word's feature vector if no subsequence recurs in it."""
    total = np.zeros(len(size))
    for _, _, c in PATTERNS:
        total += np.maximum(size - c, 0) * DECAY ** (2 * (c + 1))
    return np.sqrt(np.maximum(total, 1e-12))


def _subsequences(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each gap pattern: positions that fit in their word, the subsequence there, and its weight."""
    left = np.zeros(len(codes), dtype=np.int32)
    size = ends - starts
    inside = np.flatnonzero(codes)
    left[inside] = np.repeat(size, size) - (np.arange(len(inside)) - np.repeat(np.cumsum(size) - size, size))
    bits = [x[codes] for x in _BITS]
    for a, b, c in PATTERNS:
        at = np.flatnonzero(left > c)
        yield at, bits[0][at] ^ bits[1][at + a] ^ bits[2][at + b] ^ bits[3][at + c], DECAY ** (c + 1)


def word_values(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The model's linear value of each word; words of under three bytes have 0."""
    if not len(starts):
        return np.zeros(0)
    total = np.zeros(len(codes))
    for at, sub, decay in _subsequences(codes, starts, ends):
        total[at] += weights[sub] * decay
    return np.add.reduceat(total, starts) / _norm(ends - starts)


@dataclass(frozen=True)
class Model:
    """``weights``: of subsequences. ``bias``: of the SVM. ``slopes``: of a text's facts in the logistic curve, with the offset last."""

    weights: np.ndarray
    bias: float
    slopes: np.ndarray

    def score(self, facts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(facts @ self.slopes[:-1] + self.slopes[-1], -30, 30)))


def _features(words: list[bytes], marks: list[bytes]) -> np.ndarray:
    """Kernel of each word with each landmark."""
    run = [b" ".join(marks)]
    codes, starts, ends, _, _ = _words(run)
    owner = np.searchsorted(starts, np.arange(len(codes)), side="right") - 1
    subs = [(sub, owner[at], decay / _norm(ends - starts)[owner[at]]) for at, sub, decay in _subsequences(codes, starts, ends)]
    sub, mark, value = (np.concatenate(x) for x in zip(*subs))
    known, row = np.unique(sub, return_inverse=True)
    table = np.zeros((len(known), len(starts)), dtype=np.float32)
    np.add.at(table, (row, mark), value)
    index = np.full(_HASHES, -1, dtype=np.int32)
    index[known] = np.arange(len(known))
    out = np.zeros((len(words), len(starts)), dtype=np.float32)
    for first in range(0, len(words), 20_000):
        codes, starts, ends, _, _ = _words([b" ".join(words[first : first + 20_000])])
        owner = np.searchsorted(starts, np.arange(len(codes)), side="right") - 1
        norm = _norm(ends - starts)
        part = np.zeros((len(starts), table.shape[1]), dtype=np.float32)
        for at, sub, decay in _subsequences(codes, starts, ends):
            hit = index[sub]
            at, hit = at[hit >= 0], hit[hit >= 0]
            for low in range(0, len(at), 50_000):
                own, add = owner[at[low : low + 50_000]], table[hit[low : low + 50_000]]
                edge = np.flatnonzero(np.diff(own, prepend=-1))
                if len(edge):
                    part[own[edge]] += np.add.reduceat(add, edge) * np.float32(decay)
        out[first : first + len(starts)] = part / norm[:, None]
    return out


def _svm(x: np.ndarray, plus: np.ndarray, minus: np.ndarray, base: tuple[np.ndarray, np.ndarray], ridge: float = 1e-3) -> np.ndarray:
    """Linear SVM with squared hinge loss by Newton steps; each row counts for both classes, by these weights. ``base`` is
    the matrix and the vector of rows that always count. The bias comes last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    beta, penalty = np.zeros(x.shape[1]), _penalty(x.shape[1], ridge)
    for _ in range(25):
        value = x @ beta
        up, down = plus * (value < 1), minus * (value > -1)
        part, weight = x[up + down > 0], (up + down)[up + down > 0, None]
        new = np.linalg.solve(part.T @ (part * weight) + base[0] + penalty, part.T @ (up - down)[up + down > 0] + base[1])
        if np.allclose(new, beta, atol=1e-6):
            break
        beta = new
    return beta


def _penalty(size: int, ridge: float) -> np.ndarray:
    penalty = np.eye(size) * ridge
    penalty[-1, -1] *= 1e-3
    return penalty


def _word_sums(words: DataFrame, marks: list[bytes], whiten: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray, float]]:
    """For both classes (t, c): the sums of x x' and of x over all words, and of the words' counts. The driver adds one row for each task."""
    size = whiten.shape[1] + 1
    names = ["t", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size + 1, size))
        for batch in _gathered(batches, 20_000):
            x = _features(batch.column("word").to_pylist(), marks) @ whiten
            x = np.hstack([x, np.ones((len(x), 1))])
            for k, name in enumerate(names):
                weight = batch.column(name).to_numpy()[:, None]
                total[k, :-1] += x.T @ (x * weight)
                total[k, -1] += (x * weight).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    total = np.zeros((2, size + 1, size))
    for x in words.mapInArrow(run, "sums binary").toLocalIterator():
        total += np.frombuffer(x["sums"]).reshape(total.shape)
    return {name: (total[k, :-1], total[k, -1], float(total[k, -1, -1])) for k, name in enumerate(names)}


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together until they have so many rows."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def _logistic(facts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slopes and offset of the logistic curve through 0/1 labels, slightly smoothed."""
    x, target = np.hstack([facts, np.ones((len(facts), 1))]), np.clip(y, 0.01, 0.99)
    beta, ridge = np.zeros(x.shape[1]), 1e-2 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + ridge, x.T @ (weight * (target - p)) - ridge @ beta)
        beta += np.clip(step, -5, 5)
    return beta


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, toxic = [], []
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            own = {w for w in _joined_letters((text or "").encode("utf-8", "replace").lower()).split() if len(w) >= 2}
            words += own
            toxic += [label] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(toxic, pa.int64())], ["word", "toxic"])


def worst_words(texts: list[str | None], model: Model) -> tuple[np.ndarray, list[list[bytes]], list[int]]:
    """Facts of each text, its worst words, and the number of its words. The facts are the WITNESSES largest values of its words (at least
    FLOOR, also where it has fewer), and the logarithm of the share of words with a positive value."""
    facts: list[list[float]] = []
    worst: list[list[bytes]] = []
    sizes: list[int] = []
    for _, run in kernels.buffers(texts):
        codes, starts, ends, bounds, raw = _words(run)
        values = word_values(codes, starts, ends, model.weights) + model.bias
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            own = values[low:high]
            top = np.argpartition(-own, WITNESSES)[:WITNESSES] if len(own) > WITNESSES else np.arange(len(own))
            top = top[np.argsort(-own[top], kind="stable")]
            beyond = np.log((int((own > 0).sum()) + 0.05) / (len(own) + 5))
            facts.append([*np.maximum(own[top], FLOOR).tolist(), *[FLOOR] * (WITNESSES - len(top)), beyond])
            sizes.append(len(own))
            worst.append([raw[starts[low + k] + 1 : ends[low + k]].lower() for k in top.tolist()])
    return np.array(facts).reshape(-1, WITNESSES + 1), worst, sizes


def _worst(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts, words, sizes = worst_words(batch.column("text").to_pylist(), held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(facts), pa.list_(pa.float64())), pa.array(words, pa.list_(pa.binary())), pa.array(sizes, pa.int64())], ["toxic", "facts", "words", "n"])

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word's pieces of five bytes, and of seven at its start, with the word's counts. A blank is the start of a word."""
    for batch in batches:
        own = [{w[:8], *(w[i : i + 5] for i in range(len(w) - 4))} for w in (b" " + x for x in batch.column("word").to_pylist())]
        at = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
        yield pa.RecordBatch.from_arrays([pa.array([x for pieces in own for x in pieces], pa.binary()), batch.column("t").take(at), batch.column("c").take(at)], ["piece", "t", "c"])


def _landmarks(words: DataFrame, texts: tuple[int, int], limit: int) -> list[bytes]:
    """Strings that set toxic texts apart, by the gap between the rates of the pieces of all ``words`` (word, t, c), no two
    of them much alike, so that rarer groups of insults have their own; a quarter are words of many clean texts."""
    pieces = words.mapInArrow(_pieces, "piece binary, t long, c long").groupBy("piece").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    toxic, clean = ((F.col(x) + 0.5) / (n + 1.0) for x, n in zip("tc", texts))
    value = (toxic - clean) / F.sqrt((toxic + clean) / 2 / min(texts))
    best = pieces.orderBy(F.desc(value), F.desc(F.col("t") + F.col("c")), F.xxhash64("piece"), "piece").limit(CANDIDATES)
    often = words.orderBy(F.desc("c"), F.desc("t"), F.xxhash64("word"), "word").limit(limit)
    pieces, common = ([bytes(x[0]).strip() for x in rows.collect()] for rows in (best.select("piece"), often.select("word")))
    chosen = _apart(list(dict.fromkeys(pieces)), limit * 3 // 4)
    return list(dict.fromkeys([*chosen, *common]))[:limit]


def _apart(strings: list[bytes], limit: int) -> list[bytes]:
    """The first strings that aren't much like one chosen before."""
    strings = [x for x in strings if len(x) >= 2]
    if not strings:
        return []
    kernel = _features(strings, strings)
    nearest, chosen = np.zeros(len(strings)), []
    for k in range(len(strings)):
        if nearest[k] < ALIKE:
            chosen.append(strings[k])
            nearest = np.maximum(nearest, kernel[:, k])
            if len(chosen) == limit:
                break
    return chosen


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Train on rows of ``labels`` (doc_id, toxic) outside the held-out fold, at most SAMPLE_TOXIC and SAMPLE_CLEAN texts.

    All words of these texts count.  The driver gets candidates for landmarks, sums of landmarks by landmarks and
    WITNESSES words of each sampled text, never texts.  None without labelled texts of both classes or without words.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("long").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("toxic = 1").orderBy(*order).limit(SAMPLE_TOXIC).union(known.where("toxic = 0").orderBy(*order).limit(SAMPLE_CLEAN))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = stash(texts.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic"), "labelled")
    sizes = {x["toxic"]: x["count"] for x in texts.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    stats = texts.select("text", "toxic").mapInArrow(_distinct_words, "word binary, toxic long").groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    words = stash(stats.select("word", "t", (F.col("n") - F.col("t")).alias("c")), "words")
    marks = _landmarks(words, (sizes[1], sizes[0]), LANDMARKS)
    if not marks:
        return None
    gram = _features(marks, marks).astype(np.float64)
    gram = (gram + gram.T) / 2
    low, axes = np.linalg.eigh(gram)
    keep = low > 1e-3 * low[-1]
    whiten = axes[:, keep] / np.sqrt(low[keep])

    sums = _word_sums(words, marks, whiten)
    (toxic, up, _), (clean, down, all_clean) = sums["t"], sums["c"]
    texts_of = sizes[1], sizes[0]
    beta = np.linalg.solve(toxic / texts_of[0] + clean / texts_of[1] + _penalty(len(up), 1e-2), up / texts_of[0] - down / texts_of[1])
    background = (clean * (0.5 / max(all_clean, 1)), down * (-0.5 / max(all_clean, 1)))
    for turn in range(ROUNDS):
        model = Model(_primal(marks, whiten @ beta[:-1]), float(beta[-1]), np.zeros(WITNESSES + 2))
        rows = texts.select("toxic", "text").mapInArrow(_worst(spark.sparkContext.broadcast(model)), "toxic long, facts array<double>, words array<binary>, n long").collect()
        label = np.array([x["toxic"] for x in rows], float)
        if turn == ROUNDS - 1:
            break
        witness = [bytes(w) for x in rows for w in x["words"]]
        owner = np.repeat(np.arange(len(rows)), [len(x["words"]) for x in rows])
        worst, back = np.unique(np.array(witness, object), return_inverse=True)
        share = 1 / np.bincount(owner, minlength=len(rows))[owner]
        plus = np.bincount(back, share * label[owner], len(worst)) / label.sum()
        minus = np.bincount(back, share * (1 - label)[owner], len(worst)) / (1 - label).sum()
        beta = _svm(_features(list(worst), marks) @ whiten, plus, minus, background)
    virtual = _with_insertions([x for x in rows if x["toxic"]], lambda words: _features(words, marks) @ whiten @ beta[:-1] + beta[-1])
    facts = np.concatenate([np.array([x["facts"] for x in rows]), virtual])
    weight = np.concatenate([np.ones(len(rows)), np.full(len(virtual), INSERTED)])
    return Model(model.weights, model.bias, _logistic(facts, np.append(label, np.ones(len(virtual))), weight))


def _with_insertions(rows: list, value: Callable[[list[bytes]], np.ndarray]) -> np.ndarray:
    """Facts of texts if their worst words had a sign inserted: a word's value is the mean over its places."""
    made: dict[bytes, float] = {}
    for w in sorted({bytes(w) for x in rows for w in x["words"]}):
        made[w] = 0.0
    spelt = [[w[:i] + b"." + w[i:] for i in range(1, min(len(w), SPAN + 3))] or [w] for w in made]
    flat = value([v for x in spelt for v in x]) if spelt else np.zeros(0)
    made = dict(zip(made, (float(x.mean()) for x in np.split(flat, np.cumsum([len(x) for x in spelt])[:-1])))) if spelt else {}
    out = []
    for x in rows:
        own = sorted((made[bytes(w)] for w in x["words"]), reverse=True)
        lost = sum(v > 0 for v in x["facts"][: len(own)]) - sum(v > 0 for v in own)
        share = max(np.exp(x["facts"][-1]) * (x["n"] + 5) - lost, 0.05) / (x["n"] + 5)
        out.append([*(max(v, FLOOR) for v in own), *[FLOOR] * (WITNESSES - len(own)), np.log(share)])
    return np.array(out).reshape(-1, WITNESSES + 1)


def _primal(marks: list[bytes], alpha: np.ndarray) -> np.ndarray:
    """The weight of each subsequence in the sum of landmarks with these factors."""
    codes, starts, ends, _, _ = _words([b" ".join(marks)])
    owner = np.searchsorted(starts, np.arange(len(codes)), side="right") - 1
    factor = alpha / _norm(ends - starts)
    weights = np.zeros(_HASHES)
    for at, sub, decay in _subsequences(codes, starts, ends):
        np.add.at(weights, sub, factor[owner[at]] * decay)
    return weights.astype(np.float32)


def held_out(doc_id):
    """Whether a row is in the fold that training never sees: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs`` (doc_id, text; other columns are ignored).

    Null, empty and blank texts and words of under three bytes have the value of a word without known subsequences.  A null doc_id
    is not held out.  Without labelled texts of both classes all scores are 0.  Ties and repeated rows are scored alike;
    very long texts count with all their words.  An empty table gives no rows.
    """
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = [F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")]
    if model is None:
        return rows.select("doc_id", *out, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts, *_ = worst_words(batch.column("text").to_pylist(), held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.score(facts))], ["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", *out, "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that aren't predicted toxic; see ``toxicity``."""
    model = train(docs, labels)
    if model is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts, *_ = worst_words(batch.column(batch.schema.get_field_index("text")).to_pylist(), held.value)
            yield batch.filter(pa.array(held.value.score(facts) < 0.5, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
