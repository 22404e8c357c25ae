"""Language-model scoring by cross-entropy difference.

Two bigram models of the same form, one of target texts and one of all texts, share one vocabulary: all words of all
texts.  A text's score is its mean loss per token under the target model minus that under the background model, so
lower is nearer to the target.  Each model mixes its bigrams with its word frequencies:
p(w | h) = D c(h w) / c(h) + (1 - D) p(w), and p(w) alone if h doesn't occur.

Counts cover all texts, all target texts, and every word and bigram.  They travel in two shuffles.  Texts are dealt to
chunks of some MB; a chunk sends each of its distinct n-grams once, with its own counts, to the n-gram's bucket (the first
bits of its hash).  A bucket adds up the counts of all chunks and answers each chunk with the totals of the n-grams that
the chunk sent, in the same order, so answers hold no keys.  A chunk then scores its texts.  No table of n-grams is
broadcast or held in one place, and a frequent n-gram is one number per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .shared import bounded_batches

#: Weight of the bigrams.
MIX = 0.7
#: Bytes of text of a chunk, and n-grams of a bucket (of which each chunk sends some).
CHUNK_BYTES, BUCKET_KEYS = 8 << 20, 2_000_000
#: Target ids that may be broadcast (8 bytes each); more are joined by a shuffle.
FEW_IDS = 1_000_000
#: Stand for the start and the end of a text; words' hashes are other numbers.
START, END, FIRST = 1, 2, 3
#: Words that a task gathers before it passes them on.
_COUNTED = 2_000_000
_U = np.uint64


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key of the bigram, key of the word, tokens of each text) for each word and each text's end. Keys of bigrams are odd
    hashes, those of words even ones."""
    bigrams, words, sizes = [np.zeros(0, _U)], [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    with np.errstate(over="ignore"):
        for _, run in kernels.buffers(texts):
            own, bounds = kernels.hash_words(run, kernels.WORD_NOT_SPACE)
            word, n = np.insert(own, bounds[1:], _U(END)), np.diff(bounds) + 1
            history = np.empty_like(word)
            history[1:] = word[:-1]
            history[np.cumsum(n) - n] = START
            bigrams.append(kernels.mix64(history * _U(0xD6E8FEB86659FD93) + word) | _U(1))
            words.append(_word_key(word))
            sizes.append(n)
    return np.concatenate(bigrams), np.concatenate(words), np.concatenate(sizes)


def _word_key(word: np.ndarray) -> np.ndarray:
    return kernels.mix64(word) & ~_U(1)


def _counted(keys: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs in all texts and in target texts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    start = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    n = np.diff(start, append=len(keys))
    return keys[start], n, np.add.reduceat(target[order].astype(np.int64), start) if len(start) else n


def _packed(keys: np.ndarray) -> bytes:
    """Ascending keys: how many bytes a difference has, the first key, and the differences."""
    gaps = np.diff(keys)
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    width = raw[0]
    gaps = np.zeros((1 + (len(raw) - 9) // width, 8), np.uint8)
    gaps[0] = np.frombuffer(raw, np.uint8, 8, 1)
    gaps[1:, :width] = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, width)
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)


def _planes(values: np.ndarray) -> bytes:
    """64-bit numbers, all their first bytes before all second ones and so on: bytes that are mostly zero compress well."""
    return values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _values(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _cuts(keys: np.ndarray, bits: int) -> tuple[np.ndarray, list[slice]]:
    """Buckets of ascending keys, and where each lies."""
    bucket = (keys >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    start = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), bucket[1:] != bucket[:-1])))
    return bucket[start], [slice(a, b) for a, b in zip(start.tolist(), [*start[1:].tolist(), len(keys)])]


def _words(bits: int):
    """Distinct words by bucket, of some millions of tokens at a time; and, with a null bucket, tokens of all and of target texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, total, aim = [], 0, 0, 0
        names = ["bucket", "keys", "n", "t"]

        def out() -> pa.RecordBatch:
            keys = np.unique(np.concatenate(held))
            bucket, cut = _cuts(keys, bits)
            nothing = pa.nulls(len(cut), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array([_packed(keys[c]) for c in cut], pa.binary()), nothing, nothing], names)

        for batch in batches:
            _, words, sizes = _tokens(batch.column("text").to_pylist())
            total, aim = total + len(words), aim + int(sizes[np.array(batch.column("target").to_pylist(), bool)].sum())
            held.append(np.unique(words))
            size += len(held[-1])
            if size > _COUNTED:
                yield out()
                held, size = [], 0
        if size:
            yield out()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total]), pa.array([aim])], names)

    return run


def _distinct(rows: pa.Table) -> pa.Table:
    """How many distinct words a bucket has; tokens are passed on."""
    if rows["bucket"].null_count:
        return rows.select(["n", "t"]).append_column("words", pa.array([0] * len(rows), pa.int64()))
    words = len(np.unique(np.concatenate([_unpacked(x) for x in rows["keys"].to_pylist()])))
    return pa.table({"n": pa.array([0]), "t": pa.array([0]), "words": pa.array([words])})


def _ask(bits: int):
    """A chunk's n-grams with its counts, one row for each bucket."""

    def run(texts: pa.Table) -> pa.Table:
        bigrams, words, sizes = _tokens(texts["text"].to_pylist())
        target = np.repeat(np.array(texts["target"].to_pylist(), bool), sizes)
        keys, n, t = _counted(np.concatenate([bigrams, words]), np.concatenate([target, target]))
        bucket, cut = _cuts(keys, bits)
        columns = {name: pa.array([code(x[c]) for c in cut], pa.binary()) for name, x, code in (("keys", keys, _packed), ("n", n, _planes), ("t", t, _planes))}
        return pa.table({"chunk": pa.array([texts["chunk"][0].as_py()] * len(cut), pa.int64()), "bucket": pa.array(bucket), **columns})

    return run


def _answer(rows: pa.Table) -> pa.Table:
    """The sums over all chunks for each chunk's n-grams of a bucket."""
    parts = [_unpacked(x) for x in rows["keys"].to_pylist()]
    keys, size = np.concatenate(parts), [len(x) for x in parts]
    order = np.argsort(keys, kind="stable")
    first = np.concatenate(([True], np.diff(keys[order]) != 0))
    start, place = np.flatnonzero(first), np.empty(len(keys), np.int64)
    place[order] = np.cumsum(first) - 1
    out = {"chunk": rows["chunk"], "bucket": rows["bucket"]}
    for name in ("n", "t"):
        values = np.concatenate([_values(x) for x in rows[name].to_pylist()])[order]
        total = np.add.reduceat(values, start)[place]
        out[name] = pa.array([_planes(x) for x in np.split(total, np.cumsum(size)[:-1])], pa.binary())
    return pa.table(out)


def _loss(c: np.ndarray, before: np.ndarray, word: np.ndarray, total: int) -> np.ndarray:
    """Nats of tokens whose bigram, history and word occur so often."""
    p = (word + 1) / total
    return -np.log(np.where(before > 0, MIX * c / np.maximum(before, 1) + (1 - MIX) * p, p))


def _score(size: int, totals: tuple[int, int]):
    """Scores a chunk's texts with the answers of the buckets."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        bigrams, words, sizes = _tokens(texts["text"].to_pylist())
        keys = np.unique(np.concatenate([bigrams, words]))
        answers = answers.sort_by("bucket")
        first = np.cumsum(sizes) - sizes
        end = np.searchsorted(keys, _word_key(np.array([END], _U)))[0]
        at, word = np.searchsorted(keys, bigrams), np.searchsorted(keys, words)
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[first] = end  # the start of a text occurs as often as the end
        losses = []
        for name, total in zip(("t", "n"), totals):
            count = np.concatenate([_values(x) for x in answers[name].to_pylist()])
            losses.append(np.add.reduceat(_loss(count[at], count[before], count[word], total + size), first) / sizes)
        return pa.table({"doc_id": texts["doc_id"], "n_words": pa.array(sizes - 1), "target_loss": pa.array(losses[0]), "background_loss": pa.array(losses[1])})

    return run


def cross_entropy_difference(docs: DataFrame, target: DataFrame, chunk_bytes: int = CHUNK_BYTES, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """(doc_id, n_words, target_loss, background_loss, score) per row of ``docs`` (doc_id, text; other columns are ignored).

    Losses are nats per token, the end of the text included, so null and empty texts have a loss too (of the end alone).
    ``target`` has the doc_ids of target texts; ids that aren't in ``docs`` are ignored, and without any the target model
    is uniform.  Rows with a null doc_id are scored; repeated rows each count and get the same score, and so do ties.  A very
    long text is in one chunk, which then is as large.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    ids = target.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("target", F.lit(True))
    ids = F.broadcast(ids) if ids.count() <= FEW_IDS else ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left")
    rows = rows.select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(text_bytes // (3 * bucket_keys)).bit_length()  # a text has an n-gram for each three bytes
    words = rows.select("text", "target").mapInArrow(_words(bits), "bucket long, keys binary, n long, t long")
    words = words.groupBy("bucket").applyInArrow(_distinct, "n long, t long, words long")
    all_n, all_t, distinct = words.agg(F.sum("n"), F.sum("t"), F.sum("words")).first()
    size = FIRST + max((distinct or 0) - 1, 0)  # the end of a text isn't a word
    chunks = 1 + text_bytes // max(1, chunk_bytes)

    # both uses of the dealt texts read one shuffle, so they take the same columns
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(chunks)))
    asked = dealt.groupBy("chunk").applyInArrow(_ask(bits), "chunk long, bucket long, keys binary, n binary, t binary")
    answers = asked.groupBy("bucket").applyInArrow(_answer, "chunk long, bucket long, n binary, t binary")
    scored = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(size, (all_t or 0, all_n or 0)), "doc_id long, n_words long, target_loss double, background_loss double")
    return scored.withColumn("score", F.col("target_loss") - F.col("background_loss"))
