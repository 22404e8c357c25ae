"""Lexical retrieval packing: documents that share rare terms are packed into the same sequences.

Token ids are the terms.  Every document goes to the shard of its strongest term (by BM25 weight), and a shard holds a
BM25 inverted index of its documents.  A seed document asks it with its strongest terms; all unused neighbours of a
positive score fill the seed's window, best first, and the document that is cut at the end of a window is the next seed.
Statistics (document frequencies, mean length) are those of all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import encoder
from .shared import bounded_batches, stash

#: Documents and ids of an index shard at most (a longer document has a shard of its own), terms of a query, and the
#: constants of BM25.
SHARD_DOCS, SHARD_IDS, QUERY_TERMS, K1, B = 1024, 4_000_000, 32, 1.2, 0.75
#: Ids whose terms are counted at once.
_RUN_IDS = 1 << 20

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def token_rows(docs: DataFrame, tokenizer: str, end_id: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, ids, width) of each text, its token ids with ``end_id`` at their end as little-endian unsigned integers
    of 32 or 16 bits; and (df, docs, width), how many documents of a task hold each term."""
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
    names = ["doc_id", "n", "ids", "df"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs = np.zeros(size, dtype=np.int64), 0
        for batch in batches:
            if batch.num_rows:
                ids, n = encoder(tokenizer).encode([x or "" for x in batch.column(1).to_pylist()])
                flat, n = np.insert(ids, np.cumsum(n), end_id).astype(dtype), n + 1
                for own, part in _runs(flat, n):
                    df += np.bincount(_terms(own, part)[0], minlength=size)
                docs += len(n)
                raw, ends = flat.tobytes(), np.cumsum(n) * dtype.itemsize
                cut = [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(cut, pa.binary()), pa.nulls(len(n), pa.binary())], names)
        if docs:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([docs]), pa.nulls(1, pa.binary()), pa.array([df.tobytes()], pa.binary())], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, ids binary, df binary")
    rows = stash(rows.withColumn("width", F.lit(dtype.itemsize)), "tokens")
    return rows.where("ids is not null").select("doc_id", "n", "ids", "width"), rows.where("df is not null").select("df", F.col("n").alias("docs"))


def _runs(flat: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Consecutive documents of about _RUN_IDS ids: their ids and how many each has."""
    ends = np.cumsum(n)
    low = 0
    while low < len(n):
        at = int(ends[low] - n[low])
        high = max(low + 1, int(np.searchsorted(ends, at + _RUN_IDS, "right")))
        yield flat[at : int(ends[high - 1])], n[low:high]
        low = high


def _terms(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of documents whose ids lie one after another: (term, document, times), in order of document and term."""
    key = np.sort(np.repeat(np.arange(len(n), dtype=np.uint64) << np.uint64(32), n) | ids)
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    key = key[start].view(np.int64)
    return key & 0xFFFFFFFF, key >> 32, np.diff(start, append=len(ids))


def document_frequencies(counts: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many documents each term is, and the number of documents. The driver gets a number per term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for raw in batch.column("df").to_pylist():
                df += np.frombuffer(raw, np.int64)
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(df[there])], ["term", "df"])

    df = np.zeros(size, dtype=np.int64)
    for x in counts.select("df").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[x["term"]] = x["df"]
    return df, counts.agg(F.sum("docs")).first()[0] or 0


def _weights(terms: tuple[np.ndarray, np.ndarray, np.ndarray], n: np.ndarray, idf: np.ndarray, mean: float) -> np.ndarray:
    """BM25 weights of terms as ``_terms`` gives them, in documents of n ids."""
    term, doc, tf = terms
    return idf[term] * tf * (K1 + 1) / (tf + (K1 * (1 - B + B * n / mean))[doc])


class Index:
    """BM25 inverted index of a shard: documents and weights by term; and the terms of each document."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, idf: np.ndarray, mean: float):
        described = _terms(ids, n)
        self.n, (self.term, doc, _) = len(n), described
        self.weight = _weights(described, n, idf, mean)
        self.edge = np.searchsorted(doc, np.arange(len(n) + 1))  # terms of each document
        order = np.argsort(self.term, kind="stable")
        self.docs, self.weights = doc[order], self.weight[order]
        ranked = self.term[order]
        start = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        self.at, self.size = start, np.diff(start, append=len(ranked))  # postings of the terms of this shard
        self.row = np.empty(len(ranked), np.int64)
        self.row[order] = np.repeat(np.arange(len(start)), self.size)  # each document's terms as rows of ``at``

    def ask(self, doc: int, limit: int = QUERY_TERMS) -> np.ndarray:
        """The summed weights of the strongest ``limit`` terms of a document in each document."""
        own = np.arange(self.edge[doc], self.edge[doc + 1])
        if len(own) > limit:
            own = own[np.argpartition(-self.weight[own], limit)[:limit]]
        at, size = self.at[self.row[own]], self.size[self.row[own]]
        total = np.cumsum(size)
        place = np.arange(int(total[-1])) + np.repeat(at - (total - size), size)
        return np.bincount(self.docs[place], self.weights[place], self.n)


def _route(held):
    """The strongest term of each document, and a part of that term's shard that holds about SHARD_DOCS documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, df, mean = held.value
        idf = np.where(df > 1, idf, 0)  # a term of one document finds no other
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, n = _flat(batch)
            leads = []
            for own, part in _runs(flat, n):
                terms = _terms(own, part)
                weight, doc = _weights(terms, part, idf, mean), terms[1]
                start = np.searchsorted(doc, np.arange(len(part)))
                best = np.flatnonzero(weight == np.maximum.reduceat(weight, start)[doc])
                leads.append(terms[0][best[np.searchsorted(doc[best], np.arange(len(part)))]])
            lead = np.concatenate(leads)
            parts = (1 + df[lead] // SHARD_DOCS).tolist()
            part = [zlib.crc32(str(doc).encode()) % k if k > 1 else 0 for doc, k in zip(batch.column("doc_id").to_pylist(), parts)]
            yield pa.RecordBatch.from_arrays([pa.array(lead), pa.array(part, pa.int64()), *(batch.column(c) for c in ("doc_id", "ids", "width"))], ["lead", "part", "doc_id", "ids", "width"])

    return run


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a batch's documents one after another, and how many each has."""
    width = int(batch.column("width")[0].as_py())
    raw = batch.column("ids").to_pylist()
    return np.frombuffer(b"".join(raw), f"<u{width}"), np.array([len(x) // width for x in raw], np.int64)


class _Packer:
    """Fills windows one after another; a piece is (doc, start, length, sequence, offset)."""

    def __init__(self, window: int, first: int):
        self.window, self.sequence, self.used = window, first, 0
        self.pieces: list[tuple] = []
        self.open: list[tuple] = []  # pieces of the window that isn't full

    def add(self, doc_id, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            n = min(self.window - self.used, len(ids) - at)
            own = ids[at : at + n]
            self.open.append((doc_id, at, n, zlib.crc32(own.astype("<u4")), len(ids), self.sequence, self.used, own))
            at, self.used = at + n, self.used + n
            if self.used == self.window:
                self.pieces += [x[:-1] for x in self.open]
                self.sequence, self.used, self.open = self.sequence + 1, 0, []

    def close(self) -> None:
        """The last ids are cut to sequences whose lengths are powers of two, which need no padding."""
        left, at = self.used, 0
        rest, self.open = self.open, []
        while left:
            size = 1 << (left.bit_length() - 1)
            room = size
            while room:
                doc_id, start, n, _, total, _, _, own = rest.pop(0)
                take = min(room, n)
                self.pieces.append((doc_id, start, take, zlib.crc32(own[:take].astype("<u4")), total, self.sequence, size - room))
                if take < n:
                    rest.insert(0, (doc_id, start + take, n - take, 0, total, 0, 0, own[take:]))
                room -= take
            left, at, self.sequence = left - size, at + size, self.sequence + 1


def _pack_shard(packer: _Packer, docs: list[tuple], idf: np.ndarray, mean: float) -> None:
    n = np.array([len(ids) for _, ids in docs], np.int64)
    index = Index(np.concatenate([ids for _, ids in docs]), n, idf, mean)
    unused = np.ones(len(docs), dtype=bool)
    first, neighbours = 0, iter(())
    for _ in range(len(docs)):
        k = next((j for j in neighbours if unused[j]), None)
        if k is None:
            while not unused[first]:
                first += 1
            k = first
        unused[k] = False
        before = packer.sequence
        packer.add(*docs[k])
        if packer.sequence != before or k == first:  # cut, or a seed that was chosen by order: ask for its neighbours
            scores = index.ask(k)
            near = np.flatnonzero(unused & (scores > 0))
            neighbours = iter(near[np.argsort(-scores[near], kind="stable")].tolist())


def _pack(held, window: int):
    """Reads (doc_id, ids, width) with neighbours in order; takes shards of SHARD_DOCS documents or SHARD_IDS ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, _, mean = held.value
        packer = _Packer(window, TaskContext.get().partitionId() << 40)

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.pieces)) or [[]] * 7
            packer.pieces = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in PIECES.split(", ")])

        docs: list[tuple] = []
        size = 0
        for batch in batches:
            for doc, raw, w in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "width"))):
                ids = np.frombuffer(raw, f"<u{w}")
                if docs and (len(docs) == SHARD_DOCS or size + len(ids) > SHARD_IDS):
                    _pack_shard(packer, docs, idf, mean)
                    docs, size = [], 0
                    yield out()
                docs.append((doc, ids))
                size += len(ids)
        if docs:
            _pack_shard(packer, docs, idf, mean)
        packer.close()
        yield out()

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = 2048) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``docs`` has doc_id and text; other columns are ignored.  Each id of each document is in exactly one piece.  Sequences
    are full, but for the last ids of a partition, which lie in sequences of powers of two: nothing is padded.  A
    null or empty text has only ``end_id``.  Rows with a null doc_id are packed too; repeated rows are documents of
    their own, in ties the one that comes first by its ids.  An empty table gives no rows.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    bounded_batches(spark)
    tokens, counts = token_rows(docs, tokenizer, end_id)
    df, n = document_frequencies(counts, max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1))
    mean = tokens.agg(F.avg("n")).first()[0] or 1.0
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    held = spark.sparkContext.broadcast((idf, df, float(mean)))
    routed = tokens.select("doc_id", "ids", "width").mapInArrow(_route(held), "lead long, part long, doc_id long, ids binary, width int")
    routed = routed.repartition("lead", "part").sortWithinPartitions("lead", "part", "doc_id", "ids")
    return routed.select("doc_id", "ids", "width").mapInArrow(_pack(held, window), PIECES)
