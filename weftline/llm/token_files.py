"""Token ids as flat binary files.

The rows are range-partitioned by doc_id and each partition writes one shard of three files: ``ids`` (unsigned
little-endian integers, 16 bits wide if the vocabulary fits, else 32), ``offsets`` (64-bit, one more than documents,
counted from the shard's start) and ``docs`` (64-bit doc_ids).  How many ids lie before a shard is the prefix sum of the
shards' counts.  Readers map the files into memory where the folder is local to them, and read them otherwise.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import encoder
from .shared import bounded_batches, shared_dir

#: A null doc_id in the files.
NO_ID = -(2**63)

SHARD = "first_doc long, docs long, tokens long, path string, width long"


def _write(root: str, tokenizer: str, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        name, dtype = uuid.uuid4().hex, np.dtype(f"<u{width}")  # a repeated attempt writes files of its own
        docs, sizes, out = [], [], None
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, size = encoder(tokenizer).encode([x or "" for x in part.column(1).to_pylist()])
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}.ids")
                out.write(np.insert(ids, np.cumsum(size), end_id).astype(dtype).tobytes())
                docs.append(part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False))
                sizes.append(size + 1)
        if out is None:
            return
        out.close()
        docs, offsets = np.concatenate(docs), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
        for kind, values in (("offsets", offsets), ("docs", docs)):
            with store.open_output_stream(f"{base}/{name}.{kind}") as f:
                f.write(values.astype("<i8").tobytes())
        row = {"first_doc": int(docs[0]), "docs": len(docs), "tokens": int(offsets[-1]), "path": f"{base}/{name}", "width": width}
        yield pa.RecordBatch.from_pylist([row])

    return run


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, root: str | None = None) -> DataFrame:
    """Write ``docs`` (doc_id, text and any other columns) and return the table of shards, a few numbers per shard:
    first_doc, docs, tokens, path, width and base, the number of ids before the shard.

    Documents lie in ascending order of doc_id (null first), ties by text.  Each ends with ``end_id``; a null or empty
    text has only that.  ``root`` is a folder that driver and executors share, by default a new one in the folder of
    spark.checkpoint.dir.  An empty table gives no shards.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    bounded_batches(spark)
    root = root or f"{shared_dir(spark).rstrip('/')}/weftline-tokens-{uuid.uuid4().hex}"
    root = _qualified(spark, root)
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = rows.mapInArrow(_write(root, tokenizer, end_id, width), SHARD).collect()
    found, base = [], 0
    for x in sorted(shards, key=lambda x: x["first_doc"]):
        found.append((*x, base, root))
        base += x["tokens"]
    return spark.createDataFrame(found, f"{SHARD}, base long, root string")


def _qualified(spark, root: str) -> str:
    """``root`` with the scheme that Spark gives it: a path without one lies in the default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _values(store: fs.FileSystem, path: str, dtype: str, start: int = 0, end: int | None = None) -> np.ndarray:
    """Values ``start`` to ``end`` of a file: mapped where the folder is local, else only these bytes are read."""
    width = np.dtype(dtype).itemsize
    if isinstance(store, fs.LocalFileSystem):
        whole = np.memmap(path, dtype, "r") if store.get_file_info(path).size else np.zeros(0, dtype)
        return whole[start:end]
    with store.open_input_file(path) as f:
        end = f.size() // width if end is None else end
        return np.frombuffer(f.read_at((end - start) * width, start * width), dtype)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.to_pylist():
            store, _ = fs.FileSystem.from_uri(x["root"])
            offsets, docs = (_values(store, f"{x['path']}.{kind}", "<i8") for kind in ("offsets", "docs"))
            for at in range(0, len(docs), 2000):
                own = docs[at : at + 2000]
                cut = offsets[at : at + len(own) + 1]
                ids, near = _values(store, f"{x['path']}.ids", f"<u{x['width']}", int(cut[0]), int(cut[-1])), cut - cut[0]
                crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(near[:-1].tolist(), near[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, mask=own == NO_ID), pa.array(x["base"] + cut[:-1]), pa.array(np.diff(cut)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )


def read_token_files(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files: its place among all ids, its number of
    ids, and the CRC-32 of its ids as little-endian unsigned 32-bit integers."""
    parts = max(1, shards.count())
    return shards.repartition(parts, "path").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
