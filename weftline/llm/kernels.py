"""Vectorised word hashing shared by the text operators of this subpackage.

A batch of texts becomes one byte buffer; words are found with byte tables and hashed with
numpy, so that no Python object is made per word.  Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of a word under ``[^\x20\x09-\x0D]+``.
WORD_NOT_SPACE = np.ones(256, dtype=bool)
WORD_NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

#: Bytes of a word under ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (digits, a-z, all beyond ASCII).
WORD_ALNUM = np.zeros(256, dtype=bool)
WORD_ALNUM[48:58] = True
WORD_ALNUM[97:123] = True
WORD_ALNUM[128:] = True

#: Texts are hashed in buffers of about this many bytes; a longer text has a buffer of its own.
BUFFER_BYTES = 256 << 10


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def buffers(texts: Sequence[str | None], limit: int = BUFFER_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive runs of texts as UTF-8, each of about ``limit`` bytes, with the index of its first text."""
    first, size, run = 0, 0, []
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        if run and size + len(raw) > limit:
            yield first, run
            first, size, run = i, 0, []
        run.append(raw)
        size += len(raw) + 1
    if run:
        yield first, run


_POWERS: list[np.ndarray] = []
#: Powers that a worker keeps; bytes are hashed in blocks of about as many.
KEPT_POWERS = 1 << 20


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers or more of an odd factor and of its inverse modulo 2**64. More than KEPT_POWERS are not kept."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS
    size = max(n, KEPT_POWERS // 2)
    factors = (_BASE, _U(pow(int(_BASE), -1, 1 << 64)))
    made = [np.multiply.accumulate(np.concatenate(([_U(1)], np.full(size - 1, x)))) for x in factors]
    if size <= KEPT_POWERS:
        _POWERS[:] = made
    return made


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of true values begin and end; the last value is false."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    return edge[0::2], edge[1::2]


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of a buffer, which ascend and don't overlap. Worked off in blocks, so that a very long text needs no more memory."""
    out = np.empty(len(starts), dtype=np.uint64)
    low = 0
    while low < len(starts):
        at = int(starts[low])
        high = max(low + 1, int(np.searchsorted(ends, at + KEPT_POWERS // 2, "right")))
        part, s, e = buf[at : int(ends[high - 1])], starts[low:high] - at, ends[low:high] - at
        power, inverse = _powers(len(part))
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[part] * power[: len(part)], out=total[1:])
        out[low:high] = mix64((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        low = high
    return out


def hash_words(run: list[bytes], table: np.ndarray, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in ``run`` after folding bytes, and the bounds of each text in them (len(run) + 1 values)."""
    buf = fold[np.frombuffer(b" ".join(run) + b" ", dtype=np.uint8)]
    starts, ends = spans(table[buf])
    bounds = np.concatenate(([0], np.searchsorted(starts, np.cumsum([len(x) + 1 for x in run]))))
    return hash_spans(buf, starts, ends), bounds


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the last k - 1 positions are left out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, factor = np.zeros(n, dtype=np.uint64), _U(1)
    for j in range(k):
        out += words[j : j + n] * factor
        factor = factor * _U(0xD6E8FEB86659FD93)
    return mix64(out + _U(k))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    out = np.sort(values)
    return out[np.flatnonzero(np.diff(out, prepend=~out[:1]))]


def shingle_sets(texts: Sequence[str | None], k: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct k-word shingles of each text; a text of 1 to k - 1 words is one shingle, without words none."""
    with np.errstate(over="ignore"):
        for _, run in buffers(texts):
            words, bounds = hash_words(run, WORD_NOT_SPACE)
            every = windows(words, k)
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                n = hi - lo
                yield distinct(every[lo : hi - k + 1]) if n >= k else windows(words[lo:hi], n) if n else words[:0]
