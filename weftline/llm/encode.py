"""Fast encoding with the tokenizers library.

Words recur, so a worker encodes each distinct piece of text once and joins the ids of pieces by numpy.  Texts are cut
at single blanks and line ends, where pieces encode alike alone and together.  Whether that holds for a tokenizer is
tried on ``PROBES``; one for which it does not gets whole texts.  Ids always come from the library.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from tokenizers import Tokenizer

from . import kernels

#: Distinct pieces that a worker keeps before it starts anew; longer pieces than ``KEPT_BYTES`` are not kept. Texts are
#: encoded in runs of about ``RUN_BYTES``.
KEPT_PIECES, KEPT_BYTES, RUN_BYTES = 500_000, 64, 1 << 20

#: Texts on which cutting must agree with the library before it is used.
PROBES = (
    "The  quick brown\nfox's tail, it'll   jump\n\nover 12,345 dogs. ",
    " leading \n mixed\t \t tabs\r\n and wide　space Ünïcødé é don't 'S \"'x",
    "a\nb \nc\n d\n\n\ne  \n  f",
    "one, two; three. \"four\" 'five' (six) se7en\neight: nine",
    "<|endoftext|> x<|endoftext|>y <|startoftext|>",
    "",
)

#: A piece is a run without blank and line end.
_PIECE = np.ones(256, dtype=bool)
_PIECE[[10, 32]] = False
#: Bytes of ASCII letters and of the signs that may follow a plain word.
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SIGNS = ".,;:!?#$%&*()-"
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[ord(x) for x in _SIGNS]] = True
#: Parts two pieces in one call of the library; it has ids of its own and doesn't affect the pieces beside it.
_MARK = {"apart": " \x01 ", "before": "\n\x01"}


#: Pieces of letters (ASCII and Latin-1) and signs after them. They are words for the model as they stand, so the steps
#: before it can be left out, and the signs are a piece of their own; that this agrees with the library is tried on
#: ``PLAIN_PROBES``.
_PLAIN = re.compile(rf"([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([{re.escape(_SIGNS)}]*)")
PLAIN_PROBES = (" Hello", "\nWorld", " Straße,", " élève###", "\nÜber%%%", " a", " I.", " DONT!?", " ñandú&&&", " (", " x-")


def _byte_table() -> dict[int, str]:
    """What byte-level tokenizers write for each byte: printable ones stand for themselves, the others are numbered from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTES = _byte_table()


class Encoder:
    """``encode(texts)`` gives a flat array of the ids of all texts and the number of ids of each."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.mode, self.mark, self.plain = None, np.zeros(0, np.uint32), False
        for mode in _MARK:
            self.mode, self.mark = mode, np.array(self._ids(_MARK[mode]), np.uint32)
            self._clear()
            if self._agrees():
                break
        else:
            self.mode = None
        probes = [x if self.mode == "before" else x.strip() for x in PLAIN_PROBES]
        self.plain = self.mode is not None and all(self._probe(x) in (None, self._ids(x)) for x in probes)
        self._clear()

    def _probe(self, piece: str) -> list[int] | None:
        m = _PLAIN.fullmatch(piece)
        return m and [i for x in (m[1] + m[2], m[3]) if x for i in (self._model_ids(x) or [-1])]

    def _model_ids(self, piece: str) -> list[int] | None:
        """Ids of a plain word or of signs straight from the model; None for any other piece."""
        m = _PLAIN.fullmatch(piece)
        if m is None:
            if piece.strip(_SIGNS):
                return None
            words = [piece]
        elif m[3]:
            return None
        elif self.mode == "apart":
            words = [m[2].lower()]
        elif m[1] == "\n":
            words = ["\n", m[2]]
        else:
            words = [piece]
        if not piece.isascii():
            words = [w.encode().decode("latin-1") for w in words]
        return [t.id for w in words for t in self.tokenizer.model.tokenize(w.translate(_BYTES))]

    def _agrees(self) -> bool:
        ids, size = self.encode(PROBES)
        return len(self.mark) and [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [self._ids(x) for x in PROBES]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _clear(self) -> None:
        # a lookup table is built anew when it grows, so new pieces gather in a small one first
        self.keys = self.recent = pd.Index(np.zeros(0, np.uint64))
        self.flat = np.zeros(0, dtype=np.uint32)
        self.ends = np.zeros(1, dtype=np.int64)

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encode in runs of some MB; a text in which the cuts would change the ids is encoded whole."""
        if self.mode is None:
            return self._encode_each(list(texts))
        parts, size = [np.zeros(0, np.uint32)], []
        for first, run in kernels.buffers(texts, RUN_BYTES):
            ids, n = self._encode_run(run)
            if self.mode == "before":
                odd = [i for i, x in enumerate(run) if x[-1:] in (b" ", b"\n") or b"  " in x or b"\n\n" in x or b" \n" in x or b"\n " in x]
                if odd:
                    whole, m = self._encode_each([texts[first + i] for i in odd])
                    split, own = np.split(ids, np.cumsum(n)[:-1]), np.split(whole, np.cumsum(m)[:-1])
                    for i, x in zip(odd, own):
                        split[i] = x
                    ids, n = np.concatenate(split), np.array([len(x) for x in split], np.int64)
            parts.append(ids)
            size.append(n)
        return np.concatenate(parts), np.concatenate(size) if size else np.zeros(0, np.int64)

    def _encode_run(self, run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = b" ".join(run) + b" "
        buf = np.frombuffer(raw, np.uint8)
        at_text = np.concatenate(([0], np.cumsum([len(x) + 1 for x in run])))
        starts, ends = kernels.spans(_PIECE[buf])
        joined = np.zeros(0, np.int64)
        if self.plain:  # signs after a letter are a piece that is joined to the one before it
            tail = np.maximum.accumulate(np.where(_SIGN[buf], 0, np.arange(len(buf))))[ends - 1] + 1
            cut = np.flatnonzero((tail > starts) & (tail < ends))
            last, before = buf[tail[cut] - 1], buf[np.maximum(tail[cut] - 2, 0)]
            cut = cut[_LETTER[last] | (before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)]
            joined = cut + np.arange(1, len(cut) + 1)
            starts, ends = np.insert(starts, cut + 1, tail[cut]), np.insert(ends, cut, tail[cut])
        bounds = np.searchsorted(starts, at_text)
        with np.errstate(over="ignore"):
            hashes = kernels.hash_spans(buf, starts, ends)
            if self.mode == "before":  # a piece has the blank or line end before it; the first of a text has neither, nor have joined ones
                kind = buf[np.maximum(starts - 1, 0)].astype(np.uint64)
                kind[np.isin(starts, at_text)] = kind[joined] = 1
                hashes = kernels.mix64(hashes + kind)
        codes, distinct = pd.factorize(hashes)
        if len(self.ends) > KEPT_PIECES:
            self._clear()
        known = self.keys.get_indexer(distinct)
        if len(self.recent):
            rest = np.flatnonzero(known < 0)
            late = self.recent.get_indexer(distinct[rest])
            known[rest] = np.where(late < 0, -1, late + len(self.keys))
        new = np.flatnonzero(known < 0)
        flat, edge = self.flat, self.ends
        if len(new):
            first = np.zeros(len(distinct), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            first = first[new]
            lead = (kind[first] != 1).astype(int) if self.mode == "before" else np.zeros(len(new), int)
            letters = np.concatenate(([0], np.cumsum(_LETTER[buf])))
            plain = letters[ends[first]] - letters[starts[first]] == ends[first] - starts[first]
            if self.mode == "before":
                plain &= kind[first] != 10
            order = np.argsort(~(plain & self.plain), kind="stable")  # plain ASCII words first
            new, first, lead, n = new[order], first[order], lead[order], int((plain & self.plain).sum())
            ids, size = self._encode_words(raw, starts[first[:n]], ends[first[:n]], lead[:n])
            if n < len(new):
                pieces = [raw[a:b].decode("utf-8", "replace") for a, b in zip((starts[first] - lead)[n:].tolist(), ends[first[n:]].tolist())]
                more = self._encode_new(pieces, lead[n:])
                ids, size = np.concatenate([ids, more[0]]), np.concatenate([size, more[1]])
            known[new] = len(edge) - 1 + np.arange(len(new))
            flat, edge = np.concatenate([flat, ids]), np.concatenate([edge, edge[-1] + np.cumsum(size)])
            short = ends[first] - starts[first] <= KEPT_BYTES
            if short.all():
                self.recent, self.flat, self.ends = self.recent.append(pd.Index(distinct[new])), flat, edge
            else:
                self.recent = self.recent.append(pd.Index(distinct[new[short]]))
                self.flat = np.concatenate([self.flat, ids[np.repeat(short, size)]])
                self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(size[short])])
            if len(self.recent) > max(50_000, len(self.keys) // 2):
                self.keys, self.recent = self.keys.append(self.recent), pd.Index(np.zeros(0, np.uint64))
        code = known[codes]
        at, size = edge[code], edge[code + 1] - edge[code]
        total = np.cumsum(size)
        ids = flat[np.arange(int(total[-1]) if len(total) else 0) + np.repeat(at - (total - size), size)]
        return ids, np.diff(np.concatenate(([0], total))[bounds])

    def _encode_each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)

    def _encode_words(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words of ASCII letters, straight from the model; those with a lead have a blank before them."""
        tokenize, mark = self.tokenizer.model.tokenize, ("", _BYTES[32])
        if self.mode == "apart":
            found = [tokenize(raw[a:b].decode().lower()) for a, b in zip(starts.tolist(), ends.tolist())]
        else:
            found = [tokenize(mark[x] + raw[a:b].decode()) for a, b, x in zip(starts.tolist(), ends.tolist(), lead.tolist())]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((t.id for x in found for t in x), np.uint32, int(size.sum())), size

    def _encode_new(self, pieces: list[str], lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces; in mode "before", those without a lead, which could run into a mark, are encoded one by one."""
        order, flat, sizes = [], [], []
        rest = np.arange(len(pieces))
        if self.plain:
            found = [self._model_ids(x) for x in pieces]
            rest = np.array([i for i, x in enumerate(found) if x is None], np.int64)
            order.append(np.array([i for i, x in enumerate(found) if x is not None], np.int64))
            sizes.append(np.array([len(x) for x in found if x is not None], np.int64))
            flat.append(np.array([i for x in found if x is not None for i in x], np.uint32))
        joined = rest[lead[rest] > 0] if self.mode == "before" else rest
        alone = np.setdiff1d(rest, joined)
        mark, width = self.mark, len(self.mark)
        for at in range(0, len(joined), 2000):
            run = joined[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([_MARK[self.mode].join([pieces[i] for i in run.tolist()])], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(ids == mark[-1])
            if len(cut) != len(run) - 1:  # a piece holds the mark itself
                alone = np.concatenate([alone, run])
                continue
            order.append(run)
            flat.append(np.delete(ids, (cut[:, None] - np.arange(width)).ravel()))
            sizes.append(np.diff(np.concatenate(([-1], cut, [len(ids) + width - 1]))) - width)
        if len(alone):
            ids, size = self._encode_each([pieces[i] for i in alone.tolist()])
            order.append(alone)
            flat.append(ids)
            sizes.append(size)
        order, flat, size = np.concatenate(order), np.concatenate(flat), np.concatenate(sizes)
        starts, back = np.cumsum(size) - size, np.argsort(order)
        at, size = starts[back], size[back]
        total = np.cumsum(size)
        return flat[np.arange(len(flat)) + np.repeat(at - (total - size), size)], size


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; it outlives a task where workers are reused."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
