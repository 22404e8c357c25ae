"""Rules whose decisions depend on earlier decisions: debounced ticks under a rate, admissions under a rate, chunk states.

A rule is a small state and what a row or the passing of time does to it. The same rules run here over tables, key by key
in order of time, and in ``streaming.state`` over streams. A key's rows pass through one task, as each decision needs the
one before; they are streamed, and only the rule's state is held.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .logs import micros

#: (kind, time, id of the row, rows that it stands for)
Event = tuple[str, int, int, int]


@dataclass(frozen=True)
class Ticks:
    """A row arms a timer of ``quiet`` microseconds anew; a ``tick`` is given when it runs out, at the row's time plus ``quiet``.

    With ``most``, a row is ``rejected`` if the ``window`` before it has that many ticks; it doesn't touch an armed timer.
    A timer that runs out at the very time of a row does so before the row. The state holds the armed timer's end (-1:
    none), its last row and number of rows, then the ticks of the window."""

    quiet: int
    most: int | None = None
    window: int = 60_000_000

    def time(self, state: list[int], at: int) -> tuple[list[int], list[Event]]:
        """What has happened by the time ``at`` without a row."""
        end, last, n, *ticks = state or [-1, -1, 0]
        out = []
        if 0 <= end <= at:
            out.append(("tick", end, last, n))
            ticks, end, last, n = ticks + [end], -1, -1, 0
        ticks = [t for t in ticks if at - t < self.window] if self.most is not None else []
        return ([end, last, n, *ticks] if end >= 0 or ticks else []), out

    def row(self, state: list[int], at: int, row: int) -> tuple[list[int], list[Event]]:
        state, out = self.time(state, at)
        end, last, n, *ticks = state or [-1, -1, 0]
        if self.most is not None and len(ticks) >= self.most:
            return state, out + [("rejected", at, row, 1)]
        return [at + self.quiet, row, n + 1, *ticks], out

    def due(self, state: list[int]) -> int | None:
        """The next time at which ``time`` changes the state."""
        if not state:
            return None
        return state[0] if state[0] >= 0 else state[3] + self.window


@dataclass(frozen=True)
class Admissions:
    """A row is ``accepted`` if fewer than ``most`` were in the ``window`` before it, and ``rejected`` otherwise; rejected rows don't count."""

    most: int
    window: int = 60_000_000

    def time(self, state: list[int], at: int) -> tuple[list[int], list[Event]]:
        return [t for t in state if at - t < self.window], []

    def row(self, state: list[int], at: int, row: int) -> tuple[list[int], list[Event]]:
        state, _ = self.time(state, at)
        if len(state) >= self.most:
            return state, [("rejected", at, row, 1)]
        return state + [at], [("accepted", at, row, 1)]

    def due(self, state: list[int]) -> int | None:
        return state[0] + self.window if state else None


def absorbed_chunk(known: tuple[str, frozenset] | None, chunk: str, members: frozenset) -> tuple[tuple[str, frozenset], str, str, str | None, bool]:
    """(state, kind, chunk, replaced chunk, whether it stands beside the known one) once a pattern's next chunk has come.

    An unknown pattern's chunk is ``added``. Equal or fewer members leave the known chunk ``unchanged``; a strict superset
    has it ``replaced``; a set that neither holds the other is ``added`` beside it."""
    if known is None:
        return (chunk, members), "added", chunk, None, False
    before = known[1]
    if members <= before:
        return known, "unchanged", known[0], None, False
    if members > before:
        return (chunk, members), "replaced", chunk, known[0], False
    return known, "added", chunk, None, True


def in_order(rows: DataFrame, key: str, ts: str, row: str, rule: Ticks | Admissions) -> DataFrame:
    """(key, kind, at, row, n): what the rule gives for each key's rows in order of time, ties by ``row`` (a long), until the last timer has run out.

    Rows without a time or an id take no part; a null key is a key."""
    spans = rows.select(F.col(key), micros(ts).alias("at"), F.col(row).cast("long").alias("row")).where("at is not null and row is not null")
    spans = spans.repartition(key).sortWithinPartitions(key, "at", "row")
    schema = f"{key} {spans.schema[key].dataType.simpleString()}, kind string, at long, row long, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, fresh, types = None, [], True, None
        for batch in batches:
            out = []
            types = types or [batch.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.int64()]
            for k, at, r in zip(*(c.to_pylist() for c in batch.columns)):
                if fresh or k != own:
                    out += _rest(rule, own, state)
                    own, state, fresh = k, [], False
                state, events = rule.row(state, at, r)
                out += [(k, *e) for e in events]
            yield _batch(out, types, key)
        if types:
            yield _batch(_rest(rule, own, state), types, key)

    found = spans.mapInArrow(run, schema)
    return found.withColumns({"at": F.timestamp_micros("at")}).withColumnRenamed("row", row)


def _rest(rule: Ticks | Admissions, key, state: list[int]) -> list[tuple]:
    out = []
    while (at := rule.due(state)) is not None:
        state, events = rule.time(state, at)
        out += [(key, *e) for e in events]
    return out


def _batch(rows: list[tuple], types: list, key: str) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [key, "kind", "at", "row", "n"])


ABSORBED = "seq long, pattern string, tracked string, kind string, chunk_id string, replaced_chunk_id string, n_members long"


def absorbed_row(seq: int, pattern: str, known, chunk: str, members: frozenset) -> tuple:
    """The state after a chunk, and its row of ``ABSORBED``."""
    known, kind, kept, replaced, beside = absorbed_chunk(known, chunk, members)
    size = len(members) if kept == chunk and kind != "unchanged" else len(known[1])
    return known, (seq, pattern, f"{pattern}::{chunk}" if beside else pattern, kind, kept, replaced, size)


def absorbed(chunks: DataFrame) -> DataFrame:
    """``ABSORBED`` rows, one for each row of ``chunks`` (seq, pattern, chunk_id, members), each pattern's in order of seq and chunk_id.

    ``chunk_id`` is the chunk that stands after it, ``tracked`` the key under which it does (pattern::chunk for one beside
    another). Null members are none. Chunks without a pattern or an id can't be told apart and are added as they come."""
    known = chunks.where("pattern is not null and chunk_id is not null").select("seq", "pattern", "chunk_id", "members")
    spans = known.repartition("pattern").sortWithinPartitions("pattern", "seq", "chunk_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, None
        for batch in batches:
            out = []
            for seq, pattern, chunk, members in zip(*(c.to_pylist() for c in batch.columns)):
                if pattern != own:
                    own, state = pattern, None
                state, row = absorbed_row(seq, pattern, state, chunk, frozenset(members or ()))
                out.append(row)
            types = [pa.int64(), *[pa.string()] * 5, pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, types)], [f.split()[0] for f in ABSORBED.split(", ")])

    return spans.mapInArrow(run, ABSORBED).union(without_identity(chunks))


def without_identity(chunks: DataFrame) -> DataFrame:
    """``ABSORBED`` rows of the chunks that have no pattern or no id."""
    size = F.size(F.array_distinct(F.coalesce("members", F.array().cast("array<string>")))).cast("long")
    rows = chunks.where("pattern is null or chunk_id is null")
    return rows.select(F.col("seq").cast("long"), "pattern", F.lit(None).cast("string").alias("tracked"), F.lit("added").alias("kind"), "chunk_id", F.lit(None).cast("string").alias("replaced_chunk_id"), size.alias("n_members"))


def ledger(events: DataFrame) -> DataFrame:
    """(tracked, chunk_id, n_members): the chunks that stand after all rows of ``absorbed``."""
    last = events.where("tracked is not null and kind <> 'unchanged'").groupBy("tracked").agg(F.max_by(F.struct("chunk_id", "n_members"), F.struct("seq", "chunk_id")).alias("s"))
    return last.select("tracked", "s.chunk_id", "s.n_members")
