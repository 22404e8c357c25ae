"""Repair of conversation structure by a cheapest alignment with ``(s?(ua)+)?``, in linear space.

Four states tell what has been written: nothing, a system turn, an unanswered user turn, an answered one.  Each row is kept,
given the role that fits, or deleted, and missing turns may be inserted before it.  Hirschberg's divide and conquer finds the
edits: costs of the first half forward and of the second half backward, four states each, meet in the middle; the crossing of
least cost is taken and both halves are solved on their own.  Forward costs carry the order of the edit strings behind them,
so that of equal crossings the one with the ASCII-least string is known without the strings.

Rows are put in order by a range partition, so a conversation may spread over many tasks.  It is cut into segments of up to
``SEGMENT`` rows.  Each gives its costs from every to every state; a conversation's segments are joined by these small
tables, which fixes the states at all cuts, and every segment is solved in a task of its own.  Only the digest of a
repaired conversation needs its turns one after another; they are streamed through it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, stash

#: Rows of a segment; rows of a batch that a task gives at least, if it has them.
SEGMENT, TOGETHER = 4096, 2048
EMPTY, SYSTEM, USER, ANSWERED = range(4)
NEVER = 1 << 60
#: What an inserted or renamed turn makes of a state, and the cost and number of turns to insert behind the last row.
_NEXT = {EMPTY: USER, SYSTEM: USER, USER: ANSWERED, ANSWERED: USER}
_ROLE = {USER: "user", ANSWERED: "assistant"}
_ENDING = {EMPTY: 0, SYSTEM: 2, USER: 1, ANSWERED: 0}
KEEP, RENAME, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

Row = tuple[str, bool, bool]  # initial of the role, must be deleted, is truncated
_FIRST = ([0, NEVER, NEVER, NEVER], [0, 0, 0, 0])


def _kept(state: int, initial: str) -> int | None:
    """The state after a row of that role is kept, if the grammar allows it."""
    if initial == "s":
        return SYSTEM if state == EMPTY else None
    return _NEXT[state] if initial == {USER: "u", ANSWERED: "a"}[_NEXT[state]] else None


def _steps(row: Row) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, edits): the best way to take a row from each to each state; of equal costs the ASCII-least. More than two insertions before a row never pay."""
    initial, bad, cut = row
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start in range(4):
        state, edits, cost = start, "", 0
        for _ in range(3):
            ways = [(state, cost + DELETE, edits + "D")]
            if not bad:
                ways.append((_NEXT[state], cost + RENAME + TRUNCATED * cut, edits + "R"))
                if (to := _kept(state, initial)) is not None:
                    ways.append((to, cost + KEEP + TRUNCATED * cut, edits + "K"))
            for to, c, e in ways:
                best[start, to] = min(best.get((start, to), (NEVER, "")), (c, e))
            state, edits, cost = _NEXT[state], edits + "I", cost + INSERT
    return [(s, t, c, e) for (s, t), (c, e) in sorted(best.items())]


_KNOWN: dict[Row, list[tuple[int, int, int, str]]] = {}


def steps(row: Row) -> list[tuple[int, int, int, str]]:
    if row not in _KNOWN:
        if len(_KNOWN) > 10_000:  # initials are any characters
            _KNOWN.clear()
        _KNOWN[row] = _steps(row)
    return _KNOWN[row]


def forward(rows: Sequence[Row], low: int, high: int, costs: list[int], ranks: list[int]) -> tuple[list[int], list[int]]:
    """Least costs of each state after rows low to high, and the order of the least edit strings behind them."""
    for i in range(low, high):
        found = [(NEVER, 0, "")] * 4
        for s, t, c, e in steps(rows[i]):
            if costs[s] < NEVER:
                found[t] = min(found[t], (costs[s] + c, ranks[s], e)) if found[t][0] < NEVER else (costs[s] + c, ranks[s], e)
        costs = [x[0] for x in found]
        order = sorted({x[1:] for x in found})
        ranks = [order.index(x[1:]) for x in found]
    return costs, ranks


def backward(rows: Sequence[Row], low: int, high: int, costs: list[int]) -> list[int]:
    """Least costs from each state before row low to what ``costs`` asks for behind row high."""
    for i in range(high - 1, low - 1, -1):
        found = [NEVER] * 4
        for s, t, c, _ in steps(rows[i]):
            found[s] = min(found[s], c + costs[t])
        costs = found
    return costs


def solve(rows: Sequence[Row], start: int, end: int) -> list[str]:
    """The edits of each row (insertions before it, then its own) of the least string among the cheapest from state to state."""
    out = [""] * len(rows)
    parts = [(0, len(rows), start, end)]
    while parts:
        low, high, s, t = parts.pop()
        if high - low == 1:
            out[low] = next(e for a, b, _, e in steps(rows[low]) if (a, b) == (s, t))
        elif high > low:
            middle = (low + high) // 2
            costs, ranks = forward(rows, low, middle, [0 if x == s else NEVER for x in range(4)], [0] * 4)
            rest = backward(rows, middle, high, [0 if x == t else NEVER for x in range(4)])
            crossing = min((costs[x] + rest[x], ranks[x], x) for x in range(4))[2]
            parts += [(low, middle, s, crossing), (middle, high, crossing, t)]
    return out


def summary(rows: Sequence[Row], entries: Sequence[int] = range(4)) -> tuple[list[int], list[int]]:
    """Costs from every to every state, and the ranks of the strings from a state; row by row of a 4 x 4 table. States that aren't ``entries`` lead nowhere."""
    both = [forward(rows, 0, len(rows), [0 if x == s else NEVER for x in range(4)], [0] * 4) if s in entries else ([NEVER] * 4, [0] * 4) for s in range(4)]
    return [c for costs, _ in both for c in costs], [r for _, ranks in both for r in ranks]


#: Rows of a conversation whose results a worker keeps, as short conversations have few different forms; and how many it keeps.
SHORT, KEPT_RESULTS = 24, 20_000
_short_summary, _short_solve = lru_cache(KEPT_RESULTS)(summary), lru_cache(KEPT_RESULTS)(solve)


def chain(tables: list[tuple[list[int], list[int]]]) -> tuple[int, list[int]]:
    """Least total cost, and the states before the first, between and behind the last of consecutive segments."""
    costs, ranks = _FIRST
    held = []
    for cost, rank in tables:
        ways = [min((costs[s] + cost[4 * s + t], ranks[s], rank[4 * s + t], s) if costs[s] < NEVER and cost[4 * s + t] < NEVER else (NEVER, 0, 0, 0) for s in range(4)) for t in range(4)]
        order = sorted({w[1:3] for w in ways})
        costs, ranks = [w[0] for w in ways], [order.index(w[1:3]) for w in ways]
        held.append([w[3] for w in ways])
    total, _, state = min((costs[t] + INSERT * _ENDING[t], ranks[t], t) for t in range(4))
    states = [state]
    for came in reversed(held):
        states.append(came[states[-1]])
    return total, states[::-1]


def _text_after(fault: Column, text: Column) -> Column:
    return F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text): the rows with every twentieth dropped, emptied, without sentence ends, repeated or given the user's role.

    crc32 of ``conv_id:turn`` modulo 20 chooses; nulls are written as one space, and ``conv`` is the id as a string."""
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(conv, F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    rows = conversations.select(conv.alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), fault.alias("fault"))
    rows = rows.where("fault <> 0").select("conv", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), _text_after(F.col("fault"), F.col("text")).alias("text"), "fault")
    return rows.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("fault", "copy")


def ordered(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text) written with ``pos``, which ascends by conversation, turn (null first), role and text; equal rows follow each other."""
    rows = rows.withColumn("tie", F.monotonically_increasing_id())  # so that even equal rows of a hot conversation are dealt to several tasks
    key = ["conv", F.asc_nulls_first("turn"), "role", "text", "tie"]
    rows = rows.repartitionByRange(*key).sortWithinPartitions(*key).drop("tie")
    return stash(rows.withColumn("pos", F.monotonically_increasing_id()), "turns")


def faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, pos, initial, blank, duplicate, truncated) of ordered rows; a row's first fault counts."""
    text = F.col("text")
    key = ["conv", "role", "digest"]
    told = rows.select("conv", "turn", "pos", "role", F.substring("role", 1, 1).alias("initial"), F.sha2(text, 256).alias("digest"), (~text.rlike(r"[^\x20\x09-\x0D]")).alias("blank"), text.rlike(r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z").alias("open"))
    told = stash(told, "faults")
    again = told.where("not blank").groupBy(*key).agg(F.min("pos").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    told = told.join(again, key, "left").withColumn("duplicate", ~F.col("blank") & F.coalesce(F.col("pos") > F.col("first"), F.lit(False)))
    return told.select("conv", "turn", "pos", "initial", "blank", "duplicate", (~F.col("blank") & ~F.col("duplicate") & F.col("open")).alias("truncated"))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, str], list[int], list[Row]]]:
    """Rows (segment, conv, pos, initial, bad, truncated) that are sorted, as ((segment, conv), positions, rows)."""
    key, places, rows = None, [], []
    for batch in batches:
        for part, conv, pos, initial, bad, cut in zip(*(batch.column(c).to_pylist() for c in ("segment", "conv", "pos", "initial", "bad", "truncated"))):
            if (part, conv) != key:
                if rows:
                    yield key, places, rows
                key, places, rows = (part, conv), [], []
            places.append(pos)
            rows.append((initial, bad, cut))
    if rows:
        yield key, places, rows


def _jumps(initials: list[str]) -> int:
    """Neighbours that the grammar doesn't allow."""
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


_TABLES = "conv string, segment long, cost array<long>, ranks array<long>, first string, last string, illegal long"
_STATES = "conv string, segment long, start int, end int, cost long, illegal long"


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before, found = None, []
    for (segment, conv), _, rows in _segments(batches):
        entries = (EMPTY,) if segment == before else tuple(range(4))  # only a segment's first conversation may have begun in another one
        before = segment
        cost, ranks = _short_summary(tuple(rows), entries) if len(rows) <= SHORT else summary(rows, entries)
        initials = [x[0] for x in rows]
        found.append({"conv": conv, "segment": segment, "cost": cost, "ranks": ranks, "first": initials[0], "last": initials[-1], "illegal": _jumps(initials)})
        if len(found) == TOGETHER:
            yield pa.RecordBatch.from_pylist(found, _ARROW["tables"])
            found = []
    yield pa.RecordBatch.from_pylist(found, _ARROW["tables"])


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads segments' tables sorted by conversation and segment. The total cost and the jumps stand at the last segment."""

    def out(conv: str, held: list[dict]) -> list[dict]:
        total, states = chain([(x["cost"], x["ranks"]) for x in held])
        jumps = sum(x["illegal"] for x in held) + sum(_jumps([x["last"], y["first"]]) for x, y in zip(held, held[1:]))
        last = len(held) - 1
        return [{"conv": conv, "segment": x["segment"], "start": states[i], "end": states[i + 1], "cost": total if i == last else None, "illegal": jumps if i == last else None} for i, x in enumerate(held)]

    conv, held = None, []
    for batch in batches:
        found = []
        for x in batch.to_pylist():
            if x["conv"] != conv:
                if held:
                    found += out(conv, held)
                conv, held = x["conv"], []
            held.append(x)
        yield pa.RecordBatch.from_pylist(found, _ARROW["states"])
    if held:
        yield pa.RecordBatch.from_pylist(out(conv, held), _ARROW["states"])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows of segments, each led by a row without pos that has the segment's states as start and end; gives each row's edits, role and state before it."""
    out = {"conv": [], "pos": [], "edits": [], "state": []}
    for (_, conv), places, rows, start, end, ends in _with_states(batches):
        if len(out["pos"]) >= TOGETHER:
            yield pa.RecordBatch.from_pydict(out, _ARROW["edits"])
            out = {name: [] for name in out}
        state = start
        for pos, edits, row in zip(places, _short_solve(tuple(rows), start, end) if len(rows) <= SHORT else solve(rows, start, end), rows):
            out["conv"].append(conv)
            out["pos"].append(pos)
            out["state"].append(state)
            for e in edits:
                state = _NEXT[state] if e in "IR" else _kept(state, row[0]) if e == "K" else state
            out["edits"].append(edits)
        if ends and _ENDING[end]:
            out["edits"][-1] += "I" * _ENDING[end]
    yield pa.RecordBatch.from_pydict(out, _ARROW["edits"])


def _with_states(batches: Iterator[pa.RecordBatch]):
    key, places, rows, states = None, [], [], None
    for batch in batches:
        for part, conv, pos, initial, bad, cut, start, end, ends in zip(*(batch.column(c).to_pylist() for c in ("segment", "conv", "pos", "initial", "bad", "truncated", "start", "end", "ends"))):
            if pos is None:
                if rows:
                    yield key, places, rows, *states
                key, places, rows, states = (part, conv), [], [], (start, end, ends)
            else:
                places.append(pos)
                rows.append((initial, bad, cut))
    if rows:
        yield key, places, rows, *states


_ARROW = {
    "tables": pa.schema([("conv", pa.string()), ("segment", pa.int64()), ("cost", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64())), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64())]),
    "states": pa.schema([("conv", pa.string()), ("segment", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("illegal", pa.int64())]),
    "edits": pa.schema([("conv", pa.string()), ("pos", pa.int64()), ("edits", pa.string()), ("state", pa.int32())]),
}


def repaired_turns(edits: str, state: int, role: str, text: str) -> Iterator[tuple[str, str]]:
    """The (role, text) that the edits around one row give."""
    for e in edits:
        if e == "K":
            state = _kept(state, role[:1])
            yield role, text
        elif e != "D":
            state = _NEXT[state]
            yield _ROLE[state], text if e == "R" else ""


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (conv, pos, edits, state, role, text) sorted by conversation and pos, each row's edits before its text."""
    conv, seen, audit, digest, edits, state = None, False, [], None, "", 0
    done: list[tuple] = []
    for batch in batches:
        for c, e, s, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv", "edits", "state", "role", "text"))):
            if c != conv or digest is None:
                if digest is not None:
                    done.append((conv, "".join(audit), digest.hexdigest()))
                conv, seen, audit, digest = c, False, [], hashlib.sha256()
            if e is not None:
                edits, state = e, s
                audit.append(e)
                continue
            for r, t in repaired_turns(edits, state, role, text):
                digest.update(("\n" if seen else "").encode() + f"{r}:{t}".encode("utf-8", "surrogatepass"))
                seen = True
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.string()) for i in range(3)], ["conv", "audit", "repaired_sha256"])
        done = []
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (conv, "".join(audit), digest.hexdigest())], ["conv", "audit", "repaired_sha256"])


def edits_of(told: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, edits, state) of each row of ``faults``, and (conv, cost, illegal) of each conversation."""
    rows = told.select(F.expr(f"pos div {int(segment)}").alias("segment"), "conv", "pos", "initial", (F.col("blank") | F.col("duplicate")).alias("bad"), "truncated")
    tables = rows.repartition("segment").sortWithinPartitions("segment", "conv", "pos").mapInArrow(_tables, _TABLES)
    states = stash(tables.repartition("conv").sortWithinPartitions("conv", "segment").mapInArrow(_chains, _STATES), "states")
    led = rows.select("*", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(None).cast("boolean").alias("ends"))
    heads = states.select("segment", "conv", F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), "start", "end", F.col("cost").isNotNull())
    led = led.union(heads).repartition("segment").sortWithinPartitions("segment", "conv", F.asc_nulls_first("pos"))
    return led.mapInArrow(_edits, "conv string, pos long, edits string, state int"), states.where("cost is not null").select("conv", "cost", "illegal")


def repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of ``rows`` (conv, turn, role, text, none null but turn).

    Rows are taken by turn, null first, ties by role and text.  gaps counts the turns missing between the first and the last.
    ``audit`` has the initials of the cheapest Keep, Rerole, Delete and Insert edits, of equal costs the ASCII-least string."""
    bounded_batches(rows.sparkSession)
    rows = ordered(rows)
    told = stash(faults(rows), "told")
    edits, costs = edits_of(told, segment)
    count = lambda name: F.sum(F.col(name).cast("long")).alias(name)
    counts = told.groupBy("conv").agg(F.max("turn").alias("high"), F.min("turn").alias("low"), count("blank"), count("duplicate"), count("truncated"))
    turns = told.where("turn is not null").select("conv", "turn").distinct().groupBy("conv").agg(F.count("*").alias("turns"))
    lines = edits.select("conv", "pos", "edits", "state", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    lines = lines.union(rows.select("conv", "pos", F.lit(None).cast("string"), F.lit(None).cast("int"), "role", "text"))
    lines = lines.repartition("conv").sortWithinPartitions("conv", "pos", F.asc_nulls_last("edits"))
    ends = lines.mapInArrow(_digests, "conv string, audit string, repaired_sha256 string")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    return counts.join(turns, "conv", "left").join(costs, "conv").join(ends, "conv").select("conv", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damage_and_repair(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): one row for each conv_id of
    ``conversations`` (conv_id, turn, role, text; other columns are ignored) whose rows are damaged and then repaired.

    Null roles and texts are one space.  Rows with a null conv_id are one conversation.  Rows that repeat each count.  A
    conversation that lost all its rows has zeros, an empty audit and the digest of nothing.  An empty table gives no rows.
    """
    every = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv")).distinct()
    found = every.join(repair(damaged(conversations), segment), "conv", "left")
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    nothing = hashlib.sha256().hexdigest()
    return found.select(
        F.when(F.col("conv") != " ", F.col("conv")).cast("long").alias("conv_id"), *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
