"""Streams with timers and time to live: debounced ticks, admissions, chunk states and frames of readouts.

The queries need ``STORE`` among the session's settings before they start. State is kept by key in RocksDB and its changes
in the query's checkpoint, so a query that is started again goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.logs import micros
from ..operators.ordered import ABSORBED, Admissions, Ticks, absorbed_row, without_identity

#: The state store that holds timers and lists.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _InOrder(StatefulProcessor):
    """Holds rows back until the watermark has passed them, so that the rule sees them in order of time however they came."""

    def __init__(self, rule: Ticks | Admissions):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, row long")
        self.known = handle.getValueState("known", "numbers array<long>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r["micros"], r["row"]) for r in rows]
        for at, row in new:
            self.waiting.appendValue((at, row))
        for ms in {_ceil_ms(at) for at, _ in new}:
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get())
        ready = [r for r in rows if r[0] <= passed]
        state = list(self.known.get()[0]) if self.known.exists() else []
        out = []
        for at, row in ready:
            state, events = self.rule.row(state, at, row)
            out += events
        while (due := self.rule.due(state)) is not None and due <= passed:
            state, events = self.rule.time(state, due)
            out += events
        if ready:
            self.waiting.put(rows[len(ready) :]) if len(rows) > len(ready) else self.waiting.clear()
        self.known.update((state,)) if state else self.known.clear()
        if due is not None:
            self.handle.registerTimer(_ceil_ms(due))
        return iter([Row(key=key[0], kind=k, at=at, row=row, n=n) for k, at, row, n in out])

    def close(self) -> None:
        pass


def _ceil_ms(at: int) -> int:
    return -(-at // 1000)


def in_order(rows: DataFrame, key: str, ts: str, row: str, rule: Ticks | Admissions, late: str = "10 minutes") -> DataFrame:
    """``operators.ordered.in_order`` of a stream: an event comes out once the watermark has passed it.

    Rows that are more than ``late`` behind the newest may be dropped, as the watermark has passed their place. What is held
    for a key are its rows above the watermark and the rule's state; the latter is removed when nothing in it can matter."""
    typed = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    typed = typed.select(F.col(key), F.col(ts), micros(ts).alias("micros"), F.col(row).cast("long").alias("row")).where(F.col(ts).isNotNull() & F.col("row").isNotNull())
    schema = f"key {typed.schema[key].dataType.simpleString()}, kind string, at long, row long, n long"
    found = typed.groupBy(key).transformWithState(_InOrder(rule), schema, "Append", "EventTime")
    return found.select(F.col("key").alias(key), "kind", F.timestamp_micros("at").alias("at"), F.col("row").alias(row), "n")


class _Absorber(StatefulProcessor):
    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "chunk string, members array<string>", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.known.get() if self.known.exists() else None
        state = (held[0], frozenset(held[1])) if held else None
        names = [f.split()[0] for f in ABSORBED.split(", ")]
        out = []
        for r in sorted(rows, key=lambda r: (r["seq"], r["chunk_id"])):
            state, row = absorbed_row(r["seq"], key[0], state, r["chunk_id"], frozenset(r["members"] or ()))
            out.append(Row(**dict(zip(names, row))))
        self.known.update((state[0], list(state[1])))
        return iter(out)

    def close(self) -> None:
        pass


def absorbed(chunks: DataFrame, keep_seconds: int | None = 86_400) -> DataFrame:
    """``operators.ordered.absorbed`` of a stream; order of arrival counts, within a batch that of seq.

    A pattern that hasn't been seen for ``keep_seconds`` is forgotten, so that state doesn't grow without end; its next
    chunk is added. None keeps all. State that ends by the clock asks for batches even without rows: a query with
    ``trigger(availableNow=True)`` stops only if ``spark.sql.streaming.noDataMicroBatches.enabled`` is false."""
    known = chunks.where("pattern is not null and chunk_id is not null").select(F.col("seq").cast("long").alias("seq"), "pattern", "chunk_id", "members")
    found = known.groupBy("pattern").transformWithState(_Absorber(keep_seconds and keep_seconds * 1000), ABSORBED, "Append", "ProcessingTime")
    return found.union(without_identity(chunks))


class _Frames(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        latest = {}
        for r in rows:
            if r["node"] not in latest or r["seq"] >= latest[r["node"]]["seq"]:
                latest[r["node"]] = r
        n = self.count.get()[0] if self.count.exists() else 0
        frames = sorted(latest.values(), key=lambda r: (r["seq"], str(r["node"])))
        self.count.update((n + len(frames),))
        return iter([Row(workspace=key[0], settle_seq=n + i, node=r["node"], seq=r["seq"], payload=r["payload"]) for i, r in enumerate(frames, 1)])

    def close(self) -> None:
        pass


def readout_frames(settled: DataFrame) -> DataFrame:
    """(workspace, settle_seq, node, seq, payload): a frame per node that settled since the last batch, with its latest payload.

    ``settled`` has workspace, node, seq and payload. Frames of a workspace are numbered without gaps in order of settling; a
    node that settled twice before the batch gives one frame. A batch's size (files per trigger) bounds what is in flight."""
    rows = settled.select(F.col("workspace").cast("string").alias("workspace"), F.col("node").cast("string").alias("node"), F.col("seq").cast("long").alias("seq"), F.col("payload").cast("string").alias("payload")).where("seq is not null")
    return rows.groupBy("workspace").transformWithState(_Frames(), "workspace string, settle_seq long, node string, seq long, payload string", "Append", "None")
