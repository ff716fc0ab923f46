"""Stateful streams: debounced batches of coalesced changes, and session deltas, with state by key and event-time timers.

Both hold a key's events until the watermark has passed what could still come before them, so a
stream gives what the batch forms give over all events, in however many micro-batches they come.
Events older than the watermark are dropped, as by every windowed stream; how late an event may be
is a parameter. State is kept by RocksDB and goes when a batch closes or a session falls silent.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.delta import RETAINED, diff_of
from .changes import NOTHING, coalesced

#: The provider that keeps lists and maps of a key as rows of their own. Fixed value.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets that the paths of a workspace are dealt out over, a bit of a long each. Fixed value.
BUCKETS = 32
#: Buckets that sessions' paths are dealt out over. Fixed value.
DEALT = 256
PACKED = pa.schema([("at", pa.int64()), ("seq", pa.int64()), ("path", pa.string()), ("kind", pa.string())])
CHANGES = ["workspace", "start", "end", "path", "kind", "events"]


def prepared(spark: SparkSession) -> None:
    """State by RocksDB for the session's streams."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Silences(StatefulProcessor):
    """Spans of a workspace's events, as their times and the buckets of their paths; a span is given to each of its buckets after ``gap`` microseconds of silence."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getValueState("spans", "spans binary")

    def held(self) -> np.ndarray:
        return np.frombuffer(self.spans.get()[0], np.int64).reshape(-1, 3) if self.spans.exists() else np.empty((0, 3), np.int64)

    def keep(self, spans: np.ndarray) -> None:
        """Spans in their order; the first one is the first to end."""
        self.spans.update((spans.tobytes(),))
        self.handle.registerTimer(-(-(int(spans[0, 1]) + self.gap) // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        spans = self.held()
        for frame in rows:
            at = frame["at"].to_numpy(np.int64)
            fresh = np.column_stack([at, at, np.int64(1) << frame["bucket"].to_numpy(np.int64)])
            spans = merged(np.concatenate([spans, fresh]), self.gap)
        if len(spans):
            self.keep(spans)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        spans = self.held()
        over = spans[:, 1] + self.gap <= passed
        if not over.any() and len(spans):
            self.keep(spans)
        elif over.all():
            self.spans.clear()
        else:
            self.keep(spans[~over])
        for begin in range(0, int(over.sum()), 10_000):
            some = spans[over][begin : begin + 10_000]
            row, bucket = np.nonzero(some[:, 2:] >> np.arange(BUCKETS) & 1)
            # what closes a span comes after all that could be late
            yield pd.DataFrame({"workspace": key[0], "bucket": bucket, "seen": passed + 1000, "at": some[row, 0], "until": some[row, 1] + self.gap})

    def close(self) -> None:
        pass


def merged(spans: np.ndarray, gap: int) -> np.ndarray:
    """Spans (first, last, bits) in time order, those less than ``gap`` apart as one."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    last = np.maximum.accumulate(spans[:, 1])
    begins = np.flatnonzero(np.concatenate([[True], spans[1:, 0] >= last[:-1] + gap]))[: len(spans)]
    if not len(begins):
        return spans
    return np.column_stack([spans[begins, 0], np.maximum.reduceat(spans[:, 1], begins), np.bitwise_or.reduceat(spans[:, 2], begins)])


class SpanChanges(StatefulProcessor):
    """Events of a workspace's bucket of paths, in packed lists, held until the workspace's span is over; then one row for each path that has changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getListState("events", "events binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        over = []
        for frame in rows:
            closing = frame["closing"].to_numpy(bool)
            over += zip(frame["at"][closing].tolist(), frame["until"][closing].tolist(), strict=True)
            if not closing.all():
                self.events.appendValue((packed(pa.Table.from_pandas(frame.loc[~closing, PACKED.names], PACKED, preserve_index=False)),))
        if over:
            yield from self.changes(key, sorted(over))

    def changes(self, key, over: list[tuple[int, int]]) -> Iterator[pd.DataFrame]:
        held = pa.concat_tables(pa.ipc.open_stream(r[0]).read_all() for r in self.events.get())
        held = held.take(pc.sort_indices(held, [(c, "ascending") for c in PACKED.names]))
        at = held["at"].to_numpy()
        open_, out = np.ones(len(at), bool), []
        for start, until in over:
            i, j = np.searchsorted(at, [start, until])
            open_[i:j] = False
            batch = held.slice(i, j - i)
            for path, kind, n in coalesced(list(zip(*(batch[c].to_pylist() for c in PACKED.names), strict=True))):
                if kind != NOTHING:
                    out.append((key[0], start, until, path, kind, n))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=CHANGES)
                out = []
        if open_.any():
            self.events.put([(packed(held.filter(pa.array(open_))),)])
        else:
            self.events.clear()
        if out:
            yield pd.DataFrame(out, columns=CHANGES)

    def close(self) -> None:
        pass


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def debounced_changes(events: DataFrame, gap: timedelta = timedelta(milliseconds=500), late: str = "10 seconds") -> DataFrame:
    """Stream of (workspace, start, end, path, kind, events): a workspace's changes once it has been silent for ``gap``.

    ``events``: workspace, ts, seq, path, kind (see ``changes.split_renames`` for renames). Start is the
    first event's time and end the last one's plus the gap; changes of a path that cancel are left out.
    A workspace's state has only the times of its spans; its events are dealt out by their paths.
    """
    prepared(events.sparkSession)
    bucket = F.pmod(F.xxhash64(F.col("path").cast("string")), F.lit(BUCKETS))
    marked = events.withWatermark("ts", late).select("workspace", bucket.alias("bucket"), "ts", F.unix_micros("ts").alias("at"), F.col("seq").cast("long").alias("seq"), F.col("path").cast("string").alias("path"), "kind")
    kind = events.schema["workspace"].dataType.simpleString()
    spans = marked.select("workspace", "bucket", "ts", "at").groupBy("workspace").transformWithStateInPandas(Silences(int(gap / timedelta(microseconds=1))), f"workspace {kind}, bucket long, seen long, at long, until long", "Append", "EventTime")
    closing = spans.select("workspace", "bucket", F.timestamp_micros("seen").alias("ts"), "at", F.lit(0).cast("long").alias("seq"), F.lit("").alias("path"), F.lit("").alias("kind"), "until", F.lit(True).alias("closing"))
    both = marked.withColumns({"until": F.lit(0).cast("long"), "closing": F.lit(False)}).unionByName(closing)
    found = both.groupBy("workspace", "bucket").transformWithStateInPandas(SpanChanges(), f"workspace {kind}, start long, end long, path string, kind string, events long", "Append", "EventTime")
    return found.withColumns({c: F.timestamp_micros(c) for c in ("start", "end")})


class SessionDelta(StatefulProcessor):
    """What sessions of a bucket were last given of their paths, by hash, and by text where that is short enough; gone at the first sweep after ``silence`` microseconds.

    Texts wait in packed lists until no earlier one can come; a session's path has a row of its own in the state.
    """

    def __init__(self, retained: int, silence: int, kinds: list[str], schema: pa.Schema):
        self.retained, self.silence, self.kinds, self.schema = retained, silence, kinds, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.given = handle.getMapState("given", f"session {self.kinds[0]}, path {self.kinds[1]}", "at long, hash string, text string")
        self.sweep = handle.getValueState("sweep", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = []
        for frame in rows:
            self.waiting.appendValue((packed(pa.Table.from_pandas(frame[self.schema.names], self.schema, preserve_index=False)),))
            first.append(int(frame["at"].min()))
        if first:
            self.handle.registerTimer(min(first) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        chunks = [pa.ipc.open_stream(r[0]).read_all() for r in self.waiting.get()]
        if chunks:
            held = pa.concat_tables(chunks)
            ready = pc.less(held["at"], passed)
            rest = held.filter(pc.invert(ready))
            yield from self.deltas(held.filter(ready))
            if not len(rest):
                self.waiting.clear()
            elif len(rest) < len(held):
                self.waiting.put([(packed(rest),)])
            if len(rest):
                self.handle.registerTimer(pc.min(rest["at"]).as_py() // 1000 + 1)
        self.swept(passed)

    def deltas(self, ready: pa.Table) -> Iterator[pd.DataFrame]:
        ready = ready.take(pc.sort_indices(ready, [(c, "ascending") for c in ("at", "seq", "text")]))
        last, out = {}, []
        for session, path, at, seq, text in zip(*(ready[c].to_pylist() for c in ("session", "path", "at", "seq", "text")), strict=True):
            k = session, path
            before = last[k] if k in last else self.given.getValue(k)
            if before is not None and at >= before[0] + self.silence:
                before = None
            digest, state, diff = diff_of(None if before is None else tuple(before)[1:], text)
            out.append((session, path, at, seq, state, diff))
            last[k] = at, digest, text if len(text) <= self.retained else None
        for k, value in last.items():
            self.given.updateValue(k, value)
        for begin in range(0, len(out), 10_000):
            yield pd.DataFrame(out[begin : begin + 10_000], columns=["session", "path", "at", "seq", "state", "diff"])

    def swept(self, passed: int) -> None:
        """Drops what has been silent, once in a time of silence."""
        due = self.sweep.get()[0] if self.sweep.exists() else None
        if due is not None and passed <= due:
            return
        if due is not None:
            for k in [tuple(k) for k, value in self.given.iterator() if value[0] + self.silence < passed]:
                self.given.removeKey(k)
        if due is None or self.given.exists():
            self.sweep.update((passed + self.silence,))
            self.handle.registerTimer((passed + self.silence) // 1000 + 1)
        else:
            self.sweep.clear()

    def close(self) -> None:
        pass


def session_deltas(given: DataFrame, retained: int = RETAINED, silence: timedelta = timedelta(days=1), late: str = "10 seconds") -> DataFrame:
    """Stream of (session, path, ts, seq, state, diff): each text that a session is given against the one before of its path.

    ``given``: session, path, ts, seq, text; states as ``delta.session_delta``. A path that a session has not asked for
    since ``silence`` is new again, and its state is dropped within twice that time. Sessions' paths are dealt out over
    ``DEALT`` buckets, so that state is asked for by bucket and not by event.
    """
    prepared(given.sparkSession)
    types = [given.schema[c].dataType for c in ("session", "path")]
    kinds = [t.simpleString() for t in types]
    schema = pa.schema([("session", to_arrow_type(types[0])), ("path", to_arrow_type(types[1])), ("at", pa.int64()), ("seq", pa.int64()), ("text", pa.string())])
    marked = given.withWatermark("ts", late).select(F.pmod(F.xxhash64("session", "path"), F.lit(DEALT)).alias("bucket"), "session", "path", "ts", F.unix_micros("ts").alias("at"), F.col("seq").cast("long").alias("seq"), F.coalesce("text", F.lit("")).alias("text"))
    deltas = SessionDelta(retained, int(silence / timedelta(microseconds=1)), kinds, schema)
    found = marked.groupBy("bucket").transformWithStateInPandas(deltas, f"session {kinds[0]}, path {kinds[1]}, at long, seq long, state string, diff string", "Append", "EventTime")
    return found.select("session", "path", F.timestamp_micros("at").alias("ts"), "seq", "state", "diff")
