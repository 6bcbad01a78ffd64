"""Online detectors that give the same rows in whatever batches the input comes.

An event waits in the state of its key's bucket until the watermark has passed it; then all events before the watermark are read in order,
once. A timer at the earliest waiting event wakes the bucket, so a key whose input has ended is finished too. Events behind the watermark
are late: they change nothing and come out as rows of their own, to be counted or kept. What is held of a key is its events within the
watermark's delay and its last event; a key that was idle for longer than ``forget`` gives even that up.

A stream that has ended is closed by a marker row (`end_marker`) in a second run, which moves the watermark past all events."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LATE, WASTED, IDLE = "late", "wasted", "idle"  # kinds of output rows
FOUND = "kind string, match_id long, slot int, frame long, seq long, action string, gap long"
EVENT = "match_id long, slot int, frame long, seq long, action string"
BUCKETS = 512  # keys share so many buckets of state; a stream keeps the number it began with
AT_ONCE = 10_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark: SparkSession) -> None:
    """State with timers and lists needs this provider; it also keeps state out of the executors' heap."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKS:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def passed(rows: list[tuple], kind: str, gap_of) -> pd.DataFrame:
    """Output rows of one kind from (match, slot, frame, seq, action) and a gap for each, where it is not None."""
    out = [(kind, *r, g) for r, g in zip(rows, gap_of) if g is not None or kind == LATE]
    return pd.DataFrame(out, columns=["kind", "match_id", "slot", "frame", "seq", "action", "gap"]).astype({"match_id": "int64", "slot": "int32", "frame": "int64", "seq": "int64", "gap": "Int64"})


class InOrder(StatefulProcessor):
    """Reads each key's events in (frame, seq) order as the watermark passes them. One call serves a bucket of keys, so the calls and the
    state operations grow with the buckets, not with the keys. ``by`` are the places in (match, slot, frame, seq, action) that make up a
    key. ``judge(before, event)`` compares an event with the one before it, both (frame, seq, action): it gives the event to report and
    its gap, or None."""

    def __init__(self, kind: str, by: list[int], judge, frame_ms: float, forget_ms: int | None):
        self.kind, self.by, self.judge, self.frame_ms, self.forget_ms = kind, by, judge, frame_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", EVENT)
        self.last = handle.getListState("last", EVENT + ", until long")  # one row a key, with when it may be forgotten

    def at(self, frame: int) -> int:
        return int(frame * self.frame_ms)

    def key(self, event: tuple) -> tuple:
        return tuple(event[i] for i in self.by)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, first = timerValues.getCurrentWatermarkInMs(), None
        for some in rows:
            some = some[some["match_id"].notna()]
            late, early = [], []
            for e in zip(_ints(some["match_id"]), _ints(some["slot"]), map(int, some["frame"]), map(int, some["seq"]), some["action"]):
                (late if self.at(e[2]) < now else early).append(e)
            if early:
                self.waiting.appendList(early)
                first = min([e[2] for e in early] + ([] if first is None else [first]))
            if late:
                yield passed(late, LATE, [None] * len(late))
        if first is not None:
            self.handle.registerTimer(self.at(first) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        ready, rest = [], []
        for e in _rows(self.waiting):
            (ready if self.at(e[2]) < now else rest).append(e)
        if ready or self.forget_ms is not None:
            last = {self.key(e): e for e in _rows(self.last)}
            known, found, gaps = len(last), [], []
            for e in sorted(ready, key=lambda e: e[2:4]):
                before = last.get(self.key(e))
                told = self.judge(before[2:5], e[2:]) if before else None
                if told:
                    found.append((*e[:2], *told[0]))
                    gaps.append(told[1])
                last[self.key(e)] = (*e, None if self.forget_ms is None else max(now, self.at(e[2])) + self.forget_ms)
            if self.forget_ms is not None:
                awaited = {self.key(e) for e in rest}
                last = {k: e for k, e in last.items() if e[5] > now or k in awaited}
                if idle := [e[5] for k, e in last.items() if k not in awaited]:
                    self.handle.registerTimer(min(idle))
            if ready or len(last) < known:
                _put(self.last, list(last.values()))
            if found:
                yield passed(found, self.kind, gaps)
        if ready:
            _put(self.waiting, rest)
            if rest:
                self.handle.registerTimer(self.at(min(e[2] for e in rest)) + 1)

    def close(self) -> None:
        pass


def _ints(column: pd.Series) -> list:
    return [None if pd.isna(x) else int(x) for x in column.tolist()]


def _rows(state) -> list[tuple]:
    return [tuple(e) for e in state.get()] if state.exists() else []


def _put(state, rows: list[tuple]) -> None:
    """``rows`` in place of what a list state holds, in messages of bounded size."""
    if not rows:
        state.clear()
    for a in range(0, len(rows), AT_ONCE):
        (state.appendList if a else state.put)(rows[a:a + AT_ONCE])


def _run(inputs: DataFrame, keys: list[str], processor: InOrder, late: str) -> DataFrame:
    stateful(inputs.sparkSession)
    timed = inputs.withColumn("_ts", F.timestamp_millis((F.col("frame") * processor.frame_ms).cast("long"))).withWatermark("_ts", late)
    # a copy of the rows without the time column, so that late rows reach the processor and are counted there
    rows = timed.select("match_id", F.col("slot").cast("int").alias("slot"), F.col("frame").cast("long").alias("frame"), F.col("seq").cast("long").alias("seq"), "action")
    rows = rows.filter("match_id is not null or action is null")  # of rows without match only the marker goes on: the filter is run before the watermark
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
    return dealt.groupBy("bucket").transformWithStateInPandas(processor, FOUND, "Append", "EventTime")


def wasted_presses(inputs: DataFrame, busy: dict[str, int], late: str = "10 seconds", fps: float = 60.0, forget: str | None = None) -> DataFrame:
    """Presses (kind ``wasted``) less than ``busy[action]`` frames after the previous press of the action, with the gap, and late presses
    (kind ``late``) of ``inputs(match_id, slot, frame, seq, action)``. Frames are event time at ``fps``; a press may come ``late`` behind the
    latest frame seen. A row without match only moves the watermark."""

    def judge(before, e):
        gap = e[0] - before[0]
        return (e, gap) if gap < busy.get(e[2], 0) else None

    return _run(inputs, ["match_id", "slot", "action"], InOrder(WASTED, [0, 1, 4], judge, 1000 / fps, _ms(forget)), late)


def idle_stretches(inputs: DataFrame, frames: int, late: str = "10 seconds", fps: float = 60.0) -> DataFrame:
    """Stretches of at least ``frames`` frames without input (kind ``idle``), reported at the event before them, and late events."""

    def judge(before, e):
        gap = e[0] - before[0]
        return (before, gap) if gap >= frames else None

    return _run(inputs, ["match_id", "slot"], InOrder(IDLE, [0, 1], judge, 1000 / fps, None), late)


def _ms(interval: str | None) -> int | None:
    return None if interval is None else int(pd.Timedelta(interval).total_seconds() * 1000)


def end_marker(spark: SparkSession, schema, after_frame: int) -> DataFrame:
    """One row of ``schema`` without match at ``after_frame``: in a stream's input it closes all frames before (by more than ``late``)."""
    return spark.createDataFrame([tuple(after_frame if f.name == "frame" else None for f in schema.fields)], schema)


def run_to_end(start, close) -> None:
    """Runs ``start()`` (a query that ends when its input is read) on the input there is, then again after ``close()`` has put the marker there."""
    start().awaitTermination()
    close()
    start().awaitTermination()
