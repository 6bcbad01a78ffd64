"""Online detectors, windowed activity and awards; the windowed ones run on batch and stream alike."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from boutline.operators.progress import award_key, award_points
from boutline.operators.seq import along, blocked


def online_wasted(inputs: DataFrame, busy: dict[str, int]) -> DataFrame:
    """Presses of an action whose previous press still occupied the player, from one remembered frame per
    (match, slot, action). Rows behind the remembered frame are late and dropped."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        limit = busy.get(key[2], 0)
        last = state.get[0] if state.exists else None
        rows = pd.concat(frames).sort_values(["frame", "seq"])
        if last is not None:
            rows = rows[rows["frame"] >= last]
        gaps = rows["frame"].diff()
        if len(rows):
            gaps.iloc[0] = float("nan") if last is None else rows["frame"].iloc[0] - last
            state.update((int(rows["frame"].iloc[-1]),))
        hit = gaps.notna() & (gaps < limit) if limit > 0 else gaps.notna() & False
        out = rows[hit].assign(gap=gaps[hit].astype("int64"))
        yield out[["match_id", "slot", "frame", "seq", "action", "gap"]]

    return inputs.groupBy("match_id", "slot", "action").applyInPandasWithState(
        step, "match_id long, slot int, frame long, seq long, action string, gap long", "last long", "append", GroupStateTimeout.NoTimeout)


def activity(events: DataFrame, keys: list[str], window: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Actions per minute in tumbling or sliding windows of event time."""
    timed = events.withWatermark("ts", late) if late else events
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    minutes = (F.col("w.end").cast("timestamp").cast("double") - F.col("w.start").cast("timestamp").cast("double")) / 60.0
    return timed.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(
        *keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", (F.col("n") / minutes).alias("apm"))


def sessions(events: DataFrame, keys: list[str], gap: str, late: str | None = None) -> DataFrame:
    """Runs of activity without a pause of ``gap``. A batch cuts them on time blocks, so a key of any size is
    shared by many tasks; a stream keeps them as session windows."""
    if not events.isStreaming:
        return _batch_sessions(events, keys, gap)
    timed = events.withWatermark("ts", late) if late else events
    return timed.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(
        *keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _batch_sessions(events: DataFrame, keys: list[str], gap: str) -> DataFrame:
    stamp = dict(events.dtypes)["ts"]
    pause = F.expr(f"interval {gap}")
    width = 30 * 24 * 3600 * 10**6  # a month of microseconds per block
    at = events.select(*keys, "ts", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("_us"))
    instants = at.groupBy(*keys, "_us", "ts").agg(F.count("*").alias("n"))
    seen = along(blocked(instants, "_us", width), keys, ["_us"], prev={"_prev": F.col("ts")})
    fresh = seen.withColumn("_new", F.when(F.col("ts") < F.col("_prev") + pause, 0).otherwise(1).cast("long"))
    runs = along(fresh, keys, ["_us"], total={"_run": F.col("_new")})
    return runs.groupBy(*keys, (F.col("_run") + F.col("_new")).alias("_run")).agg(
        F.min("ts").alias("start"), (F.max("ts") + pause).cast(stamp).alias("end"), F.sum("n").alias("n")).select(*keys, "start", "end", "n")


def keyed_awards(rows: DataFrame) -> DataFrame:
    """``user, key, event, xp, t, seq`` of rows that earn something. ``rows(user, event, ref, t, seq)``."""
    return rows.withColumn("xp", award_points(F.col("event"))).filter("xp is not null").select(
        "user", award_key(F.col("event"), F.col("ref"), F.col("t"), F.col("seq")).alias("key"), "event", "xp", "t", "seq")


def pay_awards(stream: DataFrame, folder: str, log: str, **trigger):
    """Starts a query that pays each (user, key) once, however late it comes: what was paid is a table in ``folder``, and a batch adds
    what it lacks, so no state grows in memory and a batch that runs twice pays nothing twice."""

    def pay(batch: DataFrame, _: int) -> None:
        first = keyed_awards(batch).groupBy("user", "key").agg(F.min(F.struct("t", "seq", "event", "xp")).alias("_f")).select("user", "key", "_f.event", "_f.xp", "_f.t", "_f.seq")
        paid = batch.sparkSession.read.schema(first.schema).parquet(folder).select("user", "key")
        first.join(paid, ["user", "key"], "left_anti").write.mode("append").parquet(folder)

    keyed_awards(stream.sparkSession.createDataFrame([], stream.schema)).select("user", "key", "event", "xp", "t", "seq").write.mode("append").parquet(folder)
    return stream.writeStream.foreachBatch(pay).option("checkpointLocation", log).trigger(**(trigger or {"availableNow": True})).start()
