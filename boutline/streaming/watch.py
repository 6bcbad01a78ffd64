"""Watching a folder: new files once, only when they stopped growing, into the store."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from boutline.streaming.detect import stateful

BINARY = "path string, modificationTime timestamp, length long, content binary"


def watch_files(spark: SparkSession, folder: str, pattern: str, since: str | None = None) -> DataFrame:
    """Each new file of a folder once. Files older than ``since`` (the start) are not processed.
    The query's checkpoint is the record of what was seen."""
    reader = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    files = reader.load(folder)
    # the source filters on the file's own time before it reads any content
    return files if since is None else files.filter(F.col("modificationTime") > F.lit(since).cast("timestamp"))


def watch_table(spark: SparkSession, folder: str, schema, fmt: str = "parquet", pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Rows of new table files of a folder."""
    reader = spark.readStream.format(fmt).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


class Settling(StatefulProcessor):
    """Size and time since when it is so, of one path; what is known of a path is forgotten once it was not observed for ``forget_ms``."""

    def __init__(self, quiet_seconds: float, forget_ms: int):
        self.quiet_seconds, self.forget_ms = quiet_seconds, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "size long, since double, done boolean, last double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        size, since, done, last = self.seen.get() if self.seen.exists() else (-1, 0.0, False, 0.0)
        polls, out = pd.concat(rows).sort_values("at"), []  # the polls of one file in one batch
        for now, new in zip(polls["at"], polls["size"]):
            if done:
                break
            if new != size:
                size, since = int(new), float(now)
            elif now - since >= self.quiet_seconds:
                done = True
                out.append((key[0], size))
        last = max(last, float(polls["at"].max()))
        self.seen.update((size, since, done, last))
        self.handle.registerTimer(int(last * 1000) + self.forget_ms)
        yield pd.DataFrame(out, columns=["path", "size"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.seen.exists() and int(self.seen.get()[3] * 1000) + self.forget_ms <= timerValues.getCurrentWatermarkInMs():
            self.seen.clear()
        yield pd.DataFrame([], columns=["path", "size"])

    def close(self) -> None:
        pass


def settled_files(observed: DataFrame, quiet_seconds: float = 2.0, forget: str = "1 day") -> DataFrame:
    """Paths whose size stayed the same for ``quiet_seconds``; growth restarts the wait; each path once, unless it is not observed for
    ``forget`` (by the time of the polls), after which nothing is kept of it. ``observed(path, size, ts)`` is one row per poll and file."""
    stateful(observed.sparkSession)
    timed = observed.withWatermark("ts", "0 seconds").select("path", "size", F.col("ts").cast("double").alias("at"))
    return timed.groupBy("path").transformWithStateInPandas(Settling(quiet_seconds, int(pd.Timedelta(forget).total_seconds() * 1000)), "path string, size long", "Append", "EventTime")


def ingest_stream(source: DataFrame, build: Callable[[DataFrame], DataFrame], folder: str, by: list[str], checkpoint: str):
    """Every batch through the batch functions into the partitions it touches."""
    from boutline.sources.files import write_slices

    def store(batch: DataFrame, _epoch: int) -> None:
        write_slices(batch.sparkSession, build(batch), folder, by)

    return source.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_stages(batch: DataFrame, stages: list[tuple[str, list[str], Callable[[dict[str, DataFrame]], DataFrame]]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Stages in order, each from the results of those it needs. A stage with a missing prerequisite is refused,
    one that raises has failed; the others go on. Returns results and a status per stage."""
    results, status = {"input": batch}, {}
    for name, needs, work in stages:
        missing = [n for n in needs if n not in results]
        if missing:
            status[name] = "refused: needs " + ", ".join(missing)
            continue
        try:
            results[name] = work(results)
            status[name] = "done"
        except Exception as e:  # the status is the report
            status[name] = f"failed: {type(e).__name__}"
    return results, status
