"""Online detectors: the same rows for every layout of the input, late rows counted."""

import random

import pytest
from pyspark.sql import functions as F

from boutline.operators.moments import idles, wasted_inputs
from boutline.streaming import detect as D
from boutline.streaming import watch as W

INPUT = "match_id long, slot int, frame long, seq long, action string"
BUSY = {"a": 40, "b": 0, "c": 7}


def presses(n=160):
    rng = random.Random(5)
    return [(rng.randrange(3), rng.randrange(2), rng.randrange(900), i, rng.choice("abc")) for i in range(n)] + [(0, 0, 50, 1000 + i, "a") for i in range(3)]


def run(spark, folder, files, detector, end=None, per_batch=1):
    schema = spark.createDataFrame([], INPUT).schema
    for f in files:
        spark.createDataFrame(f, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    out = detector(W.watch_table(spark, f"{folder}/in", schema, files_per_batch=per_batch))

    def start():
        return out.writeStream.format("parquet").partitionBy("kind").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()

    if end is None:
        start().awaitTermination()
    else:
        D.run_to_end(start, lambda: D.end_marker(spark, schema, end).write.mode("append").parquet(f"{folder}/in"))
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def wanted(spark, rows):
    df = spark.createDataFrame(rows, INPUT)
    acts = spark.createDataFrame([(a, b, "x") for a, b in BUSY.items()], "action string, busy int, category string")
    wasted = sorted((r.match_id, r.slot, r.seq, r.gap) for r in wasted_inputs(df, acts, 64).filter("wasted").collect())
    return wasted, sorted((r.match_id, r.slot, r.seq, r.gap) for r in idles(df, 30, 64).collect())


@pytest.mark.parametrize("layout", ["one", "folder", "shuffled"])
def test_layouts(spark, tmp_path, layout):
    rows = presses()
    random.Random(layout).shuffle(rows)
    files = [rows] if layout == "one" else [rows[i::4] for i in range(4)]
    per_batch = 1 if layout == "shuffled" else 10
    wasted, idle = wanted(spark, rows)
    got = run(spark, f"{tmp_path}/w", files, lambda s: D.wasted_presses(s, BUSY, "1 minute"), 10**6, per_batch)
    assert sorted((r.match_id, r.slot, r.seq, r.gap) for r in got.collect()) == wasted and wasted
    if layout != "one":
        got = run(spark, f"{tmp_path}/i", files, lambda s: D.idle_stretches(s, 30, "1 minute"), 10**6, per_batch)
        assert sorted((r.match_id, r.slot, r.seq, r.gap) for r in got.collect()) == idle and idle


def test_late_rows_come_out_and_change_nothing(spark, tmp_path):
    first = [(1, 0, f, f, "a") for f in range(0, 3000, 50)]
    late = [(1, 0, 105, 9001, "a"), (1, 0, 2990, 9002, "a"), (2, 0, 2, 9003, "a")]  # the second is within the second of delay
    got = run(spark, str(tmp_path), [first, late], lambda s: D.wasted_presses(s, {"a": 60}, "1 second"), 10**6).collect()
    assert sorted(r.seq for r in got if r.kind == "late") == [9001, 9003]
    kept = wasted_inputs(spark.createDataFrame(first + late[1:2], INPUT), spark.createDataFrame([("a", 60, "x")], "action string, busy int, category string"), 64)
    assert sorted((r.seq, r.gap) for r in got if r.kind == "wasted") == sorted((r.seq, r.gap) for r in kept.filter("wasted").collect())


def test_rows_wait_only_for_the_watermark(spark, tmp_path):
    """Without an end marker everything older than the delay has come out."""
    rows = [(1, 0, f, f, "a") for f in range(0, 6000, 50)]
    got = run(spark, str(tmp_path), [rows], lambda s: D.wasted_presses(s, {"a": 60}, "10 seconds", forget="1 hour")).filter("kind = 'wasted'")
    assert got.agg(F.max("frame"), F.count("*")).first() == (5300, 106)


def test_a_settled_path_is_forgotten(spark, tmp_path):
    """A path is told once while it is polled, and again only after it was not seen for long."""
    def poll(*rows):
        spark.createDataFrame([(p, s, float(t)) for p, s, t in rows], "path string, size long, at double").select("path", "size", F.timestamp_seconds("at").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def told():
        schema = spark.createDataFrame([], "path string, size long, ts timestamp").schema
        out = W.settled_files(W.watch_table(spark, f"{tmp_path}/in", schema, files_per_batch=1), 2.0, "1 minute")
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.path for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect())

    poll(("a", 5, 0), ("a", 5, 3))
    poll(("a", 5, 6), ("b", 1, 6))
    assert told() == ["a"]
    poll(("b", 1, 7), ("b", 1, 9))
    assert told() == ["a", "b"]
    poll(("c", 1, 300))
    assert told() == ["a", "b"]
    poll(("a", 5, 301), ("a", 5, 304))
    assert told() == ["a", "a", "b"]
