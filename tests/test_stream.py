"""Streams over growing folders: they end up where the batch functions do."""

import os

from pyspark.sql import functions as F

from boutline.operators.moments import wasted_inputs
from boutline.sources.files import read_documents, read_gauge, write_bundles, write_documents, write_gauge
from boutline.streaming import online as S
from boutline.streaming import watch as W

INPUT = "match_id long, slot int, frame long, seq long, action string"


def rows(n0, n1):
    return [(i % 3, i % 2, 3 * i + (i * i) % 30, i, "ab"[i // 2 % 2]) for i in range(n0, n1)]


def drain(df, tmp, name, mode="append"):
    q = df.writeStream.format("parquet").option("path", f"{tmp}/{name}").option("checkpointLocation", f"{tmp}/{name}-log").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{tmp}/{name}")


def test_online_wasted_equals_batch_over_two_runs(spark, tmp_path):
    busy = {"a": 60, "b": 0}
    acts = spark.createDataFrame([("a", 60, "x"), ("b", 0, "x")], "action string, busy int, category string")
    for lo, hi in ((0, 40), (40, 90)):
        spark.createDataFrame(rows(lo, hi), INPUT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = drain(S.online_wasted(W.watch_table(spark, f"{tmp_path}/in", spark.createDataFrame([], INPUT).schema), busy), tmp_path, "out")
    want = wasted_inputs(spark.createDataFrame(rows(0, 90), INPUT), acts, 64).filter("wasted")
    assert sorted((r.seq, r.gap) for r in got.collect()) == sorted((r.seq, r.gap) for r in want.collect())
    assert got.count() > 0


def test_watch_skips_the_backlog_and_takes_each_file_once(spark, tmp_path):
    src = tmp_path / "files"
    src.mkdir()
    (src / "old.replay").write_bytes(b"old")
    os.utime(src / "old.replay", (1_000_000_000, 1_000_000_000))
    seen = lambda: sorted(os.path.basename(r.path) for r in drain(W.watch_files(spark, str(src), "*.replay", since="2020-01-01T00:00:00").select("path", "length"), tmp_path, "seen").collect())
    (src / "new.replay").write_bytes(b"new")
    assert seen() == ["new.replay"]
    (src / "newer.replay").write_bytes(b"newer")
    (src / "note.txt").write_bytes(b"x")
    assert seen() == ["new.replay", "newer.replay"]


def test_a_file_settles_when_it_stops_growing(spark, tmp_path):
    obs = [("a", 10, 0), ("a", 20, 1), ("a", 20, 2), ("a", 20, 3), ("a", 20, 4), ("b", 5, 0), ("b", 6, 1), ("b", 7, 3), ("c", 1, 0), ("c", 1, 1)]
    df = spark.createDataFrame([(p, s, float(t)) for p, s, t in obs], "path string, size long, at double").select("path", "size", F.timestamp_seconds("at").alias("ts"))
    df.coalesce(1).write.parquet(f"{tmp_path}/obs")
    got = drain(W.settled_files(W.watch_table(spark, f"{tmp_path}/obs", df.schema)), tmp_path, "settled")
    assert [(r.path, r.size) for r in got.collect()] == [("a", 20)]
    more = spark.createDataFrame([("b", 7, 5.5), ("a", 20, 9.0)], "path string, size long, at double").select("path", "size", F.timestamp_seconds("at").alias("ts"))
    more.coalesce(1).write.mode("append").parquet(f"{tmp_path}/obs")
    got = drain(W.settled_files(W.watch_table(spark, f"{tmp_path}/obs", df.schema)), tmp_path, "settled")
    assert sorted((r.path, r.size) for r in got.collect()) == [("a", 20), ("b", 7)]


def test_ingest_stream_touches_only_its_partitions(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/store"
    schema = spark.createDataFrame([], INPUT).schema
    build = lambda b: b.groupBy("match_id").agg(F.count("*").alias("n"), F.max("seq").alias("last"))
    for batch in ([r for r in rows(0, 30)], [r for r in rows(30, 60) if r[0] == 1]):
        spark.createDataFrame(batch, INPUT).coalesce(1).write.mode("append").parquet(src)
        W.ingest_stream(W.watch_table(spark, src, schema), build, out, ["match_id"], f"{tmp_path}/log").awaitTermination()
    got = {r.match_id: (r.n, r.last) for r in spark.read.parquet(out).collect()}
    assert got[0] == (10, 27) and got[2] == (10, 29) and got[1] == (10, 58)


def test_stages_refuse_and_report(spark):
    def boom(_):
        raise ValueError("no")
    res, status = W.run_stages(spark.range(3), [("read", ["input"], lambda r: r["input"]), ("bad", ["read"], boom), ("names", ["bad"], lambda r: r["bad"]), ("plan", ["read"], lambda r: r["read"].limit(1))])
    assert status == {"read": "done", "bad": "failed: ValueError", "names": "refused: needs bad", "plan": "done"}
    assert res["plan"].count() == 1


def test_awards_pay_once(spark, tmp_path):
    rows_ = [(1, "card_viewed", "x", "2024-01-01 10:00:00", 1), (1, "card_viewed", "x", "2024-01-01 11:00:00", 2), (1, "team_saved", None, "2024-01-01 10:00:00", 3),
             (1, "team_saved", None, "2024-01-02 10:00:00", 4), (1, "drill_logged", None, "2024-01-01 10:00:00", 5), (1, "drill_logged", None, "2024-01-01 10:00:01", 6), (1, "unknown", None, "2024-01-01 10:00:00", 7)]
    df = spark.createDataFrame(rows_, "user long, event string, ref string, t string, seq long").withColumn("t", F.to_timestamp("t"))
    df.coalesce(1).write.parquet(f"{tmp_path}/aw")
    for late in (None, "2023-06-01 10:00:00"):  # an award that comes half a year late, and one of a key that was paid
        if late:
            spark.createDataFrame([(1, "card_viewed", "x", late, 8), (1, "mode_open", "m", late, 9)], "user long, event string, ref string, t string, seq long").withColumn(
                "t", F.to_timestamp("t")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/aw")
        S.pay_awards(W.watch_table(spark, f"{tmp_path}/aw", df.schema), f"{tmp_path}/paid", f"{tmp_path}/log").awaitTermination()
        got = spark.read.parquet(f"{tmp_path}/paid")
        assert got.agg(F.sum("xp")).first()[0] == 3 + 25 + 25 + 10 + 10 + (15 if late else 0)
        assert got.select("user", "key").distinct().count() == got.count()


def test_windowed_activity_streams_as_it_batches(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.repartition(3).write.parquet(f"{tmp_path}/ev")
    stream = S.activity(W.watch_table(spark, f"{tmp_path}/ev", src.schema, files_per_batch=3), ["event_type"], "1 day", late="0 seconds").select("event_type", "start", "n")
    q = stream.writeStream.format("memory").queryName("act").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.event_type, r.start, r.n) for r in spark.table("act").collect())
    want = sorted((r.event_type, r.start, r.n) for r in S.activity(src, ["event_type"], "1 day").collect())
    assert got == want


def test_documents_round_trip_with_a_broken_one(spark, tmp_path):
    docs = spark.createDataFrame([(1, ("v7",), [1, 2])], "match_id long, match struct<patch:string>, xs array<int>")
    write_documents(docs, f"{tmp_path}/docs")
    folder = next(p for p in (tmp_path / "docs").iterdir() if p.is_dir())
    (folder / "broken.json").write_text("{not json\n")
    schema = "match_id long, match struct<patch:string>, xs array<int>, _corrupt_record string"
    got = read_documents(spark, f"{tmp_path}/docs", schema).collect()
    assert sorted((r.match_id or 0, r._corrupt_record is not None) for r in got) == [(0, True), (1, False)]


def test_gauge_and_bundles_keep_unknowns_and_order(spark, tmp_path):
    g = spark.createDataFrame([(0.0, 1, None, 0, 2), (0.1, None, 3, 0, 2)], "t double, gauge_p1 int, gauge_p2 int, assemble_p1 int, assemble_p2 int")
    write_gauge(g, f"{tmp_path}/g")
    assert sorted(map(tuple, read_gauge(spark, f"{tmp_path}/g").collect()), key=lambda r: r[0]) == [(0.0, 1, None, 0, 2), (0.1, None, 3, 0, 2)]
    write_bundles(spark.createDataFrame([(1, "b", "two"), (1, "a", "one"), (2, "c", "x")], "video int, id string, line string"), f"{tmp_path}/t")
    one = [ln for f in sorted((tmp_path / "t" / "video=1").glob("part-*")) for ln in f.read_text().split()]
    assert one == ["one", "two"]
