"""Tables that change together: stale children, repeated batches, refusal and restoring, matches in several batches."""

import pytest
from pyspark.sql import functions as F

from boutline.sources import versions as V
from boutline.streaming import watch as W

M, P = "match_id long, patch string", "match_id long, slot int, name string"


def table(spark, folder, name, schema, version=None):
    return sorted(map(tuple, V.read_version(spark, folder, name, schema, version).collect()))


def put(spark, folder, matches, players, batch=None, touched=None):
    m, p = spark.createDataFrame(matches, M), spark.createDataFrame(players, P)
    keys = m if touched is None else spark.createDataFrame([(t,) for t in touched], "match_id long")
    return V.replace_keys(spark, folder, {"matches": m, "players": p}, "match_id", keys, batch, buckets=4)


def test_children_change_with_their_match(spark, tmp_path):
    f = str(tmp_path)
    assert table(spark, f, "players", P) == []
    assert put(spark, f, [(i, "v1") for i in range(20)], [(i, s, f"p{i}") for i in range(20) for s in range(3)], "b0") == 1
    assert put(spark, f, [(3, "v2")], [(3, 0, "new")], "b1") == 2
    got = table(spark, f, "players", P)
    assert [r for r in got if r[0] == 3] == [(3, 0, "new")] and len(got) == 19 * 3 + 1
    assert put(spark, f, [(3, "v9")], [], "b1") == 2 and table(spark, f, "players", P) == got  # the batch runs again
    put(spark, f, [], [], "b2", touched=[4])
    assert [r for r in table(spark, f, "matches", M) if r[0] in (3, 4)] == [(3, "v2")]
    assert len(table(spark, f, "matches", M, 1)) == 20 and V.restore(spark, f, 1) == 4
    assert table(spark, f, "matches", M) == [(i, "v1") for i in range(20)] and len(table(spark, f, "players", P)) == 60
    with pytest.raises(ValueError):
        put(spark, f, [(5, "x")], [(6, 0, "y")])
    with pytest.raises(KeyError):
        V.current(spark, f, 77)
    with pytest.raises(ValueError):
        put(spark, f, [(None, "v0")], [], "b3")


def test_slices(spark, tmp_path):
    f, s = str(tmp_path), "segment long, t double"
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "segment long")
    rows = lambda *x: spark.createDataFrame(list(x), s)
    V.overwrite_slices(spark, f, "captions", rows((1, 0.5), (2, 1.5), (3, 2.5)), "segment", ids(1, 2, 3), ids(1, 2, 3))
    V.overwrite_slices(spark, f, "captions", rows((2, 9.0)), "segment", ids(2, 3))
    assert table(spark, f, "captions", s) == [(1, 0.5), (2, 9.0)]
    with pytest.raises(V.PartialSweep, match="1 of the required"):
        V.overwrite_slices(spark, f, "captions", rows((2, 0.0)), "segment", ids(1, 2), ids(1, 2, 3))
    assert table(spark, f, "captions", s) == [(1, 0.5), (2, 9.0)]
    V.restore(spark, f, 1)
    assert table(spark, f, "captions", s) == [(1, 0.5), (2, 1.5), (3, 2.5)]


def test_a_match_in_several_batches_is_whole(spark, tmp_path):
    raw = "match_id long, slot int, frame long"
    schema = spark.createDataFrame([], raw).schema
    rows = [(i % 4, i % 2, i) for i in range(90)]

    def build(r):
        return {"counts": r.groupBy("match_id").agg(F.count("*").alias("n"), F.max("frame").alias("last")), "slots": r.select("match_id", "slot").distinct()}

    for part in (rows[:30], rows[30:60], rows[60:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for _ in range(2):
        V.ingest_stream(W.watch_table(spark, f"{tmp_path}/in", schema, files_per_batch=1), f"{tmp_path}/store", "match_id", build, f"{tmp_path}/log", 4).awaitTermination()
        want = sorted((m, sum(r[0] == m for r in rows), max(r[2] for r in rows if r[0] == m)) for m in range(4))
        assert table(spark, f"{tmp_path}/store", "counts", "match_id long, n long, last long") == want
    last = V.current(spark, f"{tmp_path}/store")["version"]
    V.ingest_batch(spark, f"{tmp_path}/store", spark.createDataFrame(rows[:30], schema), "match_id", build, f"{tmp_path}/log#0", 4)  # a batch that runs again
    assert V.current(spark, f"{tmp_path}/store")["version"] == last == 3
