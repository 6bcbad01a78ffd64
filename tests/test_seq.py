"""Sequence operators and temporal joins against plain sequential definitions on random data."""

import random

import pytest
from pyspark.sql import functions as F

from boutline.operators import timejoin as TJ
from boutline.operators.quantiles import medians, order_stats
from boutline.operators.seq import along, anchored_runs, blocked, cut_runs, debounce, islands


def series(seed, keys=6, n=80, top=400):
    rnd = random.Random(seed)
    return {k: sorted(rnd.sample(range(top), rnd.randint(1, n))) for k in range(keys)}, rnd


@pytest.mark.parametrize("width", [7, 64, 5000])
def test_along(spark, width):
    data, rnd = series(1)
    rows = [(k, p, rnd.choice([None, 1, 2, 3]), rnd.randint(-5, 5)) for k, ps in data.items() for p in ps]
    df = spark.createDataFrame(rows, "k int, p int, v int, w int")
    got = along(blocked(df, "p", width), ["k"], ["p"], prev={"prev": F.col("v")}, known={"known": F.col("v")},
                total={"total": F.col("w")}, peak={"peak": F.col("w")})
    got = {(r.k, r.p): (r.prev, r.known, r.total, r.peak) for r in got.collect()}
    assert len(got) == len(rows)
    for k in data:
        prev = known = peak = None
        total = 0
        for _, p, v, w in sorted(r for r in rows if r[0] == k):
            assert got[(k, p)] == (prev, known, total, peak)
            prev, known = v, v if v is not None else known
            total, peak = total + w, w if peak is None else max(peak, w)


def test_islands(spark):
    data, rnd = series(2)
    rows = [(k, p, rnd.random() < 0.3) for k, ps in data.items() for p in ps]
    df = blocked(spark.createDataFrame(rows, "k int, p int, s boolean"), "p", 32)
    got = {(r.k, r.p): r.island for r in islands(df, ["k"], ["p"], F.col("s")).collect()}
    for k in data:
        n = 0
        for _, p, s in sorted(r for r in rows if r[0] == k):
            n += s
            assert got[(k, p)] == n


@pytest.mark.parametrize("gap,width", [(6, 16), (40, 16), (40, 500), (0, 8)])
def test_anchored_runs(spark, gap, width):
    data, _ = series(3)
    df = spark.createDataFrame([(k, p, str(p)) for k, ps in data.items() for p in ps], "k int, p int, tag string")
    got = {(r.k, r.p): (r.run_start, r.tag) for r in anchored_runs(df, ["k"], "p", gap, width, ["tag"]).collect()}
    assert len(got) == sum(map(len, data.values()))
    for k, ps in data.items():
        first = None
        for p in ps:
            if first is None or p - first > gap:
                first = p
            assert got[(k, p)] == (first, str(p))


def test_anchor_is_not_a_chain(spark):
    df = spark.createDataFrame([(0, p) for p in (0, 5, 12, 70)], "k int, p int")
    assert sorted({r.run_start for r in anchored_runs(df, ["k"], "p", 6, 16).collect()}) == [0, 12, 70]


@pytest.mark.parametrize("width", [8, 100])
def test_cut_runs_any_breaks(spark, width):
    data, rnd = series(4)
    rows = [(k, p, rnd.choice([None, rnd.randint(0, p), p - 1])) for k, ps in data.items() for p in ps]
    df = spark.createDataFrame(rows, "k int, p int, q int")
    got = {(r.k, r.p): r.run_start for r in cut_runs(df, ["k"], "p", "q", width).collect()}
    for k in data:
        start = None
        for _, p, q in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            if start is None or (q is not None and q >= start):
                start = p
            assert got[(k, p)] == start


@pytest.mark.parametrize("hold", [1, 2, 3])
def test_debounce(spark, hold):
    data, rnd = series(5)
    rows = [(k, p, rnd.choice([1, 1, 2, None])) for k, ps in data.items() for p in ps]
    df = blocked(spark.createDataFrame(rows, "k int, p int, v int"), "p", 32)
    got = {(r.k, r.p): r.stable for r in debounce(df, ["k"], ["p"], "v", hold).collect()}
    for k in data:
        vals = sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        stable, run, length = vals[0][2], object(), 0
        for _, p, v in vals:
            run, length = (run, length + 1) if v == run else (v, 1)
            stable = v if length >= hold else stable
            assert got[(k, p)] == stable


def points(spark, seed):
    rnd = random.Random(seed)
    left = [(k, i, rnd.randint(0, 300) / 2) for i, k in enumerate([0, 1, 2] * 40)]
    right = [(k, rnd.randint(0, 300) / 2, i) for i, k in enumerate([0, 1] * 25)]
    return left, right, spark.createDataFrame(left, "k int, id int, t double"), spark.createDataFrame(right, "k int, rt double, v int")


@pytest.mark.parametrize("tol", [None, 2.5, 40.0])
@pytest.mark.parametrize("forward", [False, True])
def test_asof(spark, tol, forward):
    left, right, L, R = points(spark, 6)
    got = {r.id: (r.asof_t, r.asof_v) for r in TJ.asof(L, R, ["k"], "t", "rt", ["v"], width=16.0, tolerance=tol, forward=forward).collect()}
    assert len(got) == len(left)
    for k, i, t in left:
        c = [(rt, v) for rk, rt, v in right if rk == k and (rt >= t if forward else rt <= t) and (tol is None or abs(rt - t) <= tol)]
        best = min(c, key=lambda x: (abs(x[0] - t), x[1])) if c else (None, None)
        assert got[i] == best


def test_nearest_prefers_the_earlier(spark):
    left, right, L, R = points(spark, 7)
    got = {r.id: (r.near_t, r.near_v) for r in TJ.nearest(L, R, ["k"], "t", "rt", ["v"], width=16.0, tolerance=6.0).collect()}
    for k, i, t in left:
        c = [(rt, v) for rk, rt, v in right if rk == k and abs(rt - t) <= 6.0]
        assert got[i] == (min(c, key=lambda x: (abs(x[0] - t), x[0], x[1])) if c else (None, None))


def test_interval_joins(spark):
    left, right, L, R = points(spark, 8)
    got = sorted((r.id, r.v) for r in TJ.interval_join(L, R, ["k"], F.col("t") - 5, F.col("t"), "rt", width=5).collect())
    assert got == sorted((i, v) for k, i, t in left for rk, rt, v in right if rk == k and t - 5 <= rt <= t)
    spans = L.withColumn("lo", F.col("t") - 30).withColumn("hi", F.col("t") + 0.5)
    for r in TJ.any_within(spans, R, ["k"], "lo", "hi", "rt", width=16.0).collect():
        assert r.met == any(rk == r.k and r.lo <= rt <= r.hi for rk, rt, _ in right)


def test_exact_order_statistics(spark):
    rnd = random.Random(9)
    vals = {k: [rnd.choice([rnd.random() * 1000, 7.0]) for _ in range(n)] for k, n in ((0, 1), (1, 2), (2, 999), (3, 5000))}
    df = spark.createDataFrame([(k, v) for k, vs in vals.items() for v in vs], "k int, v double")
    n = F.col("n")
    for r in order_stats(df, ["k"], "v", {"p90": F.floor(n * 0.9) + 1, "top": n}).collect():
        s = sorted(vals[r.k])
        assert (r.n, r.p90, r.top) == (len(s), s[int(0.9 * len(s))], s[-1])
    import statistics
    for r in medians(df, ["k"], "v").collect():
        assert r.median == pytest.approx(statistics.median(vals[r.k]))
