"""Panel operators against sequential definitions on random samples with many unread fields."""

import random

import pytest

from boutline.operators import panel as P

SAMPLE = "segment int, side string, t double, damage int, combo int, recovery int, startup int, active int, total int, held int, row1 int, frozen boolean"


@pytest.fixture(scope="module")
def samples(spark):
    rnd = random.Random(11)
    rows = []
    for seg in range(5):
        for side in "LR":
            t = 0.0
            combo = 0
            for _ in range(rnd.randint(1, 120)):
                t = round(t + 0.1 * rnd.choice([1, 1, 1, 2, 30]), 2)
                combo = rnd.choice([0, combo, combo + 50, combo + 100, 50, None, None]) if combo is not None else rnd.choice([0, 50, 100, None])
                dmg = rnd.choice([combo, 50, 100, None])
                rows.append((seg, side, t, dmg, combo, rnd.choice([None, None, -3, -8, -20, 5]), rnd.choice([None, 5, 5, 7]), rnd.choice([None, 1, 2]),
                             rnd.choice([None, 10, 12, 20]), rnd.randint(0, 12), rnd.randint(0, 12), rnd.random() < 0.1))
    return rows, spark.createDataFrame(rows, SAMPLE)


def by_side(rows):
    for key in sorted({(r[0], r[1]) for r in rows}):
        yield key, [r for r in sorted(rows, key=lambda r: r[2]) if (r[0], r[1]) == key and not r[11]]


def test_stuck_windows(spark, samples):
    rows, df = samples
    want = []
    for key, live in by_side(rows):
        open_, unread = None, 0
        for r in live:
            v = r[5]
            if v is None:
                unread += 1
                if unread > 5 and open_:
                    want.append((*key, *open_))
                    open_ = None
            else:
                unread = 0
                if v <= -6:
                    open_ = [r[2], r[2], v] if open_ is None else [open_[0], r[2], min(open_[2], v)]
                elif open_:
                    want.append((*key, *open_))
                    open_ = None
        if open_:
            want.append((*key, *open_))
    got = sorted(tuple(r) for r in P.stuck_windows(df, width=2.0).select("segment", "side", "first_seen", "end", "worst").collect())
    assert got == sorted(want)


def test_combos(spark, samples):
    rows, df = samples
    want = []
    for key, live in by_side(rows):
        cur, before = None, None
        for r in live:
            v = r[4]
            if v is None:
                continue
            if v == 0:
                if cur:
                    want.append((*key, *cur))
                cur = None
            elif v != before:
                start = v == r[3] or (before is not None and 0 < v < before)
                if start or (cur is None and before is not None and v > before):
                    if cur:
                        want.append((*key, *cur))
                    cur = [r[2], r[2], v, 1, not start]
                elif cur and before is not None and v > before:
                    cur = [cur[0], r[2], v, cur[3] + 1, cur[4]]
            before = v
        if cur:
            want.append((*key, *cur))
    got = P.combos(P.combo_hits(df, width=2.0)).select("segment", "side", "t0", "t1", "damage", "hits", "first_hit_inferred")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_moves(spark, samples):
    rows, df = samples
    want = []
    for key, live in by_side(rows):
        cur = None
        for r in live:
            su, tot = r[6], r[8]
            if su is None and tot is None:
                continue
            same = cur and (su is None or cur[3] is None or su == cur[3]) and not (tot is not None and cur[4] is not None and tot < cur[4])
            if same:
                cur = [cur[0], r[2], cur[2] + 1, su if cur[3] is None else cur[3], tot if tot is not None else cur[4]]
            else:
                if cur:
                    want.append((*key, *cur))
                cur = [r[2], r[2], 1, su, tot]
        if cur:
            want.append((*key, *cur))
    got = P.moves(df, width=2.0).select("segment", "side", "t", "until", "samples", "startup", "total")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_frozen_spans(spark, samples):
    rows, df = samples
    fields = ["combo", "recovery", "startup"]
    one = df.filter("side = 'L'").select("segment", "t", *fields)
    want = []
    for seg in sorted({r[0] for r in rows}):
        rs = sorted((r[2], (r[4], r[5], r[6])) for r in rows if r[0] == seg and r[1] == "L")
        i = 0
        while i < len(rs):
            known, j = list(rs[i][1]), i
            while j + 1 < len(rs) and not any(a is not None and b is not None and a != b for a, b in zip(known, rs[j + 1][1])):
                known = [b if a is None else a for a, b in zip(known, rs[j + 1][1])]
                j += 1
            want.append((seg, rs[i][0], rs[j][0], j - i + 1))
            i = j + 1
    got = P.frozen_spans(one, fields, hold=1.0, width=2.0).select("segment", "start", "end", "samples")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_unread_score_is_off_and_short_stretches_go(spark):
    sc = [("v", float(5 * i), s) for i, s in enumerate([0.9, 0.9, None, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.1, 0.9])]
    got = P.score_segments(spark.createDataFrame(sc, "video string, t double, score double")).collect()
    assert [(r.start, r.end) for r in got] == [(17.5, 42.5)]


def test_event_merge_chains_on_the_end_so_far(spark):
    ops = [(1, "L", "R", 10.0, 12.0, 20), (1, "L", "R", 13.5, 13.6, 40), (1, "L", "R", 15.2, 15.3, 40), (1, "R", "L", 15.2, 15.4, 13)]
    df = spark.createDataFrame(ops, "segment int, free string, stuck string, start double, end double, frames int")
    got = sorted((r.free, r.start, r.end, r.windows, r.anchor, r.frames) for r in P.stall_events(df, width=4.0).collect())
    assert got == [("L", 10.0, 13.6, 2, 13.6, 40), ("L", 15.2, 15.3, 1, 15.3, 40), ("R", 15.2, 15.4, 1, 15.4, 13)]
