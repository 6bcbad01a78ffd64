"""Figures that must not grow with the tables: state operations of the detectors, parts of the trial scripts, documents built once."""

import datetime

import pandas as pd
from pyspark.sql import functions as F

from boutline.operators import store as ST
from boutline.operators import textops as X
from boutline.plans import store_queries, text_queries
from boutline.plans.testviews import Tables
from boutline.streaming import detect as D


class Handle:
    """State of one key of the stream, with the operations on it counted."""

    def __init__(self):
        self.calls, self.timers, self.states = 0, set(), {}

    def getListState(self, name, schema):
        return self.states.setdefault(name, State(self))

    getValueState = getListState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class State:
    def __init__(self, handle):
        self.handle, self.rows = handle, []

    def _did(self, rows):
        self.handle.calls += 1
        self.rows = rows

    def exists(self):
        self._did(self.rows)
        return bool(self.rows)

    def get(self):
        self._did(self.rows)
        return iter(self.rows)

    def put(self, rows):
        self._did(list(rows))

    def appendList(self, rows):
        self._did(self.rows + list(rows))

    def clear(self):
        self._did([])


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


def detector(forget_ms=None):
    p, handle = D.InOrder(D.WASTED, [0, 1, 4], lambda b, e: (e, e[0] - b[0]) if e[0] - b[0] < 40 else None, 1.0, forget_ms), Handle()
    p.init(handle)
    return p, handle


def feed(p, rows, now):
    frame = pd.DataFrame(rows, columns=["match_id", "slot", "frame", "seq", "action"])
    return [tuple(r) for d in p.handleInputRows((0,), iter([frame]), Clock(now)) for r in d.itertuples(index=False)]


def fire(p, now):
    return [tuple(r) for d in p.handleExpiredTimer((0,), Clock(now), None) for r in d.itertuples(index=False)]


def test_state_operations_do_not_grow_with_the_keys():
    calls = {}
    for n in (3, 300):
        p, handle = detector()
        assert feed(p, [(m, 0, f, m * 10 + f // 30, "a") for m in range(n) for f in (90, 0, 30)], 0) == []
        got = fire(p, 80)
        assert sorted(got) == [("wasted", m, 0, 30, m * 10 + 1, "a", 30) for m in range(n)]
        assert fire(p, 1000) == []  # sixty frames are no waste
        assert [r[:5] for r in feed(p, [(0, 0, 5, 7, "a"), (None, None, 2000, 8, None)], 1000)] == [("late", 0, 0, 5, 7)]
        calls[n] = handle.calls
    assert calls[3] == calls[300]


def test_idle_keys_are_forgotten_and_busy_ones_kept():
    p, handle = detector(forget_ms=100)
    feed(p, [(1, 0, 0, 1, "a"), (2, 0, 0, 2, "a"), (2, 0, 120, 3, "a")], 0)
    fire(p, 10)
    assert {r[0] for r in handle.states["last"].rows} == {1, 2} and 110 in handle.timers
    fire(p, 110)
    assert {r[0] for r in handle.states["last"].rows} == {2}  # it awaits an event
    fire(p, 130)
    fire(p, 231)
    assert handle.states["last"].rows == [] == handle.states["waiting"].rows


def test_scripts_are_dealt_into_as_many_parts_as_they_need(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_queries, "SCRIPT_LINES", 20)
    lines = [(o, line, (7 * o + line) % 50, 5.0, 1.0) for o in range(100) for line in range(1, 5)] + [(None, 1, 1, 5.0, 1.0), (3, 1, 1, 5.0, 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = X.trial_missions(text_queries.scripts(Tables(spark, str(tmp_path))), "l_orderkey", "script")
    assert found.count() == len(lines)
    held = found.groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert len(held) > 15 and max(r["count"] for r in held) <= 60


def test_documents_are_built_once_for_the_index(spark, tmp_path, monkeypatch):
    at = datetime.datetime(2024, 1, 1)
    events = [(i, at + datetime.timedelta(minutes=25 * i), i % 8, ("click", "view", "purchase", "error")[i // 8 % 4], 70.0) for i in range(160)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    people = [(i, "MACHINERY", i, 5.0 - i) for i in range(8)]
    spark.createDataFrame(people, "c_custkey long, c_mktsegment string, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    given, real = [], ST.index_rows
    monkeypatch.setattr(ST, "index_rows", lambda d: given.append(d) or real(d))
    stored = store_queries._index_store(Tables(spark, str(tmp_path)))
    plan = given[0]._jdf.queryExecution().executedPlan().toString()
    assert len(given) == 1 and "Join" not in plan and "Aggregate" not in plan
    assert sorted(r.match_id for r in stored["matches"].collect()) == [1, 2, 3]  # match 0 was withdrawn
    assert {r.match_id for r in stored["players"].collect()} == {1, 2, 3} and stored["players"].count() == 6
