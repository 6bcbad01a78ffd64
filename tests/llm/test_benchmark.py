"""Ranked search and decontamination against SQL and plain definitions."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest

from boutline.llm import decontaminate, queries, ranked
from tests.check import compare, connect
from tests.llm.conftest import FOLDER

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("name", ["op12_ranked_search", "op13_decontamination"])
def test_against_sql(spark, name):
    error, *_ = compare(connect(FOLDER), spark, name, queries.QUERIES[name], queries.ORACLES[name], FOLDER)
    assert error is None, error


def plain_search(docs, items, k):
    lists = [(i, collections.Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in lists), sum(sum(c.values()) for _, c in lists)
    df = collections.Counter(t for _, c in lists for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in lists:
            m = 50 + (50 * sum(c.values()) * n) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0 and i is not None:
                found.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k,shard,step,items_at_once", [(5, 40, 1, 3), (50, 10**6, 64, 5000)])
def test_search(spark, monkeypatch, k, shard, step, items_at_once):
    for name, v in (("SHARD", shard), ("STEP", step), ("ITEMS", items_at_once)):
        monkeypatch.setattr(ranked, name, v)
    rng = np.random.default_rng(6)
    draw = lambda n: " ".join(f"W{int(x)}" for x in rng.zipf(1.4, n) % 60)
    docs = [(i, draw(int(n))) for i, n in enumerate(rng.integers(0, 40, 300))]
    docs += [(1000 + i, docs[7][1]) for i in range(60)] + [(500, None), (501, ""), (502, "?!"), (None, draw(30)), (503, "é" * 9 + " w1 W2 " * 900), (503, "w1 w2")]
    items = [(i, draw(6)) for i in range(8)] + [(8, None), (9, "?"), (10, "nowhere"), (10, "w1 W1 w2"), (None, docs[7][1])]
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id bigint, text string, n int, item int")
    got = ranked.search(d, spark.createDataFrame(items, "item_id bigint, text string"), k)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_search(docs, items, k)


def test_search_stops_early():
    """One document far ahead of all others: few others are looked up, and the best k are those of a whole scan."""
    rng = np.random.default_rng(2)
    n, t = 20_000, 8
    impact = np.sort(rng.integers(1, 1000, n * t).reshape(n, t) ** 3 // 10**6 + 1)
    impact[:30] += 5000
    shard = ranked.Shard(np.tile(np.arange(t), n), impact.ravel(), np.arange(0, n * t + 1, t), t)
    docs, scores, looked = shard.best(np.arange(t), np.full(t, -1), 20, 0)
    want = impact.sum(1)
    best = np.lexsort((np.arange(n), -want))[:20]
    assert set(best) <= set(docs) and (scores == want[docs]).all() and looked < n // 10


def test_search_on_odd_tables(spark, odd, none, real):
    items = spark.createDataFrame([("a", "prose word1 thing7"), ("b", None)], "item_id string, text string")
    assert ranked.search(none, items).count() == 0 and ranked.search(odd, items.limit(0)).count() == 0
    rows = ranked.search(odd, items).collect()
    assert {r.doc_id for r in rows} == {5, 6} and [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == [1, 2, 3]


def plain_contamination(docs, items, size=10):
    grams = collections.defaultdict(set)
    for item, text in items:
        ws = terms(text)
        n = min(size, len(ws))
        for i in range(len(ws) - n + 1 if ws else 0):
            grams[tuple(ws[i:i + n])].add(item)
    sizes = {len(g) for g in grams}
    out = []
    for i, t in docs:
        ws, hit, found = terms(t), set(), set()
        for n in sizes:
            for a in range(len(ws) - n + 1):
                if (g := tuple(ws[a:a + n])) in grams:
                    hit.update(range(a, a + n))
                    found |= grams[g]
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((i, len(ws), len(hit), len(ids.split(",")) if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


ITEMS = [(1, " ".join(f"Q{i}" for i in range(25))), (2, "one two three"), (20, "ONE, two three"), (3, None), (4, "?!"), (None, "solo"), (5, " ".join(f"q{i}" for i in range(3, 14)))]


def planted():
    q = [f"q{i}" for i in range(25)]
    return [(1, "clean text here"), (2, "x " + " ".join(q) + " y"), (3, "a. " + "; ".join(q[4:14]) + "\nz"), (4, " ".join(q[4:13])), (5, "One-two-three one two three four"),
            (6, None), (7, ""), (None, "and solo solo"), (8, " ".join(q[:12]) + " gap " + " ".join(q[8:])), (8, " ".join(q[:12]) + " gap " + " ".join(q[8:]))]


@pytest.mark.parametrize("items", [ITEMS, ITEMS[:1], [], [(7, "solo")]])
@pytest.mark.parametrize("sent", [10**6, 0])
def test_contamination(spark, monkeypatch, items, sent):
    monkeypatch.setattr(decontaminate, "WINDOWS_SENT", sent)
    docs = planted()
    d = spark.createDataFrame([(*x, 1, [1], "s") for x in docs], "doc_id bigint, text string, h int, entries array<int>, _ws string")
    got = decontaminate.contamination(d, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(plain_contamination(docs, items), key=str)


def test_native_plan(spark, real):
    plan = decontaminate.contamination(real, spark.read.parquet(f"{FOLDER}/benchmark.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_removal(spark, odd, none):
    b = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    d = spark.createDataFrame([(*x, None if x[1] is None else len(x[1])) for x in planted()], "doc_id bigint, text string, n_chars bigint")
    clean = decontaminate.without_contamination(d, b)
    assert clean.columns == d.columns and sorted(r.doc_id for r in clean.collect()) == [1, 4, 6, 7]
    got = collections.defaultdict(list)
    rows = decontaminate.without_contamination(d, b, spans=True).collect()
    for r in rows:
        got[r.doc_id].append(r.text)
        assert r.n_chars == (None if r.text is None else len(r.text))
    assert got == {1: ["clean text here"], 2: ["x y"], 3: ["a\nz"], 4: [planted()[3][1]], 5: [" four"], 6: [None], 7: [""], None: ["and"], 8: [" gap"] * 2}
    for table in (odd, none):
        for spans in (False, True):
            out = decontaminate.without_contamination(table, b, spans=spans)
            assert out.columns == table.columns and out.count() == table.count()
    assert decontaminate.contamination(none, b).count() == 0
