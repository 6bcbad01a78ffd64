"""Periodic runs against plain definitions."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given as drawn
from hypothesis import settings
from hypothesis import strategies as st

from boutline.llm import periodic, queries
from tests.llm.conftest import FOLDER

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_lyndon(s):
    """Longest prefix of each suffix that is smaller than all its own proper suffixes."""
    out = []
    for i in range(len(s)):
        best = 1
        for n in range(2, len(s) - i + 1):
            w = s[i:i + n]
            if all(w < w[k:] for k in range(1, n)):
                best = n
        out.append(best)
    return out


def plain_runs(s, least=24, times=3):
    """All maximal stretches with smallest period q, one period at a time."""
    found = []
    for q in range(1, len(s) // times + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            n = j - i + q
            if n >= max(least, times * q) and not any(all(s[k] == s[k + p] for k in range(i, i + n - p)) for p in range(1, q)):
                found.append((i, n, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@drawn(st.lists(st.integers(0, 2), max_size=24))
def test_lyndon_arrays(s):
    assert periodic.lyndon_array(s) == plain_lyndon(s)


@settings(max_examples=300, deadline=None)
@drawn(st.lists(st.integers(0, 3), max_size=4), st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=5), st.integers(1, 6)), max_size=4))
def test_runs(head, parts):
    s = head + [x for part, times in parts for x in part * times]
    codes = np.unique(np.array(s, np.int64), return_inverse=True)[1] if s else np.zeros(0, np.int64)
    for least in (3, 6):
        assert [tuple(r) for r in periodic.runs_of(codes, least).tolist()] == plain_runs(s, least)


def test_zones_lose_no_run():
    """Runs of many texts at once, among words of their own, each at the shortest length of its period."""
    rng = np.random.default_rng(8)
    texts = [[]]
    for q in range(1, 30):
        root, size = rng.integers(0, 50, q).tolist(), max(24, 3 * q)
        for extra in (-1, 0, 1):
            own = (root * (size // q + 2))[:size + extra]
            texts.append(list(range(1000, 1000 + q % 5)) + own + list(range(2000, 2000 + q % 3)))
    texts += [[1, 2, 3, 4] * 30, [7] * 23, [7] * 24, [5, 5, 6] * 9 + [1] + [5, 5, 6] * 9]
    per = np.cumsum([0] + [len(t) for t in texts])
    word = np.array([x for t in texts for x in t], np.uint64)
    got = periodic.batch_runs(word, per)
    assert [[tuple(r) for r in g.tolist()] for g in got] == [plain_runs(t) for t in texts]
    assert sum(map(len, got)) > 60


def wanted(doc_id, text, tamper):
    ws = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(ws)
    g = h // 10
    if tamper and doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = ws[:a] + [ws[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(ws)
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return runs, kept, (len(runs), *top, top[0] if top[0] is None else 1000 * top[1] // top[2], sha(lines), sha(kept))


FIELDS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query(spark, given):
    rows = queries.QUERIES["op11_periodic_runs"](spark, FOLDER).collect()
    assert len(rows) == len(given)
    some = [r for r in rows if len(given[r.doc_id]) < 9000]
    assert len(some) > 150 and sum(r.n_runs > 0 for r in some) > 15
    for r in some:
        assert tuple(r[f] for f in FIELDS) == wanted(r.doc_id, given[r.doc_id], True)[2], r.doc_id


def test_odd_rows(spark, odd, none):
    more = odd.select("doc_id", "text").unionByName(spark.createDataFrame(
        [(20, "x " * 40), (20, "x " * 40), (21, "a b c\n" * 9 + "tail " + "é 日 " * 15), (None, "k l " * 12), (22, "k l " * 11 + "k")], "doc_id bigint, text string"))
    rows = more.filter("coalesce(length(text), 0) < 9000").collect()
    got = periodic.periodic_runs(more.filter("coalesce(length(text), 0) < 9000")).collect()
    for r, g in zip(rows, got, strict=True):
        runs, kept, _ = wanted(r.doc_id, r.text, False)
        assert (g.doc_id, g.n_words) == (r.doc_id, len(WORD.findall(r.text or "")))
        assert list(zip(g.starts, g.lengths, g.periods)) == runs and g.collapsed == kept
    assert periodic.periodic_runs(odd).count() == odd.count()
    assert periodic.run_digests(none).count() == 0 and periodic.periodic_runs(none).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(odd, times=2)


def test_long_repetitive_text_takes_linear_time():
    import time

    rng = np.random.default_rng(1)
    for s in ([0] * 200_000, rng.integers(0, 2, 50).tolist() * 4000, list(range(200_000))):
        began = time.process_time()
        periodic.runs_of(np.array(s))
        assert time.process_time() - began < 10
