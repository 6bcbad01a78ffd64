"""Periodic runs of words: Lyndon arrays under both orders from the first phase of a suffix sorter that works by groups (Baier), whose
roots are extended into runs by longest common extensions.

A run is a maximal stretch of words with smallest period q that is at least ``max(least, 3 q)`` long. Every run has a Lyndon root in one of
the two orders of the alphabet, so a position's longest Lyndon factor, under either order, names every period worth extending.

Grouping: positions begin in groups by their word, and groups are taken from the highest to the lowest. A position of the group in hand
hands its group's context on to the nearest position before it that lies in a lower group; positions of one group that receive the same
number of contexts move to a new group just above their old one. When a group's turn comes its context is the longest Lyndon factor at its
positions, so the second phase of the sorter is not needed. Extensions are read from exact names of all stretches of 2^k words.

Only stretches whose every window of a few words occurs again in the text can hold a run (`repeated_zones`, which loses none), so ordinary
prose is left before the grouping. All repeated stretches of some texts are worked on as one sequence with separators of their own."""

import hashlib
import zlib
from collections.abc import Callable
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame

from boutline.llm.bytesops import mix, ragged, segment_hashes, text_bytes, words
from boutline.llm.common import arrow_map

LEAST, TIMES = 24, 3
PLACE = np.random.default_rng(1911).integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def lyndon_array(codes: list[int]) -> list[int]:
    """Length of the longest Lyndon factor that begins at each position; ``codes`` are 0 .. k - 1, and the end counts as smaller than all."""
    n, k = len(codes), max(codes, default=-1) + 1
    group, members = list(codes), [[] for _ in range(k)]
    for i, c in enumerate(codes):
        members[c].append(i)
    context, below = [1] * k, list(range(-1, k - 1))  # length of each group's context, and the next lower group
    above = [*range(1, k), -1]
    left = list(range(n + 1))  # of position + 1: itself while its group is to come, else where to look on for one (0: there is none)
    out = [0] * n
    g = k - 1
    while g >= 0:
        size = context[g]
        now = [i for i in members[g] if group[i] == g]
        members[g] = None
        for i in now:
            out[i] = size
            left[i + 1] = i
        counts: dict[int, int] = {}
        for i in now:
            p = i
            while left[p] != p:
                left[p] = left[left[p]]
                p = left[p]
            if p:
                counts[p - 1] = counts.get(p - 1, 0) + 1
        moved: dict[tuple[int, int], int] = {}
        for j, times in sorted(counts.items(), key=lambda x: -x[1]):  # more contexts lie higher, so they are put above the old group first
            old = group[j]
            new = moved.get((old, times))
            if new is None:
                new = moved[(old, times)] = len(context)
                context.append(context[old] + times * size)
                members.append([])
                top = above[old]
                below.append(old)
                above.append(top)
                above[old] = new
                if top >= 0:
                    below[top] = new
            group[j] = new
            members[new].append(j)
        g = below[g]
    return out


def names(codes: np.ndarray, longest: int) -> list[np.ndarray]:
    """For k = 0, 1, ... while 2^k <= longest: names of the stretches of 2^k codes from each position; equal stretches have equal names."""
    out = [codes.astype(np.int64)]
    while (1 << len(out)) <= longest:
        half = 1 << (len(out) - 1)
        last = out[-1]
        pair = last[:len(last) - half] * np.int64(2 * len(codes) + 2) + last[half:]
        out.append(np.unique(pair, return_inverse=True)[1])
    return out


def extended(levels: list[np.ndarray], one: np.ndarray, two: np.ndarray, step: int) -> np.ndarray:
    """How many codes agree from positions ``one`` < ``two`` on to the right (step 1), or before them to the left (step -1)."""
    one, two, size = one.copy(), two.copy(), np.zeros(len(one), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        name, width = levels[k], 1 << k
        a, b = (one, two) if step > 0 else (one - width, two - width)
        ok = (a >= 0) & (b < len(name))
        ok[ok] = name[a[ok]] == name[b[ok]]
        for x in (one, two):
            x[ok] += step * width
        size[ok] += width
    return size


def runs_of(codes: np.ndarray, least: int = LEAST, times: int = TIMES, separators: int = 0) -> np.ndarray:
    """Rows ``start, length, period`` of the runs of a sequence of codes 0, 1, ..., by start and period. Runs have ``times`` (3 or more)
    periods at least. The lowest ``separators`` codes occur once each, lie in no run and are the lowest under both orders."""
    n, found = len(codes), []
    if n < least:
        return np.zeros((0, 3), np.int64)
    top = int(codes.max())
    cuts = np.concatenate([[-1], np.flatnonzero(codes < separators), [n]])
    levels = names(codes, int(np.diff(cuts).max()))
    for order in (codes, np.where(codes < separators, codes, separators + top - codes)):
        period = np.array(lyndon_array(order.tolist()), np.int64)
        at = np.flatnonzero((np.arange(n) + period < n) & (codes >= separators))
        period = period[at]
        right = extended(levels, at, at + period, 1)
        before = extended(levels, at, at + period, -1)
        size = before + period + right
        ok = size >= np.maximum(least, times * period)
        found.append(np.stack([(at - before)[ok], period[ok], size[ok]], axis=1))
    return np.unique(np.concatenate(found), axis=0)[:, [0, 2, 1]]


def repeated_zones(word: np.ndarray, owner: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of ``word`` (hashes; ``owner`` is the text of each) whose every window of ``g`` words occurs twice
    or more in its text. A run of max(least, 3 q) words with period q lies in one of them: a window at i has a copy at i + q or
    i - q inside the run unless the run has less than 2 q + g - 1 words, and 3 g - 6 < least rules that out."""
    g = max(1, min(len(PLACE), (least + 5) // 3))
    m = len(word) - g + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    window = mix(sum(word[i:m + i] * PLACE[i] for i in range(g))) ^ mix(owner[:m].astype(np.uint64) + np.uint64(1))
    inside = owner[:m] == owner[g - 1:]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    twice = np.zeros(m, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    twice &= inside
    edge = np.diff(np.concatenate([[0], (twice).astype(np.int8), [0]]))
    cut = np.flatnonzero(twice[1:] & twice[:-1] & (owner[1:m] != owner[:m - 1])) + 1
    starts = np.union1d(np.flatnonzero(edge == 1), cut)
    ends = np.union1d(np.flatnonzero(edge == -1), cut) + g - 1
    long = ends - starts >= least
    return starts[long], ends[long]


def batch_runs(word: np.ndarray, per: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """Runs (see `runs_of`) of each text; ``word`` are hashes of all words of all texts, ``per`` the bounds of each text's words."""
    owner = np.repeat(np.arange(len(per) - 1), np.diff(per))
    starts, ends = repeated_zones(word, owner, least)
    if not len(starts):
        return [np.zeros((0, 3), np.int64)] * (len(per) - 1)
    sizes = ends - starts
    at = ragged(starts, sizes)
    known, code = np.unique(word[at], return_inverse=True)
    zone = np.repeat(np.arange(len(starts)), sizes)
    codes = np.zeros(len(at) + len(starts), np.int64)
    place = np.arange(len(at)) + zone  # one separator behind each zone
    codes[place] = code + len(starts)
    origin = np.zeros(len(codes), np.int64)
    origin[place] = at
    gaps = np.ones(len(codes), bool)
    gaps[place] = False
    codes[gaps] = np.arange(len(starts))[::-1]
    found = runs_of(codes, least, times, len(starts))
    start = origin[found[:, 0]]
    text = owner[start]
    found[:, 0] = start - per[text]
    bounds = np.searchsorted(text, np.arange(len(per)))
    return [found[a:b] for a, b in zip(bounds, bounds[1:])]


def best(runs: np.ndarray) -> tuple[int, int, int] | None:
    """``start, length, period`` of the run with the greatest length / period; of equal ones the first, then that of the smallest period."""
    return max((tuple(r) for r in runs.tolist()), key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a run behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def read_runs(docs: DataFrame, least: int, times: int, schema: str, row: Callable, places: Callable | None = None) -> DataFrame:
    """``row(doc_id, words, runs) -> dict`` for each row of ``docs``. ``places(doc_id, n)``, where it is not None, gives the places of the
    words to be read instead of 0 .. n - 1."""

    def run(batch):
        raw, bounds = text_bytes(batch.column("text"))
        starts, ends, per = words(raw, bounds)
        hashes, ids, whole = segment_hashes(raw, starts, ends), batch.column("doc_id").to_pylist(), raw.tobytes()
        lists = []
        for k, doc_id in enumerate(ids):
            read = whole[bounds[k]:bounds[k + 1]].split()
            at = places(doc_id, len(read)) if places and read else None
            if at is not None:
                hashes[per[k]:per[k + 1]] = hashes[per[k]:per[k + 1]][at]
                read = [read[i] for i in at.tolist()]
            lists.append(read)
        rows = [row(*x) for x in zip(ids, lists, batch_runs(hashes, per, least, times))]
        return {"doc_id": batch.column("doc_id")} | {name: [r[name] for r in rows] for name in (rows[0] if rows else names_of)}

    kind = docs.schema["doc_id"].dataType.simpleString()
    names_of = [part.split()[0] for part in schema.split(", ")]
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, {schema}")


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``doc_id, n_words, starts, lengths, periods`` (of all runs, by start and period) and ``collapsed`` (the text's words without what
    repeats: those behind the first period of a run go; joined by one space) per row of ``docs``.

    Words are maximal stretches of other characters than the six white space ones. A null or empty text has no words and no run;
    rows stand for themselves, repeated and null ids too; an empty table gives none; other columns are not read. ``times`` is 3 or more.
    A text is one task's work; its repeated stretches take about 20 bytes a word and doubling of their length."""
    if times < 3:
        raise ValueError("times must be 3 or more")

    def row(_, read, runs):
        gone = dropped(runs, len(read))
        return {"n_words": len(read), "starts": runs[:, 0].tolist(), "lengths": runs[:, 1].tolist(), "periods": runs[:, 2].tolist(),
                "collapsed": b" ".join(w for w, g in zip(read, gone.tolist()) if not g).decode()}

    return read_runs(docs, least, times, "n_words bigint, starts array<bigint>, lengths array<bigint>, periods array<bigint>, collapsed string", row)


def run_digests(docs: DataFrame, least: int = LEAST, times: int = TIMES, places: Callable | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_runs``, the run with the most periods (start, length, period, exponent_milli; null without a run), and the
    digests ``runs_sha256`` (of all runs, one line each) and ``collapsed_sha256`` (see `periodic_runs`, also for odd rows)."""

    def row(_, read, runs):
        one = best(runs)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist())
        kept = read if not len(runs) else [w for w, g in zip(read, dropped(runs, len(read)).tolist()) if not g]
        return {"n_runs": len(runs), "start": one and one[0], "length": one and one[1], "period": one and one[2], "exponent_milli": one and 1000 * one[1] // one[2],
                "runs_sha256": hashlib.sha256(lines.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(b" ".join(kept)).hexdigest()}

    return read_runs(docs, least, times, "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string", row, places)


def planted_places(doc_id: int | None, n: int) -> np.ndarray | None:
    """For every tenth document by crc32 of its id: places that make its words periodic from some word on (contract of the query)."""
    h = 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is None or h % 10:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at
