"""Packing of tokenized documents into sequences of a fixed length by cutting-stock column generation.

Documents are cut into pieces of at most LENGTH tokens. The histogram of piece lengths, in classes of GRAIN tokens rounded up, has
LENGTH / GRAIN counts whatever the size of the table, so it may be solved on the driver: a linear program chooses how often to
use each pattern (how many pieces of each class share a sequence), starting from patterns of one class; a knapsack dynamic
program over the program's dual prices finds the pattern that would save most, until none saves more than the share TOLERANCE
of a sequence, or all sequences together are within TOLERANCE of the sum of the pieces. Counts of
patterns are rounded down, and what is left over, a few sequences a class, is filled largest piece first. Pieces are ranked
within their class by (doc_id, start); rank and pattern counts give each piece its sequence, so placing needs no search."""

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boutline.llm.bytesops import text_bytes
from boutline.llm.common import arrow_map, numbered, staged
from boutline.llm.units import library

LENGTH, GRAIN, TOLERANCE = 4096, 8, 1e-3
STEPS_EACH = 8  # steps of the program a class at most; what it leaves undone is filled as leftovers


def pieces_of(docs: DataFrame, vocabulary: str, end_id: int, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` (and ``ids``) of every piece: each text's ids (null: none) and ``end_id``,
    cut every ``length`` ids."""

    def run(batch):
        flat, bounds = library(vocabulary, False).ids(*text_bytes(batch.column("text")))
        ids = np.insert(flat, bounds[1:], end_id).astype("<u4")
        size = np.diff(bounds) + 1
        n = -(-size // length)
        doc = np.repeat(np.arange(len(size)), n)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * length
        took = np.minimum(size[doc] - start, length)
        at = (np.cumsum(size) - size)[doc] + start
        data = memoryview(ids.tobytes())
        out = {"doc_id": batch.column("doc_id").take(doc), "start": start, "length": took, "doc_tokens": size[doc],
               "ids_crc32": [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(at.tolist(), (at + took).tolist())]}
        return out | ({"ids": [ids[a:b].tolist() for a, b in zip(at.tolist(), (at + took).tolist())]} if with_ids else {})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + (", ids array<bigint>" if with_ids else ""))


def best_pattern(prices: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The dearest pattern that fits: unbounded knapsack over ``room`` units."""
    value, took = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(sizes, np.arange(room + 1), side="right").tolist()
    for w in range(1, room + 1):
        fit = fits[w]
        value[w] = value[w - 1]
        if fit:
            worth = value[w - sizes[:fit]] + prices[:fit]
            k = int(worth.argmax())
            if worth[k] > value[w] + 1e-12:
                value[w], took[w] = worth[k], k
    pattern, w = np.zeros(len(sizes), np.int64), room
    while w > 0:
        if took[w] < 0:
            w -= 1
        else:
            pattern[took[w]] += 1
            w -= sizes[took[w]]
    return float(value[room]), pattern


def patterns(sizes: np.ndarray, counts: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often to use each, so that every piece has a place. ``sizes`` ascending, in units of the room."""
    m = len(sizes)
    if m == 0:
        return []
    columns = [np.eye(m, dtype=np.int64)[i] * (room // sizes[i]) for i in range(m)]
    inverse = np.diag(1.0 / (room // sizes))
    amount = counts / (room // sizes)
    least = (sizes @ counts) / room * (1 + TOLERANCE)  # no packing needs less than the sum of the sizes
    for step in range(STEPS_EACH * m):
        worth, column = best_pattern(np.maximum(inverse.sum(0), 0.0), sizes, room)
        if worth <= 1 + TOLERANCE or amount.sum() <= least:
            break
        part = np.flatnonzero(column)
        turn = (inverse[:, part] * column[part]).sum(1)
        ratio = np.where(turn > 1e-9, amount / np.where(turn > 1e-9, turn, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        amount = np.maximum(amount - ratio[out] * turn, 0.0)
        amount[out] = ratio[out]
        row = inverse[out] / turn[out]
        inverse -= turn[:, None] * row
        inverse[out] = row
        columns[out] = column
    left, used = counts.astype(np.int64).copy(), []
    for column, x in sorted(zip(columns, amount), key=lambda c: -c[1]):
        filled = column > 0
        times = min(int(x + 1e-6), int((left[filled] // column[filled]).min()))
        if times > 0:
            used.append((column, times))
            left -= column * times
    while left.any():
        column, free, i = np.zeros(m, np.int64), room, m - 1
        while free > 0 and i >= 0:
            column[i] = min(left[i], free // sizes[i])
            free -= column[i] * sizes[i]
            i -= 1
        filled = column > 0
        times = int((left[filled] // column[filled]).min())
        used.append((column, times))
        left -= column * times
    return used


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` per piece; see the module.

    A null text has the end id alone; an empty table gives no pieces; repeated rows are packed each for itself; other columns are not read."""
    cut = staged(pieces_of(docs, vocabulary, end_id, length), "pieces").withColumn("_class", F.ceil(F.col("length") / grain).cast("int"))
    histogram = sorted((r["_class"], r["count"]) for r in cut.groupBy("_class").count().collect())  # length / grain rows at most
    sizes, counts = (np.array([h[i] for h in histogram], np.int64) for i in (0, 1))
    class_base = np.cumsum(counts) - counts
    used = patterns(sizes, counts, length // grain)
    first = np.cumsum([0, *[t for _, t in used]])
    taken, slots = np.zeros(len(sizes), np.int64), []
    for (column, times), base in zip(used, first):
        for i in np.flatnonzero(column).tolist():
            slots.append((class_base[i] + taken[i], base, column[i], int(sizes[i])))
            taken[i] += column[i] * times
    slots.sort()
    lows, bases, shares, classes = (np.array([s[i] for s in slots], np.int64) for i in range(4))
    ranked = numbered(cut, ["_class", "doc_id", "start", "ids_crc32"], "ranked")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(batch):
        row = batch.column("_row").to_numpy()
        k = np.searchsorted(lows, row, side="right") - 1
        at = row - lows[k]
        return {n: batch.column(n) for n in names} | {"sequence_id": bases[k] + at // shares[k], "_order": -classes[k] * (length + 1) + at % shares[k]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, _order bigint"
    placed = arrow_map(ranked, place, schema, text=None)
    before = Window.partitionBy("sequence_id").orderBy("_order", "doc_id", "start").rowsBetween(Window.unboundedPreceding, -1)  # at most length pieces
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint")).drop("_order")


def sequences(docs: DataFrame, placed: DataFrame, vocabulary: str, end_id: int = 2, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """``sequence_id, ids``: the token ids of each sequence, padded to ``length`` unless their number is a power of two. Needs
    doc_id to be a key of ``docs``."""
    parts = pieces_of(docs, vocabulary, end_id, length, with_ids=True).select("doc_id", "start", "ids")
    joined = placed.join(parts, ["doc_id", "start"]).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.flatten(F.col("p.ids"))
    n = F.size(ids)
    fill = F.when(F.bit_count(n) == 1, 0).otherwise(F.lit(length) - n)
    return joined.select("sequence_id", F.concat(ids, F.array_repeat(F.lit(pad_id).cast("bigint"), fill)).alias("ids"))
