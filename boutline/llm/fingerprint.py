"""Document fingerprints by locally consistent parsing.

A text is a row of symbols (its UTF-8 bytes at first). At each level runs of one symbol become one symbol, then deterministic coin
tossing labels every symbol by the lowest bit in which it differs from its left neighbour, ROUNDS times over, until labels are below
eight; symbols whose label is a local maximum open phrases. Phrases have two to some fifteen symbols, and a border depends on a few
neighbours only, so equal substrings are cut alike inside wherever they stand. A phrase's name is a hash of its symbols; the
names are the symbols of the next level.

The fingerprint is a signature of SLOTS minimum hashes over a text's phrase names at LEVELS (about ten and thirty bytes long, the
repeats of a name counted as names of their own), and over the names or bytes at a lower level of a text that has FEW or less
of them there. The share of equal slots estimates how many names two texts have in common."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.llm.bytesops import BYTE_VALUE, mix, text_bytes
from boutline.llm.common import numbered, pieces

ROUNDS, LEVELS, SLOTS, FEW = 3, (2, 3), 64, 16
FACTORS = np.random.default_rng(41).integers(1, 2**63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
EMPTY = "-" * (4 * SLOTS)
BUCKETS_EACH = 4


def phrases(symbol: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of the phrases of all texts (``text``: the text of each symbol, ascending)."""
    n = len(symbol)
    if n == 0:
        return symbol, text
    first = np.ones(n, bool)
    first[1:] = text[1:] != text[:-1]
    start = first.copy()
    start[1:] |= symbol[1:] != symbol[:-1]
    at = np.flatnonzero(start)
    run = np.diff(np.append(at, n)).astype(np.uint64)
    symbol, text, first = symbol[at], text[at], first[at]
    symbol = np.where(run > 1, mix(symbol + mix(run)), symbol)
    n = len(symbol)
    label = symbol
    for _ in range(ROUNDS):
        left = np.concatenate([label[:1], label[:-1]])
        low = np.bitwise_count(((label ^ left) & (~(label ^ left) + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
        low[first] = 0  # no left neighbour
        label = np.uint64(2) * low + ((label >> low) & np.uint64(1))
    label = label.astype(np.int64)
    last = np.append(first[1:], True)
    before = np.where(first, -1, np.concatenate([[-1], label[:-1]]))
    after = np.where(last, -1, np.append(label[1:], -1))
    opens = first | ((label > before) & (label > after) & ~last)
    at = np.flatnonzero(opens)
    place = (np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))).astype(np.uint64)
    return mix(np.add.reduceat(mix(symbol + place * np.uint64(0x9E3779B97F4A7C15)), at)), text[at]


def signatures(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SLOTS 16-bit values for each text; -1 for a text without bytes."""
    rows = len(bounds) - 1
    out = np.full((rows, SLOTS), -1, np.int32)
    symbol, text = BYTE_VALUE[raw], np.repeat(np.arange(rows), np.diff(bounds))
    kept = []
    for level in range(max(LEVELS) + 1):
        if level:
            symbol, text = phrases(symbol, text)
        few = slice(None) if level in LEVELS else (np.bincount(text, minlength=rows) <= FEW)[text]
        kept.append((text[few], symbol[few] + np.uint64(level)))
    text, name = (np.concatenate([k[i] for k in kept]) for i in (0, 1))
    if not len(text):
        return out
    order = np.lexsort((name, text))
    text, name = text[order], name[order]
    fresh = np.concatenate([[True], (name[1:] != name[:-1]) | (text[1:] != text[:-1])])
    group = np.flatnonzero(fresh)
    again = np.arange(len(name)) - np.repeat(group, np.diff(np.append(group, len(name))))
    name = mix(name + again.astype(np.uint64))  # the second, third, ... of a repeated phrase counts as one of its own
    at = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    for i, f in enumerate(FACTORS):
        h = name * f
        least = mix(np.minimum.reduceat(h ^ (h >> np.uint64(31)), at))
        out[text[at], i] = (least & np.uint64(0xFFFF)).astype(np.int32)
    return out


def spelled(signature: np.ndarray) -> list[str]:
    return [EMPTY if row[0] < 0 else row.astype(">u2").tobytes().hex() for row in signature]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of phrases that two texts have in common, 2 j / (1 + j) for a share j of equal slots."""
    same = (a == b).mean(1)
    return 2 * same / (1 + same)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` per row; a null text counts as empty, and all empty texts have the fingerprint EMPTY."""
    from boutline.llm.common import arrow_map

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), lambda b: {"doc_id": b.column("doc_id"), "fingerprint": spelled(signatures(*text_bytes(b.column("text"))))}, f"doc_id {kind}, fingerprint string")


def edited(text: str, after: str) -> str:
    """``text`` with its last third of code points replaced by as many of the start of ``after``, or all of it."""
    k = len(text) // 3
    return text[:len(text) - k] + after[:k]


def with_next(docs: DataFrame) -> DataFrame:
    """Rows ``doc_id, text, _bucket, _own`` so dealt and sorted that each own row follows, in its partition, the next document in
    descending doc_id order (the first of all for the last).

    Ids are numbered and cut into buckets; the last row of each bucket goes to the next one too, as a guest. Only split points and
    guests, one a bucket, pass through the driver; texts are shuffled once."""
    spark = docs.sparkSession
    text = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = numbered(docs.select("doc_id").distinct(), ["doc_id"], "ids")
    n = ids.count()
    size = max(1, -(-n // (parts * BUCKETS_EACH)))
    edge = ids.filter((F.col("_row") % size == 0) | (F.col("_row") % size == size - 1) | (F.col("_row") == n - 1)).collect()
    splits = sorted(r["doc_id"] for r in edge if r["_row"] % size == 0 and r["_row"] and r["doc_id"] is not None)
    guests = [(r["doc_id"], r["_row"] // size + 1) for r in edge if r["_row"] % size == size - 1 and r["_row"] != n - 1]
    guests += [(r["doc_id"], 0) for r in edge if r["_row"] == n - 1]
    kind = docs.schema["doc_id"].dataType.simpleString()
    small = spark.createDataFrame(guests, f"_id {kind}, _bucket int")  # one row a bucket
    own = text.withColumn("_bucket", F.coalesce(bucket_of(splits, kind), F.lit(0))).withColumn("_own", F.lit(True))
    visiting = text.join(F.broadcast(small), F.col("doc_id").eqNullSafe(F.col("_id")))
    visiting = visiting.groupBy("_bucket").agg(F.max(F.struct("doc_id", "text")).alias("r")).select("r.doc_id", "r.text", "_bucket", F.lit(False).alias("_own"))
    return own.unionByName(visiting).repartition(parts, "_bucket").sortWithinPartitions("_bucket", "_own", "doc_id", "text")


def bucket_of(splits: list, kind: str):
    """How many split points are at most doc_id: first among every w-th, then within one stretch of w."""
    if not splits:
        return F.lit(0)
    w = max(1, int(len(splits) ** 0.5))
    every = F.lit(splits).cast(f"array<{kind}>")
    coarse = F.lit(splits[::w]).cast(f"array<{kind}>")
    first = F.size(F.filter(coarse, lambda s: s <= F.col("doc_id")))
    inside = F.filter(F.slice(every, (F.greatest(first, F.lit(1)) - 1) * w + 1, w), lambda s: s <= F.col("doc_id"))
    return F.when(F.col("doc_id").isNull(), 0).otherwise(F.greatest(first - 1, F.lit(0)) * w + F.size(inside)).cast("int")


def compare_edits(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` per row of ``docs``; whole texts.

    The next document is the next in descending doc_id order, after the last the first; rows of one doc_id are ordered by text, a null id
    comes last, and a single row is its own next. Null texts are empty; an empty table gives nothing; other columns are not read."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")

    def run(batches):
        held = None  # the row before: text and signature
        for batch in batches:
            for some in pieces(batch):
                texts, own = some.column("text").to_pylist(), np.array(some.column("_own").to_pylist())
                mine = signatures(*text_bytes(some.column("text")))
                if held is None:
                    held = texts[0], mine[0]
                nexts, their = [held[0], *texts[:-1]], np.vstack([held[1][None], mine[:-1]])
                held = texts[-1], mine[-1]
                new = [edited(t, x) for t, x in zip(texts, nexts)]
                theirs = signatures(*text_bytes(pa.array(new, pa.large_string())))
                out = {
                    "doc_id": some.column("doc_id"), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                    "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]),
                    "fingerprint": pa.array(spelled(mine)), "edited_fingerprint": pa.array(spelled(theirs)),
                    "near_edited": pa.array(likeness(mine, theirs)), "near_next": pa.array(likeness(mine, their)),
                }
                yield pa.RecordBatch.from_pydict({n: out[n] for n in names}).filter(pa.array(own))

    schema = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(run, schema)
