"""Ranked lexical search by the Best Position Algorithm over impact lists.

An impact is what a term adds to a document's score; a term's impact list holds its documents by falling impact. For an item, the lists of
its terms are read from the top in step (sorted access). A document met for the first time is looked up in all lists at once (direct
access), which gives its whole score and its place in each list. A list's best position is the end of the stretch, from the top, whose
every place has been seen by either access; no document that was not met yet can have more there than the entry behind it. When these
bounds add up to strictly less than the k-th best score so far, the search stops: a document with an equal score could still win its tie.

The index is divided by documents: tasks read the postings of the query's terms (document, term, number of occurrences) and cut them into
shards of SHARD postings; each shard has its own impact lists, and the threshold carries over from shard to shard of a task. A task returns the
best k of each item, and the best k of those are the result, which is exact. Statistics (documents, words, documents a term) come first,
over all documents. Queries are taken in turns of ITEMS items; only a turn's terms and weights are sent to the tasks."""

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boutline.llm.bytesops import LOWER, Codes, ragged, segment_hashes, text_bytes
from boutline.llm.common import arrow_map, staged

K = 50
ITEMS = 5_000
SHARD = 2_000_000
STEP = 64  # entries read from each list in the first step; each further step reads twice as many
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
INSIDE = np.ones(256, bool)
INSIDE[[b for b in range(128) if not TERM.match(bytes([b]))]] = False
LOWER_BYTES = bytes(LOWER.tolist())


def item_terms(text: str | None) -> list[bytes]:
    return sorted(set(TERM.findall((text or "").encode().translate(LOWER_BYTES))))


def term_hashes(terms: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(terms), np.uint8)
    ends = np.cumsum([len(t) for t in terms], dtype=np.int64)
    return segment_hashes(raw, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if terms else np.zeros(0, np.uint64)


def postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n`` (its terms with repeats) and, of the query's ``terms`` it holds, ``terms`` (their numbers) and ``tf``."""
    hashes = term_hashes(terms)
    if len(set(hashes.tolist())) < len(terms):
        raise ValueError("two terms of the queries share a 64-bit hash")
    spelling, sizes = np.frombuffer(b"".join(terms), np.uint8), np.array([len(t) for t in terms], np.int64)
    begins = np.cumsum(sizes) - sizes
    held: list[Codes] = []

    def run(batch):
        if not held:
            held.append(Codes())
            held[0].add(hashes)
        raw, bounds = text_bytes(batch.column("text"))
        raw = LOWER[raw]
        seen = INSIDE[raw] if len(raw) else np.zeros(0, bool)
        first = np.zeros(len(raw), bool)
        first[bounds[:-1][bounds[:-1] < len(raw)]] = True
        starts = np.flatnonzero(seen & (first | ~np.concatenate([[False], seen[:-1]])[:len(raw)]))
        stops = np.flatnonzero(seen & ~np.concatenate([seen[1:] & ~first[1:], [False]])[:len(raw)]) + 1
        per = np.searchsorted(starts, bounds)
        code = held[0].find(segment_hashes(raw, starts, stops)).astype(np.int64)
        hit = np.flatnonzero(code >= 0)
        hit = hit[stops[hit] - starts[hit] == sizes[code[hit]]]
        if len(hit):  # a hash may lie, bytes do not
            size = sizes[code[hit]]
            same = raw[ragged(starts[hit], size)] == spelling[ragged(begins[code[hit]], size)]
            hit = hit[np.logical_and.reduceat(same, np.cumsum(size) - size)]
        owner = np.searchsorted(per, hit, side="right") - 1
        pair, tf = np.unique(owner * len(terms) + code[hit], return_counts=True)
        cut = np.searchsorted(pair, np.arange(batch.num_rows + 1) * len(terms)).astype(np.int32)
        number = (pair % max(len(terms), 1)).astype(np.int32)
        return {"doc_id": batch.column("doc_id"), "n": np.diff(per), "terms": pa.ListArray.from_arrays(pa.array(cut), pa.array(number)),
                "tf": pa.ListArray.from_arrays(pa.array(cut), pa.array(tf.astype(np.int32)))}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, n bigint, terms array<int>, tf array<int>")


class Shard:
    """Impact lists of some documents: entries by term, falling impact and document; and for each document its entries' places."""

    def __init__(self, term: np.ndarray, impact: np.ndarray, cut: np.ndarray, n_terms: int):
        doc = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], impact[order]  # by list place
        self.lists = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.cut, self.term, self.own = cut, term, impact  # by document
        self.at = np.empty(len(order), np.int64)
        self.at[order] = np.arange(len(order))

    def best(self, terms: np.ndarray, slot: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores of those that may be among the best k of ``terms``, if their scores are ``floor`` or more, and the number
        of documents that were looked up. ``slot`` is a scratch array over all terms, -1 throughout."""
        start, end = self.lists[terms], self.lists[terms + 1]
        live = end > start
        terms, start, end = terms[live], start[live], end[live]
        slot[terms] = np.arange(len(terms))
        met, place_seen = np.zeros(len(self.cut) - 1, bool), np.zeros(len(self.doc), bool)
        upto, front = start.copy(), start.copy()  # read by sorted access; first place not yet seen by either
        docs, scores, step, looked = [], [], STEP, 0
        while len(terms):
            read = np.concatenate([np.arange(a, min(a + step, e)) for a, e in zip(upto.tolist(), end.tolist())])
            upto, step = np.minimum(upto + step, end), step * 2
            place_seen[read] = True
            new = np.unique(self.doc[read])
            new = new[~met[new]]
            met[new] = True
            looked += len(new)
            if len(new):
                size = self.cut[new + 1] - self.cut[new]
                entry = np.repeat(self.cut[new] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                which = slot[self.term[entry]]
                ok = which >= 0
                place_seen[self.at[entry[ok]]] = True
                total = np.zeros(len(new), np.int64)
                np.add.at(total, np.repeat(np.arange(len(new)), size)[ok], self.own[entry[ok]])
                docs.append(new)
                scores.append(total)
                if len(docs) > 1:
                    docs, scores = [np.concatenate(docs)], [np.concatenate(scores)]
            bound = 0
            for i, (a, e) in enumerate(zip(front.tolist(), end.tolist())):
                if a < e:
                    rest = place_seen[a:e]
                    gap = int(rest.argmin())
                    front[i] = a = e if rest[gap] else a + gap
                if a < e:
                    bound += int(self.impact[a])
            every = scores[0] if scores else np.zeros(0, np.int64)
            kth = max(floor, int(np.partition(every, len(every) - k)[len(every) - k]) if len(every) >= k else 0)
            if bound < kth or (upto == end).all():
                break
        slot[terms] = -1
        if not docs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), looked
        ok = (scores[0] >= max(floor, 1)) & (scores[0] >= (kth if len(scores[0]) >= k else 1))
        return docs[0][ok], scores[0][ok], looked


def impacts(term: np.ndarray, tf: np.ndarray, n: np.ndarray, weights: np.ndarray, documents: int, total: int) -> np.ndarray:
    m = 50 + (50 * n * documents) // total
    return weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def ranked_in_tasks(index: DataFrame, queries: list[np.ndarray], weights: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """The best k (``item, doc_id, score``) of each query among the rows of ``index`` that a task holds."""

    def shards(batches) -> Iterator[tuple]:
        held, size = [], 0
        for batch in batches:
            batch = batch.filter(pa.compute.is_valid(batch.column("doc_id")))
            lists = batch.column("terms")
            held.append((batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("n").to_numpy(), np.asarray(lists.flatten()).astype(np.int64),
                         np.asarray(batch.column("tf").flatten()).astype(np.int64), np.asarray(lists.value_lengths()).astype(np.int64)))
            size += len(held[-1][2])
            if size >= SHARD:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, size = [], 0
        if held:
            yield tuple(np.concatenate(x) for x in zip(*held))

    def run(batches):
        slot, tops = np.full(len(weights), -1), {}
        for doc_id, n, term, tf, size in shards(batches):
            cut = np.concatenate([[0], np.cumsum(size)])
            shard = Shard(term, impacts(term, tf, np.repeat(n, size), weights, documents, total), cut, len(weights))
            for item, terms in enumerate(queries):
                ids, scores = tops.get(item, (doc_id[:0], np.zeros(0, np.int64)))
                floor = int(scores.min()) if len(scores) >= k else 0
                docs, more, _ = shard.best(terms, slot, k, floor)
                ids, scores = np.concatenate([ids, doc_id[docs]]), np.concatenate([scores, more])
                order = np.lexsort((ids, -scores))[:k]
                tops[item] = ids[order], scores[order]
        for item, (ids, scores) in tops.items():
            if len(ids):
                yield pa.RecordBatch.from_pydict({"item": pa.array(np.full(len(ids), item, np.int32)), "doc_id": pa.array(ids, pa.int64()), "score": pa.array(scores)})

    return index.select("doc_id", "n", "terms", "tf").mapInArrow(run, "item int, doc_id bigint, score bigint")


def turns(items: DataFrame, size: int) -> Iterator[list]:
    """Rows of ``items`` in lists of ``size``; one list at a time is on the driver."""
    held = []
    for row in items.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each row of ``items`` (item_id, text) the k best documents with a score above 0.

    Terms are maximal stretches of digits, letters and characters beyond ASCII; A-Z are lower-cased. A term's weight is
    floor(1000 ln((2 N + 2) / (2 df + 1))), a document's length measure m = 50 + (50 n N) div L, its score the sum of
    weight * ((10^9 tf) div (1000 tf + 20 m)) over the item's terms, once each; equal scores by ascending doc_id, from rank 1.
    N counts documents with a term, L all terms; 50 n N must stay below 2^63.

    A null text has no terms; an item without terms finds nothing; repeated items and documents stand for themselves. A document without
    doc_id counts in the statistics and is never returned. Empty tables give none; other columns are not read. doc_id is an integer."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = []
    for some in turns(items.select("item_id", "text"), ITEMS):
        wanted = [item_terms(r["text"]) for r in some]
        terms = sorted(set().union(*wanted))
        number = {t: i for i, t in enumerate(terms)}
        index = staged(postings(rows, terms), "postings")
        stats = index.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("total")).first()
        documents, total = stats["documents"], stats["total"] or 1
        df = np.zeros(len(terms), np.int64)
        for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():  # one row a term of the turn
            df[r["t"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        queries = [np.array([number[t] for t in ts if weights[number[t]] > 0], np.int64) for ts in wanted]
        best = staged(ranked_in_tasks(index, queries, weights, documents, total, k), "best")
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
        top = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        ids = docs.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(some)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        out.append(top.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"))
    if out:
        return reduce(DataFrame.unionByName, out)
    kind = items.schema["item_id"].dataType.simpleString()
    return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")


# The same rows in SQL (DuckDB)
SEARCH = r"""
WITH d AS (SELECT doc_id, unnest(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')) AS term FROM benchmark),
t AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
s AS (SELECT count(DISTINCT doc_id) AS big_n, count(*) AS big_l FROM d),
n AS (SELECT doc_id, 50 + (50 * count(*) * any_value(big_n)) // any_value(big_l) AS m FROM d, s GROUP BY doc_id),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM t, s WHERE term IN (SELECT term FROM q) GROUP BY term),
r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN t USING (term) JOIN n USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 50
"""
