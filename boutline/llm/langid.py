"""Language identification by language-bitmask n-gram filters.

One Bloom filter per language is kept bit-sliced: slot s of the table is a word whose bit l says whether slot s is set in the filter
of language l; where there are more than 64 languages there is a table for each 64 of them. The SLOTS_EACH slots of an n-gram, joined by AND, so give all languages that contain it in one look-up. A text's n-grams are
counted by language (a popcount per bit), the share that the filters answer by chance is taken out of each count, and
the language with the largest corrected count is the text's.

n-grams are ORDERS bytes of lower-cased UTF-8, with all signs that are no letters made spaces and spaces put around the text. A
language contains an n-gram if it has it LEAST times or more and at a rate of at least NEAR times that of any other language. Filters are fitted on
at most about ``per_lang`` labelled rows a language (a sample by hash of doc_id, so the model and its fitting are bounded);
a table has 2**BITS slots, which bounds what is collected and sent to the tasks (8 MB for each 64 languages)."""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutline.llm.bytesops import mix, text_bytes
from boutline.llm.common import arrow_map, staged

ORDERS, SLOTS_EACH, BITS = (3, 5), 3, 20
LEAST, NEAR, PER_LANG = 3, 0.5, 4000
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")  # letters, and a few other signs
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[[b for b in range(128) if not chr(b).isalpha()]] = 32


def lettered(text: str | None) -> bool:
    return text is not None and any(m[0].isalpha() for m in LETTER.finditer(text))


def grams(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts as 64-bit hashes, and the text of each. Windows without a letter, or over two spaces in a row, do not count."""
    space, none = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
    col = pc.binary_join_element_wise(space, pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), space, none)
    raw, bounds = text_bytes(col)
    raw = PLAIN[raw]
    n = len(raw) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.full(n, order, np.uint64)
    for i in range(order):
        value = (value << np.uint64(8)) | raw[i:n + i]
    gap = np.concatenate([[0], np.cumsum((raw[:-1] == 32) & (raw[1:] == 32))])
    # two texts meet in two spaces, so no window that counts reaches over their border
    at = np.flatnonzero(gap[order - 1:] == gap[:n])
    return mix(value[at]), np.searchsorted(bounds, at, side="right") - 1


def slots(h: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    step, mask = (h >> np.uint64(32)) | np.uint64(1), np.uint64((1 << bits) - 1)
    return [((h + np.uint64(i) * step) & mask).astype(np.int64) for i in range(SLOTS_EACH)]


class Model:
    """Languages, the bit-sliced tables (one for each 64 languages), and the chance that each language's filter answers for an n-gram it does not hold."""

    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs, self.tables = langs, np.atleast_2d(table)
        fill = np.array([np.count_nonzero(self.tables[i // 64] & np.uint64(1 << i % 64)) / max(1, self.tables.shape[1]) for i in range(len(langs))])
        self.chance = np.minimum(fill ** SLOTS_EACH, 0.99)

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of each text, and how many of them each language contains, corrected for chance."""
        rows, many = len(texts), len(self.langs)
        hits, total = np.zeros((rows, many)), np.zeros(rows)
        for order in ORDERS:
            h, doc = grams(texts, order)
            total += np.bincount(doc, minlength=rows)
            at = slots(h)
            for first in range(0, many, 64):
                found = np.full(len(h), 2**64 - 1, np.uint64)
                for one in at:
                    found &= self.tables[first // 64][one]
                for low in range(0, min(64, many - first), 8):  # eight languages at a time: a histogram of their masks for each text
                    part = ((found >> np.uint64(low)) & np.uint64(255)).astype(np.int64)
                    bins = np.bincount(doc * 256 + part, minlength=rows * 256).reshape(rows, 256)
                    width = min(8, many - first - low)
                    hits[:, first + low:first + low + width] += bins @ ((np.arange(256)[:, None] >> np.arange(width)) & 1)
        return total, np.maximum(0.0, (hits - total[:, None] * self.chance) / (1 - self.chance))

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        total, counts = self.counts(texts)
        best = counts.argmax(1)
        score = np.minimum(1.0, counts[np.arange(len(best)), best] / np.maximum(total, 1))
        told = [lettered(t) for t in texts.to_pylist()]
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), told)], np.where(told, score, 0.0).tolist()


def fit(docs: DataFrame, use: Column, per_lang: int = PER_LANG) -> Model:
    """Filters from ``text`` and ``lang`` of rows that meet ``use``, where neither is null."""
    known = docs.filter(use & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(sizes, key=lambda name: (-sizes[name], name))  # of equal counts the commonest language wins
    if not langs:
        return Model([], np.zeros(1, np.uint64))
    spark = docs.sparkSession
    kind = known.schema["lang"].dataType.simpleString()
    named = spark.createDataFrame([(name, i, min(1.0, per_lang / sizes[name])) for i, name in enumerate(langs)], f"lang {kind}, l int, _share double")
    luck = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1_000_003)) / 1_000_003
    sample = known.select("doc_id", "lang", "text").join(F.broadcast(named), "lang").filter(luck < F.col("_share")).select("text", "l")

    def count(batch):
        lang = batch.column("l").to_numpy()
        out = {"l": [], "n": [], "h": [], "k": []}
        for order in ORDERS:
            h, doc = grams(batch.column("text"), order)
            for one in np.unique(lang):
                value, k = np.unique(h[lang[doc] == one], return_counts=True)
                for name, v in (("l", np.full(len(k), one)), ("n", np.full(len(k), order)), ("h", value.view(np.int64)), ("k", k)):
                    out[name].append(v)
        return {name: np.concatenate(v) if v else [] for name, v in out.items()}

    found = arrow_map(sample, count, "l int, n int, h bigint, k bigint").groupBy("l", "n", "h").agg(F.sum("k").alias("k"))
    totals = arrow_map(sample, lambda b: _totals(b), "l int, n int, k bigint").groupBy("l", "n").agg(F.sum("k").alias("k")).collect()
    total = spark.createDataFrame([(r["l"], r["n"], float(r["k"])) for r in totals], "l int, n int, _all double")
    rates = found.join(F.broadcast(total), ["l", "n"]).withColumn("r", F.col("k") / F.col("_all"))
    rated = rates.groupBy("n", "h").agg(F.collect_list(F.struct("l", "k", "r")).alias("c"))  # a language each at most
    top = F.array_max(F.transform("c", lambda c: c["r"]))
    mine = F.filter("c", lambda c: (c["k"] >= LEAST) & (c["r"] >= NEAR * F.col("top")))
    held = rated.select("h", "c", top.alias("top")).select("h", mine.alias("c"))
    held = held.select("h", "c", F.explode(F.array_distinct(F.transform("c", lambda c: F.floor(c["l"] / 64).cast("int")))).alias("word"))
    ours = F.filter("c", lambda c: F.floor(c["l"] / 64) == F.col("word"))
    masks = held.select("h", "word", F.aggregate(ours, F.lit(0).cast("bigint"), lambda a, c: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), c["l"] % 64))).alias("mask"))

    def spread(batch):
        h = batch.column("h").to_numpy().view(np.uint64)
        return {"word": np.tile(batch.column("word").to_numpy(), SLOTS_EACH), "slot": np.concatenate(slots(h)), "mask": np.tile(batch.column("mask").to_numpy(), SLOTS_EACH)}

    words = -(-len(langs) // 64)
    rows = arrow_map(masks, spread, "word int, slot bigint, mask bigint", text=None).groupBy("word", "slot").agg(F.bit_or("mask").alias("mask"))
    rows = staged(rows, "masks") if words > 1 else rows
    table = np.zeros((words, 1 << BITS), np.uint64)
    for word in range(words):  # 2**BITS rows at most at a time
        some = rows.filter(F.col("word") == word).toArrow()
        table[word, some.column("slot").to_numpy()] = some.column("mask").to_numpy().view(np.uint64)
    return Model(langs, table)


def _totals(batch):
    lang = batch.column("l").to_numpy()
    out = [(int(one), order, int(np.count_nonzero(lang[doc] == one))) for order in ORDERS for _, doc in [grams(batch.column("text"), order)] for one in np.unique(lang)]
    return {name: [r[i] for r in out] for i, name in enumerate(("l", "n", "k"))}


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` per row of ``docs``. score: the share of the text's n-grams that the language contains. A text that
    is null or has no letter is ``und`` with score 0, as is every text if no language was learned. Whole texts; repeated rows give repeated
    results, an empty table none; other columns are not read."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        lang, score = held.value.predict(batch.column("text"))
        return {"doc_id": batch.column("doc_id"), "lang_pred": lang, "score": score}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language with a score of ``least`` or more; if no language was learned, those
    whose text has a letter."""
    held, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batch):
        if held.value.langs:
            keep = [name != UNKNOWN and s >= least for name, s in zip(*held.value.predict(batch.column("text")))]
        else:
            keep = [lettered(t) for t in batch.column("text").to_pylist()]
        some = batch.filter(pa.array(keep, pa.bool_()))
        return {name: some.column(i) for i, name in enumerate(names)}

    return arrow_map(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))
