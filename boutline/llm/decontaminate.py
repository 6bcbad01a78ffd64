"""Benchmark decontamination, in DataFrame functions only: a broadcast hash set of the benchmark's normalised n-grams meets every window of
words of the documents; hits are verified word by word, and hit spans or whole documents can be removed.

Texts are lower-cased (A-Z) and cut into words (digits, letters and everything beyond ASCII). A window is ``size`` consecutive words of an
item; an item of fewer words, but not none, is one window. The set has one row a distinct window and is broadcast if it holds WINDOWS_SENT
pairs of window and item at most; a larger one is joined by a shuffle. Documents are read once: every window is looked up where it is read, and what is
shuffled is one row a document and one a hit."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutline.llm.common import skew_join, staged

SIZE = 10
WINDOWS_SENT = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BETWEEN), "")


def window_hash(words: Column, at: Column, size: int) -> Column:
    """A 64-bit hash of ``size`` words from place ``at`` on."""
    return F.xxhash64(*[F.get(words, at + k) for k in range(size)])


def spelled(words: Column, at: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, at + 1, size), " ")


def windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """``h, n`` (size), ``pairs`` and ``entries`` (window, its items) of each hash of the distinct windows of ``benchmark`` (item_id, text)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(lowered(F.col("text"))).alias("ws")).filter(F.size("ws") > 0)
    items = items.withColumn("n", F.least(F.size("ws"), F.lit(size)))
    placed = items.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("ws") - F.col("n"))))
    h = F.coalesce(*[F.when(F.col("n") == k, window_hash(F.col("ws"), F.col("at"), k)) for k in range(1, size + 1)])
    found = placed.select(h.alias("h"), "n", spelled(F.col("ws"), F.col("at"), F.col("n")).alias("window"), "item")
    distinct = found.groupBy("h", "n", "window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return distinct.groupBy("h", "n").agg(F.sum(1 + F.size("items")).alias("pairs"), F.collect_list(F.struct("window", "items")).alias("entries"))


def scanned(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, keep: list[str] | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``doc_id``, the columns ``keep``, ``n_words, n_hit`` (words inside any occurrence of a window),
    ``items`` (sorted ids, as text, of the items with an occurring window) and ``spans`` (disjoint word ranges, end exclusive, that were hit)."""
    grams = staged(windows(benchmark, size), "windows")
    total = grams.agg(F.sum("pairs")).first()[0] or 0
    sizes = sorted(r["n"] for r in grams.select("n").distinct().collect())  # sizes: ``size`` different ones at most
    keep = keep or []
    rows = docs.select(F.col("doc_id"), *keep, words_of(lowered(F.col("text"))).alias("_ws")).withColumn("_row", F.monotonically_increasing_id())
    placed = rows.select("doc_id", *keep, "_row", "_ws", F.size("_ws").alias("_count"), F.posexplode_outer("_ws").alias("_at", "_word"))

    def looked(k: int) -> Column:
        return F.when(F.col("_at") + k <= F.col("_count"), window_hash(F.col("_ws"), F.col("_at"), k))

    if len(sizes) == 1:
        placed = placed.withColumn("_n", F.lit(sizes[0])).withColumn("h", looked(sizes[0]))
    elif sizes:
        each = F.array(*[F.struct(F.lit(k).alias("_n"), looked(k).alias("h")) for k in sizes])
        placed = placed.select("*", F.inline(each))
    else:
        placed = placed.withColumn("_n", F.lit(size)).withColumn("h", F.lit(None).cast("bigint"))
    table = grams.select("h", F.col("n").alias("_n"), "entries")
    met = placed.join(F.broadcast(table) if total <= WINDOWS_SENT else table, ["h", "_n"], "left")
    first = F.coalesce(F.col("_at"), F.lit(0)) == 0
    if len(sizes) > 1:
        first &= F.col("_n") == sizes[0]
    met = met.filter(first | F.col("entries").isNotNull())
    here = spelled(F.col("_ws"), F.col("_at"), F.col("_n"))
    verified = F.when(F.col("entries").isNotNull(), F.filter("entries", lambda e: e["window"] == here))
    hits = met.select("doc_id", *keep, "_row", "_count", F.col("_at"), (F.col("_at") + F.col("_n")).alias("_end"), F.get(verified, 0)["items"].alias("_items"))
    hits = hits.withColumns({"_at": F.when(F.col("_items").isNotNull(), F.col("_at")), "_end": F.when(F.col("_items").isNotNull(), F.col("_end"))})
    before = Window.partitionBy("_row").orderBy("_at", "_end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = hits.withColumn("_from", F.greatest("_at", F.coalesce(F.max("_end").over(before), F.lit(0))))
    span = F.when(F.col("_end") > F.col("_from"), F.struct(F.col("_from").alias("start"), F.col("_end").alias("end")))
    per = fresh.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in keep], F.max("_count").cast("bigint").alias("n_words"),
        F.coalesce(F.sum(F.when(F.col("_end") > F.col("_from"), F.col("_end") - F.col("_from"))), F.lit(0)).cast("bigint").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("items"), F.array_sort(F.collect_list(span)).alias("spans"))
    return per.drop("_row")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` per row of ``docs``: words, words inside any occurrence of a window of
    ``benchmark`` (item_id, text), items with an occurring window, the digest of their ids (as text, sorted, comma-joined), n_hit > 0.

    A null or empty text, of a document or an item, has no words. Rows stand for themselves, repeated and null ids too; an item without
    id hits words but is in no list; items that share an id count once. An empty table of documents gives none, an empty benchmark hits
    nothing. Other columns are not read. A very long text is one row: its hits are shuffled one by one, its words are not."""
    per = scanned(docs, benchmark, size)
    return per.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def without_contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, spans: bool = False) -> DataFrame:
    """``docs``, all columns, without contaminated rows; or, with ``spans``, with all rows but without hit words (and what lies before
    each of them) in ``text``; ``n_chars``, where there is one, then follows. Texts are matched by digest, so repeated rows fare alike."""
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    hit = scanned(docs.select("doc_id", "text", digest.alias("_digest")), benchmark, size, ["_digest"]).filter("n_hit > 0")
    hit = staged(hit.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n"), F.first("spans").alias("_spans")), "contaminated")
    marked = docs.withColumn("_digest", digest)
    clean = marked.join(hit.select("_digest"), "_digest", "left_anti").select(*docs.columns)
    if not spans:
        return clean
    hit_rows = skew_join(marked, hit, "_digest", docs.count())
    text = kept_text(F.col("text"), F.col("_spans"))
    mended = hit_rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        mended = mended.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean.unionByName(mended.select(*docs.columns))


def kept_text(text: Column, spans: Column) -> Column:
    """``text`` without the words of ``spans``, each with what lies before it."""
    words, seps = words_of(text), F.split(text, WORDS)
    pieces = F.zip_with(F.slice(seps, 1, F.size(words)), words, lambda s, w: F.concat(s, w))

    def of(p):
        starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
        ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.size(p)))
        return F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(p, a + 1, F.greatest(b - a, F.lit(0)))))

    kept = F.transform(F.array(pieces), of)[0]
    return F.concat(F.array_join(kept, ""), F.element_at(seps, -1))


# The same rows in SQL (DuckDB)
CONTAMINATION = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
g AS (SELECT DISTINCT item, n, array_to_string(list_slice(ws, i + 1, i + n), ' ') AS win FROM (SELECT item, ws, least(10, len(ws)) AS n, unnest(range(0, len(ws) - least(10, len(ws)) + 1)) AS i FROM b WHERE len(ws) > 0)),
k AS (SELECT DISTINCT n FROM g),
w AS (SELECT doc_id, k.n, i, array_to_string(list_slice(ws, i + 1, i + k.n), ' ') AS win FROM (SELECT doc_id, ws, unnest(range(0, len(ws))) AS i FROM d) JOIN k ON i + k.n <= len(ws)),
h AS (SELECT w.doc_id, w.n, w.i, g.item FROM w JOIN g ON w.n = g.n AND w.win = g.win),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT doc_id, n, i FROM h)) GROUP BY doc_id),
q AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)
"""
