"""Readings against a closed set: templates, names, votes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_TEMPLATES = 65_536  # contract: templates are a game's fixed set; a larger one is refused, never cut


def _mean_abs(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def template_match(reads: DataFrame, templates: DataFrame, *, key: str, max_dist: float, min_margin: float) -> DataFrame:
    """Name of the nearest template for every reading, if near enough and clearly nearer than the best of any *other* name.

    Names are ranked by their best variant. The templates, MOST_TEMPLATES at most by contract, travel with the rows as one array, so
    readings are not shuffled and rows that share a key keep a result each. Without templates every reading stays unnamed.
    """
    bank = templates.agg(F.collect_list(F.struct("name", "vec")).alias("_bank"))
    bank = bank.select(F.when(F.size("_bank") <= MOST_TEMPLATES, F.col("_bank")).otherwise(F.raise_error(F.lit("more templates than a fixed set may have"))).alias("_bank"))
    held = reads.select(key, "vec").crossJoin(F.broadcast(bank))  # one row
    scored = held.withColumn("_d", F.transform("_bank", lambda t: F.struct(_mean_abs(F.col("vec"), t["vec"]).alias("d"), t["name"].alias("name"))))
    scored = scored.withColumn("_0", F.array_min("_d"))
    other = F.array_min(F.filter("_d", lambda x: x["name"] != F.col("_0.name")))
    ranked = scored.withColumn("_1", other).select(key, F.col("_0.name").alias("name"), F.col("_0.d").alias("d0"), F.col("_1.d").alias("d1"))
    sure = (F.col("d0") <= max_dist) & (F.coalesce(F.col("d1"), F.lit(9.9)) - F.col("d0") >= min_margin)
    return ranked.select(key, F.when(sure, F.col("name")).alias("name"), "d0", "d1")


def _shorter(words):
    """Each string of an array with any one character taken out."""
    return F.array_distinct(F.flatten(F.transform(words, lambda s: F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: i <= F.length(s)),
        lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))))))


def _signatures(text: str, edits: int):
    """The string and what is left after taking out up to ``edits`` characters: strings within that edit distance share one."""
    layers = [F.array(F.col(text))]
    for _ in range(edits):
        layers.append(_shorter(layers[-1]))
    return F.array_distinct(F.concat(*layers))


def fuzzy_snap(reads: DataFrame, roster: DataFrame, *, max_edits: int = 2) -> DataFrame:
    """Distinct readings snapped to the closed set: exact, else the single nearest key within the edit limit.

    A reading needs four characters; ties are refused. Candidates meet in an equi join on deletion signatures, so neither side is
    broadcast or paired with all of the other.
    """
    texts = reads.select("text").distinct()
    size = F.length("text")
    limit = F.least(F.lit(max_edits), F.floor(size / 4).cast("int") + 1)
    left = texts.filter(size >= 4).select("text", F.explode(_signatures("text", max_edits)).alias("_s"))
    right = roster.select("key").distinct().select("key", F.explode(_signatures("key", max_edits)).alias("_s"))
    met = left.join(right, "_s").select("text", "key").distinct().withColumn("_d", F.levenshtein("text", "key")).filter(F.col("_d") <= max_edits)
    near = met.groupBy("text", "_d").agg(F.min("key").alias("_k"), F.count(F.lit(1)).alias("_n"))
    best = near.groupBy("text").agg(F.min(F.struct("_d", "_n", "_k")).alias("_b"))
    ok = (F.col("_b._d") == 0) | ((F.col("_b._d") <= limit) & (F.col("_b._n") == 1))
    return texts.join(best, "text", "left").select("text", F.when(ok, F.col("_b._k")).alias("name"), F.when(ok, F.col("_b._d")).alias("edits"))



def name_vote(reads: DataFrame) -> DataFrame:
    """Most seen name per segment and side if at least two readings agree; every count is kept.

    ``reads(segment, side, name, ord)``; the earlier seen name wins a tie. Names form a closed set.
    """
    n = reads.filter(F.col("name").isNotNull()).groupBy("segment", "side", "name").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    voted = n.groupBy("segment", "side").agg(
        F.max_by(F.struct("name", "n"), F.struct("n", (-F.col("first")).alias("f"))).alias("_b"),
        F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("seen"))
    return voted.select("segment", "side", F.when(F.col("_b.n") >= 2, F.col("_b.name")).alias("name"), "seen")
