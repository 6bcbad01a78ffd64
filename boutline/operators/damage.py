"""Damage tracks read from video: arc readings, collapses, alignment with a log, nearest lookups."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.functions.damage import FRESH_SAT
from boutline.operators import timejoin
from boutline.operators.quantiles import order_stats
from boutline.operators.seq import cut_runs


def arc_reading(pixels: DataFrame, key: str) -> DataFrame:
    """Upper medians of hue, saturation and value over the pixels of one reading that belong to the arc, exact for readings of any size."""
    white = (F.col("sat") < FRESH_SAT) & (F.col("val") > 0.70)
    kept = pixels.filter(F.col("warm") | white).select(key, F.when(F.col("warm"), F.col("signed")).cast("double").alias("hue"), F.col("sat").cast("double"), F.col("val").cast("double"))
    long = kept.select(key, F.expr("stack(3, 'hue', hue, 'sat', sat, 'val', val) AS (_name, _value)"))
    middle = order_stats(long, [key, "_name"], "_value", {"_m": F.floor(F.col("n") / 2) + 1})
    read = middle.groupBy(key).agg(*[F.max(F.when(F.col("_name") == c, F.col("_m"))).alias(c) for c in ("hue", "sat", "val")])
    zero = F.lit(0.0)
    return pixels.select(key).distinct().join(read, key, "left").select(
        key, "hue", F.coalesce("sat", zero).alias("sat"), F.coalesce("val", zero).alias("val"))


def resets(readings: DataFrame, *, drop=0.30, floor=0.18, window=2.5, min_gap=6.0, width=16.0) -> DataFrame:
    """Collapses of a damage track: a fall of ``drop`` to at most ``floor`` within ``window`` seconds.

    ``readings(match_id, slot, seconds, estimate)``, one per instant. Each reading proposes the first later
    one that low; proposals closer than ``min_gap`` to the last accepted one are dropped (a greedy cut).
    """
    keys = ["match_id", "slot"]
    low = readings.filter(F.col("estimate") <= floor).select(
        *keys, F.col("seconds").alias("to"), F.col("estimate").alias("level"))
    pairs = timejoin.interval_join(readings, low, keys, F.col("seconds"), F.col("seconds") + window, "to", width=window * 2)
    proposed = pairs.filter((F.col("to") > F.col("seconds")) & (F.col("to") - F.col("seconds") <= window)
                            & (F.col("estimate") - F.col("level") >= drop)).groupBy(
        *keys, "seconds").agg(F.min("to").alias("to"))
    instants = proposed.select(*keys, F.col("to").alias("seconds")).distinct()
    # "more than min_gap after the last accepted" breaks a run from any position before seconds - min_gap
    marked = instants.withColumn("_q", F.col("seconds") - F.lit(min_gap) - F.lit(1e-9))
    runs = cut_runs(marked, keys, "seconds", "_q", width)
    return runs.select(*keys, F.col("run_start").alias("seconds")).distinct()


def damage_at(at: DataFrame, readings: DataFrame, tolerance: float = 1.5, width: float = 16.0) -> DataFrame:
    """The damage reading nearest to each (match_id, slot, seconds), NULL beyond ``tolerance``."""
    r = readings.select("match_id", "slot", F.col("seconds").alias("read_at"), "estimate")
    return timejoin.nearest(at, r, ["match_id", "slot"], "seconds", "read_at", ["estimate"],
                            width=width, tolerance=tolerance, out="near").withColumnRenamed("near_estimate", "damage").drop("near_t")


def validate_resets(found: DataFrame, known: DataFrame, tolerance: float = 6.0, width: float = 16.0) -> DataFrame:
    """Matched, missed and spurious times of one track: (match_id, slot, seconds, status)."""
    keys = ["match_id", "slot"]

    def near(left, right):
        return timejoin.nearest(left, right.select(*keys, F.col("seconds").alias("_o"), F.lit(1).alias("hit")), keys,
                                "seconds", "_o", ["hit"], width=width, tolerance=tolerance, out="n")

    k = near(known, found).select(*keys, "seconds", F.when(F.col("n_hit").isNotNull(), "matched").otherwise("missed").alias("status"))
    f = near(found, known).filter(F.col("n_hit").isNull()).select(*keys, "seconds", F.lit("spurious").alias("status"))
    return k.unionByName(f)


def align(deaths: DataFrame, found: DataFrame, arcs: DataFrame, *, lo=-120.0, hi=120.0, step=0.5, within=4.0) -> DataFrame:
    """Offset and arc-to-slot order under which the resets explain the deaths of each match best.

    ``deaths(match_id, slot, seconds)`` in log time, ``found(match_id, arc, seconds)`` in video time,
    ``arcs(match_id, perm, arc, slot)`` the orders to try. A death scores 1 for a reset within ``within``
    seconds, a reset no death explains costs half; the nearer fit wins a tie, then the one tried first.
    Resets of an arc keep a minimum distance, so a death at one offset meets a bounded number of them and
    the work grows with deaths times the fixed grid.
    """
    keys = ["match_id", "perm", "arc"]
    n = int(round((hi - lo) / step))
    used = arcs.join(deaths.select("match_id", "slot").distinct(), ["match_id", "slot"], "left_semi")
    shifted = deaths.distinct().join(used, ["match_id", "slot"]).select(
        *keys, F.col("seconds").alias("death"), F.explode(F.sequence(F.lit(0), F.lit(n))).alias("o")).withColumn(
        "want", F.col("death") + F.lit(lo) + F.col("o") * step)
    res = found.join(used, ["match_id", "arc"]).select(*keys, F.col("seconds").alias("reset"))
    met = timejoin.interval_join(res, shifted, keys, F.col("reset") - within, F.col("reset") + within, "want", width=2 * within)
    gap = F.col("reset") - F.col("want")
    hits = met.groupBy(*keys, "o", "death").agg(F.min_by(gap, F.struct(F.abs(gap).alias("g"), F.col("reset"))).alias("gap")).groupBy(
        "match_id", "perm", "o").agg(
        F.count("*").alias("hits"), F.avg(F.abs("gap")).alias("residual"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY gap DESC)").alias("shift"))
    explained = met.select(*keys, "o", "reset").distinct().groupBy("match_id", "perm", "o").agg(F.count("*").alias("_explained"))
    totals = res.groupBy("match_id", "perm").agg(F.count("*").alias("_resets"))
    scored = hits.join(explained, ["match_id", "perm", "o"]).join(totals, ["match_id", "perm"]).withColumn(
        "spurious", F.col("_resets") - F.col("_explained")).withColumn("score", F.col("hits") - 0.5 * F.col("spurious"))
    return scored.groupBy("match_id").agg(F.max_by(
        F.struct("perm", (F.lit(lo) + F.col("o") * step + F.col("shift")).alias("offset"), "hits", "spurious", "score", "residual"),
        F.struct("score", (-F.round("residual", 6)).alias("r"), (-F.col("perm")).alias("p"), (-F.col("o")).alias("o"))).alias("best")).select(
        "match_id", "best.*")
