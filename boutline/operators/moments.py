"""Moments in an event log: wasted inputs, bursts, idle stretches, KOs, and their anchored clusters.

``inputs(match_id, slot, frame, seq, action)``, ``kos(match_id, slot, frame, seq)``,
``actions(action, busy, category)``; ``actions`` holds one row per action of a game.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boutline.operators.seq import BLOCK, along, anchored_runs, blocked

KEY = ["match_id", "slot"]
MOMENT = ["match_id", "slot", "frame", "seq", "kind", "severity", "amount", "title"]


def press_edges(held: DataFrame, bits: dict[int, str], width: int) -> DataFrame:
    """Presses in a held-state stream: one row per action bit going from 0 to 1; nothing is held at the start.

    ``held(match_id, stream, ts_ms, state)``, one row per instant."""
    keys = ["match_id", "stream"]
    seen = along(blocked(held, "ts_ms", width), keys, ["ts_ms"], prev={"_was": F.col("state")})
    risen = F.col("state").bitwiseAND(F.bitwise_not(F.coalesce(F.col("_was"), F.lit(0))))
    names = F.array(*[F.when(risen.bitwiseAND(F.lit(1 << b)) != 0, F.struct(F.lit(b).alias("bit"), F.lit(a).alias("action"))) for b, a in sorted(bits.items())])
    return seen.select(*keys, "ts_ms", F.explode(F.array_compact(names)).alias("p")).select(*keys, "ts_ms", "p.bit", "p.action")


def press_gaps(inputs: DataFrame, width: int) -> DataFrame:
    """Frames since the same player's previous press of the same action."""
    # in frame order the previous press is the latest frame so far
    return along(blocked(inputs, "frame", width), [*KEY, "action"], ["frame", "seq"],
                 peak={"last_frame": F.col("frame")}).withColumn(
        "gap", F.col("frame") - F.col("last_frame")).drop(BLOCK, "last_frame")


def wasted_inputs(inputs: DataFrame, actions: DataFrame, width: int) -> DataFrame:
    """Presses with their gap and whether the previous press of the action still occupied the player."""
    model = F.broadcast(actions.select("action", "busy"))  # one row per action of a game
    return press_gaps(inputs, width).join(model, "action", "left").withColumn(
        "wasted", F.coalesce((F.col("busy") > 0) & (F.col("gap") < F.col("busy")), F.lit(False)))


def bursts(inputs: DataFrame, window: int, count: int, width: int) -> DataFrame:
    """Events that open a window of ``window`` frames holding at least ``count`` events from themselves on.

    Counts are taken on one row per frame; each block also sees the first ``window`` frames of the next.
    """
    frames = inputs.groupBy(*KEY, "frame").agg(F.count("*").alias("n"))
    halo = frames.withColumn(BLOCK, F.explode(F.sequence(
        F.floor((F.col("frame") - window) / width), F.floor(F.col("frame") / width))))
    ahead = Window.partitionBy(*KEY, BLOCK).orderBy("frame").rangeBetween(1, window)
    counted = (
        halo.withColumn("after", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        .filter(F.col(BLOCK) == F.floor(F.col("frame") / width))
        .filter(F.col("after") + F.col("n") >= count)
        .select(*KEY, "frame", "n", "after")
    )
    peers = Window.partitionBy(*KEY, "frame").orderBy("seq")
    return (
        inputs.join(counted, [*KEY, "frame"])
        .withColumn("presses", F.col("after") + F.col("n") - F.row_number().over(peers) + 1)
        .filter(F.col("presses") >= count)
        .select(*KEY, "frame", "seq", "presses")
    )


def idles(inputs: DataFrame, frames: int, width: int) -> DataFrame:
    """Stretches of at least ``frames`` frames without input, reported at the event before them."""
    instants = inputs.groupBy(*KEY, "frame").agg(F.max("seq").alias("seq"))
    prev = along(blocked(instants, "frame", width), KEY, ["frame"], prev={"_f": F.col("frame"), "_s": F.col("seq")})
    return prev.withColumn("gap", F.col("frame") - F.col("_f")).filter(F.col("gap") >= frames).select(
        *KEY, F.col("_f").alias("frame"), F.col("_s").alias("seq"), "gap")


def detect_moments(inputs, kos, actions, *, burst_window=60, burst_count=14, idle_frames=108, width=65536) -> DataFrame:
    """All moments, one row each; ``amount`` is the gap or count behind it."""

    def shaped(df, kind, severity, amount, title):
        return df.select(*KEY, "frame", "seq", F.lit(kind).alias("kind"), F.lit(severity).alias("severity"),
                         amount.cast("long").alias("amount"), title.alias("title"))

    wasted = wasted_inputs(inputs, actions, width).filter("wasted")
    return (
        shaped(wasted, "wasted_input", 1, F.col("gap"), F.format_string("Wasted %s input", "action"))
        .unionByName(shaped(bursts(inputs, burst_window, burst_count, width), "burst", 2, F.col("presses"),
                            F.format_string("Burst of %d inputs", "presses")))
        .unionByName(shaped(idles(inputs, idle_frames, width), "idle", 1, F.col("gap"),
                            F.format_string("Idle for %d frames", "gap")))
        .unionByName(shaped(kos, "ko", 5, F.lit(None), F.lit("KO")))
    )


def cluster_moments(moments: DataFrame, window: int = 240, width: int = 4096) -> DataFrame:
    """Moments of one kind and slot within ``window`` frames of the first one become one, with a count."""
    keys = ["match_id", "slot", "kind"]
    instants = moments.groupBy(*keys, "frame").agg(
        F.count("*").alias("n"), F.max("severity").alias("severity"), F.min_by("title", "seq").alias("title"))
    runs = anchored_runs(instants, keys, "frame", window, width, ["n", "severity", "title"])
    merged = runs.groupBy(*keys, F.col("run_start").alias("frame")).agg(
        F.sum("n").alias("count"), F.max("frame").alias("end"), F.max("severity").alias("severity"),
        F.min_by("title", F.col("frame")).alias("title"))
    plain = F.col("kind") == "ko"
    return merged.select(
        *keys, "frame", "count", "end",
        F.when(~plain & (F.col("count") >= 4), F.least(F.lit(5), F.col("severity") + 1))
        .otherwise(F.col("severity")).alias("severity"),
        F.when(~plain & (F.col("count") > 1), F.format_string("%s x%d", "title", "count"))
        .otherwise(F.col("title")).alias("title"))


def top_moments(moments: DataFrame, n: int = 18) -> DataFrame:
    """The ``n`` most severe moments of each match, earliest first among equals."""
    # a first cut inside (match, frame block) keeps a hot match from being ranked in one task
    order = [F.desc("severity"), "frame", "slot", "kind"]
    cut = moments.withColumn("_b", F.floor(F.col("frame") / 4096))
    local = cut.withColumn("_r", F.row_number().over(Window.partitionBy("match_id", "_b").orderBy(*order)))
    ranked = local.filter(F.col("_r") <= n).withColumn(
        "rank", F.row_number().over(Window.partitionBy("match_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= n).drop("_b", "_r")
