"""Sampled panel readings: usable stretches, freezes, moves, stuck windows, openings, combos, input log.

``samples(segment, side, t, damage, combo, recovery, ..., frozen)``: one row per side and instant. A NULL
reading is unknown: it never ends a run, never contradicts, never counts as zero.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boutline.operators.seq import BLOCK, along, blocked, cut_runs
from boutline.operators.settle import settle
from boutline.operators.timejoin import any_within, asof, interval_join

FPS = 59.94         # footage rate
SIDE = ["segment", "side"]


def score_segments(scored: DataFrame, *, on=0.5, step=5.0, trim=2.5, min_len=20.0, width=4096.0) -> DataFrame:
    """Stretches where the overlay is on, trimmed at both ends; an unread score is off."""
    flagged = blocked(scored.withColumn("_on", F.coalesce(F.col("score") > on, F.lit(False))), "t", width)
    runs = along(flagged, ["video"], ["t"], total={"_off": F.when(F.col("_on"), 0).otherwise(1).cast("long")})
    return runs.filter("_on").groupBy("video", "_off").agg(F.min("t").alias("a"), F.max("t").alias("b")).select(
        "video", (F.col("a") + trim).alias("start"), (F.col("b") + step - trim).alias("end")).filter(
        F.col("end") - F.col("start") >= min_len)


def scan_merge(scans: DataFrame) -> DataFrame:
    """Scores of several scan runs: the later run wins at an instant."""
    return scans.groupBy("video", "t").agg(F.max_by("score", "run").alias("score"))


def frozen_spans(wide: DataFrame, fields: list[str], *, hold=3.0, width=64.0) -> DataFrame:
    """Spans during which no known field contradicts the readings since the span's start.

    ``wide(segment, t, fields...)`` holds both sides of an instant. A row breaks the span iff, for some field,
    the last known reading before it differs and lies inside the span.
    """
    keys = ["segment"]
    seen = along(blocked(wide, "t", width), keys, ["t"], known={
        **{f"_v_{f}": F.col(f) for f in fields}, **{f"_at_{f}": F.when(F.col(f).isNotNull(), F.col("t")) for f in fields}})
    q = F.greatest(*[F.when(F.col(f"_v_{f}") != F.col(f), F.col(f"_at_{f}")) for f in fields])
    runs = cut_runs(seen.withColumn("_q", q), keys, "t", "_q", width)
    return runs.groupBy("segment", F.col("run_start").alias("start")).agg(
        F.max("t").alias("end"), F.count("*").alias("samples")).withColumn("frozen", F.col("end") - F.col("start") >= hold)


def moves(samples: DataFrame, *, width=64.0) -> DataFrame:
    """One row per move shown: startup agrees where known, Total does not fall."""
    live = samples.filter(~F.col("frozen") & (F.col("startup").isNotNull() | F.col("total").isNotNull()))
    seen = along(blocked(live, "t", width), SIDE, ["t"], known={
        "_su": F.col("startup"), "_su_t": F.when(F.col("startup").isNotNull(), F.col("t")),
        "_to": F.col("total"), "_to_t": F.when(F.col("total").isNotNull(), F.col("t"))})
    q = F.greatest(F.when(F.col("_su") != F.col("startup"), F.col("_su_t")), F.when(F.col("_to") > F.col("total"), F.col("_to_t")))
    cols = ["startup", "active", "total", "damage", "combo", "recovery"]
    runs = cut_runs(seen.withColumn("_q", q), SIDE, "t", "_q", width, cols)

    def final(c):
        return F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("t"))).alias(c)

    return runs.groupBy(*SIDE, F.col("run_start").alias("t")).agg(
        F.max("t").alias("until"), F.count("*").alias("samples"), F.max("startup").alias("startup"),
        F.max("active").alias("active"), F.max("total").alias("total"), final("damage"), final("combo"), final("recovery"))


def stuck_windows(samples: DataFrame, *, stuck=-6, max_gap=5, width=64.0) -> DataFrame:
    """Runs in which a side cannot act. Up to ``max_gap`` unread samples in a row may sit inside one."""
    live = blocked(samples.filter(~F.col("frozen")).select(*SIDE, "t", "recovery"), "t", width)
    indexed = along(live, SIDE, ["t"], total={"_i": F.lit(1).cast("long")})
    read = along(indexed.filter("recovery is not null"), SIDE, ["t"], prev={"_pi": F.col("_i"), "_pv": F.col("recovery")})
    held = (F.col("_pv") <= stuck) & (F.col("_i") - F.col("_pi") <= max_gap + 1)
    starts = read.filter(F.col("recovery") <= stuck).withColumn("_new", F.when(F.coalesce(held, F.lit(False)), 0).otherwise(1).cast("long"))
    runs = along(settle(starts), SIDE, ["t"], total={"_r": F.col("_new")})
    return runs.groupBy(*SIDE, (F.col("_r") + F.col("_new")).alias("_run")).agg(
        F.min("t").alias("first_seen"), F.max("t").alias("end"), F.min("recovery").alias("worst")).drop("_run")


def openings(windows: DataFrame, moves: DataFrame, *, min_frames=12, grace=0.3, width=64.0) -> DataFrame:
    """Windows in which the other side was free and started no move from ``grace`` before to ``grace`` after."""
    free = F.when(F.col("side") == "L", "R").otherwise("L")
    w = windows.withColumn("frames", -F.col("worst")).filter(F.col("frames") >= min_frames).select(
        "segment", free.alias("side"), F.col("side").alias("stuck"), "end", (F.col("end") - F.col("frames") / FPS).alias("start"),
        "first_seen", "frames", (F.col("end") + grace).alias("_to"))
    acted = any_within(w.withColumn("_from", F.col("start") - grace), moves.select(*SIDE, F.col("t").alias("_mt")), SIDE, "_from", "_to", "_mt", width=width, name="acted")
    return acted.filter(~F.col("acted")).select("segment", F.col("side").alias("free"), "stuck", "start", "end", "first_seen", "frames")


def stall_events(openings: DataFrame, *, gap=1.5, width=64.0) -> DataFrame:
    """Openings of one side within ``gap`` seconds of the event so far are one event, anchored on the largest."""
    keys = ["segment", "free"]
    order = ["start", "end"]
    seen = along(blocked(settle(openings), "start", width), keys, order, peak={"_reach": F.col("end")})
    new = seen.withColumn("_new", F.when(F.coalesce(F.col("start") - F.col("_reach") <= gap, F.lit(False)), 0).otherwise(1).cast("long"))
    runs = along(new, keys, order, total={"_r": F.col("_new")})
    big = F.struct("frames", (-F.col("start")).alias("s"), (-F.col("end")).alias("e"))
    ev = runs.groupBy(*keys, (F.col("_r") + F.col("_new")).alias("_run")).agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("windows"), F.max("frames").alias("frames"),
        F.max_by("end", big).alias("anchor"), F.max_by("stuck", big).alias("stuck"),
        F.array_sort(F.collect_list("end")).alias("members"))
    return ev.withColumn("span", F.col("end") - F.col("start")).drop("_run")


def combo_hits(samples: DataFrame, *, width=64.0) -> DataFrame:
    """Every counted hit with the combo it belongs to.

    Zero closes a combo. A change to the shown damage or to a lower count starts one, so does the first
    change after a zero (then the first hit is inferred); any other rise extends. A combo is therefore
    named by the zeros and the definite starts up to it.
    """
    live = blocked(samples.filter(~F.col("frozen") & F.col("combo").isNotNull()).select(*SIDE, "t", "combo", "damage"), "t", width)
    seen = along(live, SIDE, ["t"], prev={"_v": F.col("combo")}, total={"_zeros": F.when(F.col("combo") == 0, 1).otherwise(0).cast("long")})
    first = F.coalesce(F.col("combo") == F.col("damage"), F.lit(False))
    dropped = F.coalesce((F.col("_v") > 0) & (F.col("combo") < F.col("_v")), F.lit(False))
    changed = seen.filter((F.col("combo") != 0) & (F.col("_v").isNull() | (F.col("_v") != F.col("combo")))).withColumn(
        "_hard", F.when(first | dropped, 1).otherwise(0).cast("long")).filter((F.col("_hard") == 1) | F.col("_v").isNotNull())
    named = along(changed, SIDE, ["t"], total={"_starts": F.col("_hard")})
    key = [*SIDE, "_zeros", "_c"]
    in_combo = Window.partitionBy(*key).orderBy("t")
    return named.withColumn("_c", F.col("_starts") + F.col("_hard")).select(
        *key, "t", F.col("combo").alias("total"), F.row_number().over(in_combo).alias("hit"),
        F.coalesce(F.lag("combo").over(in_combo), F.lit(0)).alias("before"), "_hard")


def combos(hits: DataFrame) -> DataFrame:
    """One row per combo, with the combo key of its hits."""
    return hits.groupBy(*SIDE, "_zeros", "_c").agg(
        F.min("t").alias("t0"), F.max("t").alias("t1"), F.max_by("total", "t").alias("damage"), F.count("*").alias("hits"),
        (F.min_by("_hard", "t") == 0).alias("first_hit_inferred")).withColumn("span", F.col("t1") - F.col("t0"))


def combo_check(samples: DataFrame, *, width=64.0) -> DataFrame:
    """Per segment: rises of the counter that equal the shown damage, those that do not, exact multiples among them."""
    live = blocked(samples.filter(~F.col("frozen") & F.col("combo").isNotNull()).select(*SIDE, "t", "combo", "damage"), "t", width)
    seen = along(live, SIDE, ["t"], prev={"_v": F.col("combo")})
    rise = F.col("combo") - F.col("_v")
    counted = seen.filter((rise > 0) & (F.col("damage") != 0) & (F.col("combo") != F.col("damage")))
    ok = rise == F.col("damage")
    return counted.groupBy("segment").agg(
        F.count_if(ok).alias("matching"), F.count_if(~ok).alias("not_matching"),
        F.count_if(~ok & (F.pmod(rise, F.col("damage")) == 0)).alias("exact_multiple")).withColumn(
        "share_ok", F.col("matching") / (F.col("matching") + F.col("not_matching")))


def punish_join(captions: DataFrame, hits: DataFrame, combos: DataFrame, *, lag=2.5, width=64.0) -> DataFrame:
    """Each caption with the latest hit on its side in the ``lag`` seconds before it, and that hit's combo."""
    key = [*SIDE, "_zeros", "_c"]
    right = hits.join(combos.select(*key, "damage", "hits", "t0", "span"), key).select(
        *SIDE, F.col("t").alias("hit_t"), "hit", "before", "damage", "hits", "t0", "span")
    got = asof(captions, right, SIDE, "t", "hit_t", ["hit", "before", "damage", "hits", "t0", "span"], width=width, tolerance=lag, out="c")
    return got.select(*captions.columns, F.col("c_hit").alias("hit_index"), F.col("c_damage").alias("damage"), F.col("c_hits").alias("hits"),
                      F.col("c_t0").alias("t0"), F.col("c_span").alias("span"), (F.col("t") - F.col("c_t")).alias("caption_lag"),
                      (F.col("c_damage") - F.col("c_before")).alias("from_punish_on"))


def input_log(samples: DataFrame, *, slop=6, cap=99, width=64.0) -> DataFrame:
    """Inputs read off the gutter: when the head does not grow and the next row carries the old head, it was entered."""
    rows = blocked(samples.filter(~F.col("frozen")).select(*SIDE, "t", "held", "row1"), "t", width)
    seen = along(rows, SIDE, ["t"], prev={"_h": F.col("held")})
    emitted = seen.filter((F.col("held") <= F.col("_h")) & (F.abs(F.col("row1") - F.col("_h")) <= slop)).select(
        *SIDE, F.col("t").alias("t_end"), F.col("_h").alias("held"), BLOCK)
    chained = along(emitted, SIDE, ["t_end"], prev={"_t": F.col("t_end")})
    first = rows.groupBy(*SIDE).agg(F.min("t").alias("_first"))
    return chained.join(first, SIDE).select(*SIDE, F.coalesce("_t", "_first").alias("t"), "held", (F.col("held") >= cap).alias("capped"), "t_end")


def caption_events(teal: DataFrame, *, level=220, gap=0.35, width=64.0) -> DataFrame:
    """Runs of a lit band with gaps up to ``gap`` seconds, timed at the first peak."""
    lit = blocked(teal.filter(F.col("teal") >= level), "t", width)
    seen = along(lit, ["segment"], ["t"], prev={"_p": F.col("t")})
    new = seen.withColumn("_new", F.when(F.col("t") - F.col("_p") <= gap, 0).otherwise(1).cast("long"))
    runs = along(new, ["segment"], ["t"], total={"_r": F.col("_new")})
    return runs.groupBy("segment", (F.col("_r") + F.col("_new")).alias("_run")).agg(
        F.min("t").alias("first"), F.max("t").alias("last"), F.max_by("t", F.struct("teal", (-F.col("t")).alias("n"))).alias("t"),
        F.max("teal").alias("teal")).withColumn("span", F.col("last") - F.col("first")).drop("_run")


def caption_best(reads: DataFrame, *, max_d=0.17, min_margin=0.02) -> DataFrame:
    """Per event and side the closest accepted reading; without one the closest, its word unknown."""
    keys = ["segment", "t", "side"]
    good = (F.col("d") <= max_d) & (F.col("margin") >= min_margin)
    row = F.struct("d", "word", "margin")
    pick = reads.groupBy(*keys).agg(F.min(F.when(good, row)).alias("_g"), F.min(row).alias("_a"))
    return pick.select(*keys, F.coalesce("_g.d", "_a.d").alias("d"), F.coalesce("_g.margin", "_a.margin").alias("margin"),
                       F.when(F.col("_g").isNotNull(), F.col("_g.word")).otherwise("?").alias("word"))


def segment_quality(samples: DataFrame, fields: list[str], fps: float) -> DataFrame:
    """Active seconds, share of unread fields, and whether the right side was read at all."""
    unread = sum((F.when(F.col(f).isNull(), 1).otherwise(0) for f in fields), F.lit(0))
    right = (F.col("side") == "R") & F.coalesce(*fields).isNotNull()
    return samples.groupBy("video", "segment").agg(
        F.min("t").alias("start"), F.max("t").alias("end"), (F.count_if(~F.col("frozen")) / fps).alias("active_seconds"),
        (F.sum(unread) / (F.count("*") * len(fields))).alias("unread_share"), F.bool_or(right).alias("two_sided"))


def finding_inputs(events: DataFrame, log: DataFrame, *, slack=0.2, width=16.0) -> DataFrame:
    """What the free side entered during an event: count, first eight holds, longest, capped, or nothing.

    Holds are reduced per event as an ordered list of at most the inputs of one short window.
    """
    keys = ["segment", "free"]
    events = settle(events)
    ids = events.select(*keys, "start", "end")
    right = log.select("segment", F.col("side").alias("free"), F.col("t").alias("at"), "held", "capped")
    met = interval_join(ids, right, keys, F.col("start") - slack, F.col("end") + slack, "at", width=width)
    got = met.groupBy(*keys, "start", "end").agg(
        F.count("*").alias("inputs"), F.max("held").alias("longest"), F.bool_or("capped").alias("any_capped"),
        F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("at", "held"))), 1, 8), lambda x: x["held"].cast("string")), ",").alias("holds"))
    return events.join(got, [*keys, "start", "end"], "left").withColumn("inputs", F.coalesce("inputs", F.lit(0))).withColumn(
        "nothing_entered", F.col("inputs") == 0)
