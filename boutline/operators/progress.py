"""Awards, levels, takes, drills, clip plans and the digest given to a coach."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boutline.functions.scalars import level_of

# fixed values: points and rule per event
POINTS = {"language_set": (30, "once"), "team_saved": (25, "daily"), "card_viewed": (3, "once"), "menu_open": (5, "daily"), "mode_open": (15, "once"),
          "replay_dropped": (40, "always"), "drill_logged": (10, "always"), "claim_graded": (8, "once"), "matchup_answered": (4, "always"),
          "concept_read": (6, "once"), "tech_written": (25, "once"), "tech_imported": (10, "once"), "coach_read": (0, "once")}


def _points(field: int):
    return F.create_map(*[x for k, v in POINTS.items() for x in (F.lit(k), F.lit(v[field]))])


def award_key(event, ref, t, seq):
    """What may be paid only once: the event and its ref, per day for daily ones, per occurrence otherwise."""
    rule = F.try_element_at(_points(1), event)
    once = F.concat_ws(":", event, F.coalesce(ref, F.lit("")))
    return F.when(rule == "once", once).when(rule == "daily", F.concat_ws(":", once, F.date_format(t, "yyyy-MM-dd"))).otherwise(F.concat_ws("#", once, seq.cast("string")))


def award_points(event):
    return F.try_element_at(_points(0), event)


def levels(awards: DataFrame) -> DataFrame:
    """Points and level per user from ``awards(user, event, ref, t, seq)``; unknown events pay nothing."""
    paid = awards.withColumn("xp", award_points(F.col("event"))).filter("xp is not null").withColumn("_key", award_key(F.col("event"), F.col("ref"), F.col("t"), F.col("seq")))
    per = paid.groupBy("user", "_key").agg(F.first("xp").alias("xp")).groupBy("user").agg(F.sum("xp").alias("xp"), F.count("*").alias("paid"))
    level, into = level_of(F.col("xp"))
    return per.select("user", "xp", "paid", level.alias("level"), into.alias("into"))


def grade_latest(grades: DataFrame) -> DataFrame:
    """Newest take per finding; an earlier verdict stands where the new take has none."""
    at = F.struct("t", "seq")
    known = F.col("verdict").isNotNull()
    return grades.groupBy("id").agg(F.max_by("take", at).alias("take"), F.coalesce(
        F.max_by(F.when(known, F.col("verdict")), F.when(known, at)), F.lit("actually")).alias("verdict"))


def drill_counts(drills: DataFrame, keep: int = 200) -> DataFrame:
    """Landed and dropped per route, and its last attempts, found through each day's last ones."""
    n = drills.groupBy("route").agg(F.count_if("ok").alias("landed"), F.count_if(~F.col("ok")).alias("dropped"))
    order = [F.desc("t"), F.desc("seq")]
    day = drills.withColumn("_r", F.row_number().over(Window.partitionBy("route", F.to_date("t")).orderBy(*order))).filter(F.col("_r") <= keep)
    last = day.withColumn("_r", F.row_number().over(Window.partitionBy("route").orderBy(*order))).filter(F.col("_r") <= keep)
    log = last.groupBy("route").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "ok")), False), lambda x: F.when(x["ok"], "1").otherwise("0")), "").alias("log"))
    return n.join(log, "route")


def clip_deaths(kos: DataFrame, matches: DataFrame, *, pre=5.0, post=2.0, fps=60) -> DataFrame:
    """Where to cut the recording for each death: ``pre`` seconds before, less at its very start, and ``post`` after."""
    offset = F.col("video_offset_frames") / fps
    want = F.col("frame") / fps + offset - pre
    return kos.select("match_id", "slot", "frame").distinct().join(matches.select("match_id", "video_offset_frames", "duration_frames"), "match_id").select(
        "match_id", "slot", "frame", F.greatest(F.lit(0.0), want).alias("start"), (pre + post + F.least(F.lit(0.0), want)).alias("duration"),
        (F.greatest(F.lit(0.0), want) > F.col("duration_frames") / fps + offset).alias("past_end"))


def recent_awards(awards: DataFrame, keep: int = 500) -> DataFrame:
    """The last ``keep`` paid awards of each user, found through each day's last ones. ``awards(user, event, ref, t, seq)``."""
    paid = awards.withColumn("xp", award_points(F.col("event"))).filter("xp is not null").withColumn("key", award_key(F.col("event"), F.col("ref"), F.col("t"), F.col("seq")))
    once = paid.groupBy("user", "event", "key", "xp").agg(F.min(F.struct("t", "seq")).alias("_at"))
    order = F.desc("_at")
    day = once.withColumn("_r", F.row_number().over(Window.partitionBy("user", F.to_date("_at.t")).orderBy(order))).filter(F.col("_r") <= keep)
    last = day.withColumn("rank", F.row_number().over(Window.partitionBy("user").orderBy(order))).filter(F.col("rank") <= keep)
    return last.select("user", "rank", "event", "xp", F.col("_at.seq").alias("seq"))


def clip_plan(clusters: DataFrame, matches: DataFrame, inputs: DataFrame, *, pre=4.0, post=3.0, min_severity=2, limit=8, fps=60) -> DataFrame:
    """Where to cut the recording for the strongest moments of each match."""
    from boutline.operators.moments import top_moments
    from boutline.operators.timejoin import interval_join
    top = top_moments(clusters.filter(F.col("severity") >= min_severity), limit).select("match_id", "slot", "kind", "frame", "severity", "rank")
    want = F.col("frame") / fps + F.col("video_offset_frames") / fps - pre
    plan = top.join(matches.select("match_id", "video_offset_frames", (F.col("duration_frames") / fps + F.col("video_offset_frames") / fps).alias("ends")), "match_id").withColumn(
        "start", F.greatest(F.lit(0.0), want)).withColumn("pre", pre + F.least(F.lit(0.0), want)).withColumn("duration", F.col("pre") + post).withColumn(
        "past_end", F.col("start") > F.col("ends"))
    grid = inputs.groupBy("match_id", F.col("frame").alias("at")).agg(F.count("*").alias("n"))
    key = ["match_id", "rank"]
    met = interval_join(plan.select(*key, "frame", "pre"), grid, ["match_id"], F.col("frame") - F.col("pre") * fps, F.col("frame") + post * fps, "at", width=(pre + post) * fps)
    return plan.join(met.groupBy(*key).agg(F.sum("n").alias("presses")), key, "left").withColumn("presses", F.coalesce("presses", F.lit(0))).drop("video_offset_frames", "ends")


def evidence_order(findings: DataFrame, takes: DataFrame, cap: int = 40) -> DataFrame:
    """Findings of a capture for the digest: those with a take first, then by size, ``cap`` shown and the rest counted."""
    f = findings.join(takes.select("id", F.lit(True).alias("_take")).distinct(), "id", "left").withColumn("has_take", F.coalesce("_take", F.lit(False))).drop("_take")
    order = [F.desc("has_take"), F.desc("size"), "id"]
    near = f.withColumn("_r", F.row_number().over(Window.partitionBy("video", "segment").orderBy(*order))).filter(F.col("_r") <= cap)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("video").orderBy(*order))).filter(F.col("rank") <= cap).drop("_r")
    n = f.groupBy("video").agg(F.greatest(F.count("*") - cap, F.lit(0)).alias("not_shown"))
    return ranked.join(n, "video")


def evidence_digest(ordered: DataFrame) -> DataFrame:
    """One digest text per capture from at most ``cap`` ordered findings."""
    line = F.format_string("- [%s] %s%s", F.col("id"), F.col("title"), F.when(F.col("has_take"), " (taken)").otherwise(""))
    return ordered.groupBy("video").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"), F.max("not_shown").alias("n")).select(
        "video", F.concat(F.col("body"), F.when(F.col("n") > 0, F.format_string("\n(%d more findings not shown)", "n")).otherwise("")).alias("digest"))
