"""Habit metrics, profiles and the match browser."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.operators.quantiles import medians


def habit_metrics(inputs: DataFrame, matches: DataFrame, actions: DataFrame, categories: list[str]) -> DataFrame:
    """Long metric rows (match_id, slot, key, value); nothing for a player without inputs or playing time.
    ``categories`` names the groups of the action model that are reported, also at zero."""
    cats = categories
    model = F.broadcast(actions.select("action", "category"))  # one row per action of a game
    counts = inputs.groupBy("match_id", "slot", "action").agg(F.count("*").alias("n")).join(model, "action", "left")
    timed = matches.select("match_id", (F.col("duration_frames") / F.col("fps") / 60.0).alias("minutes")).filter("minutes > 0")
    wide = counts.groupBy("match_id", "slot").agg(
        F.sum("n").alias("presses"),
        F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("n_"), F.col("action")), F.col("n").cast("double")))).alias("_per"),
        *[F.sum(F.when(F.col("category") == c, F.col("n")).otherwise(0)).alias(f"_c_{c}") for c in cats],
    ).join(timed, "match_id")
    entries = [("presses", F.col("presses")), ("minutes", F.col("minutes")), ("apm", F.col("presses") / F.col("minutes"))]
    fixed = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("double").alias("value")) for k, v in entries])
    by_cat = F.flatten(F.array(*[
        F.array(F.struct(F.lit(c).alias("key"), F.col(f"_c_{c}").cast("double").alias("value")),
                F.struct(F.lit(c + "_pm").alias("key"), (F.col(f"_c_{c}") / F.col("minutes")).alias("value")))
        for c in cats]))
    per = F.transform(F.map_entries("_per"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    return wide.select("match_id", "slot", F.explode(F.concat(fixed, by_cat, per)).alias("_m")).select(
        "match_id", "slot", "_m.key", "_m.value")


def players_seen(players: DataFrame, n: int) -> DataFrame:
    return players.filter(F.col("display_name").isNotNull()).groupBy("display_name").agg(
        F.count("*").alias("matches")).orderBy(F.desc("matches"), "display_name").limit(n)


def facets(matches: DataFrame, kos: DataFrame, players: DataFrame, top: int = 40) -> DataFrame:
    """Counts behind the browser's filters as (facet, value, n)."""
    with_kos = kos.select("match_id").distinct().withColumn("has_ko", F.lit(1))
    totals = matches.join(with_kos, "match_id", "left").agg(
        F.count("*").alias("total"), F.count_if("has_video").alias("video"), F.count("has_ko").alias("kos"))
    rows = totals.select(F.expr("stack(3, 'total', total, 'with_video', video, 'with_kos', kos) AS (value, n)")).select(
        F.lit("totals").alias("facet"), "value", "n")
    patches = matches.filter(F.col("patch").isNotNull()).groupBy("patch").agg(F.count("*").alias("n")).select(
        F.lit("patch").alias("facet"), F.col("patch").alias("value"), "n")
    people = players_seen(players, top).select(F.lit("player").alias("facet"), F.col("display_name").alias("value"),
                                               F.col("matches").alias("n"))
    return rows.unionByName(patches).unionByName(people)


def match_list(matches: DataFrame, players: DataFrame, *, player=None, has_video=None, patch=None, like=None,
               limit: int = 50, offset: int = 0) -> DataFrame:
    """The match browser page: newest first, names joined in slot order."""
    picked = matches
    if player is not None:
        picked = picked.join(players.filter(F.col("display_name") == player).select("match_id"), "match_id", "left_semi")
    if has_video is not None:
        picked = picked.filter(F.col("has_video") == has_video)
    if patch is not None:
        picked = picked.filter(F.col("patch") == patch)
    if like is not None:
        picked = picked.filter(F.col("level_name").like(f"%{like}%") | F.col("source_file").like(f"%{like}%"))
    page = picked.orderBy(F.desc("match_id")).offset(offset).limit(limit)
    # names only for the page: a handful of players per match
    names = players.join(F.broadcast(page.select("match_id")), "match_id").groupBy("match_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "display_name"))),
                                 lambda p: p["display_name"]), " vs ").alias("names"))
    return page.join(names, "match_id", "left").withColumn("seconds", F.col("duration_frames") / F.col("fps"))


def metric_series(metrics: DataFrame, players: DataFrame, key: str) -> DataFrame:
    """One metric of every named player over its matches, in ingest order."""
    return metrics.filter(F.col("key") == key).join(players, ["match_id", "slot"]).select(
        "display_name", "match_id", "slot", "value")


def profile_characters(players: DataFrame, me: DataFrame, limit: int = 8) -> DataFrame:
    """The characters a player is seen with most. ``me`` holds one name."""
    mine = players.join(F.broadcast(me.select("display_name")), "display_name", "left_semi")
    return mine.groupBy("character_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "character_id").limit(limit)


def profile_rates(metrics: DataFrame, players: DataFrame, me: DataFrame, keys: list[str]) -> DataFrame:
    """Exact medians of rates, the player's against everybody else's. ``me`` holds one name."""
    tagged = metrics.filter(F.col("key").isin(keys)).join(players, ["match_id", "slot"]).join(
        F.broadcast(me.select("display_name", F.lit(True).alias("_me"))), "display_name", "left").withColumn(
        "mine", F.coalesce("_me", F.lit(False)))
    m = medians(tagged, ["key", "mine"], "value")
    both = m.groupBy("key").agg(F.max(F.when(F.col("mine"), F.col("median"))).alias("mine"),
                                F.max(F.when(~F.col("mine"), F.col("median"))).alias("others"))
    return both.withColumn("pct_diff", F.try_divide(F.col("mine") - F.col("others"), F.col("others")) * 100)
