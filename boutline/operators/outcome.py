"""Who is in a match, who died, who won."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boutline.operators.skew import spread_join


def credit_victims(kills: DataFrame, players: DataFrame) -> DataFrame:
    """A log that credits the killer: in a two-player match the victim is the other slot, otherwise unknown."""
    n = players.groupBy("match_id").agg(F.count("*").alias("_n"))
    return spread_join(kills, n, ["match_id"], "left").select(
        *[c for c in kills.columns if c != "killer"], F.col("killer").alias("by"),
        F.when(F.col("_n") == 2, 1 - F.col("killer")).alias("slot"))


def match_outcome(players: DataFrame, kos: DataFrame, results: DataFrame) -> DataFrame:
    """Win or loss per slot: fewer deaths wins a two-player match, else the higher raw result.

    ``results(match_id, slot, value)``. Equal deaths or equal results decide nothing.
    """
    deaths = kos.filter(F.col("slot").isNotNull()).groupBy("match_id", "slot").agg(F.count("*").alias("deaths"))
    seen = players.join(deaths, ["match_id", "slot"], "left").withColumn("deaths", F.coalesce("deaths", F.lit(0)))
    raw = results.groupBy("match_id", "slot").agg(F.max("value").alias("value"))
    seen = seen.join(raw, ["match_id", "slot"], "left")
    totals = seen.groupBy("match_id").agg(
        F.count("*").alias("_n"), F.min("deaths").alias("_lo"), F.max("deaths").alias("_hi"),
        F.count("value").alias("_nr"), F.min("value").alias("_vlo"), F.max("value").alias("_vhi"))
    joined = seen.join(totals, "match_id")
    by_deaths = (F.col("_n") == 2) & (F.col("_lo") != F.col("_hi"))
    by_result = ~by_deaths & (F.col("_nr") >= 2) & (F.col("_vlo") != F.col("_vhi"))
    return joined.select(
        "match_id", "slot", "deaths",
        F.when(by_deaths, F.when(F.col("deaths") == F.col("_hi"), "loss").otherwise("win"))
        .when(by_result & F.col("value").isNotNull(), F.when(F.col("value") == F.col("_vhi"), "win").otherwise("loss")).alias("outcome"),
        F.when(by_deaths, "deaths").when(by_result, "result_field").alias("source"))


def guard_kos(kos: DataFrame, inputs: DataFrame, slack: int = 120) -> DataFrame:
    """KOs inside the match: from frame 0 to the last input plus ``slack``."""
    last = inputs.groupBy("match_id").agg(F.max("frame").alias("_last"))
    return spread_join(kos, last, ["match_id"]).filter((F.col("frame") >= 0) & (F.col("frame") <= F.col("_last") + slack)).drop("_last")


def guard_results(results: DataFrame) -> DataFrame:
    """Results per match are kept only when all are plausible ranks and all differ: adds ``kept``."""
    plausible = F.col("value").between(1, 8) | F.col("value").isin(2048, 4096)
    verdict = results.groupBy("match_id").agg(
        (F.bool_and(plausible) & (F.count("*") == F.count_distinct("value"))).alias("kept"))
    return results.join(verdict, "match_id")


def plausible_streams(streams: DataFrame, *, first: int = 8, fallback: int = 4) -> DataFrame:
    """Streams that belong to the match, outliers dropped.

    ``streams(file, ord, span_ms, n)``: of the first eight, those under 30 minutes with 20 events; among
    them at least half the upper-median span and 15 % of the largest count. If none qualifies, the first
    four with 20 events. At most eight rows per file take part, so collecting them is bounded.
    """
    head = streams.filter(F.col("ord") < first)
    sane = (F.col("span_ms") > 0) & (F.col("span_ms") <= 30 * 60 * 1000) & (F.col("n") >= 20)
    ref = head.filter(sane).groupBy("file").agg(
        F.array_sort(F.collect_list("span_ms")).alias("_s"), F.max("n").alias("_max")).select(
        "file", F.expr("element_at(_s, int(size(_s) div 2 + 1))").alias("_ref"), "_max")
    judged = head.join(ref, "file", "left").withColumn("_good", F.coalesce(
        sane & (F.col("span_ms") >= F.col("_ref") * 0.5) & (F.col("n") >= F.col("_max") * 0.15), F.lit(False)))
    per = Window.partitionBy("file")
    few = F.row_number().over(per.orderBy(F.when(F.col("n") >= 20, 0).otherwise(1), "ord"))
    return judged.withColumn("_any", F.max("_good").over(per)).withColumn("_few", few).filter(
        F.col("_good") | (~F.col("_any") & (F.col("n") >= 20) & (F.col("_few") <= fallback))).select(*streams.columns)


def entity_slots(entities: DataFrame) -> DataFrame:
    """Slot ordinals of the entities of a match, by entity id, unknown last. A match has few entities."""
    order = Window.partitionBy("match_id").orderBy(F.col("entity_id").asc_nulls_last(), "ord")
    return entities.withColumn("slot", F.row_number().over(order) - 1)


def resolve_identity(slots: DataFrame, records: DataFrame, anchors: DataFrame) -> DataFrame:
    """Player names: the structural record of the entity wins, else the anchor at its position."""
    r = records.groupBy("match_id", "entity_id").agg(F.min_by("name", "ord").alias("_rn"))
    a = anchors.groupBy("match_id", "slot").agg(F.min_by("name", "ord").alias("_an"))
    return slots.join(r, ["match_id", "entity_id"], "left").join(a, ["match_id", "slot"], "left").select(
        "match_id", "slot", "entity_id", F.coalesce("_rn", "_an").alias("display_name"),
        F.when(F.col("_rn").isNotNull(), "structural").when(F.col("_an").isNotNull(), "anchor").alias("player_source"))
