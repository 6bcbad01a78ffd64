"""Contradictions between facts: one row per named check, and contract errors per document."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.operators.seq import along, blocked
from boutline.operators.skew import spread_join


def _tally(df: DataFrame, checks: dict, example) -> DataFrame:
    """One pass over a table for all its checks: rows seen, rows failed, smallest failing example."""
    aggs = []
    for name, ok in checks.items():
        bad = ~F.coalesce(ok, F.lit(False))
        aggs.append(F.struct(F.lit(name).alias("check"), F.count("*").alias("n"), F.count_if(bad).alias("failed"),
                             F.min(F.when(bad, example.cast("string"))).alias("example")))
    return df.agg(F.array(*aggs).alias("_c")).select(F.explode("_c").alias("c")).select("c.*")


SLACK = 120  # frames after the end in which an event still counts as within the match


def audit(matches, players, inputs, kos, moments, metrics, actions, slack: int = SLACK) -> DataFrame:
    """Named checks with rows seen, failures, pass rate and an example. An event of an unknown slot contradicts nothing."""
    size = players.groupBy("match_id").agg(F.count("*").alias("_players"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.count_distinct("slot").alias("slots"))
    bounds = matches.groupBy("match_id").agg(F.count("*").alias("copies"), F.max("duration_frames").alias("dur"))
    per_match = bounds.join(size, "match_id", "left")
    m = _tally(per_match, {
        "match_id unique": F.col("copies") == 1, "has players": F.coalesce(F.col("_players"), F.lit(0)) > 0, "duration positive": F.col("dur") > 0,
        "slots contiguous from 0": (F.col("lo") == 0) & (F.col("hi") == F.col("slots") - 1) & (F.col("slots") == F.col("_players"))}, F.col("match_id"))
    slots = players.select("match_id", "slot", F.lit(True).alias("known")).distinct()
    model = F.broadcast(actions.select("action", F.lit(True).alias("modelled")))  # one row per action of a game
    owners = slots.join(bounds.select("match_id", "dur"), "match_id", "full")
    length = owners.groupBy("match_id").agg(F.max("dur").alias("dur"), F.collect_set(F.when(F.col("known"), F.col("slot"))).alias("_slots"))  # slots of one match
    known = F.col("slot").isNull() | F.coalesce(F.array_contains("_slots", F.col("slot")), F.lit(False))
    end = F.col("dur") + slack
    i = _tally(spread_join(inputs, length, ["match_id"], "left").withColumn("known", known).join(model, "action", "left"), {
        "inputs within duration": F.col("frame").between(0, end), "inputs map to a slot": F.col("known"), "inputs have a known action": F.col("modelled")}, F.col("seq"))
    k = _tally(spread_join(kos, length, ["match_id"], "left").withColumn("known", known), {
        "kos within duration": F.col("frame").between(0, end), "kos map to a slot": F.col("known")}, F.col("seq"))
    mo = _tally(moments, {"severity 1 to 5": F.col("severity").between(1, 5), "moment frame not negative": F.col("frame") >= 0}, F.col("match_id"))
    me = _tally(metrics.filter("key = 'apm'"), {"apm 0 to 900": F.col("value").between(0, 900)}, F.col("match_id"))
    return reduce(DataFrame.unionByName, (m, i, k, mo, me)).withColumn("rate", F.try_divide(F.col("n") - F.col("failed"), F.col("n")))


def audit_more(matches, players, inputs, kos, moments, metrics, results, provenance, characters, errors, *, slack: int = SLACK, width: int = 4096) -> DataFrame:
    """The checks that look across facts, in the form of `audit`. ``results(match_id, slot, place)`` are final places, 1 the best;
    ``provenance(match_id, kos)`` what a document claims; ``characters(character_id)`` those a game has; ``errors(match_id, errors)`` the
    contract's. Checks about results see only matches that have some, the one about the winner only those with a KO and two places."""
    length = matches.groupBy("match_id").agg(F.max("duration_frames").alias("dur"), F.max("fps").alias("fps"))
    heroes = characters.select("character_id", F.lit(True).alias("has")).distinct()
    p = _tally(players.filter("character_id is not null").join(heroes, "character_id", "left"), {"hero id in table": F.col("has")}, F.col("match_id"))

    order = along(blocked(inputs.select("match_id", F.coalesce("slot", F.lit(-1)).alias("slot"), "seq", "frame"), "seq", width), ["match_id", "slot"], ["seq"], prev={"_f": F.col("frame")})
    steps = order.groupBy("match_id").agg(F.coalesce(F.bool_and(F.col("frame") >= F.col("_f")), F.lit(True)).alias("ordered"))
    i = _tally(steps, {"inputs ordered per slot": F.col("ordered")}, F.col("match_id"))

    slots = players.groupBy("match_id").agg(F.collect_set("slot").alias("_slots"))  # slots of one match
    placed = results.groupBy("match_id").agg(F.count("*").alias("n"), F.count_distinct("place").alias("places"), F.min_by("slot", F.struct("place", "slot")).alias("winner"), F.collect_set("slot").alias("_keys"))
    fell = kos.filter("slot is not null").groupBy("match_id", "slot").agg(F.count("*").alias("k"), F.min(F.struct("frame", "seq")).alias("first"))
    most = fell.groupBy("match_id").agg(F.min_by("slot", F.struct(-F.col("k"), "first")).alias("worst"))
    ranked = placed.join(slots, "match_id", "left").join(most, "match_id", "left")
    r = _tally(ranked, {"result keys are slots": F.size(F.array_except("_keys", "_slots")) == 0, "result ranks distinct": F.col("places") == F.col("n")}, F.col("match_id"))
    w = _tally(ranked.filter("worst is not null and n > 1"), {"winner is not the most KO'd": F.col("winner") != F.col("worst")}, F.col("match_id"))

    within = spread_join(moments, length, ["match_id"], "left").groupBy("match_id").agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.bool_and(F.col("frame").between(0, F.col("dur") + slack)).alias("within"))
    m = _tally(within, {"moment ids unique": F.col("n") == F.col("ids"), "moments within duration": F.col("within")}, F.col("match_id"))
    minutes = metrics.filter("key = 'minutes'").join(length, "match_id")
    t = _tally(minutes, {"metric minutes as duration": F.abs(F.col("value") * 60 * F.col("fps") - F.col("dur")) < F.col("fps") * 30}, F.col("match_id"))
    fallen = kos.select("match_id", F.lit(True).alias("fell")).distinct()
    h = _tally(provenance.join(fallen, "match_id", "left"), {"kos confidence honest": (F.col("kos").eqNullSafe("high")) == F.col("fell").isNotNull()}, F.col("match_id"))
    e = _tally(errors, {"schema valid": F.size("errors") == 0}, F.col("match_id"))
    return reduce(DataFrame.unionByName, (p, i, r, w, m, t, h, e)).withColumn("rate", F.try_divide(F.col("n") - F.col("failed"), F.col("n")))


def contract_errors(matches: DataFrame, players: DataFrame, inputs: DataFrame) -> DataFrame:
    """Contract violations of each match as a list: required values, minima, patterns, unknown slots."""
    slots = players.select("match_id", "slot").distinct()
    lost = spread_join(inputs, slots, ["match_id", "slot"], "left_anti").groupBy("match_id").agg(F.count("*").alias("lost"))
    j = matches.join(lost, "match_id", "left")
    rules = [
        (F.col("patch").isNull(), "patch is required"),
        (~F.coalesce(F.col("patch").rlike(r"^v\d+$"), F.lit(True)), "patch does not look like a version"),
        (F.coalesce("duration_frames", F.lit(-1)) < 0, "duration_frames below minimum"),
        (F.col("fps") < 1, "fps below minimum"),
        (F.col("lost") > 0, "inputs of an unknown slot"),
    ]
    return j.select("match_id", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(msg)) for c, msg in rules])).alias("errors"))


def monotone(stamps: DataFrame, keys: list[str], *, limit: int = 16, lo=0, hi=10**9, width: int = 1024) -> DataFrame:
    """Groups whose values rise strictly or fall strictly in index order, at most ``limit`` long and in range.
    ``stamps(keys, idx, value)``."""
    seen = along(blocked(stamps, "idx", width), keys, ["idx"], prev={"_p": F.col("value")})
    step = F.col("value") - F.col("_p")
    return seen.groupBy(*keys).agg(
        F.count("*").alias("n"),
        (F.coalesce(F.bool_and(step > 0), F.lit(True)) | F.coalesce(F.bool_and(step < 0), F.lit(True))).alias("one_way"),
        F.bool_and(F.col("value").between(lo, hi)).alias("in_range")).withColumn(
        "ok", F.col("one_way") & F.col("in_range") & (F.col("n") <= limit))
