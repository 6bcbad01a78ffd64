"""Exchanges that killed a player: press groups, committed options, tendencies, payoffs, the better choice."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutline.functions.payoffs import DEFENDER_LABEL, Exchange
from boutline.functions.scalars import DEFAULT_STARTUP
from boutline.operators.damage import damage_at
from boutline.operators.seq import anchored_runs
from boutline.operators.settle import settle
from boutline.operators.timejoin import interval_join


def move_facts(moves: DataFrame) -> DataFrame:
    """Startup (an assumed one, flagged, where it did not resolve), recovery on a whiff and cooldown per move."""
    startup = F.nullif(F.col("startup"), F.lit(0))
    return moves.select(
        "weapon", "move", F.coalesce(startup, F.lit(DEFAULT_STARTUP)).alias("startup"),
        (F.coalesce("recover_miss", F.lit(0)) + F.coalesce("fixedrec_miss", F.lit(0))).alias("whiff"),
        F.coalesce("cooldown", F.lit(0)).alias("cooldown"), F.coalesce(startup > 0, F.lit(False)).alias("known"))


def weapon_facts(moves: DataFrame) -> DataFrame:
    """One row per weapon with the moves the payoff model looks at; a missing move is slow and unknown."""
    facts = move_facts(moves)
    absent = F.struct(F.lit(99).alias("startup"), F.lit(0).alias("whiff"), F.lit(False).alias("known"))

    def pick(move):
        return F.coalesce(F.max(F.when(F.col("move") == move, F.struct("startup", "whiff", "known"))), absent).alias(move)

    return facts.groupBy("weapon").agg(*[pick(m) for m in ("sair", "dair", "gp", "recovery")]).select(
        "weapon", F.struct("sair", "dair", "gp", "recovery").alias("facts"))


def payoff_cells(contexts: DataFrame, model: type[Exchange] = Exchange) -> DataFrame:
    """25 cells per context row (columns mine, theirs, my_damage, their_damage).
    Another game brings its own payoffs as a model with the same ``rows`` column."""
    ex = model(F.col("mine"), F.col("theirs"), F.col("my_damage"), F.col("their_damage"))
    keep = [c for c in contexts.columns if c not in ("mine", "theirs")]
    return contexts.select(*keep, F.explode(ex.rows()).alias("_c")).select(*keep, "_c.*")


def expected_values(cells: DataFrame, tendencies: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Value of each defender option against a tendency, over the attacker options both sides know."""
    return cells.join(tendencies, [*by, "a"]).groupBy(*keys, "d", "ord").agg(
        F.sum(F.col("score") * F.col("p")).alias("ev"), F.min("row_confidence").alias("confidence"),
        F.max_by("why", F.struct("p", "a")).alias("why"))


def frame_sets(inputs: DataFrame) -> DataFrame:
    """Actions of a slot per frame; a set holds at most a game's vocabulary."""
    return inputs.groupBy("match_id", "slot", "frame").agg(F.array_sort(F.collect_set("action")).alias("acts"))


def press_groups(frames: DataFrame, keys: list[str], pair_frames: int = 6, width: int = 4096) -> DataFrame:
    """Presses within ``pair_frames`` of a group's first are one group: (keys, frame, acts)."""
    runs = anchored_runs(frames, keys, "frame", pair_frames, width, ["acts"])
    return runs.groupBy(*keys, F.col("run_start").alias("frame")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("acts")))).alias("acts"))  # pair_frames + 1 sets at most


def _has(acts: Column, *names: str) -> Column:
    return F.arrays_overlap(acts, F.array(*[F.lit(n) for n in names]))


def defender_option(acts: Column) -> Column:
    return (F.when(_has(acts, "Heavy") & _has(acts, "AimUp", "UpJump"), "recovery").when(_has(acts, "Dodge"), "airdodge")
            .when(_has(acts, "Light", "Heavy"), "contest").when(_has(acts, "Jump", "UpJump"), "doublejump"))


def attacker_option(acts: Column) -> Column:
    """Attack options only; both can be mistaken for another one. Movement is no option."""
    return F.when(_has(acts, "Heavy") & _has(acts, "AimDown"), "deep_dair").when(_has(acts, "Light", "Heavy"), "ledge_sair")


def reviewed_slots(kos: DataFrame) -> DataFrame:
    """Per match the slot that died most (the one that died first on ties)."""
    n = kos.filter(F.col("slot").isNotNull()).groupBy("match_id", "slot").agg(F.count("*").alias("n"), F.min("frame").alias("first"))
    return n.groupBy("match_id").agg(F.max_by("slot", F.struct("n", (-F.col("first")).alias("f"), (-F.col("slot")).alias("s"))).alias("slot"))


def windowed_groups(windows: DataFrame, frames: DataFrame, window: int, pair_frames: int, width: int) -> DataFrame:
    """Press groups inside each window (match_id, slot, ko_frame), grouped afresh in every window."""
    met = interval_join(windows, frames, ["match_id", "slot"], F.col("ko_frame") - window, F.col("ko_frame"), "frame", width=window)
    return press_groups(met, ["match_id", "slot", "ko_frame"], pair_frames, width)


def committed_options(deaths: DataFrame, frames: DataFrame, window=180, pair_frames=6, width=4096) -> DataFrame:
    """Last defensive option each victim committed to before dying."""
    g = windowed_groups(deaths, frames, window, pair_frames, width).withColumn("option", defender_option(F.col("acts")))
    return g.filter("option is not null").groupBy("match_id", "slot", "ko_frame").agg(
        F.max_by("option", "frame").alias("option"), F.max("frame").alias("at_frame"), F.max_by("acts", "frame").alias("acts"))


def tendency(deaths: DataFrame, opponents: DataFrame, frames: DataFrame, window=180, pair_frames=6, width=4096) -> DataFrame:
    """What the opponent pressed while killing: share per attack option, and of windows without any attack."""
    spans = deaths.select("match_id", "ko_frame").join(opponents, "match_id").select("match_id", F.col("opp").alias("slot"), "ko_frame")
    g = windowed_groups(spans, frames, window, pair_frames, width).withColumn("a", attacker_option(F.col("acts"))).filter("a is not null")
    attacks = g.groupBy("match_id", "a").agg(F.count("*").alias("n"))
    hit = g.groupBy("match_id").agg(F.count_distinct("ko_frame").alias("_hit"))
    waits = spans.groupBy("match_id").agg(F.count("*").alias("_all")).join(hit, "match_id", "left").select(
        "match_id", F.lit("wait").alias("a"), (F.col("_all") - F.coalesce("_hit", F.lit(0))).alias("n")).filter("n > 0")
    counts = attacks.unionByName(waits)
    total = counts.groupBy("match_id").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("a") != "wait", F.col("n")).otherwise(0)).alias("_amb"))
    return counts.join(total, "match_id").select("match_id", "a", "n", (F.col("n") / F.col("total")).alias("p"), "total",
                                                 (F.col("_amb") / F.col("total")).alias("ambiguous"))


def _only(facts: DataFrame) -> DataFrame:
    """The one row there must be; none or several is an error of the caller's."""
    rows = facts.agg(F.collect_list("facts").alias("f"))
    return rows.select(F.when(F.size("f") == 1, F.get("f", F.lit(0))).otherwise(F.raise_error(F.lit("facts must be one row"))).alias("facts"))


def with_facts(deaths: DataFrame, facts: DataFrame) -> DataFrame:
    """``deaths(match_id, slot, opp, ...)`` with the weapon facts of both players, ``mine`` and ``theirs``."""
    mine = facts.select("match_id", "slot", F.col("facts").alias("mine"))
    theirs = facts.select("match_id", F.col("slot").alias("opp"), F.col("facts").alias("theirs"))
    return deaths.join(mine, ["match_id", "slot"]).join(theirs, ["match_id", "opp"])


def review_deaths(kos, players, inputs, readings, facts, *, fps=60, window=180, pair_frames=6, width=4096) -> DataFrame:
    """Each death of the reviewed player: what was chosen, what it was worth, what was worth most.

    ``facts(match_id, slot, facts)`` are those of each player's weapon; deaths of a match where one of the two has none are left out. One row
    with a ``facts`` struct alone is the weapon assumed for both sides of every match.
    """
    who = reviewed_slots(kos)
    opp = players.join(who.withColumnRenamed("slot", "me"), "match_id").filter(F.col("slot") != F.col("me")).groupBy("match_id").agg(
        F.min("slot").alias("opp"))
    deaths = settle(kos.join(who, ["match_id", "slot"]).select("match_id", "slot", F.col("frame").alias("ko_frame")).distinct())
    opp = settle(opp)
    frames = frame_sets(inputs)
    tend = tendency(deaths, opp, frames, window, pair_frames, width)
    chosen = committed_options(deaths, frames, window, pair_frames, width).join(opp, "match_id").withColumn(
        "seconds", F.col("at_frame") / F.lit(float(fps)))
    mine = damage_at(chosen, readings).withColumnRenamed("damage", "my_damage").withColumnRenamed("slot", "me").withColumnRenamed("opp", "slot")
    both = damage_at(mine, readings).withColumnRenamed("damage", "their_damage").withColumnRenamed("slot", "opp").withColumnRenamed("me", "slot")
    key = ["match_id", "slot", "ko_frame", "option", "at_frame", "my_damage", "their_damage"]
    if "slot" in facts.columns:
        ctx = with_facts(both.select(*key, "opp"), facts).select(*key, "mine", "theirs")
    else:
        ctx = both.select(*key).join(F.broadcast(_only(facts)), how="cross").select(*key, F.col("facts").alias("mine"), F.col("facts").alias("theirs"))
    ev = expected_values(payoff_cells(ctx), tend.select("match_id", "a", "p"), key, ["match_id"])
    best = ev.groupBy(*key).agg(
        F.max_by(F.struct("d", "ev", "why"), F.struct("ev", (-F.col("ord")).alias("o"))).alias("_b"),
        F.max(F.when(F.col("d") == F.col("option"), F.col("ev"))).alias("ev"),
        F.max(F.when(F.col("d") == F.col("option"), F.col("confidence"))).alias("confidence"))
    label = F.create_map(*[x for k, v in DEFENDER_LABEL.items() for x in (F.lit(k), F.lit(v))])
    return best.select(*key, label[F.col("option")].alias("chose"), "ev", F.col("_b.d").alias("best"), F.col("_b.ev").alias("best_ev"),
                       (F.col("_b.ev") - F.col("ev")).alias("gap"), "confidence", F.col("_b.why").alias("why_best"))
