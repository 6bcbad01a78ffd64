"""What changes in the seconds before a death, compared with before a kill."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutline.operators.moments import wasted_inputs
from boutline.operators.timejoin import interval_join


def variance(n: Column, s: Column, q: Column, lo: Column, hi: Column) -> Column:
    """Population variance from count, sum and sum of squares; exactly zero when all values are equal."""
    return F.when(lo == hi, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), q / n - (s / n) * (s / n)))


def effect_size(mean_a: Column, var_a: Column, n_a: Column, mean_b: Column, var_b: Column, n_b: Column) -> Column:
    """Difference of means in pooled standard deviations; 0 without data on a side, a floor at zero spread."""
    spread = F.sqrt((var_a + var_b) / 2)
    return F.when((n_a == 0) | (n_b == 0), F.lit(0.0)).otherwise(
        (mean_a - mean_b) / F.when(spread == 0, F.lit(1e-9)).otherwise(spread))


def _exchanges(kos: DataFrame, players: DataFrame, inputs: DataFrame) -> DataFrame:
    """One row per player, instant and kind: a death when the player is the victim, else a kill."""
    active = inputs.select("match_id", "slot").distinct()
    who = players.join(active, ["match_id", "slot"]).select("match_id", F.col("slot").alias("me"), "display_name")
    return kos.groupBy("match_id", "slot", "frame").agg(F.count("*").alias("w")).join(who, "match_id").select(
        "match_id", F.col("me").alias("slot"), "display_name", "frame", "w",
        F.when(F.col("slot") == F.col("me"), "death").otherwise("kill").alias("kind")).groupBy(
        "match_id", "slot", "display_name", "frame", "kind").agg(F.sum("w").alias("w"))


def _two_sided(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    x, w = F.col(value), F.col("w")

    def side(kind, expr):
        return expr(F.col("kind") == kind)

    return df.groupBy(*keys).agg(*[
        agg for k in ("death", "kill") for agg in (
            F.sum(F.when(F.col("kind") == k, w * x)).alias(f"s_{k}"), F.sum(F.when(F.col("kind") == k, w * x * x)).alias(f"q_{k}"),
            F.sum(F.when(F.col("kind") == k, w)).alias(f"m_{k}"), F.min(F.when(F.col("kind") == k, x)).alias(f"lo_{k}"),
            F.max(F.when(F.col("kind") == k, x)).alias(f"hi_{k}"))])


def pressure_actions(kos, players, inputs, tracked: list[str], *, window=300) -> DataFrame:
    """Mean presses per tracked action in the window before deaths and kills of every named player."""
    ex = _exchanges(kos, players, inputs)
    n = ex.groupBy("display_name").agg(F.sum(F.when(F.col("kind") == "death", F.col("w")).otherwise(0)).alias("deaths"),
                                       F.sum(F.when(F.col("kind") == "kill", F.col("w")).otherwise(0)).alias("kills"))
    grid = inputs.groupBy("match_id", "slot", "action", F.col("frame").alias("at")).agg(F.count("*").alias("n"))
    met = interval_join(ex, grid, ["match_id", "slot"], F.col("frame") - window, F.col("frame"), "at", width=window)
    per = met.groupBy("match_id", "slot", "display_name", "frame", "kind", "w", "action").agg(F.sum("n").alias("x"))
    whole = per.groupBy("match_id", "slot", "display_name", "frame", "kind", "w").agg(F.sum("x").alias("x")).withColumn("action", F.lit("TOTAL"))
    sums = _two_sided(per.unionByName(whole), ["display_name", "action"], "x")
    rows = n.filter("deaths > 0").withColumn("action", F.explode(F.array(*[F.lit(a) for a in (*tracked, "TOTAL")]))).join(
        sums, ["display_name", "action"], "left")

    def stats(k, total):
        s, q = F.coalesce(f"s_{k}", F.lit(0)), F.coalesce(f"q_{k}", F.lit(0))
        lo = F.when(F.coalesce(f"m_{k}", F.lit(0)) < total, F.lit(0)).otherwise(F.col(f"lo_{k}"))
        hi = F.coalesce(f"hi_{k}", F.lit(0))
        size = F.nullif(total.cast("double"), F.lit(0.0))
        return F.coalesce(s / size, F.lit(0.0)), F.coalesce(variance(size, s, q, lo, hi), F.lit(0.0))

    md, vd = stats("death", F.col("deaths"))
    mk, vk = stats("kill", F.col("kills"))
    return rows.select("display_name", "action", "deaths", "kills", md.alias("before_death"), mk.alias("before_kill"),
                       F.coalesce(F.try_divide((md - mk) * 100, mk), F.lit(0.0)).alias("pct_diff"),
                       effect_size(md, vd, F.col("deaths"), mk, vk, F.col("kills")).alias("effect"))


def pressure_quality(kos, players, inputs, actions, *, action, window=300, width=65536) -> DataFrame:
    """How many presses of the committed action the game discarded in those windows. The flag looks at the
    whole sequence, not only at the window."""
    ex = _exchanges(kos, players, inputs)
    dims = actions.filter(F.col("action") == action)
    grid = wasted_inputs(inputs.filter(F.col("action") == action), dims, width).groupBy(
        "match_id", "slot", F.col("frame").alias("at")).agg(F.count("*").alias("n"), F.count_if("wasted").alias("bad"))
    met = interval_join(ex, grid, ["match_id", "slot"], F.col("frame") - window, F.col("frame"), "at", width=window)
    per = met.groupBy("match_id", "slot", "display_name", "frame", "kind", "w").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("rate", F.col("bad") / F.col("n"))
    sums = _two_sided(per, ["display_name"], "rate")
    counts = per.groupBy("display_name").agg(*[
        F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("w") * F.col(c))), F.lit(0)).alias(f"{c}_{k}")
        for k in ("death", "kill") for c in ("n", "bad")])

    def stats(k):
        m = F.coalesce(F.col(f"m_{k}"), F.lit(0))
        size = F.nullif(m.cast("double"), F.lit(0.0))
        return (F.coalesce(F.col(f"s_{k}") / size, F.lit(0.0)), F.coalesce(variance(
            size, F.col(f"s_{k}"), F.col(f"q_{k}"), F.col(f"lo_{k}"), F.col(f"hi_{k}")), F.lit(0.0)), m)

    md, vd, nd = stats("death")
    mk, vk, nk = stats("kill")
    return sums.join(counts, "display_name").select(
        "display_name",
        F.col("bad_death").alias("wasted_death"), F.col("n_death").alias("total_death"), md.alias("mean_death"),
        F.col("bad_kill").alias("wasted_kill"), F.col("n_kill").alias("total_kill"), mk.alias("mean_kill"),
        effect_size(md, vd, nd, mk, vk, nk).alias("effect"))


def death_context(kos: DataFrame, inputs: DataFrame, window: int = 300) -> DataFrame:
    """Inputs of both slots in the window before each death, one row per instant and action."""
    deaths = kos.filter(F.col("slot").isNotNull()).select("match_id", F.col("slot").alias("victim"), F.col("frame").alias("ko_frame")).distinct()
    grid = inputs.groupBy("match_id", "slot", "frame", "action").agg(F.count("*").alias("n"))
    lo = F.greatest(F.lit(0), F.col("ko_frame") - window)
    return interval_join(deaths, grid, ["match_id"], lo, F.col("ko_frame"), "frame", width=window)


def death_waste(kos: DataFrame, inputs: DataFrame, actions: DataFrame, *, window=300, width=65536) -> DataFrame:
    """Presses and wasted presses of the victim before each death, judged inside the window only."""
    deaths = kos.select("match_id", "slot", F.col("frame").alias("ko_frame")).distinct()
    grid = wasted_inputs(inputs, actions, width).groupBy(
        "match_id", "slot", F.col("frame").alias("at"),
        F.when(F.col("wasted"), F.col("frame") - F.col("gap")).alias("prior")).agg(F.count("*").alias("n"))
    lo = F.greatest(F.lit(0), F.col("ko_frame") - window)
    met = interval_join(deaths, grid, ["match_id", "slot"], lo, F.col("ko_frame"), "at", width=window)
    got = met.groupBy("match_id", "slot", "ko_frame").agg(
        F.sum("n").alias("presses"), F.sum(F.when(F.col("prior") >= lo, F.col("n")).otherwise(0)).alias("wasted"))
    return deaths.join(got, ["match_id", "slot", "ko_frame"], "left").select(
        "match_id", "slot", "ko_frame", F.coalesce("presses", F.lit(0)).alias("presses"), F.coalesce("wasted", F.lit(0)).alias("wasted"))
