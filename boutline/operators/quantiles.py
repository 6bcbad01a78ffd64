"""Exact order statistics of groups of any size.

``percentile`` keeps every distinct value of a group in one task. Here values are counted first, an
approximate sketch (bounded size) proposes cut points, exact counts per interval tell which interval holds
the wanted rank, and only that interval's values are ranked.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutline.operators.settle import settle
from boutline.operators.skew import spread_join

CUTS = 256


def order_stats(df: DataFrame, keys: list[str], value: str, ranks: dict[str, "Column"]) -> DataFrame:
    """Values at 1-based ranks of each group's non-NULL values; a rank is a column over ``n``, the group size."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    counted = settle(counted)  # read by the sketch, the interval counts and the ranking
    sketch = counted.groupBy(*keys).agg(
        F.sum("_c").alias("n"),
        F.array_distinct(F.percentile_approx("_v", [i / CUTS for i in range(1, CUTS)], 4 * CUTS)).alias("_cuts"))
    placed = spread_join(counted, sketch.select(*keys, "_cuts"), keys).select(
        *keys, "_v", "_c", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_b"))
    totals = placed.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"))
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    named = F.array(*[F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, r in ranks.items()])
    wanted = (
        totals.withColumn("_before", F.coalesce(F.sum("_bc").over(upto), F.lit(0)))
        .join(sketch.select(*keys, "n"), keys)
        .withColumn("_w", F.explode(named))
        .filter((F.col("_w.rank") > F.col("_before")) & (F.col("_w.rank") <= F.col("_before") + F.col("_bc")))
        .groupBy(*keys, "n", "_b", "_before").agg(F.collect_list("_w").alias("_ws"))  # at most len(ranks) items
    )
    run = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    hit = (
        placed.join(wanted, [*keys, "_b"])
        .withColumn("_to", F.col("_before") + F.sum("_c").over(run))
        .withColumn("_w", F.explode("_ws"))
        .filter((F.col("_w.rank") > F.col("_to") - F.col("_c")) & (F.col("_w.rank") <= F.col("_to")))
    )
    return hit.groupBy(*keys, "n").agg(*[
        F.max(F.when(F.col("_w.name") == k, F.col("_v"))).alias(k) for k in ranks])


def medians(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per group, the mean of the middle two for even sizes."""
    n = F.col("n")
    got = order_stats(df, keys, value, {"_lo": F.floor((n + 1) / 2), "_hi": F.floor(n / 2) + 1})
    return got.select(*keys, "n", ((F.col("_lo") + F.col("_hi")) / 2).alias(name))
