"""Temporal joins: as-of and nearest without emitting pairs, intervals on time bins."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutline.operators.seq import BLOCK, along


def _right_rows(right, keys, rt, payload):
    """One right row per instant (the smallest payload), as (keys, _t, _r{_rt, payload})."""
    return (
        right.groupBy(*keys, F.col(rt).alias("_t"))
        .agg(F.min(F.struct(*[F.col(c) for c in payload])).alias("_p"))
        .select(*keys, "_t", F.struct(F.col("_t").alias("rt"), F.col("_p").alias("p")).alias("_r"))
    )


def _facing(left, right, keys, lt, rt, payload, width, back, ahead):
    """Left and right rows in one frame per (key, block): a right row also stands in every block whose left
    rows may look at it, ``back`` after it and ``ahead`` before it. Left rows stand in their own block only."""
    r = _right_rows(right, keys, rt, payload).withColumn("_left", F.lit(0)).withColumn(BLOCK, F.explode(F.sequence(
        F.floor((F.col("_t") - ahead) / F.lit(width)), F.floor((F.col("_t") + back) / F.lit(width)))))
    lrow = left.select(*keys, F.col(lt).cast("double").alias("_t"), F.lit(1).alias("_left"),
                       F.struct(*[F.col(c) for c in left.columns]).alias("_l"),
                       F.floor(F.col(lt) / F.lit(width)).alias(BLOCK))
    return lrow.unionByName(r, allowMissingColumns=True)


def _unpack(df, left, payload, hit, out):
    return df.filter(F.col("_left") == 1).select(
        *[F.col(f"_l.{c}").alias(c) for c in left.columns], hit["rt"].alias(f"{out}_t"),
        *[hit["p"][c].alias(f"{out}_{c}") for c in payload])


def asof(left: DataFrame, right: DataFrame, keys: list[str], lt: str, rt: str, payload: list[str], *,
         width: float, tolerance: float | None = None, forward: bool = False, out: str = "asof") -> DataFrame:
    """Each left row with the latest right row at or before it (``forward``: earliest at or after).

    Left rows without a partner inside ``tolerance`` are kept with NULLs. Ties on the right's time go to
    the smallest payload. One shuffle of both sides by (key, block); no pairs are built.
    """
    part = [*keys, BLOCK]
    if tolerance is not None:
        both = _facing(left, right, keys, lt, rt, payload, width, 0 if forward else tolerance, tolerance if forward else 0)
        if forward:
            w = Window.partitionBy(*part).orderBy(F.desc("_t"), "_left")
        else:
            w = Window.partitionBy(*part).orderBy("_t", "_left")
        seen = both.withColumn("_hit", F.last("_r", True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        near = F.abs(F.col("_t") - F.col("_hit.rt")) <= F.lit(tolerance)
        return _unpack(seen.withColumn("_hit", F.when(near, F.col("_hit"))), left, payload, F.col("_hit"), out)
    sign = -1 if forward else 1
    r = _right_rows(right, keys, rt, payload).withColumn("_left", F.lit(0))
    lrow = left.select(*keys, F.col(lt).cast("double").alias("_t"), F.lit(1).alias("_left"), F.struct(*[F.col(c) for c in left.columns]).alias("_l"))
    both = lrow.unionByName(r, allowMissingColumns=True).withColumn("_at", F.col("_t") * sign).withColumn(
        BLOCK, F.floor(F.col("_at") / F.lit(width)))
    return _unpack(along(both, keys, ["_at", "_left"], known={"_hit": F.col("_r")}), left, payload, F.col("_hit"), out)


def nearest(left: DataFrame, right: DataFrame, keys: list[str], lt: str, rt: str, payload: list[str], *,
            width: float, tolerance: float, out: str = "near") -> DataFrame:
    """Each left row with the right row at the smallest time distance within ``tolerance``; the earlier one on ties."""
    both = _facing(left, right, keys, lt, rt, payload, width, tolerance, tolerance)
    # running frames in both directions: each costs one pass over the block
    up = Window.partitionBy(*keys, BLOCK).orderBy("_t", "_left").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys, BLOCK).orderBy(F.desc("_t"), "_left").rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("_b", F.last("_r", True).over(up)).withColumn("_f", F.last("_r", True).over(down))
    gap_b, gap_f = F.col("_t") - F.col("_b.rt"), F.col("_f.rt") - F.col("_t")
    hit = (F.when((gap_b <= tolerance) & (gap_f.isNull() | (gap_b <= gap_f)), F.col("_b"))
           .when(gap_f <= tolerance, F.col("_f")))
    return _unpack(seen.withColumn("_hit", hit), left, payload, F.col("_hit"), out)


def any_within(left: DataFrame, right: DataFrame, keys: list[str], lo: str, hi: str, at: str, *, width: float, name: str = "met") -> DataFrame:
    """Left rows with a flag: does any right point lie in [lo, hi]?

    An interval looks at each block it touches for the latest point up to its own end there, so one pass over
    the block answers every interval and no pairs are built. Left rows must be distinct.
    """
    spans = left.select(*keys, F.struct(*left.columns).alias("_l"), F.lit(1).alias("_left"), F.col(lo).alias("_lo"), F.col(hi).alias("_hi"),
                        F.explode(F.sequence(F.floor(F.col(lo) / F.lit(width)), F.floor(F.col(hi) / F.lit(width)))).alias(BLOCK))
    looks = spans.withColumn("_t", F.least(F.col("_hi"), (F.col(BLOCK) + 1) * F.lit(float(width))))
    points = right.select(*keys, F.col(at).cast("double").alias("_t"), F.lit(0).alias("_left"),
                          F.floor(F.col(at) / F.lit(width)).alias(BLOCK)).distinct()
    both = looks.unionByName(points, allowMissingColumns=True)
    w = Window.partitionBy(*keys, BLOCK).orderBy("_t", "_left").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("_left") == 0, F.col("_t")), True).over(w)
    seen = both.withColumn("_last", last).filter("_left = 1").groupBy("_l").agg(
        F.bool_or(F.coalesce(F.col("_last") >= F.col("_lo"), F.lit(False))).alias(name))
    return seen.select("_l.*", name)


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], lo: Column, hi: Column, at: str, *,
                  width: float) -> DataFrame:
    """Left rows with an interval [lo, hi], right rows with a point ``at`` inside it.

    The interval is spread over the bins it touches and meets the points of each bin by an equi join, so a
    hot key is split by time. Callers aggregate points to one row per instant first where only counts matter.
    """
    spans = left.withColumn("_lo", lo).withColumn("_hi", hi).withColumn(
        "_bin", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))))
    points = right.withColumn("_bin", F.floor(F.col(at) / width)).withColumn("_at", F.col(at).cast("double"))
    return spans.join(points, [*keys, "_bin"]).filter(
        (F.col("_at") >= F.col("_lo")) & (F.col("_at") <= F.col("_hi"))).drop("_bin", "_lo", "_hi", "_at")
