"""Sequence operators that never put a whole key into one task.

A key (a match, a capture side) may hold any share of the rows. Every operator therefore works on
*blocks*: stretches of the position axis, ``floor(position / width)``. Rows are shuffled once by
(key, block); what a block needs to know about the ones before it is one summary row per block, which
is aggregated map-side and looked up by an equi join on the same (key, block) partitioning.

Key columns must not be NULL (callers coalesce unknown slots first); position is never NULL.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_block"


def blocked(df: DataFrame, position, width: float) -> DataFrame:
    """Add the block number of ``position``."""
    return df.withColumn(BLOCK, F.floor(F.col(position) / F.lit(width)))


def along(df: DataFrame, keys: list[str], order: list[str], *, prev=None, known=None, total=None,
          peak=None) -> DataFrame:
    """Add values carried along each key, in ``order`` (a total order, block-monotone, ascending).

    prev   {name: column}  the value on the previous row (NULL on the first)
    known  {name: column}  the last non-NULL value on an earlier row
    total  {name: column}  the sum over all earlier rows (0 on the first)
    peak   {name: column}  the maximum over all earlier rows

    Numbers under a single order column keep the block summaries in a hash aggregate; structs, strings and
    several order columns make Spark sort for them. Two values of one row are better passed as two columns.
    """
    prev, known, total, peak = prev or {}, known or {}, total or {}, peak or {}
    part = [*keys, BLOCK]
    at = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])
    here = Window.partitionBy(*part).orderBy(*order)
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    blocks_before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)

    # helper columns first, so one projection feeds both branches
    work = df.select(
        "*",
        *[c.alias(f"_p_{n}") for n, c in prev.items()],
        *[c.alias(f"_k_{n}") for n, c in known.items()],
        *[c.alias(f"_t_{n}") for n, c in total.items()],
        *[c.alias(f"_m_{n}") for n, c in peak.items()],
    )
    has = {n: F.col(f"_k_{n}").isNotNull() for n in known}
    summary = work.groupBy(*part).agg(
        *[F.max_by(f"_p_{n}", at).alias(f"_p_{n}") for n in prev],
        *[F.max_by(F.when(has[n], F.col(f"_k_{n}")), F.when(has[n], at)).alias(f"_k_{n}") for n in known],
        *[F.sum(f"_t_{n}").alias(f"_t_{n}") for n in total],
        *[F.max(f"_m_{n}").alias(f"_m_{n}") for n in peak],
    )
    carried = summary.select(
        *part,
        *[F.lag(f"_p_{n}").over(Window.partitionBy(*keys).orderBy(BLOCK)).alias(f"_cp_{n}") for n in prev],
        *[F.last(f"_k_{n}", True).over(blocks_before).alias(f"_ck_{n}") for n in known],
        *[F.sum(f"_t_{n}").over(blocks_before).alias(f"_ct_{n}") for n in total],
        *[F.max(f"_m_{n}").over(blocks_before).alias(f"_cm_{n}") for n in peak],
    )
    local = work.select(
        *df.columns,
        *([F.lag(F.lit(True)).over(here).alias("_inside")] if prev else []),
        *[F.lag(f"_p_{n}").over(here).alias(f"_lp_{n}") for n in prev],
        *[F.last(f"_k_{n}", True).over(before).alias(f"_lk_{n}") for n in known],
        *[F.sum(f"_t_{n}").over(before).alias(f"_lt_{n}") for n in total],
        *[F.max(f"_m_{n}").over(before).alias(f"_lm_{n}") for n in peak],
    )
    both = local.join(carried, part, "left")
    zero = F.lit(0)
    return both.select(
        *df.columns,
        *[F.when(F.col("_inside"), F.col(f"_lp_{n}")).otherwise(F.col(f"_cp_{n}")).alias(n) for n in prev],
        *[F.coalesce(f"_lk_{n}", f"_ck_{n}").alias(n) for n in known],
        *[(F.coalesce(F.col(f"_lt_{n}"), zero) + F.coalesce(F.col(f"_ct_{n}"), zero)).alias(n) for n in total],
        *[F.greatest(f"_lm_{n}", f"_cm_{n}").alias(n) for n in peak],
    )


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Number the runs of each key: ``starts`` is true on the first row of a run."""
    flag = F.when(starts, 1).otherwise(0).cast("long")
    out = along(df.withColumn("_start", flag), keys, order, total={"_runs": F.col("_start")})
    return out.withColumn(name, F.col("_runs") + F.col("_start")).drop("_runs", "_start")


def cut_runs(df: DataFrame, keys: list[str], position: str, breaks_from: str, width: float,
             payload: list[str] | None = None, name: str = "run_start") -> DataFrame:
    """Greedy runs whose cut depends on where the run began.

    A row opens a new run iff its ``breaks_from`` position is at or after the start of the open run
    (NULL never breaks), so an anchored gap ``g`` on integers is ``breaks_from = position - g - 1``.
    ``position`` must be unique within a key. Returns keys, position, payload and the run's start.

    Three steps: each block is summarised as a function from the run start it is entered with to the
    one it is left with; those functions are applied block after block (one small row per block);
    each block is then replayed from its known entry.
    """
    payload = payload or []
    part = [*keys, BLOCK]
    row = F.struct(F.col(position).alias("p"), F.col(breaks_from).alias("q"),
                   *[F.col(c).alias(f"x_{c}") for c in payload])
    blocks = (
        df.withColumn(BLOCK, F.floor(F.col(position) / F.lit(width)))
        .groupBy(*part)
        .agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    )

    def replay(start, rows):
        """Fold the run start over the rows, from a given start."""
        return F.aggregate(rows, start, lambda s, x: F.when((x["p"] > s) & (x["q"] >= s), x["p"]).otherwise(s))

    pos_type = dict(df.dtypes)[position]
    first = F.col("_rows")[0]["p"]
    # The first row to break an entry start s is the first whose q >= s. Only rows that raise the running
    # maximum of q can be that row, and once q reaches the block's own first position none is left.
    record_type = f"array<struct<reach:{pos_type},p:{pos_type}>>"
    records = F.aggregate(
        F.col("_rows"),
        F.struct(F.lit(None).cast(pos_type).alias("top"), F.lit(None).cast(record_type).alias("list")),
        lambda acc, x: F.when(
            x["q"].isNotNull() & (acc["top"].isNull() | (x["q"] > acc["top"])) & F.coalesce(acc["top"] < first, F.lit(True)),
            F.struct(
                x["q"].alias("top"),
                F.concat(F.coalesce(acc["list"], F.array().cast(record_type)),
                         F.array(F.struct(x["q"].alias("reach"), x["p"].alias("p")))).alias("list"),
            ),
        ).otherwise(acc),
    )["list"]
    moves = blocks.withColumn("_records", F.coalesce(records, F.array().cast(record_type))).select(
        *part,
        replay(first, F.col("_rows")).alias("_fresh"),
        first.alias("_first"),
        F.transform("_records", lambda r: F.struct(r["reach"].alias("reach"), replay(r["p"], F.col("_rows")).alias("leave"))).alias("_moves"),
    )
    entry_type = f"array<struct<b:bigint,s:{pos_type}>>"
    entries = (
        moves.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct(F.col(BLOCK).alias("b"), F.col("_fresh").alias("fresh"),
                                                  F.col("_moves").alias("moves")))).alias("_blocks"))
        .select(*keys, F.explode(F.aggregate(
            F.col("_blocks"),
            F.struct(F.lit(None).cast(pos_type).alias("s"), F.array().cast(entry_type).alias("seen")),
            lambda acc, x: F.struct(
                F.when(acc["s"].isNull(), x["fresh"]).otherwise(F.coalesce(
                    F.get(F.filter(x["moves"], lambda m: m["reach"] >= acc["s"]), F.lit(0))["leave"], acc["s"])).alias("s"),
                F.concat(acc["seen"], F.array(F.struct(x["b"].alias("b"), acc["s"].alias("s")))).alias("seen"),
            ),
        )["seen"]).alias("_e"))
        .select(*keys, F.col("_e.b").alias(BLOCK), F.col("_e.s").alias("_entry"))
    )
    starts = F.aggregate(
        F.col("_rows"),
        F.array(F.coalesce(F.col("_entry"), first)),
        lambda acc, x: F.when((x["p"] > F.element_at(acc, -1)) & (x["q"] >= F.element_at(acc, -1)),
                              F.concat(acc, F.array(x["p"]))).otherwise(acc),
    )
    return (
        blocks.join(entries, part)
        .withColumn("_starts", starts)
        .select(*keys, "_starts", F.explode("_rows").alias("_r"))
        .select(*keys, F.col("_r.p").alias(position), *[F.col(f"_r.x_{c}").alias(c) for c in payload],
                F.expr("element_at(filter(_starts, s -> s <= _r.p), -1)").alias(name))
    )


def anchored_runs(df: DataFrame, keys: list[str], position: str, gap: float, width: float,
                  payload: list[str] | None = None, name: str = "run_start") -> DataFrame:
    """Runs anchored on their first member: a row more than ``gap`` after the run's start opens a new one.
    ``position`` is an integer frame, unique within a key."""
    marked = df.withColumn("_q", F.col(position) - F.lit(int(gap)) - F.lit(1))
    return cut_runs(marked, keys, position, "_q", width, payload, name)


def debounce(df: DataFrame, keys: list[str], order: list[str], value: str, hold: int, name: str = "stable", number: str | None = None) -> DataFrame:
    """A value counts once it has held ``hold`` rows; until then the last stable value stands, or the key's first.
    ``number`` names a column for the row's place in its key, from 1."""
    changed = along(df, keys, order, prev={"_pv": F.col(value)}, total={"_n": F.lit(1).cast("long")})
    changed = changed.withColumn("_new", (F.col("_n") == 0) | ~F.col("_pv").eqNullSafe(F.col(value)))
    # row number of the open run's first row
    runs = along(changed, keys, order, known={"_rs": F.when(F.col("_new"), F.col("_n"))})
    runs = runs.withColumn("_len", F.col("_n") - F.when(F.col("_new"), F.col("_n")).otherwise(F.col("_rs")) + 1)
    held = F.when(F.col("_len") >= hold, F.struct(F.col(value).alias("v")))
    firsts = F.when(F.col("_n") == 0, F.struct(F.col(value).alias("v")))
    out = along(runs, keys, order, known={"_ls": held, "_fv": firsts})
    pick = F.coalesce(held, F.col("_ls"), F.col("_fv"), firsts)
    out = out.withColumn(number, F.col("_n") + 1) if number else out
    return out.withColumn(name, pick["v"]).drop("_pv", "_new", "_n", "_rs", "_len", "_ls", "_fv")
