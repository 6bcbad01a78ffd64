"""Windowed activity over whole tables, and the online detectors run as a stream over them."""

import uuid

from pyspark.sql import functions as F

from boutline.operators.settle import shared_folder
from boutline.plans.log_queries import MOMENTS_SQL, WASTED_SQL
from boutline.plans.registry import query
from boutline.plans.testviews import BUSY_FRAMES
from boutline.streaming import detect as D
from boutline.streaming import online as S
from boutline.streaming.watch import watch_table


@query("stream_apm", """SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n, round(count(*) / 1440.0::DOUBLE, 9) AS apm FROM events GROUP BY 1, 2""")
def _(t):
    return S.activity(t.events, ["user_id"], "1 day").select("user_id", F.col("start").cast("timestamp_ntz").alias("day"), "n", F.round("apm", 9).alias("apm"))


@query("sliding_counts", """WITH w AS (SELECT event_type, h, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS h FROM events) GROUP BY 1, 2)
   SELECT event_type, h AS start, n FROM w""")
def _(t):
    return S.activity(t.events, ["event_type"], "2 hours", "1 hour").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("session_counts", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events),
   r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM r GROUP BY user_id, run""")
def _(t):
    return S.sessions(t.events, ["user_id"], "6 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


LATE_ALL = "10 minutes"  # of event time at 60 frames a second: more than the views span, so that any order of the files is in time


@query("stream_wasted", f"WITH RECURSIVE {WASTED_SQL} SELECT match_id, slot, frame, seq, action, gap FROM wasted WHERE wasted")
def _(t):
    return drained(t, parts(t, 3), lambda s: D.wasted_presses(s, BUSY_FRAMES, LATE_ALL)).filter("kind = 'wasted'").select("match_id", "slot", "frame", "seq", "action", "gap")


@query("stream_idle", f"WITH RECURSIVE {MOMENTS_SQL} SELECT match_id, slot, frame, seq, gap FROM nx WHERE gap >= 108")
def _(t):
    return drained(t, parts(t, 3), lambda s: D.idle_stretches(s, 108, LATE_ALL)).filter("kind = 'idle'").select("match_id", "slot", "frame", "seq", "gap")


@query("stream_late", """WITH seen AS (SELECT max(CAST(trunc(frame * (1000 / 60.0::DOUBLE)) AS BIGINT)) - 20000 AS mark FROM v_inputs WHERE seq % 5 <> 0)
   SELECT match_id, count(*) AS late FROM v_inputs, seen WHERE seq % 5 = 0 AND CAST(trunc(frame * (1000 / 60.0::DOUBLE)) AS BIGINT) < mark GROUP BY match_id""")
def _(t):
    """A fifth of the rows comes in a second file: what is then more than 20 seconds behind is late, and counted."""
    files = [t.inputs.filter("seq % 5 <> 0"), t.inputs.filter("seq % 5 = 0")]
    return drained(t, files, lambda s: D.wasted_presses(s, BUSY_FRAMES, "20 seconds")).filter("kind = 'late'").groupBy("match_id").agg(F.count("*").alias("late"))


def parts(t, n: int) -> list:
    """The inputs dealt out at random, so that every part spans all of the time."""
    return [t.inputs.filter(F.pmod(F.xxhash64("seq"), F.lit(n)) == k) for k in range(n)]


def drained(t, files, detector):
    """What a detector yields from a folder into which ``files`` come one after another, each a batch of its own, through a parquet sink
    in the shared folder."""
    out = f"{shared_folder(t.spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    for rows in files:
        rows.coalesce(1).write.mode("append").parquet(f"{out}/in")
    found = detector(watch_table(t.spark, f"{out}/in", t.inputs.schema, files_per_batch=1))
    start = lambda: found.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    D.run_to_end(start, lambda: D.end_marker(t.spark, t.inputs.schema, 10**9).write.mode("append").parquet(f"{out}/in"))
    return t.spark.read.schema(found.schema).parquet(f"{out}/rows")
