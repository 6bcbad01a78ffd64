"""Event-log queries: presses, moments and their ranking."""

import uuid

from pyspark.sql import functions as F

from boutline.functions import games
from boutline.operators import moments as M
from boutline.operators.settle import shared_folder
from boutline.plans.registry import query
from boutline.plans.testviews import FRAME_BLOCK

WASTED_SQL = """gaps AS (SELECT *, frame - lag(frame) OVER (PARTITION BY match_id, slot, action ORDER BY frame, seq) AS gap FROM v_inputs),
  wasted AS (SELECT g.*, a.busy, coalesce(a.busy > 0 AND g.gap < a.busy, false) AS wasted FROM gaps g LEFT JOIN v_actions a USING (action))"""

MOMENTS_SQL = WASTED_SQL + """,
  fw AS (SELECT *, count(*) OVER (PARTITION BY match_id, slot ORDER BY frame RANGE BETWEEN UNBOUNDED PRECEDING AND 60 FOLLOWING)
           - row_number() OVER (PARTITION BY match_id, slot ORDER BY frame, seq) + 1 AS presses FROM v_inputs),
  nx AS (SELECT *, lead(frame) OVER (PARTITION BY match_id, slot ORDER BY frame, seq) - frame AS gap FROM v_inputs),
  moments AS (
    SELECT match_id, slot, frame, seq, 'wasted_input' AS kind, 1 AS severity, gap AS amount, 'Wasted ' || action || ' input' AS title
      FROM wasted WHERE wasted
    UNION ALL SELECT match_id, slot, frame, seq, 'burst', 2, presses, 'Burst of ' || presses || ' inputs' FROM fw WHERE presses >= 3
    UNION ALL SELECT match_id, slot, frame, seq, 'idle', 1, gap, 'Idle for ' || gap || ' frames' FROM nx WHERE gap >= 108
    UNION ALL SELECT match_id, slot, frame, seq, 'ko', 5, NULL, 'KO' FROM v_kos)"""

CLUSTERS_SQL = MOMENTS_SQL + """,
  inst AS (SELECT match_id, slot, kind, frame, count(*) AS n, max(severity) AS severity, min_by(title, seq) AS title
           FROM moments GROUP BY ALL),
  anc AS (SELECT match_id, slot, kind, min(frame) AS a FROM inst GROUP BY ALL
    UNION ALL SELECT c.match_id, c.slot, c.kind, min(i.frame) FROM anc c JOIN inst i USING (match_id, slot, kind)
      WHERE i.frame > c.a + 240 GROUP BY c.match_id, c.slot, c.kind, c.a),
  tagged AS (SELECT i.*, max(a) OVER (PARTITION BY i.match_id, i.slot, i.kind ORDER BY i.frame ROWS UNBOUNDED PRECEDING) AS run
     FROM inst i LEFT JOIN anc c ON i.match_id = c.match_id AND i.slot = c.slot AND i.kind = c.kind AND i.frame = c.a),
  merged AS (SELECT match_id, slot, kind, run AS frame, CAST(sum(n) AS BIGINT) AS "count", max(frame) AS "end",
     max(severity) AS sev, min_by(title, frame) AS t FROM tagged GROUP BY match_id, slot, kind, run),
  clusters AS (SELECT match_id, slot, kind, frame, "count", "end",
     CASE WHEN kind <> 'ko' AND "count" >= 4 THEN least(5, sev + 1) ELSE sev END AS severity,
     CASE WHEN kind <> 'ko' AND "count" > 1 THEN t || ' x' || "count" ELSE t END AS title FROM merged)"""


def moments_of(t):
    return M.detect_moments(t.inputs, t.kos, t.action_model, burst_count=3, width=FRAME_BLOCK)


BITS = {0: "AimUp", 1: "AimDown", 2: "Left", 3: "Right"}


@query("press_edges", """WITH h AS (SELECT match_id, slot AS stream, epoch_us(ts) // 1000 AS ts_ms, bit_or(CAST(event_id % 16 AS INTEGER)) AS state FROM (SELECT user_id // 2 AS match_id, CAST(user_id % 2 AS INTEGER) AS slot, ts, event_id FROM events) GROUP BY 1, 2, 3),
  b AS (SELECT * FROM (VALUES (0, 'AimUp'), (1, 'AimDown'), (2, 'Left'), (3, 'Right')) v(bit, action)),
  e AS (SELECT match_id, stream, ts_ms, bit, action, (state >> bit) & 1 AS on_, coalesce(lag((state >> bit) & 1) OVER (PARTITION BY match_id, stream, bit ORDER BY ts_ms), 0) AS was FROM h, b)
  SELECT match_id, stream, ts_ms, bit, action FROM e WHERE on_ = 1 AND was = 0""")
def _(t):
    ms = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) div 1000")
    held = t.events.select(F.expr("user_id div 2").alias("match_id"), (F.col("user_id") % 2).cast("int").alias("stream"), ms.alias("ts_ms"), (F.col("event_id") % 16).cast("int").alias("state")).groupBy(
        "match_id", "stream", "ts_ms").agg(F.bit_or("state").alias("state"))
    return M.press_edges(held, BITS, 7 * 24 * 3600 * 1000)


@query("game_load", """WITH h AS (SELECT user_id // 2 AS match_id, CAST(user_id % 2 AS INTEGER) AS slot, epoch_us(ts) // 1000 AS frame, bit_or(CAST(event_id % 16 AS INTEGER)) AS state FROM events GROUP BY 1, 2, 3),
  b AS (SELECT * FROM (VALUES (0, 'Up'), (1, 'Down'), (2, 'Left'), (3, 'Fire')) v(bit, action)),
  e AS (SELECT match_id, slot, action, (state >> bit) & 1 AS on_, coalesce(lag((state >> bit) & 1) OVER (PARTITION BY match_id, slot, bit ORDER BY frame), 0) AS was FROM h, b)
  SELECT match_id, slot, action, count(*) AS presses FROM e WHERE on_ = 1 AND was = 0 GROUP BY 1, 2, 3""")
def _(t):
    """Pads written as replay files of a game, a folder a match, loaded by the game's name and turned into presses by its own bits."""
    folder = f"{shared_folder(t.spark).rstrip('/')}/replays-{uuid.uuid4().hex}"
    ms = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) div 1000")
    held = t.events.select(F.expr("user_id div 2").alias("match_id"), (F.col("user_id") % 2).cast("int").alias("slot"), ms.alias("frame"), (F.col("event_id") % 16).cast("int").alias("state")).groupBy(
        "match_id", "slot", "frame").agg(F.bit_or("state").alias("state"))
    lines = held.select("match_id", F.concat_ws(" ", "frame", "slot", "state").alias("value"))
    lines.repartition("match_id").write.partitionBy("match_id").text(folder)
    game = games.get("text_pad")
    rows = game.load(t.spark, folder, extension=".txt").select(F.regexp_extract("path", "match_id=([0-9]+)", 1).cast("long").alias("match_id"), F.col("slot").alias("stream"), F.col("frame").alias("ts_ms"), "state")
    edges = M.press_edges(rows, game.bits, 7 * 24 * 3600 * 1000)
    return edges.groupBy("match_id", F.col("stream").alias("slot"), "action").agg(F.count("*").alias("presses"))


@query("wasted_input", f"WITH RECURSIVE {WASTED_SQL} SELECT match_id, slot, frame, seq, action, gap FROM wasted WHERE wasted")
def _(t):
    return M.wasted_inputs(t.inputs, t.action_model, FRAME_BLOCK).filter("wasted").select(
        "match_id", "slot", "frame", "seq", "action", "gap")


@query("wasted_rate_by_slot", f"""WITH RECURSIVE {WASTED_SQL} SELECT match_id, slot, count(*) AS presses,
  count(*) FILTER (WHERE wasted) AS wasted, round(count(*) FILTER (WHERE wasted) / count(*)::DOUBLE, 6) AS rate
  FROM wasted GROUP BY 1, 2""")
def _(t):
    return M.wasted_inputs(t.inputs, t.action_model, FRAME_BLOCK).groupBy("match_id", "slot").agg(
        F.count("*").alias("presses"), F.count_if("wasted").alias("wasted"),
        F.round(F.count_if("wasted") / F.count("*"), 6).alias("rate"))


@query("burst", f"WITH RECURSIVE {MOMENTS_SQL} SELECT match_id, slot, frame, seq, presses FROM fw WHERE presses >= 3")
def _(t):
    return M.bursts(t.inputs, 60, 3, FRAME_BLOCK)


@query("idle", f"WITH RECURSIVE {MOMENTS_SQL} SELECT match_id, slot, frame, seq, gap FROM nx WHERE gap >= 108")
def _(t):
    return M.idles(t.inputs, 108, FRAME_BLOCK)


@query("moments", f"WITH RECURSIVE {MOMENTS_SQL} SELECT * FROM moments")
def _(t):
    return moments_of(t)


@query("moment_cluster", f"WITH RECURSIVE {CLUSTERS_SQL} SELECT * FROM clusters")
def _(t):
    return M.cluster_moments(moments_of(t), 240, FRAME_BLOCK)


@query("top_moments", f"""WITH RECURSIVE {CLUSTERS_SQL} SELECT * FROM (SELECT *, row_number() OVER
  (PARTITION BY match_id ORDER BY severity DESC, frame, slot, kind) AS "rank" FROM clusters) WHERE "rank" <= 18""")
def _(t):
    return M.top_moments(M.cluster_moments(moments_of(t), 240, FRAME_BLOCK), 18)
