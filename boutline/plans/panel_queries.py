"""Panel samples: segments, freezes, moves, openings, combos, captions and the input log."""

from pyspark.sql import functions as F

from boutline.operators import panel as P
from boutline.operators.quantiles import order_stats
from boutline.operators.seq import blocked, debounce
from boutline.plans.registry import near, query
from boutline.plans.testviews import SECOND_BLOCK

B = SECOND_BLOCK

SCORED_SQL = """scored AS (SELECT video, floor(t * 4) / 4 AS t, CASE WHEN count(*) % 7 <> 0 THEN min(value) / 25.0 END AS score
   FROM (SELECT match_id // 5 AS video, t, value FROM v_ticks) GROUP BY 1, 2)"""


def scored(t):
    return t._ticks.groupBy(F.expr("match_id div 5").alias("video"), (F.floor(F.col("t") * 4) / 4).alias("t")).agg(
        F.when(F.count("*") % 7 != 0, F.min("value") / 25.0).alias("score"))


@query("segments", f"""WITH {SCORED_SQL}, f AS (SELECT *, coalesce(score > 0.5, false) AS is_on, count(*) FILTER (WHERE NOT coalesce(score > 0.5, false)) OVER (PARTITION BY video ORDER BY t) AS off FROM scored),
   r AS (SELECT video, off, min(t) + 0.125 AS start, max(t) + 0.25 - 0.125 AS "end" FROM f WHERE is_on GROUP BY 1, 2) SELECT video, start, "end" FROM r WHERE "end" - start >= 0.5""")
def _(t):
    return P.score_segments(scored(t), step=0.25, trim=0.125, min_len=0.5, width=B)


@query("scan_merge", """SELECT match_id // 5 AS video, floor(t * 4) / 4 AS t, arg_max(value, seq) AS score FROM v_ticks GROUP BY 1, 2""")
def _(t):
    return P.scan_merge(t._ticks.select(F.expr("match_id div 5").alias("video"), (F.floor(F.col("t") * 4) / 4).alias("t"),
                                        F.col("value").alias("score"), F.col("seq").alias("run")))


FIELDS = ["damage", "combo", "recovery", "startup", "active", "total"]
SPAN_FIELDS = ["combo", "recovery"]
WIDE_FIELDS = [f"{s}_{f}" for s in "lr" for f in SPAN_FIELDS]
WIDE_SQL = "wide AS (SELECT segment, t, " + ", ".join(
    f"max({f} // 40) FILTER (WHERE side = '{s.upper()}') AS {s}_{f}" for s in "lr" for f in SPAN_FIELDS) + " FROM v_samples GROUP BY 1, 2)"


def runs_sql(name: str, src: str, keys: str) -> str:
    """Greedy runs of src(keys, t, q): a row opens a run iff q is at or after the open run's start."""
    on = " AND ".join(f"x.{k.strip()} = y.{k.strip()}" for k in keys.split(","))
    xk = ", ".join(f"x.{k.strip()}" for k in keys.split(","))
    return f"""{name} AS (SELECT {keys}, min(t) AS s FROM {src} GROUP BY ALL
     UNION ALL SELECT {xk}, min(y.t) FROM {name} x JOIN {src} y ON {on} WHERE y.t > x.s AND y.q >= x.s GROUP BY {xk}, x.s)"""


def _known(cols, part, order="t"):
    return ", ".join(f"last_value(CASE WHEN {c} IS NOT NULL THEN {{'t': t, 'v': {c}}} END IGNORE NULLS) OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k_{c}" for c in cols)


@query("frozen_spans", f"""WITH RECURSIVE {WIDE_SQL}, kn AS (SELECT *, {_known(WIDE_FIELDS, 'segment')} FROM wide),
   q AS (SELECT segment, t, greatest({', '.join(f"CASE WHEN k_{f}.v <> {f} THEN k_{f}.t END" for f in WIDE_FIELDS)}) AS q FROM kn),
   {runs_sql('r', 'q', 'segment')},
   a AS (SELECT q.segment, q.t, (SELECT max(s) FROM r WHERE r.segment = q.segment AND r.s <= q.t) AS s FROM q)
   SELECT segment, s AS start, max(t) AS "end", count(*) AS samples, max(t) - s >= 0.3 AS frozen FROM a GROUP BY 1, 2""")
def _(t):
    wide = t.samples.groupBy("segment", "t").agg(*[
        F.max(F.when(F.col("side") == s.upper(), F.expr(f"{f} div 40").cast("int"))).alias(f"{s}_{f}") for s in "lr" for f in SPAN_FIELDS])
    return P.frozen_spans(wide, WIDE_FIELDS, hold=0.3, width=B)


MOVES_SQL = f"""mv AS (SELECT *, {_known(['startup', 'total'], 'segment, side')} FROM v_samples WHERE NOT frozen AND (startup IS NOT NULL OR total IS NOT NULL)),
   mq AS (SELECT *, greatest(CASE WHEN k_startup.v <> startup THEN k_startup.t END, CASE WHEN k_total.v > total THEN k_total.t END) AS q FROM mv),
   {runs_sql('mr', 'mq', 'segment, side')},
   ma AS (SELECT mq.*, (SELECT max(s) FROM mr WHERE mr.segment = mq.segment AND mr.side = mq.side AND mr.s <= mq.t) AS s FROM mq),
   moves AS (SELECT segment, side, s AS t, max(t) AS until, count(*) AS samples, max(startup) AS startup, max(active) AS active, max(total) AS total,
     arg_max(damage, t) FILTER (WHERE damage IS NOT NULL) AS damage, arg_max(combo, t) FILTER (WHERE combo IS NOT NULL) AS combo,
     arg_max(recovery, t) FILTER (WHERE recovery IS NOT NULL) AS recovery FROM ma GROUP BY 1, 2, 3)"""


@query("moves", f"WITH RECURSIVE {MOVES_SQL} SELECT * FROM moves")
def _(t):
    return P.moves(t.samples, width=B)


STUCK_SQL = """lv AS (SELECT *, row_number() OVER (PARTITION BY segment, side ORDER BY t) AS i FROM v_samples WHERE NOT frozen),
   rd AS (SELECT *, lag(i) OVER w AS pi, lag(recovery) OVER w AS pv FROM lv WHERE recovery IS NOT NULL WINDOW w AS (PARTITION BY segment, side ORDER BY t)),
   sk AS (SELECT *, sum(CASE WHEN pv <= -6 AND i - pi <= 6 THEN 0 ELSE 1 END) OVER (PARTITION BY segment, side ORDER BY t) AS run FROM rd WHERE recovery <= -6),
   stuck AS (SELECT segment, side, min(t) AS first_seen, max(t) AS "end", min(recovery) AS worst FROM sk GROUP BY segment, side, run)"""

OPENINGS_SQL = f"""{MOVES_SQL}, {STUCK_SQL},
   openings AS (SELECT segment, CASE side WHEN 'L' THEN 'R' ELSE 'L' END AS free, side AS stuck, "end" - -worst / 59.94::DOUBLE AS start, "end", first_seen, -worst AS frames FROM stuck w
     WHERE -worst >= 12 AND NOT EXISTS (SELECT 1 FROM moves m WHERE m.segment = w.segment AND m.side <> w.side AND m.t BETWEEN w."end" - -worst / 59.94::DOUBLE - 0.3 AND w."end" + 0.3))"""


def openings_of(t):
    return P.openings(P.stuck_windows(t.samples, width=B), P.moves(t.samples, width=B), width=B)


@query("stuck_windows", f"WITH {STUCK_SQL} SELECT * FROM stuck")
def _(t):
    return P.stuck_windows(t.samples, width=B)


@query("openings", f"WITH RECURSIVE {OPENINGS_SQL} SELECT * FROM openings")
def _(t):
    return openings_of(t)


EVENTS_SQL = f"""{OPENINGS_SQL},
   oe AS (SELECT *, max("end") OVER (PARTITION BY segment, free ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM openings),
   og AS (SELECT *, sum(CASE WHEN start - reach <= 1.5 THEN 0 ELSE 1 END) OVER (PARTITION BY segment, free ORDER BY start, "end") AS run FROM oe),
   events_ AS (SELECT segment, free, min(start) AS start, max("end") AS "end", count(*) AS windows, max(frames) AS frames, arg_max("end", (frames, -start, -"end")) AS anchor,
     arg_max(stuck, (frames, -start, -"end")) AS stuck, list_sort(list("end")) AS members, max("end") - min(start) AS span FROM og GROUP BY segment, free, run)"""


def events_of(t):
    return P.stall_events(openings_of(t), gap=1.5, width=B)


@query("stall_events", f"""WITH RECURSIVE {EVENTS_SQL} SELECT segment, free, stuck, round(start, 6) AS start, "end", windows, frames, anchor, len(members) AS n_members, members[1] AS first_member, round(span, 6) AS span FROM events_""")
def _(t):
    return events_of(t).select("segment", "free", "stuck", F.round("start", 6).alias("start"), "end", "windows", "frames", "anchor",
                               F.size("members").cast("long").alias("n_members"), F.get("members", F.lit(0)).alias("first_member"), F.round("span", 6).alias("span"))


@query("openings_summary", f"""WITH RECURSIVE {EVENTS_SQL}, lt AS (SELECT segment, count(*) FILTER (WHERE NOT frozen) / 10.0::DOUBLE AS live FROM v_samples GROUP BY 1)
  SELECT segment // 5 AS video, sum(CASE WHEN e.segment IS NULL THEN 0 ELSE 1 END)::BIGINT AS events, coalesce(sum(frames), 0)::BIGINT AS frames, round(coalesce(sum(frames), 0) / 59.94::DOUBLE, 6) AS seconds,
    max(windows) AS biggest_cluster, round(coalesce(sum(frames), 0) / 59.94::DOUBLE / any_value(lv), 6) AS share
   FROM (SELECT segment FROM lt) s LEFT JOIN events_ e USING (segment) JOIN (SELECT segment // 5 AS video, sum(live) AS lv FROM lt GROUP BY 1) v ON v.video = segment // 5 GROUP BY 1""")
def _(t):
    live = t.samples.groupBy("video").agg((F.count_if(~F.col("frozen")) / 10.0).alias("_live"))
    per = events_of(t).groupBy(F.expr("segment div 5").alias("video")).agg(
        F.count("*").alias("events"), F.sum("frames").alias("frames"), F.max("windows").alias("biggest_cluster"))
    z = F.lit(0)
    return live.join(per, "video", "left").select(
        "video", F.coalesce("events", z).alias("events"), F.coalesce("frames", z).alias("frames"), F.round(F.coalesce("frames", z) / P.FPS, 6).alias("seconds"),
        "biggest_cluster", F.round(F.coalesce("frames", z) / P.FPS / F.col("_live"), 6).alias("share"))


HITS_SQL = """cl AS (SELECT *, lag(combo) OVER w AS pv, count(*) FILTER (WHERE combo = 0) OVER w AS zr FROM v_samples WHERE NOT frozen AND combo IS NOT NULL WINDOW w AS (PARTITION BY segment, side ORDER BY t)),
   ce AS (SELECT *, coalesce(combo = damage, false) OR coalesce(pv > 0 AND combo < pv, false) AS hard FROM cl WHERE combo <> 0 AND (pv IS NULL OR pv <> combo)),
   cf AS (SELECT * FROM ce WHERE hard OR pv IS NOT NULL),
   cs AS (SELECT *, hard OR lag(zr) OVER (PARTITION BY segment, side ORDER BY t) IS DISTINCT FROM zr AS st FROM cf),
   ci AS (SELECT *, sum(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY segment, side ORDER BY t) AS cid FROM cs),
   hits AS (SELECT segment, side, cid, t, combo AS total, row_number() OVER c AS hit, coalesce(lag(combo) OVER c, 0) AS before, hard FROM ci WINDOW c AS (PARTITION BY segment, side, cid ORDER BY t)),
   combos AS (SELECT segment, side, cid, min(t) AS t0, max(t) AS t1, arg_max(total, t) AS damage, count(*) AS hits, NOT arg_min(hard, t) AS first_hit_inferred, max(t) - min(t) AS span FROM hits GROUP BY 1, 2, 3)"""

COMBO_COLS = ["segment", "side", "t0", "t1", "damage", "hits", "first_hit_inferred", "span"]


@query("combos", f"WITH {HITS_SQL} SELECT {', '.join(COMBO_COLS)} FROM combos")
def _(t):
    return P.combos(P.combo_hits(t.samples, width=B)).select(*COMBO_COLS)


@query("combo_hits", f"WITH {HITS_SQL} SELECT segment, side, t, total, hit, before FROM hits")
def _(t):
    return P.combo_hits(t.samples, width=B).select("segment", "side", "t", "total", F.col("hit").cast("long").alias("hit"), "before")


CAPS_SQL = "caps AS (SELECT match_id AS segment, CASE slot WHEN 0 THEN 'L' ELSE 'R' END AS side, t, seq FROM v_ticks WHERE event_type = 'purchase' AND value >= 30)"


def captions(t):
    return t._ticks.filter("event_type = 'purchase' and value >= 30").select(
        F.col("match_id").alias("segment"), F.when(F.col("slot") == 0, "L").otherwise("R").alias("side"), "t", "seq")


PUNISH_SQL = f"""{HITS_SQL}, {CAPS_SQL},
   pj AS (SELECT k.*, h.t AS ht, h.hit, h.before, c.damage, c.hits, c.t0, c.span, row_number() OVER (PARTITION BY k.seq ORDER BY h.t DESC) AS rn FROM caps k
     LEFT JOIN hits h ON h.segment = k.segment AND h.side = k.side AND h.t BETWEEN k.t - 2.5 AND k.t LEFT JOIN combos c ON c.segment = h.segment AND c.side = h.side AND c.cid = h.cid),
   punishes AS (SELECT segment, side, t, seq, hit AS hit_index, damage, hits, t0, span, t - ht AS caption_lag, damage - before AS from_punish_on FROM pj WHERE rn = 1)"""


def punishes_of(t):
    hits = P.combo_hits(t.samples, width=B)
    return P.punish_join(captions(t), hits, P.combos(hits), width=B)


@query("punish_join", f"WITH {PUNISH_SQL} SELECT segment, side, t, seq, CAST(hit_index AS INTEGER) AS hit_index, damage, hits, t0, round(span, 6) AS span, round(caption_lag, 6) AS caption_lag, from_punish_on FROM punishes")
def _(t):
    return punishes_of(t).withColumn("span", F.round("span", 6)).withColumn("caption_lag", F.round("caption_lag", 6))


@query("combo_summary", f"""WITH {HITS_SQL}, x AS (SELECT segment // 5 AS video, damage, hits FROM combos)
   SELECT video, count(*) AS combos, median(damage)::DOUBLE AS median, list_sort(list(damage))[CAST(floor(0.9 * count(*)) AS INTEGER) + 1]::DOUBLE AS p90, max(damage) AS biggest, sum(hits)::BIGINT AS hits,
     round(count(*) FILTER (WHERE hits <= 1) / count(*)::DOUBLE, 6) AS one_hit_share FROM x GROUP BY 1""")
def _(t):
    c = P.combos(P.combo_hits(t.samples, width=B)).withColumn("video", F.expr("segment div 5"))
    n = F.col("n")
    stats = order_stats(c, ["video"], "damage", {"lo": F.floor((n + 1) / 2), "hi": F.floor(n / 2) + 1, "p90": F.floor(n * 0.9) + 1})
    sums = c.groupBy("video").agg(F.count("*").alias("combos"), F.max("damage").alias("biggest"), F.sum("hits").alias("hits"),
                                  F.round(F.count_if(F.col("hits") <= 1) / F.count("*"), 6).alias("one_hit_share"))
    return sums.join(stats, "video").select("video", "combos", ((F.col("lo") + F.col("hi")) / 2).alias("median"), "p90", "biggest", "hits", "one_hit_share")


@query("combo_check", """WITH c AS (SELECT segment, damage, combo, combo - lag(combo) OVER (PARTITION BY segment, side ORDER BY t) AS rise FROM v_samples WHERE NOT frozen AND combo IS NOT NULL)
   SELECT segment, count(*) FILTER (WHERE rise = damage) AS matching, count(*) FILTER (WHERE rise <> damage) AS not_matching, count(*) FILTER (WHERE rise <> damage AND rise % damage = 0) AS exact_multiple,
     round(count(*) FILTER (WHERE rise = damage) / count(*)::DOUBLE, 6) AS share_ok FROM c WHERE rise > 0 AND damage <> 0 AND combo <> damage GROUP BY 1""")
def _(t):
    return P.combo_check(t.samples, width=B).withColumn("share_ok", F.round("share_ok", 6))


LOG_SQL = """g AS (SELECT *, lag(held) OVER w AS h, min(t) OVER (PARTITION BY segment, side) AS first FROM v_samples WHERE NOT frozen WINDOW w AS (PARTITION BY segment, side ORDER BY t)),
   ge AS (SELECT segment, side, t AS t_end, h AS held, first FROM g WHERE held <= h AND abs(row1 - h) <= 6),
   input_log AS (SELECT segment, side, coalesce(lag(t_end) OVER (PARTITION BY segment, side ORDER BY t_end), first) AS t, held, held >= 10 AS capped, t_end FROM ge)"""


def log_of(t):
    return P.input_log(t.samples, cap=10, width=B)


@query("input_log", f"WITH {LOG_SQL} SELECT * FROM input_log")
def _(t):
    return log_of(t)


@query("hold_histogram", f"""WITH {LOG_SQL}, s AS (SELECT count(*) AS n, median(held)::DOUBLE AS median, list_sort(list(held))[CAST(floor(0.9 * count(*)) AS INTEGER) + 1]::DOUBLE AS p90, max(held) AS longest FROM input_log)
   SELECT least(held, 8) AS held, count(*) AS inputs, any_value(n) AS n, any_value(median) AS median, any_value(p90) AS p90, any_value(longest) AS longest FROM input_log, s GROUP BY 1""")
def _(t):
    log = log_of(t)
    n = F.col("n")
    one = log.withColumn("_all", F.lit(0))
    stats = order_stats(one, ["_all"], "held", {"lo": F.floor((n + 1) / 2), "hi": F.floor(n / 2) + 1, "p90": F.floor(n * 0.9) + 1, "longest": n})
    hist = one.groupBy("_all", F.least("held", F.lit(8)).alias("held")).agg(F.count("*").alias("inputs"))
    return hist.join(stats, "_all").select("held", "inputs", "n", ((F.col("lo") + F.col("hi")) / 2).alias("median"), "p90", F.col("longest").cast("int").alias("longest"))


@query("finding_inputs", f"""WITH RECURSIVE {EVENTS_SQL}, {LOG_SQL},
   m AS (SELECT e.segment, e.free, e.start, e."end", count(l.t) AS inputs, max(l.held) AS longest, bool_or(l.capped) AS any_capped, array_to_string(list_transform(list((l.t, l.held) ORDER BY l.t, l.held) FILTER (WHERE l.t IS NOT NULL), lambda x: x[2])[:8], ',') AS holds
     FROM events_ e LEFT JOIN input_log l ON l.segment = e.segment AND l.side = e.free AND l.t BETWEEN e.start - 0.2 AND e."end" + 0.2 GROUP BY 1, 2, 3, 4)
   SELECT segment, free, round(start, 6) AS start, "end", inputs, longest, any_capped, holds, inputs = 0 AS nothing_entered FROM m""")
def _(t):
    return P.finding_inputs(events_of(t), log_of(t)).select("segment", "free", F.round("start", 6).alias("start"), "end", "inputs", "longest", "any_capped", "holds", "nothing_entered")


TEAL_SQL = "teal AS (SELECT match_id AS segment, t, max(CAST(floor(value) AS INTEGER)) AS teal FROM v_ticks GROUP BY 1, 2)"
CAPEV_SQL = TEAL_SQL + """, tg AS (SELECT *, t - lag(t) OVER (PARTITION BY segment ORDER BY t) AS gap FROM teal WHERE teal >= 40),
   ts AS (SELECT *, sum(CASE WHEN gap <= 1.2 THEN 0 ELSE 1 END) OVER (PARTITION BY segment ORDER BY t) AS run FROM tg),
   capev AS (SELECT segment, min(t) AS first, max(t) AS last, arg_max(t, (teal, -t)) AS t, max(teal) AS teal, max(t) - min(t) AS span FROM ts GROUP BY segment, run)"""


def caption_events_of(t):
    teal = t._ticks.groupBy(F.col("match_id").alias("segment"), "t").agg(F.max(F.floor("value").cast("int")).alias("teal"))
    return P.caption_events(teal, level=40, gap=1.2, width=B)


@query("caption_events", f"WITH {CAPEV_SQL} SELECT segment, first, last, t, teal, round(span, 6) AS span FROM capev")
def _(t):
    return caption_events_of(t).withColumn("span", F.round("span", 6))


READS_SQL = """reads AS (SELECT match_id AS segment, floor(t) AS t, CASE slot WHEN 0 THEN 'L' ELSE 'R' END AS side, (seq % 37) / 100.0::DOUBLE AS d, (seq % 11) / 100.0::DOUBLE AS margin, event_type AS word FROM v_ticks)"""
BEST_SQL = READS_SQL + """, cb AS (SELECT segment, t, side, min((d, word, margin)) FILTER (WHERE d <= 0.17 AND margin >= 0.02) AS g, min((d, word, margin)) AS a FROM reads GROUP BY 1, 2, 3),
   best AS (SELECT segment, CAST(t AS BIGINT) AS t, side, coalesce(g[1], a[1]) AS d, coalesce(g[3], a[3]) AS margin, coalesce(g[2], '?') AS word FROM cb)"""


def best_reads(t):
    reads = t._ticks.select(F.col("match_id").alias("segment"), F.floor("t").alias("t"), F.when(F.col("slot") == 0, "L").otherwise("R").alias("side"),
                            ((F.col("seq") % 37) / 100.0).alias("d"), ((F.col("seq") % 11) / 100.0).alias("margin"), F.col("event_type").alias("word"))
    return P.caption_best(reads)


@query("caption_best", f"WITH {BEST_SQL} SELECT * FROM best")
def _(t):
    return best_reads(t)


@query("caption_words", f"WITH {BEST_SQL} SELECT word, count(*) AS n FROM best GROUP BY 1")
def _(t):
    return best_reads(t).groupBy("word").agg(F.count("*").alias("n"))


@query("segment_quality", f"""SELECT video, segment, min(t) AS start, max(t) AS "end", count(*) FILTER (WHERE NOT frozen) / 10.0::DOUBLE AS active_seconds,
   round(sum({' + '.join(f'({f} IS NULL)::INT' for f in FIELDS)}) / (count(*) * 6)::DOUBLE + 1e-9, 6) AS unread_share, bool_or(side = 'R' AND coalesce({', '.join(FIELDS)}) IS NOT NULL) AS two_sided FROM v_samples GROUP BY 1, 2""")
def _(t):
    return P.segment_quality(t.samples, FIELDS, 10.0).withColumn("unread_share", near(F.col("unread_share")))


@query("segment_scan", """SELECT segment, count(*) FILTER (WHERE NOT frozen) / 10.0::DOUBLE AS active_seconds FROM v_samples GROUP BY 1 HAVING count(*) FILTER (WHERE NOT frozen) / 10.0 >= 12""")
def _(t):
    return P.segment_quality(t.samples, FIELDS, 10.0).filter("active_seconds >= 12").select("segment", "active_seconds")


@query("debounce", """WITH RECURSIVE g AS (SELECT segment, t, held // 6 AS v, row_number() OVER (PARTITION BY segment ORDER BY t, seq) AS n FROM v_samples),
   d AS (SELECT segment, n, t, v, 1 AS len, v AS stable, false AS any_stable FROM g WHERE n = 1
     UNION ALL SELECT g.segment, g.n, g.t, g.v, CASE WHEN g.v = d.v THEN d.len + 1 ELSE 1 END, CASE WHEN g.v = d.v THEN g.v ELSE d.stable END, d.any_stable OR g.v = d.v FROM d JOIN g ON g.segment = d.segment AND g.n = d.n + 1)
   SELECT segment, n, v, stable FROM d""")
def _(t):
    g = t.samples.select("segment", "t", "seq", F.expr("cast(held div 6 as int)").alias("v"))
    out = debounce(blocked(g, "t", B), ["segment"], ["t", "seq"], "v", 2, number="n")
    return out.select("segment", "n", "v", "stable")
