"""Metrics, outcomes, pressure and the match browser."""

from pyspark.sql import functions as F

from boutline.operators import metrics as MT
from boutline.operators import outcome as O
from boutline.operators import pressure as P
from boutline.operators.moments import wasted_inputs
from boutline.plans.log_queries import WASTED_SQL
from boutline.plans.registry import query
from boutline.plans.testviews import BUSY_FRAMES, CATEGORIES, FRAME_BLOCK

METRICS_SQL = """cnt AS (SELECT match_id, slot, action, count(*) AS n FROM v_inputs GROUP BY ALL),
  tot AS (SELECT match_id, slot, sum(n)::DOUBLE AS presses, duration_frames / 60.0::DOUBLE / 60.0 AS minutes FROM cnt JOIN v_matches USING (match_id) GROUP BY match_id, slot, duration_frames),
  bycat AS (SELECT t.match_id, t.slot, c.category, coalesce(sum(n), 0)::DOUBLE AS n, any_value(minutes) AS minutes FROM tot t CROSS JOIN (SELECT DISTINCT category FROM v_actions) c
     LEFT JOIN (SELECT * FROM cnt JOIN v_actions USING (action)) x ON x.match_id = t.match_id AND x.slot = t.slot AND x.category = c.category GROUP BY 1, 2, 3),
  metrics AS (SELECT match_id, slot, 'presses' AS key, presses AS value FROM tot UNION ALL SELECT match_id, slot, 'minutes', minutes FROM tot
    UNION ALL SELECT match_id, slot, 'apm', presses / minutes FROM tot
    UNION ALL SELECT match_id, slot, category, n FROM bycat UNION ALL SELECT match_id, slot, category || '_pm', n / minutes FROM bycat
    UNION ALL SELECT match_id, slot, 'n_' || action, n::DOUBLE FROM cnt)"""


def metrics_of(t):
    return MT.habit_metrics(t.inputs, t.matches, t.action_model, sorted(set(CATEGORIES.values())))


def me_of(t):
    """The most seen player name."""
    return MT.players_seen(t.players, 1).select("display_name")


ME_SQL = "me AS (SELECT display_name FROM v_players GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query("habit_metrics", f"WITH {METRICS_SQL} SELECT match_id, slot, key, round(value, 6) AS value FROM metrics")
def _(t):
    return metrics_of(t).withColumn("value", F.round("value", 6))


@query("players_seen", "SELECT display_name, count(*) AS matches FROM v_players GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(t):
    return MT.players_seen(t.players, 20)


@query("facets", """SELECT 'totals' AS facet, 'total' AS value, count(*) AS n FROM v_matches
  UNION ALL SELECT 'totals', 'with_video', count(*) FILTER (WHERE has_video) FROM v_matches
  UNION ALL SELECT 'totals', 'with_kos', count(DISTINCT match_id) FROM v_kos WHERE match_id IN (SELECT match_id FROM v_matches)
  UNION ALL SELECT 'patch', patch, count(*) FROM v_matches GROUP BY patch
  UNION ALL (SELECT 'player', display_name, count(*) AS c FROM v_players GROUP BY display_name ORDER BY c DESC, display_name LIMIT 40)""")
def _(t):
    return MT.facets(t.matches, t.kos, t.players)


@query("match_list", """WITH page AS (SELECT * FROM v_matches WHERE has_video AND patch = 'v9' AND (source_file LIKE '%Hall%' OR false)
    ORDER BY match_id DESC LIMIT 25 OFFSET 2)
  SELECT match_id, patch, source_file, duration_frames / 60.0::DOUBLE AS seconds, (SELECT string_agg(display_name, ' vs ' ORDER BY slot) FROM v_players p WHERE p.match_id = page.match_id) AS names FROM page""")
def _(t):
    m = t.matches.withColumn("level_name", F.lit(None).cast("string"))
    return MT.match_list(m, t.players, has_video=True, patch="v9", like="Hall", limit=25, offset=2).select(
        "match_id", "patch", "source_file", "seconds", "names")


@query("player_matches", """SELECT match_id, source_file FROM v_matches
  WHERE match_id IN (SELECT match_id FROM v_players WHERE display_name = 'BUILDING-3') ORDER BY match_id DESC LIMIT 50""")
def _(t):
    return MT.match_list(t.matches, t.players, player="BUILDING-3").select("match_id", "source_file")


@query("metric_series", f"""WITH {METRICS_SQL} SELECT display_name, match_id, slot, round(value, 6) AS value FROM metrics
  JOIN v_players USING (match_id, slot) WHERE key = 'apm'""")
def _(t):
    return MT.metric_series(metrics_of(t), t.players, "apm").withColumn("value", F.round("value", 6))


@query("profile_characters", f"""WITH {ME_SQL} SELECT character_id, count(*) AS n FROM v_players WHERE display_name IN (SELECT display_name FROM me) GROUP BY 1 ORDER BY n DESC, character_id LIMIT 8""")
def _(t):
    return MT.profile_characters(t.players, me_of(t))


@query("profile_report", f"""WITH {METRICS_SQL}, {ME_SQL},
  x AS (SELECT key, value, display_name IN (SELECT display_name FROM me) AS mine FROM metrics JOIN v_players USING (match_id, slot)
    WHERE key IN ('apm', 'attack_pm', 'movement_pm', 'utility_pm', 'n_click', 'n_view')),
  m AS (SELECT key, median(value) FILTER (WHERE mine) AS mine, median(value) FILTER (WHERE NOT mine) AS others FROM x GROUP BY key)
  SELECT key, round(mine, 6) AS mine, round(others, 6) AS others, round((mine - others) / nullif(others, 0) * 100, 6) AS pct_diff FROM m""")
def _(t):
    keys = ["apm", "attack_pm", "movement_pm", "utility_pm", "n_click", "n_view"]
    return MT.profile_rates(metrics_of(t), t.players, me_of(t), keys).select(
        "key", *[F.round(c, 6).alias(c) for c in ("mine", "others", "pct_diff")])


RESULTS_SQL = """results AS (SELECT match_id, slot, CAST(1 + count(*) FILTER (WHERE event_type = 'signup') % 11 AS INTEGER) AS value FROM v_ticks GROUP BY 1, 2)"""

OUTCOME_SQL = RESULTS_SQL + """,
  d AS (SELECT p.match_id, p.slot, p.display_name, coalesce(k.n, 0) AS deaths, r.value FROM v_players p LEFT JOIN (SELECT match_id, slot, count(*) AS n FROM v_kos GROUP BY 1, 2) k USING (match_id, slot)
     LEFT JOIN results r USING (match_id, slot)),
  o AS (SELECT *, count(*) OVER m AS n, min(deaths) OVER m AS lo, max(deaths) OVER m AS hi, count(value) OVER m AS nr, min(value) OVER m AS vlo, max(value) OVER m AS vhi
     FROM d WINDOW m AS (PARTITION BY match_id)),
  outcomes AS (SELECT match_id, slot, deaths, display_name, CASE WHEN n = 2 AND lo <> hi THEN CASE WHEN deaths = hi THEN 'loss' ELSE 'win' END
     WHEN nr >= 2 AND vlo <> vhi AND value IS NOT NULL THEN CASE WHEN value = vhi THEN 'win' ELSE 'loss' END END AS outcome,
     CASE WHEN n = 2 AND lo <> hi THEN 'deaths' WHEN nr >= 2 AND vlo <> vhi THEN 'result_field' END AS source FROM o)"""


def results_of(t):
    return t._ticks.groupBy("match_id", "slot").agg(
        (F.count_if(F.col("event_type") == "signup") % 11 + 1).cast("int").alias("value"))


@query("match_outcome", f"WITH {OUTCOME_SQL} SELECT match_id, slot, deaths, outcome, source FROM outcomes")
def _(t):
    return O.match_outcome(t.players, t.kos, results_of(t))


@query("profile_record", f"""WITH {OUTCOME_SQL} SELECT display_name, count(*) AS matches, count(*) FILTER (WHERE outcome = 'win') AS wins,
  count(*) FILTER (WHERE outcome = 'loss') AS losses,
  round(count(*) FILTER (WHERE outcome = 'win') / nullif(count(outcome), 0)::DOUBLE, 6) AS win_rate, round(sum(duration_frames / 3600.0::DOUBLE), 6) AS minutes,
  count(DISTINCT patch) AS patches FROM outcomes JOIN v_matches USING (match_id) GROUP BY 1""")
def _(t):
    o = O.match_outcome(t.players, t.kos, results_of(t)).join(t.players, ["match_id", "slot"]).join(t.matches, "match_id")
    win, loss = F.col("outcome") == "win", F.col("outcome") == "loss"
    return o.groupBy("display_name").agg(
        F.count("*").alias("matches"), F.count_if(win).alias("wins"), F.count_if(loss).alias("losses"),
        F.round(F.try_divide(F.count_if(win), F.count("outcome")), 6).alias("win_rate"),
        F.round(F.sum(F.col("duration_frames") / 3600.0), 6).alias("minutes"), F.count_distinct("patch").alias("patches"))


@query("match_report", f"""WITH {OUTCOME_SQL}, {METRICS_SQL}
  SELECT o.match_id, o.slot, coalesce(o.display_name, 'slot ' || o.slot) AS player, outcome, deaths, round(value, 6) AS apm
  FROM outcomes o LEFT JOIN metrics m ON m.match_id = o.match_id AND m.slot = o.slot AND m.key = 'apm'""")
def _(t):
    from boutline.functions.scalars import player_label
    apm = metrics_of(t).filter("key = 'apm'").select("match_id", "slot", F.round("value", 6).alias("apm"))
    return O.match_outcome(t.players, t.kos, results_of(t)).join(t.players, ["match_id", "slot"]).join(
        apm, ["match_id", "slot"], "left").select(
        "match_id", "slot", player_label(F.col("display_name"), F.col("slot")).alias("player"), "outcome", "deaths", "apm")


@query("result_guards", f"""WITH {RESULTS_SQL}, g AS (SELECT match_id, bool_and(value BETWEEN 1 AND 8 OR value IN (2048, 4096)) AND count(*) = count(DISTINCT value) AS kept FROM results GROUP BY 1)
  SELECT match_id, slot, value, kept FROM results JOIN g USING (match_id)""")
def _(t):
    return O.guard_results(results_of(t)).select("match_id", "slot", "value", "kept")


@query("ko_guards", """WITH l AS (SELECT match_id, max(frame) AS last FROM v_inputs WHERE action <> 'signup' GROUP BY 1)
  SELECT match_id, slot, frame, seq, "by" FROM v_kos JOIN l USING (match_id) WHERE frame BETWEEN 0 AND last + 12""")
def _(t):
    return O.guard_kos(t.kos, t.inputs.filter("action <> 'signup'"), 12)


@query("stream_filter", """WITH s AS (SELECT match_id AS file, event_type AS kind, (max(frame) - min(frame)) * 450 AS span_ms, count(*) AS n FROM v_ticks GROUP BY 1, 2),
  st AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY kind) - 1 AS ord FROM s),
  sane AS (SELECT * FROM st WHERE ord < 8 AND span_ms > 0 AND span_ms <= 1800000 AND n >= 20),
  ref AS (SELECT file, list_sort(list(span_ms))[count(*) // 2 + 1] AS r, max(n) AS m FROM sane GROUP BY 1),
  good AS (SELECT sane.* FROM sane JOIN ref USING (file) WHERE span_ms >= r * 0.5 AND n >= m * 0.15),
  back AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ord) AS k FROM st WHERE ord < 8 AND n >= 20 AND file NOT IN (SELECT file FROM good)) WHERE k <= 4)
  SELECT file, ord, kind, span_ms, n FROM good UNION ALL SELECT file, ord, kind, span_ms, n FROM back""")
def _(t):
    from pyspark.sql import Window
    s = t._ticks.groupBy(F.col("match_id").alias("file"), F.col("event_type").alias("kind")).agg(
        ((F.max("frame") - F.min("frame")) * 450).alias("span_ms"), F.count("*").alias("n"))
    st = s.withColumn("ord", (F.row_number().over(Window.partitionBy("file").orderBy("kind")) - 1).cast("long"))
    return O.plausible_streams(st).select("file", "ord", "kind", "span_ms", "n")


@query("entity_slots", """SELECT match_id, display_name, CASE WHEN character_id % 4 <> 0 THEN character_id END AS entity_id,
  CAST(row_number() OVER (PARTITION BY match_id ORDER BY CASE WHEN character_id % 4 <> 0 THEN character_id END NULLS LAST, slot) - 1 AS INTEGER) AS slot FROM v_players""")
def _(t):
    return O.entity_slots(entities_of(t)).select("match_id", "display_name", "entity_id", "slot")


def entities_of(t):
    return t.players.select("match_id", "display_name", F.col("slot").alias("ord"),
                            F.when(F.col("character_id") % 4 != 0, F.col("character_id")).alias("entity_id"))


@query("identity_resolve", """WITH e AS (SELECT match_id, display_name AS nm, slot AS ord, CASE WHEN character_id % 4 <> 0 THEN character_id END AS entity_id FROM v_players),
  s AS (SELECT *, CAST(row_number() OVER (PARTITION BY match_id ORDER BY entity_id NULLS LAST, ord) - 1 AS INTEGER) AS slot FROM e),
  r AS (SELECT match_id, entity_id, min_by('r:' || nm, ord) AS rn FROM e WHERE entity_id >= 12 GROUP BY 1, 2),
  a AS (SELECT match_id, slot, min_by('a:' || c_name, c_custkey) AS an FROM v_players p JOIN customer ON c_custkey = match_id * 2 + slot WHERE c_acctbal > 1000 GROUP BY 1, 2)
  SELECT s.match_id, s.slot, s.entity_id, coalesce(rn, an) AS display_name, CASE WHEN rn IS NOT NULL THEN 'structural' WHEN an IS NOT NULL THEN 'anchor' END AS player_source
  FROM s LEFT JOIN r ON r.match_id = s.match_id AND r.entity_id = s.entity_id LEFT JOIN a ON a.match_id = s.match_id AND a.slot = s.slot""")
def _(t):
    e = entities_of(t)
    records = e.filter("entity_id >= 12").select("match_id", "entity_id", F.concat(F.lit("r:"), F.col("display_name")).alias("name"), "ord")
    anchors = t.players.join(t.customer.filter("c_acctbal > 1000"), F.col("match_id") * 2 + F.col("slot") == F.col("c_custkey")).select(
        "match_id", "slot", F.concat(F.lit("a:"), F.col("c_name")).alias("name"), F.col("c_custkey").alias("ord"))
    return O.resolve_identity(O.entity_slots(e), records, anchors)


@query("dim_lookup", r"""SELECT match_id, coalesce(n_name, nullif(trim(regexp_replace(regexp_replace(regexp_replace(source_file, '\[[\d.]+\]', '', 'g'), '\.[A-Za-z]+$', ''), '\(\d+\)', '', 'g')), '')) AS level_name,
  CASE WHEN n_name IS NOT NULL THEN 'level_id' ELSE 'file_name' END AS level_name_source FROM v_matches LEFT JOIN nation ON level_id + 5 = n_nationkey""")
def _(t):
    named = t.matches.withColumn("n_nationkey", F.col("level_id") + 5)
    bare = F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace("source_file", r"\[[\d.]+\]", ""), r"\.[A-Za-z]+$", ""), r"\(\d+\)", ""))
    return named.join(t.nation, "n_nationkey", "left").select(
        "match_id", F.coalesce("n_name", F.nullif(bare, F.lit(""))).alias("level_name"),
        F.when(F.col("n_name").isNotNull(), "level_id").otherwise("file_name").alias("level_name_source"))


EX_SQL = """act AS (SELECT DISTINCT match_id, slot FROM v_inputs), who AS (SELECT p.* FROM v_players p JOIN act USING (match_id, slot)),
  ex AS (SELECT k.match_id, k.seq, k.frame, w.slot AS me, w.display_name, CASE WHEN k.slot = w.slot THEN 'death' ELSE 'kill' END AS kind FROM v_kos k JOIN who w USING (match_id)),
  nn AS (SELECT display_name, count(*) FILTER (WHERE kind = 'death') AS deaths, count(*) FILTER (WHERE kind = 'kill') AS kills FROM ex GROUP BY 1)"""


@query("pressure", f"""WITH {EX_SQL}, track AS (SELECT action FROM v_actions UNION ALL SELECT 'TOTAL'),
  per AS (SELECT e.match_id, e.seq, e.me, e.display_name, e.kind, a.action, count(i.seq) FILTER (WHERE i.action = a.action OR a.action = 'TOTAL') AS x
     FROM ex e CROSS JOIN track a LEFT JOIN v_inputs i ON i.match_id = e.match_id AND i.slot = e.me AND i.frame BETWEEN e.frame - 300 AND e.frame GROUP BY ALL),
  st AS (SELECT display_name, action, coalesce(avg(x) FILTER (WHERE kind = 'death'), 0) AS md, coalesce(avg(x) FILTER (WHERE kind = 'kill'), 0) AS mk,
     coalesce(var_pop(x) FILTER (WHERE kind = 'death'), 0) AS vd, coalesce(var_pop(x) FILTER (WHERE kind = 'kill'), 0) AS vk FROM per GROUP BY 1, 2)
  SELECT display_name, action, CAST(deaths AS BIGINT) AS deaths, CAST(kills AS BIGINT) AS kills, round(md, 6) AS before_death, round(mk, 6) AS before_kill,
     round(CASE WHEN mk = 0 THEN 0 ELSE (md - mk) / mk * 100 END, 6) AS pct_diff,
     CASE WHEN deaths = 0 OR kills = 0 THEN 0 ELSE round((md - mk) / CASE WHEN vd + vk = 0 THEN 1e-9 ELSE sqrt((vd + vk) / 2) END, 5) END AS effect
  FROM st JOIN nn USING (display_name) WHERE deaths > 0""")
def _(t):
    p = P.pressure_actions(t.kos, t.players, t.inputs, sorted(BUSY_FRAMES))
    return p.select("display_name", "action", "deaths", "kills", *[F.round(c, 6).alias(c) for c in ("before_death", "before_kill", "pct_diff")],
                    F.round("effect", 5).alias("effect"))


@query("pressure_quality", f"""WITH {WASTED_SQL}, {EX_SQL},
  per AS (SELECT e.match_id, e.seq, e.me, e.display_name, e.kind, count(*) AS n, count(*) FILTER (WHERE wasted) AS bad FROM ex e
    JOIN wasted i ON i.match_id = e.match_id AND i.slot = e.me AND i.action = 'purchase' AND i.frame BETWEEN e.frame - 300 AND e.frame GROUP BY ALL),
  r AS (SELECT *, bad / n::DOUBLE AS rate FROM per),
  st AS (SELECT display_name, coalesce(sum(bad) FILTER (WHERE kind = 'death'), 0)::BIGINT AS wasted_death, coalesce(sum(n) FILTER (WHERE kind = 'death'), 0)::BIGINT AS total_death,
    coalesce(sum(bad) FILTER (WHERE kind = 'kill'), 0)::BIGINT AS wasted_kill, coalesce(sum(n) FILTER (WHERE kind = 'kill'), 0)::BIGINT AS total_kill,
    coalesce(avg(rate) FILTER (WHERE kind = 'death'), 0) AS md, coalesce(avg(rate) FILTER (WHERE kind = 'kill'), 0) AS mk,
    CASE WHEN min(rate) FILTER (WHERE kind = 'death') = max(rate) FILTER (WHERE kind = 'death') THEN 0 ELSE coalesce(var_pop(rate) FILTER (WHERE kind = 'death'), 0) END AS vd,
    CASE WHEN min(rate) FILTER (WHERE kind = 'kill') = max(rate) FILTER (WHERE kind = 'kill') THEN 0 ELSE coalesce(var_pop(rate) FILTER (WHERE kind = 'kill'), 0) END AS vk,
    count(*) FILTER (WHERE kind = 'death') AS nd, count(*) FILTER (WHERE kind = 'kill') AS nk FROM r GROUP BY 1)
  SELECT display_name, wasted_death, total_death, round(md, 6) AS mean_death, wasted_kill, total_kill, round(mk, 6) AS mean_kill,
    CASE WHEN nd = 0 OR nk = 0 THEN 0 ELSE round((md - mk) / CASE WHEN vd + vk = 0 THEN 1e-9 ELSE sqrt((vd + vk) / 2) END, 4) END AS effect FROM st""")
def _(t):
    q = P.pressure_quality(t.kos, t.players, t.inputs, t.action_model, action="purchase", width=FRAME_BLOCK)
    return q.select("display_name", "wasted_death", "total_death", F.round("mean_death", 6).alias("mean_death"),
                    "wasted_kill", "total_kill", F.round("mean_kill", 6).alias("mean_kill"), F.round("effect", 4).alias("effect"))


@query("death_context", """WITH d AS (SELECT DISTINCT match_id, slot AS victim, frame AS ko_frame FROM v_kos)
  SELECT d.match_id, victim, ko_frame, slot, frame, action, count(*) AS n FROM d JOIN v_inputs i ON i.match_id = d.match_id
   AND frame BETWEEN greatest(0, ko_frame - 300) AND ko_frame GROUP BY ALL""")
def _(t):
    return P.death_context(t.kos, t.inputs)


@query("death_waste", """WITH d AS (SELECT DISTINCT match_id, slot, frame AS ko_frame FROM v_kos),
  r AS (SELECT d.*, i.frame, i.action, i.seq, i.frame - lag(i.frame) OVER (PARTITION BY d.match_id, d.slot, ko_frame, i.action ORDER BY i.frame, i.seq) AS gap
    FROM d LEFT JOIN v_inputs i ON i.match_id = d.match_id AND i.slot = d.slot AND i.frame BETWEEN greatest(0, ko_frame - 300) AND ko_frame)
  SELECT match_id, slot, ko_frame, count(seq) AS presses, count(*) FILTER (WHERE busy > 0 AND gap < busy) AS wasted FROM r LEFT JOIN v_actions USING (action) GROUP BY 1, 2, 3""")
def _(t):
    return P.death_waste(t.kos, t.inputs, t.action_model, width=FRAME_BLOCK)


@query("wasted_rate", f"""WITH {WASTED_SQL}, {ME_SQL} SELECT p.display_name IN (SELECT display_name FROM me) AS mine, m.patch, count(*) AS presses,
   count(*) FILTER (WHERE wasted) AS wasted, round(count(*) FILTER (WHERE wasted) / count(*)::DOUBLE, 6) AS rate
   FROM wasted w JOIN v_players p USING (match_id, slot) JOIN v_matches m USING (match_id) GROUP BY 1, 2""")
def _(t):
    per = wasted_inputs(t.inputs, t.action_model, FRAME_BLOCK).groupBy("match_id", "slot").agg(
        F.count("*").alias("presses"), F.count_if("wasted").alias("wasted"))
    who = t.players.join(F.broadcast(me_of(t).withColumn("_me", F.lit(True))), "display_name", "left").withColumn("mine", F.coalesce("_me", F.lit(False)))
    return per.join(who, ["match_id", "slot"]).join(t.matches, "match_id").groupBy("mine", "patch").agg(
        F.sum("presses").alias("presses"), F.sum("wasted").alias("wasted"),
        F.round(F.sum("wasted") / F.sum("presses"), 6).alias("rate"))


@query("duration", """SELECT match_id, max(frame) AS last_input, max(frame) // 60 AS seconds FROM v_inputs GROUP BY 1""")
def _(t):
    return t.inputs.groupBy("match_id").agg(F.max("frame").alias("last_input")).withColumn("seconds", F.expr("last_input div 60"))


@query("ko_seconds", """SELECT match_id, slot, string_agg(CAST(frame // 60 AS VARCHAR), ',' ORDER BY frame) AS seconds, count(*) AS n FROM (SELECT DISTINCT match_id, slot, frame FROM v_kos) GROUP BY 1, 2""")
def _(t):
    # distinct instants only: bounded by the length of a match
    return t.kos.select("match_id", "slot", "frame").distinct().groupBy("match_id", "slot").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("frame")), lambda f: F.floor(f / 60).cast("string")), ",").alias("seconds"),
        F.count("*").alias("n"))


@query("provenance", """WITH c AS (SELECT match_id, bool_and(character_id IS NOT NULL AND character_id <> 0) AS known, count(*) AS n FROM v_players GROUP BY 1),
   k AS (SELECT DISTINCT match_id FROM v_kos)
   SELECT m.match_id, CASE WHEN known THEN 'high' ELSE 'partial' END AS players, CASE WHEN k.match_id IS NOT NULL THEN 'high' ELSE 'missing' END AS kos,
     CASE WHEN k.match_id IS NULL THEN 'no KO data in this match' END AS warning FROM v_matches m LEFT JOIN c USING (match_id) LEFT JOIN k ON k.match_id = m.match_id""")
def _(t):
    from boutline.operators.store import provenance
    return provenance(t.matches, t.players, t.kos)
