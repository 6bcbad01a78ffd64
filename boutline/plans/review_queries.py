"""Damage tracks, press groups, payoffs and death reviews."""

from pyspark.sql import functions as F

from boutline.functions import payoffs as PF
from boutline.operators import damage as D
from boutline.operators import review as R
from boutline.plans.registry import near, query
from boutline.plans.testviews import FRAME_BLOCK, SECOND_BLOCK

PAIR, WINDOW = 40, 300  # frames, scaled to the density of the views

READINGS_SQL = "readings AS (SELECT match_id, slot, seconds, max(estimate) AS estimate FROM v_damage GROUP BY 1, 2, 3)"

RESETS_SQL = READINGS_SQL + """,
  prop AS (SELECT DISTINCT match_id, slot, t FROM (SELECT a.match_id, a.slot, a.seconds, min(b.seconds) AS t FROM readings a JOIN readings b ON a.match_id = b.match_id AND a.slot = b.slot
     AND b.seconds > a.seconds AND b.seconds - a.seconds <= 2.5 AND a.estimate - b.estimate >= 0.30 AND b.estimate <= 0.18 GROUP BY 1, 2, 3)),
  acc AS (SELECT match_id, slot, min(t) AS t FROM prop GROUP BY 1, 2
     UNION ALL SELECT c.match_id, c.slot, min(p.t) FROM acc c JOIN prop p ON p.match_id = c.match_id AND p.slot = c.slot WHERE p.t - c.t > 6.0 + 1e-9 GROUP BY c.match_id, c.slot, c.t),
  resets AS (SELECT DISTINCT match_id, slot, t AS seconds FROM acc)"""


def readings(t):
    return t.damage.groupBy("match_id", "slot", "seconds").agg(F.max("estimate").alias("estimate"))


def resets_of(t):
    return D.resets(readings(t), width=SECOND_BLOCK)


@query("damage_resets", f"WITH RECURSIVE {RESETS_SQL} SELECT match_id, slot, seconds FROM resets")
def _(t):
    return resets_of(t)


@query("damage_at", f"""WITH {READINGS_SQL}, k AS (SELECT match_id, slot, frame, seq, frame / 60.0::DOUBLE AS seconds FROM v_kos),
  c AS (SELECT k.*, r.estimate, row_number() OVER (PARTITION BY k.seq ORDER BY abs(r.seconds - k.seconds), r.seconds) AS rn FROM k LEFT JOIN readings r
    ON r.match_id = k.match_id AND r.slot = k.slot AND abs(r.seconds - k.seconds) <= 1.5)
  SELECT match_id, slot, frame, seq, round(estimate, 9) AS damage FROM c WHERE rn = 1""")
def _(t):
    at = t.kos.select("match_id", "slot", "frame", "seq", (F.col("frame") / 60.0).alias("seconds"))
    return D.damage_at(at, readings(t), width=SECOND_BLOCK).select("match_id", "slot", "frame", "seq", F.round("damage", 9).alias("damage"))


KNOWN_SQL = "known AS (SELECT DISTINCT match_id, slot, frame / 60.0::DOUBLE AS seconds FROM v_kos)"


@query("reset_validate", f"""WITH RECURSIVE {RESETS_SQL}, {KNOWN_SQL}
  SELECT match_id, slot, seconds, CASE WHEN EXISTS (SELECT 1 FROM resets r WHERE r.match_id = k.match_id AND r.slot = k.slot AND abs(r.seconds - k.seconds) <= 6.0) THEN 'matched' ELSE 'missed' END AS status FROM known k
  UNION ALL SELECT match_id, slot, seconds, 'spurious' FROM resets r WHERE NOT EXISTS (SELECT 1 FROM known k WHERE r.match_id = k.match_id AND r.slot = k.slot AND abs(r.seconds - k.seconds) <= 6.0)""")
def _(t):
    return D.validate_resets(resets_of(t), known_deaths(t), 6.0, SECOND_BLOCK)


def known_deaths(t):
    return t.kos.select("match_id", "slot", (F.col("frame") / 60.0).alias("seconds")).distinct()


@query("align_offset", f"""WITH RECURSIVE {RESETS_SQL}, {KNOWN_SQL},
  perms AS (SELECT 0 AS perm, a AS arc, a AS slot FROM (VALUES (0), (1)) v(a) UNION ALL SELECT 1, a, 1 - a FROM (VALUES (0), (1)) v(a)),
  used AS (SELECT k.match_id, p.perm, p.arc, p.slot FROM (SELECT DISTINCT match_id, slot FROM known) k JOIN perms p ON p.slot = k.slot),
  sh AS (SELECT u.match_id, u.perm, u.arc, k.seconds AS death, o, k.seconds - 120.0 + o * 0.5 AS want FROM known k JOIN used u ON u.match_id = k.match_id AND u.slot = k.slot CROSS JOIN range(0, 481) g(o)),
  res AS (SELECT u.match_id, u.perm, u.arc, r.seconds AS reset FROM resets r JOIN used u ON u.match_id = r.match_id AND u.arc = r.slot),
  met AS (SELECT s.*, r.reset, r.reset - s.want AS gap FROM sh s JOIN res r ON r.match_id = s.match_id AND r.perm = s.perm AND r.arc = s.arc AND s.want BETWEEN r.reset - 4.0 AND r.reset + 4.0),
  near AS (SELECT match_id, perm, arc, o, death, arg_min(gap, (abs(gap), reset)) AS gap FROM met GROUP BY 1, 2, 3, 4, 5),
  hits AS (SELECT match_id, perm, o, count(*) AS hits, avg(abs(gap)) AS residual, list_sort(list(gap))[count(*) // 2 + 1] AS shift FROM near GROUP BY 1, 2, 3),
  expl AS (SELECT match_id, perm, o, count(*) AS e FROM (SELECT DISTINCT match_id, perm, arc, o, reset FROM met) GROUP BY 1, 2, 3),
  tot AS (SELECT match_id, perm, count(*) AS n FROM res GROUP BY 1, 2),
  sc AS (SELECT h.*, n - e AS spurious, hits - 0.5 * (n - e) AS score FROM hits h JOIN expl USING (match_id, perm, o) JOIN tot USING (match_id, perm))
  SELECT match_id, perm, round(-120.0 + o * 0.5 + shift, 5) AS "offset", hits, spurious, score::DOUBLE AS score, round(residual, 5) AS residual FROM
   (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY score DESC, round(residual, 6), perm, o) AS rn FROM sc) WHERE rn = 1""")
def _(t):
    deaths = known_deaths(t)
    found = resets_of(t).withColumnRenamed("slot", "arc")
    orders = F.array(*[F.struct(F.lit(p).alias("perm"), F.lit(a).alias("arc"), F.lit(a if p == 0 else 1 - a).alias("slot")) for p in (0, 1) for a in (0, 1)])
    arcs = deaths.select("match_id").distinct().select("match_id", F.explode(orders).alias("o")).select("match_id", "o.*")
    return D.align(deaths, found, arcs).select(
        "match_id", "perm", F.round("offset", 5).alias("offset"), "hits", "spurious", F.col("score").cast("double").alias("score"), F.round("residual", 5).alias("residual"))


SETS_SQL = "sets AS (SELECT match_id, slot, frame, list_sort(list(DISTINCT action)) AS acts FROM v_presses GROUP BY 1, 2, 3)"

DEF_SQL = """CASE WHEN list_contains(acts, 'Heavy') AND (list_contains(acts, 'AimUp') OR list_contains(acts, 'UpJump')) THEN 'recovery' WHEN list_contains(acts, 'Dodge') THEN 'airdodge'
   WHEN list_contains(acts, 'Light') OR list_contains(acts, 'Heavy') THEN 'contest' WHEN list_contains(acts, 'Jump') OR list_contains(acts, 'UpJump') THEN 'doublejump' END"""
ATK_SQL = """CASE WHEN list_contains(acts, 'Heavy') AND list_contains(acts, 'AimDown') THEN 'deep_dair' WHEN list_contains(acts, 'Light') OR list_contains(acts, 'Heavy') THEN 'ledge_sair' END"""


def groups_sql(name: str, src: str, keys: str) -> str:
    """Anchored press groups of ``src(keys, frame, acts)``: a recursive anchor per key."""
    on = " AND ".join(f"x.{k.strip()} = y.{k.strip()}" for k in keys.split(","))
    xk = ", ".join(f"x.{k.strip()}" for k in keys.split(","))
    return f"""{name}_a AS (SELECT {keys}, min(frame) AS a FROM {src} GROUP BY ALL
     UNION ALL SELECT {xk}, min(y.frame) FROM {name}_a x JOIN {src} y ON {on} WHERE y.frame > x.a + {PAIR} GROUP BY {xk}, x.a),
  {name} AS (SELECT {xk}, x.a AS frame, list_sort(list_distinct(flatten(list(y.acts)))) AS acts FROM {name}_a x JOIN {src} y ON {on} AND y.frame BETWEEN x.a AND x.a + {PAIR} GROUP BY {xk}, x.a)"""


@query("press_groups", f"WITH RECURSIVE {SETS_SQL}, {groups_sql('g', 'sets', 'match_id, slot')} SELECT match_id, slot, frame, array_to_string(acts, '+') AS acts FROM g")
def _(t):
    return R.press_groups(R.frame_sets(t.presses), ["match_id", "slot"], PAIR, FRAME_BLOCK).withColumn("acts", F.array_join("acts", "+"))


DEATHS_SQL = """cnt AS (SELECT match_id, slot, count(*) AS n, min(frame) AS f FROM v_kos GROUP BY 1, 2),
  rev AS (SELECT match_id, slot AS me, 1 - slot AS opp FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY n DESC, f, slot) AS rn FROM cnt) WHERE rn = 1
     AND (match_id, 1 - slot) IN (SELECT (match_id, slot) FROM v_players)),
  deaths AS (SELECT DISTINCT k.match_id, k.slot, k.frame AS ko_frame, opp FROM v_kos k JOIN rev r ON r.match_id = k.match_id AND r.me = k.slot)"""

CHOICE_SQL = f"""{SETS_SQL}, {DEATHS_SQL},
  dw AS (SELECT d.match_id, d.slot, d.ko_frame, s.frame, s.acts FROM deaths d JOIN sets s ON s.match_id = d.match_id AND s.slot = d.slot AND s.frame BETWEEN d.ko_frame - {WINDOW} AND d.ko_frame),
  {groups_sql('dg', 'dw', 'match_id, slot, ko_frame')},
  choice AS (SELECT match_id, slot, ko_frame, arg_max(o, frame) AS option, max(frame) AS at_frame FROM (SELECT *, {DEF_SQL} AS o FROM dg) WHERE o IS NOT NULL GROUP BY 1, 2, 3)"""

TEND_SQL = f"""aw AS (SELECT d.match_id, d.opp AS slot, d.ko_frame, s.frame, s.acts FROM deaths d JOIN sets s ON s.match_id = d.match_id AND s.slot = d.opp AND s.frame BETWEEN d.ko_frame - {WINDOW} AND d.ko_frame),
  {groups_sql('ag', 'aw', 'match_id, slot, ko_frame')},
  att AS (SELECT match_id, ko_frame, {ATK_SQL} AS a FROM ag),
  tc AS (SELECT match_id, a, count(*) AS n FROM att WHERE a IS NOT NULL GROUP BY 1, 2
     UNION ALL SELECT * FROM (SELECT match_id, 'wait', count(*) FILTER (WHERE (match_id, ko_frame) NOT IN (SELECT (match_id, ko_frame) FROM att WHERE a IS NOT NULL)) AS n FROM deaths GROUP BY 1) WHERE n > 0),
  tend AS (SELECT match_id, a, n, n / sum(n) OVER m AS p, CAST(sum(n) OVER m AS BIGINT) AS total, sum(CASE WHEN a <> 'wait' THEN n ELSE 0 END) OVER m / sum(n) OVER m AS ambiguous FROM tc WINDOW m AS (PARTITION BY match_id))"""


def deaths_of(t):
    who = R.reviewed_slots(t.kos)
    opp = t.players.join(who.withColumnRenamed("slot", "me"), "match_id").filter("slot <> me").groupBy("match_id").agg(F.min("slot").alias("opp"))
    return t.kos.join(who, ["match_id", "slot"]).select("match_id", "slot", F.col("frame").alias("ko_frame")).distinct(), opp


@query("committed_option", f"""WITH RECURSIVE {CHOICE_SQL} SELECT match_id, slot, ko_frame, option, at_frame FROM choice""")
def _(t):
    deaths, opp = deaths_of(t)
    deaths = deaths.join(opp.select("match_id"), "match_id", "left_semi")
    return R.committed_options(deaths, R.frame_sets(t.presses), WINDOW, PAIR, FRAME_BLOCK).select("match_id", "slot", "ko_frame", "option", "at_frame")


@query("tendency", f"""WITH RECURSIVE {CHOICE_SQL}, {TEND_SQL} SELECT match_id, a, n, round(p, 6) AS p, total, round(ambiguous, 6) AS ambiguous FROM tend""")
def _(t):
    deaths, opp = deaths_of(t)
    return R.tendency(deaths, opp, R.frame_sets(t.presses), WINDOW, PAIR, FRAME_BLOCK).select(
        "match_id", "a", "n", F.round("p", 6).alias("p"), "total", F.round("ambiguous", 6).alias("ambiguous"))


@query("payoff_primitives", """SELECT event_id, round(1 / (1 + exp(-((event_id % 20) - (user_id % 15)) / 4.0::DOUBLE)), 9) AS p_first,
   round(greatest(0.0, least(1.0, value / 30.0)), 9) AS punish, round(0.45 + 0.55 * CASE WHEN event_type = 'error' THEN 0.5 ELSE greatest(0.0, least(1.0, value / 200.0)) END, 9) AS cost,
   round(0.30 + 0.70 * CASE WHEN event_type = 'error' THEN 0.5 ELSE greatest(0.0, least(1.0, value / 200.0)) END, 9) AS worth FROM events""")
def _(t):
    d = F.when(F.col("event_type") != "error", F.col("value") / 200.0)
    return t.events.select("event_id", F.round(PF.p_first(F.col("user_id") % 15, F.col("event_id") % 20), 9).alias("p_first"),
                           F.round(PF.punish(F.col("value")), 9).alias("punish"), F.round(PF.hit_cost(d), 9).alias("cost"),
                           F.round(PF.hit_value(d), 9).alias("worth"))


FACTS_SQL = """facts AS (SELECT weapon, move, coalesce(nullif(startup, 0), 12) AS startup, coalesce(recover_miss, 0) + coalesce(fixedrec_miss, 0) AS whiff,
    coalesce(cooldown, 0) AS cooldown, coalesce(startup, 0) > 0 AS known FROM v_moves_dim),
  wf AS (SELECT weapon, """ + ", ".join(
    f"coalesce(max(startup) FILTER (WHERE move = '{m}'), 99) AS {m}_s, coalesce(max(whiff) FILTER (WHERE move = '{m}'), 0) AS {m}_w, coalesce(bool_or(known) FILTER (WHERE move = '{m}'), false) AS {m}_k"
    for m in ("sair", "dair", "gp", "recovery")) + " FROM facts GROUP BY weapon)"


@query("move_facts", f"WITH {FACTS_SQL} SELECT * FROM facts")
def _(t):
    return R.move_facts(t.moves_dim)


def cells_sql(ctx: str, cols: str) -> str:
    """The payoff cells over ``ctx(cols, my_damage, their_damage, d_* , a_*)`` with d_/a_ prefixed weapon facts."""
    un = """base AS (SELECT *, 0.45 + 0.55 * CASE WHEN my_damage IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0, my_damage)) END AS cost,
       0.30 + 0.70 * CASE WHEN their_damage IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0, their_damage)) END AS worth,
       greatest(0.0, least(1.0, d_recovery_w / 30.0)) AS pr, greatest(0.0, least(1.0, d_sair_w / 30.0)) AS pc FROM {ctx})""".replace("{ctx}", ctx)
    rows = []
    for a, m in (("deep_dair", "dair"), ("ledge_sair", "sair"), ("gp", "gp")):
        win = f"greatest(0.0, least(1.0, a_{m}_w / 25.0))"
        for d, mv, g, extra in (("recovery", "recovery", 0.60, "0"), ("contest", "sair", 0.55, "0.15 * pc")):
            p = f"(1 / (1 + exp(-(a_{m}_s - d_{mv}_s) / 4.0::DOUBLE)))"
            rows.append((d, a, f"{p} * worth * ({g} + {g} * {win}) - (1 - {p}) * (cost + {extra})", f"d_{mv}_k AND a_{m}_k"))
        rows.append(("airdodge", a, f"0.9 * worth * (0.35 + 0.55 * {win}) - 0.1 * cost - 0.175", f"a_{m}_k"))
        rows.append(("doublejump", a, f"(0.55 + 0.35 * {win}) * 0.3 - (0.45 - 0.35 * {win}) * cost", f"a_{m}_k"))
        rows.append(("stall", a, "-0.25 - 0.75 * cost", f"a_{m}_k"))
    rows += [("recovery", "wait", "-0.15 - 0.85 * pr * cost", "d_recovery_k"), ("contest", "wait", "-0.2 - 0.8 * pc * cost", "d_sair_k"),
             ("airdodge", "wait", "-0.65 - 0.35 * cost", "true"), ("doublejump", "wait", "0.1 + 0.45 * cost", "true"), ("stall", "wait", "0.2 - 0.2 * cost", "true"),
             ("recovery", "retreat", "0.35 + 0.25 * cost", "d_recovery_k"), ("contest", "retreat", "0", "d_sair_k"),
             ("airdodge", "retreat", "0.2 - 0.175 * cost", "true"), ("doublejump", "retreat", "0.4 + 0.25 * cost", "true"), ("stall", "retreat", "0.25 + 0.1 * cost", "true")]
    order = {d: i for i, d in enumerate(PF.DEFENDER)}
    union = " UNION ALL ".join(f"SELECT {cols}, '{d}' AS d, {order[d]} AS ord, '{a}' AS a, ({s})::DOUBLE AS score, CASE WHEN {k} THEN 1.0 ELSE 0.3 END::DOUBLE AS confidence FROM base" for d, a, s, k in rows)
    return f"{un}, cells0 AS ({union}), cells AS (SELECT *, min(confidence) OVER (PARTITION BY {cols}, d) AS row_confidence FROM cells0)"


_PREFIX = ", ".join(f"{s}.{m}_{x} AS {s}_{m}_{x}" for s in ("d", "a") for m in ("sair", "dair", "gp", "recovery") for x in "swk")


@query("payoff_matrix", f"""WITH {FACTS_SQL}, ctx AS (SELECT x.match_id, CASE WHEN x.match_id % 10 > 0 THEN x.match_id % 10 / 10.0::DOUBLE END AS my_damage, x.match_id % 7 / 5.0::DOUBLE AS their_damage, {_PREFIX}
     FROM v_players x JOIN v_players y ON y.match_id = x.match_id AND y.slot = 1 AND x.slot = 0 JOIN wf d ON d.weapon = 'Brand#' || (x.character_id + 1) JOIN wf a ON a.weapon = 'Brand#' || (y.character_id + 1)),
   {cells_sql('ctx', 'match_id')} SELECT match_id, d, a, round(score, 9) AS score, confidence, row_confidence FROM cells""")
def _(t):
    wf = R.weapon_facts(t.moves_dim)
    weapon = F.concat(F.lit("Brand#"), (F.col("character_id") + 1).cast("string"))
    one = t.players.filter("slot = 0").select("match_id", weapon.alias("weapon")).join(wf, "weapon").select("match_id", F.col("facts").alias("mine"))
    two = t.players.filter("slot = 1").select("match_id", weapon.alias("weapon")).join(wf, "weapon").select("match_id", F.col("facts").alias("theirs"))
    ctx = one.join(two, "match_id").select("match_id", "mine", "theirs",
                                           F.when(F.col("match_id") % 10 > 0, F.col("match_id") % 10 / 10.0).alias("my_damage"),
                                           (F.col("match_id") % 7 / 5.0).alias("their_damage"))
    return R.payoff_cells(ctx).select("match_id", "d", "a", F.round("score", 9).alias("score"), "confidence", "row_confidence")


def player_facts(t):
    """Facts of each player's weapon, named by the character."""
    weapon = F.concat(F.lit("Brand#"), (F.col("character_id") + 1).cast("string"))
    return t.players.select("match_id", "slot", weapon.alias("weapon")).join(R.weapon_facts(t.moves_dim), "weapon").select("match_id", "slot", "facts")


REVIEW_SQL = f"""{CHOICE_SQL}, {TEND_SQL}, {READINGS_SQL}, {FACTS_SQL},
  c1 AS (SELECT c.*, d.opp, at_frame / 60.0::DOUBLE AS sec FROM choice c JOIN deaths d USING (match_id, slot, ko_frame)),
  dm AS (SELECT c1.match_id, c1.ko_frame, arg_min(r.estimate, (abs(r.seconds - sec), r.seconds)) AS v FROM c1 JOIN readings r ON r.match_id = c1.match_id AND r.slot = c1.slot AND abs(r.seconds - sec) <= 1.5 GROUP BY 1, 2),
  dt AS (SELECT c1.match_id, c1.ko_frame, arg_min(r.estimate, (abs(r.seconds - sec), r.seconds)) AS v FROM c1 JOIN readings r ON r.match_id = c1.match_id AND r.slot = c1.opp AND abs(r.seconds - sec) <= 1.5 GROUP BY 1, 2),
  ctx AS (SELECT c1.match_id, c1.slot, c1.ko_frame, c1.option, c1.at_frame, dm.v AS my_damage, dt.v AS their_damage, {_PREFIX} FROM c1 LEFT JOIN dm USING (match_id, ko_frame) LEFT JOIN dt USING (match_id, ko_frame)
     JOIN v_players pd ON pd.match_id = c1.match_id AND pd.slot = c1.slot JOIN wf d ON d.weapon = 'Brand#' || (pd.character_id + 1)
     JOIN v_players pa ON pa.match_id = c1.match_id AND pa.slot = c1.opp JOIN wf a ON a.weapon = 'Brand#' || (pa.character_id + 1)),
  {cells_sql('ctx', 'match_id, slot, ko_frame, option, at_frame, my_damage, their_damage')},
  ev AS (SELECT match_id, slot, ko_frame, option, at_frame, my_damage, their_damage, d, ord, sum(score * p) AS ev, min(row_confidence) AS confidence FROM cells JOIN tend USING (match_id, a) GROUP BY ALL)"""


@query("expected_values", f"""WITH RECURSIVE {REVIEW_SQL} SELECT match_id, ko_frame, d, round(ev + 1e-9, 6) AS ev, confidence FROM ev""")
def _(t):
    deaths, opp = deaths_of(t)
    frames = R.frame_sets(t.presses)
    tend = R.tendency(deaths, opp, frames, WINDOW, PAIR, FRAME_BLOCK).select("match_id", "a", "p")
    chosen = R.committed_options(deaths, frames, WINDOW, PAIR, FRAME_BLOCK).join(opp, "match_id").withColumn("seconds", F.col("at_frame") / 60.0)
    mine = D.damage_at(chosen, readings(t), width=SECOND_BLOCK).withColumnRenamed("damage", "my_damage").withColumnRenamed("slot", "me").withColumnRenamed("opp", "slot")
    both = D.damage_at(mine, readings(t), width=SECOND_BLOCK).withColumnRenamed("damage", "their_damage").withColumnRenamed("slot", "opp").withColumnRenamed("me", "slot")
    ctx = R.with_facts(both, player_facts(t)).select("match_id", "ko_frame", "my_damage", "their_damage", "mine", "theirs")
    return R.expected_values(R.payoff_cells(ctx), tend, ["match_id", "ko_frame"], ["match_id"]).select(
        "match_id", "ko_frame", "d", near(F.col("ev")).alias("ev"), "confidence")


@query("death_review", f"""WITH RECURSIVE {REVIEW_SQL},
  b AS (SELECT match_id, slot, ko_frame, option, at_frame, my_damage, their_damage, arg_max(d, (ev, -ord)) AS best, max(ev) AS best_ev, max(ev) FILTER (WHERE d = option) AS ev,
     max(confidence) FILTER (WHERE d = option) AS confidence FROM ev GROUP BY ALL)
  SELECT match_id, slot, ko_frame, option, at_frame, round(my_damage + 1e-9, 6) AS my_damage, round(their_damage + 1e-9, 6) AS their_damage, best, round(best_ev + 1e-9, 6) AS best_ev, round(ev + 1e-9, 6) AS ev,
    round(best_ev - ev + 1e-9, 6) AS gap, confidence FROM b""")
def _(t):
    r = R.review_deaths(t.kos, t.players, t.presses, readings(t), player_facts(t), window=WINDOW, pair_frames=PAIR, width=FRAME_BLOCK)
    return r.select("match_id", "slot", "ko_frame", "option", "at_frame", "best", "confidence",
                    *[near(F.col(c)).alias(c) for c in ("my_damage", "their_damage", "best_ev", "ev", "gap")])
