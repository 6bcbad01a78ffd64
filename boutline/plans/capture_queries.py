"""Closed-set readings, findings, habits and capture comparison."""

from pyspark.sql import functions as F

from boutline.operators import classify as C
from boutline.operators import findings as FI
from boutline.operators import panel as P
from boutline.operators.settle import settle
from boutline.plans.panel_queries import EVENTS_SQL, HITS_SQL, PUNISH_SQL, events_of, punishes_of
from boutline.plans.registry import near, query
from boutline.plans.testviews import SECOND_BLOCK

B = SECOND_BLOCK


def _templates(t):
    """The first vector of each label and sign of its first component: two variants per name."""
    return t.embeddings.groupBy(F.col("label").cast("string").alias("name"), (F.col("embedding")[0] >= 0).alias("v")).agg(
        F.min_by("embedding", "vec_id").alias("vec")).select("name", "vec")


@query("template_match", """WITH tp AS (SELECT CAST(label AS VARCHAR) AS name, embedding[1] >= 0 AS v, arg_min(embedding, vec_id) AS vec FROM embeddings GROUP BY 1, 2),
   d AS (SELECT e.vec_id, tp.name, min(list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: abs(e.embedding[i]::DOUBLE - tp.vec[i]::DOUBLE))) / len(e.embedding)) AS d FROM embeddings e CROSS JOIN tp GROUP BY 1, 2),
   r AS (SELECT *, lead(d) OVER w AS d1, row_number() OVER w AS rn FROM d WINDOW w AS (PARTITION BY vec_id ORDER BY d, name))
   SELECT vec_id, CASE WHEN d <= 0.13 AND coalesce(d1, 9.9) - d >= 0.004 THEN name END AS name, round(d, 6) AS d0, round(d1, 6) AS d1 FROM r WHERE rn = 1""")
def _(t):
    reads = t.embeddings.select("vec_id", F.col("embedding").alias("vec"))
    return C.template_match(reads, _templates(t), key="vec_id", max_dist=0.13, min_margin=0.004).select(
        "vec_id", "name", F.round("d0", 6).alias("d0"), F.round("d1", 6).alias("d1"))


@query("fuzzy_snap", """WITH r AS (SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, 'r', '') WHEN 2 THEN replace(p_name, 'o', '0') WHEN 3 THEN p_name || p_size ELSE reverse(p_name) END AS text FROM part),
   k AS (SELECT DISTINCT p_name AS key FROM part),
   c AS (SELECT text, key, levenshtein(text, key) AS d FROM r JOIN k ON abs(length(key) - length(text)) <= greatest(2, length(key) // 4)),
   s AS (SELECT *, row_number() OVER w AS rn, lead(d) OVER w AS d1 FROM c WINDOW w AS (PARTITION BY text ORDER BY d, key)),
   b AS (SELECT * FROM s WHERE rn = 1)
   SELECT r.text, CASE WHEN ok THEN key END AS name, CAST(CASE WHEN ok THEN d END AS INTEGER) AS edits FROM r LEFT JOIN
     (SELECT text, key, d, length(text) >= 4 AND (d = 0 OR (d <= least(2, length(text) // 4 + 1) AND coalesce(d1 <> d, true))) AS ok FROM b) x ON x.text = r.text""")
def _(t):
    text = F.expr("""case p_partkey % 5 when 0 then p_name when 1 then replace(p_name, 'r', '') when 2 then replace(p_name, 'o', '0')
        when 3 then p_name || p_size else reverse(p_name) end""")
    return C.fuzzy_snap(t.part.select(text.alias("text")), t.part.select(F.col("p_name").alias("key")))


@query("name_vote", """WITH n AS (SELECT match_id AS segment, CASE slot WHEN 0 THEN 'L' ELSE 'R' END AS side, event_type AS name, count(*) AS n, min(seq) AS f FROM v_ticks WHERE event_type <> 'error' GROUP BY 1, 2, 3)
   SELECT segment, side, CASE WHEN max(n) >= 2 THEN arg_max(name, (n, -f)) END AS name, string_agg(name || ':' || n, ',' ORDER BY name) AS seen FROM n GROUP BY 1, 2""")
def _(t):
    reads = t._ticks.select(
        F.col("match_id").alias("segment"), F.when(F.col("slot") == 0, "L").otherwise("R").alias("side"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("name"), F.col("seq").alias("ord"))
    seen = F.array_join(F.transform(F.array_sort(F.map_entries("seen")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return C.name_vote(reads).withColumn("seen", seen)


YOU_SQL = """nm AS (SELECT DISTINCT video, segment, name FROM (SELECT video, segment, unnest([left_name, right_name]) AS name FROM v_segments) WHERE name IS NOT NULL),
   nc AS (SELECT video, name, count(*) AS n FROM nm GROUP BY 1, 2), ns AS (SELECT video, count(*) AS segments FROM v_segments GROUP BY 1),
   nt AS (SELECT *, coalesce(lead(n) OVER w, 0) AS nxt, row_number() OVER w AS rn FROM nc WINDOW w AS (PARTITION BY video ORDER BY n DESC, name)),
   you AS (SELECT ns.video, segments, CASE WHEN n >= 0.6 * segments AND n > nxt THEN name END AS you, coalesce(n, 0) AS seen, coalesce(nxt, 0) AS nxt FROM ns LEFT JOIN (SELECT * FROM nt WHERE rn = 1) t USING (video))"""


@query("capture_player", f"""WITH {YOU_SQL} SELECT video, segments, you, seen, nxt AS "next" FROM you""")
def _(t):
    return FI.capture_player(t.segments)


@query("capture_opponents", f"""WITH {YOU_SQL}, s AS (SELECT v.*, you FROM v_segments v JOIN you USING (video)),
   l AS (SELECT video, count(*) FILTER (WHERE left_name = you) - count(*) FILTER (WHERE right_name = you) AS lead_ FROM s GROUP BY 1),
   p AS (SELECT video, you, lead_, 'L' AS side, left_name AS name FROM s JOIN l USING (video) UNION ALL SELECT video, you, lead_, 'R', right_name FROM s JOIN l USING (video))
   SELECT video, name, count(*) AS n FROM p WHERE name IS NOT NULL AND CASE WHEN lead_ > 0 THEN side <> 'L' WHEN lead_ < 0 THEN side <> 'R' ELSE coalesce(name <> you, true) END GROUP BY 1, 2""")
def _(t):
    return FI.capture_opponents(t.segments, FI.capture_player(t.segments))


OPENF_SQL = f"""{EVENTS_SQL}, {YOU_SQL},
   of0 AS (SELECT e.*, v.video, you, coalesce(CASE free WHEN 'L' THEN left_name ELSE right_name END, free) AS free_name, coalesce(CASE stuck WHEN 'L' THEN left_name ELSE right_name END, stuck) AS stuck_name
     FROM events_ e JOIN v_segments v USING (segment) JOIN you ON you.video = v.video),
   openf AS (SELECT printf('%d:open:%d:%.1f', video, segment, anchor) AS id, *, CASE WHEN you IS NULL THEN 'unknown' WHEN free_name = you THEN 'you' ELSE 'them' END AS whose FROM of0)"""

PUNF_SQL = f"""pf0 AS (SELECT p.*, v.video, you, left_name, right_name, CASE side WHEN 'L' THEN left_name ELSE right_name END AS name FROM punishes p JOIN v_segments v USING (segment) JOIN you ON you.video = v.video),
   punf AS (SELECT printf('%d:punish:%d:%.1f', video, segment, t) AS id, *, CASE WHEN you IS NULL OR name IS NULL THEN 'unknown' WHEN name = you THEN 'you' ELSE 'them' END AS whose FROM pf0)"""


def open_findings_of(t):
    return FI.opening_findings(events_of(t), t.segments, FI.capture_player(t.segments))


@query("findings", f"""WITH RECURSIVE {OPENF_SQL}, {PUNISH_SQL}, {PUNF_SQL}
   SELECT id, video, segment, 'opening' AS kind, whose, CASE WHEN whose = 'you' AND free_name = stuck_name THEN 'You (' || free || ' side)' WHEN whose = 'you' THEN 'You' WHEN whose = 'them' THEN free_name || ' (them)'
       ELSE free_name || ' (' || free || ' side)' END || ', ' || frames || ' frames free, no new attack' AS title, frames AS size FROM openf
   UNION ALL SELECT id, video, segment, 'punish', whose, CASE WHEN whose = 'you' AND left_name = right_name THEN 'You (' || side || ' side)' WHEN whose = 'you' THEN 'You' WHEN whose = 'them' THEN name || ' (them)'
       ELSE side || ' side (' || coalesce(name, '?') || ')' END || CASE WHEN damage IS NOT NULL THEN ', Punish! into ' || damage || ' damage over ' || hits || ' hits' ELSE ', the game called Punish!' END, damage FROM punf""")
def _(t):
    you = settle(FI.capture_player(t.segments))
    o = open_findings_of(t).select("id", "video", "segment", "kind", "whose", "title", F.col("frames").alias("size"))
    p = FI.punish_findings(punishes_of(t), t.segments, you).select("id", "video", "segment", "kind", "whose", "title", F.col("damage").alias("size"))
    return o.unionByName(p)


def named_combos(t, keep=()):
    hits = settle(P.combo_hits(t.samples, width=B))
    c = P.combos(hits).select("segment", "side", "t0", "damage", "hits")
    return c.join(t.segments, "segment").select("video", "segment", "side", "t0", "damage", "hits", F.coalesce(
        F.when(F.col("side") == "L", F.col("left_name")).otherwise(F.col("right_name")), F.lit("?")).alias("character")), hits


def named_punishes(t, hits):
    from boutline.plans.panel_queries import captions
    p = P.punish_join(captions(t), hits, P.combos(hits), width=B)
    return p.join(t.segments, "segment").select("video", "segment", "side", "t", "damage", "hits",
                                                F.when(F.col("side") == "L", F.col("left_name")).otherwise(F.col("right_name")).alias("character"))


NAMED_SQL = f"""{PUNISH_SQL}, {YOU_SQL},
   ncombos AS (SELECT v.video, c.segment, c.side, c.t0, c.damage, c.hits, coalesce(CASE side WHEN 'L' THEN left_name ELSE right_name END, '?') AS character FROM combos c JOIN v_segments v USING (segment)),
   npun AS (SELECT v.video, p.segment, p.side, p.t, p.damage, p.hits, CASE side WHEN 'L' THEN left_name ELSE right_name END AS character FROM punishes p JOIN v_segments v USING (segment))"""

CONV_SQL = f"""cm AS (SELECT c.*, coalesce(character = you, false) AS mine FROM ncombos c JOIN you USING (video)), cx AS (SELECT *, bool_or(mine) OVER (PARTITION BY video) AS has FROM cm),
   csum AS (SELECT video, count(*) AS yours, max(damage) AS biggest, count(*) FILTER (WHERE hits <= 1) / count(*)::DOUBLE AS one_hit_share, CAST(trunc(median(damage)) AS INTEGER) AS median_damage FROM cx WHERE mine OR NOT has GROUP BY 1),
   psum AS (SELECT video, count(*) AS punishes_yours, count(*) FILTER (WHERE hits <= 1) AS punish_one_hit, CAST(trunc(median(damage)) AS INTEGER) AS punish_median_damage FROM npun JOIN you USING (video)
     WHERE coalesce(damage, 0) <> 0 AND (you IS NULL OR coalesce(character = you, false)) GROUP BY 1),
   conv AS (SELECT csum.*, coalesce(punishes_yours, 0) AS punishes_yours, punish_one_hit, punish_median_damage FROM csum LEFT JOIN psum USING (video))"""


def conversion_of(t):
    c, hits = named_combos(t)
    return FI.conversion(c, named_punishes(t, hits), FI.capture_player(t.segments))


@query("conversion", f"WITH {NAMED_SQL}, {CONV_SQL} SELECT * REPLACE (round(one_hit_share + 1e-9, 6) AS one_hit_share) FROM conv")
def _(t):
    return conversion_of(t).withColumn("one_hit_share", near(F.col("one_hit_share")))


@query("opponent_habits", f"""WITH RECURSIVE {OPENF_SQL}, {NAMED_SQL.replace(YOU_SQL + ',', '').replace(', ' + YOU_SQL, '')},
   ht AS (SELECT o.video, o.segment, o.free_name, o.frames, o.anchor, (SELECT min((c.t0, c.damage)) FROM ncombos c WHERE c.segment = o.segment AND c.side = o.free AND c.t0 BETWEEN o.anchor AND o.anchor + 2.0) AS h
      FROM openf o WHERE whose = 'them' AND free_name NOT IN ('L', 'R', '?')),
   w AS (SELECT free_name AS name, count(DISTINCT video) AS captures, count(DISTINCT segment) AS segments, count(*) AS windows, max(frames) AS longest, count(h) AS pressed, CAST(trunc(median(frames)) AS INTEGER) AS median_frames FROM ht GROUP BY 1),
   g AS (SELECT character AS name, count(*) AS their_combos, max(damage) AS their_biggest, CAST(trunc(median(damage)) AS INTEGER) AS their_median_damage FROM ncombos JOIN you USING (video) WHERE you IS NOT NULL AND character <> you AND character <> '?' GROUP BY 1),
   pu AS (SELECT character AS name, count(*) AS punished_you FROM npun JOIN you USING (video) WHERE you IS NOT NULL AND character <> you GROUP BY 1),
   rr AS (SELECT free_name AS name, CASE WHEN h IS NOT NULL THEN video || ': ' || frames || ' frames free, then a hit for ' || h[2] ELSE video || ': ' || frames || ' frames free, nothing landed' END AS x,
      row_number() OVER (PARTITION BY free_name ORDER BY video, frames DESC, segment, anchor) AS r FROM ht),
   rc AS (SELECT name, string_agg(x, '; ' ORDER BY r) AS receipts FROM rr WHERE r <= 6 GROUP BY 1)
   SELECT coalesce(w.name, g.name) AS name, coalesce(captures, 0) AS captures, coalesce(segments, 0) AS segments, coalesce(windows, 0) AS windows, coalesce(windows, 0) >= 3 AS enough, median_frames, longest, coalesce(pressed, 0) AS pressed,
     round(pressed / windows + 1e-9, 6) AS pressed_share, coalesce(their_combos, 0) AS their_combos, their_median_damage, their_biggest, coalesce(punished_you, 0) AS punished_you, receipts
   FROM w FULL JOIN g ON g.name = w.name LEFT JOIN pu ON pu.name = coalesce(w.name, g.name) LEFT JOIN rc ON rc.name = coalesce(w.name, g.name)""")
def _(t):
    you = settle(FI.capture_player(t.segments))
    c, hits = named_combos(t)
    return FI.opponent_habits(open_findings_of(t), c, named_punishes(t, hits), you, width=B).withColumn("pressed_share", near(F.col("pressed_share")))


@query("capture_rates", f"""WITH RECURSIVE {EVENTS_SQL}, {NAMED_SQL}, {CONV_SQL},
   lv2 AS (SELECT video, sum(active_seconds) AS live, count(*) AS segments FROM v_segments GROUP BY 1),
   opn AS (SELECT segment // 5 AS video, count(*) AS openings, sum(frames) AS ff FROM events_ GROUP BY 1),
   r AS (SELECT l.video, l.segments, live / 60 AS minutes, live / 60 < 1.0 AS thin, coalesce(openings, 0) AS openings, coalesce(openings, 0) / (live / 60) AS openings_per_min, coalesce(ff, 0) / 59.94::DOUBLE / live AS free_share,
       yours / (live / 60) AS combos_per_min, median_damage, one_hit_share, punishes_yours / (live / 60) AS punishes_per_min FROM lv2 l LEFT JOIN opn USING (video) LEFT JOIN conv USING (video)),
   b AS (SELECT * FROM r WHERE NOT thin AND combos_per_min IS NOT NULL ORDER BY video LIMIT 1)
   SELECT r.video, r.segments, round(r.minutes, 6) AS minutes, r.thin, r.openings, round(r.openings_per_min + 1e-9, 6) AS openings_per_min, round(r.free_share + 1e-9, 6) AS free_share, round(r.combos_per_min + 1e-9, 6) AS combos_per_min,
     r.median_damage, round(r.punishes_per_min + 1e-9, 6) AS punishes_per_min,
     CASE WHEN NOT r.thin AND r.combos_per_min IS NOT NULL AND r.video <> b.video THEN round((r.openings_per_min - b.openings_per_min) / nullif(abs(b.openings_per_min), 0) + 1e-9, 6) END AS delta_openings_per_min,
     CASE WHEN NOT r.thin AND r.combos_per_min IS NOT NULL AND r.video <> b.video THEN round((r.median_damage - b.median_damage) / nullif(abs(b.median_damage), 0) + 1e-9, 6) END AS delta_median_damage FROM r, b""")
def _(t):
    ev = events_of(t).withColumn("video", F.expr("segment div 5"))
    r = FI.capture_rates(t.segments, ev, conversion_of(t), thin_minutes=1.0)
    return r.select("video", "segments", F.round("minutes", 6).alias("minutes"), "thin", "openings", "median_damage",
                    *[near(F.col(c)).alias(c) for c in ("openings_per_min", "free_share", "combos_per_min", "punishes_per_min", "delta_openings_per_min", "delta_median_damage")])


GRADES_SQL = """grades AS (SELECT id, CASE WHEN frames % 3 = 0 THEN 'lag' ELSE 'real' END AS tag, 'take ' || frames AS take FROM openf WHERE frames >= 20)"""


def grades_of(openf):
    return openf.filter("frames >= 20").select("id", F.array(F.expr("case when frames % 3 = 0 then 'lag' else 'real' end")).alias("tags"),
                                                 F.concat(F.lit("take "), F.col("frames")).alias("take"), F.lit("right").alias("verdict"))


@query("tag_counts", f"""WITH RECURSIVE {OPENF_SQL}, {GRADES_SQL} SELECT CAST(split_part(id, ':', 1) AS BIGINT) AS video, tag, count(*) AS n FROM grades GROUP BY 1, 2""")
def _(t):
    return grades_of(open_findings_of(t)).select(F.split("id", ":")[0].try_cast("bigint").alias("video"), F.explode("tags").alias("tag")).groupBy(
        "video", "tag").agg(F.count("*").alias("n"))


@query("capture_takes", f"""WITH RECURSIVE {OPENF_SQL}, {GRADES_SQL}, g AS (SELECT CAST(split_part(id, ':', 1) AS BIGINT) AS video, id, tag FROM grades),
   n AS (SELECT video, tag, count(*) AS n FROM g GROUP BY 1, 2), l AS (SELECT video FROM v_segments GROUP BY 1 HAVING sum(active_seconds) > 0)
   SELECT video, (SELECT count(DISTINCT id) FROM g WHERE g.video = l.video) AS takes, coalesce((SELECT string_agg(tag || ':' || n, ', ' ORDER BY n DESC, tag) FROM n WHERE n.video = l.video), '') AS tags FROM l""")
def _(t):
    r = FI.capture_takes(t.segments, grades_of(open_findings_of(t)))
    return r.select("video", "takes", F.array_join(F.transform("tags", lambda x: F.concat(x["tag"], F.lit(":"), x["n"].cast("string"))), ", ").alias("tags"))


@query("lag_notes", f"""WITH RECURSIVE {OPENF_SQL}, {GRADES_SQL} SELECT split_part(id, ':', 1) AS video, CAST(split_part(id, ':', 3) AS BIGINT) AS segment, count(*) AS lag_windows FROM grades WHERE tag = 'lag' GROUP BY 1, 2""")
def _(t):
    return FI.lag_notes(grades_of(open_findings_of(t)))


@query("finding_takes", f"""WITH RECURSIVE {OPENF_SQL}, {GRADES_SQL},
   x AS (SELECT o.id AS fid, unnest(list_distinct(list_append(list_transform(members, lambda m: printf('%d:open:%d:%.1f', video, segment, m)), o.id))) AS id FROM openf o)
   SELECT fid AS id, arg_min(tag, (id <> fid, id)) AS tag, arg_min(take, (id <> fid, id)) AS take FROM x JOIN grades USING (id) GROUP BY 1""")
def _(t):
    openf = settle(open_findings_of(t))
    return FI.finding_takes(openf, grades_of(openf)).select("id", F.get("tags", F.lit(0)).alias("tag"), "take")


STARTERS_SQL = f"""{HITS_SQL}, nc AS (SELECT c.segment, c.side, c.t0, c.damage, coalesce(CASE side WHEN 'L' THEN left_name ELSE right_name END, '?') AS character FROM combos c JOIN v_segments v USING (segment)),
   tb AS (SELECT 'Fighter-' || (p_partkey % 10) AS char, p_name AS input, p_size % 4 + 5 AS startup, CAST(floor(p_retailprice) AS INTEGER) % 20 AS damage FROM part),
   rd AS (SELECT segment, side, t AS st, startup, damage AS shown FROM v_samples WHERE startup IS NOT NULL),
   a AS (SELECT nc.*, rd.startup, rd.shown, row_number() OVER (PARTITION BY nc.segment, nc.side, nc.t0 ORDER BY rd.st DESC) AS rn FROM nc LEFT JOIN rd ON rd.segment = nc.segment AND rd.side = nc.side AND rd.st BETWEEN nc.t0 - 1.0 AND nc.t0),
   k AS (SELECT char, startup, damage, list_sort(list(DISTINCT input)) AS names FROM tb GROUP BY 1, 2, 3),
   starters AS (SELECT a.segment, a.side, a.t0, character, a.startup, a.shown, a.damage, CASE WHEN len(names) BETWEEN 1 AND 3 THEN array_to_string(names, ' / ') END AS names,
     CASE WHEN names IS NULL THEN 'no match' WHEN len(names) = 1 THEN 'exact' WHEN len(names) <= 3 THEN 'set' ELSE 'not identified' END AS how
   FROM a LEFT JOIN k ON k.char = a.character AND k.startup = a.startup AND k.damage = a.shown WHERE rn = 1)"""


@query("starters", f"WITH {STARTERS_SQL} SELECT * FROM starters")
def _(t):
    return starters_of(t)


@query("starter_summary", f"""WITH {STARTERS_SQL} SELECT character, names, count(*) AS times, median(damage)::DOUBLE AS median, max(damage) AS best FROM starters WHERE names IS NOT NULL GROUP BY 1, 2""")
def _(t):
    return FI.starter_summary(starters_of(t))


def starters_of(t):
    c, _ = named_combos(t)
    table = t.part.select(F.concat(F.lit("Fighter-"), (F.col("p_partkey") % 10).cast("string")).alias("char"), F.col("p_name").alias("input"),
                          (F.col("p_size") % 4 + 5).alias("startup"), (F.floor("p_retailprice").cast("int") % 20).alias("damage"))
    return FI.starters(c.drop("video", "hits"), t.samples, table, width=B)
