"""Projections and scalar rules over whole tables."""

from pyspark.sql import functions as F

from boutline.functions import damage as D
from boutline.functions import scalars as S
from boutline.plans.registry import query


@query("ms_to_frames", """SELECT l_orderkey, l_linenumber, l_partkey,
  CAST(round_even(l_extendedprice / (1000.0::DOUBLE / 60), 0) AS BIGINT) AS frame FROM lineitem""")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", S.ms_to_frames(F.col("l_extendedprice")).alias("frame"))


@query("content_id", "SELECT doc_id, 'bh_' || substr(sha256(text), 1, 16) AS content_id FROM documents")
def _(t):
    return t.documents.select("doc_id", S.content_id(F.col("text")).alias("content_id"))


@query("moment_id", """SELECT event_id, 'm_' || substr(sha1(user_id // 2 || '|' ||
  CASE WHEN event_type = 'error' THEN 'None' ELSE CAST(user_id % 2 AS VARCHAR) END || '|' || event_id || '|' || event_type), 1, 12) AS moment_id
  FROM events""")
def _(t):
    slot = F.when(F.col("event_type") != "error", F.col("user_id") % 2)
    return t.events.select("event_id", S.moment_id(F.expr("user_id div 2"), slot, F.col("event_id"), F.col("event_type")).alias("moment_id"))


@query("filename_fields", r"""SELECT match_id, nullif(regexp_extract(source_file, '\[([\d.]+)\]', 1), '') AS patch,
  nullif(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(source_file, '\[[\d.]+\]', '', 'g'), '\.[A-Za-z]+$', ''), '\(\d+\)', '', 'g')), '([a-z])([A-Z])', '\1 \2', 'g'), '') AS stage
  FROM v_matches""")
def _(t):
    f = F.col("source_file")
    return t.matches.select("match_id", S.patch_of(f).alias("patch"), S.stage_of(f).alias("stage"))


@query("slugify", """SELECT page_id, substr(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), 1, 40) AS dashed,
  substr(trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_'), 1, 60) AS scored FROM pages""")
def _(t):
    return t.pages.select("page_id", S.slug(F.col("url")).alias("dashed"), S.slug(F.col("url"), "_", 60).alias("scored"))


@query("clock_parse", """WITH c AS (SELECT event_id, (event_id // 3600) || ':' || (event_id // 60 % 60) || ':' || (event_id % 60) || ',' || (user_id % 1000) AS a,
    (user_id // 60) || ':' || CASE WHEN event_type = 'error' THEN 'x' ELSE CAST(user_id % 60 AS VARCHAR) END AS b, value FROM events)
  SELECT event_id, round(CAST(split_part(a, ':', 1) AS DOUBLE) * 3600 + CAST(split_part(a, ':', 2) AS DOUBLE) * 60
     + CAST(replace(split_part(a, ':', 3), ',', '.') AS DOUBLE), 6) AS long_form,
   CAST(split_part(b, ':', 1) AS DOUBLE) * 60 + TRY_CAST(split_part(b, ':', 2) AS DOUBLE) AS short_form,
   CAST(floor(value / 60) AS BIGINT) || ':' || lpad(CAST(CAST(round_even(value - floor(value / 60) * 60, 0) AS BIGINT) AS VARCHAR), 2, '0') AS shown FROM c""")
def _(t):
    e = t.events
    long_form = F.concat(F.expr("event_id div 3600"), F.lit(":"), F.expr("event_id div 60 % 60"), F.lit(":"),
                         F.expr("event_id % 60"), F.lit(","), F.expr("user_id % 1000"))
    short = F.concat(F.expr("user_id div 60"), F.lit(":"),
                     F.when(F.col("event_type") == "error", "x").otherwise(F.expr("string(user_id % 60)")))
    return e.select("event_id", F.round(S.clock_seconds(long_form), 6).alias("long_form"),
                    S.clock_seconds(short).alias("short_form"), S.clock_text(F.col("value")).alias("shown"))


@query("num_or_null", """SELECT event_id, TRY_CAST(trim(regexp_extract(props, ': ?([^}]*)', 1)) AS INTEGER) AS k,
  TRY_CAST(event_type AS INTEGER) AS none FROM events""")
def _(t):
    return t.events.select("event_id", S.number_or_null(F.regexp_extract("props", ": ?([^}]*)", 1)).alias("k"),
                           S.number_or_null(F.col("event_type")).alias("none"))


@query("panel_value", r"""WITH p AS (SELECT event_id, CASE event_type WHEN 'error' THEN '-' WHEN 'click' THEN '-' || CAST(floor(value) AS INTEGER) || '(-1)'
    ELSE CAST(CAST(floor(value) AS INTEGER) AS VARCHAR) END AS raw FROM events)
  SELECT event_id, TRY_CAST(nullif(regexp_extract(raw, '^(-?\d+)', 1), '') AS INTEGER) AS recovery,
   CASE WHEN TRY_CAST(nullif(regexp_extract(raw, '^(-?\d+)', 1), '') AS INTEGER) >= 0 THEN TRY_CAST(nullif(regexp_extract(raw, '^(-?\d+)', 1), '') AS INTEGER) END AS damage
  FROM p""")
def _(t):
    whole = F.floor("value").cast("int").cast("string")
    raw = (F.when(F.col("event_type") == "error", "-")
           .when(F.col("event_type") == "click", F.concat(F.lit("-"), whole, F.lit("(-1)"))).otherwise(whole))
    return t.events.select("event_id", S.panel_value(raw, signed=True).alias("recovery"), S.panel_value(raw).alias("damage"))


HSV_SQL = """px AS (SELECT event_id, user_id, CAST(floor(value) AS INTEGER) % 256 AS r, CAST(event_id % 256 AS INTEGER) AS g, CAST(user_id % 97 AS INTEGER) AS b FROM events),
  mm AS (SELECT *, greatest(r, g, b) AS top, least(r, g, b) AS low FROM px),
  h0 AS (SELECT *, 60.0::DOUBLE * CASE WHEN top = low THEN 0.0 WHEN r = top THEN (g - b) / (top - low)::DOUBLE
     WHEN g = top THEN (b - r) / (top - low)::DOUBLE + 2 ELSE (r - g) / (top - low)::DOUBLE + 4 END AS h FROM mm),
  hsv AS (SELECT event_id, user_id, CASE WHEN h < 0 THEN h + 360 ELSE h END AS hue, CASE WHEN top = 0 THEN 0.0 ELSE (top - low) / top::DOUBLE END AS sat,
     top / 255.0::DOUBLE AS val FROM h0),
  warm AS (SELECT *, sat > 0.40 AND val > 0.45 AND (hue <= 70 OR hue >= 335) AS warm, CASE WHEN hue > 180 THEN hue - 360 ELSE hue END AS signed FROM hsv)"""


def pixels(t):
    """One coloured pixel per event, several per reading."""
    px = t.events.select("event_id", "user_id", (F.floor("value").cast("int") % 256).alias("r"),
                         (F.col("event_id") % 256).cast("int").alias("g"), (F.col("user_id") % 97).cast("int").alias("b"))
    h, s, v = D.hsv(F.col("r"), F.col("g"), F.col("b"))
    px = px.select("event_id", "user_id", h.alias("hue"), s.alias("sat"), v.alias("val"))
    return px.select("*", D.is_warm(F.col("hue"), F.col("sat"), F.col("val")).alias("warm"), D.signed_hue(F.col("hue")).alias("signed"))


@query("hsv_columns", f"""WITH {HSV_SQL} SELECT event_id, round(hue, 6) AS hue, round(sat, 6) AS sat, round(val, 6) AS val, warm,
   round(signed, 6) AS signed FROM warm""")
def _(t):
    return pixels(t).select("event_id", *[F.round(c, 6).alias(c) for c in ("hue", "sat", "val", "signed")], "warm")


@query("damage_ramp", f"""WITH {HSV_SQL}, est AS (SELECT event_id, CASE WHEN NOT warm OR sat < 0.22 THEN 0.0 ELSE
   greatest(0.0, least(1.0, 0.35 * least(1.0, sat / 0.85) + 0.65 * greatest(0.0, least(1.0, (60 - signed) / 60)))) END AS estimate FROM warm)
   SELECT event_id, round(estimate, 6) AS estimate, estimate < 0.12 AS fresh FROM est""")
def _(t):
    hue = F.when(F.col("warm"), F.col("signed"))
    est = D.ramp(hue, F.col("sat"))
    return pixels(t).select("event_id", F.round(est, 6).alias("estimate"), (est < D.FRESH_ESTIMATE).alias("fresh"))


@query("arc_reading", f"""WITH {HSV_SQL}, keep AS (SELECT user_id, CASE WHEN warm THEN signed END AS h, sat, val FROM warm
     WHERE warm OR (sat < 0.22 AND val > 0.70)),
   med AS (SELECT user_id, list_sort(list(h) FILTER (WHERE h IS NOT NULL)) AS hs, list_sort(list(sat)) AS ss, list_sort(list(val)) AS vs FROM keep GROUP BY 1),
   ids AS (SELECT DISTINCT user_id FROM events)
   SELECT user_id, round(hs[len(hs) // 2 + 1], 6) AS hue, round(coalesce(ss[len(ss) // 2 + 1], 0.0), 6) AS sat, round(coalesce(vs[len(vs) // 2 + 1], 0.0), 6) AS val
   FROM ids LEFT JOIN med USING (user_id)""")
def _(t):
    from boutline.operators.damage import arc_reading
    return arc_reading(pixels(t), "user_id").select("user_id", *[F.round(c, 6).alias(c) for c in ("hue", "sat", "val")])


@query("name_filter", r"""WITH n AS (SELECT user_id, event_id, CASE event_id % 5 WHEN 0 THEN event_type || user_id WHEN 1 THEN 'Playlist' || user_id
      WHEN 2 THEN CAST(event_id % 50 AS VARCHAR) WHEN 3 THEN event_type || '_' || (user_id % 7) ELSE 'a!' || event_type END AS name FROM events)
   SELECT name, min(event_id) AS first_seen, arg_min(user_id, event_id) AS user_id FROM n WHERE regexp_full_match(name, '[A-Za-z0-9 _\-.]{3,20}')
     AND regexp_matches(name, '[A-Za-z]') AND NOT starts_with(name, 'Playlist') GROUP BY name""")
def _(t):
    n = F.expr("""case event_id % 5 when 0 then event_type || user_id when 1 then 'Playlist' || user_id
        when 2 then string(event_id % 50) when 3 then event_type || '_' || (user_id % 7) else 'a!' || event_type end""")
    named = t.events.select("user_id", "event_id", n.alias("name")).filter(S.plausible_name(F.col("name")))
    return named.groupBy("name").agg(F.min("event_id").alias("first_seen"), F.min_by("user_id", "event_id").alias("user_id"))


@query("url_norm", r"""WITH u AS (SELECT page_id, url, 'https://' || CASE page_id % 3 WHEN 0 THEN 'x.com' WHEN 1 THEN 'www.x.com' ELSE 'mobile.twitter.com' END
      || '/' || regexp_extract(url, '^https?://(?:www\.)?([^/?#]+)', 1) || CASE WHEN page_id % 4 = 0 THEN '' ELSE '/status/' || page_id END || '?s=20' AS post FROM pages),
   n AS (SELECT page_id, url, split_part(regexp_replace(trim(post), '^https?://(www\.)?(x\.com|mobile\.twitter\.com)/', 'https://twitter.com/'), '?', 1) AS norm FROM u)
   SELECT page_id, norm, regexp_matches(norm, '^https://twitter\.com/[^/]+/status/\d+') AS valid, regexp_extract(norm, '^https://twitter\.com/([^/?#]+)', 1) AS handle,
     split_part(url, '?', 1) AS bare, regexp_extract(url, '^https?://(?:www\.)?([^/?#]+)', 1) AS host FROM n""")
def _(t):
    post = F.concat(F.lit("https://"), F.expr("case page_id % 3 when 0 then 'x.com' when 1 then 'www.x.com' else 'mobile.twitter.com' end"),
                    F.lit("/"), S.url_host(F.col("url")),
                    F.when(F.col("page_id") % 4 == 0, "").otherwise(F.concat(F.lit("/status/"), F.col("page_id"))), F.lit("?s=20"))
    n = t.pages.select("page_id", "url", S.status_url(post).alias("norm"))
    return n.select("page_id", "norm", S.is_status_url(F.col("norm")).alias("valid"),
                    F.regexp_extract("norm", r"^https://twitter\.com/([^/?#]+)", 1).alias("handle"),
                    F.split_part("url", F.lit("?"), F.lit(1)).alias("bare"), S.url_host(F.col("url")).alias("host"))


@query("grade_verdict", """WITH g AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'wrong' END AS given, list_filter([CASE WHEN quality = 1 THEN 'real' END, CASE WHEN doc_id % 3 = 0 THEN 'lag' END,
      CASE WHEN doc_id % 5 = 0 THEN 'bogus' END, CASE WHEN doc_id % 7 = 0 THEN 'spacing' END], lambda x: x IS NOT NULL) AS tags,
      CASE WHEN doc_id % 11 = 0 THEN 'take ' || doc_id ELSE ' ' END AS take FROM labels),
   k AS (SELECT *, list_filter(tags, lambda x: x IN ('real','lag','defend','spacing','misread','unsure')) AS kept FROM g)
   SELECT doc_id, array_to_string(kept, ',') AS tags, coalesce(given, CASE WHEN list_contains(kept, 'real') THEN 'right'
     WHEN list_contains(kept, 'lag') OR list_contains(kept, 'misread') THEN 'wrong' WHEN len(kept) > 0 OR length(trim(take)) > 0 THEN 'actually' END) AS verdict FROM k""")
def _(t):
    g = grades_of(t)
    return g.select("doc_id", F.array_join(S.clean_tags(F.col("tags")), ",").alias("tags"),
                    S.verdict(F.col("given"), F.col("tags"), F.col("take")).alias("verdict"))


def grades_of(t):
    """Takes on findings, from the labels table."""
    return t.labels.select(
        "doc_id", F.when(F.col("toxic") == 1, "wrong").alias("given"),
        F.array_compact(F.array(F.when(F.col("quality") == 1, "real"), F.when(F.col("doc_id") % 3 == 0, "lag"),
                                F.when(F.col("doc_id") % 5 == 0, "bogus"), F.when(F.col("doc_id") % 7 == 0, "spacing"))).alias("tags"),
        F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("take "), F.col("doc_id"))).otherwise(" ").alias("take"))


@query("verdict_caption", """WITH x AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN least(1.0, value / 200.0) END AS pct, event_type AS choice,
     CASE WHEN event_type <> 'view' THEN value / 300.0 - 0.2 END AS ev, (event_id % 100) / 100.0::DOUBLE AS best_ev FROM events),
   c AS (SELECT *, CAST(round_even(ev * 100, 0) AS BIGINT) AS ec, CAST(round_even(best_ev * 100, 0) AS BIGINT) AS bc FROM x)
   SELECT event_id, 'you ' || coalesce(CAST(round_even(pct * 100, 0) AS BIGINT) || '%', '?') || '  ' || choice || '  ' ||
     coalesce(CASE WHEN ec < 0 THEN '-' ELSE '+' END || (abs(ec) // 100) || '.' || lpad(CAST(abs(ec) % 100 AS VARCHAR), 2, '0'), '?') ||
     coalesce(CASE WHEN best_ev - ev > 0.02 THEN '  -> best ' || '+' || (bc // 100) || '.' || lpad(CAST(bc % 100 AS VARCHAR), 2, '0') END, '') AS caption FROM c""")
def _(t):
    return t.events.select("event_id", S.verdict_caption(
        F.when(F.col("event_type") != "error", F.least(F.lit(1.0), F.col("value") / 200.0)), F.col("event_type"),
        F.when(F.col("event_type") != "view", F.col("value") / 300.0 - 0.2), F.lit("best"),
        (F.col("event_id") % 100) / 100.0).alias("caption"))


@query("ko_victim", """WITH k AS (SELECT match_id, frame, seq, slot AS killer FROM v_ticks WHERE event_type = 'error'),
   n AS (SELECT match_id, count(*) AS n FROM v_players GROUP BY 1)
   SELECT match_id, frame, seq, killer AS "by", CASE WHEN n = 2 THEN 1 - killer END AS slot FROM k LEFT JOIN n USING (match_id)""")
def _(t):
    from boutline.operators.outcome import credit_victims
    kills = t._ticks.filter("event_type = 'error'").select("match_id", "frame", "seq", F.col("slot").alias("killer"))
    return credit_victims(kills, t.players)
