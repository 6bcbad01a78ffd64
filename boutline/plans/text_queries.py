"""Text: notation, pages, transcripts, posts, replies, trial scripts, quotes and threads."""

from pyspark.sql import functions as F

from boutline.functions import notation as N
from boutline.operators import textops as X
from boutline.plans.registry import query

TOKENS = ("jump", "2M", "5H", "236H", "j.HH", "cr.L", "MM", "nice", "dl.214U", "st.H+A", "land", "(5L)")


def combo_texts(t):
    """One combo text per order, a step per line item."""
    tok = F.element_at(F.array(*[F.lit(x) for x in TOKENS]), (F.col("l_partkey") % 12 + 1).cast("int"))
    sep = F.expr("case l_orderkey % 3 when 0 then ' > ' when 1 then ', ' else ' xx ' end")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice", tok.alias("tok")))), lambda s: s["tok"])
    raw = t.lineitem.groupBy("l_orderkey").agg(parts.alias("p")).select("l_orderkey", F.array_join("p", "\u0001").alias("j"))
    joined = F.replace("j", F.lit("\u0001"), sep)
    return raw.select("l_orderkey", F.when(F.col("l_orderkey") % 9 == 0, F.translate(joined, "LMHU", "ABCD")).otherwise(joined).alias("text"))


COMBO_SQL = f"""ct AS (SELECT l_orderkey, replace(string_agg([{', '.join(repr(x) for x in TOKENS)}][l_partkey % 12 + 1], ' > ' ORDER BY l_linenumber, l_partkey, l_extendedprice),
      ' > ', CASE l_orderkey % 3 WHEN 0 THEN ' > ' WHEN 1 THEN ', ' ELSE ' xx ' END) AS j FROM lineitem GROUP BY l_orderkey),
   texts AS (SELECT l_orderkey AS id, CASE WHEN l_orderkey % 9 = 0 THEN translate(j, 'LMHU', 'ABCD') ELSE j END AS text FROM ct)"""


def parse_sql(src: str) -> str:
    """Parsed combos of src(id, text): per candidate one regular expression, steps joined by spaces."""
    def rx(b):
        return "(?i)^((?:j\\.|dl\\.|c\\.|dc\\.|cl\\.|f\\.|st\\.|cr\\.|dj\\.|sj\\.)*)([1-9]{1,6})?(" + b + ")((?:\\+(?:" + b + "))*)(\\[\\]|\\(hold\\))?$"
    n, a = rx(N.BUTTONS), rx(N.LETTER_BUTTONS)
    g = lambda i: f"CASE WHEN letters THEN regexp_extract(w, '{a}', {i}) ELSE regexp_extract(w, '{n}', {i}) END"
    return f"""px AS (SELECT id, regexp_matches(text, '(^|[^A-Za-z])[1-9]?[BCD]([^A-Za-z]|$)') AND NOT regexp_matches(text, '(^|[^A-Za-z])[1-9]?j?\\.?[LMHU]([^A-Za-z]|$)') AS letters,
       list_filter(regexp_split_to_array(text, '[\\s>,~|;→]+'), lambda c: regexp_matches(c, '[A-Za-z0-9]')) AS cs FROM {src}),
     pc AS (SELECT id, letters, i, trim(cs[i], '()[]{{}}.:!?"''') AS w FROM px, unnest(range(1, len(cs) + 1)) u(i)),
     pm AS (SELECT *, CASE WHEN letters THEN regexp_matches(w, '{a}') ELSE regexp_matches(w, '{n}') END AS hit, regexp_matches(w, '(?i)^({N.WORDS})$') AS word,
       lower({g(1)}) AS p0, {g(2)} AS m0, upper({g(3)}) AS b0, upper({g(4)}) AS plus0 FROM pc),
     pn AS (SELECT *, replace(replace(replace(replace(replace(replace(replace(p0, 'cl.', ''), 'st.', '5'), 'cr.', '2'), 'c.', ''), 'f.', '6'), 'dj.', 'j.'), 'sj.', 'j.') AS p1,
       CASE WHEN letters AND regexp_matches(b0, '^[ABCD]+$') THEN translate(b0, 'ABCD', 'LMHU') ELSE b0 END AS b1, CASE WHEN letters THEN translate(plus0, 'ABCD', 'LMHU') ELSE plus0 END AS plus1 FROM pm),
     po AS (SELECT *, CASE WHEN m0 <> '' AND p1 LIKE '%5' THEN left(p1, length(p1) - 1) WHEN m0 <> '' AND p1 = '2' THEN '' ELSE p1 END AS p2 FROM pn),
     pp AS (SELECT *, CASE WHEN m0 = '' AND p2 IN ('', 'j.', 'dl.', 'dc.', 'j.dl.') THEN '5' ELSE m0 END AS m1 FROM po),
     pq AS (SELECT *, CASE WHEN hit THEN array_to_string(list_transform(range(1, length(b1) + 1), lambda k: regexp_replace(CASE WHEN k > 1 AND p2 LIKE 'j.%' THEN 'j.5' || b1[k] ELSE p2 || CASE WHEN k = 1 THEN m1 ELSE '5' END || b1[k]
         || CASE WHEN k = length(b1) THEN plus1 ELSE '' END END, '^j\\.5([0-9])', 'j.\\1')), ' ')
       WHEN word THEN CASE lower(w) WHEN 'jc' THEN 'jump' WHEN 'sj' THEN 'jump' WHEN 'dj' THEN 'jump' WHEN 'ult' THEN 'ultimate' ELSE lower(w) END END AS st FROM pp),
     parsed AS (SELECT x.id, any_value(x.letters) AS letters, coalesce(string_agg(st, ' ' ORDER BY i), '') AS steps, count(i) AS candidates, count(st) AS recognised FROM px x LEFT JOIN pq ON pq.id = x.id GROUP BY 1)"""


@query("parse_combo", f"WITH {COMBO_SQL}, {parse_sql('texts')} SELECT id, steps, CAST(candidates AS INTEGER) AS candidates, CAST(recognised AS INTEGER) AS recognised, letters FROM parsed")
def _(t):
    p = X.parse_combos(combo_texts(t).withColumnRenamed("l_orderkey", "id"), "text")
    return p.select("id", F.array_join("steps", " ").alias("steps"), "candidates", "recognised", "letters")


@query("combo_lines", f"""WITH {COMBO_SQL}, {parse_sql('texts')} SELECT id, 0 AS pos, steps, text AS line FROM parsed JOIN texts USING (id)
   WHERE len(string_split(steps, ' ')) >= 3 AND candidates > 0 AND round_even(recognised / candidates::DOUBLE, 2) >= 0.5""")
def _(t):
    posts = combo_texts(t).select(F.col("l_orderkey").alias("id"), F.concat(F.col("text"), F.lit("\nwhat a round that was\n")).alias("text"))
    return X.combo_lines(posts, "id", "text").select("id", "pos", F.array_join("steps", " ").alias("steps"), "line")


@query("best_lines", f"""WITH {COMBO_SQL}, {parse_sql('texts')}, c AS (SELECT id // 8 AS post, id, steps, round_even(recognised / candidates::DOUBLE, 2) AS confidence, text AS line FROM parsed JOIN texts USING (id)
   WHERE len(string_split(steps, ' ')) >= 3 AND candidates > 0)
   SELECT post, line, CAST(row_number() OVER (PARTITION BY post ORDER BY confidence DESC, len(string_split(steps, ' ')) DESC, id) AS INTEGER) AS "rank" FROM c WHERE confidence >= 0.5""")
def _(t):
    lines = X.parse_combos(combo_texts(t).withColumnRenamed("l_orderkey", "pos"), "text", only_lines=True)
    return X.best_lines(lines.withColumn("post", F.expr("pos div 8")), "post").select("post", F.col("text").alias("line"), "rank")


SOURCES_SQL = f"""{COMBO_SQL}, {parse_sql('texts')}, so AS (SELECT o_custkey AS source, o_orderkey AS t, steps, o_orderkey % 2 AS k FROM parsed JOIN orders ON o_orderkey = id WHERE len(string_split(steps, ' ')) >= 3),
   sc AS (SELECT source, steps, arg_min(t, (k, t)) AS t, CASE min(k) WHEN 0 THEN 'screen' ELSE 'speech' END AS "from" FROM so GROUP BY 1, 2)"""


def sources_of(t):
    p = X.parse_combos(combo_texts(t).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")), "text").select(
        F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("t"), F.lit(0).alias("pos"), "steps", "confidence")
    return X.source_combos(p.filter("t % 2 = 0"), p.filter("t % 2 = 1"))


@query("source_combos", f"""WITH {SOURCES_SQL} SELECT source, steps, t, "from" FROM sc""")
def _(t):
    return sources_of(t).select("source", "steps", "t", "from")


@query("source_to_tech", f"""WITH {SOURCES_SQL}, x AS (SELECT source, steps, t, CASE WHEN source % 2 = 0 THEN 'https://youtube.com/watch?v=' || source ELSE 'https://clips.example/' || source END AS url, CASE WHEN source % 5 > 0 THEN 'creator' || source % 50 END AS creator FROM sc)
   SELECT trim(source || '-' || t, '-') AS id, steps, source || ' · ' || (t // 60) || ':' || lpad(CAST(t % 60 AS VARCHAR), 2, '0') AS title, coalesce(creator, CAST(source AS VARCHAR)) AS author,
     CASE WHEN source % 2 = 0 AND t > 0 THEN url || '&t=' || t || 's' ELSE url END AS clip, CASE WHEN source % 2 = 0 THEN 'youtube' ELSE 'video' END AS platform FROM x""")
def _(t):
    src = F.col("source")
    c = sources_of(t).select("source", "t", "steps", F.when(src % 5 > 0, F.concat(F.lit("creator"), (src % 50).cast("string"))).alias("creator"), src.cast("string").alias("title"),
                             F.when(src % 2 == 0, F.concat(F.lit("https://youtube.com/watch?v="), src.cast("string"))).otherwise(F.concat(F.lit("https://clips.example/"), src.cast("string"))).alias("url"))
    return X.cite_source(c)


@query("tech_clean", f"""WITH {COMBO_SQL} SELECT id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[>,]'), lambda s: trim(s)), lambda s: s <> '')[:60], '|') AS steps,
    left(text, 200) AS title, left(repeat(text, 40), 2000) AS notes, CASE WHEN id % 4 > 0 THEN ltrim(left('@who' || id, 80), '@') END AS credit_who FROM texts""")
def _(t):
    r = combo_texts(t).select(F.col("l_orderkey").alias("id"), F.split("text", "[>,]").alias("steps"), F.array().cast("array<string>").alias("concepts"),
                              F.col("text").alias("title"), F.repeat("text", F.lit(40)).alias("notes"),
                              F.when(F.col("l_orderkey") % 4 > 0, F.concat(F.lit("@who"), F.col("l_orderkey").cast("string"))).alias("credit_who"), F.lit(None).cast("string").alias("credit_url"))
    return X.clean_record(r).select("id", F.array_join("steps", "|").alias("steps"), "title", "notes", "credit_who")


@query("normalise_notation", f"""WITH {COMBO_SQL} SELECT id, replace(replace(replace(replace(text, ', ', '  '), ' > ', '  '), 'SH', '5H'), '->', '->') AS repaired FROM texts WHERE id % 9 > 0 AND id % 3 < 2
   UNION ALL SELECT id, text FROM texts WHERE NOT (id % 9 > 0 AND id % 3 < 2)""")
def _(t):
    # the texts with slips put in: 5 read as S, j. as ). and separators spaced out; repaired they are the originals
    c = combo_texts(t)
    slip = F.replace(F.replace(F.regexp_replace("text", ", | > ", "  "), F.lit("5H"), F.lit("SH")), F.lit("j."), F.lit(")."))
    hurt = F.when((F.col("l_orderkey") % 9 > 0) & (F.col("l_orderkey") % 3 < 2), slip).otherwise(F.col("text"))
    return c.select(F.col("l_orderkey").alias("id"), N.repair(hurt).alias("repaired"))


@query("text_keep", r"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z''!?.-]{2,}'), lambda w: trim(lower(w), '!?.') NOT IN ('magik','hits','hit','good','great','perfect','punish','leader','p1','p2','damage','combo','highest','counter')) AS ws,
     (regexp_matches(text, '(?i)(^|[^A-Za-z0-9])(j\.)?[1-9]{0,6}[LMHU]([^A-Za-z]|$)') OR regexp_matches(text, '(^|[^A-Za-z])(236|214|623|22|41236|63214)') OR contains(text, '>') OR regexp_matches(text, '(?i)xx')) AND regexp_matches(text, '[0-9][LMHU]|j\.') AS hint FROM documents)
   SELECT doc_id, len(ws) >= 3 OR hint AS keep, CAST(len(ws) AS INTEGER) AS words, hint FROM w""")
def _(t):
    keep, words, hint = N.keep_text(F.col("text"))
    return t.documents.select("doc_id", keep.alias("keep"), words.alias("words"), hint.alias("hint"))


@query("ocr_lines", """WITH w AS (SELECT match_id || ':' || floor(t)::BIGINT AS frame, event_type AS line, seq AS x, CAST(floor(value) AS INTEGER) AS y, event_type || slot AS text FROM v_ticks WHERE value >= 20),
   l AS (SELECT frame, line, min(y) AS y, string_agg(text, ' ' ORDER BY x) AS text FROM w GROUP BY 1, 2) SELECT frame, string_agg(text, chr(10) ORDER BY y, line) AS text FROM l GROUP BY 1""")
def _(t):
    words = t._ticks.select(F.concat(F.col("match_id"), F.lit(":"), F.floor("t")).alias("frame"), F.col("event_type").alias("line"), F.col("seq").alias("x"),
                            F.floor("value").cast("int").alias("y"), F.concat("event_type", F.col("slot").cast("string")).alias("text"), F.col("value").alias("conf"))
    return X.ocr_lines(words, 20)


@query("text_blocks", """WITH f AS (SELECT match_id AS source, t, min(event_type) AS key FROM v_ticks GROUP BY 1, 2),
   n AS (SELECT *, CASE WHEN key = lag(key) OVER w AND t - lag(t) OVER w <= 0.5 THEN 0 ELSE 1 END AS st FROM f WINDOW w AS (PARTITION BY source ORDER BY t)),
   r AS (SELECT *, sum(st) OVER (PARTITION BY source ORDER BY t) AS run FROM n) SELECT source, min(t) AS t, max(t) AS t_end, min(key) AS key, count(*) AS frames FROM r GROUP BY source, run""")
def _(t):
    frames = t._ticks.groupBy(F.col("match_id").alias("source"), "t").agg(F.min("event_type").alias("key"))
    return X.text_blocks(frames, gap=0.5, width=16.0)


def page_blocks_of(t):
    return X.page_blocks(t.pages, "page_id", "html")


@query("page_blocks")
def _(t):
    return page_blocks_of(t)


@query("tier_list")
def _(t):
    # the part's brand number plays the tier; every page gets a tier heading before its own text
    from boutline.plans.testviews import values
    marked = t.pages.select("page_id", F.concat(F.lit("<h2>"), F.element_at(F.array(*[F.lit(x) for x in "SABCDEF"]), (F.col("page_id") % 7 + 1).cast("int")), F.lit(" Tier</h2>"), F.col("html")).alias("html"))
    names = values(t.spark, "name", [("the",), ("reading",), ("que",)])
    return X.tier_list(X.page_blocks(marked, "page_id", "html"), names, "page_id")


@query("page_sections")
def _(t):
    marked = t.pages.select("page_id", F.concat(F.lit("<h2>Overview</h2>"), F.col("html"), F.lit("<h3>Combos</h3><ul><li>5L > 5M</li><li>none</li></ul>")).alias("html"))
    return X.page_sections(X.page_blocks(marked, "page_id", "html"), "page_id")


@query("post_text", r"""WITH p AS (SELECT page_id, coalesce(nullif(regexp_extract(html, '(?s)<p[^>]*>(.*?)</p>', 1), ''), html) AS b FROM pages),
   q AS (SELECT page_id, regexp_replace(regexp_replace(b, '<br\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g') AS b FROM p)
   SELECT page_id, trim(replace(replace(replace(replace(replace(replace(replace(replace(b, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')) AS text FROM q""")
def _(t):
    return t.pages.select("page_id", X.post_text(F.col("html")).alias("text"))


@query("post_upsert", """SELECT page_id % 100 AS id, arg_max(url, page_id) AS url FROM pages GROUP BY 1""")
def _(t):
    from boutline.operators.store import latest_wins
    posts = t.pages.select((F.col("page_id") % 100).alias("id"), "url", F.col("page_id").alias("at"))
    return latest_wins(posts, ["id"], ["at"]).select("id", "url")


@query("reply_json", r"""WITH l AS (SELECT doc_id, '{"question":"q' || doc_id || '","confidence":"low","take":[{"text":"a","refs":["x"],"label":"fact"}]}' AS j FROM labels),
   r AS (SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN 'q' || doc_id END AS question, doc_id % 4 < 3 AS ok FROM l) SELECT doc_id, question, CASE WHEN ok THEN 'low' END AS confidence, CASE WHEN ok THEN 1 END AS takes FROM r""")
def _(t):
    j = F.concat(F.lit('{"question":"q'), F.col("doc_id"), F.lit('","confidence":"low","take":[{"text":"a","refs":["x"],"label":"fact"}]}'))
    said = (F.when(F.col("doc_id") % 4 == 0, j).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("```json\n"), j, F.lit("\n```")))
            .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("Sure. "), j, F.lit(" That is all."))).otherwise("no json here { at all"))
    p = t.labels.select("doc_id", X.reply_json(said).alias("r"))
    return p.select("doc_id", "r.question", "r.confidence", F.when(F.col("r").isNotNull(), F.size("r.take")).alias("takes"))


def transcripts(t):
    """Conversations as transcript files: even ones as subtitles, odd ones as a pasted panel."""
    said = F.btrim(F.regexp_replace(F.translate("text", "<>", "  "), r"\s+", " "))
    rows = t.conversations.select("conv_id", "turn", F.when(said == "", "empty").otherwise(F.concat(F.lit("t "), said)).alias("said"))
    srt = F.concat(F.col("turn").cast("string"), F.lit("\n00:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit(":05,500 --> 00:59:00,000\n<i>"), F.col("said"), F.lit("</i>"))
    stamp = F.concat(F.col("turn").cast("string"), F.lit(":07"))
    panel = F.when(F.col("conv_id") % 4 == 3, F.concat(stamp, F.lit(" "), F.col("said"))).otherwise(F.concat(stamp, F.lit("\n"), F.col("said")))
    block = F.when(F.col("conv_id") % 2 == 0, srt).otherwise(panel)
    sep = F.when(F.col("conv_id") % 2 == 0, "\n\n").otherwise("\n")
    files = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]).alias("bs"))
    return files.select("conv_id", F.concat(F.when(F.col("conv_id") % 2 == 0, "WEBVTT\n\n").otherwise(""), F.when(F.col("conv_id") % 2 == 0, F.array_join("bs", "\n\n")).otherwise(F.array_join("bs", "\n"))).alias("raw"))


@query("transcript_import", r"""WITH s AS (SELECT conv_id, turn, trim(regexp_replace(translate(text, '<>', '  '), '\s+', ' ', 'g')) AS said FROM conversations)
   SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN turn * 60 + 5.5 ELSE turn * 60 + 7 END::DOUBLE AS t, CASE WHEN said = '' THEN 'empty' ELSE 't ' || said END AS text FROM s""")
def _(t):
    return X.transcript_segments(transcripts(t), "conv_id", "raw").select("conv_id", "t", "text")


RULES = {"neutral": ["hand", " the "], "pressure": ["eaux", "que"], "zone": ["sch"]}
UNLESS = {"neutral": ["and "]}


@query("concept_tags", """WITH s AS (SELECT doc_id, i - 1 AS pos, trim(ss[i]) AS sentence FROM (SELECT doc_id, string_split(text, '. ') AS ss FROM documents), unnest(range(1, len(ss) + 1)) u(i)),
   k AS (SELECT *, lower(sentence) AS low FROM s WHERE sentence <> ''),
   g AS (SELECT doc_id, pos, sentence, unnest(list_filter([CASE WHEN (contains(low, 'hand') OR contains(low, ' the ')) AND NOT contains(low, 'and ') THEN 'neutral' END, CASE WHEN contains(low, 'eaux') OR contains(low, 'que') THEN 'pressure' END,
      CASE WHEN contains(low, 'sch') THEN 'zone' END], lambda x: x IS NOT NULL)) AS tag FROM k)
   SELECT doc_id, tag, min(pos) AS pos, md5(arg_min(sentence, pos)) AS sentence FROM g GROUP BY 1, 2""")
def _(t):
    return X.concept_tags(t.documents, "doc_id", "text", RULES, UNLESS).select("doc_id", "tag", F.col("pos").cast("long").alias("pos"), F.md5("sentence").alias("sentence"))


@query("roster_mention", """WITH r AS (SELECT * FROM (VALUES ('Reading', 1), ('eaux', 2), ('sch', 3), ('ent', 4)) v(name, ord))
   SELECT doc_id, arg_min(name, ord) AS name FROM documents JOIN r ON contains(lower(text), lower(name)) GROUP BY 1""")
def _(t):
    from boutline.plans.testviews import values
    roster = values(t.spark, "name, ord", [("Reading", 1), ("eaux", 2), ("sch", 3), ("ent", 4)])
    return X.roster_mention(t.documents, roster, "doc_id", "text")


@query("quotes", """SELECT conv_id AS source, turn AS t, text FROM conversations WHERE (conv_id % 3 = 0 OR conv_id % 3 = 1) AND (contains(lower(text), 'hand') OR contains(lower(text), 'eaux')) ORDER BY conv_id, turn LIMIT 12""")
def _(t):
    lines = t.conversations.select(F.col("conv_id").alias("source"), F.col("turn").alias("t"), "text", F.when(F.col("conv_id") % 3 == 1, "Magik").when(F.col("conv_id") % 3 == 2, "Storm").alias("fighter"))
    return X.quotes(lines, "magik", ["hand", "eaux"], 12).select("source", "t", "text")


@query("thread_prune", """WITH e AS (SELECT conv_id, max(turn) AS m FROM conversations WHERE role = 'user' GROUP BY 1), c AS (SELECT c.* FROM conversations c JOIN e USING (conv_id) WHERE turn <= m)
   SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM c) WHERE r <= 6""")
def _(t):
    return X.thread_prune(t.conversations).select("conv_id", "turn", "role")


@query("ref_integrity", """WITH c AS (SELECT conv_id || ':' || turn AS claim, CASE role WHEN 'assistant' THEN 'fact' WHEN 'user' THEN 'model' ELSE 'guess' END AS label,
     CASE WHEN turn = 0 THEN [] ELSE [conv_id || ':' || (turn - 1)] || CASE WHEN turn % 3 = 0 THEN [conv_id || ':' || (turn + 5)] ELSE [] END END AS refs FROM conversations),
   k AS (SELECT conv_id || ':' || turn AS ref FROM conversations WHERE role <> 'system'), u AS (SELECT claim, unnest(refs) AS ref FROM c),
   g AS (SELECT claim, count(k.ref) AS good, count(*) - count(k.ref) AS bad FROM u LEFT JOIN k USING (ref) GROUP BY 1)
   SELECT c.claim, CAST(coalesce(good, 0) AS INTEGER) AS refs, CASE WHEN coalesce(bad, 0) > 0 OR (coalesce(good, 0) = 0 AND label <> 'guess') THEN 'guess' ELSE label END AS label,
     coalesce(bad, 0) > 0 OR (coalesce(good, 0) = 0 AND label <> 'guess') AS demoted FROM c LEFT JOIN g USING (claim)""")
def _(t):
    ref = lambda n: F.concat(F.col("conv_id"), F.lit(":"), n)
    none = F.array().cast("array<string>")
    refs = F.when(F.col("turn") == 0, none).otherwise(F.concat(F.array(ref(F.col("turn") - 1)), F.when(F.col("turn") % 3 == 0, F.array(ref(F.col("turn") + 5))).otherwise(none)))
    claims = t.conversations.select(ref(F.col("turn")).alias("claim"), F.expr("case role when 'assistant' then 'fact' when 'user' then 'model' else 'guess' end").alias("label"), refs.alias("refs"))
    known = t.conversations.filter("role <> 'system'").select(ref(F.col("turn")).alias("ref"))
    return X.ref_integrity(claims, known).select("claim", F.size("refs").alias("refs"), "label", "demoted")


TRIAL = ("|CmnVJump", "|CmnFJump", "|NmlAtk5A", "|NmlAtkAIR2B", "|SpecialSkill236C", "|SimpleSkill2EA", "+NmlAtk5C", "dam", None, "|UltimateSkill632146D")


SCRIPT_LINES = 50_000  # lines of scripts a task holds and sorts


def scripts(t):
    """One trial script per order: two missions, tokens from its lines. Dealt by order into as many parts as the lines need: what follows
    keeps to them, so a task's memory does not grow with the table."""
    tok = F.coalesce(F.element_at(F.array(*[F.lit(x) for x in TRIAL]), (F.col("l_partkey") % 10 + 1).cast("int")), (F.col("l_quantity").cast("int") + 10).cast("string"))
    item = F.struct(F.when(F.col("l_linenumber") <= 3, 1).otherwise(2).alias("m"), "l_linenumber", "l_partkey", "l_extendedprice", tok.alias("tok"))
    lines = t.lineitem.select("l_orderkey", item.alias("item"))
    dealt = lines.repartition(t.lineitem.count() // SCRIPT_LINES + 1, "l_orderkey")
    rows = dealt.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("item")).alias("r"))
    part = lambda m: F.array_join(F.transform(F.filter("r", lambda x: x["m"] == m), lambda x: x["tok"]), "\u0001")
    head = "-MISSION-\u0001x1\u0001-LIST-\u0001"
    return rows.select("l_orderkey", F.concat(F.lit(head), part(1), F.lit("\u0001" + head), part(2)).alias("script"))


MISSIONS_SQL = f"""mi AS (SELECT l_orderkey, CASE WHEN l_linenumber <= 3 THEN 1 ELSE 2 END AS mission, coalesce([{', '.join('NULL' if x is None else repr(x) for x in TRIAL)}][l_partkey % 10 + 1], CAST(CAST(trunc(l_quantity) AS INTEGER) + 10 AS VARCHAR)) AS tok,
     row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS n FROM lineitem),
   tk AS (SELECT *, CASE WHEN tok LIKE '|%' THEN 'seq' WHEN tok LIKE '+%' THEN 'alt' WHEN regexp_matches(tok, '^[0-9]+$') THEN 'num' ELSE 'tag' END AS kind, CASE WHEN tok LIKE '|%' OR tok LIKE '+%' THEN substr(tok, 2) ELSE tok END AS value FROM mi)"""


@query("trial_missions", f"WITH {MISSIONS_SQL} SELECT l_orderkey, CAST(mission AS BIGINT) AS mission, kind, value, count(*) AS n FROM tk GROUP BY ALL")
def _(t):
    return X.trial_missions(scripts(t), "l_orderkey", "script").groupBy("l_orderkey", "mission", "kind", "value").agg(F.count("*").alias("n"))


ROUTES_SQL = MISSIONS_SQL + """,
   rs AS (SELECT l_orderkey, mission, list(CASE WHEN value LIKE 'Cmn%' THEN 'JUMP' ELSE value END ORDER BY n) AS raw FROM tk WHERE kind = 'seq' GROUP BY 1, 2),
   rk AS (SELECT *, list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(raw, lambda v: [v])), lambda a, x: CASE WHEN (x[1] = 'JUMP' AND a[-1] = 'JUMP') OR (x[1] = 'SimpleSkill2EA' AND a[-1] LIKE 'SpecialSkill%') THEN a ELSE list_concat(a, x) END) AS steps FROM rs),
   routes AS (SELECT rk.l_orderkey, rk.mission, steps, CASE WHEN bool_or(tk.kind = 'tag' AND tk.value = 'dam') THEN arg_min(CAST(tk.value AS VARCHAR), tk.n) FILTER (WHERE tk.kind = 'num') END AS dam FROM rk JOIN tk USING (l_orderkey, mission)
     WHERE len(list_filter(steps, lambda s: s LIKE 'NmlAtk%' OR s LIKE 'SpecialSkill%' OR s LIKE 'UltimateSkill%')) >= 2 GROUP BY 1, 2, 3)"""


def routes_of(t):
    return X.trial_routes(X.trial_missions(scripts(t), "l_orderkey", "script"), "l_orderkey")


@query("trial_routes", f"""WITH {ROUTES_SQL} SELECT l_orderkey, CAST(mission AS BIGINT) AS mission, array_to_string(steps, ' ') AS steps,
   array_to_string(list_transform(steps, lambda s: CASE s WHEN 'JUMP' THEN 'jump' WHEN 'NmlAtk5A' THEN '5A' WHEN 'NmlAtkAIR2B' THEN 'j.2B' WHEN 'SpecialSkill236C' THEN '236C' WHEN 'UltimateSkill632146D' THEN '632146D ULT' ELSE s END), ' > ') AS shown,
   TRY_CAST(dam AS INTEGER) AS damage_req FROM routes""")
def _(t):
    return routes_of(t).select("l_orderkey", "mission", F.array_join("steps", " ").alias("steps"), F.array_join("shown", " > ").alias("shown"), "damage_req")


@query("trial_alternatives", f"""WITH {ROUTES_SQL} SELECT r.l_orderkey, CAST(r.mission - 1 AS BIGINT) AS mission, coalesce((SELECT string_agg('5C', ', ') FROM tk WHERE tk.l_orderkey = r.l_orderkey AND tk.mission = r.mission AND tk.kind = 'alt'), '') AS alts FROM routes r""")
def _(t):
    return routes_of(t).select("l_orderkey", (F.col("mission") - 1).alias("mission"), F.array_join("alts", ", ").alias("alts"))


@query("cancel_table", f"""WITH {ROUTES_SQL}, f AS (SELECT list_filter(steps, lambda s: s LIKE 'NmlAtk%' OR s LIKE 'SpecialSkill%' OR s LIKE 'UltimateSkill%' OR s = 'JUMP') AS s FROM routes),
   p AS (SELECT s[i] AS a, s[i + 1] AS b FROM f, unnest(range(1, len(s))) u(i)) SELECT a, b, count(*) AS n FROM p GROUP BY 1, 2""")
def _(t):
    return X.cancel_table(routes_of(t))


@query("step_notation", f"""WITH {ROUTES_SQL}, s AS (SELECT DISTINCT CASE s WHEN 'JUMP' THEN 'jump' WHEN 'NmlAtk5A' THEN '5A' WHEN 'NmlAtkAIR2B' THEN 'j.2B' WHEN 'SpecialSkill236C' THEN '236C' WHEN 'UltimateSkill632146D' THEN '632146D ULT' ELSE s END AS step FROM (SELECT unnest(steps) AS s FROM routes))
   SELECT step, CASE step WHEN 'jump' THEN 'jump' WHEN '632146D ULT' THEN '632146U' WHEN '5A' THEN '5L' WHEN 'j.2B' THEN 'j.2M' WHEN '236C' THEN '236H' WHEN 'SimpleSkill2EA' THEN 'SimpleSkill2M+HL' END AS input,
     CASE step WHEN 'jump' THEN 'Jump' WHEN '632146D ULT' THEN 'Ultimate (start)' END AS label, CASE step WHEN 'jump' THEN 'move' ELSE 'attack' END AS kind FROM s""")
def _(t):
    s = routes_of(t).select(F.explode("shown").alias("step")).distinct()
    return s.select("step", N.wiki_step(F.col("step")).alias("w")).select("step", "w.input", "w.label", "w.kind")
