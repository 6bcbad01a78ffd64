"""Documents, index tables, audits, progress, clip plans and move tables."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.functions.scalars import moment_id
from boutline.operators import audit as A
from boutline.operators import contract as C
from boutline.operators import lookup as L
from boutline.operators import progress as PR
from boutline.operators import store as ST
from boutline.operators.moments import cluster_moments
from boutline.operators.settle import settle, shared_folder
from boutline.plans.capture_queries import GRADES_SQL, OPENF_SQL, grades_of, open_findings_of
from boutline.plans.log_queries import CLUSTERS_SQL, moments_of
from boutline.plans.match_queries import METRICS_SQL, metrics_of
from boutline.plans.panel_queries import CAPS_SQL, SCORED_SQL, captions, scored
from boutline.plans.registry import near, query
from boutline.plans.testviews import FRAME_BLOCK
from boutline.sources import versions as V
from boutline.sources.files import read_documents, read_gauge, scan_files, write_documents, write_gauge
from boutline.streaming.watch import watch_table


@query("src_scan", """SELECT source, sum(strlen(replace(coalesce(text, ''), chr(10), ' ')) + 1)::BIGINT AS bytes, count(*) AS lines, sum(length(replace(coalesce(text, ''), chr(10), ' ')))::BIGINT AS chars FROM documents GROUP BY 1""")
def _(t):
    """The documents' lines written as text files by source, found again by folder and name and read as whole files."""
    folder = fresh_folder(t)
    line = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" "))
    t.spark.read.parquet(f"{t.folder}/documents.parquet").select("source", line.alias("value")).write.partitionBy("source").text(folder)
    files = scan_files(t.spark, folder, "*.txt").select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"), "length", F.decode("content", "UTF-8").alias("body"))
    marks = F.length("body") - F.length(F.replace("body", F.lit("\n"), F.lit("")))
    return files.groupBy("source").agg(F.sum("length").alias("bytes"), F.sum(marks).alias("lines"), F.sum(F.length("body") - marks).alias("chars"))


@query("ingest_new", """SELECT DISTINCT 'bh_' || substr(sha256(text), 1, 16) AS id FROM documents WHERE 'bh_' || substr(sha256(text), 1, 16) NOT IN (SELECT 'bh_' || substr(sha256(text), 1, 16) FROM documents WHERE lang = 'fr')""")
def _(t):
    from boutline.functions.scalars import content_id
    ids = t.documents.select(content_id(F.col("text")).alias("id"), "lang")
    return ST.new_only(ids.select("id"), ids.filter("lang = 'fr'").select("id"), "id")


STATUS_SQL = """st AS (SELECT m.match_id, CASE WHEN m.patch = 'v8' THEN 'skipped' WHEN coalesce(p.n, 0) = 0 OR m.duration_frames <= 0 OR coalesce(i.n, 0) = 0 THEN 'failed' ELSE 'ok' END AS status,
   coalesce(p.n, 0) AS np, coalesce(i.n, 0) AS ni, duration_frames AS d FROM v_matches m LEFT JOIN (SELECT match_id, count(*) AS n FROM v_players WHERE character_id > 2 GROUP BY 1) p USING (match_id)
   LEFT JOIN (SELECT match_id, count(*) AS n FROM v_inputs GROUP BY 1) i USING (match_id))"""


@query("ingest_status", f"""WITH {STATUS_SQL} SELECT match_id, status, CASE WHEN status = 'failed' THEN 'parsed to an empty match (' || np || ' players, ' || d || ' frames, ' || ni || ' inputs)' END AS error FROM st""")
def _(t):
    return ST.ingest_status(t.matches, t.players.filter("character_id > 2"), t.inputs, t.matches.filter("patch = 'v8'"))


def documents_of(t):
    return ST.build_documents(t.matches, t.players, t.inputs, t.kos, cluster_moments(moments_of(t), 240, FRAME_BLOCK), metrics_of(t))


@query("doc_build", f"""WITH RECURSIVE {CLUSTERS_SQL}, {METRICS_SQL}
   SELECT m.match_id, patch, (SELECT count(*) FROM v_players p WHERE p.match_id = m.match_id)::INTEGER AS players, (SELECT count(*) FROM v_inputs p WHERE p.match_id = m.match_id)::INTEGER AS inputs,
     (SELECT count(*) FROM v_kos p WHERE p.match_id = m.match_id)::INTEGER AS kos, (SELECT count(*) FROM clusters p WHERE p.match_id = m.match_id)::INTEGER AS moments,
     (SELECT count(DISTINCT slot) FROM metrics p WHERE p.match_id = m.match_id)::INTEGER AS metrics FROM v_matches m""")
def _(t):
    d = documents_of(t)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return d.select("match_id", "match.patch", size("players").alias("players"), size("observations.inputs").alias("inputs"), size("observations.kos").alias("kos"),
                    size("analysis.moments").alias("moments"), size("analysis.metrics").alias("metrics"))


@query("doc_scan", """SELECT m.match_id, patch, (SELECT count(*) FROM v_inputs p WHERE p.match_id = m.match_id)::INTEGER AS inputs, (SELECT count(*) FROM v_players p WHERE p.match_id = m.match_id)::INTEGER AS players FROM v_matches m""")
def _(t):
    d = documents_of(t)
    folder = fresh_folder(t)
    write_documents(d, folder)
    back = read_documents(t.spark, folder, d.schema)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return back.select("match_id", "match.patch", size("observations.inputs").alias("inputs"), size("players").alias("players"))


def fresh_folder(t):
    return f"{shared_folder(t.spark).rstrip('/')}/written-{uuid.uuid4().hex}"


@query("gauge_csv", """SELECT t, max(CASE WHEN slot = 0 THEN CAST(floor(value) AS INTEGER) END) AS gauge_p1, max(CASE WHEN slot = 1 THEN CAST(floor(value) AS INTEGER) END) AS gauge_p2,
   CAST(count(*) FILTER (WHERE slot = 0) AS INTEGER) AS assemble_p1, CAST(count(*) FILTER (WHERE slot = 1) AS INTEGER) AS assemble_p2 FROM v_ticks GROUP BY 1""")
def _(t):
    whole = F.floor("value").cast("int")
    g = t._ticks.groupBy("t").agg(F.max(F.when(F.col("slot") == 0, whole)).alias("gauge_p1"), F.max(F.when(F.col("slot") == 1, whole)).alias("gauge_p2"),
                                  F.count_if(F.col("slot") == 0).cast("int").alias("assemble_p1"), F.count_if(F.col("slot") == 1).cast("int").alias("assemble_p2"))
    folder = fresh_folder(t)
    write_gauge(g, folder)
    return read_gauge(t.spark, folder)


@query("index_rebuild", f"WITH {METRICS_SQL} SELECT match_id, slot, key, round(value, 6) AS value FROM metrics")
def _(t):
    return ST.index_rows(documents_of(t))["metrics"].withColumn("value", F.round("value", 6))


@query("index_matches", "SELECT match_id, patch, duration_frames, fps FROM v_matches")
def _(t):
    return ST.index_rows(documents_of(t))["matches"].select("match_id", "patch", "duration_frames", "fps")


@query("index_players", "SELECT match_id, slot, display_name, character_id FROM v_players JOIN v_matches USING (match_id)")
def _(t):
    return ST.index_rows(documents_of(t))["players"].select("match_id", "slot", "display_name", "character_id")


@query("index_moments", f"WITH RECURSIVE {CLUSTERS_SQL} SELECT match_id, slot, kind, frame, severity FROM clusters JOIN v_matches USING (match_id)")
def _(t):
    return ST.index_rows(documents_of(t))["moments"].select("match_id", "slot", "kind", "frame", "severity")


@query("index_children", """WITH n AS (SELECT match_id, slot, display_name FROM v_players JOIN v_matches USING (match_id) WHERE has_video),
   o AS (SELECT match_id, slot + 2 AS slot, 'old' AS display_name FROM v_players JOIN v_matches USING (match_id) WHERE level_id > 10)
   SELECT * FROM n UNION ALL SELECT * FROM o WHERE match_id NOT IN (SELECT match_id FROM v_matches WHERE has_video)""")
def _(t):
    """A match that comes in again takes all its stored children with it, also those the new one lacks."""
    new = t.matches.filter("has_video").select("match_id")
    found = t.players.join(new, "match_id").select("match_id", "slot", "display_name")
    stored = t.players.join(t.matches.filter("level_id > 10").select("match_id"), "match_id").select("match_id", (F.col("slot") + 2).alias("slot"), F.lit("old").alias("display_name"))
    return ST.replace_slices(stored, found, new, "match_id")


@query("index_upsert", """WITH n AS (SELECT match_id, patch, duration_frames FROM v_matches WHERE has_video), o AS (SELECT match_id, 'old' AS patch, 0::BIGINT AS duration_frames FROM v_matches WHERE level_id > 10)
   SELECT coalesce(n.match_id, o.match_id) AS match_id, coalesce(n.patch, o.patch) AS patch, coalesce(n.duration_frames, o.duration_frames) AS duration_frames FROM n FULL JOIN o ON n.match_id = o.match_id""")
def _(t):
    new = t.matches.filter("has_video").select("match_id", "patch", "duration_frames", F.lit(2).alias("version"))
    old = t.matches.filter("level_id > 10").select("match_id", F.lit("old").alias("patch"), F.lit(0).cast("long").alias("duration_frames"), F.lit(1).alias("version"))
    return ST.upsert(old, new, ["match_id"], "version").drop("version")


def _stale_sql(name: str, columns: str) -> str:
    """Stored matches in three batches with stale children, then two that come again; each match is as its last batch has it."""
    return f"""SELECT {columns} FROM {name} WHERE match_id % 3 <> 0 OR match_id % 2 <> 0"""


def _index_store(t):
    """The four index tables of all matches, stored with children that no longer hold, then a third of the matches again: half of them
    anew, half withdrawn, and the last batch twice."""
    documents = settle(ST.wire_projection(documents_of(t)))  # read by four tables
    found = {n: settle(d) for n, d in ST.index_rows(documents).items()}
    folder = fresh_folder(t)
    stale = dict(found)
    stale["players"] = found["players"].unionByName(found["players"].withColumn("slot", F.col("slot") + 5))
    stale["moments"] = found["moments"].unionByName(found["moments"].withColumn("kind", F.lit("stale")))
    stale["metrics"] = found["metrics"].unionByName(found["metrics"].withColumn("key", F.lit("stale")))
    V.replace_keys(t.spark, folder, stale, "match_id", found["matches"], "first", 8)
    for batch, part in (("second", "match_id % 3 <> 0"), ("third", "match_id % 3 = 0"), ("third", "match_id % 3 = 0")):
        keep = "match_id % 3 <> 0 or match_id % 2 <> 0"
        V.replace_keys(t.spark, folder, {n: d.filter(part).filter(keep) for n, d in found.items()}, "match_id", found["matches"].filter(part), batch, 8)
    return {n: V.read_version(t.spark, folder, n, d.schema) for n, d in found.items()}


@query("index_store", f"""WITH RECURSIVE {CLUSTERS_SQL}, {METRICS_SQL},
   pl AS (SELECT p.* FROM v_players p JOIN v_matches USING (match_id)), mo AS (SELECT c.* FROM clusters c JOIN v_matches USING (match_id)),
   u AS ({_stale_sql("(SELECT match_id, 'matches' AS tbl, patch AS a FROM v_matches)", "match_id, tbl, a")}
     UNION ALL {_stale_sql("(SELECT match_id, 'players' AS tbl, slot || display_name AS a FROM pl)", "match_id, tbl, a")}
     UNION ALL {_stale_sql("(SELECT match_id, 'moments' AS tbl, slot || kind || frame AS a FROM mo)", "match_id, tbl, a")}
     UNION ALL {_stale_sql("(SELECT match_id, 'metrics' AS tbl, slot || key AS a FROM metrics)", "match_id, tbl, a")})
   SELECT match_id, tbl, count(*) AS n, min(a) AS first, max(a) AS last FROM u GROUP BY 1, 2""")
def _(t):
    s = _index_store(t)
    tagged = [s["matches"].select("match_id", F.lit("matches").alias("tbl"), F.col("patch").alias("a")), s["players"].select("match_id", F.lit("players").alias("tbl"), F.concat("slot", "display_name").alias("a")),
              s["moments"].select("match_id", F.lit("moments").alias("tbl"), F.concat("slot", "kind", "frame").alias("a")), s["metrics"].select("match_id", F.lit("metrics").alias("tbl"), F.concat("slot", "key").alias("a"))]
    return reduce(DataFrame.unionByName, tagged).groupBy("match_id", "tbl").agg(F.count("*").alias("n"), F.min("a").alias("first"), F.max("a").alias("last"))


@query("ingest_batches", """SELECT match_id, count(*) AS inputs, max(frame) AS last, count(DISTINCT slot)::BIGINT AS slots FROM v_inputs GROUP BY 1""")
def _(t):
    """Inputs of every match spread over three batches of a stream: a match is whole whichever batches its rows come in."""
    folder = fresh_folder(t)
    for k in range(3):
        t.inputs.filter(F.pmod(F.xxhash64("seq"), F.lit(3)) == k).write.mode("append").parquet(f"{folder}/in/part={k}")
    source = watch_table(t.spark, f"{folder}/in/part=*", t.inputs.schema, files_per_batch=5)
    count = lambda r: {"counts": r.groupBy("match_id").agg(F.count("*").alias("inputs"), F.max("frame").alias("last"), F.count_distinct("slot").alias("slots"))}
    V.ingest_stream(source, f"{folder}/store", "match_id", count, f"{folder}/log", 8).awaitTermination()
    return V.read_version(t.spark, f"{folder}/store", "counts", "match_id long, inputs long, last long, slots long")


@query("wire_projection", """SELECT m.match_id, (SELECT count(*) FROM v_kos k WHERE k.match_id = m.match_id)::INTEGER AS kos, false AS has_inputs FROM v_matches m""")
def _(t):
    d = ST.wire_projection(documents_of(t))
    inputs = "inputs" in d.schema["observations"].dataType.names
    return d.select("match_id", F.coalesce(F.size("observations.kos"), F.lit(0)).alias("kos"), F.lit(inputs).alias("has_inputs"))


@query("doc_summary", """SELECT m.match_id, patch, round(duration_frames / 60.0::DOUBLE, 6) AS duration, round(video_offset_frames / 60.0::DOUBLE, 6) AS video_offset, (SELECT string_agg(display_name, ' / ' ORDER BY slot) FROM v_players p WHERE p.match_id = m.match_id) AS names,
    (SELECT count(DISTINCT (slot, frame)) FROM v_kos k WHERE k.match_id = m.match_id)::INTEGER AS kos, (SELECT min(frame) FROM v_kos k WHERE k.match_id = m.match_id) AS first_ko,
    (SELECT count(*) FROM v_inputs i WHERE i.match_id = m.match_id) AS inputs, EXISTS (SELECT 1 FROM v_damage d WHERE d.match_id = m.match_id) AS has_video FROM v_matches m""")
def _(t):
    return ST.doc_summary(t.matches, t.players, t.kos, t.inputs, t.damage).withColumn("duration", F.round("duration", 6)).withColumn("video_offset", F.round("video_offset", 6))


@query("doc_signature", """WITH r AS (SELECT match_id, frame // 65536 AS part, frame || ':' || slot || ':' || action AS line, frame, slot, seq FROM v_inputs),
   p AS (SELECT match_id, part, count(*) AS n, sha1(string_agg(line, ',' ORDER BY frame, slot, seq)) AS h FROM r GROUP BY 1, 2) SELECT match_id, sum(n)::BIGINT AS inputs, sha1(string_agg(h, ',' ORDER BY part)) AS signature FROM p GROUP BY 1""")
def _(t):
    return ST.signatures(t.inputs)


@query("doc_validate", """WITH l AS (SELECT match_id, count(*) AS lost FROM v_inputs i WHERE (match_id, slot) NOT IN (SELECT (match_id, slot) FROM v_players WHERE character_id > 2) GROUP BY 1)
   SELECT match_id, array_to_string(list_filter([CASE WHEN patch = 'v9' THEN 'patch is required' END, CASE WHEN duration_frames - 4300 < 0 THEN 'duration_frames below minimum' END, CASE WHEN lost > 0 THEN 'inputs of an unknown slot' END], lambda x: x IS NOT NULL), '; ') AS errors
   FROM v_matches LEFT JOIN l USING (match_id)""")
def _(t):
    m = t.matches.withColumn("patch", F.when(F.col("patch") != "v9", F.col("patch"))).withColumn("duration_frames", F.col("duration_frames") - 4300)
    return A.contract_errors(m, t.players.filter("character_id > 2"), t.inputs).withColumn("errors", F.array_join("errors", "; "))


@query("audit", f"""WITH RECURSIVE {CLUSTERS_SQL}, {METRICS_SQL},
   pl AS (SELECT match_id, count(*) AS c, min(slot) AS lo, max(slot) AS hi, count(DISTINCT slot) AS s FROM v_players WHERE character_id > 2 GROUP BY 1), pm AS (SELECT m.match_id, duration_frames AS dur, pl.* EXCLUDE match_id FROM v_matches m LEFT JOIN pl USING (match_id)),
   sl AS (SELECT match_id, slot FROM v_players WHERE character_id > 2),
   i AS (SELECT i.*, dur, s.slot IS NOT NULL AS known, a.action IS NOT NULL AS modelled FROM v_inputs i LEFT JOIN pm USING (match_id) LEFT JOIN sl s ON s.match_id = i.match_id AND s.slot = i.slot LEFT JOIN v_actions a ON a.action = i.action),
   k AS (SELECT k.*, dur, s.slot IS NOT NULL AS known FROM v_kos k LEFT JOIN pm USING (match_id) LEFT JOIN sl s ON s.match_id = k.match_id AND s.slot = k.slot),
   c AS (SELECT 'match_id unique' AS "check", true AS ok, CAST(match_id AS VARCHAR) AS e FROM pm UNION ALL SELECT 'has players', coalesce(c, 0) > 0, CAST(match_id AS VARCHAR) FROM pm UNION ALL SELECT 'duration positive', dur > 0, CAST(match_id AS VARCHAR) FROM pm
     UNION ALL SELECT 'slots contiguous from 0', coalesce(lo = 0 AND hi = s - 1 AND s = c, false), CAST(match_id AS VARCHAR) FROM pm
     UNION ALL SELECT 'inputs within duration', coalesce(frame BETWEEN 0 AND dur, false), CAST(seq AS VARCHAR) FROM i UNION ALL SELECT 'inputs map to a slot', known, CAST(seq AS VARCHAR) FROM i UNION ALL SELECT 'inputs have a known action', modelled, CAST(seq AS VARCHAR) FROM i
     UNION ALL SELECT 'kos within duration', coalesce(frame BETWEEN 0 AND dur, false), CAST(seq AS VARCHAR) FROM k UNION ALL SELECT 'kos map to a slot', known, CAST(seq AS VARCHAR) FROM k
     UNION ALL SELECT 'severity 1 to 5', severity BETWEEN 1 AND 5, CAST(match_id AS VARCHAR) FROM clusters UNION ALL SELECT 'moment frame not negative', frame >= 0, CAST(match_id AS VARCHAR) FROM clusters
     UNION ALL SELECT 'apm 0 to 900', value BETWEEN 0 AND 900, CAST(match_id AS VARCHAR) FROM metrics WHERE key = 'apm')
   SELECT "check", count(*) AS n, count(*) FILTER (WHERE NOT ok) AS failed, min(e) FILTER (WHERE NOT ok) AS example, round(count(*) FILTER (WHERE ok) / count(*)::DOUBLE, 6) AS rate FROM c GROUP BY 1""")
def _(t):
    clusters = cluster_moments(moments_of(t), 240, FRAME_BLOCK)
    return A.audit(t.matches, t.players.filter("character_id > 2"), t.inputs, t.kos, clusters, metrics_of(t), t.action_model).withColumn("rate", F.round("rate", 6))


RAW_SQL = """raw AS (SELECT m.match_id, patch, fps, duration_frames, level_id, has_video, (SELECT count(*) FROM v_players p WHERE p.match_id = m.match_id) AS np, (SELECT max(slot) FROM v_players p WHERE p.match_id = m.match_id) AS top FROM v_matches m),
   faults AS (SELECT match_id, list_filter([
     CASE WHEN match_id % 13 = 0 THEN '<root>: required analyzer_version' END,
     CASE WHEN level_id % 5 = 0 THEN 'match/patch: type' END, CASE WHEN match_id % 7 = 0 THEN 'match/fps: minimum' END,
     CASE WHEN level_id = 3 THEN 'match/outcome/1: enum' END, CASE WHEN match_id % 5 = 0 THEN 'match: additional replay' END,
     CASE WHEN np = 0 THEN 'players: minItems' END, CASE WHEN np > 0 AND match_id % 11 = 0 THEN 'players/0/display_name: type' END,
     CASE WHEN match_id % 3 = 0 THEN 'observations/inputs/1/frame: minimum' END, CASE WHEN match_id % 9 = 0 THEN 'analysis/moments/0/id: pattern' END,
     CASE WHEN match_id % 4 = 1 AND match_id % 17 <> 0 THEN 'input references unknown slot 7' END], lambda x: x IS NOT NULL) AS errors FROM raw)"""


def raw_documents(t):
    """Match documents as text, with faults of every kind in some of them."""
    named = F.array_sort(F.collect_list(F.struct("slot", F.to_json(F.struct("slot", "display_name")).alias("body"))))
    who = t.players.groupBy("match_id").agg(named.alias("_p"), F.max("slot").alias("top"))
    m = t.matches.join(who, "match_id", "left")
    is_ = lambda test, yes, no: F.when(F.expr(test), yes).otherwise(no)
    players = F.transform(F.coalesce("_p", F.array().cast("array<struct<slot:int,body:string>>")), lambda p, i: F.when((i == 0) & F.expr("match_id % 11 = 0"), F.concat(F.lit('{"slot": '), p["slot"].cast("string"), F.lit(', "display_name": 5}'))).otherwise(p["body"]))
    inputs = F.concat(F.lit('[{"slot": null, "frame": 1, "action": "a"}, {"slot": '), is_("match_id % 4 = 1 and match_id % 17 <> 0", F.lit("7"), F.coalesce(F.col("top").cast("string"), F.lit("null"))),
                      F.lit(', "frame": '), is_("match_id % 3 = 0", F.lit("-1"), F.lit("2")), F.lit(', "action": "b"}]'))
    body = F.concat(
        F.lit('{"schema_version": "1.1", '), is_("match_id % 13 = 0", F.lit(""), F.lit('"analyzer_version": "x", ')), F.lit('"match": {"id": "'), F.col("match_id").cast("string"), F.lit('", "game": "g", "patch": '),
        is_("level_id % 5 = 0", F.lit("7"), F.concat(F.lit('"'), F.col("patch"), F.lit('"'))), F.lit(', "fps": '), is_("match_id % 7 = 0", F.lit("0"), F.lit("60")), F.lit(', "duration_frames": '), F.col("duration_frames").cast("string"),
        F.lit(', "outcome": {"0": "win", "1": '), is_("level_id = 3", F.lit('"lost"'), F.lit('"loss"')), F.lit("}"), is_("match_id % 5 = 0", F.lit(', "replay": 1'), F.lit("")),
        F.lit('}, "players": ['), F.array_join(players, ", "), F.lit('], "observations": {"inputs": '), inputs, F.lit('}, "analysis": {"moments": [{"id": "'), is_("match_id % 9 = 0", F.lit("x1"), F.lit("m_1")),
        F.lit('", "frame": 3, "kind": "ko", "severity": 5}]}, "provenance": {"parser": "p"}}'))
    return m.select("match_id", body.alias("body"))


@query("doc_contract", f"WITH {RAW_SQL} SELECT match_id, array_to_string(errors, '; ') AS errors FROM faults")
def _(t):
    return C.valid(raw_documents(t), C.MATCH_DOCUMENT).select("match_id", F.array_join("errors", "; ").alias("errors"))


def results_of(t):
    """Final places, some of them shared and some of slots that no player has."""
    return t.players.select("match_id", F.expr("case when character_id = 4 then slot + 3 else slot end").alias("slot"), F.expr("case when match_id % 6 = 0 then 1 else (slot + match_id) % 2 + 1 end").alias("place"))


@query("audit_more", f"""WITH RECURSIVE {CLUSTERS_SQL}, {METRICS_SQL}, {RAW_SQL},
   hero AS (SELECT DISTINCT CAST(n_nationkey AS INTEGER) AS character_id FROM nation WHERE n_nationkey % 8 <> 1),
   o AS (SELECT match_id, coalesce(bool_and(frame >= f), true) AS ok FROM (SELECT match_id, frame, lag(frame) OVER (PARTITION BY match_id, slot ORDER BY seq) AS f FROM v_inputs) GROUP BY 1),
   res AS (SELECT match_id, CASE WHEN character_id = 4 THEN slot + 3 ELSE slot END AS slot, CASE WHEN match_id % 6 = 0 THEN 1 ELSE (slot + match_id) % 2 + 1 END AS place FROM v_players),
   fell AS (SELECT match_id, slot, count(*) AS k, min(frame * 1000000000 + seq) AS first FROM v_kos GROUP BY 1, 2), worst AS (SELECT match_id, slot FROM fell QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY k DESC, first) = 1),
   win AS (SELECT match_id, slot FROM res QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY place, slot) = 1),
   rk AS (SELECT match_id, count(*) AS n, count(DISTINCT place) AS places, bool_and(EXISTS (SELECT 1 FROM v_players p WHERE p.match_id = res.match_id AND p.slot = res.slot)) AS keys FROM res GROUP BY 1),
   mo AS (SELECT c.match_id, count(*) AS n, count(DISTINCT (coalesce(CAST(slot AS VARCHAR), 'None'), frame, kind)) AS ids, coalesce(bool_and(frame BETWEEN 0 AND duration_frames - 3600 + 120), false) AS within FROM clusters c LEFT JOIN v_matches USING (match_id) GROUP BY 1),
   c AS (SELECT 'hero id in table' AS "check", character_id IN (SELECT character_id FROM hero) AS ok, match_id FROM v_players WHERE character_id IS NOT NULL
     UNION ALL SELECT 'inputs ordered per slot', ok, match_id FROM o UNION ALL SELECT 'result keys are slots', keys, match_id FROM rk UNION ALL SELECT 'result ranks distinct', places = n, match_id FROM rk
     UNION ALL SELECT 'winner is not the most KO''d', w.slot <> x.slot, w.match_id FROM win w JOIN worst x ON x.match_id = w.match_id JOIN rk ON rk.match_id = w.match_id AND rk.n > 1
     UNION ALL SELECT 'moment ids unique', n = ids, match_id FROM mo UNION ALL SELECT 'moments within duration', within, match_id FROM mo
     UNION ALL SELECT 'metric minutes as duration', abs(value * 60 * fps - (duration_frames - 3600)) < fps * 30, match_id FROM metrics JOIN v_matches USING (match_id) WHERE key = 'minutes'
     UNION ALL SELECT 'kos confidence honest', (level_id % 2 = 0) = (match_id IN (SELECT match_id FROM v_kos)), match_id FROM v_matches UNION ALL SELECT 'schema valid', len(errors) = 0, match_id FROM faults)
   SELECT "check", count(*) AS n, count(*) FILTER (WHERE NOT ok) AS failed, min(CAST(match_id AS VARCHAR)) FILTER (WHERE NOT ok) AS example, round(count(*) FILTER (WHERE ok) / count(*)::DOUBLE, 6) AS rate FROM c GROUP BY 1""")
def _(t):
    """Durations are taken an hour of frames short here, so that trailing events fail."""
    short = t.matches.withColumn("duration_frames", F.col("duration_frames") - 3600)
    moments = cluster_moments(moments_of(t), 240, FRAME_BLOCK).withColumn("id", moment_id(F.col("match_id"), F.col("slot"), F.col("frame"), F.col("kind")))
    claims = t.matches.select("match_id", F.expr("case when level_id % 2 = 0 then 'high' else 'missing' end").alias("kos"))
    heroes = t.nation.filter("n_nationkey % 8 <> 1").select(F.col("n_nationkey").cast("int").alias("character_id"))
    errors = C.valid(raw_documents(t), C.MATCH_DOCUMENT)
    return A.audit_more(short, t.players, t.inputs, t.kos, moments, metrics_of(t), results_of(t), claims, heroes, errors).withColumn("rate", F.round("rate", 6))


@query("monotone_check", """WITH s AS (SELECT conv_id, turn, length(text) AS v, length(text) - lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS d FROM conversations)
   SELECT conv_id, count(*) AS n, coalesce(bool_and(d > 0), true) OR coalesce(bool_and(d < 0), true) AS one_way, bool_and(v BETWEEN 50 AND 5000) AS in_range,
     (coalesce(bool_and(d > 0), true) OR coalesce(bool_and(d < 0), true)) AND bool_and(v BETWEEN 50 AND 5000) AND count(*) <= 16 AS ok FROM s GROUP BY 1""")
def _(t):
    stamps = t.conversations.select("conv_id", F.col("turn").alias("idx"), F.length("text").alias("value"))
    return A.monotone(stamps, ["conv_id"], limit=16, lo=50, hi=5000)


@query("artefact_pick", """WITH a AS (SELECT match_id AS segment, seq, 0 AS "rank" FROM v_ticks WHERE event_type = 'error' AND value > 150 UNION ALL SELECT match_id, seq, 1 FROM v_ticks WHERE event_type = 'view' AND value > 50)
   SELECT segment, seq, "rank" FROM (SELECT *, min("rank") OVER (PARTITION BY segment) AS b FROM a) WHERE "rank" = b""")
def _(t):
    pick = lambda cond, rank: t._ticks.filter(cond).select(F.col("match_id").alias("segment"), "seq", F.lit(rank).alias("rank"))
    both = pick("event_type = 'error' and value > 150", 0).unionByName(pick("event_type = 'view' and value > 50", 1))
    return ST.artefact_pick(both, ["segment"])


def _slices_sql(src):
    return f"""SELECT segment, seq, t FROM {src} WHERE segment NOT IN (SELECT match_id FROM v_matches WHERE has_video) UNION ALL SELECT segment, seq, t FROM {src} WHERE side = 'L' AND segment IN (SELECT match_id FROM v_matches WHERE has_video)"""


@query("slice_overwrite", f"WITH {CAPS_SQL} {_slices_sql('caps')}")
def _(t):
    done = t.matches.filter("has_video").select(F.col("match_id").alias("segment"))
    caps = captions(t).select("segment", "seq", "t", "side")
    found = caps.filter("side = 'L'").join(done, "segment", "left_semi")
    return ST.replace_slices(caps.drop("side"), found.drop("side"), done, "segment")


@query("slice_sweeps", f"WITH {CAPS_SQL} SELECT segment, seq, t FROM caps WHERE side = 'L' OR segment NOT IN (SELECT match_id FROM v_matches WHERE has_video)")
def _(t):
    """A whole sweep, one of some slices, one that is refused since it left slices out, and one that is undone."""
    folder, caps = fresh_folder(t), settle(captions(t).select("segment", "seq", "t", "side"))
    every, some = caps.select("segment").distinct(), t.matches.filter("has_video").select(F.col("match_id").alias("segment"))
    row = lambda d: d.select("segment", "seq", "t")
    V.overwrite_slices(t.spark, folder, "captions", row(caps), "segment", every, every)
    good = V.overwrite_slices(t.spark, folder, "captions", row(caps.filter("side = 'L'").join(some, "segment", "left_semi")), "segment", some)
    try:
        V.overwrite_slices(t.spark, folder, "captions", row(caps.limit(0)), "segment", some, every)
    except V.PartialSweep:
        V.overwrite_slices(t.spark, folder, "captions", row(caps.limit(0)), "segment", every, every)
        V.restore(t.spark, folder, good)
    return V.read_version(t.spark, folder, "captions", row(caps).schema)


@query("caption_union", f"WITH {CAPS_SQL}, u AS ({_slices_sql('caps')}) SELECT segment, count(*) AS n, min(t) AS first, max(t) AS last FROM u GROUP BY 1")
def _(t):
    done = t.matches.filter("has_video").select(F.col("match_id").alias("segment"))
    caps = captions(t).select("segment", "seq", "t", "side")
    u = ST.replace_slices(caps.drop("side"), caps.filter("side = 'L'").join(done, "segment", "left_semi").drop("side"), done, "segment")
    return u.groupBy("segment").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


@query("capture_list", f"""WITH {SCORED_SQL}, s AS (SELECT video, segment, min(t) AS start, max(t) AS "end" FROM v_samples GROUP BY 1, 2)
   SELECT video, count(*) AS segments, round(sum("end" - start), 6) AS overlay_seconds, (SELECT max(t) FROM scored c WHERE c.video = s.video) AS scanned_seconds,
    video IN (SELECT match_id // 5 FROM v_ticks WHERE event_type = 'error' AND value > 200) AS has_openings, video IN (SELECT match_id // 5 FROM v_ticks WHERE event_type = 'view' AND value > 250) AS has_punishes FROM s GROUP BY 1""")
def _(t):
    seg = t.samples.groupBy("video", "segment").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    has = lambda cond: t._ticks.filter(cond).select(F.expr("match_id div 5").alias("video"))
    return ST.capture_list(seg, scored(t), has("event_type = 'error' and value > 200"), has("event_type = 'view' and value > 250")).withColumn("overlay_seconds", F.round("overlay_seconds", 6))


@query("takes_export", f"""WITH RECURSIVE {OPENF_SQL}, {GRADES_SQL} SELECT o.video, o.id, o.id || ' | ' || o.frames || ' frames | ' || take || ' | ' || tag AS line FROM openf o JOIN grades g USING (id)""")
def _(t):
    openf = settle(open_findings_of(t))
    return ST.takes_export(openf.select("video", "id", F.concat(F.col("frames"), F.lit(" frames")).alias("title")), grades_of(openf))


@query("evidence_digest", f"""WITH RECURSIVE {OPENF_SQL}, {GRADES_SQL}, r AS (SELECT video, id, frames, id IN (SELECT id FROM grades) AS tk, row_number() OVER (PARTITION BY video ORDER BY id IN (SELECT id FROM grades) DESC, frames DESC, id) AS rn, count(*) OVER (PARTITION BY video) AS n FROM openf)
   SELECT video, string_agg('- [' || id || '] ' || frames || ' frames' || CASE WHEN tk THEN ' (taken)' ELSE '' END, chr(10) ORDER BY rn) || CASE WHEN any_value(n) > 8 THEN chr(10) || '(' || (any_value(n) - 8) || ' more findings not shown)' ELSE '' END AS digest FROM r WHERE rn <= 8 GROUP BY 1""")
def _(t):
    openf = settle(open_findings_of(t))
    f = openf.select("id", "video", "segment", F.col("frames").alias("size"), F.concat(F.col("frames"), F.lit(" frames")).alias("title"))
    return PR.evidence_digest(PR.evidence_order(f, grades_of(openf), cap=8))


@query("note_tail", """SELECT conv_id, turn, role FROM conversations WHERE turn % 4 <> 3 ORDER BY conv_id DESC, turn DESC LIMIT 50""")
def _(t):
    good = F.to_json(F.struct("conv_id", "turn", "role"))
    lines = t.conversations.select(F.when(F.col("turn") % 4 == 3, F.concat(F.lit("{broken "), good)).otherwise(good).alias("value"))
    return ST.note_tail(lines, "conv_id bigint, turn bigint, role string", ["conv_id", "turn"])


EVENT_OF = {"signup": "team_saved", "click": "card_viewed", "view": "mode_open", "purchase": "drill_logged", "error": "matchup_answered"}
CASE_EVENT = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_OF.items()) + " END"


@query("progress_levels", f"""WITH a AS (SELECT user_id, {CASE_EVENT} AS event, CAST(event_id % 4 AS VARCHAR) AS ref, CAST(ts AS DATE) AS d, event_id FROM events),
   k AS (SELECT DISTINCT user_id, event, CASE WHEN event IN ('drill_logged', 'matchup_answered') THEN CAST(event_id AS VARCHAR) WHEN event = 'team_saved' THEN ref || d ELSE ref END AS key FROM a),
   s AS (SELECT user_id, sum(CASE event WHEN 'team_saved' THEN 25 WHEN 'card_viewed' THEN 3 WHEN 'mode_open' THEN 15 WHEN 'drill_logged' THEN 10 ELSE 4 END)::BIGINT AS xp, count(*) AS paid FROM k GROUP BY 1)
   SELECT user_id AS "user", xp, paid, 1 + xp // 100 AS level, xp % 100 AS "into" FROM s""")
def _(t):
    return PR.levels(awards_of(t))


def awards_of(t):
    return t.events.select(F.col("user_id").alias("user"), F.expr(CASE_EVENT).alias("event"), (F.col("event_id") % 4).cast("string").alias("ref"), F.col("ts").alias("t"), F.col("event_id").alias("seq"))


@query("grade_latest", """WITH g AS (SELECT user_id AS id, event_id AS seq, CASE event_type WHEN 'click' THEN 'right' WHEN 'view' THEN 'wrong' END AS verdict, 'take ' || event_id AS take FROM events)
   SELECT id, arg_max(take, seq) AS take, coalesce(arg_max(verdict, seq) FILTER (WHERE verdict IS NOT NULL), 'actually') AS verdict FROM g GROUP BY 1""")
def _(t):
    return PR.grade_latest(t.events.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("ts").alias("t"), F.concat(F.lit("take "), F.col("event_id")).alias("take"),
                                           F.expr("case event_type when 'click' then 'right' when 'view' then 'wrong' end").alias("verdict")))


@query("drill_counts", """WITH d AS (SELECT user_id AS route, value >= 30 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
   SELECT route, count(*) FILTER (WHERE ok) AS landed, count(*) FILTER (WHERE NOT ok) AS dropped, string_agg(CASE WHEN ok THEN '1' ELSE '0' END, '' ORDER BY r DESC) FILTER (WHERE r <= 20) AS log FROM d GROUP BY 1""")
def _(t):
    return PR.drill_counts(t.events.select(F.col("user_id").alias("route"), (F.col("value") >= 30).alias("ok"), F.col("ts").alias("t"), F.col("event_id").alias("seq")), keep=20)


@query("clip_plan", f"""WITH RECURSIVE {CLUSTERS_SQL}, tm AS (SELECT * FROM (SELECT match_id, slot, kind, frame, severity, row_number() OVER (PARTITION BY match_id ORDER BY severity DESC, frame, slot, kind) AS "rank" FROM clusters WHERE severity >= 2) WHERE "rank" <= 8),
   p AS (SELECT tm.*, frame / 60.0::DOUBLE + (video_offset_frames - 1000) / 60.0::DOUBLE - 4.0 AS want, duration_frames / 60.0::DOUBLE + (video_offset_frames - 1000) / 60.0::DOUBLE AS ends FROM tm JOIN v_matches USING (match_id)),
   q AS (SELECT *, greatest(0.0, want) AS start, 4.0 + least(0.0, want) AS pre FROM p)
   SELECT match_id, slot, kind, frame, severity, "rank", round(start, 6) AS start, round(pre, 6) AS pre, round(pre + 3.0, 6) AS duration, start > ends AS past_end,
     (SELECT count(*) FROM v_inputs i WHERE i.match_id = q.match_id AND i.frame BETWEEN q.frame - pre * 60 AND q.frame + 180) AS presses FROM q""")
def _(t):
    m = t.matches.withColumn("video_offset_frames", F.col("video_offset_frames") - 1000)
    c = PR.clip_plan(cluster_moments(moments_of(t), 240, FRAME_BLOCK), m, t.inputs)
    return c.select("match_id", "slot", "kind", "frame", "severity", "rank", *[F.round(x, 6).alias(x) for x in ("start", "pre", "duration")], "past_end", "presses")


@query("clip_deaths", """WITH k AS (SELECT DISTINCT k.match_id, k.slot, k.frame, frame / 60.0::DOUBLE + (video_offset_frames - 1000) / 60.0::DOUBLE - 5.0 AS want, duration_frames / 60.0::DOUBLE + (video_offset_frames - 1000) / 60.0::DOUBLE AS ends FROM v_kos k JOIN v_matches USING (match_id))
   SELECT match_id, slot, frame, round(greatest(0.0, want), 6) AS start, round(7.0 + least(0.0, want), 6) AS duration, greatest(0.0, want) > ends AS past_end FROM k""")
def _(t):
    c = PR.clip_deaths(t.kos, t.matches.withColumn("video_offset_frames", F.col("video_offset_frames") - 1000))
    return c.withColumns({x: F.round(x, 6) for x in ("start", "duration")})


@query("recent_awards", f"""WITH a AS (SELECT user_id, {CASE_EVENT} AS event, CAST(event_id % 4 AS VARCHAR) AS ref, CAST(ts AS DATE) AS d, ts, event_id FROM events),
   k AS (SELECT user_id, event, CASE WHEN event IN ('drill_logged', 'matchup_answered') THEN CAST(event_id AS VARCHAR) WHEN event = 'team_saved' THEN ref || d ELSE ref END AS key, ts, event_id FROM a),
   p AS (SELECT user_id, event, key, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS seq FROM k GROUP BY 1, 2, 3)
   SELECT "user", "rank", event, CASE event WHEN 'team_saved' THEN 25 WHEN 'card_viewed' THEN 3 WHEN 'mode_open' THEN 15 WHEN 'drill_logged' THEN 10 ELSE 4 END AS xp, seq
   FROM (SELECT user_id AS "user", event, seq, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, seq DESC) AS INTEGER) AS "rank" FROM p) WHERE "rank" <= 5""")
def _(t):
    return PR.recent_awards(awards_of(t), keep=5)


@query("matchup", """WITH pr AS (SELECT DISTINCT 'Brand#' || (a.character_id + 1) AS them, 'Brand#' || (b.character_id + 1) AS you FROM v_players a JOIN v_players b ON a.match_id = b.match_id AND a.slot = 0 AND b.slot = 1)
   SELECT them, x.input AS move, you, y.input, y.startup, y.damage, -x.on_block - y.startup AS spare, CASE WHEN y.type = 'tokon' THEN 150 WHEN y.type = 'super' AND contains(y.input, '632146') THEN 100 WHEN y.type = 'super' THEN 50 ELSE 0 END AS cost,
     CASE WHEN x.reach - y.reach <= 0 THEN 'reaches' WHEN x.reach - y.reach <= 60 THEN 'close' WHEN x.reach - y.reach IS NOT NULL THEN 'may not reach' END AS verdict,
     CAST(row_number() OVER (PARTITION BY them, x.input, you ORDER BY coalesce(y.damage, 0) DESC, y.startup, y.input) AS INTEGER) AS "rank"
   FROM pr JOIN v_roster x ON x.char = them AND x.on_block IS NOT NULL JOIN v_roster y ON y.char = you AND y.type <> 'assist' AND NOT starts_with(y.input, 'j.') AND y.startup <= -x.on_block""")
def _(t):
    one = t.players.filter("slot = 0").select("match_id", F.concat(F.lit("Brand#"), (F.col("character_id") + 1).cast("string")).alias("them"))
    two = t.players.filter("slot = 1").select("match_id", F.concat(F.lit("Brand#"), (F.col("character_id") + 1).cast("string")).alias("you"))
    return L.matchup(one.join(two, "match_id").select("them", "you").distinct(), t.roster)


@query("punishable_moves", "SELECT char, input, on_block, startup, reach FROM v_roster WHERE on_block < 0 AND type <> 'assist'")
def _(t):
    return L.punishable(t.roster)


@query("fighter_card", """SELECT char, count(*) AS moves, (min((startup, input)) FILTER (WHERE type = 'normal' AND startup IS NOT NULL))[2] AS fastest, (min((startup, input)) FILTER (WHERE type = 'normal' AND startup IS NOT NULL))[1] AS startup,
   (max((reach, input)) FILTER (WHERE reach > 0))[2] AS longest, (max((reach, input)) FILTER (WHERE reach > 0))[1] AS reach, (min((on_block, input)) FILTER (WHERE type IN ('normal', 's', 'q') AND on_block IS NOT NULL))[2] AS worst,
   (min((on_block, input)) FILTER (WHERE type IN ('normal', 's', 'q') AND on_block IS NOT NULL))[1] AS on_block FROM v_roster GROUP BY 1""")
def _(t):
    return L.fighter_card(t.roster)


@query("system_words", r"""WITH s AS (SELECT p_brand AS char, 'Atk' || upper(p_name[1]) || substr(replace(p_name, ' ', ''), 2) || '_' || p_type || p_size AS state FROM part),
   w AS (SELECT char, unnest(list_distinct(list_transform(regexp_extract_all(replace(state, '_', ' '), '[A-Z]?[a-z]+|[0-9]+|[A-Z]+'), lambda x: lower(x)))) AS word FROM s),
   n AS (SELECT char, word, count(*) AS n FROM w WHERE word NOT IN ('atk', 'set', 'end') AND length(word) >= 3 AND NOT regexp_matches(word, '^[0-9]+$') GROUP BY 1, 2)
   SELECT char, word, n, "rank"::INTEGER AS "rank" FROM (SELECT *, row_number() OVER (PARTITION BY char ORDER BY n DESC, word) AS "rank" FROM n) WHERE "rank" <= 6""")
def _(t):
    name = F.col("p_name")
    state = F.concat(F.lit("Atk"), F.upper(F.left(name, F.lit(1))), F.expr("substring(replace(p_name, ' ', ''), 2)"), F.lit("_"), F.col("p_type"), F.col("p_size").cast("string"))
    return L.system_words(t.part.select(F.col("p_brand").alias("char"), state.alias("state")))


KEYS = ("236L / M / H (Air OK)", "U / 2U / 3U", "L + M", "5H", "QS", "T / 6A", "22M")
EXPANDED = {"236L / M / H (Air OK)": ["236L", "236M", "236H"], "U / 2U / 3U": ["5U", "2U", "3U"], "L + M": ["L+M"], "5H": ["5H"], "QS": [], "T / 6A": ["6A"], "22M": ["22M"]}
CMD_SQL = "cmd AS (SELECT DISTINCT p_brand || '/' || p_size % 10 AS char, p_name AS entry, [" + ", ".join(f"'{k}'" for k in KEYS) + "][p_partkey % 7 + 1] AS key FROM part)"
ROWS_SQL = "wk AS (SELECT DISTINCT p_brand || '/' || p_size % 10 AS char, ['236L', 'j.236M', '5U', 'j.2U', '5H', 'j.5L', 'L+M', '236X', 'j.22X', 'j.5H', 'j.5U'][p_partkey % 11 + 1] AS input, CAST(p_size AS INTEGER) AS startup FROM part)"
WIKI = ("236L", "j.236M", "5U", "j.2U", "5H", "j.5L", "L+M", "236X", "j.22X", "j.5H", "j.5U")


def fighter():
    """Many fighters with a few rows each, so that some inputs have no row."""
    return F.concat("p_brand", F.lit("/"), (F.col("p_size") % 10).cast("string")).alias("char")


def wiki_rows(t):
    return t.part.select(fighter(), F.element_at(F.array(*[F.lit(x) for x in WIKI]), (F.col("p_partkey") % 11 + 1).cast("int")).alias("input"), F.col("p_size").alias("startup")).distinct()


def commands(t):
    return t.part.select(fighter(), F.col("p_name").alias("entry"), F.element_at(F.array(*[F.lit(x) for x in KEYS]), (F.col("p_partkey") % 7 + 1).cast("int")).alias("key")).distinct()


@query("input_expand", f"WITH {CMD_SQL}, x AS (SELECT DISTINCT key FROM cmd) SELECT key, CASE key " + " ".join(f"WHEN '{k}' THEN '{','.join(sorted(v))}'" for k, v in EXPANDED.items()) + " END AS inputs FROM x")
def _(t):
    from boutline.functions.notation import expand_inputs
    return commands(t).select("key").distinct().select("key", F.array_join(expand_inputs(F.col("key")), ",").alias("inputs"))


@query("command_join", f"""WITH {CMD_SQL}, {ROWS_SQL}, x AS (SELECT char, entry, unnest(CASE key {' '.join(f"WHEN '{k}' THEN {v}::VARCHAR[]" for k, v in EXPANDED.items())} END) AS input FROM cmd)
   SELECT DISTINCT x.char, entry, x.input, wk.input AS wiki FROM x LEFT JOIN wk ON wk.char = x.char AND (wk.input = x.input OR wk.input = 'j.' || x.input
     OR (wk.input LIKE '%X' AND substr(replace(wk.input, 'j.', ''), 1, length(replace(wk.input, 'j.', '')) - 1) = substr(x.input, 1, length(x.input) - 1)))""")
def _(t):
    return L.command_join(commands(t), wiki_rows(t))


@query("routes", f"""WITH {ROWS_SQL}, s AS (SELECT p_brand || '/' || p_size % 10 AS char, p_partkey AS route, list_concat([['jump', '236A', 'j.236B', '5E~N', '5D', '632146D ULT'][p_partkey % 6 + 1]], [['5C', 'jump', '5D', '236A'][p_size % 4 + 1]]) AS raw FROM part),
   m AS (SELECT * FROM (VALUES ('jump', 'jump', 0), ('236A', '236L', 0), ('j.236B', 'j.236M', 0), ('5E~N', '5M+H~N', 50), ('5D', '5U', 0), ('632146D ULT', '632146U', 100), ('5C', '5H', 0)) v(raw, input, spent)),
   e AS (SELECT char, route, i, m.input, spent, coalesce((SELECT min(startup) FROM wk WHERE wk.char = s.char AND wk.input = m.input), (SELECT min(startup) FROM wk WHERE wk.char = s.char AND wk.input = replace(m.input, 'j.', ''))) AS su FROM s, unnest(range(1, 3)) u(i) JOIN m ON m.raw = s.raw[i])
   SELECT char, route, string_agg(input, ' > ' ORDER BY i) AS inputs, count(*) AS steps, count(su) AS known, max(spent) AS cost FROM e GROUP BY 1, 2""")
def _(t):
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), i.cast("int"))
    steps = F.array(pick(["jump", "236A", "j.236B", "5E~N", "5D", "632146D ULT"], F.col("p_partkey") % 6 + 1), pick(["5C", "jump", "5D", "236A"], F.col("p_size") % 4 + 1))
    return L.routes(t.part.select(fighter(), F.col("p_partkey").alias("route"), steps.alias("steps")), wiki_rows(t))


@query("fastest_answers", """SELECT char, "rank"::INTEGER AS "rank", input, startup FROM (SELECT *, row_number() OVER (PARTITION BY char ORDER BY startup, input) AS "rank" FROM v_roster WHERE type <> 'assist' AND NOT starts_with(input, 'j.')) WHERE "rank" <= 5""")
def _(t):
    return L.fastest_answers(t.roster)


@query("knowledge_hooks", """WITH o AS (SELECT 'Brand#' || (character_id + 1) AS char, count(*) AS n FROM v_players GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6)
   SELECT char, input, startup FROM v_roster JOIN o USING (char) WHERE guard = 'O' AND type <> 'assist' ORDER BY startup DESC, char DESC, input DESC LIMIT 8""")
def _(t):
    met = t.players.groupBy(F.concat(F.lit("Brand#"), (F.col("character_id") + 1).cast("string")).alias("char")).agg(F.count("*").alias("n"))
    return L.slow_overheads(t.roster, met)
