"""Documents and the tables derived from them."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def provenance(matches: DataFrame, players: DataFrame, kos: DataFrame) -> DataFrame:
    """How far each part of a match can be trusted."""
    known = players.groupBy("match_id").agg(F.bool_and(F.coalesce(F.col("character_id") != 0, F.lit(False))).alias("_known"))
    fell = kos.select("match_id").distinct().withColumn("_ko", F.lit(True))
    return matches.join(known, "match_id", "left").join(fell, "match_id", "left").select(
        "match_id", F.when(F.col("_known"), "high").otherwise("partial").alias("players"),
        F.when(F.col("_ko"), "high").otherwise("missing").alias("kos"),
        F.when(F.col("_ko").isNull(), "no KO data in this match").alias("warning"))


def latest_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the latest by ``order``: an aggregate, so a hot key is reduced before the shuffle."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*keys).agg(F.max_by(whole, F.struct(*order)).alias("_r")).select("_r.*")


PART_FRAMES = 65536  # frames of a match one document part holds


def new_only(found: DataFrame, stored: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Found rows not stored yet, once each; ``force`` takes them all again."""
    once = found.dropDuplicates([key])
    return once if force else once.join(stored.select(key).distinct(), key, "left_anti")


def ingest_status(matches: DataFrame, players: DataFrame, inputs: DataFrame, stored: DataFrame) -> DataFrame:
    """ok, skipped or failed per match; a match without players, duration or inputs has failed, it is not empty."""
    p = players.groupBy("match_id").agg(F.count("*").alias("n_players"))
    i = inputs.groupBy("match_id").agg(F.count("*").alias("n_inputs"))
    s = stored.select("match_id", F.lit(True).alias("_stored")).distinct()
    z = F.lit(0)
    j = matches.join(p, "match_id", "left").join(i, "match_id", "left").join(s, "match_id", "left").select(
        "match_id", "duration_frames", F.coalesce("n_players", z).alias("n_players"), F.coalesce("n_inputs", z).alias("n_inputs"), "_stored")
    empty = (F.col("n_players") == 0) | (F.coalesce("duration_frames", z) <= 0) | (F.col("n_inputs") == 0)
    return j.select("match_id", F.when(F.col("_stored"), "skipped").when(empty, "failed").otherwise("ok").alias("status"),
                    F.when(F.col("_stored").isNull() & empty, F.format_string(
                        "parsed to an empty match (%d players, %d frames, %d inputs)", "n_players", F.coalesce("duration_frames", z), "n_inputs")).alias("error"))


def build_documents(matches: DataFrame, players: DataFrame, inputs: DataFrame, kos: DataFrame, moments: DataFrame, metrics: DataFrame) -> DataFrame:
    """Match documents in parts of PART_FRAMES frames: part 0 carries the header, every part its observations.

    A part is bounded by the frames it spans, so a match of any length is written by many tasks.
    """
    part = F.floor(F.col("frame") / PART_FRAMES).alias("part")
    ev = inputs.groupBy("match_id", part).agg(F.array_sort(F.collect_list(F.struct("frame", "slot", "seq", "action"))).alias("inputs"))
    ko = kos.groupBy("match_id", part).agg(F.array_sort(F.collect_list(F.struct("frame", "slot", "seq", "by"))).alias("kos"))
    mo = moments.groupBy("match_id", part).agg(F.array_sort(F.collect_list(F.struct("frame", "slot", "kind", "severity", "title"))).alias("moments"))
    zero = F.lit(0).cast("long").alias("part")
    head = matches.select("match_id", zero, F.struct(*[c for c in matches.columns if c != "match_id"]).alias("match"))
    who = players.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("slot", "display_name", "character_id"))).alias("players")).select("match_id", zero, "players")
    met = metrics.groupBy("match_id", "slot").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("m")).groupBy("match_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("slot").cast("string"), "m"))).alias("metrics")).select("match_id", zero, "metrics")
    j = head
    for other in (who, met, ev, ko, mo):
        j = j.join(other, ["match_id", "part"], "full")
    return j.select("match_id", "part", "match", "players", F.struct("inputs", "kos").alias("observations"), F.struct("moments", "metrics").alias("analysis"),
                    F.lit("1.1").alias("schema_version"))


def index_rows(documents: DataFrame) -> dict[str, DataFrame]:
    """The four index tables derived from documents, metrics included."""
    d = documents
    return {
        "matches": d.filter("match is not null").select("match_id", "match.*"),
        "players": d.select("match_id", F.explode("players").alias("p")).select("match_id", "p.*"),
        "moments": d.select("match_id", F.explode("analysis.moments").alias("m")).select("match_id", "m.*"),
        "metrics": d.select("match_id", F.explode("analysis.metrics").alias("slot", "m")).select(
            "match_id", F.col("slot").cast("int").alias("slot"), F.explode("m").alias("key", "value")),
    }


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Stored rows replaced or joined by incoming ones, the latest per key."""
    return latest_wins(stored.unionByName(incoming, allowMissingColumns=True), keys, [order])


def replace_slices(stored: DataFrame, found: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Stored rows outside the processed slices, plus what was found in them."""
    return stored.join(processed.select(key).distinct(), key, "left_anti").unionByName(found)


def wire_projection(documents: DataFrame) -> DataFrame:
    """Documents without their raw inputs."""
    return documents.withColumn("observations", F.col("observations").dropFields("inputs"))


def part_signatures(inputs: DataFrame) -> DataFrame:
    """Counts and a hash over the ordered inputs of each document part of a match."""
    line = F.concat_ws(":", F.col("frame").cast("string"), F.col("slot").cast("string"), "action")
    part = F.floor(F.col("frame") / PART_FRAMES).alias("part")
    rows = inputs.groupBy("match_id", part).agg(F.array_sort(F.collect_list(F.struct("frame", "slot", "seq", line.alias("line")))).alias("r"))
    return rows.select("match_id", "part", F.size("r").alias("n"), F.sha1(F.array_join(F.transform("r", lambda x: x["line"]), ",")).alias("hash"))


def signatures(inputs: DataFrame) -> DataFrame:
    """One signature per match from those of its parts."""
    return part_signatures(inputs).groupBy("match_id").agg(
        F.sum("n").alias("inputs"), F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "hash"))), lambda x: x["hash"]), ",")).alias("signature"))


def artefact_pick(artefacts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the best-ranked artefact each capture has; an empty artefact has no rows and does not count."""
    best = artefacts.groupBy(*keys).agg(F.min("rank").alias("_best"))
    return artefacts.join(best, keys).filter(F.col("rank") == F.col("_best")).drop("_best")


def capture_list(segments: DataFrame, scored: DataFrame, openings: DataFrame, punishes: DataFrame) -> DataFrame:
    """Per capture: segments, overlay seconds, last scanned instant, and which artefacts exist."""
    s = segments.groupBy("video").agg(F.count("*").alias("segments"), F.sum(F.col("end") - F.col("start")).alias("overlay_seconds"))
    last = scored.groupBy("video").agg(F.max("t").alias("scanned_seconds"))
    has = lambda df, name: df.select("video", F.lit(True).alias(name)).distinct()
    no = F.lit(False)
    return s.join(last, "video", "left").join(has(openings, "o"), "video", "left").join(has(punishes, "p"), "video", "left").select(
        "video", "segments", "overlay_seconds", "scanned_seconds", F.coalesce("o", no).alias("has_openings"), F.coalesce("p", no).alias("has_punishes"))


def takes_export(findings: DataFrame, grades: DataFrame) -> DataFrame:
    """One text line per finding with a take, under its capture; written as text, ordered by capture and line."""
    j = findings.join(grades, "id")
    return j.select("video", "id", F.concat_ws(" | ", F.col("id"), F.col("title"), F.coalesce("take", F.lit("(no words)")), F.array_join("tags", ", ")).alias("line"))


def note_tail(lines: DataFrame, schema: str, order: list[str], n: int = 50) -> DataFrame:
    """The last ``n`` notes of a line log, malformed lines skipped."""
    parsed = lines.withColumn("_n", F.from_json("value", schema, {"mode": "PERMISSIVE"})).filter(F.get_json_object("value", "$").isNotNull())
    return parsed.select("_n.*").orderBy(*[F.desc(c) for c in order]).limit(n)


def doc_summary(matches: DataFrame, players: DataFrame, kos: DataFrame, inputs: DataFrame, damage: DataFrame) -> DataFrame:
    """What a match page shows, per match."""
    n = inputs.groupBy("match_id").agg(F.count("*").alias("inputs"))
    k = kos.select("match_id", "slot", "frame").distinct().groupBy("match_id").agg(F.count("*").cast("int").alias("kos"), F.min("frame").alias("first_ko"))
    d = damage.groupBy("match_id").agg(F.count("*").alias("readings"))
    p = players.groupBy("match_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "display_name"))), lambda x: x["display_name"]), " / ").alias("names"))
    return matches.join(p, "match_id", "left").join(k, "match_id", "left").join(n, "match_id", "left").join(d, "match_id", "left").select(
        "match_id", "patch", (F.col("duration_frames") / F.col("fps")).alias("duration"), (F.col("video_offset_frames") / F.col("fps")).alias("video_offset"), "names",
        F.coalesce("kos", F.lit(0)).alias("kos"), "first_ko", F.coalesce("inputs", F.lit(0)).alias("inputs"),
        F.col("readings").isNotNull().alias("has_video"))
