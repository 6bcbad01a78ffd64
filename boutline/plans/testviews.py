"""Match-shaped views over the given tables, once in Spark and once as SQL for the checks.

A pair of users is a match (so matches grow with the data and stay the same size), the parity of the user
is the slot, ten minutes are one frame. Every row of a source table ends up in a view.
"""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.operators.settle import settle
from boutline.sources.tables import table

# Block widths of the sequence operators for these views.
FRAME_BLOCK = 1024
SECOND_BLOCK = 16.0

# Action model of the views (fixed values).
BUSY_FRAMES = {"click": 60, "view": 30, "purchase": 90, "signup": 0}
CATEGORIES = {"click": "attack", "view": "attack", "signup": "movement", "purchase": "utility"}

US = "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))"


def values(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A small fixed dimension as an inline relation the optimizer can see the size of."""
    def lit(v):
        return "null" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "\\'") + "'"
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS d({columns})")


class Tables:
    """Lazily built views over one table folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__"):
            raise AttributeError(name)
        df = table(self.spark, self.folder, name)
        self.__dict__[name] = df  # read the file's schema once
        return df

    @cached_property
    def _ticks(self) -> DataFrame:
        return self.events.select(
            F.expr("user_id div 2").alias("match_id"),
            (F.col("user_id") % 2).cast("int").alias("slot"),
            F.expr(f"{US} div 600000000").alias("frame"),
            F.expr(f"{US} / 60000000000D").alias("t"),
            F.col("event_id").alias("seq"), "event_type", "value", "user_id",
        )

    @cached_property
    def inputs(self) -> DataFrame:
        return self._ticks.filter("event_type <> 'error'").select(
            "match_id", "slot", "frame", "seq", F.col("event_type").alias("action"))

    @cached_property
    def kos(self) -> DataFrame:
        return self._ticks.filter("event_type = 'error' and value >= 60").select(
            "match_id", "slot", "frame", "seq", (1 - F.col("slot")).alias("by"))

    @cached_property
    def segments(self) -> DataFrame:
        """Usable capture segments with the fighter read on each side, unread plates NULL."""
        live = self.samples.groupBy("video", "segment").agg((F.count_if(~F.col("frozen")) / 10.0).alias("active_seconds"))
        me = F.expr("case when segment % 5 < 4 then concat('Fighter-', video % 5) else 'Fighter-9' end")
        named = live.filter("active_seconds >= 10").join(self.customer, F.col("segment") * 2 + 1 == F.col("c_custkey")).withColumn("_me", me).withColumn(
            "_opp", F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("Fighter-"), (F.col("c_nationkey") % 6).cast("string"))))
        left = F.expr("segment % 3 < 2")
        # one row per segment, read by several branches of a capture's plans
        return settle(named.select("video", "segment", "active_seconds", F.when(left, F.col("_me")).otherwise(F.col("_opp")).alias("left_name"),
                                   F.when(left, F.col("_opp")).otherwise(F.col("_me")).alias("right_name")))

    @cached_property
    def presses(self) -> DataFrame:
        """Inputs under a fighting-game vocabulary."""
        return self._ticks.filter("event_type <> 'error'").select("match_id", "slot", "frame", "seq", F.expr(
            "case event_type when 'click' then 'Heavy' when 'purchase' then 'Light' "
            "when 'view' then case when seq % 2 = 0 then 'AimUp' else 'AimDown' end "
            "else case seq % 3 when 0 then 'Dodge' when 1 then 'Jump' else 'UpJump' end end").alias("action"))

    @cached_property
    def moves_dim(self) -> DataFrame:
        """Frame facts per weapon and move, from the parts of a brand and type."""
        return self.part.groupBy(F.col("p_brand").alias("weapon"), F.expr(
            "case p_type when 'STANDARD' then 'sair' when 'ECONOMY' then 'dair' when 'MEDIUM' then 'gp' "
            "when 'PROMO' then 'recovery' when 'LARGE' then 'nair' else 'slight' end").alias("move")).agg(
            F.expr("min_by(p_size, p_partkey) % 13").cast("int").alias("startup"),
            F.expr("sum(p_size) % 30").cast("int").alias("recover_miss"),
            F.expr("case when count(*) % 2 = 0 then min(p_size) end").cast("int").alias("fixedrec_miss"),
            F.expr("count(*) % 40").cast("int").alias("cooldown"))

    @cached_property
    def roster(self) -> DataFrame:
        """Roster moves with block data: a brand is a fighter, a part name an input."""
        named = self.part.withColumn("input", F.expr(
            "case when p_name like 'hot%' then 'j.' || p_name when p_name like 'new%' then '632146' || p_name else p_name end"))
        return named.groupBy(F.col("p_brand").alias("char"), "input").agg(
            F.min("p_size").alias("startup"), F.expr("case when count(*) % 5 > 0 then int(10 - sum(p_size) % 30) end").alias("on_block"),
            F.expr("int(max(p_retailprice))").alias("damage"),
            F.expr("case min(p_type) when 'STANDARD' then 'normal' when 'ECONOMY' then 's' when 'MEDIUM' then 'super' when 'PROMO' then 'assist' when 'LARGE' then 'tokon' else 'normal' end").alias("type"),
            F.expr("case when sum(p_partkey) % 7 > 0 then int(sum(p_partkey) % 200) end").alias("reach"),
            F.expr("case when sum(p_size) % 3 = 0 then 'O' when sum(p_size) % 3 = 1 then 'M' end").alias("guard"))

    @cached_property
    def action_model(self) -> DataFrame:
        return values(self.spark, "action, busy, category", [(a, b, CATEGORIES[a]) for a, b in BUSY_FRAMES.items()])

    @cached_property
    def players(self) -> DataFrame:
        users = self.events.select("user_id").distinct()
        return users.join(self.customer, users.user_id == F.col("c_custkey")).select(
            F.expr("user_id div 2").alias("match_id"), (F.col("user_id") % 2).cast("int").alias("slot"),
            F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("display_name"),
            F.col("c_nationkey").cast("int").alias("character_id"))

    @cached_property
    def matches(self) -> DataFrame:
        span = self._ticks.groupBy("match_id").agg((F.max("frame") + 1).alias("duration_frames"))
        return span.join(self.customer, F.col("match_id") * 2 == F.col("c_custkey")).select(
            "match_id", F.concat(F.lit("v"), F.length("c_mktsegment").cast("string")).alias("patch"),
            F.lit(60).alias("fps"), "duration_frames", F.col("c_nationkey").cast("int").alias("level_id"),
            F.expr("c_acctbal > 0").alias("has_video"),
            F.expr("cast(abs(c_acctbal) as bigint)").alias("video_offset_frames"),
            F.concat(F.lit("[7.0"), F.length("c_mktsegment").cast("string"), F.lit("] GreatHall"),
                     F.col("match_id").cast("string"), F.lit("(1).replay")).alias("source_file"))

    @cached_property
    def damage(self) -> DataFrame:
        return self._ticks.filter("event_type = 'purchase'").select(
            "match_id", "slot", (F.col("frame") / 60.0).alias("seconds"),
            F.least(F.lit(1.0), F.col("value") / 200.0).alias("estimate"), "frame", "seq")

    @cached_property
    def samples(self) -> DataFrame:
        """Panel samples: one row per side and instant, unread fields NULL."""
        return self._ticks.select(
            F.expr("match_id div 5").alias("video"), F.col("match_id").alias("segment"),
            F.when(F.col("slot") == 0, "L").otherwise("R").alias("side"), "t", "seq",
            F.expr("case when seq % 3 = 0 then cast(floor(value) as int) else cast(seq % 20 as int) end").alias("damage"),
            F.expr("case event_type when 'error' then 0 when 'signup' then null else cast(floor(value) as int) end").alias("combo"),
            F.expr("case event_type when 'signup' then null when 'purchase' then cast(floor(value) as int) "
                   "when 'error' then cast(floor(value) as int) else -cast(floor(value) as int) end").alias("recovery"),
            F.expr("case event_type when 'view' then null else cast(seq % 4 + 5 as int) end").alias("startup"),
            F.expr("case event_type when 'purchase' then null else cast(floor(value) as int) end").alias("total"),
            F.expr("case event_type when 'click' then null else cast(seq % 9 as int) end").alias("active"),
            F.expr("cast(seq % 12 as int)").alias("held"), F.expr("cast(seq div 3 % 12 as int)").alias("row1"),
            F.expr("seq % 17 = 0").alias("frozen"))


_US = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00'))"

VIEW_SQL = {
    "v_ticks": f"""SELECT user_id // 2 AS match_id, CAST(user_id % 2 AS INTEGER) AS slot,
        {_US} // 600000000 AS frame, {_US} / 60000000000.0::DOUBLE AS t, event_id AS seq, event_type, value, user_id
        FROM events""",
    "v_inputs": "SELECT match_id, slot, frame, seq, event_type AS action FROM v_ticks WHERE event_type <> 'error'",
    "v_kos": """SELECT match_id, slot, frame, seq, 1 - slot AS "by" FROM v_ticks
        WHERE event_type = 'error' AND value >= 60""",
    "v_segments": """SELECT video, segment, active_seconds, CASE WHEN segment % 3 < 2 THEN me ELSE opp END AS left_name, CASE WHEN segment % 3 < 2 THEN opp ELSE me END AS right_name
        FROM (SELECT l.*, CASE WHEN segment % 5 < 4 THEN 'Fighter-' || (video % 5) ELSE 'Fighter-9' END AS me, CASE WHEN c_acctbal >= 0 THEN 'Fighter-' || (c_nationkey % 6) END AS opp
          FROM (SELECT video, segment, count(*) FILTER (WHERE NOT frozen) / 10.0::DOUBLE AS active_seconds FROM v_samples GROUP BY 1, 2) l JOIN customer ON segment * 2 + 1 = c_custkey
          WHERE active_seconds >= 10)""",
    "v_presses": """SELECT match_id, slot, frame, seq, CASE event_type WHEN 'click' THEN 'Heavy' WHEN 'purchase' THEN 'Light'
        WHEN 'view' THEN CASE WHEN seq % 2 = 0 THEN 'AimUp' ELSE 'AimDown' END
        ELSE CASE seq % 3 WHEN 0 THEN 'Dodge' WHEN 1 THEN 'Jump' ELSE 'UpJump' END END AS action
        FROM v_ticks WHERE event_type <> 'error'""",
    "v_moves_dim": """SELECT p_brand AS weapon, CASE p_type WHEN 'STANDARD' THEN 'sair' WHEN 'ECONOMY' THEN 'dair' WHEN 'MEDIUM' THEN 'gp'
        WHEN 'PROMO' THEN 'recovery' WHEN 'LARGE' THEN 'nair' ELSE 'slight' END AS move,
        CAST(arg_min(p_size, p_partkey) % 13 AS INTEGER) AS startup, CAST(sum(p_size) % 30 AS INTEGER) AS recover_miss,
        CASE WHEN count(*) % 2 = 0 THEN CAST(min(p_size) AS INTEGER) END AS fixedrec_miss, CAST(count(*) % 40 AS INTEGER) AS cooldown
        FROM part GROUP BY 1, 2""",
    "v_roster": """SELECT p_brand AS char, input, CAST(min(p_size) AS INTEGER) AS startup, CASE WHEN count(*) % 5 > 0 THEN CAST(10 - sum(p_size) % 30 AS INTEGER) END AS on_block,
        CAST(trunc(max(p_retailprice)) AS INTEGER) AS damage,
        CASE min(p_type) WHEN 'STANDARD' THEN 'normal' WHEN 'ECONOMY' THEN 's' WHEN 'MEDIUM' THEN 'super' WHEN 'PROMO' THEN 'assist' WHEN 'LARGE' THEN 'tokon' ELSE 'normal' END AS type,
        CASE WHEN sum(p_partkey) % 7 > 0 THEN CAST(sum(p_partkey) % 200 AS INTEGER) END AS reach,
        CASE WHEN sum(p_size) % 3 = 0 THEN 'O' WHEN sum(p_size) % 3 = 1 THEN 'M' END AS guard
        FROM (SELECT *, CASE WHEN p_name LIKE 'hot%' THEN 'j.' || p_name WHEN p_name LIKE 'new%' THEN '632146' || p_name ELSE p_name END AS input FROM part) GROUP BY 1, 2""",
    "v_actions": "SELECT * FROM (VALUES " + ", ".join(
        f"('{a}', {b}, '{CATEGORIES[a]}')" for a, b in BUSY_FRAMES.items()) + ") a(action, busy, category)",
    "v_players": """SELECT user_id // 2 AS match_id, CAST(user_id % 2 AS INTEGER) AS slot,
        c_mktsegment || '-' || c_nationkey AS display_name, CAST(c_nationkey AS INTEGER) AS character_id
        FROM (SELECT DISTINCT user_id FROM events) JOIN customer ON user_id = c_custkey""",
    "v_matches": """SELECT match_id, 'v' || length(c_mktsegment) AS patch, 60 AS fps, duration_frames,
        CAST(c_nationkey AS INTEGER) AS level_id, c_acctbal > 0 AS has_video,
        CAST(trunc(abs(c_acctbal)) AS BIGINT) AS video_offset_frames,
        '[7.0' || length(c_mktsegment) || '] GreatHall' || match_id || '(1).replay' AS source_file
        FROM (SELECT match_id, max(frame) + 1 AS duration_frames FROM v_ticks GROUP BY 1)
        JOIN customer ON match_id * 2 = c_custkey""",
    "v_damage": """SELECT match_id, slot, frame / 60.0::DOUBLE AS seconds, least(1.0::DOUBLE, value / 200.0) AS estimate,
        frame, seq FROM v_ticks WHERE event_type = 'purchase'""",
    "v_samples": """SELECT match_id // 5 AS video, match_id AS segment, CASE slot WHEN 0 THEN 'L' ELSE 'R' END AS side, t, seq,
        CASE WHEN seq % 3 = 0 THEN CAST(floor(value) AS INTEGER) ELSE CAST(seq % 20 AS INTEGER) END AS damage,
        CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN NULL ELSE CAST(floor(value) AS INTEGER) END AS combo,
        CASE event_type WHEN 'signup' THEN NULL WHEN 'purchase' THEN CAST(floor(value) AS INTEGER)
             WHEN 'error' THEN CAST(floor(value) AS INTEGER) ELSE -CAST(floor(value) AS INTEGER) END AS recovery,
        CASE event_type WHEN 'view' THEN NULL ELSE CAST(seq % 4 + 5 AS INTEGER) END AS startup,
        CASE event_type WHEN 'purchase' THEN NULL ELSE CAST(floor(value) AS INTEGER) END AS total,
        CASE event_type WHEN 'click' THEN NULL ELSE CAST(seq % 9 AS INTEGER) END AS active,
        CAST(seq % 12 AS INTEGER) AS held, CAST(seq // 3 % 12 AS INTEGER) AS row1, seq % 17 = 0 AS frozen
        FROM v_ticks""",
}
