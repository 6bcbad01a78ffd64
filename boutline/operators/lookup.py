"""Move tables: what answers a blocked move, command lists, trial routes, fighter cards."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boutline.functions.notation import expand_inputs, wiki_step
from boutline.functions.scalars import cost_rule

CLOSE_REACH = 60
# fixed values: words of state names that carry no meaning
NOISE = ("rsn", "nml", "atk", "tmp", "init", "special", "skill", "set", "start", "end", "ex", "2nd", "3rd", "air", "player", "shot", "x", "y", "add", "del",
         "flex", "chain", "begin", "all", "delete", "fast", "for", "limited", "attack", "hit", "stack0", "stack1", "replacement", "change", "adjustment",
         "temporary", "stop", "assemble", "u", "cmn", "act", "lv1", "lv2", "lv3", "loop", "in", "out", "on", "off", "up", "down", "front", "back", "ground",
         "land", "landing", "to", "a", "b", "c", "d")


def matchup(pairs: DataFrame, moves: DataFrame) -> DataFrame:
    """For every pair (them, you) and each of their moves with an on-block value: your answers in time.

    ``moves(char, input, startup, on_block, damage, guard, type, reach)`` is a roster table, a hundred rows a
    fighter, so a pair meets a bounded number of combinations.
    """
    theirs = moves.filter("on_block is not null").select(F.col("char").alias("them"), F.col("input").alias("move"), (-F.col("on_block")).alias("adv"), F.col("reach").alias("their_reach"))
    air = F.col("input").startswith("j.") | F.col("input").contains(".j.")
    mine = moves.filter((F.col("type") != "assist") & F.col("startup").isNotNull() & ~air).select(F.col("char").alias("you"), "input", "startup", "damage", "type", "reach", "guard")
    got = pairs.join(theirs, "them").join(mine, "you").filter(F.col("startup") <= F.col("adv"))
    gap = F.col("their_reach") - F.col("reach")
    rank = Window.partitionBy("them", "move", "you").orderBy(F.desc(F.coalesce("damage", F.lit(0))), "startup", "input")
    return got.select("them", "move", "you", "input", "startup", "damage", (F.col("adv") - F.col("startup")).alias("spare"), cost_rule(F.col("type"), F.col("input")).alias("cost"),
                      F.when(gap <= 0, "reaches").when(gap <= CLOSE_REACH, "close").when(gap.isNotNull(), "may not reach").alias("verdict"),
                      F.row_number().over(rank).alias("rank"))


def punishable(moves: DataFrame) -> DataFrame:
    """Moves that leave their owner open on block, worst first."""
    return moves.filter((F.col("on_block") < 0) & (F.col("type") != "assist")).select("char", "input", "on_block", "startup", "reach").orderBy("char", "on_block", "input")


def fighter_card(moves: DataFrame) -> DataFrame:
    """Fastest normal, longest reach, worst on block per fighter."""
    normal = F.col("type") == "normal"
    open_ = F.col("type").isin("normal", "s", "q") & ~F.col("input").startswith("dc.")

    def pick(fn, col, cond):
        return fn(F.when(cond & F.col(col).isNotNull(), F.struct(col, "input")))

    lo, hi = F.min, F.max
    return moves.groupBy("char").agg(
        F.count("*").alias("moves"), pick(lo, "startup", normal).alias("_f"), hi(F.when(F.col("reach") > 0, F.struct("reach", "input"))).alias("_l"), pick(lo, "on_block", open_).alias("_w")).select(
        "char", "moves", F.col("_f.input").alias("fastest"), F.col("_f.startup").alias("startup"), F.col("_l.input").alias("longest"), F.col("_l.reach").alias("reach"),
        F.col("_w.input").alias("worst"), F.col("_w.on_block").alias("on_block"))


def system_words(states: DataFrame, top: int = 6) -> DataFrame:
    """Words most states of a fighter are named after. ``states(char, state)``; a word counts once per state."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.translate("state", "_", " "), F.lit(r"([A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[0-9]+|[A-Z]+)"), F.lit(1)), lambda w: F.lower(w)))
    said = states.select("char", F.explode(words).alias("word")).filter(~F.col("word").isin(*NOISE) & (F.length("word") >= 3) & ~F.col("word").rlike(r"^\d+$"))
    n = said.groupBy("char", "word").agg(F.count("*").alias("n"))
    w = Window.partitionBy("char").orderBy(F.desc("n"), "word")  # a fighter's vocabulary
    return n.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def command_join(commands: DataFrame, wiki: DataFrame) -> DataFrame:
    """Inputs a command-list entry covers, each with every wiki row it has: as is, under its air form, and of the same stem where the wiki
    gives one row for all strengths (``236X``, also in the air). An input without a row comes once, with NULL.
    ``commands(char, entry, key)``, ``wiki(char, input)``."""
    ins = commands.select("char", "entry", F.explode(expand_inputs(F.col("key"))).alias("input"))
    w = wiki.select("char", F.col("input").alias("wiki")).distinct()
    ground = F.regexp_replace("wiki", r"^(j\.|dc\.)", "")
    exact = w.select("char", F.explode(F.array_compact(F.array(F.col("wiki"), F.when(F.col("wiki").startswith("j."), F.substring("wiki", 3, 1 << 20))))).alias("input"), "wiki")
    stems = w.filter(ground.endswith("X")).select("char", F.expr(r"left(regexp_replace(wiki, '^(j[.]|dc[.])', ''), length(regexp_replace(wiki, '^(j[.]|dc[.])', '')) - 1)").alias("stem"), "wiki")
    found = ins.join(exact, ["char", "input"]).unionByName(
        ins.withColumn("stem", F.expr("left(input, length(input) - 1)")).join(stems, ["char", "stem"]).drop("stem")).distinct()
    return ins.join(found, ["char", "entry", "input"], "left").select("char", "entry", "input", "wiki")


def routes(trials: DataFrame, wiki: DataFrame) -> DataFrame:
    """Trial routes in wiki notation with what each step costs. ``trials(char, route, steps)``, ``wiki(char, input, startup)``."""
    s = trials.select("char", "route", F.posexplode("steps").alias("pos", "raw")).withColumn("w", wiki_step(F.col("raw"))).select(
        "char", "route", "pos", "raw", F.col("w.input").alias("input"), F.col("w.label").alias("label"))
    rows = wiki.groupBy("char", F.col("input").alias("_w")).agg(F.min("startup").alias("_s"))
    j = s.join(rows.select("char", F.col("_w").alias("input"), F.col("_s").alias("_s1")), ["char", "input"], "left").withColumn("_g", F.replace("input", F.lit("j."), F.lit(""))).join(
        rows.select("char", F.col("_w").alias("_g"), F.col("_s").alias("_s2")), ["char", "_g"], "left").withColumn("startup", F.coalesce("_s1", "_s2"))
    spent = F.when(F.col("raw").contains("632146"), 100).when(F.split_part("raw", F.lit("~"), F.lit(1)).contains("E"), 50).otherwise(0)
    return j.groupBy("char", "route").agg(  # one trial's steps
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "input"))), lambda x: x["input"]), " > ").alias("inputs"),
        F.count("*").alias("steps"), F.count("startup").alias("known"), F.max(spent).alias("cost"))


def fastest_answers(moves: DataFrame, n: int = 5) -> DataFrame:
    """A fighter's fastest ground moves."""
    ok = moves.filter(F.col("startup").isNotNull() & (F.col("type") != "assist") & ~F.col("input").startswith("j."))
    w = Window.partitionBy("char").orderBy("startup", "input")
    return ok.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("char", "rank", "input", "startup")


def slow_overheads(moves: DataFrame, opponents: DataFrame, n: int = 8) -> DataFrame:
    """The slowest overheads of the fighters most often met. ``opponents(char, n)``."""
    met = opponents.orderBy(F.desc("n"), "char").limit(6)
    ov = moves.filter(F.col("guard").contains("O") & F.col("startup").isNotNull() & (F.col("type") != "assist"))
    return ov.join(F.broadcast(met.select("char")), "char").orderBy(F.desc("startup"), F.desc("char"), F.desc("input")).limit(n).select("char", "input", "startup")  # six rows broadcast
