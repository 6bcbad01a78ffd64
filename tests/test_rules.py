"""Rules of moments, outcomes, payoffs and text on small hand-made inputs."""

from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from boutline.functions import notation as N
from boutline.functions import payoffs as PF
from boutline.functions import scalars as S
from boutline.operators import classify as C
from boutline.operators import moments as M
from boutline.operators import outcome as O
from boutline.operators import review as R
from boutline.operators import textops as X


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


@pytest.mark.parametrize("width", [8, 64])
def test_burst_counts_only_from_the_event_on(spark, width):
    rows = [(0, 0, f, i, "a") for i, f in enumerate([10, 10, 10, 70, 71])]
    got = {r.seq: r.presses for r in M.bursts(spark.createDataFrame(rows, "match_id int, slot int, frame long, seq int, action string"), 60, 2, width).collect()}
    assert got == {0: 4, 1: 3, 2: 2, 3: 2}


def test_games_declare_their_vocabulary(spark):
    from boutline.functions import games
    rows = {r.action: (r.busy, r.category) for r in games.get("platform_fighter").actions(spark).collect()}
    assert rows["Dodge"] == (14, "defence") and rows["Light"] == (0, "attack")
    with pytest.raises(KeyError):
        games.get("chess")


def test_press_edges(spark):
    held = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 10, 3), (1, 0, 20, 2), (1, 0, 30, 3), (2, 0, 5, 2)], "match_id int, stream int, ts_ms long, state int")
    got = sorted((r.match_id, r.ts_ms, r.action) for r in M.press_edges(held, {0: "Up", 1: "Down"}, 16).collect())
    assert got == [(1, 0, "Up"), (1, 10, "Down"), (1, 30, "Up"), (2, 5, "Down")]


def test_gap_bounds(spark):
    rows = [(0, 0, f, i, "a") for i, f in enumerate([0, 59, 119, 227])]
    inputs = spark.createDataFrame(rows, "match_id int, slot int, frame long, seq int, action string")
    acts = spark.createDataFrame([("a", 60, "x")], "action string, busy int, category string")
    assert [r.seq for r in M.wasted_inputs(inputs, acts, 64).filter("wasted").collect()] == [1]
    assert [(r.seq, r.gap) for r in M.idles(inputs, 108, 64).collect()] == [(2, 108)]


def test_outcomes(spark):
    P = spark.createDataFrame([(m, s) for m in range(4) for s in range(2)] + [(9, 0), (9, 1), (9, 2)], "match_id int, slot int")
    kos = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 0), (1, 1), (9, 0)], "match_id int, slot int")
    res = spark.createDataFrame([(1, 0, 3), (1, 1, 5), (2, 0, 4), (2, 1, 4), (9, 0, 1), (9, 1, 2)], "match_id int, slot int, value int")
    got = {(r.match_id, r.slot): (r.outcome, r.source) for r in O.match_outcome(P, kos, res).collect()}
    assert got[(0, 0)] == ("loss", "deaths") and got[(0, 1)] == ("win", "deaths")
    assert got[(1, 0)] == ("loss", "result_field") and got[(1, 1)] == ("win", "result_field")
    assert got[(2, 0)] == (None, None) and got[(3, 0)] == (None, None)
    assert got[(9, 1)] == ("win", "result_field") and got[(9, 2)] == (None, "result_field")


def test_option_rules(spark):
    def opt(fn, *acts):
        return one(spark, fn(F.array(*[F.lit(a) for a in acts])))
    assert opt(R.defender_option, "Heavy", "UpJump") == "recovery"
    assert opt(R.defender_option, "Dodge", "Light") == "airdodge"
    assert opt(R.defender_option, "Light") == "contest"
    assert opt(R.defender_option, "Jump") == "doublejump"
    assert opt(R.defender_option, "AimUp") is None
    assert opt(R.attacker_option, "Heavy", "AimDown") == "deep_dair"
    assert opt(R.attacker_option, "Dodge") is None


def cells(spark, startup=11, known=True, mine=None, theirs=None):
    rows = [("W", m, s, 16, 6, 9) for m, s in (("sair", 12), ("dair", 15), ("gp", 12 if known else 0), ("recovery", startup))]
    facts = R.weapon_facts(spark.createDataFrame(rows, "weapon string, move string, startup int, recover_miss int, fixedrec_miss int, cooldown int"))
    ctx = facts.select(F.col("facts").alias("mine"), F.col("facts").alias("theirs"), F.lit(mine).cast("double").alias("my_damage"), F.lit(theirs).cast("double").alias("their_damage"))
    return {(r.d, r.a): r for r in R.payoff_cells(ctx).collect()}


def test_payoff_properties(spark):
    fast, slow = cells(spark, 5), cells(spark, 20)
    assert fast[("recovery", "deep_dair")].score > slow[("recovery", "deep_dair")].score
    fresh, dying = cells(spark, mine=0.0, theirs=1.0), cells(spark, mine=1.0, theirs=0.0)
    assert all(fresh[k].score >= dying[k].score for k in fresh if k[1] in PF.ATTACK_MOVE)
    unknown, half = cells(spark), cells(spark, mine=0.5, theirs=0.5)
    assert all(unknown[k].score == pytest.approx(half[k].score) for k in unknown)
    doubt = cells(spark, known=False)
    assert doubt[("contest", "gp")].confidence == PF.UNSURE and doubt[("contest", "wait")].confidence == 1.0
    assert all(r.row_confidence == PF.UNSURE for r in doubt.values())
    assert "f11" in cells(spark)[("recovery", "deep_dair")].why
    assert len(unknown) == 25 and all(-1.5 <= r.score <= 1 for r in unknown.values())


@pytest.mark.parametrize("text,steps", [
    ("2M > 5H > 236H", ["2M", "5H", "236H"]), ("j.HH, jump, MM", ["j.5H", "j.5H", "jump", "5M", "5M"]), ("cr.L xx st.H+A", ["2L", "55H+A"]),
    ("5B > 5C > D", ["5M", "5H", "5U"]), ("jc dl.214U land", ["jump", "dl.214U", "land"]), ("", []), ("hello there", [])])
def test_parse_combo(spark, text, steps):
    got = one(spark, N.parse_combo(F.lit(text)))
    if text == "cr.L xx st.H+A":  # the prefix 5 stands, no motion follows it
        steps = [s.replace("55H", "5H") for s in steps]
    assert got.steps == steps


@pytest.mark.parametrize("raw,put", [("SH > ZM", "5H > 2M"), (").5L", "j.5L"), ("j-2U", "j.2U"), ("21UM 62EH", "214M 623H"), ("lM", "1M"), ("Super Hot", "Super Hot")])
def test_repair(spark, raw, put):
    assert one(spark, N.repair(F.lit(raw))) == put


def test_clock(spark):
    assert one(spark, S.clock_seconds(F.lit("1:02:03,5"))) == 3723.5
    assert one(spark, S.clock_seconds(F.lit("1:x"))) is None
    assert one(spark, S.clock_text(F.lit(119.6))) == "1:60"
    assert one(spark, S.ms_to_frames(F.lit(25.0 / 3 * 2.5))) is not None
    assert one(spark, S.panel_value(F.lit("-46(-1)"))) is None and one(spark, S.panel_value(F.lit("-46(-1)"), signed=True)) == -46


def test_closed_set_refuses_ties_and_scraps(spark):
    roster = spark.createDataFrame([("HULK",), ("DOCTORDOOM",), ("STORM",), ("STERM",)], "key string")
    reads = spark.createDataFrame([("FUL",), ("DOCTORDOOK",), ("STARM",), ("STORM",), ("ZZZZZZ",)], "text string")
    got = {r.text: r.name for r in C.fuzzy_snap(reads, roster).collect()}
    assert got == {"FUL": None, "DOCTORDOOK": "DOCTORDOOM", "STARM": None, "STORM": "STORM", "ZZZZZZ": None}


def test_template_margin_is_between_names(spark):
    tpl = spark.createDataFrame([("a", [0.0, 0.0]), ("a", [0.01, 0.0]), ("b", [1.0, 1.0])], "name string, vec array<float>")
    reads = spark.createDataFrame([(1, [0.0, 0.01]), (2, [0.5, 0.5])], "id int, vec array<float>")
    got = {r.id: r.name for r in C.template_match(reads, tpl, key="id", max_dist=0.13, min_margin=0.02).collect()}
    assert got == {1: "a", 2: None}
    twice = spark.createDataFrame([(1, [0.0, 0.01]), (1, [1.0, 0.99])], "id int, vec array<float>")
    assert sorted(r.name for r in C.template_match(twice, tpl, key="id", max_dist=0.13, min_margin=0.02).collect()) == ["a", "b"]
    assert [r.name for r in C.template_match(twice, tpl.limit(0), key="id", max_dist=0.13, min_margin=0.02).collect()] == [None, None]


def test_long_tokens_and_inputs_stay_whole(spark):
    long = "A" * 5000
    scripts = spark.createDataFrame([(1, f"-MISSION-\n-LIST-\n|{long}\n")], "id int, text string")
    assert long in {r.value for r in X.trial_missions(scripts, "id", "text").collect()}
    from boutline.operators.lookup import command_join

    entry = "2" * 100 + "L"
    commands = spark.createDataFrame([("c", 1, entry)], "char string, entry int, key string")
    wiki = spark.createDataFrame([("c", "j.none")], "char string, input string")
    given = command_join(commands, wiki).first().input
    assert len(given) > 64
    assert command_join(commands, wiki.selectExpr("char", f"'j.{given}' AS input")).first().wiki == f"j.{given}"


class Blocks(HTMLParser):
    """Reference reading of a page: blocks of kept tags, innermost text only."""

    def __init__(self):
        super().__init__()
        self.open, self.hidden, self.found = [], 0, []

    def handle_starttag(self, tag, attrs):
        if tag in X.SKIP_TAGS:
            self.hidden += 1
        elif tag in X.KEEP_TAGS:
            self.open.append((tag, []))
        elif tag == "br" and self.open:
            self.open[-1][1].append(" ")

    def handle_endtag(self, tag):
        if tag in X.SKIP_TAGS:
            self.hidden = max(0, self.hidden - 1)
        elif self.open and self.open[-1][0] == tag:
            text = " ".join("".join(self.open.pop()[1]).split())
            if text:
                self.found.append((tag, text))

    def handle_data(self, data):
        if self.open and not self.hidden:
            self.open[-1][1].append(data)


def test_page_blocks(spark):
    pages = [(r.page_id, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html").collect()]
    pages += [(-1, "<ul><li>own <p>inner &amp; more</p> tail<br>end</li></ul><nav><p>no</p></nav><p>open <li>x</li>"), (-2, "<script>if (a<b) '</p>'</script><p>ok</p>"), (-3, "")]
    got = {}
    for r in X.page_blocks(spark.createDataFrame(pages, "page_id long, html string"), "page_id", "html").orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append((r.kind, r.text))
    for pid, html in pages:
        p = Blocks()
        p.feed(html)
        assert got.get(pid, []) == p.found, pid


def test_reply_json(spark):
    reply = '{"question": "q", "take": []}'
    assert one(spark, X.reply_json(F.lit("```json\n" + reply + "\n```"))).question == "q"
    assert one(spark, X.reply_json(F.lit("well " + reply + " ok"))).question == "q"
    assert one(spark, X.reply_json(F.lit("no { json"))) is None


def test_transcripts(spark):
    files = [(1, "WEBVTT\n\n1\n00:00:01.500 --> 00:00:02.000\n<i>hello</i>\nthere\n\n\n2\n00:01:02,250 --> x\nbye"), (2, "0:32\nfirst\n1:02:03 second\n9:99\n")]
    got = sorted((r.id, r.t, r.text) for r in X.transcript_segments(spark.createDataFrame(files, "id int, raw string"), "id", "raw").collect())
    assert got == [(1, 1.5, "hello there"), (1, 62.25, "bye"), (2, 32.0, "first"), (2, 3723.0, "second")]


def test_a_hot_key_is_shared_by_blocks(spark):
    """A key with nearly all rows: no (key, block) group and no salted group holds more than its share."""
    from boutline.operators.seq import BLOCK, blocked
    from boutline.operators.skew import spread_join
    rows = spark.range(40000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(99).alias("k"), F.col("id").alias("frame"))
    assert blocked(rows, "frame", 1000).groupBy("k", BLOCK).count().agg(F.max("count")).first()[0] <= 1000
    facts = rows.select("k").distinct().withColumn("x", F.col("k") * 2)
    joined = spread_join(rows, facts, ["k"])
    assert joined.count() == 40000 and joined.filter("x <> k * 2").count() == 0
    share = rows.groupBy("k", F.pmod(F.xxhash64("k", "frame"), F.lit(16))).count().agg(F.max("count")).first()[0]
    assert share < 40000 / 8
    assert spread_join(rows, facts.filter("k = 99"), ["k"], "left_anti").count() == 4000
    assert spread_join(rows, facts.filter("k = 99"), ["k"], "left").filter("x is null").count() == 4000
