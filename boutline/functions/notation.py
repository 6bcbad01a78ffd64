"""Combo notation: reading it out of text, repairing what a reader got wrong, translating game tokens."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: prefixes, buttons and words of the notation
PREFIXES = r"((?:j\.|dl\.|c\.|dc\.|cl\.|f\.|st\.|cr\.|dj\.|sj\.)*)"
BUTTONS = r"QS|QA|[LMHU]{1,3}|[AT]"
LETTER_BUTTONS = r"QS|QA|[ABCD]{1,3}|T"
WORDS = "jump|jc|sj|dj|land|dash|delay|walk|whiff|hold|charge|tag|assist|super|ultimate|dhc|tac|ult"
PREFIX_FORMS = (("cl.", ""), ("st.", "5"), ("cr.", "2"), ("c.", ""), ("f.", "6"), ("dj.", "j."), ("sj.", "j."))
WORD_FORMS = {"jc": "jump", "sj": "jump", "dj": "jump", "ult": "ultimate"}
STRIP = "()[]{}.:!?\"'"

# fixed values: reading slips and their repair, in order
SLIPS = (
    (r"[)\]}]\.(?=[0-9LMHU])", "j."),
    (r"(?<![A-Za-z0-9])S(?=[LMHU](?![A-Za-z]))", "5"),
    (r"(?<![A-Za-z0-9])Z(?=[0-9]*[LMHU])", "2"),
    (r"(?<![A-Za-z0-9])[lI](?=[0-9]*[LMHU](?![A-Za-z]))", "1"),
    (r"(?<=[0-9])O(?=[0-9LMHU])|(?<=[LMHU>])O(?=[0-9])", "0"),
    ("»|→|=>", ">"),
    (r"(?<![A-Za-z0-9])j-(?=[0-9LMHU])", "j."),
    (r"(?<![A-Za-z0-9])21U(?=[LMHU])", "214"),
    (r"(?<![A-Za-z0-9])62E(?=[LMHU])", "623"),
)
HUD_WORDS = ("magik", "hits", "hit", "good", "great", "perfect", "punish", "leader", "p1", "p2", "damage", "combo", "highest", "counter")
HINT = r"(?i)(?<![A-Za-z0-9])(?:j\.)?[1-9]{0,6}[LMHU](?![A-Za-z])|(?<![A-Za-z])(?:236|214|623|22|41236|63214)|>|xx"

# fixed values: how a text shows which buttons it names
LETTERS_SEEN = r"(^|[^A-Za-z])[1-9]?[BCD]([^A-Za-z]|$)"
BUTTONS_SEEN = r"(^|[^A-Za-z])[1-9]?j?\.?[LMHU]([^A-Za-z]|$)"


def letter_mode(text: Column) -> Column:
    """The game's own letters stand for buttons when B, C or D occur as one and L, M, H, U do not."""
    return text.rlike(LETTERS_SEEN) & ~text.rlike(BUTTONS_SEEN)


def _token(buttons: str) -> str:
    return rf"(?i)^{PREFIXES}([1-9]{{1,6}})?({buttons})((?:\+(?:{buttons}))*)(\[\]|\(hold\))?$"


def bind(value: Column, use) -> Column:
    """``use`` of a value computed once: expressions inside array functions are not shared otherwise."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _steps(word: Column, letters: bool) -> Column:
    """Steps of one candidate, NULL when it is no notation."""
    rx = _token(LETTER_BUTTONS if letters else BUTTONS)

    def parts(_):
        pre = F.lower(F.regexp_extract(word, rx, 1))
        for old, new in PREFIX_FORMS:
            pre = F.replace(pre, F.lit(old), F.lit(new))
        return F.struct(pre.alias("pre"), F.regexp_extract(word, rx, 2).alias("motion"), F.upper(F.regexp_extract(word, rx, 3)).alias("b"),
                        F.upper(F.regexp_extract(word, rx, 4)).alias("plus"))

    def mapped(g):
        if not letters:
            return g
        plain = g["b"].rlike("^[ABCD]+$")
        extra = F.transform(F.filter(F.split(g["plus"], r"\+"), lambda p: p != ""),
                            lambda p: F.concat(F.lit("+"), F.when(F.length(p) == 1, F.translate(p, "ABCD", "LMHU")).otherwise(p)))
        return F.struct(g["pre"].alias("pre"), g["motion"].alias("motion"), F.when(plain, F.translate(g["b"], "ABCD", "LMHU")).otherwise(g["b"]).alias("b"),
                        F.when(plain, F.array_join(extra, "")).otherwise(g["plus"]).alias("plus"))

    def placed(g):
        moving = g["motion"] != ""
        pre = (F.when(moving & (g["pre"] == "2"), "").when(moving & g["pre"].endswith("5"), F.left(g["pre"], F.length(g["pre"]) - 1)).otherwise(g["pre"]))
        motion = F.when(~moving & g["pre"].isin("", "j.", "dl.", "dc.", "j.dl."), "5").otherwise(g["motion"])
        presses = F.when((F.length(g["b"]) < 2) | g["b"].isin("QS", "QA"), F.array(g["b"])).otherwise(F.filter(F.split(g["b"], ""), lambda c: c != ""))
        return F.struct(pre.alias("pre"), motion.alias("motion"), g["plus"].alias("plus"), presses.alias("presses"))

    def steps(g):
        def step(b, k):
            last = k == F.size(g["presses"]) - 1
            plain = F.concat(g["pre"], F.when(k == 0, g["motion"]).otherwise("5"), b, F.when(last, g["plus"]).otherwise(""))
            again = F.when((k > 0) & g["pre"].startswith("j."), F.concat(F.lit("j.5"), b)).otherwise(plain)
            return F.regexp_replace(again, r"^j\.5(?=[0-9])", "j.")
        return F.transform(g["presses"], step)

    named = F.create_map(*[F.lit(x) for kv in WORD_FORMS.items() for x in kv])
    read = bind(bind(bind(parts(None), mapped), placed), steps)
    return F.when(word.rlike(rx), read).when(
        word.rlike(f"(?i)^({WORDS})$"), F.array(F.coalesce(F.try_element_at(named, F.lower(word)), F.lower(word))))


def parse_combo(text: Column) -> Column:
    """struct<steps, candidates, recognised, letters, confidence> read out of free text."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("→"), F.lit(">"))

    def read(s):
        words = F.transform(s["cand"], lambda c: F.btrim(c, F.lit(STRIP)))
        per = F.when(s["letters"], F.transform(words, lambda w: _steps(w, True))).otherwise(F.transform(words, lambda w: _steps(w, False)))
        return F.struct(F.filter(per, lambda x: x.isNotNull()).alias("known"), F.size(s["cand"]).alias("n"), s["letters"].alias("letters"))

    def summed(s):
        k, n = F.size(s["known"]), s["n"]
        return F.struct(F.flatten(s["known"]).alias("steps"), n.alias("candidates"), k.alias("recognised"), s["letters"].alias("letters"),
                        F.when(n > 0, F.bround(k / F.nullif(n, F.lit(0)), 2)).otherwise(F.lit(0.0)).alias("confidence"))

    split = bind(plain, lambda t: F.struct(F.filter(F.split(t, r"[\s>,~|;→]+"), lambda c: c.rlike("[A-Za-z0-9]")).alias("cand"), letter_mode(t).alias("letters")))
    return bind(bind(split, read), summed)


def repair(line: Column) -> Column:
    """Reading slips inside notation put right."""
    for pattern, put in SLIPS:
        line = F.regexp_replace(line, pattern, put)
    return line


def keep_text(joined: Column) -> tuple[Column, Column, Column]:
    """(keep, real words, notation hint) for the lines of a frame."""
    words = F.regexp_extract_all(joined, F.lit(r"([A-Za-z][A-Za-z'!?.-]{2,})"), F.lit(1))
    real = F.filter(words, lambda w: ~F.btrim(F.lower(w), F.lit("!?.")).isin(*HUD_WORDS))
    hint = joined.rlike(HINT) & joined.rlike(r"[0-9][LMHU]|j\.")
    return (F.size(real) >= 3) | hint, F.size(real), hint


# fixed values: the two token forms of a trial script, the letters of its buttons, and a command-list input
NORMAL_TOKEN = r"^NmlAtk(AIR)?(\d?)([A-E])(\w*)$"
SPECIAL_TOKEN = r"^(Special|Ultimate|Super)Skill(Air)?(\d+)([A-E])(\w*)$"
TRIAL_LETTERS = (("E", "M+H"), ("A", "L"), ("B", "M"), ("C", "H"), ("D", "U"))
COMMAND_INPUT = r"^(\d*)\s*([LMHUA](?:\+[LMHUA])?|QS|QA|T|QD)?"
TRIAL_JUMPS = ("CmnVJump", "CmnBJump", "CmnFJump", "CmnVHighJump", "CmnBHighJump", "CmnFHighJump", "CmnHomingJump", "CmnAirJump")  # fixed values
TRIAL_ATTACKS = ("NmlAtk", "SpecialSkill", "UltimateSkill", "SuperSkill", "Shot_")  # fixed values


def display_move(token: Column) -> Column:
    """A trial token in display notation; unknown tokens stand as they are."""
    normal, special = NORMAL_TOKEN, SPECIAL_TOKEN

    def tail(rx, i):
        rest = F.regexp_extract(token, rx, i)
        return F.when(rest != "", F.concat(F.lit("("), rest, F.lit(")"))).otherwise("")

    def air(rx, i):
        return F.when(F.regexp_extract(token, rx, i) != "", "j.").otherwise("")

    digit = F.regexp_extract(token, normal, 2)
    tag = F.create_map(F.lit("Special"), F.lit(""), F.lit("Ultimate"), F.lit(" ULT"), F.lit("Super"), F.lit(" SUPER"))
    return (F.when(token == "JUMP", "jump")
            .when(token.rlike(normal), F.concat(air(normal, 1), F.when(digit == "", "5").otherwise(digit), F.regexp_extract(token, normal, 3), tail(normal, 4)))
            .when(token.rlike(special), F.concat(air(special, 2), F.regexp_extract(token, special, 3), F.regexp_extract(token, special, 4),
                                                 F.try_element_at(tag, F.regexp_extract(token, special, 1)), tail(special, 5)))
            .otherwise(token))


def wiki_letters(text: Column) -> Column:
    """Trial letters A-E to inputs."""
    for old, new in TRIAL_LETTERS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def wiki_step(step: Column) -> Column:
    """struct<input, label, kind> of a trial step."""
    ultimate = F.when(step.contains("632146"), "Ultimate").otherwise("Super")
    finish, start = step.contains("ULT~Finish"), step.contains(" ULT")
    ex = step.contains("~EX")
    bare = F.when(finish, F.replace(step, F.lit(" ULT~Finish"), F.lit(""))).when(start, F.replace(step, F.lit(" ULT"), F.lit(""))).otherwise(step)
    bare = F.replace(bare, F.lit("~EX"), F.lit(""))
    label = F.when(ex, "EX").when(finish, ultimate).when(start, F.concat(ultimate, F.lit(" (start)")))
    follow = bare.contains("~") | bare.startswith("shot ")
    head = F.split_part(bare, F.lit("~"), F.lit(1))
    rest = F.when(F.instr(bare, "~") > 0, F.substring(bare, F.instr(bare, "~") + 1, F.length(bare))).otherwise("")
    raw = F.concat(F.when(bare.startswith("shot"), head).otherwise(wiki_letters(head)), F.when(rest != "", F.concat(F.lit("~"), rest)).otherwise(""))
    return (F.when(step == "jump", F.struct(F.lit("jump").alias("input"), F.lit("Jump").alias("label"), F.lit("move").alias("kind")))
            .when(follow, F.struct(raw.alias("input"), F.lit("follow-up").alias("label"), F.lit("raw").alias("kind")))
            .otherwise(F.struct(wiki_letters(bare).alias("input"), label.alias("label"), F.lit("attack").alias("kind"))))


def expand_inputs(key: Column) -> Column:
    """Wiki inputs a command-list key covers; later alternatives inherit the prefix of the inputs so far."""
    k = F.regexp_replace(F.btrim(F.split_part(key, F.lit("("), F.lit(1))), r" ?\+ ?", "+")
    rx = COMMAND_INPUT
    empty = F.array().cast("array<string>")

    def add(acc, alt):
        alt = F.btrim(alt)
        button = F.regexp_extract(alt, rx, 2)
        own = F.regexp_extract(alt, rx, 1)
        pre = F.when((own == "") & (F.size(acc) > 0), F.regexp_extract(F.array_max(acc), r"^(\d*)", 1)).otherwise(own)
        made = F.when(button.isin("L", "M", "H", "U"), F.concat(F.when(pre == "", "5").otherwise(pre), button)).otherwise(F.concat(pre, button))
        return F.when(button.isin("", "QS", "QA", "T", "QD"), acc).otherwise(F.array_union(acc, F.array(made)))

    return F.array_sort(F.aggregate(F.split(k, "/"), empty, add))
