"""Text sources: transcripts, read frames, web pages, posts, replies, trial scripts."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutline.functions import notation as N
from boutline.functions.entities import unescape
from boutline.functions.scalars import clock_seconds
from boutline.operators.seq import along, blocked


def parse_combos(df: DataFrame, text: str, only_lines: bool = False) -> DataFrame:
    """Rows with the combo read out of ``text`` as steps, candidates, recognised, letters, confidence.

    The reading is generated, not projected, so that no later filter or column makes the engine read again.
    """
    read = F.array(N.parse_combo(F.col(text)))
    if only_lines:
        read = F.filter(read, lambda p: (F.size(p["steps"]) >= 3) & (p["confidence"] >= 0.5))
    return df.select("*", F.inline(read))


def combo_lines(posts: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of a text that read as a combo: at least three steps, at least half of it recognised."""
    lines = posts.select(key, F.posexplode(F.split(text, r"[\r\n]+")).alias("pos", "line"))
    return parse_combos(lines, "line", only_lines=True).select(key, "pos", F.btrim("line").alias("line"), "steps", "confidence")


def best_lines(lines: DataFrame, key: str) -> DataFrame:
    """The combo lines of a text (``combo_lines``), best first: by confidence, then steps, then place."""
    best = Window.partitionBy(key).orderBy(F.desc("confidence"), F.size("steps").desc(), "pos")  # lines of one text
    return lines.withColumn("rank", F.row_number().over(best))


def transcript_segments(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, t, text) from subtitle blocks or a pasted panel, whichever the file holds."""
    arrows = files.filter(F.col(text).contains("-->"))
    blocks = arrows.select(key, F.posexplode(F.split(text, r"\n\s*\n")).alias("pos", "_b"))
    stamp = F.regexp_extract("_b", r"(\d+:\d+(?::\d+)?[.,]?\d*)\s*-->", 1)
    kept = F.filter(F.split("_b", r"\r?\n"), lambda ln: ~ln.contains("-->") & ~F.btrim(ln).rlike(r"^\d+$") & ~ln.startswith("WEBVTT"))
    subs = blocks.filter(stamp != "").select(key, "pos", F.coalesce(clock_seconds(stamp), F.lit(0.0)).alias("t"),
                                             F.regexp_replace(F.btrim(F.array_join(kept, " ")), "<[^>]+>", "").alias("text")).filter("text <> ''")
    rx = r"(?s)^\s*(\d{1,2}:\d{2}(?::\d{2})?)\s*(.*)$"
    panel = files.filter(~F.col(text).contains("-->")).select(key, F.split(text, r"\r?\n").alias("_l"))
    lines = panel.select(key, "_l", F.posexplode("_l").alias("pos", "_b")).filter(F.col("_b").rlike(rx))
    inline = F.btrim(F.regexp_extract("_b", rx, 2))
    said = F.when(inline != "", inline).otherwise(F.btrim(F.get("_l", F.col("pos") + 1)))
    pasted = lines.select(key, "pos", F.coalesce(clock_seconds(F.regexp_extract("_b", rx, 1)), F.lit(0.0)).alias("t"), said.alias("text")).filter("text <> ''")
    return subs.unionByName(pasted)


def text_blocks(frames: DataFrame, *, gap=3.0, width=600.0) -> DataFrame:
    """Consecutive frames with the same text within ``gap`` seconds become one block: (source, t, t_end, key)."""
    seen = along(blocked(frames, "t", width), ["source"], ["t"], prev={"_pt": F.col("t"), "_pk": F.col("key")})
    new = seen.withColumn("_new", F.when((F.col("key") == F.col("_pk")) & (F.col("t") - F.col("_pt") <= gap), 0).otherwise(1).cast("long"))
    runs = along(new, ["source"], ["t"], total={"_r": F.col("_new")})
    return runs.groupBy("source", (F.col("_r") + F.col("_new")).alias("_run")).agg(
        F.min("t").alias("t"), F.max("t").alias("t_end"), F.min("key").alias("key"), F.count("*").alias("frames")).drop("_run")


def ocr_lines(words: DataFrame, min_conf: float = 50) -> DataFrame:
    """Words of a frame to lines: lines by their top, words by x. A frame holds a screenful of words."""
    kept = words.filter(F.col("conf") >= min_conf).groupBy("frame", "line").agg(
        F.min("y").alias("y"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda w: w["text"]), " ").alias("text"))
    return kept.groupBy("frame").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "line", "text"))), lambda w: w["text"]), "\n").alias("text"))


# The tags whose text is kept, and those whose content is not.
KEEP_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td", "th")
SKIP_TAGS = ("script", "style", "nav", "footer", "noscript")


def page_blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, kind, text) of headings, paragraphs, list items and cells outside skipped parts of a page.

    The page is cut into tags and text, which are folded over a stack of open blocks: text goes to the
    innermost one, a closing tag only closes the innermost one.
    """
    body = F.regexp_replace(F.col(html), r"(?s)<!--.*?-->", "")
    for tag in ("script", "style"):  # their content is no markup
        body = F.regexp_replace(body, rf"(?is)(<{tag}\b[^>]*>).*?(</{tag}\s*>)", "$1$2")
    tokens = F.regexp_extract_all(body, F.lit(r"(</?[A-Za-z][^>]*>|[^<]+|<)"), F.lit(1))
    tag_rx = r"^<(/?)([A-Za-z][A-Za-z0-9]*)"
    block = "struct<kind:string,text:string>"

    def turn(s, tok):
        name, closing = F.lower(F.regexp_extract(tok, tag_rx, 2)), F.regexp_extract(tok, tag_rx, 1) == "/"
        stack, depth = s["stack"], F.size(s["stack"])
        top = F.try_element_at(stack, F.lit(-1))
        below = F.slice(stack, 1, F.greatest(depth - 1, F.lit(0)))

        def state(skip=None, stack_=None, out=None):
            return F.struct((s["skip"] if skip is None else skip).alias("skip"), (stack if stack_ is None else stack_).alias("stack"),
                            (s["out"] if out is None else out).alias("out"))

        def written(text):
            return F.concat(below, F.array(F.struct(top["kind"].alias("kind"), F.concat(top["text"], text).alias("text"))))

        keep, skipped = name.isin(*KEEP_TAGS), name.isin(*SKIP_TAGS)
        done = F.btrim(F.regexp_replace(top["text"], r"[\s\u00a0]+", " "))
        return (F.when(skipped, state(skip=F.greatest(F.lit(0), s["skip"] + F.when(closing, -1).otherwise(1))))
                .when(keep & ~closing, state(stack_=F.concat(stack, F.array(F.struct(name.alias("kind"), F.lit("").alias("text"))))))
                .when(keep & (top["kind"] == name), state(stack_=below, out=F.when(done != "", F.concat(
                    s["out"], F.array(F.struct(name.alias("kind"), done.alias("text"))))).otherwise(s["out"])))
                .when((name == "br") & ~closing & (depth > 0), state(stack_=written(F.lit(" "))))
                .when((name == "") & (s["skip"] == 0) & (depth > 0), state(stack_=written(unescape(tok))))
                .otherwise(s))

    none = F.array().cast(f"array<{block}>")
    start = F.struct(F.lit(0).alias("skip"), none.alias("stack"), none.alias("out"))
    return pages.select(key, F.posexplode(F.aggregate(tokens, start, turn)["out"]).alias("pos", "_b")).select(
        key, "pos", F.col("_b.kind").alias("kind"), F.col("_b.text").alias("text"))


GRAM, FEW_NAMES = 3, 256


def naming(texts: DataFrame, names: DataFrame, text: str) -> DataFrame:
    """Rows of ``texts`` with each of ``names(name, ...)`` that ``text`` contains, in whatever case; an empty name is in no text.

    FEW_NAMES or fewer are sent to every task and looked for in turn. Of more, each is found by one of its grams of GRAM characters, the
    one that fewest names have, so only texts with that gram are searched for it: taking a text apart into grams costs as much as
    looking for some hundred names."""

    def grams(low, n):
        return F.regexp_extract_all(low, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))

    named = names.withColumn("_low", F.lower("name")).filter("_low <> ''")
    if named.limit(FEW_NAMES + 1).count() <= FEW_NAMES:
        return texts.withColumn("_text", F.lower(text)).join(F.broadcast(named), F.col("_text").contains(F.col("_low"))).drop("_text", "_low")
    own = F.when(F.length("_low") >= GRAM, grams(F.col("_low"), GRAM)).otherwise(F.array("_low"))
    each = named.select("_low").distinct().select("_low", F.explode(F.array_distinct(own)).alias("_gram"))
    rare = each.join(each.groupBy("_gram").agg(F.count("*").alias("_n")), "_gram").groupBy("_low").agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"))
    low = F.lower(text)
    found = F.array_distinct(F.concat(*[grams(low, n) for n in range(1, GRAM + 1)]))
    placed = texts.withColumn("_text", low).withColumn("_gram", F.explode(found))
    return placed.join(named.join(rare, "_low"), "_gram").filter(F.col("_text").contains(F.col("_low"))).drop("_gram", "_text", "_low")


def tier_list(blocks: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """First tier each name stands under: a tier heading carries forward, names count in short blocks only."""
    rx = r"(?i)\b([SABCDEF])[\s-]?Tier\b"
    marked = blocks.withColumn("_tier", F.when(F.col("kind").startswith("h") & F.col("text").rlike(rx), F.upper(F.regexp_extract("text", rx, 1))))
    w = Window.partitionBy(key).orderBy("pos")  # blocks of one page
    under = marked.withColumn("tier", F.last("_tier", True).over(w)).filter("tier is not null and _tier is null").filter(F.length("text") < 80)
    hit = naming(under, names.select("name"), "text")
    return hit.groupBy(key, "name").agg(F.min_by("tier", "pos").alias("tier"))


def page_sections(blocks: DataFrame, key: str) -> DataFrame:
    """First long paragraph under overview and how-to-play headings, and combo lines under combo headings."""
    w = Window.partitionBy(key).orderBy("pos")
    head = F.col("kind").startswith("h")
    under = blocks.withColumn("section", F.last(F.when(head, F.col("text")), True).over(w)).filter(~head)
    low = F.lower(F.coalesce("section", F.lit("")))
    long_p = (F.col("kind") == "p") & (F.length("text") > 40)
    combo = F.col("kind").isin("li", "p", "td") & low.contains("combo") & F.col("text").rlike("[》>→]")

    def first(cond):
        return F.min_by(F.when(cond, F.col("text")), F.when(cond, F.col("pos")))

    return under.groupBy(key).agg(first(long_p & low.contains("overview")).alias("overview"), first(long_p & low.contains("how to play")).alias("how_to_play"),
                                  F.count_if(combo).alias("combos"))


def post_text(html: Column) -> Column:
    """Text of a post's first paragraph (or all of it), breaks as newlines."""
    body = F.coalesce(F.nullif(F.regexp_extract(html, r"(?s)<p[^>]*>(.*?)</p>", 1), F.lit("")), html)
    return F.btrim(unescape(F.regexp_replace(F.regexp_replace(body, r"<br\s*/?>", "\n"), "<[^>]+>", "")))


REPLY = "struct<question:string,confidence:string,take:array<struct<text:string,refs:array<string>,label:string>>>"


def reply_json(text: Column) -> Column:
    """A reply parsed as it is, without its code fence, or from the outermost braces; else NULL."""
    t = F.btrim(text)
    bare = F.when(t.startswith("```"), F.regexp_replace(F.btrim(t, F.lit("`")), "^json", "")).otherwise(t)
    braces = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)

    def valid(x):
        return F.when(F.get_json_object(x, "$").isNotNull(), F.from_json(x, REPLY))

    return F.coalesce(valid(bare), valid(braces))


def ref_integrity(claims: DataFrame, known: DataFrame) -> DataFrame:
    """References of each claim reduced to existing ids; a bad one, or none on a claim that is no guess, demotes it.

    ``claims(claim, label, refs)``, ``known(ref)``.
    """
    refs = claims.select("claim", F.posexplode("refs").alias("pos", "ref"))
    seen = refs.join(known.select("ref", F.lit(True).alias("ok")).distinct(), "ref", "left")
    per = seen.groupBy("claim").agg(
        F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("pos", "ref")))).alias("_good"), F.count_if(F.col("ok").isNull()).alias("bad"))
    j = claims.join(per, "claim", "left")
    good = F.coalesce(F.transform("_good", lambda r: r["ref"]), F.array().cast("array<string>"))
    demoted = (F.coalesce("bad", F.lit(0)) > 0) | ((F.size(good) == 0) & (F.col("label") != "guess"))
    return j.select("claim", good.alias("refs"), F.when(demoted, "guess").otherwise(F.col("label")).alias("label"), demoted.alias("demoted"))


def roster_mention(texts: DataFrame, roster: DataFrame, key: str, text: str) -> DataFrame:
    """First roster name (roster order) each text contains. ``roster(name, ord)`` is a closed set."""
    hit = naming(texts.select(key, F.col(text).alias("text")), roster, "text")
    return hit.groupBy(key).agg(F.min_by("name", "ord").alias("name"))


def concept_tags(texts: DataFrame, key: str, text: str, rules: dict[str, list[str]], unless: dict[str, list[str]]) -> DataFrame:
    """First sentence of each text that holds a word of a tag and none of the words that rule it out."""
    sents = texts.select(key, F.posexplode(F.split(F.col(text), r"\. ")).alias("pos", "_s")).withColumn("sentence", F.btrim("_s")).filter("sentence <> ''")
    low = F.lower("sentence")

    def any_of(words):
        return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(w)) if words else F.lit(False)

    tags = F.array_compact(F.array(*[F.when(any_of(ws) & ~any_of(unless.get(t, [])), F.lit(t)) for t, ws in rules.items()]))
    return sents.withColumn("tag", F.explode(tags)).groupBy(key, "tag").agg(F.min_by("sentence", "pos").alias("sentence"), F.min("pos").alias("pos"))


def quotes(lines: DataFrame, fighter: str | None, keywords: list[str], limit: int) -> DataFrame:
    """Lines of sources about a fighter (untagged sources count for all) holding any keyword, in source order."""
    low = F.lower("text")
    picked = lines if fighter is None else lines.filter(F.col("fighter").isNull() | (F.lower("fighter") == fighter.lower()))
    if keywords:
        words = F.array(*[F.lit(k.lower()) for k in keywords])
        picked = picked.filter(F.exists(words, lambda k: low.contains(k)))
    return picked.orderBy("source", "t").limit(limit)


def thread_prune(thread: DataFrame, keep: int = 6) -> DataFrame:
    """Threads cut back to end with the player, last ``keep`` turns."""
    end = thread.filter("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("_end"))
    cut = thread.join(end, "conv_id").filter("turn <= _end").drop("_end")
    # the last of each stretch of a thread first, so that a long thread is not ranked in one task
    local = Window.partitionBy("conv_id", F.expr("turn div 1000")).orderBy(F.desc("turn"))
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    near_end = cut.withColumn("_r", F.row_number().over(local)).filter(F.col("_r") <= keep)
    return near_end.withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= keep).drop("_r")


def trial_missions(scripts: DataFrame, key: str, text: str) -> DataFrame:
    """Missions of a token stream: what follows each -MISSION- marker, sorted into kinds after -LIST-."""
    tok = scripts.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"([ -~]{2,})"), F.lit(1))).alias("pos", "tok"))
    w = Window.partitionBy(key).orderBy("pos")  # tokens of one script
    m = tok.withColumn("mission", F.count_if(F.col("tok") == "-MISSION-").over(w)).filter("mission > 0")
    wm = Window.partitionBy(key, "mission").orderBy("pos")
    listed = m.withColumn("_in", F.count_if(F.col("tok") == "-LIST-").over(wm)).filter("_in > 0 and tok <> '-LIST-'")
    tokc = F.col("tok")
    kind = (F.when(tokc.startswith("|"), "seq").when(tokc.startswith("CL_"), "skip").when(tokc.startswith("+"), "alt")
            .when(tokc.rlike(r"^\d+$"), "num").when(tokc.startswith("//") | tokc.startswith("-"), "skip").otherwise("tag"))
    return listed.withColumn("kind", kind).filter("kind <> 'skip'").select(
        key, "mission", "pos", "kind", F.when(F.col("kind").isin("seq", "alt"), F.expr("substring(tok, 2)")).otherwise(tokc).alias("value"))


def trial_routes(missions: DataFrame, key: str) -> DataFrame:
    """Routes of missions with two attacks or more: jump variants collapsed, simple duplicates dropped; ``alts`` are the moves a mission takes
    instead, as shown. ``mission`` counts from 1."""
    jump = F.col("value").isin(*N.TRIAL_JUMPS)
    seq = missions.filter("kind = 'seq'").groupBy(key, "mission").agg(  # one trial's steps
        F.transform(F.array_sort(F.collect_list(F.struct("pos", F.when(jump, "JUMP").otherwise(F.col("value")).alias("v")))), lambda s: s["v"]).alias("_raw"))
    kept = F.aggregate("_raw", F.array().cast("array<string>"), lambda acc, x: F.when(
        F.coalesce(((x == "JUMP") & (F.try_element_at(acc, F.lit(-1)) == "JUMP"))
                   | (x.rlike(r"^SimpleSkill(Air)?\dE[A-C]$") & F.try_element_at(acc, F.lit(-1)).rlike("^(SpecialSkill|Skill)")), F.lit(False)), acc)
        .otherwise(F.concat(acc, F.array(x))))
    numbers = missions.groupBy(key, "mission").agg(
        F.min_by(F.when(F.col("kind") == "num", F.col("value").try_cast("int")), F.when(F.col("kind") == "num", F.col("pos"))).alias("_n"),
        F.max(F.coalesce((F.col("kind") == "tag") & (F.col("value") == "dam"), F.lit(False))).alias("_dam"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "alt", F.struct("pos", "value")))).alias("_alts"))
    attack = "^(" + "|".join(N.TRIAL_ATTACKS) + ")"
    return seq.withColumn("steps", kept).filter(F.size(F.filter("steps", lambda s: s.rlike(attack))) >= 2).join(numbers, [key, "mission"]).select(
        key, "mission", "steps", F.transform("steps", N.display_move).alias("shown"), F.when(F.col("_dam"), F.col("_n")).alias("damage_req"),
        F.transform("_alts", lambda a: N.display_move(a["value"])).alias("alts"))


def cancel_table(routes: DataFrame) -> DataFrame:
    """How often each attack or jump of a route is followed by which other."""
    shown = F.filter("steps", lambda s: s.rlike("^(NmlAtk|SpecialSkill|UltimateSkill|Shot_)") | (s == "JUMP"))
    pairs = routes.select(shown.alias("s")).filter("size(s) > 1").select(F.explode(F.transform(
        F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.struct(F.element_at("s", i).alias("a"), F.element_at("s", i + 1).alias("b")))).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def source_combos(screen: DataFrame, speech: DataFrame) -> DataFrame:
    """Combos of a source, screen before speech, the first of equal steps kept.

    Both ``(source, t, pos, steps, confidence)``."""
    both = screen.withColumn("_k", F.lit(0)).unionByName(speech.withColumn("_k", F.lit(1)))
    key = F.array_join("steps", " ")
    first = both.filter(F.size("steps") >= 3).groupBy("source", key.alias("steps")).agg(
        F.min_by(F.struct("t", "confidence", "_k"), F.struct("_k", "t", "pos")).alias("_f"))
    return first.select("source", "steps", "_f.t", "_f.confidence", F.when(F.col("_f._k") == 0, "screen").otherwise("speech").alias("from"))


def clean_record(df: DataFrame) -> DataFrame:
    """Technique records within their limits: 60 steps, 8 concepts, 200 or 2000 characters, empty credits dropped."""
    steps = F.slice(F.filter(F.transform("steps", lambda s: F.btrim(s)), lambda s: s != ""), 1, 60)
    credit = (F.coalesce("credit_who", F.lit("")) != "") | (F.coalesce("credit_url", F.lit("")) != "")
    return df.select(
        "id", steps.alias("steps"), F.slice("concepts", 1, 8).alias("concepts"), F.left(F.coalesce("title", F.lit("")), F.lit(200)).alias("title"),
        F.left(F.coalesce("notes", F.lit("")), F.lit(2000)).alias("notes"),
        F.when(credit, F.ltrim(F.left(F.coalesce("credit_who", F.lit("")), F.lit(80)), F.lit("@"))).alias("credit_who"),
        F.when(credit, F.left(F.coalesce("credit_url", F.lit("")), F.lit(300))).alias("credit_url"))


def cite_source(combos: DataFrame) -> DataFrame:
    """Combos of a source as cited records with a timestamped link. ``combos(source, t, steps, creator, title, url)``."""
    from boutline.functions.scalars import slug
    secs = F.floor("t").cast("long")
    stamp = F.format_string("%d:%02d", (secs / 60).cast("long"), secs % 60)
    link = F.when(F.col("url").contains("youtube") & (F.col("t") > 0),
                  F.concat("url", F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("t="), secs.cast("string"), F.lit("s"))).otherwise(F.col("url"))
    who = F.coalesce("creator", "title", F.col("source").cast("string"))
    return combos.select(slug(F.concat_ws("-", F.col("source").cast("string"), secs.cast("string")), "-", 48).alias("id"), "steps",
                         F.left(F.concat(F.coalesce("title", F.col("source").cast("string")), F.lit(" · "), stamp), F.lit(80)).alias("title"),
                         who.alias("author"), link.alias("clip"),
                         F.when(F.col("url").contains("youtube"), "youtube").otherwise("video").alias("platform"))
