"""Scalar column functions: time, identifiers, names, numbers and small rules."""

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_STARTUP = 12  # frames assumed for a move whose startup did not resolve


def ms_to_frames(ms: Column, fps: int = 60) -> Column:
    """Milliseconds to whole frames, halves to even."""
    return F.rint(ms / F.lit(1000.0 / fps)).cast("long")


def content_id(content: Column, prefix: str = "bh_") -> Column:
    """Identity of a file's bytes."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(content, 256), 1, 16))


def moment_id(match_id: Column, slot: Column, frame: Column, kind: Column) -> Column:
    """Stable id of a moment; an unknown slot prints as None."""
    text = F.concat_ws("|", match_id.cast("string"), F.coalesce(slot.cast("string"), F.lit("None")),
                       frame.cast("string"), kind)
    return F.concat(F.lit("m_"), F.substring(F.sha1(text), 1, 12))


def patch_of(file_name: Column) -> Column:
    """The bracketed version in a file name, NULL when there is none."""
    return F.nullif(F.regexp_extract(file_name, r"\[([\d.]+)\]", 1), F.lit(""))


def stage_of(file_name: Column) -> Column:
    """Stage in a file name: version, copy number and extension dropped, camel case split."""
    bare = F.regexp_replace(F.regexp_replace(file_name, r"\[[\d.]+\]", ""), r"\.[A-Za-z]+$", "")
    bare = F.btrim(F.regexp_replace(bare, r"\(\d+\)", ""))
    return F.nullif(F.regexp_replace(bare, r"([a-z])([A-Z])", "$1 $2"), F.lit(""))


def player_label(name: Column, slot: Column) -> Column:
    return F.coalesce(name, F.concat(F.lit("slot "), slot.cast("string")))


def slug(text: Column, joiner: str = "-", cap: int = 40) -> Column:
    """Lower case, runs of anything but letters and digits to one joiner, trimmed, capped in length."""
    joined = F.regexp_replace(F.lower(text), "[^a-z0-9]+", joiner)
    return F.substring(F.btrim(joined, F.lit(joiner)), 1, cap)


def clock_seconds(text: Column) -> Column:
    """``h:m:s,ms`` or shorter to seconds; NULL unless every part is a number."""
    parts = F.transform(F.split(F.replace(F.btrim(text), F.lit(","), F.lit(".")), ":"),
                        lambda p: p.try_cast("double"))
    return F.when(F.exists(parts, lambda p: p.isNull()), None).otherwise(
        F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60 + p))


def clock_text(seconds: Column) -> Column:
    """Seconds as m:ss; the seconds part is rounded on its own and may print 60."""
    return F.format_string("%d:%02d", F.floor(seconds / 60).cast("long"),
                           F.rint(seconds - F.floor(seconds / 60) * 60).cast("long"))


def number_or_null(text: Column) -> Column:
    return F.btrim(text).try_cast("int")


def panel_value(text: Column, signed: bool = False) -> Column:
    """Leading integer of a panel field such as ``-46(-1)``; a negative one only where the field is signed."""
    value = F.nullif(F.regexp_extract(F.btrim(text), r"^(-?\d+)", 1), F.lit("")).try_cast("int")
    return value if signed else F.when(value >= 0, value)


def plausible_name(name: Column) -> Column:
    """Three to twenty name characters with a letter, and not a playlist label."""
    return (name.rlike(r"^[A-Za-z0-9 _\-.]{3,20}$") & name.rlike("[A-Za-z]") & ~name.startswith("Playlist"))


def status_url(url: Column) -> Column:
    """A post address with host aliases unified and the query dropped."""
    host = F.regexp_replace(F.btrim(url), r"^https?://(www\.)?(x\.com|mobile\.twitter\.com)/", "https://twitter.com/")
    return F.split_part(host, F.lit("?"), F.lit(1))


def is_status_url(url: Column) -> Column:
    return url.rlike(r"^https://twitter\.com/[^/]+/status/\d+")


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://(?:www\.)?([^/?#]+)", 1)


def level_of(xp: Column) -> tuple[Column, Column]:
    """Level and progress into it, 100 points each."""
    return (xp.cast("long") / 100).cast("long") + 1, F.pmod(xp, F.lit(100))


# fixed values: tags a take may carry
VERDICT_TAGS = ("real", "lag", "defend", "spacing", "misread", "unsure")


def verdict(given: Column, tags: Column, take: Column) -> Column:
    """Explicit verdict, else what the tags imply, else ``actually`` when anything was said."""
    kept = clean_tags(tags)
    return F.coalesce(
        given,
        F.when(F.array_contains(kept, "real"), "right")
        .when(F.array_contains(kept, "lag") | F.array_contains(kept, "misread"), "wrong")
        .when((F.size(kept) > 0) | (F.length(F.btrim(F.coalesce(take, F.lit("")))) > 0), "actually"))


def clean_tags(tags: Column, limit: int = 6) -> Column:
    """Known tags in the order given, at most ``limit``."""
    known = F.array(*[F.lit(t) for t in VERDICT_TAGS])
    return F.slice(F.filter(tags, lambda x: F.array_contains(known, x)), 1, limit)


def verdict_caption(pct: Column, choice: Column, ev: Column, best: Column, best_ev: Column) -> Column:
    """One line for a reviewed exchange; the gap only when it matters, unknown numbers as ``?``."""
    def signed(x):
        cents = F.rint(x * 100).cast("long")
        text = F.concat(F.when(cents < 0, "-").otherwise("+"), F.expr("''"),
                        F.floor(F.abs(cents) / 100).cast("string"), F.lit("."),
                        F.lpad((F.abs(cents) % 100).cast("string"), 2, "0"))
        return F.coalesce(text, F.lit("?"))
    shown = F.coalesce(F.concat(F.rint(pct * 100).cast("long").cast("string"), F.lit("%")), F.lit("?"))
    gap = F.when(best_ev - ev > 0.02, F.concat(F.lit("-> "), best, F.lit(" "), signed(best_ev)))
    return F.concat_ws("  ", F.concat(F.lit("you "), shown), choice, signed(ev), gap)


def cost_rule(kind: Column, motion: Column) -> Column:
    """Meter a move spends."""
    return (F.when(kind == "tokon", 150).when((kind == "super") & motion.contains("632146"), 100)
            .when(kind == "super", 50).otherwise(0))
