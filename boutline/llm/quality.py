"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a Boolean column that is true where a text must go. On a sample (SAMPLE_SHARE of the rows) every rule is run alone:
its selectivity is the share it rejects, its cost the time it takes beyond reading the sample. The rules are then
chained in one CASE by rejection per cost, so that a row stops at the first rule that rejects it and dear rules see few rows.
The order changes which rule is named, never which rows stay."""

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutline.llm.common import staged

SAMPLE_SHARE = 0.01
BLANK = r"[\x20\x09-\x0D]+"
SEEN = r"[^\x20\x09-\x0D]"
WINDOW = 8


def text_of() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def count_chars(text: Column, others: str) -> Column:
    """Code points of ``text`` that the pattern ``others`` does not take away."""
    return F.char_length(F.regexp_replace(text, others, "")).cast("bigint")


def held(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more. Windows are compared by a 64-bit hash; only a text in
    which some hash repeats is looked at closely."""

    def covered(hashes):
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s):
            twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"])))
            start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
            return F.aggregate(F.array_sort(F.transform(twice, lambda x: x["i"])), start,
                               lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(held(ranked, places))

    def of(ws):
        windows = F.transform(F.sequence(F.lit(1), F.size(ws) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(ws, i, WINDOW)))
        return F.when(F.size(ws) <= WINDOW, 0).otherwise(held(windows, covered))

    return held(words, of).cast("bigint")


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and the text of every row."""
    rows = docs.select("doc_id", text_of().alias("text"))
    facts = held(words_of(F.col("text")), lambda ws: F.struct(
        F.size(ws).cast("bigint").alias("n_words"), F.char_length(F.array_join(ws, "")).cast("bigint").alias("word_chars"), repeated_words(ws).alias("n_repeat_words")))
    lines = held(F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(SEEN)), lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint"))
    return rows.select("doc_id", "text", facts.alias("_f"), count_chars(F.col("text"), r"[^#*$%&|<>]+").alias("n_symbols"), lines.alias("n_dup_lines")).select(
        "doc_id", "text", "_f.n_words", "_f.word_chars", "n_symbols", "n_dup_lines", "_f.n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def standard_rules() -> dict[str, Column]:
    """Rules over ``measures``. Thresholds leave room for names, numbers and tables in ordinary prose."""
    return {
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words")),
        "repeated_lines": (F.col("n_dup_lines") >= 3) & (2 * F.col("n_dup_lines") > F.size(F.split(F.col("text"), "\n"))),
        "capitals": 10 * count_chars(F.col("text"), "[^A-Z]+") > 4 * F.col("word_chars"),
        "exclamations": 10 * count_chars(F.col("text"), "[^!?]+") > 4 * F.col("n_words"),
        "few_letters": 10 * F.size(F.filter(words_of(F.col("text")), lambda w: w.rlike(r"\p{L}"))) < 7 * F.col("n_words"),
        "few_distinct_words": held(words_of(F.col("text")), lambda ws: 100 * F.size(F.array_distinct(ws)) < F.least(F.lit(25), 2500 / F.greatest(F.size(ws), F.lit(1))) * F.size(ws)),
    }


def ordered(sample: DataFrame, rules: dict[str, Column]) -> list[str]:
    """Rule names by rejection per cost on the sample, best first. Costs and shares are damped so that an empty sample works."""

    def spent(*aggs):
        start = time.perf_counter()
        row = sample.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
        return time.perf_counter() - start, row

    spent()
    floor, row = spent()
    rates = {}
    for name, rule in rules.items():
        cost, row = spent(F.count_if(F.coalesce(rule, F.lit(False))).alias("hits"))
        rates[name] = (row["hits"] + 1) / (row["n"] + 2) / max(cost - floor, 0.005)
    return sorted(rules, key=lambda name: (-rates[name], name))


def cascade(rows: DataFrame, rules: dict[str, Column], sample: DataFrame | None = None, share: float = SAMPLE_SHARE) -> Column:
    """A column with the name of the first rule that rejects a row, null where none does."""
    if sample is None:
        sample = staged(rows.sample(share, seed=7), "quality-sample")
    out = None
    for name in ordered(sample, rules):
        out = F.when(rules[name], name) if out is None else out.when(rules[name], name)
    return out if out is not None else F.lit(None).cast("string")


def quality(docs: DataFrame, rules: dict[str, Column] | None = None, share: float = SAMPLE_SHARE) -> DataFrame:
    """``doc_id``, the five measures, ``base_failed``, ``kept`` and ``rejected_by`` per row of ``docs``.

    The two base conditions come first since their measures are always returned; only texts that pass them enter the
    cascade. A null text counts as empty and so fails; repeated rows get equal results; an empty table gives none; other columns,
    whatever their names, are not read."""
    rows = measures(docs)
    sample = staged(measures(docs.select("doc_id", "text").sample(share, seed=7)).filter(~base_failed()), "quality-sample")
    failed = base_failed()
    reason = F.when(failed, "base").otherwise(cascade(rows, rules or standard_rules(), sample))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select(*names, failed.alias("base_failed"), reason.alias("rejected_by")).select(*names, "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, all columns as they are. A row travels as one struct beside its measures, so no column
    name of ``docs`` can clash with theirs."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("doc_id"), F.col("text"))
    measured = measures(rows)
    sample = staged(measures(rows.select(F.lit(0).alias("doc_id"), "text").sample(SAMPLE_SHARE, seed=7)).filter(~base_failed()), "quality-sample")
    reason = F.when(base_failed(), "base").otherwise(cascade(measured, standard_rules(), sample))
    return measured.filter(reason.isNull()).select("doc_id.*")
