"""Quality rules as a short-circuit cascade. Native columns only.

Each rule says when it rejects a text. On a bounded sample the operator measures what every rule
costs and how much it rejects, and tests the rules in order of rejection per cost; later rules are
not worked out for texts that an earlier one has rejected. The order changes the work, never the
verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordflow.functions.text import bind
from recordflow.llm.common import SPACE_CLASS, is_empty, stored, unused, whole

# The characters counted as symbols.
SYMBOLS = "[#*$%&|<>]"

#: Rows the rules are measured on, and how often each is gone through.
SAMPLE_ROWS, SAMPLE_TIMES = 400, 4

#: A rule: (text, its words) -> true where the text is rejected.
Rule = Callable[[Column, Column], Column]


def words(text: Column) -> Column:
    """The words of a text: runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, f"[{SPACE_CLASS}]+"), "")


def word_chars(text: Column) -> Column:
    """Characters in words."""
    return F.length(F.regexp_replace(text, f"[{SPACE_CLASS}]+", "")).cast("bigint")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint")


def _lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    return bind(_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))


def n_repeat_words(w: Column) -> Column:
    """Words that lie in a window of three words found twice or more, the first one included.

    Windows are sorted by their hash, so equal ones are neighbours; then the union of the places
    they cover is added up. Time is n log n in the words, memory is one pair per word.
    """
    windows = F.when(F.size(w) > 2, F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"),
                           i.alias("i")))).otherwise(
        F.array().cast("array<struct<h:bigint,i:int>>"))

    def same(s: Column, x: Column, j: Column) -> Column:
        return F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(
            F.get(s, j + 1)["h"] == x["h"], F.lit(False))

    def places(s: Column) -> Column:
        return F.sort_array(F.transform(F.filter(s, lambda x, j: same(s, x, j)), lambda x: x["i"]))

    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
    return bind(F.sort_array(windows), lambda s: F.aggregate(
        places(s), start,
        lambda acc, p: F.struct(p.alias("last"),
                                (acc["n"] + F.least(p - acc["last"], F.lit(3))).alias("n")),
        lambda acc: acc["n"]))


def base_fails(n_words: Column, repeat_words: Column) -> Column:
    """Under 50 words, or over half of the words in repeated windows."""
    return (n_words < 50) | (100 * repeat_words > 50 * n_words)


#: Production rules; every one is false for what it cannot judge.
RULES: dict[str, Rule] = {
    "few_words": lambda t, w: F.size(w) < 50,
    "repeated_words": lambda t, w: 100 * n_repeat_words(w) > 50 * F.size(w),
    "word_length": lambda t, w: (word_chars(t) < 3 * F.size(w)) | (word_chars(t) > 12 * F.size(w)),
    "symbols": lambda t, w: 10 * n_symbols(t) > F.size(w),
    "repeated_lines": lambda t, w: bind(_lines(t), lambda x: (
        10 * F.size(F.array_distinct(x)) < 6 * F.size(x))),
    "letters": lambda t, w: 10 * F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))) < 7 * F.size(w),
}


def _rejects(rule: Rule, text: Column) -> Column:
    return bind(words(text), lambda w: rule(text, w))


def _seconds(df: DataFrame, c: Column) -> float:
    start = time.perf_counter()
    df.select(c.alias("x")).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def measure(docs: DataFrame, rules: dict[str, Rule], text: str = "text",
            rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(name, seconds, share rejected) of each rule on at most ``rows`` texts picked by hash.

    Empty without rows. Seconds are those beyond splitting the sample into words, the better of
    two runs.
    """
    sample = stored(docs.select(whole(text).alias("text"))
                    .where(F.pmod(F.xxhash64("text"), F.lit(8)) == 3).limit(rows), "quality-sample")
    if is_empty(sample):
        return []
    often = sample.withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(SAMPLE_TIMES))))
    t = F.col("text")
    base = min(_seconds(often, F.size(words(t))) for _ in range(2))
    shares = sample.agg(*[
        F.avg(_rejects(r, t).cast("double")).alias(n)
        for n, r in rules.items()]).first()
    cost = {n: max(1e-4, min(_seconds(often, _rejects(r, t)) for _ in range(2)) - base) for n, r in rules.items()}
    return [(n, cost[n], shares[n] or 0.0) for n in rules]


def order(measured: list[tuple[str, float, float]]) -> list[str]:
    """Rule names by rejection per cost; those that reject nothing last, the cheapest first."""
    return [n for n, _, _ in sorted(measured, key=lambda m: (-m[2] / m[1], m[1], m[0]))]


def rejected_by(docs: DataFrame, rules: dict[str, Rule] | None = None,
                text: str = "text") -> Column:
    """The name of a rule that rejects the text, NULL where none does.

    The rules are put in order by measuring them on ``docs`` (no order is needed where it is
    empty). NULL texts are judged as ''. A rule that is NULL for a text does not reject it. Which
    of several rejecting rules is named depends on the order; whether one is, does not.
    """
    rules = RULES if rules is None else rules
    names = order(measure(docs, rules, text)) or list(rules)

    def cascade(w: Column) -> Column:
        out = F.when(rules[names[0]](whole(text), w), F.lit(names[0]))
        for n in names[1:]:
            out = out.when(rules[n](whole(text), w), F.lit(n))
        return out.otherwise(F.lit(None).cast("string"))

    return bind(words(whole(text)), cascade)


def keep(docs: DataFrame, rules: dict[str, Rule] | None = None, text: str = "text") -> DataFrame:
    """The rows no rule rejects, with the columns of ``docs``. Rows are judged one by one, so
    repeated rows and ties share a verdict."""
    return docs.where(rejected_by(docs, rules, text).isNull())


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and
    kept. The counts are those of the whole text, zero where it is NULL or empty; columns with
    these names are replaced. Texts that fail the base rules are not put to the others."""
    t = whole(text)
    stats = bind(words(t), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"), n_repeat_words(w).alias("n_repeat_words")))
    others = {n: r for n, r in RULES.items() if n not in ("few_words", "repeated_words")}
    verdict = rejected_by(docs, others, text)
    # The struct has two consumers below, and one of them decides about the cascade.
    judged = bind(stats, lambda s: F.struct(
        s.alias("s"), base_fails(s["n_words"], s["n_repeat_words"]).alias("base_failed")))
    held, = unused(docs, "quality")
    q = F.col(held)
    out = docs.withColumn(held, bind(judged, lambda j: F.struct(
        j["s"].alias("s"), j["base_failed"].alias("base_failed"),
        F.when(j["base_failed"], F.lit(False)).otherwise(verdict.isNull()).alias("kept"))))
    return (out.withColumn("n_words", q["s"]["n_words"])
            .withColumn("word_chars", word_chars(t))
            .withColumn("n_symbols", n_symbols(t))
            .withColumn("n_dup_lines", n_dup_lines(t))
            .withColumn("n_repeat_words", q["s"]["n_repeat_words"])
            .withColumn("base_failed", q["base_failed"])
            .withColumn("kept", q["kept"])
            .drop(held))
