"""Quality rules as a short-circuit cascade, in DataFrame operations only.

A rule is a condition that rejects a text. :func:`measure` runs every rule over a sample: one job gives how often each
combination of rules rejects, and one timed job a rule gives what the rule costs. :func:`cheapest_order` puts first the
rule that rejects most per second, then the one that rejects most per second of what that one lets through, and so on,
so rules that reject the same texts do not stand side by side. The cascade is one CASE expression in that order: a text
that a rule rejects meets no later rule. A text is kept if no rule rejects it, so the verdict does not depend on the
order, the sample or the clock; only the time and ``failed_rule`` (the first rule that rejected) do.

Defined results: a null text is an empty text; a text without words fails ``few_words``; ties in rejections per
second go by the order of the given rules; repeated rows are judged one by one; an empty table gives no rows (its rules
stay in the given order). Whole texts are read. The caller's columns come back untouched inside the struct ``row``.
"""
from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veiltab.llm.common import text_of, written

SAMPLE_ROWS = 2000   # rows that costs and rejections are estimated on
TIMED_RUNS = 2       # each rule is timed so often; the shortest time counts
LEAST_COST = 1e-4    # seconds below which a difference of two times is noise
# The character classes of the base counts and the limits of the rules.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
BARE_WORD = rf"(?<![^{SPACE}])[^{SPACE}\p{{L}}]++(?![^{SPACE}])"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_WORDS = 50
REPEAT_PERCENT = 50


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` applied to ``value``, which is evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _without(text: Column, characters: str) -> Column:
    return F.char_length(F.translate(text, characters, ""))


def word_chars(text: Column) -> Column:
    return _without(text, BLANKS).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.char_length(text) - _without(text, SYMBOLS)).cast("long")


def lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")


def n_dup_lines(text: Column) -> Column:
    return _bind(lines(text), lambda found: (F.size(found) - F.size(F.array_distinct(found))).cast("long"))


def n_repeat_words(text: Column, window: int = 3) -> Column:
    """Words covered by windows of consecutive words that the text holds more than once.

    Windows are sorted as one number each, hash and place together: its hash part alike marks candidates, whose words are
    then compared. Only where different words share a hash part are the windows themselves sorted.
    """
    words = F.filter(F.split(text, rf"[{SPACE}]+"), lambda x: x != "")

    def counted(found: Column, n: Column) -> Column:
        first = F.slice(found, 1, n)
        hashes = F.transform(first, lambda x, i: F.shiftright(F.xxhash64(x, *[F.get(found, i + k) for k in range(1, window)]), 1))
        numbers = F.transform(hashes, lambda x, i: x - F.pmod(x, n) + i)
        part, at = lambda x: x - F.pmod(x, n), lambda x: F.pmod(x, n).cast("int")
        words_at = lambda p: F.concat_ws(" ", *[F.get(found, p + k) for k in range(window)])

        def alike(ordered: Column, key) -> Column:
            return F.filter(ordered, lambda x, i: (key(F.get(ordered, i - 1)) == key(x)) | (key(F.get(ordered, i + 1)) == key(x)))

        def places(hits: Column) -> Column:
            differ = F.filter(hits, lambda x, i: (part(F.get(hits, i - 1)) == part(x)) & (words_at(at(F.get(hits, i - 1))) != words_at(at(x))))
            spelled = F.sort_array(F.transform(hits, lambda x: F.struct(words_at(at(x)).alias("w"), at(x).alias("at"))))
            exact = _bind(spelled, lambda o: F.transform(alike(o, lambda x: x["w"]), lambda x: x["at"]))
            return F.sort_array(F.when(F.size(differ) == 0, F.transform(hits, at)).otherwise(exact))

        return _bind(F.sort_array(numbers), lambda o: _bind(alike(o, part), lambda hits: F.when(F.size(hits) > 0, _bind(places(hits), covered)).otherwise(F.lit(0).cast("long"))))

    def covered(starts: Column) -> Column:
        reach = F.transform(starts, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(starts, i + 1) - x, F.lit(window))))
        return F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)

    return _bind(words, lambda found: _bind(F.greatest(F.size(found) - (window - 1), F.lit(0)), lambda n: counted(found, n)))


@dataclass(frozen=True)
class Rule:
    """``rejects(text, n_words)`` is true for a text that the rule rejects; it is never null."""
    name: str
    rejects: Callable[[Column, Column], Column]


def _share_of_lines(text: Column, holds: Callable[[Column], Column], percent: int) -> Column:
    return _bind(lines(text), lambda found: 100 * F.size(F.filter(found, holds)) > percent * F.size(found))


def _length_is_odd(text: Column, n: Column) -> Column:
    return _bind(word_chars(text), lambda chars: (chars < 3 * n) | (chars > 10 * n))


#: The base rules, which the contract of the counts fixes.
BASE = [Rule("few_words", lambda t, n: n < LEAST_WORDS),
        Rule("repeated_words", lambda t, n: 100 * n_repeat_words(t) > REPEAT_PERCENT * n)]
#: Rules of well-formed prose: limits as in published filters of web text, duplicate lines at one half.
RULES = [
    *BASE,
    Rule("symbols", lambda t, n: 10 * n_symbols(t) > n),
    Rule("word_length", _length_is_odd),
    Rule("bare_words", lambda t, n: 5 * F.regexp_count(t, F.lit(BARE_WORD)) > n),
    Rule("capitals", lambda t, n: 10 * (F.char_length(t) - _without(t, CAPITALS)) > 3 * word_chars(t)),
    Rule("duplicate_lines", lambda t, n: _bind(lines(t), lambda found: 2 * (F.size(found) - F.size(F.array_distinct(found))) > F.size(found))),
    Rule("bullets", lambda t, n: _share_of_lines(t, lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•"), 90)),
    Rule("ellipses", lambda t, n: _share_of_lines(t, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"), 30)),
]


def measure(texts: DataFrame, rules: list[Rule], rows: int = SAMPLE_ROWS) -> tuple[list[float], dict[int, int]]:
    """Seconds of each rule, and how many sampled texts each combination of rules (as bits) rejects.

    ``texts(_text, _n)`` is sampled by position, not by a key, so a repeated id cannot fill the sample.
    """
    total = texts.count()
    if not total:
        return [LEAST_COST] * len(rules), {}
    sample = written(texts.sample(False, min(1.0, rows / total), 7).coalesce(texts.sparkSession.sparkContext.defaultParallelism), "rule-sample")
    bits = sum((F.when(r.rejects(F.col("_text"), F.col("_n")), 1 << k).otherwise(0) for k, r in enumerate(rules)), F.lit(0))
    seen = {r["_bits"]: r["count"] for r in sample.select(bits.alias("_bits")).groupBy("_bits").count().collect()}  # at most `rows` rows

    def seconds(rejects: Column) -> float:
        job, best = sample.agg(F.count_if(rejects), F.sum(F.octet_length("_text"))), float("inf")
        for _ in range(TIMED_RUNS):
            start = time.perf_counter()
            job.first()
            best = min(best, time.perf_counter() - start)
        return best

    idle = seconds(F.lit(False))
    return [max(LEAST_COST, seconds(r.rejects(F.col("_text"), F.col("_n"))) - idle) for r in rules], seen


def cheapest_order(costs: list[float], seen: dict[int, int]) -> list[int]:
    """Numbers of the rules: each time the most rejections per second among texts that the earlier ones let through."""
    left, order = dict(seen), []
    while len(order) < len(costs):
        rest = [k for k in range(len(costs)) if k not in order]
        rejected = {k: sum(n for bits, n in left.items() if bits >> k & 1) for k in rest}
        best = max(rest, key=lambda k: (rejected[k] / costs[k], -costs[k], -k))
        order.append(best)
        left = {bits: n for bits, n in left.items() if not bits >> best & 1}
    return order


def cascade(text: Column, n: Column, rules: list[Rule]) -> Column:
    """Name of the first of ``rules`` that rejects the text; null where none does."""
    first, *rest = rules
    found = F.when(first.rejects(text, n), F.lit(first.name))
    for r in rest:
        found = found.when(r.rejects(text, n), F.lit(r.name))
    return found


def judge(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """Every row of ``docs`` as struct ``row``, with ``_text``, ``n_words``, ``failed_rule`` (null: kept) and ``kept``."""
    prepared = docs.select(F.struct("*").alias("row"), text_of(text).alias("_text")).withColumn("_n", n_words(F.col("_text")))
    costs, seen = measure(prepared.select("_text", "_n"), rules)
    ordered = [rules[k] for k in cheapest_order(costs, seen)]
    judged = prepared.withColumn("failed_rule", cascade(F.col("_text"), F.col("_n"), ordered))
    return judged.select("row", "_text", F.col("_n").alias("n_words"), "failed_rule", F.col("failed_rule").isNull().alias("kept"))


def keep_good(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects."""
    return judge(docs, rules, text).where("kept").select("row.*")
