import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from llm_fixtures import documents, empty, rows, words
from veiltab.llm import rules
from veiltab.llm.q_rules import op13_rule_cascade

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    found, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(found[i:i + 3]) for i in range(len(found) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def rejecting(text):
    n, chars, symbols, dup, repeat = counts(text)
    found, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    bare = sum(not any(c.isalpha() for c in w) for w in found)
    tests = {"few_words": n < 50, "repeated_words": 100 * repeat > 50 * n, "symbols": 10 * symbols > n, "word_length": chars < 3 * n or chars > 10 * n, "bare_words": 5 * bare > n,
             "capitals": 10 * sum("A" <= c <= "Z" for c in text) > 3 * chars, "duplicate_lines": 2 * dup > len(lines),
             "bullets": 100 * sum(x.lstrip(" ")[:1] in ("-", "*", "•") for x in lines) > 90 * len(lines),
             "ellipses": 100 * sum(x.rstrip(" ").endswith(("...", "…")) for x in lines) > 30 * len(lines)}
    return {name for name, hit in tests.items() if hit}


PROSE = words(80, 5)
TEXTS = [PROSE, PROSE + " " + PROSE, "\n".join([PROSE] * 2 + [words(70, 6)]), "\n".join(["one two three four"] * 30), "| " * 60 + PROSE, PROSE.upper(), "12 34 5,6 " * 10 + words(40, 7),
         "\n".join("- " + words(6, i) for i in range(20)), "\n".join(words(6, i) + "... " for i in range(20)), "a b c a b c a", "a a a a", "a b", "x" * 3000, "", "  \t\n", "é ü 漢 🙂 " * 30,
         words(9000, 8) + " " + words(30, 9) + " z " + words(30, 9), "ab " * 60, "-\n" * 80, "9" * 200_000]


def test_counts_and_verdicts(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    text = F.col("_text")
    got = {r["doc_id"]: r for r in rules.judge(docs).select(
        "row.doc_id", "n_words", rules.word_chars(text).alias("c"), rules.n_symbols(text).alias("s"), rules.n_dup_lines(text).alias("d"), rules.n_repeat_words(text).alias("r"), "failed_rule", "kept").collect()}
    for k, t in enumerate(TEXTS):
        assert (got[k]["n_words"], got[k]["c"], got[k]["s"], got[k]["d"], got[k]["r"]) == counts(t), t[:50]
        assert got[k]["kept"] == (not rejecting(t)), (t[:50], got[k], rejecting(t))
        assert got[k]["failed_rule"] is None if got[k]["kept"] else got[k]["failed_rule"] in rejecting(t)
    assert {r.name for r in rules.RULES} == set().union(*map(rejecting, TEXTS))


def test_hashes_that_collide_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(F, "shiftright", lambda c, n: F.lit(7).cast("long"))  # every window has the same hash
    docs = spark.createDataFrame([(t,) for t in TEXTS[:4] + ["a b c d e f a b c", "a b c d"]], "t string")
    assert [r[0] for r in docs.select(rules.n_repeat_words(F.col("t"))).collect()] == [counts(r.t)[4] for r in docs.collect()]


def test_order_is_by_rejections_per_second():
    # the first rule rejects 6 in 1 s; the second 9 in 3 s; the third rejects only what the first does
    seen = {0b101: 5, 0b001: 1, 0b010: 9, 0: 4}
    assert rules.cheapest_order([1.0, 3.0, 0.9], seen) == [0, 1, 2]
    assert rules.cheapest_order([1.0, 3.0, 0.5], seen) == [2, 1, 0]
    assert rules.cheapest_order([1.0, 1.0], {}) == [0, 1]


def test_cascade_stops_at_the_first_rejection(spark):
    boom = rules.Rule("boom", lambda t, n: F.raise_error(F.lit("evaluated")).isNull())
    df = spark.createDataFrame([("short",)], "_text string").withColumn("_n", rules.n_words(F.col("_text")))
    assert df.select(rules.cascade(F.col("_text"), F.col("_n"), [rules.BASE[0], boom])).first()[0] == "few_words"
    with pytest.raises(Exception, match="evaluated"):
        df.select(rules.cascade(F.col("_text"), F.col("_n"), [boom, rules.BASE[0]])).first()


def test_awkward_tables(spark):
    assert rules.judge(empty(spark)).collect() == [] and rules.keep_good(empty(spark)).columns == empty(spark).columns
    kept = rules.keep_good(documents(spark))
    assert kept.columns == documents(spark).columns
    want = sorted((r for r in rows() if not rejecting(r[1] or "")), key=repr)
    assert sorted(map(tuple, kept.collect()), key=repr) == want


def test_query_on_awkward_rows(spark, tmp_path):
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op13_rule_cascade(spark, str(tmp_path)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()), key=repr)
    want = []
    for r in rows():
        bad = rejecting(r[1] or "")
        want.append((r[0], *counts(r[1] or ""), bool(bad & {"few_words", "repeated_words"}), not bad))
    assert got == sorted(want, key=repr)
