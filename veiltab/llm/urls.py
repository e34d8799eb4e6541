"""URL filter: allow and block rules, and for the rest word segmentation of host names with naive Bayes.

Host names glue words together. A unigram model, word counts over the visible text of all pages, splits every distinct host
label by Viterbi search. The model is never gathered: each label asks for the counts of its own substrings by a join. A multinomial
naive Bayes over host segments and path tokens learns from the pages that a rule decides and judges the others.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule, and gets the verdict of the class
priors; a longest rule wins, of equally long ones the first given; a score of 0 means allow; without decided pages of both
kinds everything undecided is allowed. A host label longer than 63 characters, which DNS does not allow, is split in pieces of 63
first. Repeated rows are judged each; an empty table gives no rows; columns other than id, url and html are not read.
"""
from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veiltab.llm.common import attach, small_batches, written

#: Host, path, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
LABEL = 63     # longest label that DNS allows
LONGEST = 20   # longest word a segment can be
SMOOTHING = 1.0
_URL = r"(?s)^.*?://([^/?#]*+)([^?#]*+)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url.cast("string"), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(text, _URL, 1), upper, upper.lower()), F.regexp_extract(text, _URL, 2)


def best_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host`` + ``path``, and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # longer ones are asked first: they wrap the rest
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """``word, n`` over the visible text of all pages, lower case."""
    visible = F.lower(F.regexp_replace(F.coalesce(F.col(html).cast("string"), F.lit("")), "<[^>]*+>", " "))
    words = pages.select(F.explode(F.split(visible, r"[^\p{L}]+")).alias("word")).where("word != '' and length(word) <= %d" % LONGEST)
    return words.groupBy("word").agg(F.count("*").alias("n"))


def viterbi(label: str, found: list[tuple[int, str, int]], total: int) -> list[str]:
    """Likeliest split of ``label``; a letter that no known word covers stands alone at a price below any word's."""
    by_start: dict[int, list[tuple[str, float]]] = {}
    for start, word, n in found:
        by_start.setdefault(start, []).append((word, math.log(n / total)))
    unknown = -math.log(max(total, 2)) - 8.0
    best: list[tuple[float, int, bool]] = [(0.0, 0, True)] + [(-math.inf, 0, False)] * len(label)
    for i in range(len(label)):
        score = best[i][0]
        options = [(label[i], unknown, False), *((w, p, True) for w, p in sorted(by_start.get(i, [])))]
        for word, p, known in options:
            if score + p > best[i + len(word)][0]:
                best[i + len(word)] = (score + p, i, known)
    parts, end = [], len(label)
    while end:
        start = best[end][1]
        parts.append(label[start:end])
        end = start
    return parts[::-1]


def segmented(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """``host, segments`` of distinct ``hosts(host)``; ``words`` is a written table of :func:`word_counts`."""
    piece = rf"(?<=\G.{{{LABEL}}})"
    labels = hosts.select("host", F.explode(F.flatten(F.transform(F.split("host", r"[^\p{L}]+"), lambda x: F.split(x, piece)))).alias("label")).where("label != ''").distinct()
    distinct = labels.select("label").distinct()
    starts = distinct.select("label", F.explode(F.sequence(F.lit(0), F.length("label") - 1)).alias("start"))
    longest = F.least(F.length("label") - F.col("start"), F.lit(LONGEST))
    cut = starts.select("label", "start", F.explode(F.sequence(F.lit(1), longest)).alias("size")).select(
        "label", "start", F.substr("label", F.col("start") + 1, F.col("size")).alias("word"))
    used = written(cut.select("word").distinct().join(words, "word"), "label-words")  # only the counts that some label asks for
    total = words.agg(F.sum("n")).first()[0] or 1
    found = attach(cut, used, ["word"], "inner", salt_by=F.col("label")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("start", "word", "n"))).alias("found"))

    @F.pandas_udf("array<string>")
    def split(label: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([viterbi(x, [] if f is None else [(r["start"], r["word"], r["n"]) for r in f], total) for x, f in zip(label, found)], dtype=object)

    parts = distinct.join(found, "label", "left").select("label", split("label", "found").alias("parts"))
    return labels.join(parts, "label").groupBy("host").agg(F.flatten(F.array_sort(F.collect_list("parts"))).alias("segments"))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: ``page_id, host, path, rule, verdict, score`` (above 0: rather allow)."""
    pages = small_batches(pages)
    host, path = host_and_path(F.col(url))
    split = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, decided = best_rule(F.col("host"), F.col("path"), rules)
    urls = written(split.select(F.monotonically_increasing_id().alias("row"), "page_id", "host", "path", rule.alias("rule"), decided.alias("decided")), "urls")
    words = written(word_counts(pages, html), "words")
    hosts = written(segmented(urls.select("host").distinct(), words), "hosts")

    path_tokens = F.filter(F.split(F.regexp_replace(F.lower("path"), "[0-9]+", "/#/"), r"[^\p{L}#]+"), lambda x: x != "")
    tokens = F.concat(F.transform(F.coalesce("segments", F.array().cast("array<string>")), lambda x: F.concat(F.lit("h:"), x)), F.transform(path_tokens, lambda x: F.concat(F.lit("p:"), x)))
    listed = attach(urls, hosts, ["host"], "left", salt_by=F.col("row")).select("row", "decided", F.explode(tokens).alias("token"))
    counted = written(listed.where("decided is not null").groupBy("token").agg(F.count_if(F.col("decided") == "allow").alias("a"), F.count_if(F.col("decided") == "block").alias("b")), "token-counts")
    sums = counted.agg(F.count("*").alias("v"), F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    docs = {r.decided: r["count"] for r in urls.where("decided is not null").groupBy("decided").count().collect()}
    if len(docs) < 2:
        return urls.select("page_id", "host", "path", "rule", F.coalesce("decided", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    side = lambda c, n: F.log((F.col(c) + SMOOTHING) / ((n or 0) + SMOOTHING * sums.v))
    weights = written(counted.select("token", F.round(side("a", sums.a) - side("b", sums.b), 9).cast("decimal(20,9)").alias("w")), "weights")
    prior = round(math.log(docs["allow"] / docs["block"]), 9)
    scores = attach(listed.where("decided is null"), weights, ["token"], "inner", salt_by=F.col("row")).groupBy("row").agg(F.sum("w").alias("w"))
    score = F.coalesce(F.col("w").cast("double"), F.lit(0.0)) + F.lit(prior)
    judged = urls.join(scores, "row", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("decided", F.when(score >= 0, "allow").otherwise("block")).alias("verdict"),
                         F.when(F.col("decided").isNull(), score).alias("score"))
