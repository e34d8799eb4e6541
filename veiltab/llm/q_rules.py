"""Query on quality rules."""
from pyspark.sql import functions as F

from veiltab.llm.rules import BASE, LEAST_WORDS, REPEAT_PERCENT, RULES, judge, n_dup_lines, n_repeat_words, n_symbols, word_chars


def op13_rule_cascade(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    judged = judge(docs, [r for r in RULES if r not in BASE])  # the base rules need counts that every row returns
    text = F.col("_text")
    counted = judged.select("row.doc_id", "n_words", word_chars(text).alias("word_chars"), n_symbols(text).alias("n_symbols"), n_dup_lines(text).alias("n_dup_lines"),
                            n_repeat_words(text).alias("n_repeat_words"), "kept")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.col("kept"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
      row_number() OVER () AS k FROM d),
g AS (SELECT k, i, list_aggregate(ws[i:i + 2], 'string_agg', ' ') AS win FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
c AS (SELECT k, i, count(*) OVER (PARTITION BY k, win) AS m FROM g),
p AS (SELECT k, count(DISTINCT i + j) AS n_repeat_words FROM c, unnest([0, 1, 2]) AS v(j) WHERE m > 1 GROUP BY k),
b AS (SELECT w.doc_id, t, ls, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(p.n_repeat_words, 0) AS n_repeat_words,
      len(list_filter(ws, lambda x: NOT regexp_matches(x, '\p{L}'))) AS bare, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS capitals,
      len(list_filter(ls, lambda x: left(ltrim(x, ' '), 1) IN ('-', '*', chr(8226)))) AS bullets,
      len(list_filter(ls, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%' || chr(8230))) AS ellipses
      FROM w LEFT JOIN p ON w.k = p.k),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 5 * bare > n_words OR 10 * capitals > 3 * word_chars
            OR 2 * n_dup_lines > len(ls) OR 100 * bullets > 90 * len(ls) OR 100 * ellipses > 30 * len(ls)) AS kept FROM f
"""
QUERIES = {"op13_rule_cascade": (op13_rule_cascade, OP13_SQL)}
