"""Descriptive statistics over the subject view, lineitem and labels."""
from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from veiltab.catalog.registry import query, rounded
from veiltab.functions import clean
from veiltab.functions.hashing import integer_between, uniform
from veiltab.operators import profile as P
from veiltab.plans.views import (AGE_EDGES, AGE_GROUP_SQL, AGE_LABELS, FLAGS, NUMERIC, REGIONS,
                                 SEGMENTS, int_sql, subject, table, u_sql, with_sql)

INF = float("inf")
LEVELS = {"segment": SEGMENTS + ["OTHER"], "region": REGIONS, "age_group": AGE_LABELS,
          **{f: ["0", "1"] for f in FLAGS}}
GROUPED_SQL = f"grouped AS (SELECT *, {AGE_GROUP_SQL} AS age_group FROM subject)"


def grouped(spark, sf):
    return subject(spark, sf).withColumn(
        "age_group", clean.bin_label("age", AGE_EDGES + [INF], AGE_LABELS))


def long_sql(cols, source="subject", ids=(), name="long", col="column"):
    parts = [*ids, *[f"CAST({c} AS DOUBLE) AS {c}" for c in cols]]
    return (f"{name} AS (SELECT * FROM (UNPIVOT (SELECT {', '.join(parts)} FROM {source}) "
            f"ON {', '.join(cols)} INTO NAME \"{col}\" VALUE value))")


def grid_sql(levels, name="grid", col="column"):
    vals = ", ".join(f"('{c}','{v}')" for c, vs in levels.items() for v in vs)
    return f"{name}(\"{col}\", level) AS (VALUES {vals})"


RANGES_SQL = 'rng AS (SELECT "column", min(value) AS lo, max(value) AS hi FROM long GROUP BY 1)'
SCALED_SQL = ("scaled AS (SELECT long.*, CASE WHEN hi=lo THEN 0.0 ELSE (value-lo)/(hi-lo) END AS x "
              "FROM long JOIN rng USING (\"column\"))")
STATS_SQL = ("round(avg(x),9) AS mean, round(CASE WHEN count(x)>1 THEN stddev_samp(x) END,9) AS std, "
             "round(quantile_cont(x,0.25),9) AS p25, round(quantile_cont(x,0.5),9) AS p50, "
             "round(quantile_cont(x,0.75),9) AS p75")


@query("describe_scaled", with_sql(
    f'SELECT "column", {STATS_SQL} FROM scaled GROUP BY 1', long_sql(NUMERIC), RANGES_SQL, SCALED_SQL))
def _(spark, sf):
    return rounded(P.describe_scaled(subject(spark, sf), NUMERIC), 9)


@query("category_ratio", with_sql(f"""
SELECT grid."column", grid.level, coalesce(n,0)::BIGINT AS n,
  round(coalesce(n,0)/(SELECT count(*) FROM grouped)::DOUBLE,6) AS ratio
FROM grid LEFT JOIN (SELECT "column", level, count(*) AS n FROM
  (UNPIVOT (SELECT {', '.join(f'{c}::VARCHAR AS {c}' for c in LEVELS)} FROM grouped)
   ON {', '.join(LEVELS)} INTO NAME "column" VALUE level) GROUP BY 1,2) s
 ON grid."column"=s."column" AND grid.level=s.level""", GROUPED_SQL, grid_sql(LEVELS)))
def _(spark, sf):
    return rounded(P.category_ratio(grouped(spark, sf), LEVELS))


@query("crosstab_ratio", with_sql("\nUNION ALL\n".join(f"""
SELECT '{a}' AS col_a, '{b}' AS col_b, ga.level AS level_a, gb.level AS level_b,
  coalesce(n,0)::BIGINT AS n, round(coalesce(n,0)/(SELECT count(*) FROM grouped)::DOUBLE,6) AS ratio
FROM (SELECT level FROM grid WHERE "column"='{a}') ga, (SELECT level FROM grid WHERE "column"='{b}') gb
LEFT JOIN (SELECT {a}::VARCHAR AS x, {b}::VARCHAR AS y, count(*) AS n FROM grouped GROUP BY 1,2) s
  ON s.x=ga.level AND s.y=gb.level""" for a, b in combinations(LEVELS, 2)),
    GROUPED_SQL, grid_sql(LEVELS)))
def _(spark, sf):
    return rounded(P.crosstab_ratio(grouped(spark, sf), LEVELS))


LINE_LEVELS = {"l_returnflag": ["A", "N", "R"], "l_linestatus": ["F", "O"],
               "l_linenumber": ["1", "2", "3", "4", "5", "6", "7"]}


@query("crosstab_ratio_lineitem", "WITH " + grid_sql(LINE_LEVELS) + "\nUNION ALL\n".join(f"""
SELECT '{a}' AS col_a, '{b}' AS col_b, ga.level AS level_a, gb.level AS level_b,
  coalesce(n,0)::BIGINT AS n, round(coalesce(n,0)/(SELECT count(*) FROM lineitem)::DOUBLE,6) AS ratio
FROM (SELECT level FROM grid WHERE "column"='{a}') ga, (SELECT level FROM grid WHERE "column"='{b}') gb
LEFT JOIN (SELECT {a}::VARCHAR AS x, {b}::VARCHAR AS y, count(*) AS n FROM lineitem GROUP BY 1,2) s
  ON s.x=ga.level AND s.y=gb.level""" for a, b in combinations(LINE_LEVELS, 2)))
def _(spark, sf):
    return rounded(P.crosstab_ratio(table(spark, sf, "lineitem"), LINE_LEVELS))


GD_LEVELS = {c: LEVELS[c] for c in ("segment", "age_group", "urgent_flag")}
GD_COLS = ["n_orders", "n_items", "avg_price", "balance"]


@query("group_describe", with_sql(f"""
SELECT grid.cat, grid.level, c."column", s.mean, s.std, s.p25, s.p50, s.p75
FROM grid CROSS JOIN (VALUES {', '.join(f"('{c}')" for c in GD_COLS)}) c("column")
LEFT JOIN (SELECT cat, level, "column", {STATS_SQL} FROM (
{' UNION ALL '.join(f"SELECT '{k}' AS cat, {k}::VARCHAR AS level, {chr(34)}column{chr(34)}, x FROM scaled" for k in GD_LEVELS)}
) z WHERE level IS NOT NULL GROUP BY 1,2,3) s
 ON s.cat=grid.cat AND s.level=grid.level AND s."column"=c."column\"""",
    GROUPED_SQL, long_sql(GD_COLS, "grouped", list(GD_LEVELS)), RANGES_SQL, SCALED_SQL,
    grid_sql(GD_LEVELS, col="cat")))
def _(spark, sf):
    return rounded(P.group_describe(grouped(spark, sf), GD_LEVELS, GD_COLS), 9)


@query("pearson_matrix", with_sql("\nUNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL "
    f"THEN 1 END) AS n, round(corr({a},{b}),6) AS corr FROM subject"
    for a in NUMERIC for b in NUMERIC)))
def _(spark, sf):
    return rounded(P.pearson_matrix(subject(spark, sf), NUMERIC))


@query("value_share", with_sql("""
SELECT segment AS level, count(*) AS n, round(count(*)*100.0/(SELECT count(*) FROM subject),6)::DOUBLE AS pct
FROM subject GROUP BY 1"""))
def _(spark, sf):
    return rounded(P.value_share(subject(spark, sf), "segment"))


@query("min_max_mean", with_sql(
    'SELECT "column", round(min(value),6) AS min, round(max(value),6) AS max, round(avg(value),6) AS mean FROM long GROUP BY 1',
    long_sql(NUMERIC)))
def _(spark, sf):
    return rounded(P.min_max_mean(subject(spark, sf), NUMERIC))


@query("group_mean", with_sql(f"""
SELECT age_group AS "group", count(*) AS n, {', '.join(f'round(avg({c}),6) AS avg_{c}' for c in FLAGS + ['avg_price'])}
FROM grouped GROUP BY 1""", GROUPED_SQL))
def _(spark, sf):
    return rounded(P.group_mean(grouped(spark, sf), "age_group", FLAGS + ["avg_price"]))


@query("flag_prevalence", with_sql("\nUNION ALL ".join(
    f"SELECT '{f}' AS flag, sum({f})::BIGINT AS n_ones, round(sum({f})/count(*)::DOUBLE,6) AS share FROM subject"
    for f in FLAGS)))
def _(spark, sf):
    return rounded(P.flag_prevalence(subject(spark, sf), FLAGS))


RANGES = {"avg_qty": (20.0, 30.0), "avg_disc": (0.04, 0.06), "avg_price": (150000.0, 350000.0)}
RANGE_CASE = ("CASE " + " ".join(f"WHEN \"column\"='{c}' THEN value BETWEEN {lo} AND {hi}"
                                 for c, (lo, hi) in RANGES.items()) + " END")
RANGE_STATS = """count(CASE WHEN ok THEN 1 END) AS n_normal, count(CASE WHEN NOT ok THEN 1 END) AS n_abnormal,
  round(min(value),6) AS min, round(max(value),6) AS max, round(avg(value),6) AS mean,
  round(CASE WHEN count(value)>1 THEN stddev_samp(value) END,6) AS std, round(median(value),6) AS median,
  round(count(CASE WHEN NOT ok THEN 1 END)/count(ok)::DOUBLE,6) AS abnormal_rate"""


@query("range_summary", with_sql(
    f'SELECT "column", {RANGE_STATS} FROM (SELECT *, {RANGE_CASE} AS ok FROM long) z GROUP BY 1',
    long_sql(list(RANGES))))
def _(spark, sf):
    return rounded(P.range_summary(subject(spark, sf), RANGES))


@query("range_summary_by_age_group", with_sql(
    f'SELECT "column", age_group, {RANGE_STATS} FROM (SELECT *, {RANGE_CASE} AS ok FROM long) z GROUP BY 1,2',
    GROUPED_SQL, long_sql(list(RANGES), "grouped", ["age_group"])))
def _(spark, sf):
    return rounded(P.range_summary(grouped(spark, sf), RANGES, by="age_group"))


QTY_BANDS = [(0, 18, 15.0, 30.0), (18, 200, 18.5, 24.9)]
PRICE_BANDS = [(0, 10, 100000.0, 200000.0), (10, 18, 100000.0, 300000.0), (18, 200, 150000.0, 350000.0)]


def band_sql(c, band, rows):
    return "CASE " + " ".join(f"WHEN {band}>={s} AND {band}<{e} THEN {c} BETWEEN {lo} AND {hi}"
                              for s, e, lo, hi in rows) + " END"


@query("normal_range_flag_by_age", with_sql(f"""
SELECT "column", band, count(CASE WHEN ok THEN 1 END) AS n_true, count(CASE WHEN NOT ok THEN 1 END) AS n_false,
  round(count(CASE WHEN NOT ok THEN 1 END)/count(*)::DOUBLE,6) AS abnormal_rate
FROM (SELECT 'avg_qty' AS "column", age_group AS band, {band_sql('avg_qty', 'age', QTY_BANDS)} AS ok FROM grouped
 UNION ALL SELECT 'avg_price', age_group, {band_sql('avg_price', 'age', PRICE_BANDS)} FROM grouped) z
WHERE ok IS NOT NULL GROUP BY 1,2""", GROUPED_SQL))
def _(spark, sf):
    checks = {"avg_qty": clean.in_range_by_band("avg_qty", "age", QTY_BANDS),
              "avg_price": clean.in_range_by_band("avg_price", "age", PRICE_BANDS)}
    return rounded(P.range_rate_by_band(grouped(spark, sf), checks, F.col("age_group")))


@query("normal_range_flag", with_sql(f"""
SELECT row_id, CAST(avg_qty BETWEEN 20.0 AND 30.0 AS INT) AS qty_ok,
  CAST(avg_disc BETWEEN 0.04 AND 0.06 AS INT) AS disc_ok FROM subject"""))
def _(spark, sf):
    return subject(spark, sf).select(
        "row_id", clean.in_range("avg_qty", 20.0, 30.0).cast("int").alias("qty_ok"),
        clean.in_range("avg_disc", 0.04, 0.06).cast("int").alias("disc_ok"))


SHAPE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("distribution_shape", "WITH " + long_sql(SHAPE, "lineitem") + """
SELECT "column", round(skewness(value),6) AS skew, round(kurtosis(value),6) AS kurtosis,
  round(stddev_samp(value)/avg(value),6) AS cv FROM long GROUP BY 1""")
def _(spark, sf):
    return rounded(P.distribution_shape(table(spark, sf, "lineitem"), SHAPE))


@query("histogram", """
WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
b AS (SELECT least(floor((value-lo)*30/(hi-lo)),29)::INT AS bin, count(*) AS n FROM events, e
      WHERE value IS NOT NULL GROUP BY 1)
SELECT g.bin::INT AS bin, round(lo+g.bin*((hi-lo)/30),6) AS left_edge, coalesce(n,0)::BIGINT AS n
FROM range(30) g(bin) CROSS JOIN e LEFT JOIN b ON b.bin=g.bin""")
def _(spark, sf):
    return rounded(P.histogram(table(spark, sf, "events"), "value", 30))


@query("zero_share", with_sql(
    'SELECT "column", count(CASE WHEN value=0 THEN 1 END) AS n_zero, '
    'round(count(CASE WHEN value=0 THEN 1 END)/(SELECT count(*) FROM subject)::DOUBLE,6) AS share '
    'FROM long GROUP BY 1', long_sql(NUMERIC)))
def _(spark, sf):
    return rounded(P.zero_share(subject(spark, sf), NUMERIC))


UNIQ = ["row_id", "age", "segment", "region", "nation", "n_items", "balance"]


@query("uniqueness_ratio", with_sql("\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique, "
    f"round(count(DISTINCT {c})/count(*)::DOUBLE,6) AS ratio FROM subject" for c in UNIQ)))
def _(spark, sf):
    return rounded(P.uniqueness_ratio(subject(spark, sf), UNIQ))


@query("quasi_id_uniqueness", with_sql("""
SELECT count(*) AS n_combinations, sum(n)::BIGINT AS n_rows, count(CASE WHEN n=1 THEN 1 END) AS n_singletons,
  round(count(*)/sum(n)::DOUBLE,6) AS ratio
FROM (SELECT age, segment, region, count(*) AS n FROM subject GROUP BY 1,2,3) z"""))
def _(spark, sf):
    return rounded(P.quasi_id_uniqueness(subject(spark, sf), ["age", "segment", "region"]))


ENT = ["segment", "region", "nation", "urgent_flag"]


@query("level_entropy", with_sql("\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n_levels, round(-sum(p*ln(p)),6) AS entropy FROM "
    f"(SELECT count(*)/sum(count(*)) OVER ()::DOUBLE AS p FROM subject WHERE {c} IS NOT NULL GROUP BY {c}) z"
    for c in ENT)))
def _(spark, sf):
    return rounded(P.level_entropy(subject(spark, sf), ENT))


@query("iqr_outliers", "WITH " + long_sql(SHAPE, "lineitem") + """,
q AS (SELECT "column", quantile_cont(value,0.25) AS q1, quantile_cont(value,0.75) AS q3 FROM long GROUP BY 1)
SELECT "column", round(any_value(q1),6) AS q1, round(any_value(q3),6) AS q3,
  count(CASE WHEN value<q1-1.5*(q3-q1) OR value>q3+1.5*(q3-q1) THEN 1 END) AS n_outliers,
  round(count(CASE WHEN value<q1-1.5*(q3-q1) OR value>q3+1.5*(q3-q1) THEN 1 END)
    /(SELECT count(*) FROM lineitem)::DOUBLE,6) AS share
FROM long JOIN q USING ("column") GROUP BY 1""")
def _(spark, sf):
    return rounded(P.iqr_outliers(table(spark, sf, "lineitem"), SHAPE))


TIERS = [["age", "segment", "region"], ["age_group", "segment", "region"],
         ["age_group", "segment"], ["age_group", "urgent_flag"]]


@query("group_size_relax", with_sql("\nUNION ALL ".join(
    f"SELECT {i} AS tier, min(n)::BIGINT AS smallest, count(*) AS n_groups, "
    f"CAST(min(n)>=25 AS INT) AS wide_enough FROM (SELECT count(*) AS n FROM grouped GROUP BY {', '.join(t)}) z"
    for i, t in enumerate(TIERS)), GROUPED_SQL))
def _(spark, sf):
    return P.group_sizes_by_tier(grouped(spark, sf), TIERS).withColumn(
        "wide_enough", (F.col("smallest") >= 25).cast("int"))


@query("table_overview", with_sql("""
SELECT row_id, age, segment, n_orders, (SELECT count(*) FROM subject) AS n_rows, 4::BIGINT AS n_columns
FROM subject ORDER BY row_id LIMIT 5"""))
def _(spark, sf):
    return P.table_overview(subject(spark, sf).select("row_id", "age", "segment", "n_orders"), "row_id")


def _noised(spark, sf):
    return subject(spark, sf).withColumns({
        "n_items": F.greatest(F.col("n_items") + integer_between(-3, 4, "ba"), F.lit(0)),
        "segment": F.when(uniform("bs") < 0.1, "BUILDING").otherwise(F.col("segment"))})


NOISED_SQL = (f"noised AS (SELECT row_id, age, greatest(n_items+{int_sql(-3, 4, 'ba')},0) AS n_items, avg_price, "
              f"CASE WHEN {u_sql('bs')}<0.1 THEN 'BUILDING' ELSE segment END AS segment, age_group, urgent_flag FROM grouped)")


def _side_sql(t, name):
    return " UNION ALL ".join(
        [f"SELECT '{c}' AS \"column\", 'mean' AS item, avg({c})::DOUBLE AS {name} FROM {t}"
         for c in ("n_items", "avg_price")]
        + [f"SELECT 'segment', segment, count(*)/(SELECT count(*) FROM {t})::DOUBLE FROM {t} GROUP BY segment"])


@query("before_after_report", with_sql(f"""
SELECT "column", item, round(before,6) AS before, round(after,6) AS after,
  round((after-before)*100.0/nullif(abs(before),0),6) AS change_pct
FROM ({_side_sql('grouped', 'before')}) b FULL OUTER JOIN ({_side_sql('noised', 'after')}) a
USING ("column", item)""", GROUPED_SQL, NOISED_SQL))
def _(spark, sf):
    return rounded(P.before_after_report(subject(spark, sf), _noised(spark, sf),
                                         ["n_items", "avg_price"], ["segment"]))


@query("utility_diff", with_sql("""
, d AS (SELECT abs(coalesce(a.x,0)-coalesce(b.x,0)) AS d FROM
 (SELECT segment, avg(n_items) AS x FROM grouped GROUP BY 1) b FULL OUTER JOIN
 (SELECT segment, avg(n_items) AS x FROM noised GROUP BY 1) a USING (segment))
SELECT 'avg_n_items' AS stat, round(avg(d),6) AS mean_abs_diff, round(max(d),6) AS max_abs_diff FROM d
""".strip(), GROUPED_SQL, NOISED_SQL).replace(")\n, d AS", "),\nd AS"))
def _(spark, sf):
    b, a = subject(spark, sf), _noised(spark, sf)
    g = [df.groupBy("segment").agg(F.avg("n_items").alias("avg_n_items")) for df in (b, a)]
    return rounded(P.utility_diff(g[0], g[1], ["segment"], ["avg_n_items"]))


@query("value_set_equal", with_sql("""
SELECT (SELECT count(*) FROM (SELECT age FROM grouped EXCEPT SELECT least(age,90) FROM grouped)) AS n_lost,
 (SELECT count(*) FROM (SELECT least(age,90) FROM grouped EXCEPT SELECT age FROM grouped)) AS n_new,
 CAST((SELECT count(*) FROM (SELECT age FROM grouped EXCEPT SELECT least(age,90) FROM grouped))=0 AS INT) AS equal""",
    GROUPED_SQL))
def _(spark, sf):
    s = subject(spark, sf).select("age")
    return P.value_set_equal(s, s.select(F.least("age", F.lit(90)).alias("age")), "age")
