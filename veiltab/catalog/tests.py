"""Rank tests and classifier metrics."""
from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import functions as F

from veiltab.catalog.profile import GROUPED_SQL, grouped, long_sql
from veiltab.catalog.registry import query, rounded
from veiltab.functions import special
from veiltab.operators import metrics as M
from veiltab.operators import ranktest as R
from veiltab.operators.ranks import column_quantiles, mid_ranks
from veiltab.plans.views import (AGE_LABELS, COUNTS, NUMERIC, SCORES_SQL, scores, subject, table, u_sql,
                                 with_sql)
from veiltab.functions.hashing import uniform

KW = ["n_orders", "n_items", "n_returns", "n_suppliers", "avg_price"]


def kw_sql(long_cte: str, labels: list[str], extra_cols: str = "", min_n: int = 2) -> str:
    """Window-rank formulation of the same table (pairwise shares by direct comparison of
    value counts), for groups named by ``labels``."""
    idx = " ".join(f"WHEN '{lab}' THEN {i}" for i, lab in enumerate(labels))
    return f"""{long_cte},
k0 AS (SELECT metric, CASE g {idx} END AS gi, value AS y FROM long WHERE g IS NOT NULL AND value IS NOT NULL),
gs0 AS (SELECT metric, gi, count(*) AS n FROM k0 GROUP BY 1,2),
k1 AS (SELECT k0.* FROM k0 JOIN gs0 USING (metric, gi) WHERE n >= {min_n}),
k2 AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY y)
   + (count(*) OVER (PARTITION BY metric, y) - 1)/2.0::DOUBLE AS r FROM k1),
gs AS (SELECT metric, gi, count(*)::DOUBLE AS n, sum(r) AS rs FROM k2 GROUP BY 1,2),
tie AS (SELECT metric, sum(t*t*t-t) AS ties FROM
   (SELECT metric, y, count(*)::DOUBLE AS t FROM k2 GROUP BY 1,2) z GROUP BY 1),
tot AS (SELECT metric, count(*)::DOUBLE AS n, var_pop(r)*count(*) AS sst FROM k2 GROUP BY 1),
hm0 AS (SELECT gs.*, coalesce(sum(n) OVER (PARTITION BY metric ORDER BY gi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS pre FROM gs),
hm AS (SELECT hm0.metric, 12/(any_value(tot.n)*(any_value(tot.n)+1))*sum(hm0.n*pow(pre+(hm0.n+1)/2-(tot.n+1)/2,2)) AS hmax
   FROM hm0 JOIN tot USING (metric) GROUP BY 1),
kw AS (SELECT gs.metric, count(*)-1 AS dof, any_value(tot.n) AS n, any_value(sst) AS sst,
   sum(gs.n*pow(rs/gs.n-(tot.n+1)/2,2)) AS ssb, any_value(ties) AS ties FROM gs JOIN tot USING (metric) JOIN tie USING (metric) GROUP BY 1),
vc AS (SELECT metric, gi, y, count(*)::DOUBLE AS c FROM k2 GROUP BY 1,2,3),
vd0 AS (SELECT a.metric, a.gi AS i, b.gi AS j, sum(a.c*b.c*CASE WHEN a.y>b.y THEN 1 WHEN a.y=b.y THEN 0.5 ELSE 0 END) AS w,
   sum(a.c*b.c) AS nn FROM vc a JOIN vc b ON a.metric=b.metric AND a.gi<b.gi GROUP BY 1,2,3),
vd AS (SELECT metric, sum(w)/sum(nn) AS a_avg, sum(2*abs(w-0.5*nn))/sum(nn) AS a_sym FROM vd0 GROUP BY 1),
res AS (SELECT kw.*, hmax, a_avg, a_sym, 12/(n*(n+1))*ssb/(1-ties/(n*n*n-n)) AS h FROM kw JOIN hm USING (metric) JOIN vd USING (metric))
SELECT metric, {extra_cols} round(least(greatest(h/hmax,0),1),6) AS "H_norm",
 round(2/pi()*atan((h/2 - ln(CASE dof WHEN 2 THEN 1 ELSE 1+h/2 END))/ln(10)/10),6) AS minus_log10_p_norm,
 round(least(greatest((h-dof)/(n-dof),0),1),6) AS epsilon2, round(least(greatest((h-dof)/(n-1),0),1),6) AS eta2_kw,
 round(ssb/sst,6) AS rank_eta2, round(a_avg,6) AS "A_pair_avg", round(a_sym,6) AS "A_pair_sym" """


SUBJECT_LONG = long_sql(KW, "grouped", ["age_group"], name="long0", col="metric") + \
    ", long AS (SELECT metric, age_group AS g, value FROM long0)"


@query("kruskal_wallis", "WITH " + kw_sql(
    with_sql("", GROUPED_SQL, SUBJECT_LONG)[5:].rstrip(), AGE_LABELS) + "FROM res")
def _(spark, sf):
    return rounded(R.kruskal_wallis(grouped(spark, sf), KW, F.col("age_group"), AGE_LABELS))


@query("kruskal_wallis_report", "WITH " + kw_sql(
    with_sql("", GROUPED_SQL, SUBJECT_LONG)[5:].rstrip(), AGE_LABELS,
    "(SELECT string_agg(lab||':'||coalesce(n,0)::BIGINT, '; ' ORDER BY ord) FROM (VALUES "
    + ", ".join(f"({i},'{lab}')" for i, lab in enumerate(AGE_LABELS))
    + ") v(ord,lab) LEFT JOIN gs0 ON gs0.gi=v.ord AND gs0.metric=res.metric) AS group_sizes, '' AS note, ")
    + "FROM res")
def _(spark, sf):
    return rounded(R.kruskal_wallis(grouped(spark, sf), KW, F.col("age_group"), AGE_LABELS,
                                    keep_missing=True))


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("kruskal_wallis_events", "WITH " + kw_sql(
    "long AS (SELECT 'value' AS metric, event_type AS g, value FROM events)", EVENT_TYPES) + "FROM res")
def _(spark, sf):
    return rounded(R.kruskal_wallis(table(spark, sf, "events"), ["value"], F.col("event_type"), EVENT_TYPES))


@query("mid_rank", """
SELECT DISTINCT l_extendedprice AS value, count(*) OVER (PARTITION BY l_extendedprice) AS n,
  rank() OVER (ORDER BY l_extendedprice)+(count(*) OVER (PARTITION BY l_extendedprice)-1)/2.0::DOUBLE AS mid_rank
FROM lineitem""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("value"))
    return mid_ranks(li, [], "value").select("value", "n", "mid_rank")


@query("exact_quantiles", with_sql(
    'SELECT "column", round(quantile_cont(value,0.01),6) AS p01, round(quantile_cont(value,0.5),6) AS p50, '
    'round(quantile_cont(value,0.995),6) AS p995, count(value) AS n_valid FROM long GROUP BY 1',
    long_sql(NUMERIC)))
def _(spark, sf):
    return rounded(column_quantiles(subject(spark, sf), NUMERIC, {"p01": .01, "p50": .5, "p995": .995}))


@query("h_max_no_ties", with_sql("""
SELECT round(12/(n*(n+1))*s,6) AS h_max FROM (SELECT any_value(n) AS n, sum(c*pow(pre+(c+1)/2-(n+1)/2,2)) AS s FROM (
 SELECT c::DOUBLE AS c, sum(c) OVER ()::DOUBLE AS n, coalesce(sum(c) OVER (ORDER BY age_group ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::DOUBLE AS pre
 FROM (SELECT age_group, count(*) AS c FROM grouped GROUP BY 1) z) z) z""", GROUPED_SQL))
def _(spark, sf):
    sizes = grouped(spark, sf).agg(*[F.count_if(F.col("age_group") == g).alias(f"c{i}")
                                     for i, g in enumerate(AGE_LABELS)])
    return rounded(sizes.select(R.h_max([F.col(f"c{i}") for i in range(len(AGE_LABELS))]).alias("h_max")))


@query("chi2_logsf", """
SELECT l_orderkey, l_linenumber, round((x/2-ln(1+x/2))/ln(10),6) AS df4,
  round((x/2-ln(1+x/2+pow(x/2,2)/2))/ln(10),6) AS df6,
  round(2/pi()*atan((x/2-ln(1+x/2))/ln(10)/10),6) AS squashed_arctan,
  round(1-exp(-(x/2-ln(1+x/2))/ln(10)/10),6) AS squashed_exp,
  round(ln(1+least((x/2-ln(1+x/2))/ln(10),300))/ln(301),6) AS squashed_log1p
FROM (SELECT l_orderkey, l_linenumber, l_quantity*3.7 AS x FROM lineitem) z""")
def _(spark, sf):
    x = F.col("l_quantity") * 3.7
    df4, df6 = (special.minus_log10_p(x, F.lit(d)) for d in (4, 6))
    return rounded(table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", df4.alias("df4"), df6.alias("df6"),
        *[special.squash_log10_p(df4, m).alias(f"squashed_{m}") for m in ("arctan", "exp", "log1p")]))


AUC_SQL = """(SELECT (sum(CASE WHEN y=1 THEN r END)-n1*(n1+1)/2)/(n1*n0) FROM
 (SELECT y, rank() OVER (ORDER BY p)+(count(*) OVER (PARTITION BY p)-1)/2.0 AS r,
  sum(y) OVER ()::DOUBLE AS n1, sum(1-y) OVER ()::DOUBLE AS n0 FROM scores) z GROUP BY n1, n0)"""


@query("classification_metrics", with_sql(f"""
SELECT count(*) AS n, round(avg(CASE WHEN (p>=0.5)=(y=1) THEN 1.0 ELSE 0.0 END)::DOUBLE,6) AS accuracy,
 round(avg(-(y*ln(p)+(1-y)*ln(1-p))),6) AS logloss, round({AUC_SQL}::DOUBLE,6) AS auc FROM scores""", SCORES_SQL))
def _(spark, sf):
    return rounded(M.classification_metrics(scores(spark, sf)))


SPLIT = f"CASE WHEN {u_sql('split')}<0.8 THEN 'train' ELSE 'valid' END"


def split_scores(spark, sf):
    return scores(spark, sf).withColumn(
        "split", F.when(uniform("split") < 0.8, "train").otherwise("valid"))


@query("confidence_metrics", with_sql(f"""
SELECT {SPLIT} AS split, round(avg(greatest(p,1-p)),6) AS mean_conf,
 round(avg(CASE WHEN p>0.99 OR p<0.01 THEN 1.0 ELSE 0.0 END)::DOUBLE,6) AS extreme_share,
 round(avg(-(y*ln(p)+(1-y)*ln(1-p))),6) AS nll,
 round(avg(-(y*ln(p)+(1-y)*ln(1-p)))+0.1*avg(abs(p-0.5)),6) AS penalised_loss FROM scores GROUP BY 1""", SCORES_SQL))
def _(spark, sf):
    return rounded(M.confidence_metrics(split_scores(spark, sf), "split"))


@query("confidence_gap", with_sql(f"""
SELECT round(avg(CASE WHEN s='train' THEN greatest(p,1-p) END)-avg(CASE WHEN s='valid' THEN greatest(p,1-p) END),6)
 AS confidence_gap FROM (SELECT p, {SPLIT} AS s FROM scores) z""", SCORES_SQL))
def _(spark, sf):
    return rounded(M.confidence_gap(split_scores(spark, sf), "split", "train", "valid"))


@query("is_binary_01", """
SELECT 'quality' AS name, count(*) AS n, count(CASE WHEN quality NOT IN (0,1) THEN 1 END) AS n_bad,
 CAST(count(*)>0 AND count(CASE WHEN quality NOT IN (0,1) THEN 1 END)=0 AS INT) AS is_binary FROM labels
UNION ALL SELECT 'l_linenumber', count(*), count(CASE WHEN l_linenumber NOT IN (0,1) THEN 1 END),
 CAST(count(*)>0 AND count(CASE WHEN l_linenumber NOT IN (0,1) THEN 1 END)=0 AS INT) FROM lineitem
UNION ALL SELECT 'quality_lenient', count(CASE WHEN doc_id%10<>0 THEN 1 END), 0, 1 FROM labels""")
def _(spark, sf):
    labels = table(spark, sf, "labels")
    gaps = labels.withColumn("quality", F.when(F.col("doc_id") % 10 != 0, F.col("quality").cast("string")).otherwise("nan"))
    parts = [("quality", M.is_binary(labels, "quality")),
             ("l_linenumber", M.is_binary(table(spark, sf, "lineitem"), "l_linenumber")),
             ("quality_lenient", M.is_binary(gaps, "quality", lenient=True))]
    dfs = [df.select(F.lit(n).alias("name"), "*") for n, df in parts]
    return dfs[0].unionByName(dfs[1]).unionByName(dfs[2])
