"""Quantile mapping, copula synthesis and logit alignment."""
from __future__ import annotations

from pyspark.sql import functions as F

from veiltab.catalog.registry import query, rounded
from veiltab.operators import synth as Y
from veiltab.operators.profile import pearson_matrix
from veiltab.plans.views import RELEASE_SQL, gauss_sql, release, subject, with_sql
from veiltab.session import materialize

COLS = ["n_orders", "n_items", "avg_price"]
INTS = ["n_orders", "n_items"]


def map_sql(new: str, src: str, c: str, integer: bool, key: str = "region") -> str:
    """CTE body: rows of ``new`` with column c mapped onto ``src`` per key."""
    pick = ("list_extract(xs, (round_even(pos,0)+1)::BIGINT)" if integer else
            "CASE WHEN pos-floor(pos)<=0 THEN list_extract(xs, floor(pos)::BIGINT+1) ELSE "
            "list_extract(xs, floor(pos)::BIGINT+1)*(1-(pos-floor(pos)))+list_extract(xs, ceil(pos)::BIGINT+1)*(pos-floor(pos)) END")
    return f"""SELECT id, {pick} AS {c} FROM (
 SELECT id, xs, round((r-1)/greatest(n-1,1)*(len(xs)-1),9) AS pos FROM
 (SELECT id, {key}, rank() OVER (PARTITION BY {key} ORDER BY {c})+(count(*) OVER (PARTITION BY {key}, {c})-1)/2.0::DOUBLE AS r,
   count(*) OVER (PARTITION BY {key}) AS n FROM {new} WHERE {c} IS NOT NULL) a
 JOIN (SELECT {key}, list_sort(list({c}::DOUBLE)) AS xs FROM {src} WHERE {c} IS NOT NULL GROUP BY 1) s USING ({key})) z"""


@query("quantile_map", with_sql(
    "SELECT src_id, round(x.n_orders,6) AS n_orders, round(y.n_items,6) AS n_items, round(z.avg_price,8) AS avg_price FROM release r "
    "LEFT JOIN x ON x.id=r.src_id LEFT JOIN y ON y.id=r.src_id LEFT JOIN z ON z.id=r.src_id",
    RELEASE_SQL, "rel AS (SELECT src_id AS id, region, n_orders, n_items, round(avg_price,6) AS avg_price FROM release)",
    *[f"{t} AS ({map_sql('rel', 'subject', c, c in INTS)})" for t, c in zip("xyz", COLS)]))
def _(spark, sf):
    new = release(spark, sf).select("src_id", "region", "n_orders", "n_items", F.round("avg_price", 6).alias("avg_price"))
    return rounded(Y.quantile_map(new, subject(spark, sf), ["region"], COLS, INTS, "src_id").select("src_id", *COLS), 8)


@query("jitter_match", with_sql(
    "SELECT j.id AS row_id, x.n_orders, round(z.avg_price,8) AS avg_price FROM jit j JOIN x USING (id) JOIN z USING (id)",
    f"jit AS (SELECT row_id AS id, region, round(n_orders+{gauss_sql('jit/n_orders')}*0.02*stddev_pop(n_orders) OVER (PARTITION BY region),9) AS n_orders, "
    f"round(avg_price+{gauss_sql('jit/avg_price')}*0.02*stddev_pop(avg_price) OVER (PARTITION BY region),9) AS avg_price FROM subject)",
    f"x AS ({map_sql('jit', 'subject', 'n_orders', True)})", f"z AS ({map_sql('jit', 'subject', 'avg_price', False)})"))
def _(spark, sf):
    df = subject(spark, sf).select("row_id", "region", "n_orders", "avg_price")
    return rounded(Y.jitter_match(df, ["region"], ["n_orders", "avg_price"], ["n_orders"]).select("row_id", "n_orders", "avg_price"), 8)


@query("gaussian_copula_synth")
def _(spark, sf):
    df = subject(spark, sf).select("row_id", "region", *COLS, "balance")
    return rounded(Y.gaussian_copula_synth(df, ["region"], [*COLS, "balance"], INTS))


@query("copula_correlation_kept")
def _(spark, sf):
    df = subject(spark, sf).select("row_id", "region", *COLS)
    out = Y.gaussian_copula_synth(df, ["region"], COLS, INTS)
    b, a = pearson_matrix(df, COLS), pearson_matrix(out, COLS)
    return rounded(b.select("col_a", "col_b", F.col("corr").alias("before")).join(
        a.select("col_a", "col_b", F.col("corr").alias("after")), ["col_a", "col_b"]), 4)


# Coefficients of a small literal logistic model.
COEF = {"age": 0.004, "n_orders": 0.06, "avg_price": 0.000002, "balance": 0.0001}


@query("logit_align")
def _(spark, sf):
    before = materialize(subject(spark, sf).select("row_id", "region", "urgent_flag", *COEF))
    after = Y.gaussian_copula_synth(before, ["region"], ["avg_price", "balance"], [])
    return Y.logit_align(before, after, COEF, -1.1, ["urgent_flag", "region"], ["avg_price", "balance"])
