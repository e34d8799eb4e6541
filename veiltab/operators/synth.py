"""Rank-based mapping and Gaussian-copula synthesis inside groups."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veiltab.functions.clean import range_clip
from veiltab.functions.hashing import gaussian
from veiltab.functions.special import normal_cdf, normal_quantile
from veiltab.operators.joins import attach_groups, keyed_join
from veiltab.operators.ranks import attach_by_value, cumulative_counts, exact_quantiles
from veiltab.session import materialize

ROW = "row_id"
STEP = 64  # order-statistic positions per lookup bucket


def order_statistics(src: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Lookup table of a value histogram: (keys, bucket, from, until, value, next value).

    A run of equal values is repeated in every bucket of positions it touches, so a lookup is
    an equi-join on (keys, bucket) with at most STEP + 1 entries per bucket, whatever the
    group size or the number of copies.
    """
    cum = cumulative_counts(src, keys, value)
    first = F.floor(F.greatest(F.col("n_before") - 1, F.lit(0)) / STEP).cast("long")
    last = F.floor((F.col("n_before") + F.col("n") - 1) / STEP).cast("long")
    cut = cum.select(*keys, F.explode(F.sequence(first, last)).alias("bucket"),
                     F.col("n_before").alias("from"), (F.col("n_before") + F.col("n")).alias("until"),
                     F.col(value).alias("value"), F.col("n_total").alias("m"))
    w = Window.partitionBy(*keys, "bucket").orderBy("from")
    return cut.withColumn("next", F.lead("value").over(w))


def at_positions(rows: DataFrame, stats: DataFrame, keys: list[str], pos: str, integer: Column, out: str) -> DataFrame:
    """Order statistic at a fractional 0-based position: nearest (half-even) where ``integer``,
    else linear between neighbours. ``rows`` needs keys and ``pos``."""
    at = F.when(integer, F.bround(pos)).otherwise(F.floor(pos)).cast("long")
    asked = rows.withColumns({"__lo": at, "__bucket": F.floor(at / STEP).cast("long")})
    right = stats.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("bucket").alias("__b"),
                         "from", "until", "value", "next")
    on = F.col("__bucket") == F.col("__b")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    on = on & (F.col("__lo") >= F.col("from")) & (F.col("__lo") < F.col("until"))
    frac = F.col(pos) - F.col("__lo")
    above = F.when(F.col("__lo") + 1 < F.col("until"), F.col("value")).otherwise(F.coalesce("next", "value"))
    value = F.when(integer | (frac <= 0), F.col("value")).otherwise(F.col("value") * (1 - frac) + above * frac)
    return asked.join(right, on, "left").select(*rows.columns, value.alias(out))


def quantile_map(new: DataFrame, src: DataFrame, keys: list[str], cols: list[str], integers: list[str],
                 row_id: str = ROW) -> DataFrame:
    """Replace each value by the source group's value at the same relative mid-rank.

    All columns go through one long-form job: mid-ranks of the new values by histogram, then a
    lookup of order statistics; equal new values are looked up once.
    """
    k = [*keys, "column"]
    long_new, long_src = _long(new, [row_id, *keys], cols), _long(src, keys, cols)
    ranks = cumulative_counts(long_new, k, "value")
    stats = order_statistics(long_src.filter(F.col("value").isNotNull()), k, "value")
    sizes = stats.groupBy(*k).agg(F.max("m").alias("m"))
    r = (F.col("n_before") + (F.col("n") - 1) / 2.0) / F.greatest(F.col("n_total") - 1, F.lit(1))
    asked = keyed_join(ranks, sizes, k, "left").select(*k, "value", "n", F.round(r * (F.col("m") - 1), 9).alias("pos")).withColumnRenamed("value", "new")
    mapped = at_positions(asked, stats, k, "pos", F.col("column").isin(integers), "mapped")
    back = attach_by_value(long_new, mapped.withColumnRenamed("new", "value").drop("pos"), k, "value", ["mapped"], row_id)
    return _wide(new, back, "mapped", cols, row_id)


def _long(df: DataFrame, ids: list[str], cols: list[str]) -> DataFrame:
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(ids, cols, "column", "value")


def _wide(df: DataFrame, long: DataFrame, value: str, cols: list[str], row_id: str) -> DataFrame:
    """Put long-form values back as columns; rows without a new value get null."""
    wide = long.groupBy(row_id).pivot("column", cols).agg(F.first(value))
    return df.drop(*cols).join(wide, row_id, "left").select(*df.columns)


def jitter_match(df: DataFrame, keys: list[str], cols: list[str], integers: list[str], noise: float = 0.02,
                 salt: str = "jit", row_id: str = ROW) -> DataFrame:
    """N(0, noise) times the group's standard deviation, then mapped back onto the group's values."""
    sd = df.groupBy(*keys).agg(*[F.stddev_pop(F.col(c).cast("double")).alias(f"__s_{c}") for c in cols])
    moved = attach_groups(df, sd, keys).withColumns({
        c: F.round(F.col(c) + gaussian(f"{salt}/{c}", row_id) * noise * F.col(f"__s_{c}"), 9) for c in cols}
    ).select(*df.columns)
    return quantile_map(moved, df, keys, cols, integers, row_id)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _cholesky(corr: pd.Series) -> pd.Series:
    """Lower factor (row-major) of the nearest positive-definite correlation matrix, per group."""
    def one(flat):
        d = int(round(len(flat) ** 0.5))
        m = np.array([0.0 if x is None or not np.isfinite(x) else x for x in flat]).reshape(d, d)
        np.fill_diagonal(m, 1.0)
        vals, vecs = np.linalg.eigh((m + m.T) / 2.0)
        m = (vecs * np.maximum(vals, 1e-6)) @ vecs.T
        return np.linalg.cholesky(m).reshape(-1)
    return corr.map(one)


def normal_scores(df: DataFrame, keys: list[str], cols: list[str], row_id: str = ROW) -> DataFrame:
    """(row id, keys, one normal score per column): inverse normal of (mid-rank - 1/2) / (n + 1)
    inside the group; a missing value sits at the median, score 0."""
    k = [*keys, "column"]
    long = _long(df, [row_id, *keys], cols)
    mid = F.col("n_before") + (F.col("n") + 1) / 2.0
    p = range_clip((mid - 0.5) / (F.col("n_total") + 1.0), 1e-6, 1 - 1e-6)
    z = cumulative_counts(long, k, "value").select(*k, "value", "n", normal_quantile(p).alias("z"))
    scored = attach_by_value(long, z, k, "value", ["z"], row_id).withColumn("z", F.coalesce("z", F.lit(0.0)))
    return scored.groupBy(row_id, *keys).pivot("column", cols).agg(F.first("z"))


def rank_correlation(df: DataFrame, keys: list[str], cols: list[str], row_id: str = ROW) -> DataFrame:
    """(keys, corr): row-major correlation matrix of the normal scores per group."""
    z = normal_scores(df, keys, cols, row_id)
    d = len(cols)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    agg = z.groupBy(*keys).agg(*[F.try_divide(
        F.covar_pop(cols[i], cols[j]), F.stddev_pop(cols[i]) * F.stddev_pop(cols[j])).alias(f"r{i}_{j}")
        for i, j in pairs])
    cells = [F.coalesce(F.col(f"r{min(i, j)}_{max(i, j)}"), F.lit(1.0 if i == j else 0.0))
             for i in range(d) for j in range(d)]
    return agg.select(*keys, F.array(*cells).alias("corr"))


def gaussian_copula_synth(df: DataFrame, keys: list[str], cols: list[str], integers: list[str],
                          salt: str = "copula", row_id: str = ROW) -> DataFrame:
    """Replace ``cols`` by a synthetic draw that keeps each group's marginals and rank correlation.

    Ranks, correlations and order statistics are aggregations; only the d x d factorisation of
    each group's matrix runs in Python, on one row per group.
    """
    d = len(cols)
    factor = rank_correlation(df, keys, cols, row_id).select(*keys, _cholesky("corr").alias("__l"))
    draws = df.select(row_id, *keys, F.array(*[gaussian(f"{salt}/{c}", row_id) for c in cols]).alias("__g"))
    g = attach_groups(draws, factor, keys, "inner")
    # correlated normals: row i of the factor times the independent draws
    z = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.aggregate(
        F.sequence(F.lit(0), i), F.lit(0.0), lambda s, j: s + F.get("__l", i * d + j) * F.get("__g", j)))
    k = [*keys, "column"]
    u = g.select(row_id, *keys, F.posexplode(z).alias("__i", "z")).select(
        row_id, *keys, F.get(F.array(*[F.lit(c) for c in cols]), F.col("__i")).alias("column"),
        normal_cdf(F.col("z")).alias("u"))
    stats = materialize(order_statistics(_long(df, keys, cols).filter(F.col("value").isNotNull()), k, "value"), "stats")
    sizes = stats.groupBy(*k).agg(F.max("m").alias("m"))
    asked = attach_groups(u, sizes, k, "inner").withColumn("pos", range_clip(F.col("u"), 0.0, 1.0) * (F.col("m") - 1)).drop("m", "u")
    mapped = at_positions(asked, stats, k, "pos", F.col("column").isin(integers), "mapped")
    return _wide(df, mapped, "mapped", cols, row_id)


def logit_align(before: DataFrame, after: DataFrame, coef: dict[str, float], intercept: float, group: list[str],
                continuous: list[str], digits: int = 2, row_id: str = ROW) -> DataFrame:
    """``align_logits`` for a logit given by literal coefficients of numeric columns; missing numbers count as 0."""
    z = F.lit(float(intercept))
    for c, b in coef.items():
        z = z + F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * b
    return align_logits(before, after, z, {c: coef.get(c, 0.0) for c in continuous}, group, digits, row_id)


def align_logits(before: DataFrame, after: DataFrame, logit: Column, weight: dict[str, float], group: list[str],
                 digits: int = 2, row_id: str = ROW) -> DataFrame:
    """Move the release's logits onto the original's logit distribution per group.

    The logit change is spread over the continuous columns (``weight``: their coefficients) along their coefficients (the
    smallest move that achieves it) and clipped to the original's 0.5..99.5 percent range; missing values stay missing.
    """
    norm2 = sum(w * w for w in weight.values())
    if norm2 < 1e-10:
        return after
    continuous = list(weight)
    b, a = (df.withColumn("logit", F.round(logit, 9)) for df in (before, after))
    target = quantile_map(a.select(row_id, *group, "logit"), b.select(row_id, *group, "logit"), group, ["logit"], [], row_id
                          ).select(row_id, F.col("logit").alias("__target"))
    moved = a.join(target, row_id).withColumn("__d", F.coalesce(F.col("__target") - F.col("logit"), F.lit(0.0)))
    lim = exact_quantiles(_long(before, group, continuous), [*group, "column"], "value", {"lo": 0.005, "hi": 0.995})
    wide = lim.groupBy(*group).pivot("column", continuous).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    out = attach_groups(moved, wide, group)
    exprs = {}
    for c, w in weight.items():
        x = F.col(c).cast("double") + F.col("__d") * (w / norm2)
        exprs[c] = F.when(x.isNotNull(), F.round(F.least(F.greatest(x, F.col(f"{c}_lo")), F.col(f"{c}_hi")), digits))
    return out.withColumns(exprs).select(*after.columns)
