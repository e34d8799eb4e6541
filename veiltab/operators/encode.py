"""Feature encodings: one-hot tables for models, compact vectors for matching.

A matching vector is ``num`` (scaled numbers), ``cat`` (one 64-bit code per category) and
``w`` (the weight of the row's own level per category). Two rows whose levels differ are
w_a + w_c apart in L1 (w_a^2 + w_c^2 in squared L2), exactly as in the weighted one-hot
embedding, which therefore never has to be built.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veiltab.functions.clean import clean_category, to_number
from veiltab.operators import fit
from veiltab.operators import scale as S
from veiltab.operators.joins import attach_groups
from veiltab.session import materialize

# ---------------------------------------------------------------- for models


def _numeric_columns(df: DataFrame, cols: list[str]) -> list[str]:
    got = fit.row(df, **{c: F.count_if(to_number(c).isNotNull()) for c in cols})
    return [c for c in cols if got[c] > 0]


def _drop_constant(df: DataFrame, keep: list[str], cols: list[str]) -> DataFrame:
    aggs = {}
    for i, c in enumerate(cols):
        aggs.update({f"lo{i}": F.min(f"`{c}`"), f"hi{i}": F.max(f"`{c}`"), f"n{i}": F.count(f"`{c}`")})
    got = fit.row(df, n=F.count(F.lit(1)), **aggs)
    live = [c for i, c in enumerate(cols) if got[f"n{i}"] > 0 and (
        got[f"lo{i}"] != got[f"hi{i}"] or got[f"n{i}"] < got["n"])]
    return df.select(*keep, *[F.col(f"`{c}`") for c in sorted(live)])


def encode_supervised(df: DataFrame, cols: list[str], keep: list[str], missing: str | None = None,
                      impute: bool = False) -> DataFrame:
    """Numbers where any value parses, else one-hot ``column_level`` without the first level;
    constant columns dropped (null counts as a value), names sorted.

    ``missing`` gives blanks a level of their own and ``impute`` fills numbers with medians.
    """
    numeric = _numeric_columns(df, cols)
    num = {c: F.when(~F.isnan(to_number(c)) & ~to_number(c).isin(math.inf, -math.inf), to_number(c)) for c in numeric}
    base = df.withColumns(num)
    if impute and numeric:
        med = fit.medians(base, numeric)
        base = base.withColumns({c: F.coalesce(F.col(c), F.lit(med[c]).cast("double")) for c in numeric})
    hot = {}
    for c in [c for c in cols if c not in numeric]:
        text = F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit(missing).cast("string"))
        base = base.withColumn(c, text)
        for level, _ in fit.level_counts(base, c)[1:]:
            hot[f"{c}_{level}"] = F.when(F.col(c) == level, 1.0).otherwise(0.0)
    wide = base.select(*keep, *numeric, *[e.alias(n) for n, e in hot.items()])
    return _drop_constant(wide, keep, [*numeric, *hot])


def encode_glm(df: DataFrame, cols: list[str], keep: list[str]) -> DataFrame:
    """As ``encode_supervised`` with a (NA) level and median-filled numbers."""
    return encode_supervised(df, cols, keep, missing="(NA)", impute=True)


def align_features(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """The model's columns in the model's order; absent ones are 0, extra ones dropped."""
    have = set(df.columns)
    return df.select(*keep, *[
        (F.coalesce(F.col(f"`{f}`"), F.lit(0.0)) if f in have else F.lit(0.0)).alias(f) for f in features])


# ---------------------------------------------------------------- for matching


def _codes(cats: list[str]) -> tuple[Column, list[Column]]:
    text = [clean_category(c) for c in cats]
    codes = F.array(*[F.xxhash64(t) for t in text]) if cats else F.array().cast("array<bigint>")
    return codes, text


def _vector(df: DataFrame, row_id: str, num: list[Column], codes: Column, weights: list[Column],
            extra: list[str]) -> DataFrame:
    return df.select(
        F.col(row_id).alias("id"),
        (F.array(*num) if num else F.array()).cast("array<double>").alias("num"), codes.alias("cat"),
        (F.array(*weights) if weights else F.array()).cast("array<double>").alias("w"), *extra)


def encode_pair(a: DataFrame, c: DataFrame, numeric: list[str], cats: list[str], a_id: str = "row_id",
                c_id: str = "row_id", kind: str = "l1", extra: list[str] | None = None):
    """Matching vectors of the population and the release under one fitted encoding.

    ``l1``: A-range min-max numbers, unit category weights. ``zidf``: winsorised z-scores and
    ln(1/share)^1.2 level weights over both tables. ``idf_clip``: min-max numbers with weights
    from A's column means clipped to [0.5, 3], numbers included. ``robust``: median/IQR numbers;
    categories with more than 30 levels keep their 20 most frequent and a rest level.
    """
    extra = extra or []
    numeric = list(numeric)
    factor = {k: 1.0 for k in numeric}
    if kind in ("l1", "idf_clip"):
        a, c, numeric = S.minmax_scale_pair(a, c, numeric)
    elif kind == "zidf":
        a, c = S.zscore_winsor_pair(a, c, numeric)
    elif kind == "robust":
        a, c = S.robust_scale_pair(a, c, numeric)
    else:
        raise ValueError(kind)

    def idf(share: float) -> float:
        return max(math.log(1.0 / (share + 1e-6)), 0.0) ** 1.2

    tidy = {k: clean_category(k) for k in cats}
    a, c = a.withColumns(tidy), c.withColumns(tidy)
    weights = [F.lit(1.0) for _ in cats]

    def share_weight(counted: DataFrame, k: str, n: int) -> DataFrame:
        """``k, __w_k``: ln(1/share)^1.2 per level; a table of any size, joined to the rows."""
        logs = F.log(F.lit(1.0) / (F.col("n") / F.lit(float(n)) + F.lit(1e-6)))
        return fit.level_table(counted, k).select(F.col("level").alias(k), F.pow(F.greatest(logs, F.lit(0.0)), F.lit(1.2)).alias(f"__w_{k}"))

    if kind == "zidf":
        both = a.select(*cats).unionByName(c.select(*cats))
        n = both.count()
        for k in cats:
            table = materialize(share_weight(both, k, n), "levels")
            a, c = attach_groups(a, table, [k]), attach_groups(c, table, [k])
        weights = [F.coalesce(f"__w_{k}", F.lit(1.0)) for k in cats]
    elif kind == "idf_clip":
        means = fit.row(a, n=F.count(F.lit(1)), **{k: F.avg(k) for k in numeric})
        factor = {k: min(max(idf(means[k]), 0.5), 3.0) for k in numeric}
        for k in cats:
            table = materialize(share_weight(a, k, means["n"]), "levels")
            a, c = attach_groups(a, table, [k]), attach_groups(c, table, [k])
        # a level A never shows has an all-zero column in A: mean 0, so the upper clip
        weights = [F.coalesce(F.least(F.greatest(f"__w_{k}", F.lit(0.5)), F.lit(3.0)), F.lit(3.0)) for k in cats]
    elif kind == "robust":
        both = a.select(*cats).unionByName(c.select(*cats))
        for k in cats:
            table = fit.level_table(both, k)
            if table.limit(31).count() > 30:
                top = [r["level"] for r in table.orderBy(F.col("n").desc(), "level").limit(20).collect()]
                fold = F.when(F.col(k).isin(top), F.col(k)).otherwise("__rest__")
                a, c = a.withColumn(k, fold), c.withColumn(k, fold)
    num = [F.col(k) * factor.get(k, 1.0) for k in numeric]
    codes, _ = _codes(cats)
    return (_vector(a, a_id, num, codes, weights, extra), _vector(c, c_id, num, codes, weights, extra))


def encode_vectors(df: DataFrame, vec: str, row_id: str) -> DataFrame:
    """Matching vectors from an existing array column."""
    return df.select(F.col(row_id).alias("id"), F.col(vec).cast("array<double>").alias("num"),
                     F.array().cast("array<bigint>").alias("cat"),
                     F.array().cast("array<double>").alias("w"))


def unit_rows(enc: DataFrame) -> DataFrame:
    """Scale every vector to Euclidean length 1 (cosine then equals L2)."""
    def squares(col: str) -> Column:
        return F.aggregate(col, F.lit(0.0), lambda s, x: s + x * x)

    norm = F.sqrt(squares("num") + squares("w")) + 1e-12
    return enc.withColumn("__n", norm).withColumns({
        "num": F.transform("num", lambda x: x / F.col("__n")),
        "w": F.transform("w", lambda x: x / F.col("__n"))}).drop("__n")
