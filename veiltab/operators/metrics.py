"""Scores of a probabilistic classifier's output."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veiltab.operators.ranktest import area_under_curve


def neg_log_lik(y: str | Column = "y", p: str | Column = "p", eps: float = 1e-12) -> Column:
    y = F.col(y) if isinstance(y, str) else y
    p = F.col(p) if isinstance(p, str) else p
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def classification_metrics(df: DataFrame, y: str = "y", p: str = "p", thr: float = 0.5) -> DataFrame:
    """Accuracy at a threshold, AUC and log-loss."""
    base = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(((F.col(p) >= thr).cast("int") == F.col(y)).cast("double")).alias("accuracy"),
        F.avg(neg_log_lik(y, p, 1e-15)).alias("logloss"))
    return base.withColumn("auc", area_under_curve(df, y, p).scalar())


def confidence_metrics(df: DataFrame, split: str, y: str = "y", p: str = "p",
                       alpha: float = 0.1) -> DataFrame:
    """Confidence summary per split: mean max(p, 1-p), share of extreme p, penalised loss."""
    c = F.col(p)
    return df.groupBy(split).agg(
        F.avg(F.greatest(c, 1 - c)).alias("mean_conf"),
        F.avg(((c > 0.99) | (c < 0.01)).cast("double")).alias("extreme_share"),
        F.avg(neg_log_lik(y, p)).alias("nll"),
        (F.avg(neg_log_lik(y, p)) + alpha * F.avg(F.abs(c - 0.5))).alias("penalised_loss"))


def confidence_gap(df: DataFrame, split: str, first: str, second: str, p: str = "p") -> DataFrame:
    """Mean confidence of one split minus that of another."""
    conf = F.greatest(F.col(p), 1 - F.col(p))
    return df.agg(
        (F.avg(F.when(F.col(split) == first, conf)) - F.avg(F.when(F.col(split) == second, conf)))
        .alias("confidence_gap"))


def is_binary(df: DataFrame, c: str, lenient: bool = False) -> DataFrame:
    """One row: is the column non-empty and made of exact 0/1 only?

    Strict counts blanks as violations; lenient sets aside '', 'nan' and 'none' first.
    """
    t = F.lower(F.trim(F.col(c).cast("string")))
    blank = t.isNull() | t.isin("", "nan", "none")
    good = F.coalesce(t.try_cast("double").isin(0.0, 1.0), F.lit(False))
    kept = F.when(~blank, 1) if lenient else F.lit(1)
    bad = F.count_if(~good & ~blank) if lenient else F.count_if(~good)
    return df.agg(F.count(kept).alias("n"), bad.alias("n_bad")).withColumn(
        "is_binary", ((F.col("n") > 0) & (F.col("n_bad") == 0)).cast("int"))
