"""Small fitted parameters: a few numbers per column or per bounded level, taken to the
driver once and used as literals.

Fitting on the driver keeps a recipe of many steps a chain of narrow projections; a lazy
sub-plan per step would double the plan with every step.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veiltab.operators.ranks import exact_quantiles, long_values


def row(df: DataFrame, **aggs: Column) -> dict:
    """One-row aggregate as a dict."""
    return df.agg(*[e.alias(n) for n, e in aggs.items()]).first().asDict()


def ranges(df: DataFrame, cols: list[str]) -> dict[str, tuple]:
    """Observed (min, max) per column."""
    got = row(df, **{f"lo_{c}": F.min(c) for c in cols}, **{f"hi_{c}": F.max(c) for c in cols})
    return {c: (got[f"lo_{c}"], got[f"hi_{c}"]) for c in cols}


def quantiles(df: DataFrame, cols: list[str], probs: dict[str, float]) -> dict[str, dict]:
    """Exact quantiles per column."""
    got = exact_quantiles(long_values(df, cols), ["column"], "value", probs).collect()
    return {r["column"]: r.asDict() for r in got}


def medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    got = quantiles(df, cols, {"m": 0.5})
    return {c: got[c]["m"] if c in got else None for c in cols}


def modes(df: DataFrame, cols: list[str]) -> dict[str, str | None]:
    """Most frequent non-blank level per column; ties go to the smallest level."""
    hist = (df.select(*[F.col(c).cast("string").alias(c) for c in cols])
            .unpivot([], cols, "column", "level")
            .filter(F.col("level").isNotNull() & (F.trim("level") != ""))
            .groupBy("column", "level").agg(F.count(F.lit(1)).alias("n")))
    best = hist.groupBy("column").agg(F.min(F.struct(-F.col("n"), F.col("level").alias("level"))).alias("b"))
    got = {r["column"]: r["level"] for r in best.select("column", "b.level").collect()}
    return {c: got.get(c) for c in cols}


def level_table(df: DataFrame, c: str) -> DataFrame:
    """``level, n`` of the non-blank levels, one row each; the set may be of any size."""
    return (df.filter(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""))
            .groupBy(F.col(c).alias("level")).agg(F.count(F.lit(1)).alias("n")))


def level_counts(df: DataFrame, c: str) -> list[tuple[str, int]]:
    """(level, count) of the non-blank levels in level order, for columns that become one output column per level."""
    return sorted((r[0], r[1]) for r in level_table(df, c).collect())


def lookup(key: Column, table: dict, default=None) -> Column:
    """Map a bounded set of key values to literals."""
    out = F.lit(default)
    if not table:
        return out
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    got = F.element_at(F.create_map(*pairs), key)
    return got if default is None else F.coalesce(got, out)
