"""Descriptive statistics with fixed output shapes."""
from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veiltab.operators.joins import group_name
from veiltab.operators.ranks import column_quantiles, exact_quantiles, long_values
from veiltab.schema import level_grid

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def moments(long: DataFrame, keys: list[str]) -> DataFrame:
    """n, mean, std (n-1), min, max per key of a (keys, value) table."""
    return long.groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.when(F.count("value") > 1, F.stddev_samp("value")).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))


def value_ranges(df: DataFrame, cols: list[str]) -> DataFrame:
    """min and max per column in one pass."""
    one = df.agg(F.array(*[F.struct(
        F.lit(c).alias("column"), F.min(F.col(c).cast("double")).alias("lo"),
        F.max(F.col(c).cast("double")).alias("hi")) for c in cols]).alias("x"))
    return one.select(F.inline("x"))


def _scaled(stat: str, lo="lo", hi="hi", spread=False) -> Column:
    flat = F.col(hi) == F.col(lo)
    top = F.col(stat) if spread else F.col(stat) - F.col(lo)
    return F.when(flat, F.col(stat) * 0.0).otherwise(top / F.nullif(F.col(hi) - F.col(lo), F.lit(0.0)))


def describe_scaled(df: DataFrame, cols: list[str]) -> DataFrame:
    """mean, std and quartiles of min-max-scaled columns.

    Scaling is affine, so the statistics are taken on the raw values and mapped afterwards.
    """
    long = long_values(df, cols)
    q = exact_quantiles(long, ["column"], "value", QUARTILES)
    m = moments(long, ["column"]).withColumnsRenamed({"min": "lo", "max": "hi"})
    return m.join(q, "column", "left").select(
        "column", _scaled("mean").alias("mean"), _scaled("std", spread=True).alias("std"),
        *[_scaled(p).alias(p) for p in QUARTILES])


def level_cube(df: DataFrame, cats: list[str]) -> DataFrame:
    """Counts per combination of all categories: the only pass over the rows that the
    ratio and cross-table operators need."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in cats]).groupBy(*cats).agg(
        F.count(F.lit(1)).alias("n"))


def category_ratio(df: DataFrame, levels: dict[str, list]) -> DataFrame:
    """Share of all rows per configured level; levels never seen give 0."""
    cats = list(levels)
    cube = level_cube(df, cats)
    total = df.agg(F.count(F.lit(1))).scalar()
    seen = (cube.unpivot(["n"], cats, "column", "level")
            .groupBy("column", "level").agg(F.sum("n").alias("n")))
    return level_grid(df, levels).join(seen, ["column", "level"], "left").select(
        "column", "level", F.coalesce("n", F.lit(0)).alias("n"),
        (F.coalesce("n", F.lit(0)) / total).alias("ratio"))


def crosstab_ratio(df: DataFrame, levels: dict[str, list]) -> DataFrame:
    """All category pairs on the configured grid as shares of all rows.

    One map-side-combined pass builds the combination counts; the pairs are expanded from
    that small table. Rows with a null in a pair are left out of it but stay in the divisor.
    """
    cats = list(levels)
    cube = level_cube(df, cats)
    total = df.agg(F.count(F.lit(1))).scalar()
    pairs = list(combinations(cats, 2))
    cells = F.array(*[F.struct(
        F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
        F.col(a).alias("level_a"), F.col(b).alias("level_b")) for a, b in pairs])
    seen = (cube.select("n", F.inline(cells))
            .groupBy("col_a", "col_b", "level_a", "level_b").agg(F.sum("n").alias("n")))
    grid = df.sparkSession.createDataFrame(
        [(a, b, str(x), str(y)) for a, b in pairs for x in levels[a] for y in levels[b]],
        "col_a string, col_b string, level_a string, level_b string")
    return grid.join(seen, ["col_a", "col_b", "level_a", "level_b"], "left").withColumns({
        "n": F.coalesce("n", F.lit(0)), "ratio": F.coalesce("n", F.lit(0)) / total})


def group_describe(df: DataFrame, levels: dict[str, list], cols: list[str]) -> DataFrame:
    """Category level x numeric column x {mean, std, quartiles} of scaled values, fixed levels."""
    cats = list(levels)
    long = long_values(df.select(*[F.col(c).cast("string").alias(c) for c in cats], *cols),
                       cols, ids=cats)
    pick = F.array(*[F.struct(F.lit(c).alias("cat"), F.col(c).alias("level")) for c in cats])
    cells = long.select("column", "value", F.inline(pick)).filter(F.col("level").isNotNull())
    keys = ["cat", "level", "column"]
    stats = moments(cells, keys).drop("min", "max").join(
        exact_quantiles(cells, keys, "value", QUARTILES), keys, "left")
    grid = level_grid(df, levels).withColumnRenamed("column", "cat").select(
        "cat", "level", F.explode(F.array(*[F.lit(c) for c in cols])).alias("column"))
    full = grid.join(stats, keys, "left").join(F.broadcast(value_ranges(df, cols)), "column")
    return full.select(*keys, _scaled("mean").alias("mean"), _scaled("std", spread=True).alias("std"),
                       *[_scaled(p).alias(p) for p in QUARTILES])


def pearson_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise-complete correlations; null where a column is constant."""
    x = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    pairs = F.array(*[
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                 F.col(a).alias("x"), F.col(b).alias("y"))
        for i, a in enumerate(cols) for b in cols[i:]])
    half = (
        x.select(F.inline(pairs))
        .groupBy("col_a", "col_b")
        .agg(F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).alias("n"),
             F.try_divide(
                 F.covar_pop("x", "y"),
                 F.stddev_pop(F.when(F.col("y").isNotNull(), F.col("x")))
                 * F.stddev_pop(F.when(F.col("x").isNotNull(), F.col("y")))).alias("corr"))
    )
    both = F.array(F.struct("col_a", "col_b"), F.struct(F.col("col_b").alias("col_a"),
                                                        F.col("col_a").alias("col_b")))
    return half.select(F.inline(F.array_distinct(both)), "n", "corr")


def value_share(df: DataFrame, c: str) -> DataFrame:
    """Count and percentage per level."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.groupBy(F.col(c).alias("level")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "pct", F.col("n") * 100.0 / total)


def min_max_mean(df: DataFrame, cols: list[str]) -> DataFrame:
    one = df.agg(F.array(*[F.struct(
        F.lit(c).alias("column"), F.min(F.col(c).cast("double")).alias("min"),
        F.max(F.col(c).cast("double")).alias("max"),
        F.avg(F.col(c).cast("double")).alias("mean")) for c in cols]).alias("x"))
    return one.select(F.inline("x"))


def group_mean(df: DataFrame, key: str | Column, cols: list[str]) -> DataFrame:
    k = F.col(key) if isinstance(key, str) else key
    return df.groupBy(k.alias("group")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"avg_{c}") for c in cols])


def flag_prevalence(df: DataFrame, flags: list[str]) -> DataFrame:
    one = df.agg(F.array(*[F.struct(
        F.lit(c).alias("flag"), F.coalesce(F.sum(c), F.lit(0)).cast("long").alias("n_ones"),
        F.try_divide(F.sum(c), F.count(F.lit(1))).alias("share")) for c in flags]).alias("x"))
    return one.select(F.inline("x"))


def range_summary(df: DataFrame, ranges: dict[str, tuple[float, float]],
                  by: str | None = None) -> DataFrame:
    """Inside/outside counts and min, max, mean, std, median per measure, optionally by band."""
    ids = [by] if by else []
    keys = ["column", *ids]
    long = long_values(df, list(ranges), ids)
    inside = F.lit(None).cast("boolean")
    for c, (lo, hi) in ranges.items():
        inside = F.when(F.col("column") == c, F.col("value").between(lo, hi)).otherwise(inside)
    counts = long.withColumn("ok", inside).groupBy(*keys).agg(
        F.count_if("ok").alias("n_normal"), F.count_if(~F.col("ok")).alias("n_abnormal"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"),
        F.when(F.count("value") > 1, F.stddev_samp("value")).alias("std"))
    med = exact_quantiles(long, keys, "value", {"median": 0.5})
    return counts.join(med.drop("n_valid"), keys, "left").withColumn(
        "abnormal_rate", F.try_divide(F.col("n_abnormal"), F.col("n_normal") + F.col("n_abnormal")))


def range_rate_by_band(df: DataFrame, checks: dict[str, Column], band: Column) -> DataFrame:
    """Counts of true/false per check and band, and the abnormal rate."""
    cells = F.array(*[F.struct(F.lit(n).alias("column"), e.alias("ok")) for n, e in checks.items()])
    return (df.select(band.alias("band"), F.inline(cells)).filter(F.col("ok").isNotNull())
            .groupBy("column", "band")
            .agg(F.count_if("ok").alias("n_true"), F.count_if(~F.col("ok")).alias("n_false"))
            .withColumn("abnormal_rate", F.col("n_false") / (F.col("n_true") + F.col("n_false"))))


def distribution_shape(df: DataFrame, cols: list[str]) -> DataFrame:
    """Bias-adjusted skewness and excess kurtosis, and the coefficient of variation."""
    long = long_values(df, cols).filter(F.col("value").isNotNull())
    n = F.col("n").cast("double")
    base = long.groupBy("column").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.when(F.count("value") > 1, F.stddev_samp("value")).alias("std"),
        F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2"))
    return base.select(
        "column",
        F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.col("g1")).alias("skew"),
        F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)).alias("kurtosis"),
        F.try_divide("std", "mean").alias("cv"))


def histogram(df: DataFrame, c: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between the column's min and max (the last bin is closed)."""
    x = df.select(F.col(c).cast("double").alias("v")).filter(F.col("v").isNotNull())
    ends = x.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"))).scalar()
    lo, hi = ends.getField("lo"), ends.getField("hi")
    width = (hi - lo) / bins
    idx = F.when(hi == lo, 0).otherwise(
        F.least(F.floor((F.col("v") - lo) * bins / F.nullif(hi - lo, F.lit(0.0))), F.lit(bins - 1)))
    counts = x.groupBy(idx.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin", (lo + F.col("bin") * width).alias("left_edge"), F.coalesce("n", F.lit(0)).alias("n"))


def zero_share(df: DataFrame, cols: list[str]) -> DataFrame:
    one = df.agg(F.array(*[F.struct(
        F.lit(c).alias("column"), F.count_if(F.col(c) == 0).alias("n_zero"),
        F.try_divide(F.count_if(F.col(c) == 0), F.count(F.lit(1))).alias("share"))
        for c in cols]).alias("x"))
    return one.select(F.inline("x"))


def uniqueness_ratio(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct values / rows per column, through one value histogram of all columns."""
    total = df.agg(F.count(F.lit(1))).scalar()
    text = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], cols, "column", "value")
    return (text.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.lit(1).alias("one"))
            .groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
            .withColumn("ratio", F.col("n_unique") / total))


def quasi_id_uniqueness(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct combinations of the quasi-identifiers, their share, and unique rows."""
    combos = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return combos.agg(F.count(F.lit(1)).alias("n_combinations"), F.sum("n").alias("n_rows"),
                      F.count_if(F.col("n") == 1).alias("n_singletons")).withColumn(
        "ratio", F.try_divide("n_combinations", "n_rows"))


def level_entropy(df: DataFrame, cols: list[str]) -> DataFrame:
    """Shannon entropy (nats) of the level shares per column."""
    hist = (df.select(*[F.col(c).cast("string").alias(c) for c in cols])
            .unpivot([], cols, "column", "level").filter(F.col("level").isNotNull())
            .groupBy("column", "level").agg(F.count(F.lit(1)).alias("n")))
    # H = ln N - (1/N) sum n ln n, so the total needs no second pass
    n = F.sum("n").cast("double")
    return hist.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_levels"),
        (F.log(n) - F.sum(F.col("n") * F.log(F.col("n").cast("double"))) / n).alias("entropy"))


def iqr_outliers(df: DataFrame, cols: list[str], k: float = 1.5) -> DataFrame:
    """Values outside [Q1 - k IQR, Q3 + k IQR] per column."""
    q = column_quantiles(df, cols, {"q1": 0.25, "q3": 0.75}).drop("n_valid")
    iqr = F.col("q3") - F.col("q1")
    out = (F.col("value") < F.col("q1") - k * iqr) | (F.col("value") > F.col("q3") + k * iqr)
    total = df.agg(F.count(F.lit(1))).scalar()
    return (long_values(df, cols).join(F.broadcast(q), "column").groupBy("column")
            .agg(F.first("q1").alias("q1"), F.first("q3").alias("q3"), F.count_if(out).alias("n_outliers"))
            .withColumn("share", F.col("n_outliers") / total))


def group_sizes_by_tier(df: DataFrame, tiers: list[list[str]]) -> DataFrame:
    """Smallest group and number of groups of every key tier, in one job.

    The finest combination is counted once; tiers are rolled up from that table.
    """
    cols = sorted({c for t in tiers for c in t})
    cube = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    keys = F.array(*[F.struct(
        F.lit(i).alias("tier"),
        group_name(t).alias("key"))
        for i, t in enumerate(tiers)])
    return (cube.select("n", F.inline(keys)).groupBy("tier", "key").agg(F.sum("n").alias("n"))
            .groupBy("tier").agg(F.min("n").alias("smallest"), F.count(F.lit(1)).alias("n_groups")))


def group_size_relax(df: DataFrame, tiers: list[list[str]], k_min: int) -> list[str]:
    """First key tier whose every group has at least ``k_min`` rows, else the last tier."""
    sizes = {r["tier"]: r["smallest"] for r in group_sizes_by_tier(df, tiers).collect()}
    return next((t for i, t in enumerate(tiers) if sizes.get(i, 0) >= k_min), tiers[-1])


def table_overview(df: DataFrame, row_id: str, n: int = 5) -> DataFrame:
    """First rows in id order, each with the table's row and column counts."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.orderBy(row_id).limit(n).withColumns(
        {"n_rows": total, "n_columns": F.lit(len(df.columns)).cast("long")})


def before_after_report(before: DataFrame, after: DataFrame, cols: list[str],
                        cats: list[str]) -> DataFrame:
    """Column means and level shares before and after, with the change in percent."""
    def side(df: DataFrame, name: str) -> DataFrame:
        total = df.agg(F.count(F.lit(1))).scalar()
        num = min_max_mean(df, cols).select(
            "column", F.lit("mean").alias("item"), F.col("mean").alias(name))
        cat = (df.select(*[F.col(c).cast("string").alias(c) for c in cats])
               .unpivot([], cats, "column", "item")
               .filter(F.col("item").isNotNull()).groupBy("column", "item")
               .agg(F.count(F.lit(1)).alias("n")).select("column", "item", (F.col("n") / total).alias(name)))
        return num.unionByName(cat)

    both = side(before, "before").join(side(after, "after"), ["column", "item"], "full_outer")
    return both.withColumn("change_pct", F.try_divide((F.col("after") - F.col("before")) * 100.0,
                                                      F.abs("before")))


def utility_diff(before: DataFrame, after: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Mean and max absolute difference of two statistic tables; absent cells count as 0."""
    b = before.select(*keys, *[F.col(c).alias(f"b_{c}") for c in cols])
    a = after.select(*keys, *[F.col(c).alias(f"a_{c}") for c in cols])
    both = b.join(a, keys, "full_outer")
    d = {c: F.abs(F.coalesce(f"a_{c}", F.lit(0.0)) - F.coalesce(f"b_{c}", F.lit(0.0))) for c in cols}
    one = both.agg(F.array(*[F.struct(F.lit(c).alias("stat"), F.avg(e).alias("mean_abs_diff"),
                                      F.max(e).alias("max_abs_diff")) for c, e in d.items()]).alias("x"))
    return one.select(F.inline("x"))


def value_set_equal(before: DataFrame, after: DataFrame, c: str) -> DataFrame:
    """Values present on one side only; equal sets give zero on both counts."""
    b, a = before.select(c).distinct(), after.select(c).distinct()
    lost = b.exceptAll(a).agg(F.count(F.lit(1)).alias("n_lost"))
    new = a.exceptAll(b).agg(F.count(F.lit(1))).scalar()
    return lost.withColumn("n_new", new).withColumn(
        "equal", ((F.col("n_lost") == 0) & (F.col("n_new") == 0)).cast("int"))
