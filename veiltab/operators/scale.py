"""Scaling, bucketing and imputing with fitted parameters."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veiltab.functions.clean import norm_flag, range_clip
from veiltab.operators import fit
from veiltab.operators.joins import attach_groups, keyed_join
from veiltab.operators.ranks import exact_quantiles


def _num(c: str) -> Column:
    return F.col(c).cast("double")


def minmax_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - min) / (max - min); constant columns become 0."""
    got = fit.ranges(df, cols)
    out = {}
    for c, (lo, hi) in got.items():
        flat = lo is None or lo == hi
        out[c] = _num(c) * 0.0 if flat else (_num(c) - float(lo)) / (float(hi) - float(lo))
    return df.withColumns(out)


def minmax_scale_pair(a: DataFrame, c: DataFrame, cols: list[str]):
    """Scale both tables by A's range; drop columns of zero range; null takes A's scaled median."""
    rng = {k: v for k, v in fit.ranges(a, cols).items() if v[0] is not None and v[0] != v[1]}
    med = fit.medians(a, list(rng))

    def scaled(k):
        lo, hi = map(float, rng[k])
        return F.coalesce((_num(k) - lo) / (hi - lo), F.lit((med[k] - lo) / (hi - lo)))

    exprs = {k: scaled(k) for k in rng}
    return a.withColumns(exprs), c.withColumns(exprs), list(rng)


def zscore_winsor_pair(a: DataFrame, c: DataFrame, cols: list[str]):
    """Clip A to its 1st..99th percentile, fill with its median, standardise (population std)
    and apply A's parameters to C, which is not clipped."""
    q = fit.quantiles(a, cols, {"lo": 0.01, "mid": 0.5, "hi": 0.99})
    clipped = {k: F.coalesce(range_clip(_num(k), q[k]["lo"], q[k]["hi"]), F.lit(q[k]["mid"])) for k in q}
    a2 = a.withColumns(clipped)
    m = fit.row(a2, **{f"m_{k}": F.avg(k) for k in q}, **{f"s_{k}": F.stddev_pop(k) for k in q})
    std = {k: (F.coalesce(_num(k), F.lit(q[k]["mid"])) - m[f"m_{k}"])
           / (m[f"s_{k}"] if m[f"s_{k}"] else 1.0) for k in q}
    return a2.withColumns(std), c.withColumns(std)


def robust_scale_pair(a: DataFrame, c: DataFrame, cols: list[str]):
    """(x - median) / IQR with both taken on A and C together; degenerate IQR falls back to
    std + 1e-6, and any scale <= 1e-6 to 1. Null takes the median."""
    both = a.select(*cols).unionByName(c.select(*cols))
    q = fit.quantiles(both, cols, {"q1": 0.25, "mid": 0.5, "q3": 0.75})
    sd = fit.row(both, **{k: F.stddev_pop(_num(k)) for k in q})
    out = {}
    for k in q:
        scale = q[k]["q3"] - q[k]["q1"]
        scale = scale if scale > 1e-6 else (sd[k] or 0.0) + 1e-6
        scale = scale if scale > 1e-6 else 1.0
        out[k] = (F.coalesce(_num(k), F.lit(q[k]["mid"])) - q[k]["mid"]) / scale
    return a.withColumns(out), c.withColumns(out)


def standardise_pair(a: DataFrame, c: DataFrame, cols: list[str]):
    """(x - mean_A) / (std_A + 1e-8) after unparsable values became 0."""
    zero = {k: F.coalesce(_num(k), F.lit(0.0)) for k in cols}
    m = fit.row(a.select(*[e.alias(k) for k, e in zero.items()]),
                **{f"m_{k}": F.avg(k) for k in cols}, **{f"s_{k}": F.stddev_pop(k) for k in cols})
    out = {k: (zero[k] - m[f"m_{k}"]) / (m[f"s_{k}"] + 1e-8) for k in cols}
    return a.withColumns(out), c.withColumns(out)


def unit_rescale(df: DataFrame, c: str, out: str | None = None) -> DataFrame:
    """(x - min) / (max - min + 1e-12)."""
    ends = df.agg(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi"))).scalar()
    lo, hi = ends.getField("lo"), ends.getField("hi")
    return df.withColumn(out or c, (F.col(c) - lo) / (hi - lo + 1e-12))


def quantile_edges(df: DataFrame, c: str, q: int = 5) -> list[float]:
    """Inner and outer quantile edges without duplicates."""
    got = fit.quantiles(df, [c], {f"e{i}": i / q for i in range(q + 1)})
    return sorted({got[c][f"e{i}"] for i in range(q + 1)}) if c in got else []


def quantile_bucket(c: str, edges: list[float], missing: str = "__miss__") -> Column:
    """Right-closed quantile bin as text; null or outside becomes ``missing``."""
    if len(edges) < 2:
        return F.lit(missing)
    x = _num(c)
    out = F.lit(missing)
    for i in reversed(range(len(edges) - 1)):
        low = (x >= edges[0]) if i == 0 else (x > edges[i])
        out = F.when(low & (x <= edges[i + 1]), F.lit(f"q{i}")).otherwise(out)
    return F.coalesce(out, F.lit(missing))


def coarsen_rare_levels(df: DataFrame, c: str, min_count: int = 50, other: str = "other") -> DataFrame:
    """Levels with fewer than ``min_count`` rows become one level.

    Only the frequent levels are joined back: there are at most rows / min_count of them,
    and no row is lost when the table is too big to broadcast.
    """
    keep = (df.groupBy(F.col(c).alias("__lv")).agg(F.count(F.lit(1)).alias("__n"))
            .filter(F.col("__n") >= min_count).select("__lv"))
    return (attach_groups(df.withColumn("__lv", F.col(c)), keep.withColumn("__kept", F.lit(True)), ["__lv"])
            .withColumn(c, F.when(F.col("__kept") & F.col(c).isNotNull(), F.col(c)).otherwise(other))
            .drop("__lv", "__kept"))


def group_medians(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """(keys, __size, one median per column as __m_column): all columns in one long-form job."""
    long = df.select(*keys, *[_num(c).alias(c) for c in cols]).unpivot(keys, cols, "column", "value")
    med = exact_quantiles(long, [*keys, "column"], "value", {"m": 0.5})
    wide = med.groupBy(*keys).agg(*[F.max(F.when(F.col("column") == c, F.col("m"))).alias(f"__m_{c}") for c in cols])
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
    return keyed_join(size, wide, keys, "left")


def group_median_impute(df: DataFrame, limits: dict[str, tuple], keys: list[str], integer: bool = True) -> DataFrame:
    """Out-of-range or null -> group median -> global median -> lower limit; then round and clip."""
    cols = list(limits)
    base = df.withColumns({c: F.when(_num(c).between(lo, hi), _num(c)) for c, (lo, hi) in limits.items()})
    mid = fit.medians(base, cols)
    known = group_medians(base, keys, cols).drop("__size").dropna(subset=keys)  # rows without a key take the global median
    out = attach_groups(base, known, keys)
    fills = {}
    for c, (lo, hi) in limits.items():
        x = F.coalesce(F.col(c), F.col(f"__m_{c}"), F.lit(mid[c]).cast("double"), F.lit(float(lo)))
        fills[c] = range_clip(F.bround(x) if integer else x, float(lo), float(hi))
    return out.withColumns(fills).select(*df.columns)


def hierarchical_impute(df: DataFrame, cols: list[str], tiers: list[list[str]], min_size: int,
                        limits: dict[str, tuple] | None = None) -> DataFrame:
    """Fill nulls (and out-of-range values when limits are given) with the median of the
    finest key tier whose group has at least ``min_size`` rows, then the global median, then 0.

    All tiers read observed values only, so they are independent joins in one pass.
    """
    def seen(c: str) -> Column:
        return F.when(_num(c).between(*limits[c]), _num(c)) if limits and c in limits else _num(c)

    base = df.withColumns({c: seen(c) for c in cols})
    mid = fit.medians(base, cols)
    out, fills = base, {c: [F.col(c)] for c in cols}
    for i, keys in enumerate(t for t in tiers if t):
        g = group_medians(base, keys, cols).filter(F.col("__size") >= min_size).select(
            *keys, *[F.col(f"__m_{c}").alias(f"__t{i}_{c}") for c in cols])
        out = attach_groups(out, g, keys)
        for c in cols:
            fills[c].append(F.col(f"__t{i}_{c}"))
    exprs = {}
    for c in cols:
        x = F.coalesce(*fills[c], F.lit(mid[c] if mid[c] is not None else 0.0))
        exprs[c] = range_clip(x, *map(float, limits[c])) if limits and c in limits else x
    return out.withColumns(exprs).select(*df.columns)


def format_release(df: DataFrame, integers: list[str], decimals: dict[str, int],
                   categories: list[str], flags: list[str],
                   limits: dict[str, tuple] | None = None) -> DataFrame:
    """Publishable types: medians for missing numbers (half-even rounding), modes for missing
    categories, invalid flags to 0, limits clipped."""
    nums = [*integers, *decimals]
    med, mode = fit.medians(df, nums), fit.modes(df, categories) if categories else {}
    out = {}
    for c in nums:
        v = F.coalesce(_num(c), F.lit(med[c] if med[c] is not None else 0.0))
        if limits and c in limits:
            v = range_clip(v, float(limits[c][0]), float(limits[c][1]))
        out[c] = F.bround(v).cast("int") if c in integers else F.bround(v, decimals[c])
    for c in categories:
        blank = F.col(c).isNull() | (F.trim(c) == "")
        out[c] = F.when(blank, F.lit(mode[c])).otherwise(F.col(c))
    for c in flags:
        out[c] = F.coalesce(norm_flag(c), F.lit(0))
    return df.withColumns(out)


def clip_to_range_by_bin_mean(df: DataFrame, c: str, bin_: Column, lo: float, hi: float) -> DataFrame:
    """Values outside [lo, hi] take the mean of their bin's valid values, else the median."""
    ok = F.when(_num(c).between(lo, hi), _num(c))
    base = df.withColumns({"__bin": bin_, "__ok": ok})
    means = {r[0]: r[1] for r in base.groupBy("__bin").agg(F.avg("__ok")).collect()
             if r[0] is not None and r[1] is not None}
    mid = fit.medians(base, ["__ok"])["__ok"]
    fill = F.coalesce(fit.lookup(F.col("__bin"), means), F.lit(mid).cast("double"))
    return base.withColumn(c, F.coalesce("__ok", F.bround(fill))).drop("__bin", "__ok")
