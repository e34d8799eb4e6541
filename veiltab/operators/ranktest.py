"""Kruskal-Wallis family over many metrics in one job."""
from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veiltab.functions.special import minus_log10_p, squash_log10_p
from veiltab.operators.ranks import cumulative_counts, running_counts

# Output columns of the rank-test table, in order.
EFFECTS = ["H_norm", "minus_log10_p_norm", "epsilon2", "eta2_kw", "rank_eta2",
           "A_pair_avg", "A_pair_sym"]


def _clip01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def _sum_all(cols: list[Column]) -> Column:
    out = F.lit(0)
    for c in cols:
        out = out + c
    return out


def h_max(counts: list[Column]) -> Column:
    """Largest H reachable without ties for the given group sizes (empty groups skipped)."""
    n = _sum_all(counts).cast("double")
    before, ssb = F.lit(0.0), F.lit(0.0)
    for c in counts:
        gap = before + (c + 1) / 2.0 - (n + 1) / 2.0
        ssb = ssb + F.when(c > 0, c * gap * gap).otherwise(0.0)
        before = before + c
    return F.when(n > 1, 12.0 / (n * (n + 1)) * ssb).otherwise(0.0)


def kruskal_wallis(df: DataFrame, metrics: list[str], group: Column, labels: list[str],
                   min_per_group: int = 2, p_norm: str = "arctan", p_scale: float = 10.0,
                   p_cap: float = 300.0, keep_missing: bool = False,
                   row_id: str = "row_id") -> DataFrame:
    """Rank test of every metric across the labelled groups, one output row per metric.

    A value histogram per metric carries one count per group, so mid-ranks, tie
    correction, rank variance and all pairwise P(x > y) come from the same running counts;
    rows are shuffled once, already combined by value. ``keep_missing`` keeps null plus a
    note where a metric has fewer than two usable groups (instead of zeros) and adds the
    group sizes as text.
    """
    k = len(labels)
    cells = F.array(*[F.struct(F.lit(m).alias("metric"),
                               F.col(m).try_cast("double").alias("value")) for m in metrics])
    # a plain column: referring to the array twice must not expand rows twice
    long = (df.select(group.alias("g"), F.inline(cells))
            .filter(F.col("g").isNotNull() & F.col("value").isNotNull()))
    names = [f"c{i}" for i in range(k)]
    hist = long.groupBy("metric", "value").agg(
        *[F.count_if(F.col("g") == lab).alias(c) for c, lab in zip(names, labels)])
    sizes = hist.groupBy("metric").agg(*[F.sum(c).alias(f"s{i}") for i, c in enumerate(names)])
    used = hist.join(F.broadcast(sizes), "metric").withColumns({
        c: F.when(F.col(f"s{i}") >= min_per_group, F.col(c)).otherwise(0)
        for i, c in enumerate(names)}).withColumn("n", _sum_all([F.col(c) for c in names]))
    used = used.filter(F.col("n") > 0).select("metric", "value", "n", *names)
    cum = running_counts(used, "metric", "value", ["n", *names]).withColumn(
        "r", F.col("n_before") + (F.col("n") + 1) / 2.0)
    t = F.col("n").cast("double")
    wins = [F.sum(F.col(a) * (F.col(f"{b}_before") + F.col(b) / 2.0)).alias(f"w_{a}_{b}")
            for a, b in combinations(names, 2)]
    tot = cum.groupBy("metric").agg(
        F.max("n_total").cast("double").alias("N"), F.sum(t * t * t - t).alias("ties"),
        F.sum(t * F.col("r") * F.col("r")).alias("rr"),
        *[F.max(f"{c}_total").alias(f"n_{c}") for c in names],
        *[F.sum(F.col(c) * F.col("r")).alias(f"r_{c}") for c in names], *wins)
    N = F.col("N")
    ns = [F.col(f"n_{c}") for c in names]
    mean_rank = (N + 1) / 2.0
    ssb = _sum_all([F.when(n > 0, F.col(f"r_{c}") * F.col(f"r_{c}") / n).otherwise(0.0)
                    for c, n in zip(names, ns)]) - N * mean_rank * mean_rank
    sst = F.col("rr") - N * mean_rank * mean_rank
    k_used = _sum_all([(n > 0).cast("int") for n in ns])
    pairs = list(combinations(names, 2))
    weight = {p: F.col(f"n_{p[0]}") * F.col(f"n_{p[1]}") for p in pairs}
    win = {p: F.col(f"w_{p[0]}_{p[1]}") for p in pairs}
    w_sum = _sum_all(list(weight.values()))
    sym = _sum_all([2.0 * F.abs(win[p] - 0.5 * weight[p]) for p in pairs])
    tie = 1.0 - F.col("ties") / F.nullif(N * N * N - N, F.lit(0.0))
    step = tot.select(
        "metric", "N", k_used.alias("k_used"), tie.alias("tie"), h_max(ns).alias("h_max"),
        ssb.alias("ssb"), sst.alias("sst"), w_sum.alias("w_sum"),
        _sum_all(list(win.values())).alias("w_win"), sym.alias("w_sym"))
    step = step.withColumns({
        "dof": F.col("k_used") - 1,
        "H": F.when(F.col("k_used") >= 2,
                    F.try_divide(12.0 / (N * (N + 1)) * F.col("ssb"), F.col("tie")))})
    H, dof, ok = F.col("H"), F.col("dof"), F.col("H").isNotNull()
    step = step.withColumn("mlog10p", minus_log10_p(H, dof))
    out = step.select(
        "metric",
        F.when(ok, F.when(F.col("h_max") > 0, _clip01(H / F.col("h_max"))).otherwise(0.0)).alias("H_norm"),
        F.when(ok, squash_log10_p(F.col("mlog10p"), p_norm, p_scale, p_cap)).alias("minus_log10_p_norm"),
        F.when(ok, F.when(N > dof, _clip01((H - dof) / (N - dof))).otherwise(0.0)).alias("epsilon2"),
        F.when(ok, F.when(N > 1, _clip01((H - dof) / (N - 1))).otherwise(0.0)).alias("eta2_kw"),
        F.when(ok, F.coalesce(F.try_divide("ssb", "sst"), F.lit(0.0))).alias("rank_eta2"),
        F.when(ok, F.coalesce(F.try_divide("w_win", "w_sum"), F.lit(0.5))).alias("A_pair_avg"),
        F.when(ok, F.coalesce(F.try_divide("w_sym", "w_sum"), F.lit(0.0))).alias("A_pair_sym"))
    terms = df.sparkSession.createDataFrame([(m,) for m in metrics], "metric string")
    full = terms.join(out, "metric", "left")
    if not keep_missing:
        return full.select("metric", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in EFFECTS])
    text = F.concat_ws("; ", *[F.concat(F.lit(f"{lab}:"), F.coalesce(f"s{i}", F.lit(0)))
                               for i, lab in enumerate(labels)])
    return full.join(sizes.select("metric", text.alias("group_sizes")), "metric", "left").select(
        "metric", "group_sizes", *EFFECTS,
        F.when(F.col("H_norm").isNull(), "fewer than two usable groups").otherwise("").alias("note"))


def area_under_curve(df: DataFrame, y: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """AUC per key from score histograms: P(score of a 1 > score of a 0), ties half."""
    keys = keys or []
    cum = cumulative_counts(df, keys, score, {
        "c1": F.when(F.col(y) == 1, 1).otherwise(0), "c0": F.when(F.col(y) == 0, 1).otherwise(0)})
    return cum.groupBy(*keys).agg(F.try_divide(
        F.sum(F.col("c1") * (F.col("c0_before") + F.col("c0") / 2.0)),
        F.max("c1_total").cast("double") * F.max("c0_total")).alias("auc"))
