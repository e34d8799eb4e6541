"""Hand-computed and brute-force cases of the statistics."""
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veiltab.functions import clean, special
from veiltab.operators import profile as P
from veiltab.operators.ranktest import kruskal_wallis


def test_normal_functions(spark):
    ps = [1e-6, 0.01, 0.024, 0.3, 0.5, 0.77, 0.98, 1 - 1e-6]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = df.select("p", special.normal_quantile(F.col("p")).alias("z")).withColumn("back", special.normal_cdf(F.col("z"))).collect()
    for r in got:
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), rel=2e-8, abs=1e-8)
        assert r["back"] == pytest.approx(r["p"], rel=3e-7)


@pytest.mark.parametrize("x,df,p", [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (9.487729, 4, 0.05), (20.515, 5, 0.001)])
def test_chi_square_tail(spark, x, df, p):
    got = spark.range(1).select(special.chi2_log_sf(F.lit(x), F.lit(df)).alias("l")).first()["l"]
    assert math.exp(got) == pytest.approx(p, rel=2e-3)


def test_tiny_tail_is_finite(spark):
    got = spark.range(1).select(special.minus_log10_p(F.lit(5000.0), F.lit(3)).alias("m")).first()["m"]
    assert 1080 < got < 1090


def brute_kw(groups):
    y = np.concatenate(groups)
    r = pd.Series(y).rank().to_numpy()
    n, out, at = len(y), 0.0, 0
    for g in groups:
        out += len(g) * (r[at:at + len(g)].mean() - (n + 1) / 2) ** 2
        at += len(g)
    _, t = np.unique(y, return_counts=True)
    H = 12 / (n * (n + 1)) * out / (1 - (t ** 3 - t).sum() / (n ** 3 - n))
    w = a = s = 0
    for i in range(len(groups)):
        for j in range(i + 1, len(groups)):
            x, z = groups[i][:, None], groups[j][None, :]
            A, m = ((x > z) + 0.5 * (x == z)).mean(), len(groups[i]) * len(groups[j])
            w, a, s = w + m, a + m * A, s + m * 2 * abs(A - 0.5)
    return H, out / ((r - r.mean()) ** 2).sum(), a / w, s / w, n


def test_kruskal_wallis_with_ties_and_small_groups(spark):
    rng = np.random.default_rng(3)
    groups = [rng.integers(0, 6, 40).astype(float), rng.integers(1, 7, 25).astype(float), rng.integers(0, 9, 31).astype(float)]
    rows = [(g, float(v)) for g, vals in zip("abc", groups) for v in vals] + [("d", 100.0)]
    df = spark.createDataFrame(rows, "g string, y double").withColumn("const", F.lit(1.0))
    got = {r["metric"]: r for r in kruskal_wallis(df, ["y", "const"], F.col("g"), list("abcd"), keep_missing=True).collect()}
    H, eta, a, s, n = brute_kw(groups)
    r = got["y"]
    assert r["rank_eta2"] == pytest.approx(eta, rel=1e-9)
    assert (r["A_pair_avg"], r["A_pair_sym"]) == pytest.approx((a, s), rel=1e-9)
    assert r["eta2_kw"] == pytest.approx((H - 2) / (n - 1), rel=1e-9)
    assert r["group_sizes"] == "a:40; b:25; c:31; d:1"
    assert got["const"]["H_norm"] is None and got["const"]["note"] != ""


def test_constant_column_in_matrix_and_scaling(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (4.0, 2.0)], "a double, b double")
    m = {(r["col_a"], r["col_b"]): r["corr"] for r in P.pearson_matrix(df, ["a", "b"]).collect()}
    assert m[("a", "b")] is None and m[("b", "a")] is None and m[("a", "a")] == pytest.approx(1.0) and len(m) == 4
    d = {r["column"]: r for r in P.describe_scaled(df, ["a", "b"]).collect()}
    assert d["b"]["mean"] == 0.0 and d["a"]["p50"] == pytest.approx(1 / 3)


def test_unseen_levels_count_as_zero(spark):
    df = spark.createDataFrame([("x", "p"), ("x", None), ("y", "p")], "a string, b string")
    got = {(r["level_a"], r["level_b"]): r["ratio"] for r in P.crosstab_ratio(df, {"a": ["x", "y", "z"], "b": ["p", "q"]}).collect()}
    assert len(got) == 6 and got[("x", "p")] == pytest.approx(1 / 3) and got[("z", "q")] == 0.0


def test_bins_and_normalisers(spark):
    df = spark.createDataFrame([(0,), (18,), (75,), (130,), (None,)], "age int")
    edges, labels = clean.open_bins([0, 18, 45, 65, 75, 200])
    assert [r[0] for r in df.select(clean.bin_label("age", edges, labels)).collect()] == ["0-17", "18-44", "75+", "75+", None]
    t = spark.createDataFrame([("Native Hawaiian",), ("none",), ("",), (None,)], "t string")
    assert [r[0] for r in t.select(clean.norm_keyword_map("t")).collect()] == ["hawaiian", "unknown", "unknown", "unknown"]
    with pytest.raises(ValueError):
        clean.open_bins([0, 1])
