"""Distributed ranks against brute force, with one value holding a third of the rows."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from veiltab.functions.hashing import uniform
from veiltab.operators import ranks as R
from veiltab.operators.fit import modes


@pytest.fixture(scope="module")
def hot(spark):
    """3,000 rows; a third share one value, one group holds two thirds of the rows."""
    x = F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(F.round(uniform("x", "id") * 10, 3))
    g = F.when(F.col("id") % 3 < 2, "big").otherwise("small")
    return spark.range(3000).select(F.col("id").alias("row_id"), x.alias("v"), g.alias("g")).cache()


def test_quantiles_equal_numpy(hot):
    pdf = hot.toPandas()
    probs = {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.977}
    got = {r["g"]: r for r in R.exact_quantiles(hot, ["g"], "v", probs).collect()}
    for g, part in pdf.groupby("g"):
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(part["v"], p), abs=1e-9)


def test_mid_ranks_equal_pandas(hot):
    pdf = hot.toPandas()
    pdf["r"] = pdf.groupby("g")["v"].rank(method="average")
    want = {(a, b): r for a, b, r in zip(pdf["g"], pdf["v"], pdf["r"])}
    for r in R.mid_ranks(hot, "g", "v").collect():
        assert r["mid_rank"] == want[(r["g"], r["v"])]


@pytest.mark.parametrize("n", [1, 700, 999, 1000, 1001, 2500])
def test_top_n_bound_by_counts(hot, monkeypatch, n):
    pdf = hot.toPandas().sort_values(["v", "row_id"])
    monkeypatch.setattr(R, "TAKE_ORDERED_MAX", 0)
    monkeypatch.setattr(R, "ORDER_RANGES", 8)
    monkeypatch.setattr(R, "LAST_SLICE_ROWS", 40)
    got = hot.filter(R.first_n(hot, F.col("v"), n)).select("row_id").toPandas()["row_id"]
    assert set(got) == set(pdf["row_id"].head(n))


def test_ordered_and_hash_rank(hot, monkeypatch):
    monkeypatch.setattr(R, "ORDER_RANGES", 8)
    pdf = R.ordered_rank(hot, "g", "v").toPandas().sort_values(["g", "v", "row_id"])
    assert (pdf.groupby("g").cumcount() + 1 == pdf["rn"]).all()
    one = R.hash_rank(hot, "g", "s").toPandas().set_index("row_id")["rn"]
    two = R.hash_rank(hot.repartition(7), "g", "s", ranges=3).toPandas().set_index("row_id")["rn"]
    assert (one.sort_index() == two.sort_index()).all()
    by_id = R.id_rank(hot, "g").toPandas().sort_values(["g", "row_id"])
    assert (by_id.groupby("g").cumcount() + 1 == by_id["rn"]).all()


def test_more_asked_than_there_is(hot):
    assert hot.filter(R.first_n(hot, F.col("v"), 5000)).count() == 3000
    assert hot.filter(R.first_n(hot, F.col("v"), 0)).count() == 0


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), ("",), (None,)], "c string")
    assert modes(df, ["c"]) == {"c": "a"}
