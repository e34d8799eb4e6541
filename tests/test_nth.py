"""The n-th row of every key at once against pandas: hot and null keys, ties, text ids, repeated rows."""
import pytest
from pyspark.sql import functions as F

from veiltab.functions.hashing import uniform
from veiltab.operators import nth as N
from veiltab.operators import select as S


@pytest.fixture
def small_steps(monkeypatch):
    monkeypatch.setattr(N, "LAST_ROWS", 30)
    monkeypatch.setattr(N, "PIVOTS", 6)
    monkeypatch.setattr(N, "SAMPLE", 24)


@pytest.fixture(scope="module")
def table(spark):
    key = F.when(F.col("id") % 3 < 2, F.lit("hot")).when(F.col("id") % 30 == 2, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 11))
    value = F.when(F.col("id") % 2 == 0, 5.0).when(F.col("id") % 17 == 1, F.lit(None)).otherwise(F.round(uniform("x", "id") * 10, 2))
    return spark.range(3000).select(F.col("id").alias("row_id"), key.alias("release"), value.alias("v"), F.concat(F.lit("t"), "id").alias("name"), F.lit(1).alias("hit")).cache()


def first(pdf, key, value, row_id, take):
    want = set()
    for k, part in pdf[pdf[value].notna()].groupby(key, dropna=False):
        part = part.sort_values([value, row_id])
        want |= set(part[row_id].head(max(0, take(None if k != k else k, len(part)))))
    return want


@pytest.mark.parametrize("row_id", ["row_id", "name"])
@pytest.mark.parametrize("n", [1, 7, 400, 5000])
def test_first_n_of_every_key(table, small_steps, row_id, n):
    got = N.first_n_by_key(table, ["release"], F.col("v"), n, row_id)
    assert got.columns == table.columns and got.count() == 3000
    found = {r[0] for r in got.filter("hit").select(row_id).collect()}
    assert found == first(table.toPandas(), "release", "v", row_id, lambda k, m: n)


def test_a_number_per_key(table, small_steps, spark):
    wanted = {"hot": 600, "k2": 0, "k5": -3, None: 20, "other": 4, "k8": 10_000}
    n = spark.createDataFrame(list(wanted.items()), "release string, n long")
    got = {r[0] for r in N.first_n_by_key(table, ["release"], F.col("v"), n).filter("hit").select("row_id").collect()}
    assert got == first(table.toPandas(), "release", "v", "row_id", lambda k, m: wanted.get(k, 0))


def test_copies_of_one_row_end_the_search(spark, small_steps):
    rows = spark.range(500).select(F.lit(7).alias("row_id"), F.lit(1.0).alias("v"), F.lit("a").alias("release"))
    bound = N.nth_bounds(rows, ["release"], F.col("v"), 250).first()
    assert not bound["__all"] and tuple(bound["__bound"]) == (1.0, 7)


def test_empty(table):
    none = table.filter("false")
    assert N.first_n_by_key(none, ["release"], F.col("v"), 5).count() == 0
    assert N.first_n_by_key(table, ["release"], F.col("v"), 0).filter("hit").count() == 0


def test_force_count_per_key_equals_one_key_at_a_time(table, small_steps):
    marked = table.select("row_id", "release", (F.col("row_id") % 4 == 0).cast("int").alias("mark")).filter("release in ('hot', 'k2')")
    got = {(r.release, r.row_id) for r in S.force_count(marked, "mark", 120, keys=["release"]).filter("mark = 1").collect()}
    for k in ("hot", "k2"):
        alone = S.force_count(marked.filter(F.col("release") == k), "mark", 120).filter("mark = 1").collect()
        assert {r.row_id for r in alone} == {i for name, i in got if name == k}
