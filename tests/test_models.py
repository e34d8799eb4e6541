"""Boosted trees on numbers that are missing or infinite."""
import pytest
from pyspark.sql import functions as F

from veiltab.operators import model as M


@pytest.mark.parametrize("gap", [None, float("nan"), float("inf")])
def test_trees_take_missing_and_infinite_numbers(spark, tmp_path, gap):
    rows = [(i, gap if i % 3 == 0 else float(i % 7), float(i % 5), int(i % 3 == 0), i % 4 == 0) for i in range(120)]
    df = spark.createDataFrame(rows, "row_id long, a double, `b``x` double, y int, is_valid boolean")
    model = M.boosted_fit(df, ["a", "b`x"], "y", "is_valid", trees=3, depth=2)
    out = M.predict(model, df, ["row_id", "a", "y"])
    assert out.filter((F.col("p") >= 0.5) != (F.col("y") == 1)).count() == 0  # the gap itself tells the label
    assert out.filter("a is null").count() == (40 if gap is None else 0)  # kept columns stay as they were
    model.write().save(f"{tmp_path}/model")
    again, features, target = M.model_load(str(tmp_path), "y")
    assert (features, target) == (["a", "b`x"], "y")
    assert again.transform(df).count() == 120
