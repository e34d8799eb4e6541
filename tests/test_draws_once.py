"""Draws of the recipes' steps are evaluated once, and the steps give the rows of a plain version."""
import hashlib
import math
import statistics

import pytest
from pyspark.sql import functions as F

from veiltab.functions import clean
from veiltab.operators import cohort as C
from veiltab.operators import perturb as N
from veiltab.operators import ranks as R

LIMITS = {"a": (0, 60), "b": (5, 40)}
PEOPLE = [(i, None if i % 17 == 0 else i % 25, None if i % 11 == 3 else (i * 7) % 50, 3 if i % 25 < 10 else i % 90) for i in range(240)]
SCHEMA = "row_id long, age int, a int, b int"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def u(salt, i):
    return int(hashlib.md5(f"7|{salt}|{i}".encode()).hexdigest()[:8], 16) / 2**32


def g(salt, i):
    return math.sqrt(-2 * math.log(max(u(salt + "/r", i), 2**-32))) * math.cos(2 * math.pi * u(salt + "/t", i))


def test_group_noise_is_written_before_its_medians(spark):
    df = spark.createDataFrame(PEOPLE, SCHEMA)
    got = N.noise_by_group_std(df, LIMITS, clean.bin_label("age", [0, 10, 20], ["x", "y"]), 0.3, "s/", wide=(0.2, 0.9))
    assert "md5" not in plan(got) and got.columns == df.columns
    bins = {r[0]: None if r[1] is None or r[1] >= 20 else "x" if r[1] < 10 else "y" for r in PEOPLE}
    want = {r[0]: {} for r in PEOPLE}
    for at, (c, (lo, hi)) in enumerate(LIMITS.items(), 2):
        std = {}
        for k in ("x", "y"):
            held = [r[at] for r in PEOPLE if bins[r[0]] == k and r[at] is not None]
            std[k] = statistics.stdev(held) or max(1.0, statistics.mean(held) * 0.1)
        new = {}
        for r in PEOPLE:
            i, v = r[0], r[at]
            if v is not None and bins[i]:
                f = 0.9 if u(f"s/{c}/wide", i) < 0.2 else 0.3
                v = round(min(max(v + g(f"s/{c}/g", i) * std[bins[i]] * f, lo), hi))
            new[i] = v
        fill = int(min(max(statistics.median(v for v in new.values() if v is not None), lo), hi))
        for i, v in new.items():
            want[i][c] = v if v is not None and lo <= v <= hi else fill
    assert {r.row_id: {"a": r.a, "b": r.b} for r in got.collect()} == want


def test_group_noise_without_any_group(spark):
    df = spark.createDataFrame([(1, None, 7, 9), (2, None, None, 50)], SCHEMA)
    got = N.noise_by_group_std(df, LIMITS, clean.bin_label("age", [0, 10], ["x"]), 0.3)
    assert sorted(tuple(r) for r in got.collect()) == [(1, None, 7, 9), (2, None, 7, 29)]


def test_range_noise_draws_one_gaussian_a_row(spark):
    values = [None, 10.0, 85.0, 90.0, 115.0, 140.0, 141.0, 190.0, 260.0]
    df = spark.createDataFrame([(i, values[i % 9]) for i in range(90)], "row_id long, v double")
    got = N.noise_normal_range_aware(df, "v", (90, 140), (60, 200), 2.5, (4, 2.5), 1, "s/")
    assert plan(got).count("md5(") == 2 and got.columns == df.columns
    for r in got.collect():
        x, d = values[r.row_id % 9], g("s/v/g", r.row_id)
        if x is None:
            assert r.v is None
            continue
        move = abs(4 + d * 2.5)
        x = min(max(x + d * 2.5, 90), 140) if 90 <= x <= 140 else max(x - move, 140) if x > 140 else min(x + move, 90)
        assert r.v == pytest.approx(min(max(x, 60), 200), abs=0.051)


def test_bins_are_one_chain_of_conditions(spark):
    edges, labels = [0, 11, 21, 31, 41, 51, 61, 71, 81, 91, 101, 200], list("abcdefghijk")
    df = spark.createDataFrame([(x,) for x in [None, -1.0, 0.0, 10.5, 11.0, 100.9, 101.0, 199.0, 200.0, float("nan")]], "x double")
    left = df.select("x", clean.bin_label("x", edges, labels).alias("l"), clean.bin_index("x", edges).alias("i"))
    assert plan(left).count(">=") <= 2 * len(labels) + 1
    assert [r.l for r in left.collect()] == [None, None, "a", "a", "b", "j", "k", "k", None, None]
    assert [r.i for r in left.collect()] == [None, None, 0, 0, 1, 9, 10, 10, None, None]
    right = df.select(clean.bin_label("x", edges, labels, right=True).alias("l"), clean.bin_label("x", edges, labels, right=True, include_lowest=True).alias("m"))
    assert [(r.l, r.m) for r in right.collect()] == [(None, None), (None, None), (None, "a"), ("a", "a"), ("a", "a"), ("j", "j"), ("j", "j"), ("k", "k"), ("k", "k"), (None, None)]


def test_nth_row_and_swaps_read_written_draws(spark, monkeypatch):
    monkeypatch.setattr(R, "TAKE_ORDERED_MAX", 10)
    written = []
    for module in (R, C):
        real = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, name="table", real=real: written.append(name) or real(df, name))
    df = spark.range(3000).select(F.col("id").alias("row_id"), (F.col("id") % 5).alias("v"))
    order = sorted(range(3000), key=lambda i: (u("z", i), i))
    hit = R.first_n(df, N.uniform("z"), 700)
    assert {r.row_id for r in df.filter(hit).collect()} == set(order[:700]) and written == ["ordered"]
    out = C.swap_between_cohorts(df, "v", F.col("v") == 1, F.col("v") == 2, 0.5)
    assert written == ["ordered", "ranked"] and "md5" not in plan(out)
    assert {r[0]: r[1] for r in out.groupBy("v").count().collect()} == {i: 600 for i in range(5)}
    assert df.join(out.withColumnRenamed("v", "w"), "row_id").filter("v <> w").count() == 600
    out = C.swap_records(df, ["v"], 0.1)
    assert written[2:] == ["chosen", "ranked"] and "md5" not in plan(out)
    assert {r[0]: r[1] for r in out.groupBy("v").count().collect()} == {i: 600 for i in range(5)}
