"""Swaps in sequence, aligned logits, beta draws, text ids and leaf shares against plain versions."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veiltab.operators import cohort as C
from veiltab.operators import model as ML
from veiltab.operators import ranks as R
from veiltab.operators import risk
from veiltab.operators import select as S
from veiltab.operators import synth as Y


@pytest.mark.parametrize("case", ["random", "one row in every swap", "a chain through all rows"])
def test_swap_sequence_equals_a_loop(spark, case):
    rng, n = random.Random(5), 60
    swaps = {"random": [(rng.randrange(n), rng.randrange(n)) for _ in range(150)],
             "one row in every swap": [(0, rng.randrange(n)) for _ in range(90)],
             "a chain through all rows": [(i, i + 1) for i in range(n - 1)]}[case]
    held = {i: (f"t{i % 7}", None if i == 3 else i) for i in range(n)}
    df = spark.createDataFrame([(i, *v, i * 2) for i, v in held.items()], "row_id long, a string, b int, kept int")
    for x, y in swaps:
        held[x], held[y] = held[y], held[x]
    plan = spark.createDataFrame([(i * 3, x, y) for i, (x, y) in enumerate(swaps)], "swap long, first long, second long")
    got = C.swap_sequence(df, plan, ["a", "b"]).collect()
    assert {r.row_id: (r.a, r.b) for r in got} == held and all(r.kept == 2 * r.row_id for r in got)


def test_swap_sequence_without_swaps(spark):
    df = spark.createDataFrame([(1, 5), (2, None)], "row_id long, v int")
    none = spark.createDataFrame([], "swap long, first long, second long")
    assert sorted(map(tuple, C.swap_sequence(df, none, ["v"]).collect())) == [(1, 5), (2, None)]


def test_similar_swaps_reach_every_partner_and_no_other(spark):
    people = [(0, "M", 30), (1, "M", 35), (2, "M", 36), (3, "F", 30), (4, None, 30), (5, "M", None), (6, "M", 25), (7, "M", 30)]
    df = spark.createDataFrame(people, "row_id long, sex string, age int")
    got = [tuple(r) for r in C.similar_swaps(df, 3000, "sex", "age").collect()]
    near = {(a, b) for a, s, x in people for b, t, y in people
            if a != b and s and s == t and None not in (x, y) and abs(x - y) <= 5}
    seen = {}
    for _, a, b in got:
        seen[a, b] = seen.get((a, b), 0) + 1
    assert set(seen) == near and len({s for s, _, _ in got}) == len(got)
    for a, b in near:  # each of 8 rows is drawn in an eighth of the turns, its partners evenly
        assert abs(seen[a, b] / 3000 - 1 / 8 / sum(x == a for x, _ in near)) < 0.03


@pytest.mark.parametrize("alpha", [0.05, 0.4, 1.0, 6.0])
def test_symmetric_beta_has_its_moments(spark, alpha):
    x = np.array([r[0] for r in spark.range(20000).select(ML.symmetric_beta(alpha, "b", "id")).collect()])
    assert ((0 <= x) & (x <= 1)).all() and abs(x.mean() - 0.5) < 0.012
    assert abs(x.var() * 4 * (2 * alpha + 1) - 1) < 0.05
    fourth = 3 / (16 * (2 * alpha + 1) * (2 * alpha + 3))
    assert abs(((x - 0.5) ** 4).mean() / fourth - 1) < 0.1


def test_aligned_logits_equal_a_plain_version(spark):
    rng = np.random.default_rng(3)
    n, w, cut = 80, np.array([0.3, -0.2]), 4
    before = rng.normal(size=(n, 2)).round(3) * 10
    after = before + rng.normal(size=(n, 2)).round(2)
    group = np.arange(n) % 3
    names = "row_id long, g int, u double, v double"
    make = lambda m: spark.createDataFrame([(i, int(group[i]), *map(float, m[i])) for i in range(n)], names)
    got = {r.row_id: (r.u, r.v) for r in Y.align_logits(
        make(before), make(after), F.col("u") * 0.3 + F.col("v") * -0.2, {"u": 0.3, "v": -0.2}, ["g"], cut).collect()}
    for g in range(3):
        idx = np.flatnonzero(group == g)
        old, new = before[idx] @ w, after[idx] @ w
        target = np.quantile(old, np.argsort(np.argsort(new)) / (len(idx) - 1))
        moved = after[idx] + ((target - new) / (w @ w))[:, None] * w
        lo, hi = np.quantile(before[idx], [0.005, 0.995], axis=0)
        for i, want in zip(idx, np.clip(moved, lo, hi)):
            assert got[i] == pytest.approx(want, abs=2e-4)


def test_fitted_logit_scores_another_table(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "", None]), rng.choice([1.0, 2.0, 3.0, None])) for _ in range(600)]
    rows = [(int(rng.random() < (0.3 if c == "b" else 0.6)), c, x) for c, x in rows]
    model = ML.fit_logit(spark.createDataFrame(rows, "y int, c string, x double"), "y", ["c", "x"])
    assert set(model.numbers) == {"x"} and set(model.levels["c"]) == {"a", "b"} and model.levels["c"]["b"] < -0.5
    new = spark.createDataFrame([("b", 2.0), ("never seen", 2.0), (None, None), ("", 1.0)], "c string, x double")
    got = [r[0] for r in new.select(model.logit()).collect()]
    base = model.intercept
    x = model.numbers["x"]
    assert got == pytest.approx([base + model.levels["c"]["b"] + 2 * x, base + 2 * x, base + model.fills["x"] * x, base + x])


def test_top_k_mark_with_text_ids_on_both_sides_of_the_limit(spark, monkeypatch):
    rows = [(f"id{i:05d}", float((i * 7919) % 97)) for i in range(6500)]
    df = spark.createDataFrame(rows, "row_id string, s double")
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    for n in (4999, 5001, 6500, 7000):
        got = {r.row_id for r in S.top_k_mark(df, F.col("s"), n).filter("mark = 1").collect()}
        assert got == {r[0] for r in order[:n]}
    monkeypatch.setattr(R, "TAKE_ORDERED_MAX", 10)
    got = {r.row_id for r in S.top_k_mark(df, F.col("s"), 3).filter("mark = 1").collect()}
    assert got == {r[0] for r in order[:3]}


def test_leaf_rarity_by_lookup_equals_the_join(spark, monkeypatch):
    rows = [(i, [i % 3, 7 if i else 9]) for i in range(40)] + [(40, [99, None]), (41, []), (42, None)]
    df = spark.createDataFrame(rows, "row_id long, leaf array<int>")
    base = df.filter("row_id < 30").select("leaf")
    take = lambda: {r.row_id: r.s_leaf for r in risk.score_leaf_rarity(df, base).collect()}
    looked_up = take()
    assert "Generate" not in risk.with_leaf_rarity(df, base, "leaf", "row_id", "s")._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(risk, "LEAF_ROWS", 0)
    assert looked_up == pytest.approx(take()) and looked_up[40] == pytest.approx(1.0) and looked_up[42] == 0.0
