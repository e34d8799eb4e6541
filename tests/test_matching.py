"""Exact neighbours against brute force; planted truth."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from veiltab.functions.hashing import integer_between, uniform
from veiltab.operators import encode as E
from veiltab.operators import matching as M
from veiltab.operators.neighbours import Metric, Vectors, View, knn, per_query
from veiltab.plans import audits as A


def table(spark, n, salt, copies):
    """Rows with three numbers and a category; every ``copies``-th row is one and the same."""
    same = F.col("id") % copies == 0
    return spark.range(n).select(
        "id", *[F.when(same, 0.5).otherwise(F.round(uniform(f"{salt}/{c}", "id"), 3)).alias(c) for c in "xyz"],
        F.when(same, "k0").otherwise(F.concat(F.lit("k"), integer_between(0, 3, f"{salt}/k", "id").cast("string"))).alias("k"))


def vectors(df):
    return df.select("id", F.array("x", "y", "z").alias("num"), F.array(F.xxhash64("k")).alias("cat"),
                     F.array(F.lit(0.2)).alias("w"))


def brute(a, c, k, l2, unit=False):
    def arrays(df):
        p = (E.unit_rows(df) if unit else df).orderBy("id").toPandas()
        return p["id"].to_numpy(), Vectors(p)
    (ai, av), (ci, cv) = arrays(a), arrays(c)
    whole = View("*", tuple(range(av.num.shape[1])), tuple(range(av.cat.shape[1])))
    metric = Metric("l2" if l2 else "l1", [whole], av.num.shape[1], av.cat.shape[1])
    every = np.arange(len(ai))
    d = np.round([metric.exact(0, cv.take(np.full(len(ai), i)), av.take(every)) for i in range(len(ci))], 9)
    return {(int(q), r + 1): (int(ai[j]), d[i, j]) for i, q in enumerate(ci)
            for r, j in enumerate(np.lexsort((ai, d[i]))[:k])}


@pytest.mark.parametrize("metric,block,cells", [("l1", 4096, 16384), ("l1", 40, 40), ("l2", 64, 150), ("cosine", 50, 50)])
def test_knn_equals_brute_force(spark, metric, block, cells):
    a, c = vectors(table(spark, 600, "a", 3)), vectors(table(spark, 150, "c", 4))
    found = per_query(c, knn(a, c, 4, metric, block_rows=block, cell_rows=cells), metric)
    got = {(r["query_id"], r["rank"]): (r["id"], r["dist"]) for r in found.collect()}
    want = brute(a, c, 4, metric != "l1", metric == "cosine")
    assert got.keys() == want.keys()
    for key in want:
        assert got[key][0] == want[key][0] and got[key][1] == pytest.approx(want[key][1], abs=2e-9)


def test_views_and_parts(spark):
    a, c = vectors(table(spark, 300, "a", 3)), vectors(table(spark, 60, "c", 5))
    views = [View("xy", (0, 1), ()), View("zk", (2,), (0,))]
    both = knn(a, c, 2, views=views, block_rows=32, cell_rows=32)
    assert {r[0] for r in both.select("part").distinct().collect()} == {"xy", "zk"}
    mult = both.filter("rank = 1").groupBy("part").agg(F.sum("mult").alias("n")).collect()
    assert all(r["n"] == 60 for r in mult)
    part = F.when(F.col("id") % 2 == 0, "even").otherwise("odd")
    inside = knn(a.withColumn("part", part), c.withColumn("part", part), 3).collect()
    assert all(r["id"] % 2 == (0 if r["part"] == "even" else 1) for r in inside)


def test_fewer_rows_than_k(spark):
    a, c = vectors(table(spark, 3, "a", 100)), vectors(table(spark, 5, "c", 100))
    assert knn(a, c, 7).count() == 15


def test_marks_reach_the_target(spark):
    a, c = vectors(table(spark, 400, "a", 3)), vectors(table(spark, 50, "c", 2))
    for n in (10, 40, 200):
        assert M.ranked_assign(a, c, n, 2).agg(F.sum("mark")).first()[0] == n


def test_planted_members_are_found_and_noise_hides_them(spark):
    pop = table(spark, 800, "p", 10 ** 9).withColumnRenamed("id", "row_id")
    rel = pop.filter(uniform("m") < 0.2)

    def hit_rate(noise):
        moved = rel.withColumns({c: F.col(c) + (uniform(f"n/{c}") - 0.5) * noise for c in "xyz"})
        pair = A.Pair(pop, moved, ["x", "y", "z"], ["k"])
        return A.recall(A.nearest(pair), rel, "row_id").first()["recall"]

    low, high = hit_rate(0.005), hit_rate(1.0)
    assert low > 0.9 and high < low - 0.3


def test_rounds_of_the_same_features_are_searched_once_and_all_counted(spark, monkeypatch):
    a, c = vectors(table(spark, 120, "a", 9)), vectors(table(spark, 30, "c", 7))
    xy, zk = ((0, 1), ()), ((2,), (0,))
    rounds = [View(f"r{i}", *x) for i, x in enumerate([xy, zk, xy, xy, zk])]
    asked, search = [], M.knn
    monkeypatch.setattr(M, "knn", lambda *x, views, **y: asked.append(len(views)) or search(*x, views=views, **y))
    got = {r["id"]: r["score"] for r in M.stability_vote(a, c, rounds, 3, heat_rounds=3).collect()}
    assert asked == [2]
    votes, hits = dict.fromkeys(got, 0.0), dict.fromkeys(got, 0)
    for r in search(a, c, 3, views=rounds).collect():
        votes[r["id"]] += r["mult"] / (r["dist"] + 1e-8)
        hits[r["id"]] += r["mult"] * (r["rank"] == 1 and r["part"] in ("r0", "r1", "r2"))
    damped = {i: votes[i] / (1 + 0.1 * hits[i]) for i in votes}
    lo, hi = min(damped.values()), max(damped.values())
    assert got == pytest.approx({i: (x - lo) / (hi - lo + 1e-12) for i, x in damped.items()}, abs=1e-9)


def test_v7_takes_the_votes_of_every_released_row(spark):
    pop = table(spark, 200, "p7", 10 ** 9).withColumnRenamed("id", "row_id")
    rel = pop.filter("row_id % 5 = 0")
    flat = pop.select(F.col("row_id").alias("id"), F.lit(1).alias("y"), F.lit(0.5).alias("p"))
    marks = A.v7(A.Pair(pop, rel, ["x", "y", "z"], ["k"]), flat, rel.count(), rounds=2)
    assert {r["id"] for r in marks.filter("mark = 1").collect()} == {r["row_id"] for r in rel.collect()}


def test_hybrid_fallbacks(spark):
    from veiltab.operators.risk import hybrid_risk
    ids = spark.range(100).withColumnRenamed("id", "row_id")
    assert hybrid_risk(ids, 10).agg(F.sum("mark")).first()[0] == 0
    flat = ids.withColumn("s_model", F.lit(0.3))
    marks = hybrid_risk(ids, 10, model=flat)
    assert marks.agg(F.sum("mark")).first()[0] == 10
    assert marks.filter("mark = 1").agg(F.max("row_id")).first()[0] > 10
