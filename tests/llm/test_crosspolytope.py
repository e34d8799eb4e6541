"""Recall, exact scores and awkward vectors."""
import numpy as np
from pyspark.sql import functions as F

from veiltab.llm.crosspolytope import Rotations, hadamard, nearest


def test_hadamard_is_orthogonal():
    m = hadamard(np.eye(16, dtype=np.float32))
    assert np.allclose(m @ m.T, np.eye(16), atol=1e-6)
    turns = Rotations(20, 2, 2)
    x = np.random.default_rng(0).normal(size=(30, 20)).astype(np.float32)
    assert np.allclose(np.linalg.norm(turns.turned(x, 1, 1), axis=1), np.linalg.norm(x, axis=1), rtol=1e-4)
    found = turns.buckets(x, 1, 9)
    assert found.shape == (30, 9) and all(len(set(r)) == 9 for r in found.tolist()) and (turns.buckets(x, 1, 1)[:, 0] == found[:, 0]).all()


def test_recall_and_ties(spark):
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(40, 24))
    data = {i: (centers[i % 40] + 0.6 * rng.normal(size=24)).astype(np.float32) for i in range(1200)}
    for i in range(0, 400, 4):
        data[i] = data[0]  # one vector held by many ids
    rows = [(i, [float(x) for x in v]) for i, v in data.items()]
    bad = [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (5003, [1.0, None] + [0.0] * 22), (5004, [1.0] * 3), (None, rows[1][1]), rows[9], (5005, [float("inf")] * 24)]
    df = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("bucket", F.lit("x"))
    got: dict = {}
    for r in nearest(df, F.col("id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append(r)
    ids = np.array(sorted(data))
    m = np.array([data[i] for i in ids], float)
    n = np.linalg.norm(m, axis=1)
    hits = total = 0
    assert set(got) == {i for i in data if i % 50 == 0}
    for q, found in got.items():
        found.sort(key=lambda r: r["rank"])
        s = (m @ data[q].astype(float)) / (n * np.linalg.norm(data[q].astype(float)))
        s[ids == q] = -9
        best = [ids[k] for k in np.lexsort((ids, -np.round(s, 12)))[:5]]
        hits += len({r.vec_id for r in found} & set(best))
        total += 5
        assert [r["rank"] for r in found] == list(range(1, len(found) + 1))
        assert all(abs(r.score - s[np.searchsorted(ids, r.vec_id)]) < 1e-12 for r in found)
    assert hits >= 0.9 * total
    hot = [r.vec_id for r in got[0]]
    assert hot == [4, 8, 12, 16, 20]


def test_small(spark):
    schema = "vec_id long, embedding array<double>"
    assert nearest(spark.createDataFrame([], schema), F.col("id") % 50 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0])], schema)
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in nearest(few, F.col("id") % 50 == 0).collect())
    assert got == [(0, 1, 1), (0, 2, 2)]
    wide = spark.createDataFrame([(i, [float(i == d) + 0.01 * d for d in range(64)]) for i in range(4)], schema)
    assert sorted((r.query_id, r["rank"]) for r in nearest(wide, F.col("id") == 0).collect()) == [(0, 1), (0, 2), (0, 3)]


def test_queries_alone_in_their_buckets(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    got: dict = {}
    for r in nearest(df, F.col("id") % 50 == 0, k=59).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    for q, found in got.items():
        want = [int(i) for i in np.argsort(-(unit @ unit[q]), kind="stable") if i != q]
        assert [found[r] for r in sorted(found)] == want
    assert set(got) == {0, 50}


def test_many_ties_go_to_smaller_ids(spark):
    base = [1.0, 2.0, 0.0, -1.0]
    rows = [(0, [1.0, 2.0, 0.5, -1.0])] + [(200 - i, [x * 2.0 ** i for x in base]) for i in range(40)]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 0).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [161, 162, 163, 164, 165]
