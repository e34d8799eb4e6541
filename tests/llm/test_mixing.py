"""Targets against resharing in rounds, and the draw's promises."""
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from veiltab.llm.mixing import WEIGHTS, mix, source_targets, with_copies

SCHEMA = "doc_id long, text string, source string, size string, _size int"


def reshared(sizes: dict, limit: int = 3) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[k % 3] for k, s in enumerate(names)}
    left, target, open_ = float(sum(sizes.values())), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > limit * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            target[s] = float(limit * sizes[s])
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, "c": 1, "d": 7}, {"a": 0, "b": 5, None: 9}, {"x": 4}, {"a": 500, "b": 3, "c": 900, "d": 2, "e": 1, "": 44, "é": 8, None: 3}])
def test_targets(spark, sizes):
    rows = [(s, n) for s, n in sizes.items()]
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = reshared(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-9 * max(1, want[s]) for s in want)
    assert abs(sum(got.values()) - sum(sizes.values())) < 1e-6


def documents(spark):
    rows = [(i, "w " * (i % 17 + 1), f"s{i % 4}" if i % 4 else ("s0" if i % 8 else None), "x", 1) for i in range(3000)]
    rows += [(5, "w " * 6, "s1", "x", 1)] * 3 + [(None, None, "s2", None, None), (9001, "", "", None, None), (9002, "w " * 900, "s3", None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_draw(spark):
    docs = documents(spark)
    rows = with_copies(docs).collect()
    assert len(rows) == docs.count()
    taken, target = defaultdict(int), {}
    for r in rows:
        assert 0 <= r.copies <= 3
        taken[r.row.source] += r.copies * r.size
        target[r.row.source] = r.target
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.05 * t + 900, (s, taken[s], t)
    again = with_copies(docs.repartition(7)).groupBy("row.doc_id", "size", "row.source").agg(F.sum("copies").alias("c"))
    first = defaultdict(int)
    for r in rows:
        first[r.row.doc_id, r.size, r.row.source] += r.copies
    assert {(r.doc_id, r["size"], r.source): r.c for r in again.collect()} == dict(first)
    mixed = mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)


def test_empty(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
