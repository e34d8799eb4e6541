"""Operators on levels take more levels than any list of literals could hold."""
import hashlib

from pyspark.sql import functions as F

from veiltab.operators import encode as E
from veiltab.operators import perturb as N

LEVELS = 20_000


def u(salt, i):
    return int(hashlib.md5(f"7|{salt}|{i}".encode()).hexdigest()[:8], 16) / 4294967296.0


def table(spark):
    """A third of the rows share one level; every level occurs; some are blank or null."""
    lv = F.when(F.col("row_id") % 3 == 0, "hot").when(F.col("row_id") % 1001 == 1, F.lit(None)).otherwise(F.concat(F.lit("é"), (F.col("row_id") % LEVELS).cast("string")))
    return spark.range(2 * LEVELS).select(F.col("id").alias("row_id")).withColumn("c", lv)


def test_replacement_among_many_levels(spark):
    df = table(spark)
    rows = {r.row_id: r.c for r in df.collect()}
    counts = {}
    for v in rows.values():
        if v is not None:
            counts[v] = counts.get(v, 0) + 1
    order, at, acc = sorted(counts, key=lambda v: v.encode()), {}, 0
    for v in order:
        at[v], acc = acc, acc + counts[v]
    lines = [v for v in order for _ in range(counts[v])]
    place = {v: i for i, v in enumerate(order)}

    def uniform(i, v):
        if v is None or u("s" + "c/p", i) >= 0.4:
            return v
        t = int(u("s" + "c/v", i) * (len(order) - 1))
        return order[t + (t >= place[v])]

    def weighted(i, v):
        if v is None or u("s" + "c/p", i) >= 0.4:
            return v
        t = int(u("s" + "c/v", i) * (acc - counts[v]))
        return lines[t + (counts[v] if t >= at[v] else 0)]

    for op, want in ((N.replace_category_uniform, uniform), (N.replace_category_weighted, weighted)):
        got = {r.row_id: r.c for r in op(df, "c", 0.4, "s").collect()}
        assert got == {i: want(i, v) for i, v in rows.items()}


def test_pair_weights_of_many_levels(spark):
    df = table(spark).withColumn("x", F.col("row_id") % 7 / 1.0)
    a, c = E.encode_pair(df, df.filter("row_id < 100"), ["x"], ["c"], kind="zidf")
    assert a.count() == 2 * LEVELS and c.count() == 100
    weights = a.groupBy(F.col("cat")[0].alias("k")).agg(F.count_distinct(F.col("w")[0]).alias("d")).agg(F.max("d")).first()[0]
    assert weights == 1


def test_one_level_and_no_level(spark):
    one = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "row_id long, c string")
    none = one.filter("c is null")
    for op in (N.replace_category_uniform, N.replace_category_weighted):
        assert sorted(map(tuple, op(one, "c", 1.0).collect())) == [(1, "a"), (2, "a"), (3, None)]
        assert [tuple(r) for r in op(none, "c", 1.0).collect()] == [(3, None)]
