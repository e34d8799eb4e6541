"""Marking rows: top-k, quotas, exact counts, priorities and splits.

With ``keys`` every count holds per key (many releases in one plan), and may be a table with a column ``n`` per key.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veiltab.functions.hashing import uniform
from veiltab.operators import fit
from veiltab.operators.nth import first_n_by_key
from veiltab.operators.ranks import first_n, hash_rank
from veiltab.session import materialize

ROW = "row_id"


def _mark(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def _first(df: DataFrame, order: Column, n: int | DataFrame, row_id: str, out: str, keys: list[str] | None) -> DataFrame:
    if keys:
        return first_n_by_key(df, keys, order, n, row_id, out=out).withColumn(out, F.col(out).cast("int"))
    return df.withColumn(out, _mark(first_n(df, order, n, row_id)))


def top_k_mark(df: DataFrame, score: Column, k: int | DataFrame, largest: bool = True, row_id: str = ROW,
               out: str = "mark", keys: list[str] | None = None) -> DataFrame:
    """1 on the k best rows (ties by row id), 0 elsewhere; scores are compared at 9 decimals."""
    return _first(df, F.round(-score if largest else score, 9), k, row_id, out, keys)


def random_mark(df: DataFrame, n: int | DataFrame, salt: str | Column = "mark", row_id: str = ROW, keys: list[str] | None = None) -> DataFrame:
    """1 on exactly n random rows."""
    return _first(df, uniform(salt, row_id), n, row_id, "mark", keys)


def class_quota_top_k(df: DataFrame, loss: str, k: int, y: str = "y", p: str = "p",
                      quota: str = "predicted", row_id: str = ROW, keys: list[str] | None = None) -> DataFrame:
    """Lowest losses per true class, the quota split by the predicted (or true) positive share;
    left-over places go to the lowest losses of all."""
    if keys:
        return _class_quota_by_key(df, loss, k, y, p, quota, row_id, keys)
    ones = F.avg((F.col(p) >= 0.5).cast("double")) if quota == "predicted" else F.avg(F.col(y).cast("double"))
    got = fit.row(df, r=ones, n1=F.count_if(F.col(y) == 1), n0=F.count_if(F.col(y) == 0))
    q1 = min(round(k * (got["r"] or 0.0)), k)
    order = F.round(loss, 9)
    hit = (first_n(df, order, min(q1, got["n1"]), row_id, F.col(y) == 1)
           | first_n(df, order, min(k - q1, got["n0"]), row_id, F.col(y) == 0))
    rest = k - min(q1, got["n1"]) - min(k - q1, got["n0"])
    if rest > 0:
        hit = hit | first_n(df, order, rest, row_id, ~hit)
    return df.withColumn("mark", _mark(hit))


def _class_quota_by_key(df: DataFrame, loss: str, k: int, y: str, p: str, quota: str, row_id: str, keys: list[str]) -> DataFrame:
    ones = F.avg((F.col(p) >= 0.5).cast("double")) if quota == "predicted" else F.avg(F.col(y).cast("double"))
    got = df.groupBy(*keys).agg(ones.alias("__r"), F.count_if(F.col(y) == 1).alias("__n1"), F.count_if(F.col(y) == 0).alias("__n0"))
    q1 = F.least(F.bround(F.lit(k) * F.coalesce("__r", F.lit(0.0))), F.lit(k)).cast("long")
    share = materialize(got.select(*keys, F.least(q1, "__n1").alias("__t1"), F.least(F.lit(k) - q1, "__n0").alias("__t0")), "quota")
    per_class = share.select(*keys, F.explode(F.array(F.struct(F.lit(1).alias("y"), F.col("__t1").alias("n")), F.struct(F.lit(0).alias("y"), F.col("__t0").alias("n")))).alias("__q"))
    per_class = per_class.select(*keys, F.col("__q.y").cast(df.schema[y].dataType).alias(y), "__q.n")
    order = F.round(loss, 9)
    first = materialize(first_n_by_key(df, [*keys, y], order, per_class, row_id, F.col(y).isin(0, 1), "__first"), "quota")
    rest = share.select(*keys, (F.lit(k) - F.col("__t1") - F.col("__t0")).alias("n"))
    both = first_n_by_key(first, keys, order, rest, row_id, ~F.col("__first"), "__rest")
    return both.withColumn("mark", (F.col("__first") | F.col("__rest")).cast("int")).drop("__first", "__rest")


def force_count(df: DataFrame, mark: str, n: int | DataFrame, salt: str | Column = "force", row_id: str = ROW,
                keys: list[str] | None = None) -> DataFrame:
    """Exactly n ones: drop random ones or add random zeros."""
    u = uniform(salt, row_id)
    if keys:  # ones in random order, then zeros in random order
        order = F.when(F.col(mark) == 1, u).when(F.col(mark) == 0, u + 1)
        hit = first_n_by_key(df, keys, order, n, row_id, out="__hit")
        return hit.withColumn(mark, F.col("__hit").cast("int")).drop("__hit")
    have = df.filter(F.col(mark) == 1).count()
    if have > n:
        hit = first_n(df, u, n, row_id, F.col(mark) == 1)
    else:
        hit = (F.col(mark) == 1) | first_n(df, u, n - have, row_id, F.col(mark) == 0)
    return df.withColumn(mark, _mark(hit))


def priority_fill(df: DataFrame, sources: list[str], n: int | DataFrame, salt: str | Column = "fill", row_id: str = ROW,
                  keys: list[str] | None = None) -> DataFrame:
    """Exactly n marks: all of the first source, then the next ones in row order, then random.

    The three stages are one order: stage number, then row id inside a marked stage and a
    hashed draw among the unmarked rows.
    """
    stage = F.lit(len(sources))
    for i in reversed(range(len(sources))):
        stage = F.when(F.col(sources[i]) == 1, i).otherwise(stage)
    order = stage + F.when(stage == len(sources), uniform(salt, row_id)).otherwise(0.0)
    return _first(df, order, n, row_id, "mark", keys)


def majority_vote(df: DataFrame, marks: list[str], at_least: int = 2) -> DataFrame:
    votes = F.lit(0)
    for m in marks:
        votes = votes + F.coalesce(F.col(m), F.lit(0))
    return df.withColumn("mark", (votes >= at_least).cast("int"))


def stratified_split(df: DataFrame, y: str, share: float, salt: str = "split", row_id: str = ROW) -> DataFrame:
    """``is_test`` = 1 on ceil(share * n_class) random rows of every class, whatever the number of classes."""
    sizes = df.groupBy(y).agg(F.ceil(F.lit(share) * F.count(F.lit(1))).alias("n"))
    return _first(df, uniform(salt, row_id), sizes, row_id, "is_test", [y])


def sample_and_split(df: DataFrame, share: float = 0.5, train: float = 0.9, salt: str = "s",
                     row_id: str = ROW) -> DataFrame:
    """Bernoulli sample, then a train flag by a second draw."""
    return df.filter(uniform(salt + "/keep", row_id) < share).withColumn(
        "is_train", (uniform(salt + "/train", row_id) < train).cast("int"))


def exact_key_sample(a: DataFrame, c: DataFrame, cols: list[str], max_levels: int = 10, quota: int = 50,
                     salt: str = "key", row_id: str = ROW) -> tuple[str | None, DataFrame]:
    """Pick the category with the most shared levels (2..max_levels) and mark, per level, as
    many random A rows as min(rows in A, rows in C, quota)."""
    def levels(df):
        return (df.select(*[F.lower(F.trim(F.col(k).cast("string"))).alias(k) for k in cols])
                .unpivot([], cols, "column", "level").filter((F.col("level") != ""))
                .groupBy("column", "level").agg(F.count(F.lit(1)).alias("n")))

    shared = levels(a).join(levels(c).withColumnRenamed("n", "n_c"), ["column", "level"])
    sizes = {r[0]: r[1] for r in shared.groupBy("column").count().collect()}
    ok = {k: sizes.get(k, 0) for k in cols if 1 < sizes.get(k, 0) <= max_levels}
    if not ok:
        return None, a.withColumn("mark", F.lit(0))
    best = max(ok, key=lambda k: (ok[k], -cols.index(k)))
    take = {r["level"]: min(r["n"], r["n_c"], quota)
            for r in shared.filter(F.col("column") == best).collect()}
    key = F.lower(F.trim(F.col(best).cast("string")))
    # WindowGroupLimit keeps at most ``quota`` rows per level and map task before the shuffle
    w = Window.partitionBy("__key").orderBy("__u", row_id)
    hits = (a.select(row_id, key.alias("__key"), uniform(salt, row_id).alias("__u"))
            .withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= quota)
            .filter(F.col("rn") <= fit.lookup(F.col("__key"), take, 0)).select(row_id, F.lit(1).alias("mark")))
    return best, a.join(hits, row_id, "left").withColumn("mark", F.coalesce("mark", F.lit(0)))


def shuffle_rows(df: DataFrame, salt: str = "shuffle", row_id: str = ROW) -> DataFrame:
    """Give every row a new id 1..n in random order; the old id is dropped."""
    return hash_rank(df, [], salt, row_id, "__new").drop(row_id).withColumnRenamed("__new", row_id)


