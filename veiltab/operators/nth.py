"""The exact n-th row of every key at once, and marks of the first n rows per key.

One loop serves all keys, however many and however unequal: a small hashed sample of each key's rows gives it some pivots,
one count per (key, slot between pivots) tells which slot holds its n-th row, and only these slots' rows go on. Rows left
shrink by about the number of pivots per round; when no key has more than ``LAST_ROWS`` left, these are sorted. Rows are
compared as (order, row id), so values that tie, text ids and a key that holds most of the table need no other way. A value
that is a pivot has a slot of its own, hence copies of one row end the search.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veiltab.operators.joins import attach_groups, keyed_join
from veiltab.session import materialize

PIVOTS = 32
SAMPLE = 128          # rows of a key its pivots are drawn from, on average
LAST_ROWS = 100_000   # rows of a key that are sorted together in the end


def nth_bounds(df: DataFrame, keys: list[str], order: Column, n: int | DataFrame, row_id: str = "row_id") -> DataFrame:
    """Per key the n-th row by (order, row id): ``keys, __all, __bound`` (struct of both).

    ``n`` is a number or a table with a column ``n`` per key. ``__all`` is true where a key has no more than n rows; keys of
    which none are wanted have no row. Rows without an order value do not count; null keys are a key like others.
    """
    rows = materialize(df.select(*keys, F.struct(order.alias("o"), F.col(row_id).alias("i")).alias("__at")).filter(F.col("__at.o").isNotNull()), "ordered")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__have"))
    asked = sizes.withColumn("__n", F.lit(n).cast("long")) if isinstance(n, int) else keyed_join(sizes, n.select(*keys, F.col("n").cast("long").alias("__n")), keys)
    asked = materialize(asked.filter("__n > 0"), "asked")
    none = F.lit(None).cast(rows.schema["__at"].dataType)
    found = asked.filter("__have <= __n").select(*keys, F.lit(True).alias("__all"), none.alias("__bound"))
    open_ = asked.filter("__have > __n")
    salt = 0
    while (most := open_.agg(F.max("__have")).first()[0]) is not None:
        if most <= LAST_ROWS:
            place = F.row_number().over(Window.partitionBy(*keys).orderBy("__at"))
            last = attach_groups(rows, open_.select(*keys, "__n"), keys, "inner").withColumn("__place", place).filter("__place = __n")
            return materialize(found.unionByName(last.select(*keys, F.lit(False).alias("__all"), F.col("__at").alias("__bound"))), "bounds")
        salt += 1
        chance = F.pmod(F.xxhash64("__at", F.lit(salt)), F.lit(1 << 30)) * F.col("__have") < F.lit(SAMPLE << 30)
        live = attach_groups(rows, open_, keys, "inner")
        drawn = live.groupBy(*keys).agg(F.min("__at").alias("__least"), F.array_sort(F.collect_set(F.when(chance, F.col("__at")))).alias("__drawn"))
        step = F.greatest(F.lit(1), F.ceil(F.size("__drawn") / PIVOTS)).cast("int")
        some = F.filter("__drawn", lambda p, at: at % step == 0)
        pivots = materialize(keyed_join(open_, drawn.select(*keys, F.array_sort(F.array_union(F.array("__least"), some)).alias("__pivots")), keys), "pivots")
        slot = F.size(F.filter("__pivots", lambda p: p < F.col("__at"))) * 2 + F.array_contains("__pivots", F.col("__at")).cast("int")
        cut = attach_groups(rows, pivots, keys, "inner").withColumn("__slot", slot)
        upto = F.sum("__c").over(Window.partitionBy(*keys).orderBy("__slot"))
        counts = cut.groupBy(*keys, "__slot").agg(F.count(F.lit(1)).alias("__c")).withColumn("__upto", upto)
        hit = keyed_join(counts, pivots, keys).filter("__upto - __c < __n and __n <= __upto")
        hit = materialize(hit.select(*keys, "__slot", F.col("__c").alias("__have"), (F.col("__n") - F.col("__upto") + F.col("__c")).alias("__n"), "__pivots"), "slots")
        exact = F.col("__slot") % 2 == 1
        found = found.unionByName(hit.filter(exact).select(*keys, F.lit(False).alias("__all"), F.get("__pivots", ((F.col("__slot") - 1) / 2).cast("int")).alias("__bound")))
        inside = hit.filter(~exact).select(*keys, F.col("__slot").alias("__mine"), "__pivots")
        rows = materialize(attach_groups(rows, inside, keys, "inner").filter(slot == F.col("__mine")).select(*keys, "__at"), "ordered")
        open_ = hit.filter(~exact).select(*keys, "__have", "__n")
    return materialize(found, "bounds")


def first_n_by_key(df: DataFrame, keys: list[str], order: Column, n: int | DataFrame, row_id: str = "row_id", where: Column | None = None, out: str = "hit") -> DataFrame:
    """``df`` with ``out``: true on exactly the first n rows of every key (of those matching ``where``). Row ids are unique within a key."""
    eligible = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    bounds = nth_bounds(df.filter(eligible), keys, order, n, row_id)
    inside = F.col("__all") | (F.struct(order.alias("o"), F.col(row_id).alias("i")) <= F.col("__bound"))
    return attach_groups(df, bounds, keys).withColumn(out, F.coalesce(eligible & order.isNotNull() & inside, F.lit(False))).select(
        *[F.col(f"`{c}`") for c in df.columns if c != out], out)
