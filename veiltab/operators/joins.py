"""Joins on group keys that may be null or hot."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veiltab.session import materialize

BROADCAST_ROWS = 100_000  # rows of a group table up to which it is broadcast
SALTS = 32                # beyond: tasks one key's rows are dealt to


def group_name(keys: list[str]) -> Column:
    """Text of a key combination; null and blank differ, and no two combinations share a name."""
    parts = [F.coalesce(F.concat(F.length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string")), F.lit("-")) for k in keys]
    return F.concat_ws("|", *parts)


def keyed_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by keys of which nulls equal nulls; key columns are the left side's."""
    names = {k: f"__right_{i}" for i, k in enumerate(keys)}
    other = right.select(*[F.col(f"`{k}`").alias(n) for k, n in names.items()], *[F.col(f"`{c}`") for c in right.columns if c not in names])
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(n)) for k, n in names.items()], F.lit(True))
    return left.join(other, same, how).drop(*names.values())


def attach_groups(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join a table with one row per group to the rows of the groups.

    The group table is written once and counted: up to ``BROADCAST_ROWS`` rows it is broadcast and the rows stay where
    they are; beyond, each of its rows is repeated ``SALTS`` times and a hot group's rows are dealt to as many tasks.
    """
    small = materialize(groups, "groups")
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return keyed_join(rows, F.broadcast(small), keys, how)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(SALTS)))
    spread = small.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return keyed_join(salted, spread, [*keys, "__salt"], how).drop("__salt")
