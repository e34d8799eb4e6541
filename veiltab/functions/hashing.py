"""Seeded randomness as column expressions.

Every random step hashes ``(seed, salt, row id)`` instead of calling ``rand()``:
the draw of a row does not depend on partitioning, survives task retries, and can be
recomputed by any engine that has md5.
"""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 7
TWO_32 = 4294967296.0


def uniform(salt: str | Column, row_id: str | Column = "row_id", seed: int = SEED) -> Column:
    """Uniform draw in [0, 1) for a row."""
    salt_col = F.lit(salt) if isinstance(salt, str) else salt
    id_col = F.col(row_id) if isinstance(row_id, str) else row_id
    text = F.concat_ws("|", F.lit(str(seed)), salt_col, id_col.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(TWO_32)


def gaussian(salt: str, row_id: str | Column = "row_id", seed: int = SEED) -> Column:
    """Standard normal draw (Box-Muller on two hashed uniforms)."""
    u1 = F.greatest(uniform(salt + "/r", row_id, seed), F.lit(1.0 / TWO_32))
    u2 = uniform(salt + "/t", row_id, seed)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def integer_between(lo: int, hi: int, salt: str, row_id: str | Column = "row_id") -> Column:
    """Uniform integer in [lo, hi]."""
    return F.lit(lo) + F.floor(uniform(salt, row_id) * F.lit(float(hi - lo + 1))).cast("int")


def float_between(lo: float, hi: float, salt: str, row_id: str | Column = "row_id") -> Column:
    """Uniform double in [lo, hi)."""
    return F.lit(float(lo)) + uniform(salt, row_id) * F.lit(float(hi - lo))


def weighted_choice(choices: list[tuple[float, float]], salt: str, row_id="row_id") -> Column:
    """Pick a value from ``[(value, probability), ...]`` by one hashed draw."""
    draw = uniform(salt, row_id)
    total = sum(p for _, p in choices)
    out, acc = F.lit(choices[-1][0]), 0.0
    bounds = []
    for value, prob in choices[:-1]:
        acc += prob / total
        bounds.append((acc, value))
    for bound, value in reversed(bounds):
        out = F.when(draw < F.lit(bound), F.lit(value)).otherwise(out)
    return out


def even_choice(values: list[float], salt: str, row_id="row_id") -> Column:
    """Pick one of ``values`` with equal probability."""
    picks = F.array(*[F.lit(v) for v in values])
    return F.element_at(picks, (F.floor(uniform(salt, row_id) * len(values)) + 1).cast("int"))
