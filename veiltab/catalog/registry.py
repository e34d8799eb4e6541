"""Name -> (Spark query, SQL text) registry behind ``__spark_entry__``."""
from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGISTRY: dict[str, tuple[Callable, str | None]] = {}
MODULES: list[str] = ["profile", "tests", "clean", "perturb", "order", "cohort", "matching", "risk", "synthesis", "files", "models", "recipes", "audits"]



def query(name: str, sql: str | None = None):
    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return add


def load_all() -> dict[str, tuple[Callable, str | None]]:
    for m in MODULES:
        importlib.import_module(f"veiltab.catalog.{m}")
    return REGISTRY


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round doubles so that results compare across engines."""
    return df.select(*[
        F.round(F.col(f"`{c}`"), places).alias(c) if t in ("double", "float") else F.col(f"`{c}`")
        for c, t in df.dtypes])


def r(c, places: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places)
