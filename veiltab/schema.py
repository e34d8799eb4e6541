"""Column roles and fixed level tables."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The person-table columns and the levels reported for each category.
PERSON_NUMERIC = ["AGE", "encounter_count", "num_procedures", "num_medications",
                  "num_immunizations", "num_allergies", "num_devices",
                  "mean_systolic_bp", "mean_diastolic_bp", "mean_bmi", "mean_weight"]
PERSON_FLAGS = ["asthma_flag", "stroke_flag", "obesity_flag", "depression_flag"]
PERSON_LEVELS = {
    "GENDER": ["M", "F", "O", "U"],
    "RACE": ["asian", "black", "white", "native", "hawaiian", "other", "unknown"],
    "ETHNICITY": ["hispanic", "nonhispanic", "unknown"],
}


@dataclass(frozen=True)
class RoleSchema:
    """Which column plays which part; nothing is guessed unless ``infer_roles`` is asked."""
    row_id: str
    numeric: list[str]
    categorical: list[str]
    flags: list[str] = field(default_factory=list)
    integer: list[str] = field(default_factory=list)
    target: str | None = None

    @property
    def continuous(self) -> list[str]:
        return [c for c in self.numeric if c not in self.integer]


PERSON = RoleSchema(row_id="row_id", numeric=PERSON_NUMERIC, categorical=list(PERSON_LEVELS),
                    flags=PERSON_FLAGS, integer=PERSON_NUMERIC[:7], target="stroke_flag")


def numeric_share(df: DataFrame, cols: list[str], denominator: str = "nonblank") -> DataFrame:
    """Share of values that parse as numbers per column, counted over non-blank or all rows."""
    def parts(c: str) -> Column:
        text = F.trim(F.col(c).cast("string"))
        ok = F.count_if(text.try_cast("double").isNotNull())
        base = F.count_if(text != "") if denominator == "nonblank" else F.count(F.lit(1))
        return F.struct(F.lit(c).alias("column"), ok.alias("n_parsed"), base.alias("n_base"))

    one = df.agg(F.array(*[parts(c) for c in cols]).alias("x"))
    return one.select(F.inline("x")).withColumn(
        "share", F.coalesce(F.try_divide("n_parsed", "n_base"), F.lit(0.0)))


def infer_roles(df: DataFrame, cols: list[str], threshold: float = 0.95,
                denominator: str = "nonblank") -> DataFrame:
    """Column -> 'numeric' / 'categorical'. ``threshold=0`` means any parsed value suffices."""
    share = numeric_share(df, cols, denominator)
    is_num = (F.col("n_parsed") > 0) if threshold <= 0 else (F.col("share") >= threshold)
    return share.withColumn("role", F.when(is_num, "numeric").otherwise("categorical"))


def level_grid(df: DataFrame, levels: dict[str, list]) -> DataFrame:
    """The configured (column, ordinal, level) table; its size is fixed by configuration."""
    rows = [(c, i, str(v)) for c, vs in levels.items() for i, v in enumerate(vs)]
    return df.sparkSession.createDataFrame(rows, "column string, ord int, level string")


def resolve_columns(df: DataFrame, names: list[str]) -> tuple[dict[str, str], list[str]]:
    """Case-insensitive lookup of ``names``: (name -> actual column, not found)."""
    actual = {c.strip().lower(): c for c in reversed(df.columns)}
    found = {n: actual[n.strip().lower()] for n in names if n.strip().lower() in actual}
    return found, [n for n in names if n not in found]


def add_missing_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add absent columns as typed nulls."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items()
                           if c.lower() not in have})
