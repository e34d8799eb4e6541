"""Casts, normalisers and binning as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _tidy(c: str | Column) -> Column:
    return F.lower(F.trim(_c(c).cast("string")))


def to_number(c: str | Column) -> Column:
    """Number, or null where the text does not parse."""
    return F.trim(_c(c).cast("string")).try_cast("double")


def norm_flag(c: str | Column) -> Column:
    """0/1, anything else null."""
    x = to_number(c)
    return F.when(x.isin(0.0, 1.0), x.cast("int"))


def norm_gender(c: str | Column) -> Column:
    t = F.coalesce(_tidy(c), F.lit(""))
    return (F.when(t.startswith("m"), "M").when(t.startswith("f"), "F")
            .when((t == "o") | t.startswith("oth"), "O").otherwise("U"))


# Keyword -> level, the first keyword contained in the text wins.
RACE_KEYWORDS = [("asian", "asian"), ("black", "black"), ("white", "white"),
                 ("native hawaiian", "hawaiian"), ("hawaiian", "hawaiian"),
                 ("native", "native"), ("other", "other"), ("unknown", "unknown"),
                 ("null", "unknown"), ("none", "unknown")]


def norm_keyword_map(c: str | Column, keywords=RACE_KEYWORDS, default: str = "unknown") -> Column:
    t = _tidy(c)
    out = None
    for word, level in keywords:
        hit = t.contains(word)
        out = F.when(hit, level) if out is None else out.when(hit, level)
    return out.otherwise(default)


def norm_ethnicity(c: str | Column) -> Column:
    t = _tidy(c)
    return (F.when(t.rlike("non|not"), "nonhispanic").when(t.contains("hisp"), "hispanic")
            .otherwise("unknown"))


def clean_category(c: str | Column, missing: str = "___missing___") -> Column:
    """Trimmed lower-case text; blank or null becomes a level of its own."""
    t = F.coalesce(_tidy(c), F.lit(""))
    return F.when(t == "", missing).otherwise(t)


def range_clip(c: str | Column, lo, hi) -> Column:
    """Clip to [lo, hi], keeping null."""
    x = _c(c)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def _bins(c: str | Column, edges: list, values: list, right: bool, include_lowest: bool) -> Column:
    """The value of the first bin that holds x, as one chain of conditions; null outside."""
    x, out = _c(c), None
    for i, value in enumerate(values):
        lo, hi = F.lit(edges[i]), F.lit(edges[i + 1])
        if right:
            low_ok = (x >= lo) if (include_lowest and i == 0) else (x > lo)
            inside = low_ok & (x <= hi)
        else:
            inside = (x >= lo) & (x < hi)
        out = F.when(inside, F.lit(value)) if out is None else out.when(inside, F.lit(value))
    return out


def bin_index(c: str | Column, edges: list, right: bool = False,
              include_lowest: bool = False) -> Column:
    """0-based bin between consecutive edges, null outside. ``right`` closes bins on the right."""
    if len(edges) < 2:
        return F.lit(None).cast("int")
    return _bins(c, edges, list(range(len(edges) - 1)), right, include_lowest)


def bin_label(c: str | Column, edges: list, labels: list[str], right: bool = False,
              include_lowest: bool = False) -> Column:
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per bin is needed")
    if not labels:
        return F.lit(None).cast("string")
    return _bins(c, edges, labels, right, include_lowest)


def open_bins(edges: list) -> tuple[list, list[str]]:
    """Left-closed bins with an open last bin: (edges with an infinite top, labels)."""
    edges = sorted(edges)
    if len(edges) < 3:
        raise ValueError("at least three edges (two groups) are needed")
    labels = [f"{int(a)}-{int(b) - 1}" for a, b in zip(edges[:-2], edges[1:-1])]
    return edges[:-1] + [float("inf")], labels + [f"{int(edges[-2])}+"]


def group_named(c: str | Column, listed: list[str], label: str) -> Column:
    """Map listed levels to one label."""
    return F.when(_c(c).isin(listed), F.lit(label)).otherwise(_c(c))


def bmi_category(bmi: str | Column, age: str | Column) -> Column:
    b = _c(bmi)
    return (F.when(b.isNull() | _c(age).isNull(), None).when(_c(age) < 18, "child")
            .when(b < 18.5, "underweight").when(b < 25, "normal")
            .when(b < 30, "overweight").otherwise("obese"))


def in_range(c: str | Column, lo, hi) -> Column:
    return _c(c).between(F.lit(lo), F.lit(hi))


def in_range_by_band(c: str | Column, band: str | Column,
                     ranges: list[tuple[float, float, float, float]]) -> Column:
    """Range check whose limits depend on a band value: rows are (from, below, lo, hi)."""
    out = None
    for start, stop, lo, hi in ranges:
        here = (_c(band) >= start) & (_c(band) < stop)
        out = F.when(here, in_range(c, lo, hi)) if out is None else out.when(here, in_range(c, lo, hi))
    return out


def ensure_category(c: str | Column, label: str = "Unknown") -> Column:
    t = F.trim(_c(c).cast("string"))
    return F.when(t.isNull() | (t == ""), F.lit(label)).otherwise(t)


def ensure_flag(c: str | Column) -> Column:
    return F.coalesce(norm_flag(c), F.lit(0))


def top_code(c: str | Column, limit, fill: Column | None = None) -> Column:
    x = F.least(_c(c), F.lit(limit))
    out = F.when(_c(c).isNotNull(), x)
    return out if fill is None else F.coalesce(out, F.least(fill, F.lit(limit)))


def odds_to_unit(c: str | Column) -> Column:
    """x / (1 + x)."""
    return _c(c) / (1 + _c(c))


def vif_to_unit(c: str | Column) -> Column:
    """1 - 1/max(v, 1); 0 where v is missing or not finite."""
    v = _c(c)
    bad = v.isNull() | F.isnan(v) | v.isin(float("inf"), float("-inf"))
    return F.when(bad, 0.0).otherwise(1.0 - 1.0 / F.greatest(v, F.lit(1.0)))


def unit_l2(vec: str | Column) -> Column:
    """Vector divided by its Euclidean length."""
    norm = F.sqrt(F.aggregate(_c(vec), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(_c(vec), lambda x: x.cast("double") / (norm + 1e-12))
