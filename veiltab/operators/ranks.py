"""Exact ranks, quantiles and top-n without a single-partition sort.

Three building blocks serve everything that needs an order over the whole table:

* ``cumulative_counts`` - value histogram (map-side combined, so copies of one value
  collapse before the shuffle), cut into value ranges, plus per-range offsets. It gives
  mid-ranks, exact quantiles, rank tests and AUC.
* ``hash_rank`` - dense positions 1..n inside groups in a hashed order. Large groups are
  cut by the leading bits of the hash, so one group never becomes one task.
* ``top_n_bound`` - the exact n-th row in an order, found from bucket counts; marking
  rows against it is a plain comparison without a join.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veiltab.functions.hashing import uniform
from veiltab.operators.joins import keyed_join
from veiltab.operators.nth import nth_bounds
from veiltab.session import materialize

VALUE_RANGES = 64      # value ranges per key when cutting a histogram (a power of two)
HASH_RANGES = 1024     # hash ranges per group in hash_rank
ORDER_RANGES = 64      # order ranges when searching the n-th row or ranking by a value
LAST_SLICE_ROWS = 500_000  # a slice this small is sorted to find the n-th row; larger ones are cut again
NAMED_KEYS = {"column", "metric"}  # keys whose values are names given by the caller, never data
HOT_ROWS = 1_000_000   # rows of one value from which it is matched without a shuffle
TAKE_ORDERED_MAX = 5000  # largest n answered by a bounded take-ordered


def _as_list(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys or [])


def cumulative_counts(
    df: DataFrame,
    keys,
    value: str,
    counts: dict[str, Column] | None = None,
    ranges: int = VALUE_RANGES,
) -> DataFrame:
    """One row per (keys, distinct value) with counts and exclusive running counts.

    ``counts`` maps a name to a 0/1 (or integer) expression to be summed; each name ``c``
    yields ``c`` (count at the value), ``c_before`` (sum over smaller values) and
    ``c_total``. Null values are dropped.
    """
    keys = _as_list(keys)
    counts = counts or {"n": F.lit(1)}
    names = list(counts)
    hist = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(*[F.sum(expr).cast("long").alias(c) for c, expr in counts.items()])
    )
    return running_counts(hist, keys, value, names, ranges)


def running_counts(hist: DataFrame, keys, value: str, names: list[str],
                   ranges: int = VALUE_RANGES) -> DataFrame:
    """Add ``*_before`` and ``*_total`` to a histogram with one row per (keys, value)."""
    keys = _as_list(keys)
    keyed, keys_ = (hist, keys) if keys else (hist.withColumn("__all", F.lit(1)), ["__all"])
    cuts = F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 4 * ranges)
    edges = keyed.groupBy(*keys_).agg(cuts.alias("__edges"))
    few = set(keys) <= NAMED_KEYS  # then one small row per configured name: no shuffle of the histogram
    cut = keyed_join(keyed, F.broadcast(edges) if few else edges, keys_).withColumn("__range", F.lit(0))
    step = ranges // 2
    while step:  # number of edges below the value: unrolled binary search over ranges - 1 edges
        probe = F.get("__edges", F.col("__range") + (step - 1))
        cut = cut.withColumn("__range", F.col("__range") + F.when(F.col(value) > probe, step).otherwise(0))
        step //= 2
    cut = cut.drop("__edges")
    per_range = cut.groupBy(*keys_, "__range").agg(*[F.sum(c).alias(c) for c in names])
    by_range = Window.partitionBy(*keys_).orderBy("__range")
    whole = Window.partitionBy(*keys_)
    offsets = per_range.select(
        *keys_, "__range",
        *[F.coalesce(F.sum(c).over(by_range.rowsBetween(Window.unboundedPreceding, -1)),
                     F.lit(0)).alias(f"__{c}_off") for c in names],
        *[F.sum(c).over(whole).alias(f"{c}_total") for c in names],
    )
    inside = Window.partitionBy(*keys_, "__range").orderBy(value).rowsBetween(
        Window.unboundedPreceding, -1)
    placed = cut.select(
        *keys_, "__range", value, *names,
        *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__{c}_in") for c in names],
    )
    out = keyed_join(placed, F.broadcast(offsets) if few else offsets, [*keys_, "__range"])
    return out.select(
        *keys, value, *names,
        *[(F.col(f"__{c}_off") + F.col(f"__{c}_in")).alias(f"{c}_before") for c in names],
        *[f"{c}_total" for c in names],
    )


def attach_by_value(rows: DataFrame, hist: DataFrame, keys, value: str, add: list[str], row_id: str) -> DataFrame:
    """Bring histogram results (``hist``: keys, value, n, ``add`` columns) back to the rows.

    Values with at least HOT_ROWS rows number at most rows / HOT_ROWS; they are broadcast and
    matched where the rows are. Their rows then carry a salt that no other entry has, so the
    shuffled join of the remaining values never gathers a hot value in one task.
    """
    on = [*_as_list(keys), value]
    hot = hist.filter(F.col("n") >= HOT_ROWS).select(*on, F.lit(True).alias("__hot"), *[F.col(c).alias(f"__h_{c}") for c in add])
    cold = hist.filter(F.col("n") < HOT_ROWS).select(*on, F.lit(0).alias("__salt"), *add)
    tagged = keyed_join(rows, F.broadcast(hot), on, "left").withColumn(
        "__salt", F.when(F.col("__hot"), 1 + F.pmod(F.xxhash64(row_id), F.lit(1024))).otherwise(0).cast("int"))
    out = keyed_join(tagged, cold, [*on, "__salt"], "left")
    return out.select(*rows.columns, *[F.coalesce(F.col(f"__h_{c}"), F.col(c)).alias(c) for c in add])


def mid_ranks(df: DataFrame, keys, value: str) -> DataFrame:
    """Average rank of ties: one row per (keys, value) with ``n`` and ``mid_rank``."""
    return cumulative_counts(df, keys, value).withColumn(
        "mid_rank", F.col("n_before") + (F.col("n") + 1) / 2.0
    )


def exact_quantiles(df: DataFrame, keys, value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per key, one column per entry of ``probs``.

    The two order statistics around each position are read off the running counts, so no
    aggregation buffer ever holds the values of a group.
    """
    keys = _as_list(keys)
    cum = cumulative_counts(df, keys, value)
    aggs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("n_total") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        frac = pos - lo

        def covers(k):
            return (F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n"))

        part = F.when(covers(lo), F.col(value) * (1 - frac)).otherwise(F.lit(0.0)) + F.when(
            covers(hi), F.col(value) * frac).otherwise(F.lit(0.0))
        aggs.append(F.sum(part).alias(name))
    aggs.append(F.max("n_total").alias("n_valid"))
    return cum.groupBy(*keys).agg(*aggs)


def column_quantiles(df: DataFrame, cols: list[str], probs: dict[str, float]) -> DataFrame:
    """``exact_quantiles`` for several columns at once (one unpivot, one job)."""
    return exact_quantiles(long_values(df, cols), ["column"], "value", probs)


def long_values(df: DataFrame, cols: list[str], ids: list[str] | None = None) -> DataFrame:
    """Unpivot numeric columns to (ids, column, value DOUBLE)."""
    ids = ids or []
    wide = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    return wide.unpivot(ids, cols, "column", "value")


def hash_rank(df: DataFrame, keys, salt: str, row_id: str = "row_id",
              out: str = "rn", ranges: int = HASH_RANGES) -> DataFrame:
    """Exact position 1..n of each row in its group, ordered by (hashed draw, row id)."""
    draw = df.withColumn("__u", uniform(salt, row_id))
    return sliced_rank(draw, keys, F.floor(F.col("__u") * ranges), ["__u", row_id], out).drop("__u")


def id_rank(df: DataFrame, keys, row_id: str = "row_id", out: str = "rn") -> DataFrame:
    """Exact position 1..n of each row in its group in row-id order."""
    cuts = [i / ORDER_RANGES for i in range(1, ORDER_RANGES)]
    edges = df.agg(F.percentile_approx(row_id, cuts, 4 * ORDER_RANGES).alias("e")).first()["e"] or []
    return sliced_rank(df, keys, below(row_id, edges), [row_id], out)


def below(c: str, edges: list) -> Column:
    """How many of the (literal) edges lie below the column, by binary search in SQL text."""
    edges = sorted(set(edges))

    def text(v) -> str:
        return f"CAST('{v!r}' AS DOUBLE)" if isinstance(v, float) else str(v)

    def search(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"CASE WHEN `{c}` > {text(edges[mid])} THEN {search(mid + 1, hi)} ELSE {search(lo, mid)} END"

    return F.expr(search(0, len(edges)))


def sliced_rank(df: DataFrame, keys, slice_: Column, order: list[str], out: str) -> DataFrame:
    """Position in group when ``slice_`` cuts the order into ascending pieces.

    Positions are counted inside (group, slice) and lifted by the sizes of the earlier
    slices, so a group of any size is spread over its slices.
    """
    keys = _as_list(keys)
    keyed, keys_ = (df, keys) if keys else (df.withColumn("__all", F.lit(1)), ["__all"])
    cut = keyed.withColumn("__slice", slice_.cast("long"))
    slices = cut.groupBy(*keys_, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*keys_).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys_)],
        F.col("__slice").alias("__s"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__off"))
    same = F.col("__slice") == F.col("__s")
    for i, k in enumerate(keys_):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = Window.partitionBy(*keys_, "__slice").orderBy(*order)
    ranked = cut.withColumn("__in", F.row_number().over(inside)).join(offsets, same)
    return ranked.select(*df.columns, (F.col("__in") + F.col("__off")).cast("long").alias(out))


def top_n_bound(df: DataFrame, order: Column, n: int, row_id: str = "row_id"):
    """The n-th row by (order ascending, row_id ascending) as ``(order, id)``.

    Returns ``None`` when fewer than n rows have an order value (all of them are inside).
    Small n: a bounded take-ordered. Otherwise the slice holding the row is found from slice
    counts and cut again until it is small, a factor of about ORDER_RANGES per round. Rows
    sharing one order value are cut by row id, so a value that fills a third of the table
    spreads over many slices too.
    """
    base = df.select(order.alias("o"), F.col(row_id).alias("i")).filter(F.col("o").isNotNull())
    if n <= 0:
        raise ValueError("n must be positive")
    if n <= TAKE_ORDERED_MAX:
        last = (base.orderBy("o", "i").limit(n)
                .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("o", "i")).alias("s"))
                .first())
        return (last["s"]["o"], last["s"]["i"]) if last["n"] == n else None
    if not isinstance(base.schema["i"].dataType, T.NumericType):  # no quantiles of text: the search over pivots serves any id
        got = nth_bounds(base.withColumn("__one", F.lit(1)), ["__one"], F.col("o"), n, "i").first()
        return None if got is None or got["__all"] else (got["__bound"]["o"], got["__bound"]["i"])
    base = materialize(base, "ordered")  # read in every round: the order is drawn once
    while True:
        slice_ = order_slices(base, "o", "i")
        if slice_ is None:
            return None
        cut, seen, hit = base.withColumn("b", slice_), 0, None
        for row in sorted(cut.groupBy("b").count().collect()):
            if seen + row["count"] >= n:
                hit = row
                break
            seen += row["count"]
        if hit is None:
            return None
        base, n = cut.filter(F.col("b") == hit["b"]).drop("b"), n - seen
        if hit["count"] <= LAST_SLICE_ROWS:
            break
    nth = (base.withColumn("rn", F.row_number().over(Window.orderBy("o", "i")))
           .filter(F.col("rn") == n).first())
    return (nth["o"], nth["i"])


def order_slices(df: DataFrame, order: str, row_id: str) -> Column | None:
    """Slice number ascending in (order, row id), for at most ~2 ORDER_RANGES^2 slices.

    Edges are approximate quantiles of the order value. A value that repeats among the edges
    fills more than one slice, so its rows are cut further by row-id quantiles.
    """
    cuts = [i / ORDER_RANGES for i in range(1, ORDER_RANGES)]
    edges = df.agg(F.percentile_approx(order, cuts, 4 * ORDER_RANGES).alias("o"),
                   F.percentile_approx(row_id, cuts, 4 * ORDER_RANGES).alias("i")).first()
    if edges["o"] is None:
        return None
    hot = sorted({e for e in edges["o"] if edges["o"].count(e) > 1})

    is_hot = F.col(order).isin(hot) if hot else F.lit(False)
    major = below(order, edges["o"]) * 2 - F.when(is_hot, 0).otherwise(1)
    minor = F.when(is_hot, below(row_id, edges["i"])).otherwise(0)
    return (major * (ORDER_RANGES + 1) + minor).cast("long")


def ordered_rank(df: DataFrame, keys, order: str, row_id: str = "row_id", out: str = "rn") -> DataFrame:
    """Exact position 1..n of each row in its group by (order value, row id)."""
    slice_ = order_slices(df, order, row_id)
    return sliced_rank(df, keys, F.lit(0) if slice_ is None else slice_, [order, row_id], out)


def inside_bound(order: Column, bound, row_id: str = "row_id") -> Column:
    """True for rows at or before the bound of ``top_n_bound``."""
    if bound is None:
        return order.isNotNull()
    o, i = F.lit(bound[0]), F.lit(bound[1])
    return F.coalesce((order < o) | ((order == o) & (F.col(row_id) <= i)), F.lit(False))


def first_n(df: DataFrame, order: Column, n: int, row_id: str = "row_id",
            where: Column | None = None) -> Column:
    """Predicate selecting exactly the first n rows (of those matching ``where``)."""
    if n <= 0:
        return F.lit(False)
    eligible = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    bound = top_n_bound(df.filter(eligible), order, n, row_id)
    return eligible & inside_bound(order, bound, row_id)
