"""Cell-level perturbation: categories, numbers and flags, all driven by hashed draws."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veiltab.functions.clean import range_clip
from veiltab.functions.hashing import (even_choice, float_between, gaussian, integer_between,
                                       uniform, weighted_choice)
from veiltab.operators import fit
from veiltab.operators.joins import attach_groups
from veiltab.operators.ranks import first_n
from veiltab.session import materialize

ROW = "row_id"


def _num(c: str) -> Column:
    return F.col(c).cast("double")


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")


# ---------------------------------------------------------------- categories

def _numbered_levels(df: DataFrame, c: str) -> DataFrame:
    """Written table ``level, n, at, place``: rows of smaller levels and number of smaller levels."""
    return materialize(_text_counts(fit.level_table(df.withColumn(c, F.col(c).cast("string")), c)), "levels")


def _text_counts(table: DataFrame) -> DataFrame:
    """Running counts of text levels: cut by their first bytes, counted inside and lifted by the sizes of the earlier cuts."""
    cut = table.withColumn("_cut", F.substring(F.encode("level", "utf-8"), 1, 2))
    sizes = cut.groupBy("_cut").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_m"))
    earlier = Window.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)  # at most 65,536 cuts
    starts = sizes.select("_cut", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_at"), F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_place"))
    inside = Window.partitionBy("_cut").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    own = cut.withColumn("n_in", F.coalesce(F.sum("n").over(inside), F.lit(0))).withColumn("m_in", F.coalesce(F.count(F.lit(1)).over(inside), F.lit(0)))
    return own.join(F.broadcast(starts), "_cut").select("level", "n", (F.col("_at") + F.col("n_in")).alias("at"), (F.col("_place") + F.col("m_in")).alias("place"))


def replace_category_uniform(df: DataFrame, c: str, p: float, salt: str = "", row_id: str = ROW) -> DataFrame:
    """With probability p take another observed non-blank level, all equally likely.

    Levels are numbered; the draw is a number among the others, and a join by number brings the level.
    """
    levels = _numbered_levels(df, c)
    total = levels.count()
    hit = (uniform(f"{salt}{c}/p", row_id) < p) & ~_blank(c)
    own = attach_groups(df, levels.select(F.col("level").alias(c), F.col("place").alias("__own")), [c])
    t = F.floor(uniform(f"{salt}{c}/v", row_id) * (total - 1))
    drawn = own.withColumn("__slot", F.when(hit & (total > 1), t + F.when(t >= F.col("__own"), 1).otherwise(0)))
    picked = attach_groups(drawn, levels.select(F.col("place").alias("__slot"), F.col("level").alias("__pick")), ["__slot"])
    return picked.withColumn(c, F.coalesce("__pick", F.col(c))).select(*df.columns)


def replace_category_weighted(df: DataFrame, c: str, p: float, salt: str = "", row_id: str = ROW) -> DataFrame:
    """With probability p take another level, in proportion to the observed frequencies.

    The draw lands on a position among the rows of other levels; positions at or after the own level's stretch are
    shifted past it. Positions are cut into as many equal slots as there are levels: a slot's entry lists the levels it
    meets (an equi-join by slot number), and the position picks among them. A slot meets two levels on average; as levels
    number the slots, all lists together hold less than twice the levels, and a row only carries its own slot's list.
    """
    levels = _numbered_levels(df, c)
    got = levels.agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n")).first()
    if got["m"] < 2:
        return df
    width = -(-got["n"] // got["m"])
    hit = (uniform(f"{salt}{c}/p", row_id) < p) & ~_blank(c)
    own = attach_groups(df, levels.select(F.col("level").alias(c), F.col("at").alias("__at"), F.col("n").alias("__n")), [c])
    t = F.floor(uniform(f"{salt}{c}/v", row_id) * (F.lit(got["n"]) - F.col("__n")))
    t = F.when(hit, t + F.when(t >= F.col("__at"), F.col("__n")).otherwise(0))
    drawn = own.withColumn("__t", t).withColumn("__slot", F.floor(F.col("__t") / width))
    reach = F.sequence(F.floor(F.col("at") / width), F.floor((F.col("at") + F.col("n") - 1) / width))
    slots = levels.select(F.explode(reach).alias("__slot"), F.struct((F.col("at") + F.col("n")).alias("end"), "level").alias("e")).groupBy("__slot").agg(
        F.sort_array(F.collect_list("e")).alias("__met"))
    met = attach_groups(drawn, slots, ["__slot"])
    first = F.get(F.filter("__met", lambda e: e["end"] > F.col("__t")), F.lit(0))["level"]
    return met.withColumn(c, F.when(hit, F.coalesce(first, F.col(c))).otherwise(F.col(c))).select(*df.columns)


def replace_value_fixed(df: DataFrame, c: str, moves: list[tuple[str, str, float]], salt: str = "",
                        row_id: str = ROW) -> DataFrame:
    """Move level a to level b with its probability, one draw per row."""
    draw = uniform(f"{salt}{c}/move", row_id)
    out = F.col(c)
    for a, b, p in moves:
        out = F.when((F.col(c) == a) & (draw < p), F.lit(b)).otherwise(out)
    return df.withColumn(c, out)


def randomise_level(df: DataFrame, c: str, level: str, p: float, to: list[str], salt: str = "",
                    row_id: str = ROW) -> DataFrame:
    """Rows of one level take one of ``to`` at random with probability p."""
    hit = (F.col(c) == level) & (uniform(f"{salt}{c}/rnd", row_id) < p)
    return df.withColumn(c, F.when(hit, even_choice(to, f"{salt}{c}/to", row_id)).otherwise(F.col(c)))


def merge_levels_probabilistic(df: DataFrame, c: str, to: str, tiny_ratio: float, listed: list[str],
                               p: float = 0.7, salt: str = "", row_id: str = ROW) -> DataFrame:
    """Listed levels at or below the ratio always merge; those above it merge with probability p."""
    asked = fit.row(df, n=F.count(F.lit(1)), **{f"l{i}": F.count_if(F.col(c) == v) for i, v in enumerate(listed)})
    counts = {v: asked[f"l{i}"] for i, v in enumerate(listed) if asked[f"l{i}"]}
    total = asked["n"]
    tiny = [v for v in listed if v in counts and counts[v] <= tiny_ratio * total]
    large = [v for v in listed if v in counts and v not in tiny]
    out = F.col(c)
    if large:
        out = F.when(F.col(c).isin(large) & (uniform(f"{salt}{c}/merge", row_id) < p), to).otherwise(out)
    if tiny:
        out = F.when(F.col(c).isin(tiny), to).otherwise(out)
    return df.withColumn(c, out)


def remap_levels_in_order(df: DataFrame, c: str, listed: list[str], to: list[tuple[str, float]],
                          salt: str = "", row_id: str = ROW) -> DataFrame:
    """Each listed level in turn is redrawn from ``to``; a level drawn earlier may be redrawn."""
    out = F.col(c)
    for v in listed:
        out = F.when(out == v, weighted_choice(to, f"{salt}{c}/remap/{v}", row_id)).otherwise(out)
    return df.withColumn(c, out)


def match_share(df: DataFrame, c: str, level: str, other: str, target: float, cap: float | None = None,
                step: float = 1.0, salt: str = "", row_id: str = ROW) -> DataFrame:
    """Move exactly as many rows between two levels as brings ``level`` to its target share of
    all rows (``step`` of the gap, at most ``cap`` of all rows)."""
    got = fit.row(df, n=F.count(F.lit(1)), have=F.count_if(F.col(c) == level))
    gap = int(got["n"] * target) - got["have"] if step == 1.0 else \
        int(got["n"] * (target - got["have"] / max(got["n"], 1)) * step)
    move = min(abs(gap), int(cap * got["n"])) if cap is not None else abs(gap)
    src, dst = (other, level) if gap > 0 else (level, other)
    hit = first_n(df, uniform(f"{salt}{c}/share", row_id), move, row_id, F.col(c) == src)
    return df.withColumn(c, F.when(hit, dst).otherwise(F.col(c)))


# ---------------------------------------------------------------- numbers

def _replace_blanks(df: DataFrame, c: str, value: Column, n_blank: int, salt: str, row_id: str) -> DataFrame:
    """Write ``value`` everywhere, then blank as many random rows as were blank before."""
    if n_blank == 0:
        return df.withColumn(c, value)
    hit = first_n(df, uniform(f"{salt}{c}/hole", row_id), n_blank, row_id)
    return df.withColumn(c, F.when(~hit, value))


def noise_int_uniform(df: DataFrame, c: str, lo: int, hi: int, blanks: str = "replace", upper: bool = True,
                      salt: str = "", row_id: str = ROW) -> DataFrame:
    """Add an integer from [lo, hi], clipped to the observed range.

    ``blanks='replace'``: blanks are filled uniformly and the same number of blanks is put on
    random rows; ``'keep'``: blanks stay where they are.
    """
    got = fit.row(df, lo=F.min(_num(c)), hi=F.max(_num(c)), blank=F.count_if(F.col(c).isNull()))
    if got["lo"] is None:
        return df
    vmin, vmax = int(got["lo"] // 1), int(-(-got["hi"] // 1))
    x = _num(c) + integer_between(lo, hi, f"{salt}{c}/d", row_id)
    x = range_clip(x, float(vmin), float(vmax)) if upper else F.greatest(x, F.lit(float(vmin)))
    if blanks == "keep":
        return df.withColumn(c, F.when(F.col(c).isNotNull(), F.bround(x).cast("int")))
    fill = integer_between(vmin, vmax, f"{salt}{c}/fill", row_id)
    value = F.coalesce(F.bround(x).cast("int"), fill)
    return _replace_blanks(df, c, value, got["blank"], salt, row_id)


def noise_int_positive_only(df: DataFrame, c: str, lo: int, hi: int, salt: str = "", row_id: str = ROW) -> DataFrame:
    """Only values >= 1 change and stay >= 1."""
    x = F.greatest(F.col(c) + integer_between(lo, hi, f"{salt}{c}/d", row_id), F.lit(1))
    return df.withColumn(c, F.when(F.col(c) >= 1, x).otherwise(F.col(c)).cast("int"))


def noise_age(df: DataFrame, c: str, delta: int, lo: int = 2, hi: int = 110, salt: str = "",
              row_id: str = ROW) -> DataFrame:
    """Plus/minus up to ``delta``, clipped; blanks stay."""
    x = F.bround(_num(c)) + integer_between(-delta, delta, f"{salt}{c}/d", row_id)
    return df.withColumn(c, range_clip(x, float(lo), float(hi)).cast("int"))


def noise_age_by_segment(df: DataFrame, c: str, segments: list[tuple[float, int]], lo: int = 2,
                         hi: int = 110, salt: str = "", row_id: str = ROW) -> DataFrame:
    """Delta depends on the age: ``[(upper bound, delta), ...]`` in ascending order."""
    u = uniform(f"{salt}{c}/d", row_id)
    d = None
    for bound, delta in segments:
        v = F.floor(u * (2 * delta + 1)) - delta
        d = F.when(F.col(c) <= bound, v) if d is None else d.when(F.col(c) <= bound, v)
    return df.withColumn(c, range_clip(F.bround(_num(c)) + d, float(lo), float(hi)).cast("int"))


def noise_age_by_bin(df: DataFrame, c: str, bin_: Column, delta: int, lo: int, hi: int,
                     min_rows: int = 10, salt: str = "", row_id: str = ROW) -> DataFrame:
    """Plus/minus ``delta`` only inside bins with more than ``min_rows`` rows."""
    sizes = df.groupBy(bin_.alias("b")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_rows)
    bins = [r["b"] for r in sizes.collect() if r["b"] is not None]
    x = range_clip(_num(c) + integer_between(-delta, delta, f"{salt}{c}/d", row_id), float(lo), float(hi))
    return df.withColumn(c, F.when(bin_.isin(bins), x).otherwise(_num(c)).cast("int"))


def noise_float_uniform(df: DataFrame, c: str, lo: float, hi: float, digits: int = 2, blanks: str = "keep",
                        salt: str = "", row_id: str = ROW) -> DataFrame:
    """Add U(lo, hi), clip to the observed range, round; blanks kept or re-placed."""
    got = fit.row(df, lo=F.min(_num(c)), hi=F.max(_num(c)), blank=F.count_if(F.col(c).isNull()))
    if got["lo"] is None:
        return df
    x = F.round(range_clip(_num(c) + float_between(lo, hi, f"{salt}{c}/d", row_id), got["lo"], got["hi"]), digits)
    if blanks == "keep":
        return df.withColumn(c, x)
    fill = F.round(float_between(got["lo"], got["hi"], f"{salt}{c}/fill", row_id), digits)
    return _replace_blanks(df, c, F.coalesce(x, fill), got["blank"], salt, row_id)


def noise_proportional(df: DataFrame, c: str, sigma: float, digits: int | None = 2, salt: str = "",
                       row_id: str = ROW, limits: tuple | None = None) -> DataFrame:
    """x (1 + N(0, sigma)), clipped to the observed (or given) range; ``digits=None`` -> integer."""
    lo, hi = limits or fit.ranges(df, [c])[c]
    if lo is None:
        return df
    x = range_clip(_num(c) * (1 + gaussian(f"{salt}{c}/g", row_id) * sigma), float(lo), float(hi))
    return df.withColumn(c, F.bround(x).cast("int") if digits is None else F.round(x, digits))


def noise_by_group_std(df: DataFrame, limits: dict[str, tuple], bin_: Column, factor: float, salt: str = "",
                       row_id: str = ROW, wide: tuple[float, float] | None = None) -> DataFrame:
    """N(0, factor * std of the value's bin), clipped to the column's limits and rounded; a zero
    or missing std counts as max(1, mean / 10). ``wide=(share, factor)`` gives a share of the
    rows a larger factor. Afterwards missing values take the median of the new values, forced
    into the range. All columns share one fit of the bins and one of the medians.
    """
    cols = list(limits)
    binned = df.withColumn("__bin", bin_)
    g = binned.groupBy(F.col("__bin").alias("b")).agg(
        *[F.avg(_num(c)).alias(f"m_{c}") for c in cols],
        *[F.when(F.count(_num(c)) > 1, F.stddev_samp(_num(c))).alias(f"s_{c}") for c in cols]).collect()
    std = {r["b"]: [None if r[f"m_{c}"] is None else float(r[f"s_{c}"]) if r[f"s_{c}"] else max(1.0, r[f"m_{c}"] * 0.1) for c in cols]
           for r in g if r["b"] is not None}
    known = binned.withColumn("__std", fit.lookup(F.col("__bin"), std).cast("array<double>"))
    moved = {}
    for i, c in enumerate(cols):
        f = F.lit(factor)
        if wide:
            f = F.when(uniform(f"{salt}{c}/wide", row_id) < wide[0], wide[1]).otherwise(f)
        moved[f"__x_{c}"] = _num(c) + gaussian(f"{salt}{c}/g", row_id) * F.col("__std")[i] * f
    # draws stand in a projection of their own (clipping names its value twice) and are written before the medians read them
    noised = materialize(known.withColumns(moved).withColumns({
        c: F.coalesce(F.bround(range_clip(f"__x_{c}", float(lo), float(hi))), _num(c)) for c, (lo, hi) in limits.items()}
    ).select(*df.columns), "noised")
    mid = fit.medians(noised, cols)
    fill = {c: int(min(max(mid[c] if mid[c] is not None else lo, lo), hi)) for c, (lo, hi) in limits.items()}
    return noised.withColumns({
        c: F.when(F.col(c).between(lo, hi), F.col(c)).otherwise(fill[c]).cast("int") for c, (lo, hi) in limits.items()})


def shrink_to_group_mean(df: DataFrame, c: str, bin_: Column, rate: float = 0.1, min_rows: int = 5) -> DataFrame:
    """x + rate * (bin mean - x) inside bins with more than ``min_rows`` rows."""
    g = df.groupBy(bin_.alias("b")).agg(F.avg(_num(c)).alias("m"), F.count(F.lit(1)).alias("n"))
    means = {r["b"]: r["m"] for r in g.collect() if r["b"] is not None and r["n"] > min_rows and r["m"] is not None}
    m = fit.lookup(bin_, means)
    return df.withColumn(c, F.coalesce(_num(c) + rate * (m - _num(c)), _num(c)))


def noise_sparse_choice(df: DataFrame, c: str, share: float, choices: list, lo: float, hi: float,
                        weights: list[float] | None = None, integer: bool = True, salt: str = "",
                        row_id: str = ROW) -> DataFrame:
    """A share of the rows gets one of ``choices`` added, clipped to [lo, hi]."""
    pick = (weighted_choice(list(zip(choices, weights)), f"{salt}{c}/v", row_id) if weights
            else even_choice(choices, f"{salt}{c}/v", row_id))
    x = range_clip(_num(c) + pick, float(lo), float(hi))
    hit = (uniform(f"{salt}{c}/p", row_id) < share) & F.col(c).isNotNull()
    out = F.when(hit, x).otherwise(_num(c))
    return df.withColumn(c, out.cast("int") if integer else F.round(out, 2))


def noise_relative_step(df: DataFrame, c: str, share: float, rate: float, lo: float, hi: float,
                        salt: str = "", row_id: str = ROW) -> DataFrame:
    """A share of the rows moves by up to +-rate of the value, by at least one."""
    u = uniform(f"{salt}{c}/v", row_id) * 2 - 1
    step = F.greatest(F.abs(F.bround(_num(c) * rate * u)), F.lit(1.0)) * F.when(u < 0, -1.0).otherwise(1.0)
    hit = (uniform(f"{salt}{c}/p", row_id) < share) & F.col(c).isNotNull()
    return df.withColumn(c, F.when(hit, range_clip(_num(c) + step, float(lo), float(hi))).otherwise(_num(c)).cast("int"))


def noise_normal_range_aware(df: DataFrame, c: str, normal: tuple[float, float], limits: tuple[float, float],
                             sd: float, pull: tuple[float, float], digits: int = 1, salt: str = "",
                             row_id: str = ROW) -> DataFrame:
    """Inside the normal range: + N(0, sd), kept inside. Outside: pulled toward it by
    |N(pull)| without crossing its edge. Finally clipped to the limits."""
    lo, hi = normal
    x, g = _num(c), F.col("__g")
    move = F.abs(F.lit(pull[0]) + g * pull[1])
    out = (F.when(x.between(lo, hi), range_clip(x + g * sd, float(lo), float(hi)))
           .when(x > hi, F.greatest(x - move, F.lit(float(hi))))
           .when(x < lo, F.least(x + move, F.lit(float(lo)))))
    drawn = df.withColumn("__g", gaussian(f"{salt}{c}/g", row_id))  # one draw a row, used in several places
    return drawn.withColumn(c, F.round(range_clip(out, float(limits[0]), float(limits[1])), digits)).drop("__g")


# ---------------------------------------------------------------- flags

def flip_flag(df: DataFrame, c: str, p: float, where: Column | None = None, salt: str = "",
              row_id: str = ROW) -> DataFrame:
    """0 <-> 1 with probability p on valid values (matching ``where``)."""
    hit = (uniform(f"{salt}{c}/flip", row_id) < p) & F.col(c).isin(0, 1)
    if where is not None:
        hit = hit & F.coalesce(where, F.lit(False))
    return df.withColumn(c, F.when(hit, 1 - F.col(c)).otherwise(F.col(c)))


def flip_cohort_fraction(df: DataFrame, c: str, value: int, share: float, cohort: Column, salt: str = "",
                         row_id: str = ROW) -> DataFrame:
    """Exactly ``share`` of the cohort rows that hold the other value take ``value``."""
    where = cohort & (F.col(c) == 1 - value)
    n = int(df.filter(where).count() * share)
    hit = first_n(df, uniform(f"{salt}{c}/cohort{value}", row_id), n, row_id, where)
    return df.withColumn(c, F.when(hit, value).otherwise(F.col(c)))


def flip_cohort_bernoulli(df: DataFrame, c: str, value: int, share: float, cohort: Column, salt: str = "",
                          row_id: str = ROW) -> DataFrame:
    hit = F.coalesce(cohort, F.lit(False)) & (uniform(f"{salt}{c}/cohort{value}", row_id) < share)
    return df.withColumn(c, F.when(hit, value).otherwise(F.col(c)))


def raise_prevalence_priority(df: DataFrame, c: str, target: float, tiers: list[Column], salt: str = "",
                              row_id: str = ROW, cap: float | None = None) -> DataFrame:
    """Turn exactly as many zeros into ones as reach the target share, best tier first."""
    got = fit.row(df, n=F.count(F.lit(1)), ones=F.count_if(F.col(c) == 1))
    add = int(got["n"] * target) - got["ones"]
    if cap is not None:
        add = min(add, int(got["n"] * cap))
    if add <= 0:
        return df
    tier = F.lit(float(len(tiers)))
    for i in reversed(range(len(tiers))):
        tier = F.when(tiers[i], float(i)).otherwise(tier)
    # tier + draw in [0, 1) orders by tier first and at random inside it
    hit = first_n(df, tier + uniform(f"{salt}{c}/raise", row_id), add, row_id, F.col(c) == 0)
    return df.withColumn(c, F.when(hit, 1).otherwise(F.col(c)))


def adjust_by_flag(df: DataFrame, c: str, flag: str, up: tuple[float, float], down: tuple[float, float],
                   lo: float, hi: float, digits: int = 2, salt: str = "", row_id: str = ROW) -> DataFrame:
    """Shift by U(up) where the flag is 1 and by U(down) where it is 0."""
    u = uniform(f"{salt}{c}/adj", row_id)
    shift = (F.when(F.col(flag) == 1, up[0] + u * (up[1] - up[0]))
             .when(F.col(flag) == 0, down[0] + u * (down[1] - down[0])).otherwise(0.0))
    return df.withColumn(c, F.round(range_clip(_num(c) + shift, float(lo), float(hi)), digits))


def preserve_correlation_nudge(df: DataFrame, a: str, b: str, floor: float, where_above: float,
                               lo: float, hi: float, salt: str = "", row_id: str = ROW) -> DataFrame:
    """If |corr(a, b)| fell below ``floor``: add 1 or 2 to b where a is high and b is below
    the median of a."""
    got = fit.row(df, r=F.try_divide(F.covar_pop(_num(a), _num(b)), F.stddev_pop(_num(a)) * F.stddev_pop(_num(b))))
    if got["r"] is None or abs(got["r"]) >= floor:
        return df
    mid = fit.medians(df, [a])[a]
    hit = (F.col(a) > where_above) & (F.col(b) < mid)
    x = range_clip(_num(b) + integer_between(1, 2, f"{salt}{b}/nudge", row_id), float(lo), float(hi))
    return df.withColumn(b, F.when(hit, x).otherwise(_num(b)).cast("int"))


