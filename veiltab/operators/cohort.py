"""Exchanging values between rows: swaps, permutations inside groups, local shifts, mixes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veiltab.functions.hashing import gaussian, uniform
from veiltab.operators import fit
from veiltab.operators.joins import attach_groups, group_name, keyed_join
from veiltab.operators.ranks import hash_rank, id_rank, sliced_rank
from veiltab.session import materialize

ROW = "row_id"


def _overlay(df: DataFrame, changed: DataFrame, cols: list[str], row_id: str) -> DataFrame:
    """Write the changed cells (row_id, cols...) over the table; other rows stay."""
    new = changed.select(F.col(row_id).alias("__rid"), F.lit(True).alias("__hit"),
                         *[F.col(c).alias(f"__new_{c}") for c in cols])
    out = df.join(new, F.col(row_id) == F.col("__rid"), "left")
    return out.withColumns({c: F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)) for c in cols}
                           ).select(*df.columns)


def swap_between_cohorts(df: DataFrame, c: str, a: Column, b: Column, share: float, salt: str = "swap",
                         row_id: str = ROW) -> DataFrame:
    """Exchange a column between ``share`` of two cohorts, one to one."""
    n = fit.row(df, a=F.count_if(a), b=F.count_if(b))
    m = min(int(n["a"] * share), int(n["b"] * share))
    if m == 0:
        return df
    side = F.when(a, "a").when(b, "b")
    ranked = materialize(hash_rank(df.select(row_id, c, side.alias("__side")).filter(F.col("__side").isNotNull()),
                                   "__side", salt, row_id).filter(F.col("rn") <= m), "ranked")  # read by both sides
    other = ranked.select("rn", F.when(F.col("__side") == "a", "b").otherwise("a").alias("__side"),
                          F.col(c).alias("__val"))
    changed = ranked.drop(c).join(other, ["rn", "__side"]).withColumnRenamed("__val", c)
    return _overlay(df, changed, [c], row_id)


def swap_records(df: DataFrame, cols: list[str], share: float, group: list[Column] | None = None,
                 salt: str = "pairs", row_id: str = ROW) -> DataFrame:
    """Exchange ``cols`` inside exactly floor(``share`` x rows) disjoint random pairs.

    The rows are the first twice as many of a hashed order. With ``group`` (for example sex and a five-year age
    band) partners come from one group; a row left without one stays as it is.
    """
    keys = {f"__g{i}": g for i, g in enumerate(group or [])}
    base = df.select(row_id, *cols, *[g.alias(k) for k, g in keys.items()])
    n = 2 * int(df.count() * share)
    chosen = materialize(hash_rank(base, [], salt + "/in", row_id, out="__in").filter(F.col("__in") <= n).drop("__in"), "chosen")
    ranked = materialize(hash_rank(chosen, list(keys), salt, row_id), "ranked")  # read by both sides
    partner = F.when(F.col("rn") % 2 == 1, F.col("rn") + 1).otherwise(F.col("rn") - 1)
    other = ranked.select(partner.alias("__p"), *[F.col(k).alias(f"{k}o") for k in keys],
                          *[F.col(c).alias(f"__v{i}") for i, c in enumerate(cols)])
    on = F.col("rn") == F.col("__p")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}o"))
    changed = ranked.select(row_id, "rn", *keys).join(other, on).select(
        row_id, *[F.col(f"__v{i}").alias(c) for i, c in enumerate(cols)])
    return _overlay(df, changed, cols, row_id)


def record_pair_join(df: DataFrame, who: Column, sex: str, age: str, within: int = 5, salt: str = "partner",
                     row_id: str = ROW) -> DataFrame:
    """A random partner of the same sex with |age difference| <= ``within`` for each chosen row.

    The partner's place is drawn from the age histogram and then looked up by (sex, age,
    position), so candidate pairs are never formed. Rows that draw themselves get none.
    """
    people = df.select(row_id, F.col(sex).alias("__sex"), F.col(age).cast("int").alias("__age")).filter(
        F.col("__sex").isNotNull() & F.col("__age").isNotNull())
    hist = people.groupBy("__sex", "__age").agg(F.count(F.lit(1)).alias("__n"))
    near = people.filter(who).select(
        row_id, "__sex", F.explode(F.sequence(F.col("__age") - within, F.col("__age") + within)).alias("__age")
    ).join(hist, ["__sex", "__age"])
    w = Window.partitionBy(row_id)
    cum = near.withColumns({
        "__before": F.coalesce(F.sum("__n").over(w.orderBy("__age").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "__t": F.floor(uniform(salt, row_id) * F.sum("__n").over(w))})
    place = cum.filter((F.col("__t") >= F.col("__before")) & (F.col("__t") < F.col("__before") + F.col("__n"))).select(
        row_id, "__sex", "__age", (F.col("__t") - F.col("__before") + 1).alias("rn"))
    seats = hash_rank(people, ["__sex", "__age"], salt + "/seat", row_id).withColumnRenamed(row_id, "partner_id")
    return place.join(seats, ["__sex", "__age", "rn"]).filter(F.col("partner_id") != F.col(row_id)).select(
        row_id, "partner_id")


def similar_swaps(df: DataFrame, n: int, sex: str, age: str, within: int = 5, salt: str = "swap", row_id: str = ROW) -> DataFrame:
    """(swap, first, second) of up to n swaps in sequence: a random row, which may be drawn again, and a random other row
    of its sex with |age difference| <= ``within``. A row without sex, age or such a partner gives no swap.

    The rows of one sex are numbered by (age, hashed draw), so all partners of a row are one run of places; a partner is
    a drawn place, looked up by (sex, place). Candidate pairs are never formed.
    """
    total = df.count()
    people = df.select(row_id, F.col(sex).alias("__sex"), F.col(age).cast("int").alias("__age")).filter(
        F.col("__sex").isNotNull() & F.col("__age").isNotNull())
    by_age = Window.partitionBy("__sex").orderBy("__age")

    def upto(window):
        return F.coalesce(F.sum("__n").over(window), F.lit(0))

    spans = people.groupBy("__sex", "__age").agg(F.count(F.lit(1)).alias("__n")).select(
        "__sex", "__age", upto(by_age.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"),
        upto(by_age.rangeBetween(Window.unboundedPreceding, -within - 1)).alias("__from"),
        upto(by_age.rangeBetween(-within, within)).alias("__many"))
    ranked = hash_rank(people, ["__sex", "__age"], salt + "/seat", row_id)
    seats = materialize(attach_groups(ranked, spans, ["__sex", "__age"], "inner").select(
        F.col(row_id).alias("first"), "__sex", (F.col("__before") + F.col("rn") - 1).alias("__place"), "__from", "__many"))
    turns = df.sparkSession.range(1, n + 1).select(
        F.col("id").alias("swap"), (1 + _wide_draw(salt + "/first", "id", F.lit(total))).alias("rn"))
    first = hash_rank(df.select(F.col(row_id).alias("first")), [], salt + "/row", "first").join(turns, "rn").drop("rn")
    drawn = seats.filter(F.col("__many") > 1).join(first, "first")
    t = _wide_draw(salt + "/second", "swap", F.col("__many") - 1)
    own = F.col("__place") - F.col("__from")
    asked = drawn.select("swap", "first", "__sex", (F.col("__from") + t + F.when(t >= own, 1).otherwise(0)).alias("__place"))
    found = seats.select(F.col("first").alias("second"), "__sex", "__place")
    return asked.join(found, ["__sex", "__place"]).select("swap", "first", "second")


def _wide_draw(salt: str, row_id: str, n: Column) -> Column:
    """Uniform integer in [0, n) from two hashed draws, which reaches tables beyond 2^32 rows."""
    u = uniform(salt, row_id) + uniform(salt + "/low", row_id) / 4294967296.0
    return F.least(F.floor(u * n), n - 1).cast("long")


def swap_sequence(df: DataFrame, swaps: DataFrame, cols: list[str], row_id: str = ROW) -> DataFrame:
    """Exchange ``cols`` of the rows ``first`` and ``second`` swap after swap, in order of ``swap``; a row may take part
    any number of times. Swap numbers are unique.

    What a row holds before a swap is what its partner of the swap before held. These links are followed for all swaps at
    once by pointer doubling: rounds grow with the logarithm of the longest chain, and the values move once, at the end.
    """
    pair = lambda a, b: F.struct(F.col(a).alias("row"), F.col(b).alias("other"))
    ends = swaps.filter(F.col("first") != F.col("second")).select(
        "swap", F.inline(F.array(pair("first", "second"), pair("second", "first"))))
    turn = Window.partitionBy("row").orderBy("swap")
    events = materialize(ends.withColumns({"to_swap": F.lag("swap").over(turn), "to_row": F.coalesce(F.lag("other").over(turn), F.col("row")),
                                           "is_last": F.lead("swap").over(turn).isNull()}), "swaps")
    links = events.select("swap", "row", "to_swap", "to_row")
    while not links.filter(F.col("to_swap").isNotNull()).isEmpty():
        far = links.select(F.col("swap").alias("__s"), F.col("row").alias("__r"), F.col("to_swap").alias("__ts"), F.col("to_row").alias("__tr"))
        hop = links.join(far, (F.col("to_swap") == F.col("__s")) & (F.col("to_row") == F.col("__r")), "left")
        links = materialize(hop.select("swap", "row", F.col("__ts").alias("to_swap"), F.coalesce("__tr", "to_row").alias("to_row")), "links")
    held = links.select("swap", F.col("row").alias("other"), F.col("to_row").alias("__source"))
    ends_at = events.filter("is_last").select("swap", "row", "other").join(held, ["swap", "other"]).select("row", "__source")
    values = df.select(F.col(row_id).alias("__source"), *[F.col(c).alias(f"__v{i}") for i, c in enumerate(cols)])
    changed = ends_at.join(values, "__source").select(
        F.col("row").alias(row_id), *[F.col(f"__v{i}").alias(c) for i, c in enumerate(cols)])
    return _overlay(df, changed, cols, row_id)


def permute_within_group_columns(df: DataFrame, keys: list[str], cols: list[str], salt: str = "perm",
                                 row_id: str = ROW) -> DataFrame:
    """Permute each column on its own inside the groups.

    Target places and source places are positions in two hashed orders of the group, so a
    large group is never gathered in one task.
    """
    places = hash_rank(df.select(row_id, *keys), keys, f"{salt}/base", row_id)
    out = df.drop(*cols)
    for c in cols:
        values = hash_rank(df.select(row_id, c, *keys), keys, f"{salt}/{c}", row_id).drop(row_id)
        got = _null_safe_join(places, values, keys, row_id, [c])
        out = out.join(got, F.col(row_id) == F.col("__rid")).drop("__rid")
    return out.select(*df.columns)


def _null_safe_join(places: DataFrame, values: DataFrame, keys: list[str], row_id: str, cols: list[str]) -> DataFrame:
    found = keyed_join(places.select(row_id, "rn", *keys), values.select("rn", *keys, *cols), ["rn", *keys])
    return found.select(F.col(row_id).alias("__rid"), *cols)


def assign_tiers(df: DataFrame, tiers: list[list[str]], min_size: int, prob: float = 1.0,
                 salt: str = "tier") -> DataFrame:
    """(key columns, tier, group) per key combination: the first tier whose group of not yet
    placed rows is large enough and is drawn. Decided on the combination counts, not on rows."""
    cols = sorted({c for t in tiers for c in t})
    cube = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n")).withColumns(
        {"__tier": F.lit(None).cast("int"), "__group": F.lit(None).cast("string")})
    for i, t in enumerate(tiers):
        left = F.when(F.col("__tier").isNull(), F.col("__n")).otherwise(0)
        name = F.concat_ws("|", F.lit(str(i)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in t])
        group = F.concat_ws("|", F.lit(str(i)), group_name(t)) if t else F.lit(str(i))
        size = F.sum(left).over(Window.partitionBy(*t)) if t else F.lit(cube.agg(F.sum(left)).first()[0] or 0)
        hit = F.col("__tier").isNull() & (size >= min_size)
        if prob < 1.0:
            hit = hit & (uniform(salt, name) < prob)
        cube = cube.withColumn("__hit", hit).withColumns({
            "__group": F.when(F.col("__hit"), group).otherwise(F.col("__group")),
            "__tier": F.when(F.col("__hit"), i).otherwise(F.col("__tier"))}).drop("__hit")
    return cube.drop("__n")


def permute_within_group_block(df: DataFrame, tiers: list[list[str]], cols: list[str], min_size: int,
                               prob: float = 1.0, salt: str = "block", row_id: str = ROW) -> DataFrame:
    """One permutation for all ``cols``, in the first tier that can take the row; rows that no
    tier takes keep their values. The key columns of the tiers are not altered by the grouping."""
    keys = sorted({c for t in tiers for c in t})
    tier = assign_tiers(df, tiers, min_size, prob, salt).select(*keys, "__group")
    grouped = attach_groups(df, tier, keys, "inner").filter(F.col("__group").isNotNull()).select(row_id, *cols, "__group")
    places = hash_rank(grouped.select(row_id, "__group"), "__group", f"{salt}/base", row_id)
    values = hash_rank(grouped, "__group", f"{salt}/value", row_id).drop(row_id)
    changed = places.join(values, ["rn", "__group"])
    return _overlay(df, changed, cols, row_id)


def permute_local(df: DataFrame, keys: list[str], cols: list[str], window: float = 0.15, salt: str = "local",
                  row_id: str = ROW) -> DataFrame:
    """Cyclic shift of the group by a random amount below the window, after a local shuffle in
    which a fifth of the rows move by up to the window.

    The local exchange is a re-ranking by a jittered position, which needs no loop over rows.
    """
    ranked = id_rank(df.select(row_id, *cols, *keys), keys, row_id)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
    name = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])  # names a draw, not a group
    w = F.least(F.greatest(F.lit(3), F.floor(F.col("__size") * window)), F.col("__size"))
    placed = attach_groups(ranked, sizes, keys, "inner").withColumn("__w", w)
    shift = F.when(F.col("__w") > 1, 1 + F.floor(uniform(f"{salt}/shift", name) * (F.col("__w") - 1))).otherwise(0)
    to = F.pmod(F.col("rn") - 1 - shift, F.col("__size")) + 1
    targets = placed.select(row_id, *keys, to.alias("__place"))
    jitter = F.when(uniform(f"{salt}/move", row_id) < 0.2,
                    F.round((uniform(f"{salt}/by", row_id) * 2 - 1) * F.col("__w"), 6)).otherwise(0.0)
    moved = placed.withColumn("__at", F.col("rn") + jitter)
    values = sliced_rank(moved, keys, F.floor(F.col("__at") / 4096), ["__at", row_id], "__place").select(
        *keys, "__place", *cols)
    return _overlay(df, keyed_join(targets, values, [*keys, "__place"]), cols, row_id)


def convex_mix(df: DataFrame, keys: list[str], cols: list[str], k: int = 3, noise: float = 0.08,
               salt: str = "mix", row_id: str = ROW) -> DataFrame:
    """Weighted mean of k distinct random rows of the group plus N(0, noise * group std).

    The k rows are neighbours in a hashed order starting at a random place, so they are a
    random sample without repetition.
    """
    ranked = hash_rank(df.select(row_id, *keys, *[F.col(c).cast("double").alias(c) for c in cols]),
                       keys, f"{salt}/order", row_id)
    sizes = materialize(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"),
                                  *[F.stddev_pop(F.col(c).cast("double")).alias(f"__s_{c}") for c in cols]))
    start = F.floor(uniform(f"{salt}/start", row_id) * F.col("__size"))
    wanted = attach_groups(df.select(row_id, *keys), sizes.select(*keys, "__size"), keys, "inner").select(
        row_id, *keys, F.explode(F.sequence(F.lit(0), F.least(F.lit(k), F.col("__size").cast("int")) - 1)).alias("__j"),
        start.alias("__start"), "__size").select(
        row_id, *keys, "__j", (F.pmod(F.col("__start") + F.col("__j"), F.col("__size")) + 1).alias("rn"))
    weight = uniform(F.concat(F.lit(f"{salt}/w/"), F.col("__j").cast("string")), row_id)
    parts = wanted.withColumn("__wt", weight).transform(keyed_join, ranked.drop(row_id), [*keys, "rn"])
    mixed = parts.groupBy(row_id, *keys).agg(*[
        F.try_divide(F.sum(F.col(c) * F.col("__wt")), F.sum("__wt")).alias(c) for c in cols])
    noisy = attach_groups(mixed, sizes, keys, "inner").select(row_id, *[
        (F.col(c) + gaussian(f"{salt}/{c}", row_id) * noise * F.col(f"__s_{c}")).alias(c) for c in cols])
    return df.drop(*cols).join(noisy, row_id, "left").select(*df.columns)
