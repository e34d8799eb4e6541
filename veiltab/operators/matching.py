"""Marking population rows by their closeness to released rows."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veiltab.functions.hashing import SEED, uniform
from veiltab.operators import fit
from veiltab.operators.joins import attach_groups
from veiltab.operators.neighbours import View, knn
from veiltab.operators.ranks import first_n, ordered_rank
from veiltab.operators.scale import quantile_bucket, quantile_edges, unit_rescale
from veiltab.session import materialize


def nearest_neighbour_mark(a: DataFrame, c: DataFrame, metric: str = "l1") -> DataFrame:
    """1 on every population row that is some released row's nearest neighbour."""
    hits = knn(a, c, 1, metric).select("id").distinct().withColumn("mark", F.lit(1))
    return a.select("id").join(hits, "id", "left").withColumn("mark", F.coalesce("mark", F.lit(0)))


def _best_hit(found: DataFrame) -> DataFrame:
    """Best (distance, rank) per population row as one sortable number per row."""
    return found.groupBy("id").agg(F.min(F.struct("dist", "rank")).alias("b")).select(
        "id", "b.dist", "b.rank")


def _hit_order() -> Column:
    """(distance, rank) as one exact number: distances are multiples of 1e-9, ranks below 1e9 follow."""
    return F.round(F.col("dist") * 1e9).cast("decimal(28,0)") * F.lit(1_000_000_000).cast("decimal(10,0)") + F.col("rank")


def _take_ranked(hits: DataFrame, n: int) -> Column:
    """The first n rows by (distance, rank, id)."""
    return first_n(hits, _hit_order(), n, "id")


def fill_by_distance(a: DataFrame, c: DataFrame, marked: DataFrame, n: int, metric: str = "l1") -> DataFrame:
    """Add the n unmarked population rows closest to any released row."""
    rest = a.join(marked.select("id"), "id", "left_anti")
    found = knn(c, rest, 1, metric)
    # equal vectors were searched once: bring the distance back to each of them
    vec = ["num", "cat", "w"] if "part" not in rest.columns else ["part", "num", "cat", "w"]
    near = rest.join(rest.groupBy(*vec).agg(F.min("id").alias("qid")), vec).select("id", "qid").join(
        found.select("qid", "dist"), "qid").select("id", "dist")
    near = materialize(near)
    return near.filter(first_n(near, F.col("dist"), n, "id")).select("id")


def ranked_assign(a: DataFrame, c: DataFrame, n: int, k: int = 7, metric: str = "l1") -> DataFrame:
    """Hits in order of (distance, rank), each population row once, until n marks; missing
    marks are filled by population-to-release distance."""
    hits = materialize(_best_hit(knn(a, c, k, metric)))
    marked = hits.filter(_take_ranked(hits, n)).select("id")
    have = hits.count()
    if have < n:
        marked = marked.unionByName(fill_by_distance(a, c, marked, n - have, metric))
    return _as_marks(a, marked)


def _as_marks(a: DataFrame, marked: DataFrame) -> DataFrame:
    return a.select("id").join(marked.withColumn("mark", F.lit(1)), "id", "left").withColumn(
        "mark", F.coalesce("mark", F.lit(0)))


def level_overlap(a: DataFrame, c: DataFrame, cols: list[str]) -> DataFrame:
    """Per category: levels in A, in C and in both (blank as a level of its own)."""
    def levels(df, flag):
        return df.select(*[F.coalesce(F.nullif(F.lower(F.trim(F.col(k).cast("string"))), F.lit("")), F.lit("__miss__"))
                           .alias(k) for k in cols]).unpivot([], cols, "column", "level").groupBy(
            "column", "level").agg(F.lit(1).alias(flag))

    both = levels(a, "in_a").join(levels(c, "in_c"), ["column", "level"], "full_outer")
    return both.groupBy("column").agg(F.count("in_a").alias("n_a"), F.count("in_c").alias("n_c"),
                                      F.count_if(F.col("in_a").isNotNull() & F.col("in_c").isNotNull()).alias("n_both"))


def block_key(a: DataFrame, c: DataFrame, cats: list[str], numeric: list[str], q: int = 5,
              max_levels: int = 20) -> tuple[Column | None, str | None, str | None]:
    """(key expression, category, number): the category with 2..max_levels shared levels and the
    largest shared share, plus quantile bins (A's edges on both sides) of the first number that
    is 30 % filled and has more than 10 values."""
    stats = {r["column"]: r for r in level_overlap(a, c, cats).collect()}
    ok = [k for k in cats if k in stats and 1 < stats[k]["n_both"] <= max_levels]
    if not ok:
        return None, None, None
    cat = max(ok, key=lambda k: (stats[k]["n_both"] / max(stats[k]["n_a"], 1), -cats.index(k)))
    got = fit.row(a, n=F.count(F.lit(1)), **{f"n_{k}": F.count(k) for k in numeric},
                  **{f"d_{k}": F.approx_count_distinct(k) for k in numeric})
    num = next((k for k in numeric if got[f"n_{k}"] > 0.3 * got["n"] and got[f"d_{k}"] > 10), None)
    key = F.coalesce(F.nullif(F.lower(F.trim(F.col(cat).cast("string"))), F.lit("")), F.lit("__miss__"))
    if num is not None:
        key = F.concat_ws("|", key, quantile_bucket(num, quantile_edges(a, num, q)))
    return key, cat, num


def block_knn_assign(a: DataFrame, c: DataFrame, n: int, k: int = 5, metric: str = "l1") -> DataFrame:
    """Quota per block in proportion to min(rows in A, rows in C); inside a block the best
    hits by (distance, rank); missing marks are filled by distance over the whole tables.

    Both inputs carry ``part`` = block key.
    """
    shared = materialize(a.groupBy("part").agg(F.count(F.lit(1)).alias("n_a")).join(
        c.groupBy("part").agg(F.count(F.lit(1)).alias("n_c")), "part").select("part", F.least("n_a", "n_c").alias("both")))
    total = max(shared.agg(F.sum("both")).first()[0] or 0, 1)
    quota = shared.select("part", F.bround(F.col("both") * n / total).cast("long").alias("quota"))
    hits = materialize(knn(a, c, k, metric).groupBy("part", "id").agg(
        F.min(F.struct("dist", "rank")).alias("b")).select("part", "id", "b.dist", "b.rank"))
    ranked = ordered_rank(hits.withColumn("o", _hit_order()), "part", "o", "id")
    marked = materialize(attach_groups(ranked, quota, ["part"]).filter(F.col("rn") <= F.coalesce("quota", F.lit(0))).select("id"))
    have = marked.count()
    if have < n:
        marked = marked.unionByName(fill_by_distance(a.drop("part"), c.drop("part"), marked, n - have, metric))
    elif have > n:
        best = hits.join(marked, "id", "left_semi")
        marked = best.filter(_take_ranked(best, n)).select("id")
    return _as_marks(a, marked)


def stable_categories(a: DataFrame, c: DataFrame, cats: list[str], max_levels: int = 10, pick: int = 2) -> list[str]:
    """Low-cardinality categories with the largest overlap (fewest levels break ties)."""
    stats = {r["column"]: r for r in level_overlap(a, c, cats).collect()}
    ok = [k for k in cats if k in stats and 1 <= stats[k]["n_a"] <= max_levels and 1 <= stats[k]["n_c"] <= max_levels]
    return sorted(ok, key=lambda k: (-stats[k]["n_both"], stats[k]["n_a"] + stats[k]["n_c"], cats.index(k)))[:pick]


def exact_block(cols: list[str]) -> Column:
    """Joined text of the blocking categories."""
    if not cols:
        return F.lit("__all__")
    return F.concat_ws("\x1f", *[F.coalesce(F.nullif(F.trim(F.col(k).cast("string")), F.lit("")), F.lit("__miss__"))
                                 for k in cols])


def exact_sum(c: Column) -> Column:
    """Sum in fixed point: the result does not depend on the order of addition."""
    return F.sum(c.cast("decimal(28,9)")).cast("double")


def block_vote(a: DataFrame, c: DataFrame, k: int = 7, power: float = 1.0, metric: str = "l1") -> DataFrame:
    """Votes (1 / (d + 1e-8))^power / rank inside exact blocks; released rows whose block is
    empty in A search all of A; rows of A whose block occurs in C gain mean + std of the votes."""
    keys = a.select("part").distinct()
    lost = c.join(keys, "part", "left_anti")
    found = knn(a, c, k, metric)
    if not lost.isEmpty():
        found = found.unionByName(knn(a.drop("part"), lost.drop("part"), k, metric))
    one = F.pow(1.0 / (F.col("dist") + 1e-8), F.lit(power)) / F.col("rank") * F.col("mult")
    votes = found.groupBy("id").agg(exact_sum(one).alias("vote"))
    seen = c.select("part").distinct().withColumn("__seen", F.lit(1))
    scored = materialize(a.select("id", "part").join(votes, "id", "left").join(seen, "part", "left").select(
        "id", F.coalesce("vote", F.lit(0.0)).alias("vote"), F.col("__seen").isNotNull().alias("seen")))
    got = fit.row(scored, m=F.avg("vote"), s=F.stddev_pop("vote"))
    bonus = F.when(F.col("seen"), (got["m"] or 0.0) + (got["s"] or 0.0)).otherwise(0.0)
    return scored.select("id", (F.col("vote") + bonus).alias("score"))


def hashed_order(names: list[str], salt: str) -> list[str]:
    """Names in a reproducible random order."""
    import hashlib
    return sorted(names, key=lambda n: (hashlib.md5(f"{SEED}|{salt}|{n}".encode()).hexdigest(), n))


def subspaces(n_num: int, n_cat: int, rounds: int, share: float, at_least: int = 3, at_most: int | None = None,
              salt: str = "round") -> list[View]:
    """One random feature subset per round; a category stays or goes with all its levels."""
    names = [f"n{i}" for i in range(n_num)] + [f"c{i}" for i in range(n_cat)]
    m = min(len(names), max(at_least, math.ceil(share * len(names))))
    m = min(m, at_most) if at_most else m
    views = []
    for r in range(rounds):
        got = hashed_order(names, f"{salt}/{r}")[:m]
        views.append(View(f"r{r:03d}", tuple(sorted(int(x[1:]) for x in got if x[0] == "n")),
                          tuple(sorted(int(x[1:]) for x in got if x[0] == "c"))))
    return views


def stability_vote(a: DataFrame, c: DataFrame, views: list[View], k: int = 5, metrics: tuple[str, ...] = ("l1",),
                   eps: float = 1e-8, heat_rounds: int = 0, heat: float = 0.1, c_share: float | None = None,
                   salt: str = "vote") -> DataFrame:
    """Sum of 1 / (d + eps) over rounds, metrics and released rows onto their k neighbours.

    All rounds of a metric are one search keyed by round; rounds that drew the same features
    are searched once and count as often as they were drawn. ``heat_rounds`` damps rows that are
    the nearest neighbour unusually often in the first rounds: vote / (1 + heat * hits).
    ``c_share`` keeps a hashed share of the released rows and scales the votes up.
    """
    scale = 1.0
    if c_share is not None and c_share < 1.0:
        kept = c.filter(uniform(salt + "/keep", "id") < c_share)
        got = c.agg(F.count(F.lit(1)).alias("n"),
                    F.count_if(uniform(salt + "/keep", "id") < c_share).alias("m")).first()
        c, scale = kept, (got["n"] / got["m"] if got["m"] else 1.0)
    drawn: dict[tuple, list[int]] = {}
    for place, v in enumerate(views):
        drawn.setdefault((v.num, v.cat), []).append(place)
    found = None
    for m in metrics:
        one = knn(a, c, k, m, views=[views[places[0]] for places in drawn.values()])
        found = one if found is None else found.unionByName(one)

    def rounds(counted) -> Column:
        """How many of the counted rounds a search stands for."""
        times = [x for places in drawn.values() for x in (F.lit(views[places[0]].name), F.lit(sum(p in counted for p in places)))]
        return F.element_at(F.create_map(*times), F.col("part"))

    vote = (F.lit(scale) / (F.col("dist") + eps) * F.col("mult")).cast("decimal(28,9)") * rounds(range(len(views))).cast("decimal(5,0)")
    votes = found.groupBy("id").agg(
        F.sum(vote).cast("double").alias("vote"),
        F.sum(F.when(F.col("rank") == 1, F.col("mult") * rounds(range(heat_rounds))).otherwise(0)).alias("hits"))
    damped = F.col("vote") / (1.0 + heat * F.col("hits")) if heat_rounds else F.col("vote")
    scored = materialize(a.select("id").join(votes, "id", "left").select(
        "id", F.coalesce(damped, F.lit(0.0)).alias("score")))
    return unit_rescale(scored, "score")
