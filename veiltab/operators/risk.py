"""Membership scores from a model's output and their fusion."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veiltab.functions.hashing import uniform
from veiltab.operators import fit
from veiltab.operators.matching import exact_sum
from veiltab.operators.metrics import neg_log_lik
from veiltab.operators.ranks import first_n
from veiltab.operators.scale import unit_rescale
from veiltab.operators.select import top_k_mark
from veiltab.session import materialize

ROW = "row_id"
UNSEEN = 1e-6
LEAF_ROWS = 100_000  # (tree, leaf) shares that are looked up inside a row instead of joined


def score_correct(y: str = "y", p: str = "p") -> Column:
    return ((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("int")


def score_confident(y: str = "y", p: str = "p", within: float = 0.1) -> Column:
    return (F.abs(F.col(p) - F.col(y)) <= within).cast("int")


def score_top_conf(df: DataFrame, k: int | DataFrame, y: str = "y", p: str = "p", row_id: str = ROW, keys: list[str] | None = None) -> DataFrame:
    """1 on the k smallest |p - y|, per key if ``keys`` are given."""
    return top_k_mark(df, F.abs(F.col(p) - F.col(y)), k, False, row_id, keys=keys)


def score_loss(df: DataFrame, y: str = "y", p: str = "p", out: str = "s_loss") -> DataFrame:
    """1 - rescaled negative log-likelihood: a small loss speaks for membership."""
    scored = unit_rescale(df.withColumn(out, neg_log_lik(y, p)), out)
    return scored.withColumn(out, 1.0 - F.col(out))


def score_conf_true(df: DataFrame, y: str = "y", p: str = "p", out: str = "s_conf") -> DataFrame:
    """Rescaled probability of the true class."""
    return unit_rescale(df.withColumn(out, F.when(F.col(y) == 1, F.col(p)).otherwise(1 - F.col(p))), out)


def score_leaf_rarity(a: DataFrame, base: DataFrame | None = None, leaf: str = "leaf", row_id: str = ROW,
                      out: str = "s_leaf") -> DataFrame:
    """Sum over trees of ln(1 / (leaf share + 1e-6)), rescaled to [0, 1]; shares counted on ``base`` (the release)
    or on the rows themselves; a leaf never seen counts as share 0.

    The raw sums are written once; their range is one small aggregate over that copy.
    """
    raw = materialize(with_leaf_rarity(a, base, leaf, row_id, out), "rarity")
    (lo, hi), = fit.ranges(raw, [out]).values()
    return raw if lo is None else raw.withColumn(out, F.coalesce((F.col(out) - lo) / (hi - lo + 1e-12), F.lit(0.0)))


def with_leaf_rarity(a: DataFrame, base: DataFrame | None, leaf: str, row_id: str, out: str) -> DataFrame:
    """``a`` with the rarity before rescaling; null where a row has no leaves.

    Shares are a (tree, leaf) table of at most trees x leaves rows. Up to ``LEAF_ROWS`` of them become one array of maps,
    one map per tree, looked up inside each row: rows are neither exploded nor shuffled, and no leaf can be hot. A larger
    table is joined to the exploded leaves. The sum is in fixed point.
    """
    def leaves(df, ids):
        return df.select(*ids, F.posexplode(leaf).alias("tree", "leaf"))

    def part(share):
        return F.log(1.0 / (F.coalesce(share, F.lit(0.0)) + UNSEEN))

    ref = a if base is None else base
    n = ref.count()
    share = materialize(leaves(ref, []).groupBy("tree", "leaf").agg((F.count(F.lit(1)) / n).alias("share")), "leaves")
    if share.limit(LEAF_ROWS + 1).count() > LEAF_ROWS:
        rarity = leaves(a, [row_id]).join(share, ["tree", "leaf"], "left").groupBy(row_id).agg(exact_sum(part(F.col("share"))).alias(out))
        return a.drop(out).join(rarity, row_id, "left")
    per_tree = share.filter(F.col("leaf").isNotNull()).groupBy("tree").agg(
        F.map_from_entries(F.collect_list(F.struct("leaf", "share"))).alias("m"))
    maps = per_tree.agg(F.map_from_entries(F.collect_list(F.struct("tree", "m"))).alias("maps")).scalar()
    fixed = "decimal(28,9)"
    one = F.transform(leaf, lambda x, i: part(F.try_element_at(F.try_element_at("__maps", i), x)).cast(fixed))
    total = F.aggregate(one, F.lit(0).cast(fixed), lambda s, x: (s + x).cast(fixed)).cast("double")
    return a.withColumn("__maps", maps).withColumn(out, F.when(F.size(leaf) > 0, total)).drop("__maps")


def fuse_weighted(parts: dict[str, float]) -> Column:
    """Weighted sum of score columns; an absent score counts as 0."""
    out = F.lit(0.0)
    for c, w in parts.items():
        out = out + F.coalesce(F.col(c), F.lit(0.0)) * w
    return out


# Weights of loss, leaf rarity, true-class confidence and correctness.
FOUR_PART = {"s_loss": 0.35, "s_leaf": 0.30, "s_conf": 0.25, "s_correct": 0.10}


def four_part_score(df: DataFrame, base: DataFrame | None = None, row_id: str = ROW,
                    weights: dict[str, float] | None = None) -> DataFrame:
    """Loss, leaf rarity, confidence and correctness fused into ``s_model``.

    The raw scores are written once; their ranges are one small aggregate over that copy.
    """
    raw = df.select(row_id, (-neg_log_lik()).alias("s_loss"),
                    F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p")).alias("s_conf"),
                    score_correct().cast("double").alias("s_correct"), *(["leaf"] if "leaf" in df.columns else []))
    if "leaf" in df.columns:
        raw = with_leaf_rarity(raw, base, "leaf", row_id, "s_leaf").drop("leaf")
    else:
        raw = raw.withColumn("s_leaf", F.lit(0.0))
    raw = materialize(raw)
    ends = fit.ranges(raw, ["s_loss", "s_conf", "s_leaf"])
    scaled = raw.withColumns({c: (F.col(c) - lo) / (hi - lo + 1e-12) for c, (lo, hi) in ends.items()
                              if lo is not None})
    return scaled.withColumn("s_model", fuse_weighted(weights or FOUR_PART))


def adaptive_weight(df: DataFrame, distance: str, model: str, base: float = 0.6) -> float:
    """0.7 base + 0.3 dynamic weight of the distance score, where the dynamic part compares the
    distance score's std / mean with the model score's interquartile range."""
    d = fit.row(df, m=F.avg(distance), s=F.stddev_pop(distance))
    q = fit.quantiles(df, [model], {"q1": 0.25, "q3": 0.75}).get(model)
    spread = (d["s"] or 0.0) / ((d["m"] or 0.0) + 1e-8)
    iqr = q["q3"] - q["q1"] if q else 0.0
    return min(max(0.7 * base + 0.3 * spread / (spread + iqr + 1e-8), 0.0), 1.0)


def fuse_adaptive(df: DataFrame, distance: str, model: str, base: float = 0.6, out: str = "score") -> DataFrame:
    w = adaptive_weight(df, distance, model, base)
    return df.withColumn(out, w * F.col(distance) + (1.0 - w) * F.col(model))


def hybrid_risk(ids: DataFrame, n: int, distance: DataFrame | None = None, model: DataFrame | None = None,
                w_distance: float = 0.6, adaptive: bool = False, salt: str = "fallback",
                row_id: str = ROW) -> DataFrame:
    """Top-n marks from whichever scores exist: both are fused, one stands alone, none gives
    all zeros; constant scores (no information) fall back to n random marks.

    ``distance`` has (row_id, s_distance) and ``model`` (row_id, s_model).
    """
    if distance is None and model is None:
        return ids.select(row_id).withColumn("mark", F.lit(0))
    both = ids.select(row_id)
    for part in (distance, model):
        if part is not None:
            both = both.join(part, row_id, "left")
    cols = [c for c, part in (("s_distance", distance), ("s_model", model)) if part is not None]
    both = materialize(both.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in cols}))
    if len(cols) == 1:
        both = both.withColumn("score", F.col(cols[0]))
    elif adaptive:
        both = fuse_adaptive(both, "s_distance", "s_model", w_distance)
    else:
        both = both.withColumn("score", fuse_weighted({"s_distance": w_distance, "s_model": 1 - w_distance}))
    score = F.round("score", 9)
    ends = fit.row(both, lo=F.min(score), hi=F.max(score))
    order = uniform(salt, row_id) if ends["lo"] == ends["hi"] else -score
    return both.select(row_id, first_n(both, order, n, row_id).cast("int").alias("mark"))
