"""Audit recipes: how well could an outsider mark the released rows of one's own population?

Inputs are the population and the release in one schema (``Pair``) and, where a model is
audited, its output on the population: (id, y, p) and optionally ``leaf``. Every audit
returns (id, mark) with exactly ``n`` ones unless stated otherwise.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veiltab.operators import encode as E
from veiltab.operators import matching as M
from veiltab.operators import risk as R
from veiltab.operators import select as S
from veiltab.operators.metrics import neg_log_lik
from veiltab.session import materialize
from veiltab.sources.files import pick_vectors, release_matrix


@dataclass(frozen=True)
class Pair:
    population: DataFrame
    release: DataFrame
    numeric: list[str]
    categories: list[str]
    a_id: str = "row_id"
    c_id: str = "row_id"

    def encode(self, kind: str = "l1", key=None):
        a, c = self.population, self.release
        if key is not None:
            a, c = a.withColumn("part", key), c.withColumn("part", key)
        return E.encode_pair(a, c, self.numeric, self.categories, self.a_id, self.c_id, kind,
                             ["part"] if key is not None else None)

    def ids(self) -> DataFrame:
        return self.population.select(F.col(self.a_id).alias("id"))


def _views(pair: Pair, rounds: int, share: float, at_least: int = 3, at_most: int | None = None):
    return M.subspaces(len(pair.numeric), len(pair.categories), rounds, share, at_least, at_most)


def _as(df: DataFrame, score: str) -> DataFrame:
    return df.select("id", F.col("score").alias(score))


def _ordered_fill(ids: DataFrame, sources: list[DataFrame], n: int) -> DataFrame:
    both = ids
    for i, s in enumerate(sources):
        both = both.join(s.select("id", F.col("mark").alias(f"m{i}")), "id", "left")
    both = materialize(both.select("id", *[F.coalesce(f"m{i}", F.lit(0)).alias(f"m{i}") for i in range(len(sources))]))
    return S.priority_fill(both, [f"m{i}" for i in range(len(sources))], n, row_id="id").select("id", "mark")


def _low_loss(scores: DataFrame, n: int) -> DataFrame:
    return S.top_k_mark(scores, neg_log_lik(), n, largest=False, row_id="id").select("id", "mark")


def _loss_and_leaf(scores: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """0.4 loss + 0.6 leaf rarity."""
    return R.four_part_score(scores, base, "id", {"s_loss": 0.4, "s_leaf": 0.6}).select("id", "s_model")


def nearest(pair: Pair) -> DataFrame:
    """Every population row that is some released row's nearest neighbour (count not forced)."""
    return M.nearest_neighbour_mark(*pair.encode())


def vote3(pair: Pair, scores: DataFrame) -> DataFrame:
    """Two of: nearest, confident, correct (count not forced)."""
    both = nearest(pair).withColumnRenamed("mark", "near").join(
        scores.select("id", R.score_confident().alias("sure"), R.score_correct().alias("right")), "id")
    return S.majority_vote(both, ["near", "sure", "right"]).select("id", "mark")


def top_conf_all(scores: DataFrame, n: int | DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Marks of one release, or of all releases of a table at once (``keys=["release_id"]``)."""
    return R.score_top_conf(scores, n, row_id="id", keys=keys).select(*(keys or []), "id", "mark")


def v1(pair: Pair, scores: DataFrame, n: int) -> DataFrame:
    """Ranked hits (k = 7), then lowest losses, then random."""
    return _ordered_fill(pair.ids(), [M.ranked_assign(*pair.encode(), n, 7), _low_loss(scores, n)], n)


def v2(pair: Pair, scores: DataFrame, n: int) -> DataFrame:
    """A few exact-key rows, then block neighbours, then class-quota losses, then random."""
    a, c = pair.population.withColumnRenamed(pair.a_id, "id"), pair.release.withColumnRenamed(pair.c_id, "id")
    _, exact = S.exact_key_sample(a, c, pair.categories, row_id="id")
    key, _, _ = M.block_key(a, c, pair.categories, pair.numeric)
    block = M.block_knn_assign(*pair.encode(key=key), n, 7) if key is not None else \
        M.ranked_assign(*pair.encode(), n, 7)
    quota = S.class_quota_top_k(scores.withColumn("loss", neg_log_lik()), "loss", n, row_id="id")
    return _ordered_fill(pair.ids(), [exact, block, quota], n)


def v3(pair: Pair, scores: DataFrame, n: int, rounds: int = 40, leaves: DataFrame | None = None) -> DataFrame:
    """IDF-weighted votes (L1 and cosine) .6 + loss and leaf rarity .4; ``leaves`` of the release rows give the leaf shares."""
    a, c = pair.encode("zidf")
    votes = M.stability_vote(a, c, _views(pair, rounds, 0.65, 8), 5, ("l1", "cosine"), eps=1e-6)
    return R.hybrid_risk(pair.ids(), n, _as(votes, "s_distance"), _loss_and_leaf(scores, leaves), 0.6, row_id="id")


def v4(pair: Pair, scores: DataFrame, n: int, leaves: DataFrame | None = None) -> DataFrame:
    """Votes inside exact blocks, then loss and leaf rarity, then random."""
    cols = M.stable_categories(pair.population, pair.release, pair.categories)
    votes = M.block_vote(*pair.encode("idf_clip", M.exact_block(cols)), 7)
    first = S.top_k_mark(votes, F.col("score"), n, row_id="id")
    second = S.top_k_mark(_loss_and_leaf(scores, leaves), F.col("s_model"), n, row_id="id")
    return _ordered_fill(pair.ids(), [first, second], n)


def v5(pair: Pair, scores: DataFrame, n: int, rounds: int = 30, leaves: DataFrame | None = None) -> DataFrame:
    """Votes on L1 and cosine damped by hit counts, four-part model score, adaptive weights."""
    votes = M.stability_vote(*pair.encode("robust"), _views(pair, rounds, 0.7), 5, ("l1", "cosine"), heat_rounds=5)
    model = R.four_part_score(scores, leaves, row_id="id").select("id", "s_model")
    return R.hybrid_risk(pair.ids(), n, _as(votes, "s_distance"), model, 0.6, adaptive=True, row_id="id")


def v6(pair: Pair, scores: DataFrame, n: int, rounds: int = 8) -> DataFrame:
    """L1 votes on at most 15 features .6 + (loss .6, confidence .4) .4."""
    votes = M.stability_vote(*pair.encode(), _views(pair, rounds, 0.6, 3, 15), 3)
    model = R.four_part_score(scores, row_id="id", weights={"s_loss": 0.6, "s_conf": 0.4}).select("id", "s_model")
    return R.hybrid_risk(pair.ids(), n, _as(votes, "s_distance"), model, 0.6, row_id="id")


def v7(pair: Pair, scores: DataFrame, n: int, rounds: int = 12, leaves: DataFrame | None = None) -> DataFrame:
    """Robust encoding on unit rows, cosine votes of the whole release, adaptive weights."""
    a, c = (E.unit_rows(x) for x in pair.encode("robust"))
    votes = M.stability_vote(a, c, _views(pair, rounds, 0.6), 5, ("l2",))
    model = R.four_part_score(scores, leaves, row_id="id").select("id", "s_model")
    return R.hybrid_risk(pair.ids(), n, _as(votes, "s_distance"), model, 0.6, adaptive=True, row_id="id")


def merge(vectors: dict[str, dict[str, DataFrame]], ids: DataFrame, share: float = 0.1, own: str | None = None,
          zero: list[str] | None = None) -> DataFrame:
    """:func:`merge_releases` of separate vectors; the kinds of a release are tried in their order."""
    long = None
    for release_id, parts in vectors.items():
        for place, v in enumerate(parts.values()):
            one = v.select(F.lit(release_id).alias("release_id"), F.lit(str(place)).alias("kind"), "id", "member")
            long = one if long is None else long.unionByName(one)
    kinds = [str(k) for k in range(max(map(len, vectors.values())))]
    return merge_releases(long, kinds, ids, list(vectors), share, own, zero)


def merge_releases(vectors: DataFrame, kinds: list[str], ids: DataFrame, releases: list[str], share: float = 0.1, own: str | None = None,
                   zero: list[str] | None = None) -> DataFrame:
    """Per release the first kind that has the row, forced to ``share`` ones, all releases in one plan; then the matrix.

    ``vectors`` is one table ``release_id, kind, id, member``.
    """
    n = round(ids.count() * share)
    every = materialize(pick_vectors(vectors, kinds, ids, releases, "id"))
    forced = S.force_count(every, "member", n, F.concat(F.lit("force/"), "release_id"), "id", ["release_id"])
    return release_matrix(forced, ids, releases, own, zero, "id")


def recall(marks: DataFrame, truth: DataFrame, id_col: str = "id") -> DataFrame:
    """Marks, members, hits, recall and precision against known membership."""
    joined = marks.join(truth.select(F.col(id_col).alias("id"), F.lit(1).alias("member")).distinct(), "id", "left")
    return joined.agg(
        F.sum("mark").cast("long").alias("n_marks"), F.count("member").alias("n_members"),
        F.count_if((F.col("mark") == 1) & F.col("member").isNotNull()).alias("n_hits")).withColumns({
            "recall": F.try_divide("n_hits", "n_members"), "precision": F.try_divide("n_hits", "n_marks")})
