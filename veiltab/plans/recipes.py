"""Release recipes: ordered lists of operators with their parameters.

A step is ``(operator, parameters)``; conditions are SQL text over the person columns. Fitted
parameters are small literals, so a run of cell-level steps stays one chain of projections;
steps that exchange values between rows are written to the checkpoint folder.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veiltab.functions import clean
from veiltab.operators import cohort as C
from veiltab.operators import perturb as N
from veiltab.operators import scale as S
from veiltab.operators import synth as Y
from veiltab.operators.fit import medians
from veiltab.operators.model import fit_logit
from veiltab.operators.profile import group_size_relax
from veiltab.operators.select import shuffle_rows
from veiltab.session import materialize

Step = tuple[str, dict]
ROW = "row_id"
CHAIN = 8  # cell-level steps between two written copies

COUNTS = ["encounter_count", "num_procedures", "num_medications", "num_immunizations",
          "num_allergies", "num_devices"]
BODY = ["mean_systolic_bp", "mean_diastolic_bp", "mean_weight", "mean_bmi"]
FLAGS = ["asthma_flag", "stroke_flag", "obesity_flag", "depression_flag"]
CATEGORIES = ["GENDER", "RACE", "ETHNICITY"]
NUMBERS = ["AGE", *COUNTS, *BODY]
# Allowed ranges of the counts and measures.
SMALL_LIMITS = {"encounter_count": (7, 85), "num_procedures": (1, 2086), "num_medications": (0, 2351),
                "num_immunizations": (0, 37), "num_allergies": (0, 13), "num_devices": (0, 133)}
COUNT_LIMITS = {"encounter_count": (4, 1211), "num_procedures": (0, 500), "num_medications": (0, 200),
                "num_immunizations": (0, 50), "num_allergies": (0, 20), "num_devices": (0, 10)}
WIDE_LIMITS = {"AGE": (0, 120), "encounter_count": (0, 2000), "num_procedures": (0, 2000),
               "num_medications": (0, 1000), "num_immunizations": (0, 300), "num_allergies": (0, 200),
               "num_devices": (0, 100), "mean_systolic_bp": (60, 220), "mean_diastolic_bp": (35, 130),
               "mean_weight": (25, 300), "mean_bmi": (12, 65)}
BODY_LIMITS = {"mean_systolic_bp": (60, 200), "mean_diastolic_bp": (40, 120), "mean_weight": (30, 200),
               "mean_bmi": (15, 50)}
DECADES = [0, 11, 21, 31, 41, 51, 61, 71, 81, 91, 101, 200]
DECADE_LABELS = ["0-10", "11-20", "21-30", "31-40", "41-50", "51-60", "61-70", "71-80", "81-90", "91-100", "100+"]
SIX_BANDS = [0, 18, 35, 50, 65, 80, 200]
SIX_LABELS = ["0-18", "19-35", "36-50", "51-65", "66-80", "81+"]
TENS = [0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100, 200]
TEN_LABELS = ["0-9", "10-19", "20-29", "30-39", "40-49", "50-59", "60-69", "70-79", "80-89", "90-99", "100+"]
FIVE_BANDS = [0, 18, 45, 65, 75, 200]
FIVE_LABELS = ["0-17", "18-44", "45-64", "65-74", "75+"]


def decade():
    return clean.bin_label("AGE", DECADES, DECADE_LABELS)


def five_bands():
    return clean.bin_label("AGE", FIVE_BANDS, FIVE_LABELS)


# ---------------------------------------------------------------- operators by name

def _group_std(df, limits, factor, wide=None, salt="", row_id=ROW):
    return N.noise_by_group_std(df, limits, decade(), factor, salt, row_id, wide)


def _where(fn: Callable) -> Callable:
    def run(df, where=None, cohort=None, **kw):
        if where is not None:
            kw["where"] = F.expr(where)
        if cohort is not None:
            kw["cohort"] = F.expr(cohort)
        return fn(df, **kw)
    return run


def _raise(df, c, target, tiers, salt="", row_id=ROW, cap=None):
    return N.raise_prevalence_priority(df, c, target, [F.expr(t) for t in tiers], salt, row_id, cap)


def _swap(df, c, a, b, share, salt="", row_id=ROW):
    return materialize(C.swap_between_cohorts(df, c, F.expr(a), F.expr(b), share, salt + "swap", row_id))


def _format(df, integers, decimals, salt="", row_id=ROW):
    # medians, modes and the release read the table: the run of steps before is evaluated once
    return S.format_release(materialize(df), integers, decimals, CATEGORIES, FLAGS, {"AGE": (2, 110)})


def _clean(df, salt="", row_id=ROW):
    return df.withColumns({**{c: clean.ensure_category(c) for c in CATEGORIES},
                           **{c: clean.ensure_flag(c) for c in FLAGS}})


def _top_code(df, c, limit, salt="", row_id=ROW):
    return df.withColumn(c, clean.top_code(F.col(c).cast("double"), float(limit), F.lit(medians(df, [c])[c])))


def _clip(df, salt="", row_id=ROW):
    return df.withColumns({c: clean.range_clip(F.col(c).cast("double"), float(lo), float(hi))
                           for c, (lo, hi) in WIDE_LIMITS.items()})


def _impute(df, cols, tiers, min_size, ranged, salt="", row_id=ROW):
    limits = {c: WIDE_LIMITS[c] for c in cols} if ranged else None
    out = df.withColumn("AGE_BIN", five_bands())
    return materialize(S.hierarchical_impute(out, cols, tiers, min_size, limits).drop("AGE_BIN"))


def _group_impute(df, limits, integer, salt="", row_id=ROW):
    out = df.withColumn("AGE_BIN", decade())
    return materialize(S.group_median_impute(out, limits, ["AGE_BIN", "GENDER"], integer).drop("AGE_BIN"))


def _permute_block(df, cols, tiers, min_size, prob=1.0, salt="", row_id=ROW):
    out = df.withColumn("AGE_BIN", five_bands())
    return materialize(C.permute_within_group_block(out, tiers, cols, min_size, prob, salt + "block", row_id).drop("AGE_BIN"))


def _permute_columns(df, cols, where=None, salt="", row_id=ROW):
    """Per-column permutation inside five-year bands, optionally of a subset only."""
    band = F.floor(F.col("AGE") / 5).cast("int")
    part = df.filter(F.expr(where)) if where else df.filter(F.col("AGE").isNotNull() & (F.col("AGE") < 120))
    mixed = C.permute_within_group_columns(part.withColumn("__band", band), ["__band"], cols, salt + "perm", row_id).drop("__band")
    rest = df.filter(~F.coalesce(F.expr(where), F.lit(False))) if where else None
    return materialize(mixed if rest is None else mixed.unionByName(rest))


def _swap_records(df, cols, share, salt="", row_id=ROW):
    return materialize(C.swap_records(df, cols, share, None, salt + "pairs", row_id))


def _swap_similar(df, cols, share, within, salt="", row_id=ROW):
    """Swaps in sequence with partners of the same sex and about the same age, any row again and again."""
    df = materialize(df)
    n = int(df.count() * share)
    if n <= 1:
        return df
    swaps = C.similar_swaps(df, n, "GENDER", "AGE", within, salt + "swap", row_id)
    return materialize(C.swap_sequence(df, swaps, cols, row_id))


def _shrink(df, cols, rate, salt="", row_id=ROW):
    """Toward the mean of the age band, clipped at 0 and rounded."""
    band = clean.bin_label(F.least(F.greatest(F.col("AGE"), F.lit(2)), F.lit(110)), SIX_BANDS, SIX_LABELS, right=True)
    for c in cols:
        df = N.shrink_to_group_mean(df, c, band, rate)
        df = df.withColumn(c, F.greatest(F.bround(F.col(c)), F.lit(0.0)).cast("int"))
    return df


def _noise_age_bins(df, c, delta, salt="", row_id=ROW):
    """Ages are clipped first; bins of at most ten rows stay as they are."""
    held = df.withColumn(c, clean.range_clip(F.col(c).cast("double"), 2.0, 110.0).cast("int"))
    return N.noise_age_by_bin(held, c, clean.bin_label(c, TENS, TEN_LABELS), delta, 2, 110, 10, salt, row_id)


def _named(df, c, listed, label, salt="", row_id=ROW):
    return df.withColumn(c, clean.group_named(c, listed, label))


def _by_group(fn: Callable, key: list[str]) -> Callable:
    """Coarsen the categories, choose the group key and run ``fn(df, keys)``; the release carries the coarse levels."""
    def run(df, k_min, min_count=50, salt="", row_id=ROW, **kw):
        sex = F.upper(F.substring(F.col("GENDER").cast("string"), 1, 1))
        g = df.withColumns({"AGE_BIN": five_bands(), "GENDER": F.when(sex.isin("M", "F"), sex).otherwise("U")})
        for c in ("RACE", "ETHNICITY"):
            blank = F.coalesce(F.col(c), F.lit("")) == ""
            g = S.coarsen_rare_levels(g.withColumn(c, F.when(blank, "(NA)").otherwise(F.col(c))), c, min_count)
        g = materialize(g)
        tiers = [key, [k for k in key if k != "ETHNICITY"], [k for k in key if k != "RACE"], ["AGE_BIN", "asthma_flag"]]
        keys = group_size_relax(g, tiers, k_min)
        return materialize(fn(g, keys, salt=salt, row_id=row_id, **kw).select(*df.columns))
    return run


def _mix_block(df, keys, privacy=True, salt="", row_id=ROW):
    local = materialize(C.permute_local(df, keys, NUMBERS, 0.12, salt + "local", row_id))
    if not privacy:
        return Y.jitter_match(local, keys, NUMBERS, ["AGE", *COUNTS], 0.02, salt + "jit", row_id)
    mixed = materialize(C.convex_mix(local, keys, NUMBERS, 3, 0.08, salt + "mix", row_id))
    return Y.quantile_map(mixed, df, keys, NUMBERS, ["AGE", *COUNTS], row_id)


def _copula(df, keys, align=None, salt="", row_id=ROW):
    """Copula draw; with ``align`` (decimals) the release's logits of asthma are then moved onto the original's, by a
    model fitted on the original, inside (label, age band). Bands are the original's; a null band is a group too."""
    out = Y.gaussian_copula_synth(df, keys, NUMBERS, ["AGE", *COUNTS], salt + "copula", row_id)
    if align is None:
        return out
    model = fit_logit(df, "asthma_flag", [*NUMBERS, *CATEGORIES, *FLAGS[1:], "AGE_BIN"])
    weight = {c: model.numbers[c] for c in BODY if c in model.numbers}
    return Y.align_logits(df, materialize(_round(out, align)), model.logit(), weight, ["asthma_flag", "AGE_BIN"], align, row_id)


def _round(df, digits, salt="", row_id=ROW):
    ints = {c: F.greatest(F.bround(F.coalesce(F.col(c).cast("double"), F.lit(0.0))), F.lit(0.0)).cast("int") for c in ["AGE", *COUNTS]}
    return df.withColumns({**ints, **{c: F.round(F.col(c).cast("double"), digits) for c in BODY}})


OPS: dict[str, Callable] = {
    "replace_uniform": N.replace_category_uniform, "replace_weighted": N.replace_category_weighted,
    "replace_fixed": N.replace_value_fixed, "randomise_level": N.randomise_level, "group_named": _named,
    "merge_levels": N.merge_levels_probabilistic, "remap": N.remap_levels_in_order, "match_share": N.match_share,
    "noise_int": N.noise_int_uniform, "noise_int_positive": N.noise_int_positive_only, "noise_age": N.noise_age,
    "noise_age_segments": N.noise_age_by_segment, "noise_age_bins": _noise_age_bins, "noise_float": N.noise_float_uniform,
    "noise_proportional": N.noise_proportional, "noise_group_std": _group_std, "noise_sparse": N.noise_sparse_choice,
    "noise_step": N.noise_relative_step, "noise_range": N.noise_normal_range_aware, "flip": _where(N.flip_flag),
    "flip_cohort": _where(N.flip_cohort_fraction), "flip_cohort_random": _where(N.flip_cohort_bernoulli),
    "raise_share": _raise, "adjust_by_flag": N.adjust_by_flag, "nudge": N.preserve_correlation_nudge,
    "swap_cohorts": _swap, "format": _format, "clean": _clean, "clip": _clip, "top_code": _top_code,
    "impute": _impute, "group_impute": _group_impute, "permute_block": _permute_block,
    "permute_columns": _permute_columns, "swap_records": _swap_records, "swap_similar": _swap_similar, "shrink": _shrink,
    "shuffle_rows": lambda df, salt="", row_id=ROW: shuffle_rows(df, salt + "shuffle", row_id),
    "mix_block": _by_group(_mix_block, ["AGE_BIN", "asthma_flag"]),
    "copula": _by_group(_copula, ["AGE_BIN", "GENDER", "RACE", "ETHNICITY", "asthma_flag"]), "round": _round,
}


def run_recipe(df: DataFrame, name: str, row_id: str = ROW) -> DataFrame:
    """Apply a recipe's steps in order; every step has its own draws.

    A long run of projections is written out every ``CHAIN`` steps: later fits then read the
    written copy instead of re-evaluating the run, and generated code stays compilable.
    """
    for i, (op, args) in enumerate(RECIPES[name]):
        df = OPS[op](df, salt=f"{name}{i}/", row_id=row_id, **args)
        if i % CHAIN == CHAIN - 1 and i + 1 < len(RECIPES[name]):
            df = materialize(df)
    return df


# ---------------------------------------------------------------- parameters

def _each(op: str, cols: list[str], values: list, key: str, **same) -> list[Step]:
    return [(op, {"c": c, key: v, **same}) for c, v in zip(cols, values)]


def _pm(cols: list[str], deltas: list[int], **same) -> list[Step]:
    return [("noise_int", {"c": c, "lo": -d, "hi": d, **same}) for c, d in zip(cols, deltas)]


def _flips(shares: list[float | None], where: str | None = None) -> list[Step]:
    return [("flip", {"c": c, "p": p, **({"where": where} if where else {})}) for c, p in zip(FLAGS, shares) if p]


def _range(c: str, sd: float, pull: tuple, digits: int, normal: tuple | None = None) -> Step:
    return ("noise_range", {"c": c, "normal": normal or BODY_LIMITS[c], "limits": BODY_LIMITS[c], "sd": sd,
                            "pull": pull, "digits": digits})


def _cohorts(rows: list[tuple[str, int, float, str]], op: str = "flip_cohort") -> list[Step]:
    return [(op, {"c": c, "value": v, "share": s, "cohort": w}) for c, v, s, w in rows]


def _bands(pairs: list[tuple]) -> list[Step]:
    return [("swap_cohorts", {"c": "AGE", "a": f"AGE BETWEEN {a} AND {b}", "b": f"AGE BETWEEN {c} AND {d}", "share": s})
            for a, b, c, d, s in pairs]


def _counts(share: float, choices: list, weights: list | None = None, limits: dict = COUNT_LIMITS) -> list[Step]:
    return [("noise_sparse", {"c": c, "share": share, "choices": choices, "weights": weights, "lo": lo, "hi": hi})
            for c, (lo, hi) in limits.items()]


FORMAT: Step = ("format", {"integers": ["AGE", *COUNTS, "mean_systolic_bp", "mean_diastolic_bp", "mean_weight"],
                           "decimals": {"mean_bmi": 1}})
RARE: Step = ("group_named", {"c": "RACE", "listed": ["hawaiian", "native"], "label": "other"})
MALE: Step = ("match_share", {"c": "GENDER", "level": "M", "other": "F", "target": 0.5116})
YOUNG_FIRST = ["AGE BETWEEN 18 AND 40 AND GENDER = 'F'", "AGE BETWEEN 18 AND 40 OR GENDER = 'F'"]
OLDER = "AGE > 40"


def _ethnicity(to_hisp: float, from_hisp: float) -> Step:
    return ("replace_fixed", {"c": "ETHNICITY", "moves": [("nonhispanic", "hispanic", to_hisp), ("hispanic", "nonhispanic", from_hisp)]})


def _body_sparse(shares: tuple, steps: tuple, weights=None, zero: bool = False) -> list[Step]:
    out = []
    for c, s, d in zip(["mean_systolic_bp", "mean_diastolic_bp", "mean_weight", "mean_bmi"], shares, steps):
        if s is None:
            continue
        lo, hi = BODY_LIMITS[c]
        out.append(("noise_sparse", {"c": c, "share": s, "choices": [-d, 0.0, d] if zero else [-d, d], "weights": weights,
                                     "lo": lo, "hi": hi, "integer": False}))
    return out


W3 = [0.45, 0.1, 0.45]
BUNDLE_TIERS = [["GENDER", "RACE", "ETHNICITY", "asthma_flag"], ["GENDER", "ETHNICITY", "asthma_flag"],
                ["GENDER", "asthma_flag"], ["asthma_flag"]]
AGE_TIERS = [["AGE_BIN", *BUNDLE_TIERS[0]], ["AGE_BIN", "GENDER", "asthma_flag"], ["AGE_BIN", "asthma_flag"]]

# The steps of each recipe and their parameters, in order.
RECIPES: dict[str, list[Step]] = {
    "ano": [
        *_each("replace_uniform", CATEGORIES, [0.04, 0.04, 0.03], "p"), ("noise_age", {"c": "AGE", "delta": 2}),
        *_pm(COUNTS, [10, 10, 5, 1, 1, 2]), *_flips([0.03, 0.03, 0.03, 0.05]),
        *[("noise_float", {"c": c, "lo": -d, "hi": d}) for c, d in zip(BODY[:3], [5, 4, 3])],
        ("noise_float", {"c": "mean_bmi", "lo": -6, "hi": 6, "blanks": "replace"})],
    "ano1": [
        *_each("replace_weighted", CATEGORIES, [0.01, 0.015, 0.01], "p"), ("noise_age", {"c": "AGE", "delta": 2}),
        *_pm(COUNTS, [10, 10, 5, 1, 1, 1]), *_flips([0.01, 0.02, 0.02, 0.02], OLDER),
        *_each("noise_proportional", BODY, [0.01] * 4, "sigma")],
    "ano1_1": [
        ("permute_columns", {"cols": [*COUNTS, *BODY], "where": "AGE < 10"}),
        *_each("replace_weighted", CATEGORIES, [0.01, 0.015, 0.01], "p"), ("noise_age", {"c": "AGE", "delta": 2}),
        *_pm(COUNTS, [10, 10, 5, 1, 1, 1]), *_flips([0.01, None, 0.02, 0.02], OLDER),
        ("adjust_by_flag", {"c": "mean_bmi", "flag": "obesity_flag", "up": (1.0, 3.0), "down": (-2.0, -0.5), "lo": 10, "hi": 50}),
        ("adjust_by_flag", {"c": "mean_weight", "flag": "obesity_flag", "up": (2.0, 8.0), "down": (-5.0, -1.0), "lo": 10, "hi": 200}),
        *_each("noise_proportional", BODY[:2], [0.01] * 2, "sigma")],
    "ano12": [
        *_each("replace_weighted", CATEGORIES, [0.01, 0.02, 0.015], "p"),
        ("noise_age_segments", {"c": "AGE", "segments": [(30, 3), (60, 5), (1000, 2)]}),
        *_each("noise_proportional", COUNTS, [0.05] * 3 + [0.02] * 3, "sigma", digits=None),
        *_each("noise_proportional", BODY, [0.005, 0.005, 0.01, 0.015], "sigma", digits=1),
        ("flip", {"c": "asthma_flag", "p": 0.01, "where": "AGE < 20"}), ("flip", {"c": "stroke_flag", "p": 0.01, "where": "AGE > 60"}),
        ("flip", {"c": "obesity_flag", "p": 0.01}), ("flip", {"c": "depression_flag", "p": 0.01})],
    "ano2": [
        *_each("replace_weighted", CATEGORIES, [0.005, 0.015, 0.01], "p"), ("noise_age", {"c": "AGE", "delta": 1}),
        *_pm(COUNTS, [5, 5, 3, 1, 1, 1]), *_flips([None, None, 0.01, 0.01], OLDER),
        *_each("noise_proportional", BODY, [0.005, 0.005, 0.005, 0.01], "sigma")],
    "ano3": [
        *_each("replace_weighted", CATEGORIES, [0.003, 0.005, 0.005], "p"), ("noise_age", {"c": "AGE", "delta": 1}),
        *_pm(COUNTS[:4], [3, 3, 2, 1], blanks="keep", upper=False), ("noise_int_positive", {"c": "num_allergies", "lo": -1, "hi": 1}),
        *_pm(COUNTS[5:], [1], blanks="keep", upper=False), *_flips([0.01] * 4, OLDER),
        *_each("noise_proportional", BODY, [0.005, 0.005, 0.005, 0.01], "sigma")],
    "anony1": [
        *_bands([(21, 30, 31, 40, 0.10), (51, 60, 61, 70, 0.10)]), RARE, _ethnicity(0.05, 0.03),
        ("noise_group_std", {"limits": COUNT_LIMITS, "factor": 0.05}),
        *_cohorts([("stroke_flag", 0, 0.02, "AGE > 70"), ("stroke_flag", 1, 0.01, "AGE < 40"),
                   ("obesity_flag", 1, 0.03, "AGE BETWEEN 40 AND 60"), ("obesity_flag", 0, 0.04, "AGE < 30")]),
        ("flip", {"c": "asthma_flag", "p": 0.02}), ("raise_share", {"c": "depression_flag", "target": 0.02, "tiers": YOUNG_FIRST}),
        _range("mean_systolic_bp", 1.5, (3, 2), 0, (90, 140)), _range("mean_weight", 0.8, (0, 0), 0), _range("mean_bmi", 0.3, (0, 0), 1),
        MALE, FORMAT],
    "anony1_1": [("mix_block", {"k_min": 25, "privacy": True}), ("round", {"digits": 3})],
    "anony1_1_utility": [("mix_block", {"k_min": 25, "privacy": False}), ("round", {"digits": 3})],
    "anony1_2": [("copula", {"k_min": 40}), ("round", {"digits": 3})],
    "anony1_3": [("copula", {"k_min": 40}), ("round", {"digits": 2})],
    "anony1_2_align": [("copula", {"k_min": 40, "align": 3}), ("round", {"digits": 3})],
    "anony1_3_align": [("copula", {"k_min": 40, "align": 2}), ("round", {"digits": 2})],
    "anony2": [
        ("noise_sparse", {"c": "AGE", "share": 0.05, "choices": [-1, 1], "lo": 2, "hi": 110}), RARE, _ethnicity(0.02, 0.01),
        *_counts(0.03, [-2, -1, 1, 2]), ("flip", {"c": "asthma_flag", "p": 0.01}),
        ("raise_share", {"c": "depression_flag", "target": 0.02, "tiers": ["AGE BETWEEN 18 AND 40"]}),
        *_cohorts([("stroke_flag", 1, 0.01, "AGE > 70"), ("obesity_flag", 1, 0.01, "AGE BETWEEN 40 AND 60")], "flip_cohort_random"),
        *_body_sparse((0.05, None, 0.03, 0.03), (1.0, 1.0, 0.5, 0.1)), MALE, FORMAT],
    "anony3": [
        ("noise_sparse", {"c": "AGE", "share": 0.02, "choices": [-1, 0, 1], "weights": W3, "lo": 2, "hi": 110}),
        ("merge_levels", {"c": "RACE", "to": "other", "tiny_ratio": 0.003, "listed": ["hawaiian", "native"], "p": 0.7}),
        _ethnicity(0.005, 0.003), *_counts(0.01, [-1, 0, 1], limits=COUNT_LIMITS | {"encounter_count": (0, 1211)}),
        ("group_impute", {"limits": COUNT_LIMITS | {"encounter_count": (0, 1211)}, "integer": True}),
        ("flip", {"c": "asthma_flag", "p": 0.005}),
        ("raise_share", {"c": "depression_flag", "target": 0.02, "tiers": ["AGE BETWEEN 18 AND 40"], "cap": 0.005}),
        *_cohorts([("stroke_flag", 1, 0.002, "AGE > 75"), ("obesity_flag", 1, 0.002, "AGE BETWEEN 40 AND 60")], "flip_cohort_random"),
        *_body_sparse((0.015, None, 0.01, 0.01), (1.0, 1.0, 0.3, 0.1), W3, True),
        ("group_impute", {"limits": BODY_LIMITS, "integer": False}),
        ("match_share", {"c": "GENDER", "level": "M", "other": "F", "target": 0.5116, "cap": 0.005}), FORMAT],
    "anony4": [
        ("noise_sparse", {"c": "AGE", "share": 0.02, "choices": [-1, 0, 1], "weights": W3, "lo": 2, "hi": 110}),
        *_body_sparse((0.015, 0.015, 0.01, 0.01), (1.0, 1.0, 0.3, 0.1), W3, True), FORMAT],
    "anony5": [
        ("clean", {}), ("top_code", {"c": "AGE", "limit": 90}),
        ("impute", {"cols": [*COUNTS, *BODY], "tiers": BUNDLE_TIERS, "min_size": 9, "ranged": False}),
        ("permute_block", {"cols": NUMBERS, "tiers": BUNDLE_TIERS, "min_size": 9})],
    "anony6": [
        ("clean", {}), ("clip", {}), ("top_code", {"c": "AGE", "limit": 90}),
        ("impute", {"cols": [*COUNTS, *BODY], "tiers": AGE_TIERS, "min_size": 9, "ranged": True}),
        ("permute_block", {"cols": [*COUNTS, *BODY], "tiers": AGE_TIERS, "min_size": 9}), FORMAT],
    "anony7": [
        ("clean", {}), ("impute", {"cols": [*COUNTS, *BODY], "tiers": AGE_TIERS, "min_size": 7, "ranged": False}),
        ("permute_block", {"cols": [*COUNTS, *BODY], "tiers": AGE_TIERS, "min_size": 7, "prob": 0.8}),
        ("noise_sparse", {"c": "num_devices", "share": 0.005, "choices": [-1, 1], "lo": 0, "hi": 100}), FORMAT],
    "anony8": [
        *_bands([(21, 30, 31, 40, 0.08), (51, 60, 61, 70, 0.08)]), RARE, _ethnicity(0.04, 0.02),
        ("noise_group_std", {"limits": COUNT_LIMITS, "factor": 0.03}),
        *_cohorts([("stroke_flag", 0, 0.01, "AGE > 70"), ("stroke_flag", 1, 0.005, "AGE < 40"),
                   ("obesity_flag", 1, 0.02, "AGE BETWEEN 40 AND 60"), ("obesity_flag", 0, 0.03, "AGE < 30")]),
        ("flip", {"c": "asthma_flag", "p": 0.01}),
        *_cohorts([("asthma_flag", 0, 0.005, "AGE < 18"), ("asthma_flag", 1, 0.003, "AGE BETWEEN 18 AND 40")]),
        ("raise_share", {"c": "depression_flag", "target": 0.02, "tiers": YOUNG_FIRST}),
        _range("mean_systolic_bp", 1.0, (2, 1.5), 0, (90, 140)), _range("mean_weight", 0.5, (0, 0), 0), _range("mean_bmi", 0.2, (0, 0), 1),
        MALE, *_counts(0.1, [-1, 0, 1], [0.4, 0.2, 0.4]), FORMAT],
    "anony9": [
        *_bands([(21, 30, 31, 40, 0.12), (31, 40, 41, 50, 0.10), (51, 60, 61, 70, 0.12), (41, 50, 61, 70, 0.08), (18, 25, 66, 75, 0.05)]),
        RARE, ("merge_levels", {"c": "RACE", "to": "other", "tiny_ratio": 0.0, "listed": ["asian"], "p": 0.3}), _ethnicity(0.08, 0.06),
        ("randomise_level", {"c": "ETHNICITY", "level": "unknown", "p": 0.15, "to": ["hispanic", "nonhispanic"]}),
        ("noise_group_std", {"limits": COUNT_LIMITS, "factor": 0.08, "wide": (0.1, 0.2)}),
        *_cohorts([("asthma_flag", 1, 0.15, "AGE < 18"), ("asthma_flag", 1, 0.08, "AGE >= 18 AND AGE < 40"), ("asthma_flag", 0, 0.12, "AGE > 60")]),
        ("flip", {"c": "asthma_flag", "p": 0.05}),
        *_cohorts([("stroke_flag", 0, 0.08, "AGE > 65"), ("stroke_flag", 1, 0.03, "AGE BETWEEN 45 AND 65"),
                   ("obesity_flag", 1, 0.10, "AGE BETWEEN 40 AND 60"), ("obesity_flag", 0, 0.12, "AGE < 30")]),
        ("raise_share", {"c": "depression_flag", "target": 0.045, "tiers": YOUNG_FIRST}),
        _range("mean_systolic_bp", 2.5, (4, 2.5), 0, (90, 140)), _range("mean_diastolic_bp", 2.0, (4, 2.5), 0, (60, 90)),
        _range("mean_weight", 1.5, (0, 0), 0), _range("mean_bmi", 0.6, (0, 0), 1), MALE,
        ("replace_fixed", {"c": "GENDER", "moves": [("M", "F", 0.02), ("F", "M", 0.02)]}),
        *[("noise_step", {"c": c, "share": 0.2, "rate": 0.05, "lo": lo, "hi": hi}) for c, (lo, hi) in COUNT_LIMITS.items()],
        FORMAT, ("swap_records", {"cols": [*CATEGORIES, *NUMBERS, *FLAGS], "share": 0.03})],
    "anony10": [
        FORMAT, RARE, _ethnicity(0.04, 0.03), *_bands([(21, 30, 31, 40, 0.06), (51, 60, 61, 70, 0.06)]),
        *_cohorts([("asthma_flag", 1, 0.05, "AGE < 18"), ("asthma_flag", 0, 0.06, "AGE > 60")]), ("flip", {"c": "asthma_flag", "p": 0.02}),
        *_cohorts([("stroke_flag", 0, 0.04, "AGE > 65"), ("obesity_flag", 1, 0.05, "AGE BETWEEN 40 AND 60"), ("obesity_flag", 0, 0.06, "AGE < 30")]),
        ("raise_share", {"c": "depression_flag", "target": 0.025, "tiers": ["AGE BETWEEN 18 AND 40"]}),
        *_counts(0.1, [-1, 0, 1], [0.4, 0.2, 0.4]),
        ("noise_group_std", {"limits": COUNT_LIMITS, "factor": 0.04}),
        _range("mean_systolic_bp", 1.5, (3, 2), 0, (90, 140)), _range("mean_diastolic_bp", 1.2, (3, 2), 0, (60, 90)),
        _range("mean_weight", 0.8, (0, 0), 0), _range("mean_bmi", 0.3, (0, 0), 1), MALE,
        ("nudge", {"a": "AGE", "b": "encounter_count", "floor": 0.1, "where_above": 60, "lo": 4, "hi": 1211}), FORMAT],
    "anony11": [
        FORMAT, MALE, ("match_share", {"c": "ETHNICITY", "level": "hispanic", "other": "nonhispanic", "target": 0.0655, "step": 0.5}),
        _range("mean_systolic_bp", 0.0, (5, 2), 0, (90, 140)), _range("mean_bmi", 0.5, (0, 0), 1), _range("mean_weight", 0.8, (0, 0), 0),
        *_cohorts([("asthma_flag", 1, 0.02, "AGE < 30"), ("asthma_flag", 0, 0.01, "AGE > 60"), ("stroke_flag", 1, 0.01, "AGE > 65"),
                   ("stroke_flag", 0, 0.005, "AGE < 45"), ("obesity_flag", 1, 0.01, "AGE BETWEEN 40 AND 60"),
                   ("obesity_flag", 0, 0.01, "AGE < 30")], "flip_cohort_random"),
        ("raise_share", {"c": "depression_flag", "target": 0.02, "tiers": []}),
        *[("noise_proportional", {"c": c, "sigma": 0.02, "digits": None, "limits": SMALL_LIMITS[c]}) for c in COUNTS[:3]],
        *[("noise_sparse", {"c": c, "share": 1.0, "choices": [-1, 0, 1], "lo": lo, "hi": hi}) for c, (lo, hi) in list(SMALL_LIMITS.items())[3:]],
        ("shrink", {"cols": COUNTS, "rate": 0.1}),
        ("remap", {"c": "RACE", "listed": ["hawaiian", "native", "other", "asian", "black"], "to": [("white", 0.8), ("other", 0.2)]}),
        ("noise_age_bins", {"c": "AGE", "delta": 2}),
        ("swap_similar", {"cols": ["num_immunizations", "num_allergies", "num_devices"], "share": 0.02, "within": 5}), FORMAT],
    "group_shuffle": [("permute_columns", {"cols": [*CATEGORIES, *COUNTS, *BODY, *FLAGS]})],
    "row_shuffle": [("shuffle_rows", {})],
}
