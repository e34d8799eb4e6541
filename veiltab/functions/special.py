"""Normal and chi-square functions Spark lacks, as column expressions."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LN10 = math.log(10.0)


def _poly(x: Column, coefs: list[float]) -> Column:
    """Horner evaluation, highest power first."""
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


# Chebyshev fit of erfc (Press et al., Numerical Recipes), highest power first.
ERFC_COEFS = [0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807,
              -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223]


def log_erfc(z: Column) -> Column:
    """ln erfc(z) for z >= 0, relative error below 1.2e-7, without underflow."""
    t = 1.0 / (1.0 + 0.5 * z)
    return F.log(t) - z * z + _poly(t, ERFC_COEFS)


def normal_cdf(z: Column) -> Column:
    tail = 0.5 * F.exp(log_erfc(F.abs(z) / F.lit(math.sqrt(2.0))))
    return F.when(z >= 0, 1.0 - tail).otherwise(tail)


# Acklam's rational approximation of the normal quantile.
ACKLAM_A = [-39.69683028665376, 220.9460984245205, -275.9285104469687,
            138.3577518672690, -30.66479806614716, 2.506628277459239]
ACKLAM_B = [-54.47609879822406, 161.5858368580409, -155.6989798598866,
            66.80131188771972, -13.28068155288572, 1.0]
ACKLAM_C = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838,
            -2.549732539343734, 4.374664141464968, 2.938163982698783]
ACKLAM_D = [0.007784695709041462, 0.3224671290700398, 2.445134137142996,
            3.754408661907416, 1.0]


def normal_quantile(p: Column) -> Column:
    low = 0.02425
    q = p - 0.5
    r = q * q
    mid = q * _poly(r, ACKLAM_A) / _poly(r, ACKLAM_B)
    ql = F.sqrt(-2.0 * F.log(F.when(p < low, p)))
    qh = F.sqrt(-2.0 * F.log(F.when(p > 1 - low, 1.0 - p)))
    left = _poly(ql, ACKLAM_C) / _poly(ql, ACKLAM_D)
    right = -_poly(qh, ACKLAM_C) / _poly(qh, ACKLAM_D)
    return F.when(p < low, left).when(p > 1 - low, right).otherwise(mid)


def log_sum_exp(terms: Column) -> Column:
    top = F.array_max(terms)
    return top + F.log(F.aggregate(F.transform(terms, lambda t: F.exp(t - top)),
                                   F.lit(0.0), lambda s, x: s + x))


def chi2_log_sf(x: Column, df: Column) -> Column:
    """ln P(X > x) for a chi-square with integer ``df``; finite however small the tail.

    Even df: -x/2 + ln sum_{i < df/2} (x/2)^i / i!. Odd df: the erfc term plus the
    half-integer series, both in log space.
    """
    h = F.greatest(x, F.lit(1e-300)) / 2.0

    def log_gamma_int(n: Column) -> Column:  # ln (n)!
        return F.aggregate(F.sequence(F.lit(0), n), F.lit(0.0),
                           lambda s, i: s + F.log(F.greatest(i, F.lit(1)).cast("double")))

    even_terms = F.transform(
        F.sequence(F.lit(0), F.greatest((df / 2).cast("int") - 1, F.lit(0))),
        lambda i: i * F.log(h) - log_gamma_int(i))
    even = -h + log_sum_exp(even_terms)

    def log_gamma_half(j: Column) -> Column:  # ln Gamma(j + 3/2)
        return F.lit(0.5 * math.log(math.pi)) + F.aggregate(
            F.sequence(F.lit(0), j), F.lit(0.0), lambda s, i: s + F.log(i + 0.5))

    odd_terms = F.transform(
        F.sequence(F.lit(0), F.greatest(((df - 3) / 2).cast("int"), F.lit(0))),
        lambda j: -h + (j + 0.5) * F.log(h) - log_gamma_half(j))
    odd_head = log_erfc(F.sqrt(h))
    odd = F.when(df < 2, odd_head).otherwise(log_sum_exp(F.concat(F.array(odd_head), odd_terms)))
    return F.when(x <= 0, 0.0).when(df % 2 == 0, even).otherwise(odd)


def minus_log10_p(x: Column, df: Column) -> Column:
    return -chi2_log_sf(x, df) / F.lit(LN10)


def squash_log10_p(x: Column, method: str = "arctan", scale: float = 10.0,
                   cap: float = 300.0) -> Column:
    """Map -log10 p to [0, 1]; negative or non-finite input counts as 0."""
    bad = x.isNull() | F.isnan(x) | (x < 0) | (x == F.lit(float("inf")))
    v = F.when(bad, 0.0).otherwise(x)
    if method == "arctan":
        return F.lit(2.0 / math.pi) * F.atan(v / scale)
    if method == "exp":
        return 1.0 - F.exp(-v / scale)
    if method == "log1p":
        return F.log1p(F.least(v, F.lit(cap))) / F.lit(math.log1p(cap))
    raise ValueError(method)
