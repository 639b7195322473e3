"""Scalar statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def crc_bound(mean: Column, n: Column, bound: float = 1.0) -> Column:
    return F.when(n <= 0, F.lit(bound)).otherwise(n / (n + 1) * mean + bound / (n + 1))


def collision_probability(j: Column, bands: int, rows: int) -> Column:
    return 1 - F.pow(1 - F.pow(j, rows), bands)


def recall_amplification(q: Column, m: Column) -> Column:
    return 1 - F.pow(1 - q, F.greatest(m, F.lit(1)))


def cross_entity_leak_bound(beta2: float, mass: Column, score: Column) -> Column:
    return beta2 * mass / (1 - beta2) * score


def tv_inflation(bound: float, tv: Column | None = None, chi2: Column | None = None, mean_abs_error: Column | None = None) -> Column:
    """B * min(1, d) from exactly one of the distances."""
    given = [x for x in (tv, chi2, mean_abs_error) if x is not None]
    if len(given) != 1:
        raise ValueError("give exactly one distance")
    d = tv if tv is not None else F.sqrt(chi2 / 2) if chi2 is not None else mean_abs_error / 2
    return bound * F.least(F.lit(1.0), d)


def precision(tp: Column, fp: Column) -> Column:
    return F.coalesce(F.try_divide(tp.cast("double"), tp + fp), F.lit(0.0))


def recall(tp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(tp.cast("double"), tp + fn), F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0))


def kl(a: Column, b: float) -> Column:
    """Kullback-Leibler divergence of Bernoulli(a) from Bernoulli(b)."""
    first = F.when(a > 0, a * F.ln(a / b)).otherwise(0.0)
    second = F.when(a < 1, (1 - a) * F.ln((1 - a) / (1 - b))).otherwise(0.0)
    return first + second


_LOG_FACTORIALS = [math.lgamma(i + 1) for i in range(32)]


def log_factorial(x: Column) -> Column:
    """ln x! of whole numbers: from a table while small, else Stirling's series (to 1e-12)."""
    y = x.cast("double") + 1
    series = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5))
    return F.when(x < len(_LOG_FACTORIALS), F.get(F.array(*map(F.lit, _LOG_FACTORIALS)), F.greatest(x, F.lit(0)).cast("int"))).otherwise(series)


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k). Terms are summed downwards from k, each from the one above, for as many as can matter: some standard
    deviations, whatever n. Above the mean the other tail is taken from 1."""

    def down(k: Column, p: float) -> Column:
        most = F.ceil(12 * F.sqrt(n * p * (1 - p))) + 64
        top = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(p) + (n - k) * math.log(1 - p))
        ratio = math.log((1 - p) / p)
        zero = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
        step = lambda a, i: F.struct((a["t"] * F.exp(F.ln(i / (n - i + 1).cast("double")) + ratio)).alias("t"), (a["s"] + a["t"] * F.exp(F.ln(i / (n - i + 1).cast("double")) + ratio)).alias("s"))
        falling = F.when(k >= 1, F.sequence(k.cast("long"), F.greatest(k - most + 1, F.lit(1)).cast("long"), F.lit(-1).cast("long"))).otherwise(F.expr("cast(array() as array<bigint>)"))
        return F.when(k < 0, 0.0).otherwise(F.least(F.lit(1.0), top * F.aggregate(falling, zero, step, lambda a: a["s"])))

    return F.when(k >= n, 1.0).when(k <= n * p, down(k, p)).otherwise(F.greatest(F.lit(0.0), 1 - down(n - k - 1, 1 - p)))


def hoeffding_bentkus(mean: Column, n: Column, alpha: float) -> Column:
    hoeffding = F.exp(-n * kl(F.least(mean, F.lit(alpha)), alpha))
    bentkus = math.e * binomial_cdf(F.ceil(F.round(n * mean, 9)), n, alpha)
    return F.when(mean >= alpha, 1.0).otherwise(F.least(F.lit(1.0), hoeffding, bentkus))


def upper_mean(mean: Column, var: Column, n: Column, delta: float, sign: int = 1) -> Column:
    """The tighter of Hoeffding's and the empirical Bernstein bound, clamped to [0, 1]; ``sign`` -1: lower."""
    hoeffding = F.sqrt(math.log(1 / delta) / (2 * n))
    bernstein = F.sqrt(2 * var * math.log(1 / delta) / n) + 7 * math.log(1 / delta) / (3 * F.greatest(n - 1, F.lit(1)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean + sign * F.least(hoeffding, bernstein)))


def normal_quantile(p: float) -> float:
    """Inverse of the normal distribution function, for constants."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def verdict(empty: Column, rho_hat: Column, rho_star: Column) -> Column:
    """What a certificate says: none, valid where it was calibrated (no shift measured), valid, or void beyond its radius."""
    return F.when(empty, "no-certificate").when(rho_hat.isNull(), "valid-at-P").when(rho_hat <= rho_star, "valid").otherwise("void")
