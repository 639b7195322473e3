"""Sequential monitors: e-processes, mixtures, e-BH, Chao's estimator, CUSUM and fixed windows.

Streams are rows (series, pos, x) with x in [0, 1]. A series is folded by itself, in the order of pos."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import normal_quantile
from .folds import fold

FLOOR = 1e-300


class Bettor:
    """A bettor against "the mean is at most alpha": the stake follows from what came before; the wealth is floored, its
    peak kept and the first alarm noted. Observations may be numbers or arrays that run side by side."""

    def __init__(self, alpha: float, delta: float, cap: float = 0.5):
        self.alpha, self.most, self.goal = alpha, cap / alpha, 1 / delta
        self.wealth, self.peak, self.mu, self.var, self.n = 1.0, 1.0, alpha, 0.25, 0
        self.alarm: int | None = None

    def see(self, x: float, pos: int | None = None) -> None:
        gap = self.mu - self.alpha
        stake = max(0.0, min(self.most, gap / max(self.var, 1e-4)))
        self.wealth = max(self.wealth * (1 + stake * (x - self.alpha)), FLOOR)
        self.n += 1
        if self.n == 1:
            self.mu, self.var = x, 0.0
        else:
            mu = self.mu + (x - self.mu) / self.n
            self.var += ((x - self.mu) * (x - mu) - self.var) / self.n
            self.mu = mu
        self.peak = max(self.peak, self.wealth)
        if self.alarm is None and self.wealth >= self.goal:
            self.alarm = pos


def e_process(stream: DataFrame, alpha: float, delta: float = 0.05) -> DataFrame:
    """(series, wealth, e_value, n, alarm): e_value is the running peak, alarm the position where it first reached 1/delta."""
    rows = stream.select("series", F.col("pos").cast("long").alias("pos"), F.col("x").cast("double").alias("x"))
    kind = dict(rows.dtypes)["series"]
    return fold(rows, ["series"], ["pos"], ["x", "pos"], f"series {kind}, wealth double, e_value double, n int, alarm long", lambda: Bettor(alpha, delta), Bettor.see, lambda b: (b.wealth, b.peak, b.n, b.alarm))


class Mixture:
    """Bettors started every ``every`` observations, ``most`` at most, as arrays side by side."""

    def __init__(self, alpha: float, every: int, shares: np.ndarray):
        self.alpha, self.every, self.shares, self.t = alpha, every, shares, 0
        self.wealth, self.mu, self.var, self.n = (np.full(len(shares), x, float) for x in (1.0, alpha, 0.25, 0.0))

    def see(self, x: float) -> None:
        k = min(self.t // self.every + 1, len(self.shares))
        self.t += 1
        w, mu, var, n = self.wealth[:k], self.mu[:k], self.var[:k], self.n[:k]
        gap = mu - self.alpha
        stake = np.clip(gap / np.maximum(var, 1e-4), 0.0, 0.5 / self.alpha)
        np.maximum(w * (1 + stake * (x - self.alpha)), FLOOR, out=w)
        n += 1
        first = n == 1
        new = np.where(first, x, mu + (x - mu) / n)
        var[:] = np.where(first, 0.0, var + ((x - mu) * (x - new) - var) / n)
        mu[:] = new

    def value(self) -> tuple[float]:
        used = self.shares[: min((self.t - 1) // self.every + 1, len(self.shares))]
        return (float(used @ self.wealth[: len(used)] + 1 - used.sum()),)


def e_detector(stream: DataFrame, alpha: float, every: int = 25, most: int = 64, ratio: float = 0.85, prior: str = "geometric") -> DataFrame:
    """(series, e_value): the mixture of processes started every ``every`` observations; those not started count 1."""
    norm = (1 - ratio**most) / (1 - ratio) if prior == "geometric" else float(most)
    shares = np.array([ratio**k / norm if prior == "geometric" else 1 / norm for k in range(most)])
    rows = stream.select("series", "pos", F.col("x").cast("double").alias("x"))
    return fold(rows, ["series"], ["pos"], ["x"], f"series {dict(rows.dtypes)['series']}, e_value double", lambda: Mixture(alpha, every, shares), Mixture.see, Mixture.value)


class Watch(Mixture):
    """A mixture that notes when its value first reached 1/delta."""

    def __init__(self, alpha: float, every: int, shares: np.ndarray, delta: float):
        super().__init__(alpha, every, shares)
        self.goal, self.alarm, self.peak = 1 / delta, None, 0.0

    def watch(self, x: float, pos: int) -> None:
        self.see(x)
        (value,) = self.value()
        self.peak = max(self.peak, value)
        if self.alarm is None and value >= self.goal:
            self.alarm = pos


def e_detector_alarm(stream: DataFrame, alpha: float, delta: float = 0.05, every: int = 25, most: int = 64, ratio: float = 0.85) -> DataFrame:
    """(series, alarm, peak): where the mixture first reached 1/delta."""
    shares = np.array([ratio**k for k in range(most)]) * (1 - ratio) / (1 - ratio**most)
    rows = stream.select("series", F.col("pos").cast("long").alias("pos"), F.col("x").cast("double").alias("x"))
    return fold(rows, ["series"], ["pos"], ["x", "pos"], f"series {dict(rows.dtypes)['series']}, alarm long, peak double", lambda: Watch(alpha, every, shares, delta), Watch.watch, lambda w: (w.alarm, w.peak))


def e_bh(values: DataFrame, delta: float) -> DataFrame:
    """Adds ``rejected``: with k the largest rank whose e-value reaches m / (delta k), those of m / (delta k) or more. The types are few."""
    w = Window.orderBy(F.desc("e_value"))
    ranked = values.withColumn("rk", F.row_number().over(w)).withColumn("m", F.count("*").over(Window.partitionBy()))
    k = F.max(F.when(F.col("e_value") >= F.col("m") / (delta * F.col("rk")), F.col("rk"))).over(Window.partitionBy())
    return ranked.withColumn("k", k).withColumn("rejected", F.coalesce(F.col("e_value") >= F.col("m") / (delta * F.col("k")), F.lit(False))).drop("rk", "m", "k")


def chao1(captures: DataFrame, occasions: Column | int, delta: float = 0.05, least: int = 30) -> DataFrame:
    """Per type from (type, multiplicity): n_obs, f1, f2, the bias-corrected richness, its log-normal upper limit, informative."""
    z = normal_quantile(1 - delta / 2)
    m = F.lit(occasions) if isinstance(occasions, int) else occasions
    c = captures.groupBy("type").agg(F.count("*").alias("n_obs"), F.count_if(F.col("multiplicity") == 1).alias("f1"), F.count_if(F.col("multiplicity") == 2).alias("f2"))
    a = ((m - 1) / m).cast("double")
    f1, f2 = F.col("f1").cast("double"), F.col("f2").cast("double")
    extra = a * f1 * (f1 - 1) / (2 * (f2 + 1))
    n_hat = F.col("n_obs") + extra
    var = F.when(
        f2 > 0, a * f1 * (f1 - 1) / (2 * (f2 + 1)) + a * a * f1 * F.pow(2 * f1 - 1, 2) / (4 * F.pow(f2 + 1, 2)) + a * a * f1 * f1 * f2 * F.pow(f1 - 1, 2) / (4 * F.pow(f2 + 1, 4))
    ).otherwise(F.greatest(F.lit(0.0), a * f1 * (f1 - 1) / 2 + a * a * f1 * F.pow(2 * f1 - 1, 2) / 4 - a * a * F.pow(f1, 4) / (4 * F.greatest(n_hat, F.lit(1.0)))))
    upper = F.when((extra > 0) & (var > 0), F.col("n_obs") + extra * F.exp(z * F.sqrt(F.ln(1 + var / (extra * extra))))).otherwise(n_hat)
    return c.select("type", "n_obs", "f1", "f2", n_hat.alias("n_hat"), upper.alias("n_upper"), ((F.col("n_obs") >= least) & (F.col("f2") > 0) & (m > 1)).alias("informative"))


def dark_matter(merged: DataFrame, least_score: float = 0.0, delta: float = 0.05) -> DataFrame:
    """Chao's estimate per type over how many engines found each merged span (engines: array)."""
    engines = merged.select(F.explode("engines").alias("e")).agg(F.countDistinct("e").alias("m"))
    rows = merged.where(F.col("score") >= least_score).select("type", F.size("engines").alias("multiplicity"))
    m = int(engines.first()[0] or 1)
    out = chao1(rows, m, delta)
    return out.withColumn("dark_rate", F.when(F.col("n_hat") > 0, 1 - F.col("n_obs") / F.col("n_hat")).otherwise(0.0))


def cusum_alarm(stream: DataFrame, alpha: float, threshold: float, drift: float = 0.02) -> DataFrame:
    """(series, alarm): first position where max(0, s + x - alpha - drift) exceeds the threshold; s_t = S_t - min(0, S_1..S_t)."""
    w = Window.partitionBy("series").orderBy("pos")
    s = stream.withColumn("s", F.sum(F.col("x") - alpha - drift).over(w))
    s = s.withColumn("stat", F.col("s") - F.least(F.lit(0.0), F.min("s").over(w)))
    return s.groupBy("series").agg(F.min(F.when(F.col("stat") > threshold, F.col("pos"))).alias("alarm"), F.max("stat").alias("peak"))


def fixed_window_alarm(stream: DataFrame, alpha: float, width: int, z: float) -> DataFrame:
    """(series, alarm, peak): first position whose mean over the last ``width`` exceeds alpha by z standard errors, and the most by which any does."""
    order = Window.partitionBy("series").orderBy("pos")
    rows = stream.select("series", "pos", F.row_number().over(order).alias("t"), F.avg("x").over(order.rowsBetween(1 - width, 0)).alias("m"))
    error = math.sqrt(alpha * (1 - alpha) / width)
    full = F.col("t") >= width
    return rows.groupBy("series").agg(F.min(F.when(full & (F.col("m") > alpha + z * error), F.col("pos"))).alias("alarm"), F.max(F.when(full, (F.col("m") - alpha) / error)).alias("peak"))


def calibrate_threshold(peaks: DataFrame, target: float) -> DataFrame:
    """The threshold whose false-alarm rate over series (series, peak) is ``target``: a quantile of the peaks."""
    return peaks.agg(F.expr(f"percentile(peak, {1 - target})").alias("threshold"))


def delay_stats(alarms: DataFrame, change: int) -> DataFrame:
    """(false_alarm_rate, detected, median_delay, mean_delay) of alarms around a change point."""
    a = F.col("alarm")
    delay = F.when(a >= change, a - change)
    return alarms.agg(
        F.avg((F.coalesce(a < change, F.lit(False))).cast("double")).alias("false_alarm_rate"), F.avg(F.coalesce(a >= change, F.lit(False)).cast("double")).alias("detected"),
        F.median(delay).alias("median_delay"), F.avg(delay).alias("mean_delay"),
    )
