"""Statistics: exact tails, distances between distributions, and running totals that scale."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probity.functions import ordered
from probity.sources.storage import materialize


#: Steps of a continued fraction: enough for some 10^12 trials.
STEPS = 10_000_000


def beta_tail(p: float, a: float, b: float) -> float:
    """The regularised incomplete beta function I_p(a, b) by its continued fraction, in constant memory."""
    if p > (a + 1) / (a + b + 2):
        return 1.0 - beta_tail(1.0 - p, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(p) + b * math.log1p(-p)) / a
    tiny = 1e-300
    d = 1.0 - (a + b) * p / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    c, value = 1.0, d
    for m in range(1, STEPS):  # the convergents alternate around the limit and meet after some sqrt(a + b) steps
        before = value
        for step in (m * (b - m) * p / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * p / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(value - before) <= 4e-16 * abs(value):
            return min(1.0, front * value)
    raise ArithmeticError(f"the tail of ({p}, {a}, {b}) did not settle in {STEPS} steps")


@F.pandas_udf(T.DoubleType())
def binomial_tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """P(X >= k) of n trials, as I_p(k, n - k + 1); p is held inside (1e-9, 1 - 1e-9), k <= 0 gives 1."""

    def one(k: int, n: int, p: float) -> float:
        if k <= 0:
            return 1.0
        return beta_tail(min(max(p, 1e-9), 1 - 1e-9), float(k), float(n - k + 1)) if k <= n else 0.0

    return pd.Series([one(int(a), int(b), float(c)) for a, b, c in zip(k, n, p, strict=True)], dtype="float64")


def running_totals(df: DataFrame, order: str, sums: list[str], group: list[str] | None = None) -> DataFrame:
    """``df`` (one row for each value of ``order`` in a group) with inclusive running totals of ``sums`` as cum_<name>."""
    return ordered.running(df, group or [], [order], {f"cum_{s}": s for s in sums})


def ks_probability(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample probability from 100 terms; 1 where the distance is 0."""
    root = F.sqrt(n * m / (n + m))
    lam = (root + 0.12 + 0.11 / root) * d
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, j: s + F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * j * j * lam * lam))
    return F.when(d == 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * series)))


def ks_two_sample(df: DataFrame, value: str, is_current: Column, group: list[str] | None = None) -> DataFrame:
    """Per group: n_ref, n_cur, ks (largest gap of the right-continuous distributions), p_value."""
    group = group or []
    keyed = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*group, F.col(value).alias("v"), is_current.cast("int").alias("cur"))
    counts = materialize(keyed.groupBy(*group, "v").agg(F.sum("cur").alias("c"), F.sum(1 - F.col("cur")).alias("r")), "counts")
    sizes = counts.groupBy(*group).agg(F.sum("r").alias("n_ref"), F.sum("c").alias("n_cur"))
    cums = running_totals(counts, "v", ["c", "r"], group)
    joined = cums.join(F.broadcast(sizes)) if not group else cums.join(sizes, group)
    gaps = joined.groupBy(*group, "n_ref", "n_cur").agg(F.max(F.abs(F.col("cum_r") / F.col("n_ref") - F.col("cum_c") / F.col("n_cur"))).alias("ks"))
    return gaps.withColumn("p_value", ks_probability(F.col("ks"), F.col("n_ref"), F.col("n_cur")))


def exact_percentiles(df: DataFrame, value: str, shares: list[float], group: list[str] | None = None) -> DataFrame:
    """group, p: the interpolated percentiles of ``value`` at ``shares``, exact, from running counts.

    No task holds the values of a group. Null and NaN values are left out; a group without values has no row.
    """
    group = group or []
    counts = materialize(df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*group, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")), "counts")
    sizes = counts.groupBy(*group).agg(F.sum("n").alias("_all"))
    cums = running_totals(counts, "v", ["n"], group)
    joined = cums.join(sizes, group) if group else cums.join(F.broadcast(sizes))
    at = [F.lit(float(p)) * (F.col("_all") - 1) for p in shares]
    # The value of rank r (from 0) is the least one with more than r values up to it.
    ends = [(F.min(F.when(F.col("cum_n") > F.floor(r), F.col("v"))), F.min(F.when(F.col("cum_n") > F.ceil(r), F.col("v"))), F.first(r - F.floor(r))) for r in at]
    found = joined.groupBy(*group).agg(F.array(*[lo + (hi - lo) * part for lo, hi, part in ends]).alias("p"))
    return found if group else found.where(F.col("p")[0].isNotNull())


def psi(df: DataFrame, value: str, is_current: Column, bins: int = 10) -> DataFrame:
    """One row a bin: bin, n_ref, n_cur, and the bin's part of the population stability index over reference deciles."""
    flagged = df.select(F.col(value).alias("v"), is_current.alias("cur"))
    cuts = exact_percentiles(flagged.where(~F.col("cur")), "v", [i / bins for i in range(1, bins)]).withColumnRenamed("p", "cuts")
    placed = flagged.join(F.broadcast(cuts)).withColumn("bin", F.size(F.filter("cuts", lambda c: c <= F.col("v"))))
    n = placed.groupBy("bin").agg(F.sum(F.when(F.col("cur"), 0).otherwise(1)).alias("n_ref"), F.sum(F.when(F.col("cur"), 1).otherwise(0)).alias("n_cur"))
    whole = n.agg(F.sum("n_ref").alias("a"), F.sum("n_cur").alias("b"))
    share = n.join(F.broadcast(whole)).withColumns({"p": F.col("n_ref") / F.col("a") + 1e-4, "q": F.col("n_cur") / F.col("b") + 1e-4})
    return share.select("bin", "n_ref", "n_cur", ((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("part"))


def total_variation(df: DataFrame, kind: str, is_current: Column) -> DataFrame:
    """n_ref, n_cur and half the summed difference of the kinds' shares."""
    n = df.groupBy(kind).agg(F.sum(F.when(is_current, 1).otherwise(0)).alias("c"), F.sum(F.when(is_current, 0).otherwise(1)).alias("r"))
    whole = n.agg(F.sum("r").alias("n_ref"), F.sum("c").alias("n_cur"))
    return n.join(F.broadcast(whole)).groupBy("n_ref", "n_cur").agg((0.5 * F.sum(F.abs(F.col("r") / F.col("n_ref") - F.col("c") / F.col("n_cur")))).alias("tv"))


def moments(value: str) -> list[Column]:
    """count, l2, mean, population deviation, raw kurtosis (0 of a constant) and largest magnitude of a column."""
    v = F.col(value)
    square = F.var_pop(v) * F.var_pop(v)
    return [
        F.count(v).alias("n"), F.sqrt(F.sum(v * v)).alias("l2"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.when(square > 0, (F.kurtosis(v) + 3) * square / (square + 1e-12)).otherwise(0.0).alias("kurtosis"), F.max(F.abs(v)).alias("max_abs"),
    ]


def mmd_test(x: np.ndarray, y: np.ndarray, permutations: int = 200, seed: int = 0) -> tuple[float, float]:
    """Biased squared MMD with an RBF kernel whose width is the median positive distance, and its permutation probability.

    With weights 1/n on one sample and -1/m on the other the statistic is the form w' K w; the weights of all trials
    are evaluated in one product.
    """
    z = np.vstack([x, y]).astype(np.float64)
    norms = np.einsum("ij,ij->i", z, z)
    squares = np.clip(norms[:, None] + norms - 2.0 * (z @ z.T), 0.0, None)
    np.fill_diagonal(squares, 0.0)
    width = np.median(squares[squares > 0]) if (squares > 0).any() else 1.0
    kernel = np.exp(squares / -width)
    sets = trial_sets(len(x), len(y), permutations, seed)
    trials = np.full((len(sets), len(z)), 1.0 / len(x))
    np.put_along_axis(trials, sets, -1.0 / len(y), axis=1)
    values = ((trials @ kernel) * trials).sum(axis=1)
    return float(values[0]), float((1 + np.count_nonzero(values[1:] >= values[0])) / (permutations + 1))


def trial_sets(n: int, m: int, permutations: int, seed: int) -> np.ndarray:
    """Places (of n + m) that count as the second sample: its own ones first, then a row of m drawn ones for each permutation.

    Only the drawn places are held, so the first sample may be of any size.
    """
    rng = np.random.default_rng(seed)
    return np.array([np.arange(n, n + m), *(rng.choice(n + m, m, replace=False, shuffle=False) for _ in range(permutations))])
