"""Statistics as columns: Wilson intervals, means with errors, lifts, the logistic approximation of the normal, quantile variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """The Wilson interval of k out of n; (0, 1) where n is 0."""
    p = F.try_divide(k, n)
    d = 1 + F.try_divide(F.lit(z * z), n)
    centre = p + F.try_divide(F.lit(z * z / 2), n)
    spread = F.lit(z) * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z / 4), n * n))
    return F.coalesce((centre - spread) / d, F.lit(0.0)), F.coalesce((centre + spread) / d, F.lit(1.0))


def mean_interval(x: Column, z: float = Z95) -> list[Column]:
    """n, mean, sample deviation, and the mean's interval."""
    n, m, s = F.count(x), F.avg(x), F.stddev_samp(x)
    return [n.alias("n"), m.alias("mean"), s.alias("sd"), (m - z * s / F.sqrt(n)).alias("lo"), (m + z * s / F.sqrt(n)).alias("hi")]


def corr(x: str, y: str) -> Column:
    """Pearson's correlation over the rows that have both; null where one of them doesn't vary."""
    both = lambda c: F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(c))
    return F.try_divide(F.covar_pop(both(x), both(y)), F.stddev_pop(both(x)) * F.stddev_pop(both(y)))


def normal_cdf(x: Column) -> Column:
    """The normal distribution function by Abramowitz and Stegun 26.2.17 (error under 7.5e-8)."""
    t = 1 / (1 + F.lit(0.2316419) * F.abs(x))
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * F.lit(1.330274429)))))
    tail = F.lit(0.3989422804014327) * F.exp(-x * x / 2) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def quantile_round(values: Column, q: float) -> Column:
    """The element of rank round(q * (n - 1)), half to even, of an array."""
    s = F.array_sort(values)
    return F.element_at(s, F.bround(F.lit(q) * (F.size(s) - 1)).cast("int") + 1)


def quantile_floor(values: Column, q: float) -> Column:
    """The element of rank floor(q * (n - 1))."""
    s = F.array_sort(values)
    return F.element_at(s, F.floor(F.lit(q) * (F.size(s) - 1)).cast("int") + 1)


def upper_median(values: Column) -> Column:
    """The element of rank n // 2."""
    s = F.array_sort(values)
    return F.element_at(s, F.floor(F.size(s) / 2).cast("int") + 1)


def break_even(target: Column, stop: Column, cost: Column) -> Column:
    return (stop + cost) / (target + stop)
