"""Phred scores, probabilities and tests, as built-in expressions; binomial tails as an Arrow function."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def error_probability(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10)


def phred(p: Column, most: int | None = None) -> Column:
    """floor(-10 log10(p) + 0.5), for p of zero the most."""
    score = F.floor(-10 * F.log10(p) + 0.5).cast("int")
    return F.when(p <= 0, F.lit(most)).otherwise(F.least(score, F.lit(most))) if most is not None else score


def complement(p: Column) -> Column:
    return 1 - p


def snp_adjusted_error(q: Column, snp: float) -> Column:
    """Error of a base call with a chance snp that the base truly differs."""
    e = error_probability(q)
    return e * (1 - F.lit(snp) / 3) + (1 - e) * F.lit(snp)


def log_sum2(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b)), stable."""
    top, low = F.greatest(a, b), F.least(a, b)
    return top + F.log1p(F.exp(low - top))


def log_sum_all(values: Column) -> Column:
    """log of the summed exponentials of an array."""
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda a, v: a + F.exp(v - top)))


def normalised(values: Column) -> Column:
    """An array of log weights as probabilities."""
    top = F.array_max(values)
    weights = F.transform(values, lambda v: F.exp(v - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, v: a + v)
    return F.transform(weights, lambda v: v / total)


def ramp(x: Column, low: float, high: float) -> Column:
    """0 up to low, 1 from high on, linear between."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / F.lit(float(high - low))))


@lru_cache(maxsize=100_000)
def _tail(k: int, n: int, p: float) -> float:
    """P(X >= k) of a binomial, summed from its smaller side."""
    if k <= 0:
        return 1.0
    if k > n or p <= 0:
        return 0.0
    if p >= 1:
        return 1.0
    term = lambda i: math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
    if k > n * p:
        return min(1.0, math.fsum(term(i) for i in range(k, n + 1)))
    return max(0.0, 1.0 - math.fsum(term(i) for i in range(k)))


@F.pandas_udf(DoubleType())
def binomial_tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """P(X >= k) for n trials of chance p."""
    return pd.Series([_tail(int(a), int(b), float(c)) if np.isfinite(a) and np.isfinite(b) else None for a, b, c in zip(k, n, p)])


def rejects_upper(k: Column, n: Column, p: Column, alpha: float) -> Column:
    return (k > 0) & (binomial_tail(k, n, p) <= alpha)


@F.pandas_udf(DoubleType())
def binomial_two_sided(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """Twice the smaller tail, at most 1."""
    out = []
    for a, b, c in zip(k.astype(int), n.astype(int), p):
        out.append(min(1.0, 2 * min(_tail(a, b, c), 1 - _tail(a + 1, b, c))))
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def chi_square_tail(x: pd.Series) -> pd.Series:
    """P(X > x) with one degree of freedom."""
    return pd.Series([math.erfc(math.sqrt(max(v, 0.0) / 2)) for v in x])


def likelihood_ratio_tail(null: Column, alt: Column) -> Column:
    """The tail of twice the gain in log likelihood, with one degree of freedom."""
    return chi_square_tail(2 * (alt - null))
