"""Tail probabilities that Spark SQL has no built-in for, as column arithmetic.

Densities are integrated by a fixed number of Gauss-Legendre nodes, each relative to its greatest value, so that
neither the number of trials nor the distance into the tail changes the work or the relative precision.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

NODES = 64
# Half the width of a bell curve that holds all of it but 1e-20, in standard deviations, and the e-folds of a tail that count.
WIDTH, FOLDS = 9.5, 42.0


def _integral(low: Column, high: Column, density) -> Column:
    """Integral of ``density(t)`` over an interval in which it is smooth."""
    half, middle = (high - low) / 2, (high + low) / 2
    nodes = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(w)).alias("w")) for x, w in zip(*np.polynomial.legendre.leggauss(NODES), strict=True)])
    return half * F.aggregate(nodes, F.lit(0.0), lambda acc, p: acc + p["w"] * density(middle + half * p["x"]))


def binomial_upper_tail(n: Column, wins: Column) -> Column:
    """P(Bin(n, 0.5) >= wins), to about 1e-12 relative; null if either is null or n is negative.

    The tail is the share of a beta density below one half, I_0.5(wins, n - wins + 1). For fewer wins than half the
    other tail is taken from one.
    """
    n, wins = n.cast("double"), wins.cast("double")
    more = 2 * wins >= n + 1
    return (
        F.when(n.isNull() | wins.isNull() | (n < 0), None).when(wins <= 0, F.lit(1.0)).when(wins > n, F.lit(0.0))
        .when(more, _beta_share(n, wins)).otherwise(1.0 - _beta_share(n, n - wins + 1)))


def _beta_share(n: Column, wins: Column) -> Column:
    """I_0.5(wins, n - wins + 1) for at least half of n wins, by the density relative to its mode."""
    a, b = wins - 1, n - wins
    mode = a / F.greatest(n - 1, F.lit(1.0))
    spread = F.sqrt(wins * (n - wins + 1) / ((n + 1) * (n + 1) * (n + 2)))
    log_density = lambda t: a * F.log1p((t - mode) / mode) + b * F.log1p((mode - t) / (1 - mode))
    # With few losses the density has the longer tail of a gamma density on this side.
    whole = _integral(F.greatest(F.lit(0.0), mode - WIDTH * spread - FOLDS / (a + 1)), F.least(F.lit(1.0), mode + WIDTH * spread), lambda t: F.exp(log_density(t)))
    half = F.lit(0.5)
    at_half = log_density(half)
    # From one half downwards the density falls at least as fast as at its start.
    reach = F.least(half, WIDTH * spread, FOLDS / F.greatest(2 * (a - b), F.lit(1e-300)))
    below = _integral(half - reach, half, lambda t: F.exp(log_density(t) - at_half))
    # All wins: the density has its mode at the end of the interval.
    return F.when(wins >= n, F.exp(-n * math.log(2.0))).otherwise(F.exp(at_half) * below / whole)


def normal_upper_tail(t: Column) -> Column:
    """P(N(0,1) >= t), to about 1e-13 relative; null and NaN give null."""
    size = F.abs(t)
    reach = F.least(F.lit(WIDTH), FOLDS / F.greatest(size, F.lit(1e-300)))
    tail = F.exp(-size * size / 2) / math.sqrt(2 * math.pi) * _integral(F.lit(0.0), reach, lambda u: F.exp(-size * u - u * u / 2))
    return F.when(t.isNull() | F.isnan(t), None).when(size == float("inf"), F.when(t > 0, 0.0).otherwise(1.0)).when(t >= 0, tail).otherwise(1.0 - tail)
