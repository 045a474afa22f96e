"""A variational mixture of normal laws on a weighted sample, and the choice of its size by held-out folds.

Samples are histograms of a fixed number of bins, so what is fitted does not grow with the number of spots.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotloom.operators.estimators import mixture_1d
from spotloom.operators.quantiles import quantiles

#: Prior of the means (precision of a mean at 0), floor added to variances, change of the bound at which rounds end.
MEAN_PRECISION, FLOOR, TOL = 1e7, 1e-6, 1e-3


def digamma(x: np.ndarray) -> np.ndarray:
    """The derivative of log gamma, by recurrence up to 6 and the asymptotic series from there."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (low := x < 6).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    s = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - s * (1 / 12 - s * (1 / 120 - s / 252))


def variational_mixture(x: np.ndarray, weights: np.ndarray, k: int, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and variances under a stick-breaking prior on weights and means held at zero."""
    total = weights.sum()
    centre = (weights * x).sum() / total
    prior = (weights * (x - centre) ** 2).sum() / max(total - 1, 1)
    start = mixture_1d(x, weights, k)[1]
    resp = (np.abs(x[:, None] - start).argmin(1)[:, None] == np.arange(k)).astype(float)
    last = -np.inf
    for _ in range(rounds):
        part = resp * weights[:, None]
        n = part.sum(0) + 1e-15
        mean = (part * x[:, None]).sum(0) / n
        spread = (part * (x[:, None] - mean) ** 2).sum(0) / n + FLOOR
        a, b = 1 + n, 1 / k + np.append(np.cumsum(n[::-1])[::-1][1:], 0.0)
        precision = MEAN_PRECISION + n
        dof = 1 + n
        var = (prior + n * spread + n * MEAN_PRECISION / precision * mean**2) / dof
        at = n * mean / precision
        both = digamma(a + b)
        stick = digamma(a) - both + np.append(0.0, np.cumsum(digamma(b) - both)[:-1])
        gauss = -0.5 * (math.log(2 * math.pi) + np.log(var) + (x[:, None] - at) ** 2 / var)
        log = stick + gauss + 0.5 * (math.log(2) + digamma(dof / 2) - np.log(dof) - 1 / precision)
        top = log.max(1, keepdims=True)
        norm = top[:, 0] + np.log(np.exp(log - top).sum(1))
        resp = np.exp(log - norm[:, None])
        bound = float((weights * norm).sum())
        if abs(bound - last) < TOL:
            break
        last = bound
    v = a / (a + b)
    share = v * np.append(1.0, np.cumprod(1 - v)[:-1])
    return share / share.sum(), at, var


def components_by_folds(x: np.ndarray, folds: np.ndarray, most: int = 3) -> int:
    """The number of components with the lowest mean information criterion on folds left out; folds has a row a fold."""

    def held_out(k: int) -> float:
        found = []
        for f in folds:
            rest = folds.sum(0) - f
            if f.sum() == 0 or rest.sum() == 0:
                continue
            share, mean, var, _ = mixture_1d(x, rest, k)
            log = np.log(share) - 0.5 * np.log(2 * np.pi * var) - (x[:, None] - mean) ** 2 / (2 * var)
            top = log.max(1)
            ll = float((f * (top + np.log(np.exp(log - top[:, None]).sum(1)))).sum())
            found.append((3 * k - 1) * math.log(max(2.0, f.sum())) - 2 * ll)
        return float(np.mean(found)) if found else math.inf

    return 1 + int(np.argmin([held_out(k) for k in range(1, most + 1)]))


def trim_jumps(jumps: DataFrame, axes: tuple[str, ...] = ("dx", "dy"), rounds: int = 2, wide: float = 4.0, most: float = 10.0) -> DataFrame:
    """Jumps whose parts are all below `wide` mean deviations (or `most`, if that is more), twice, and then below `most`."""
    for _ in range(rounds):
        spread = sum(F.coalesce(F.stddev_pop(c), F.lit(0.0)) for c in axes) / len(axes)
        limit = jumps.agg(F.greatest(wide * spread, F.lit(most)).alias("_limit"))
        near = reduce(and_, [F.abs(F.col(c)) < F.col("_limit") for c in axes])
        jumps = jumps.join(F.broadcast(limit)).where(near).drop("_limit")  # a single row
    return jumps.where(reduce(and_, [F.abs(F.col(c)) < most for c in axes]))


def gmm_jump_threshold(jumps: DataFrame, axes: tuple[str, ...] = ("dx", "dy"), bins: int = 400, floor: float = 5.0, folds: int = 5) -> float:
    """The jump threshold from mixtures of each axis's displacements strictly between their 2.5 and 97.5 percentiles.

    The widest component near zero gives an axis 2.5 deviations, the axes add as squares, and floor is the least. Axes
    without spread or without such a component add nothing. Only folds * bins counts an axis come to the driver.
    """
    total = 0.0
    for c in axes:
        ends = quantiles(jumps, c, [], lo=0.025, hi=0.975).first()
        if ends is None or ends.hi <= ends.lo:
            continue
        lo, hi = ends.lo, ends.hi
        at = F.least(F.floor((F.col(c) - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
        inner = jumps.where((F.col(c) > lo) & (F.col(c) < hi))
        rows = inner.groupBy(F.pmod(F.xxhash64(*inner.columns), F.lit(folds)).cast("int").alias("fold"), at.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
        hist = np.zeros((folds, bins))
        for r in rows:
            hist[r.fold, r.bin] = r.n
        used = hist.sum(0) > 0
        x, hist = (lo + (np.arange(bins) + 0.5) * (hi - lo) / bins)[used], hist[:, used]
        n = hist.sum(0)
        if n.sum() == 0 or (n * (x - (n * x).sum() / n.sum()) ** 2).sum() / n.sum() <= 1e-5:
            continue
        share, mean, var = variational_mixture(x, n, components_by_folds(x, hist))
        near = (np.abs(mean) < 1) & (share > 0.05)
        if near.any():
            total += 2.5**2 * float(var[near].max())
    return max(floor, math.sqrt(total))
