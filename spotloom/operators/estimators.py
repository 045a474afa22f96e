"""Iterative estimators: localization precision, K, scans over strides, histogram fits and mixtures.

What is fitted has been reduced first, to a curve of mean squares or to a histogram, so a fit never holds a group of
points in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotloom.operators import diffusion, graph
from spotloom.operators import trajectory as T
from spotloom.operators.quantiles import quantiles

_ERF = np.vectorize(math.erf, otypes=[float])


def precision_of_spots(loc: pd.DataFrame) -> np.ndarray:
    """Localization error in pixels of each spot; nan where the fit or the background says nothing."""
    x, y, u, v, rho, bg, flux = (loc[c].to_numpy(float) for c in ("x", "y", "xvar", "yvar", "rho", "bg_var", "integrated_flux"))
    window = loc["window_size"].fillna(0).to_numpy(int)
    out = np.full(len(loc), np.nan)
    with np.errstate(all="ignore"):
        sx, sy, k = np.sqrt(u), np.sqrt(v), 1 - rho**2
        caught = np.clip(_ERF(np.nan_to_num(window / 2 / (sx * math.sqrt(2)))) * _ERF(np.nan_to_num(window / 2 / (sy * math.sqrt(2)))), 0.5, 1)
        photons = flux / caught
        good = (u > 0) & (v > 0) & (bg > 0) & np.isfinite(bg) & np.isfinite(photons) & (photons > 0) & (k > 0)
    for w in np.unique(window[good]):
        at = np.flatnonzero(good & (window == w))
        side = np.arange(-(w // 2), w // 2 + 1)
        dx = (np.rint(x[at])[:, None] + side - x[at][:, None])[:, None, :]
        dy = (np.rint(y[at])[:, None] + side - y[at][:, None])[:, :, None]
        one = lambda a: a[at][:, None, None]  # noqa: B023, E731
        cross = one(rho) / (one(sx) * one(sy))
        mu = one(photons) / (2 * np.pi * one(sx) * one(sy) * np.sqrt(one(k))) * np.exp(-(dx**2 / one(u) + dy**2 / one(v) - 2 * cross * dx * dy) / (2 * one(k)))
        gx, gy = mu / one(k) * (dx / one(u) - cross * dy), mu / one(k) * (dy / one(v) - cross * dx)
        ixx, iyy, ixy = ((a * b).sum((1, 2)) / bg[at] for a, b in ((gx, gx), (gy, gy), (gx, gy)))
        with np.errstate(all="ignore"):
            det = ixx * iyy - ixy**2
            out[at] = np.where(det > 0, 0.5 * (np.sqrt(iyy / det) + np.sqrt(ixx / det)), np.nan)
    return out


def sigma_loc(loc: DataFrame) -> DataFrame:
    """loc with sigma_loc, null where it can't be told."""

    def run(batches):
        for b in batches:
            s = pd.Series(precision_of_spots(b), index=b.index)
            yield b.assign(sigma_loc=s.where(s.notna(), None))

    return loc.mapInPandas(run, loc.limit(0).withColumn("sigma_loc", F.lit(None).cast("double")).schema)


def pooled_sigma(with_sigma: DataFrame) -> DataFrame:
    """Median and root mean square of finite errors by video; 0 without any."""
    s = with_sigma.select("video", F.when(~F.isnan("sigma_loc"), F.col("sigma_loc")).alias("s"))
    rms = s.groupBy("video").agg(F.coalesce(F.sqrt(F.avg(F.col("s") * F.col("s"))), F.lit(0.0)).alias("rms"))
    return rms.join(quantiles(s, "s", ["video"], median=0.5), "video", "left").select("video", F.coalesce("median", F.lit(0.0)).alias("median"), "rms")


def _j_var(h: float, d: np.ndarray, r: float) -> np.ndarray:
    if r <= 1e-9:
        return d ** (2 * h)
    a = 2 * h + 2
    return ((d + r) ** a + np.abs(d - r) ** a - 2 * d**a - 2 * r**a) / (r * r * (2 * h + 1) * (2 * h + 2))


def fit_curve(lag: np.ndarray, msd: np.ndarray, sem: np.ndarray, sigma: float, r: float) -> tuple[float, float]:
    """K in [1e-4, 10] and H in [0.01, 0.99] of 2 K J_var + 2 sigma^2 by weighted least squares; K is linear given H."""
    w, y = 1 / np.maximum(sem, 1e-12) ** 2, msd - 2 * sigma**2

    def best_k(h: float) -> float:
        x = 2 * _j_var(h, lag, r)
        return float(np.clip((w * x * y).sum() / (w * x * x).sum(), 1e-4, 10.0))

    loss = lambda h: float((w * (y - 2 * best_k(h) * _j_var(h, lag, r)) ** 2).sum())
    grid = np.linspace(0.01, 0.99, 99)
    i = int(np.argmin([loss(h) for h in grid]))
    h = diffusion.golden(loss, grid[max(0, i - 1)], grid[min(98, i + 1)])
    return best_k(h), float(h)


def fit_k(traces: DataFrame, sigma: float = 0.0, r: float = 0.0, lags: int = 10) -> tuple[float, float] | None:
    """K and H from the pooled mean squared displacements of all trajectories (a row a lag comes to the driver)."""
    rows = [x for x in T.pooled_msd(traces, lags).orderBy("lag").collect() if x.msd is not None]
    if len(rows) < 2:
        return None
    return fit_curve(np.array([x.lag for x in rows], float), np.array([x.msd for x in rows]), np.array([x.sem if x.sem is not None else x.msd for x in rows]), sigma, r)


def fit_k_by_state(traces: DataFrame, sigma: float = 0.0, r: float = 0.0, lags: int = 10) -> DataFrame:
    """state, K, H: fit_k for every state at once, of trajectories that each have one; null with less than two lags."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("lag")
        found = (None, None)
        if len(g) > 1:
            found = fit_curve(g.lag.to_numpy(float), g.msd.to_numpy(), g["sem"].fillna(g["msd"]).to_numpy(), sigma, r)
        return pd.DataFrame({"state": [g.state.iloc[0]], "K": [found[0]], "H": [found[1]]}).astype({"K": float, "H": float})

    return T.pooled_msd(traces, lags, by=("state",)).groupBy("state").applyInPandas(run, "state int, K double, H double")


def longest_stride(traces: DataFrame, most: int = 75, least: int = 30) -> int:
    """The greatest stride up to which all strides have places for at least `least` ratios."""
    n = {x.delta: x.n for x in diffusion.ratio_counts(traces, most).collect()}
    d = 0
    while d < most and n.get(d + 1, 0) >= least:
        d += 1
    return d


def multi_delta_scan(traces: DataFrame, k: float = 1.0, sigma: float = 0.0, r: float = 0.0, most: int = 75, least: int = 30) -> DataFrame:
    """H with its error by state for each stride that has enough ratios."""
    top = longest_stride(traces, most, least)
    fits = diffusion.h_fit(diffusion.stride_ratios(traces, max(1, top)), r, k, sigma)
    return fits.where((F.col("n_ratios") >= least) & (F.col("delta") <= top)).withColumn("converged", ~F.isnan("H_estim"))


def scan_by_state(traces: DataFrame, ks: DataFrame, sigma: float = 0.0, r: float = 0.0, most: int = 75, least: int = 30) -> DataFrame:
    """multi_delta_scan of each state by its own K (ks: state, K), all in one pass, of trajectories that each have one state.

    Places for ratios fall as strides grow, so a state's strides end where it has fewer than `least`.
    """
    places = diffusion.ratio_counts(traces.join(ks.select("state"), "state", "left_semi"), most, ("state",))
    tops = graph.cut_lineage(places.where(F.col("n") >= least).groupBy("state").agg(F.max("delta").alias("top")))  # a row a state
    longest = tops.agg(F.max("top")).first()[0]
    own = ks.select("state", F.col("K").alias("k")).join(tops, "state")
    ratios = diffusion.stride_ratios(traces, max(1, longest or 1)).join(own, "state").where(F.col("delta") <= F.col("top")).drop("top")
    return diffusion.h_fit(ratios, r, sigma=sigma).where(F.col("n_ratios") >= least).withColumn("converged", ~F.isnan("H_estim"))


def sensitivity(scan: DataFrame, k: float, sigma: float, r: float, factors: tuple[float, ...] = (0.1, 0.5, 1.0, 2.0, 10.0)) -> DataFrame:
    """H that a fitted location would mean if the noise variance were some multiple of what it was taken for."""
    rows = scan.select("state", "delta", "rho", F.explode(F.array(*[F.lit(f) for f in factors])).alias("factor"))

    def run(batches):
        for b in batches:
            yield b.assign(h=[diffusion.invert_rho(p, float(d), r, k, math.sqrt(f) * sigma) if p == p else float("nan") for p, d, f in zip(b.rho, b.delta, b.factor, strict=True)])

    return rows.mapInPandas(run, "state int, delta int, rho double, factor double, h double")


def nelder_mead(f: Callable[[np.ndarray], float], start: list[float], step: float = 0.25, steps: int = 400, tol: float = 1e-9) -> np.ndarray:
    """Where f is least near start, by the downhill simplex."""
    pts = [np.array(start, float)]
    for i in range(len(start)):
        p = pts[0].copy()
        p[i] += step * (abs(p[i]) or 1)
        pts.append(p)
    val = [f(p) for p in pts]
    for _ in range(steps):
        order = np.argsort(val, kind="stable")
        pts, val = [pts[i] for i in order], [val[i] for i in order]
        if val[-1] - val[0] < tol:
            break
        mid = np.mean(pts[:-1], 0)
        away = mid + (mid - pts[-1])
        fa = f(away)
        if fa < val[0]:
            far = mid + 2 * (mid - pts[-1])
            ff = f(far)
            pts[-1], val[-1] = (far, ff) if ff < fa else (away, fa)
        elif fa < val[-2]:
            pts[-1], val[-1] = away, fa
        else:
            near = mid + 0.5 * ((away if fa < val[-1] else pts[-1]) - mid)
            fn = f(near)
            if fn < min(fa, val[-1]):
                pts[-1], val[-1] = near, fn
            else:
                pts = [pts[0], *[pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]]
                val = [val[0], *[f(p) for p in pts[1:]]]
    return pts[int(np.argmin(val))]


def _own_histogram(values: DataFrame, column: str, bins: int, by: list[str]) -> DataFrame:
    """Counts by bin between the least and greatest value of each group, whose ends, size, mean and spread come along."""
    ends = values.groupBy(*by).agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n_all"), F.avg(column).alias("mu"), F.stddev_pop(column).alias("sd"))
    at = F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    in_bin = F.when(F.col("hi") > F.col("lo"), F.least(at, F.lit(bins - 1))).otherwise(0).cast("int")
    return values.join(ends, by).groupBy(*by, "lo", "hi", "n_all", "mu", "sd", in_bin.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _density(g: pd.DataFrame, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Middles of bins and the density there."""
    lo, hi = float(g.lo.iloc[0]), float(g.hi.iloc[0])
    width = max(hi - lo, 1e-12) / bins
    y = np.zeros(bins)
    y[g.bin.to_numpy()] = g.n.to_numpy() / (g.n.sum() * width)
    return lo + (np.arange(bins) + 0.5) * width, y


def ratio_histogram_fit(runs: DataFrame, bins: int = 100, top: float = 10.0, least: int = 10) -> DataFrame:
    """H and amplitude of the Cauchy law nearest (by absolute differences) to the density of ratios within top, by state.

    States with fewer than `least` such ratios have null.
    """
    hist = _own_histogram(T.ratios_1d(runs).where(F.abs("r") < top), "r", bins, ["state"])

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        n = int(g.n.sum())
        h = a = float("nan")
        if n >= least:
            mid, y = _density(g, bins)

            def loss(p: np.ndarray) -> float:
                if not 0 < p[0] < 1:
                    return math.inf
                loc = 2 ** (2 * p[0] - 1) - 1
                s = math.sqrt(1 - loc * loc)
                return float(np.abs(y - p[1] / (np.pi * s * (1 + ((mid - loc) / s) ** 2))).sum())

            h, a = nelder_mead(loss, [0.5, 1.0])
            h, a = float(np.clip(h, 0.01, 0.99)), max(float(a), 0.01)
        return pd.DataFrame({"state": [int(g.state.iloc[0])], "h": [h], "alpha": [a], "n": [n]})

    return hist.groupBy("state").applyInPandas(fit, "state int, h double, alpha double, n bigint")


def displacement_histogram_fit(runs: DataFrame, bins: int = 80, least: int = 10) -> DataFrame:
    """Mean, spread and amplitude of the normal law nearest (by absolute differences) to the density of each axis, by state."""
    hist = _own_histogram(T.displacements_1d(runs), "d", bins, ["state", "axis"])

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        mu = sigma = a = float("nan")
        if g.n.sum() >= least:
            mid, y = _density(g, bins)

            def loss(p: np.ndarray) -> float:
                return float(np.abs(y - p[2] / (p[1] * math.sqrt(2 * math.pi)) * np.exp(-0.5 * ((mid - p[0]) / p[1]) ** 2)).sum()) if p[1] > 0 else math.inf

            mu, sigma, a = nelder_mead(loss, [float(g.mu.iloc[0]), max(float(g.sd.iloc[0]), 1e-6), 1.0])
            mu, sigma, a = float(mu), max(float(sigma), 1e-8), max(float(a), 0.01)
        return pd.DataFrame({"state": [int(g.state.iloc[0])], "axis": [g.axis.iloc[0]], "mu": [mu], "sigma": [sigma], "alpha": [a], "n": [int(g.n.sum())]})

    return hist.groupBy("state", "axis").applyInPandas(fit, "state int, axis string, mu double, sigma double, alpha double, n bigint")


def mixture_1d(x: np.ndarray, weights: np.ndarray, k: int, steps: int = 200, tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Weights, means, variances and log likelihood of a normal mixture of a weighted sample, by EM."""
    q = (np.cumsum(weights) - weights / 2) / weights.sum()
    order = np.argsort(x, kind="stable")
    x, weights = x[order], weights[order]
    q = (np.cumsum(weights) - weights / 2) / weights.sum()
    mean = np.interp((np.arange(k) + 0.5) / k, q, x)
    total = weights.sum()
    var = np.full(k, max((weights * (x - (weights * x).sum() / total) ** 2).sum() / total, 1e-6))
    share, last = np.full(k, 1 / k), -np.inf
    for _ in range(steps):
        log = np.log(share) - 0.5 * np.log(2 * np.pi * var) - (x[:, None] - mean) ** 2 / (2 * var)
        top = log.max(1, keepdims=True)
        norm = top[:, 0] + np.log(np.exp(log - top).sum(1))
        ll = float((weights * norm).sum())
        resp = np.exp(log - norm[:, None]) * weights[:, None]
        n = resp.sum(0) + 1e-12
        share, mean = n / n.sum(), (resp * x[:, None]).sum(0) / n
        var = (resp * (x[:, None] - mean) ** 2).sum(0) / n + 1e-6
        if ll - last < tol * total:
            break
        last = ll
    return share, mean, var, ll
