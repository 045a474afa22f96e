"""Effective sample sizes of the Cauchy estimator from tabulated covariances of its scores."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotloom.operators.diffusion import _rho

#: Exponents with a table of covariances.
GRID = (0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875)
NAMES = ("u", "S_rr", "S_gg", "S_rg")


def table_name(h: float) -> str:
    """The tag of the nearest table: thousandths, four digits."""
    return f"H{round(min(GRID, key=lambda g: abs(g - h)) * 1000):04d}"


def read_table(npz: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(npz)) as z:
        return {n: z[n] for n in NAMES}


def _slope(h: float, d: float, r: float, k: float, sigma: float, step: float = 1e-5) -> float:
    return float((_rho(h + step, d, r, k, sigma) - _rho(h - step, d, r, k, sigma)) / (2 * step))


def score_covariance(lag: np.ndarray, table: dict[str, np.ndarray], h: float, d: float, r: float, k: float, sigma: float) -> tuple[np.ndarray, float]:
    """Covariance of scores of H of ratios `lag` strides apart (0 past the table), and the information of one ratio."""
    rho, slope = float(_rho(h, d, r, k, sigma)), _slope(h, d, r, k, sigma)
    g2 = 1 - rho * rho
    turn = -rho * slope / np.sqrt(max(g2, 1e-14))
    rr, gg, rg = (np.interp(lag, table["u"], table[n], right=0.0) for n in NAMES[1:])
    return slope**2 * rr + turn**2 * gg + slope * turn * rg, slope**2 / (2 * g2 * g2)


def n_eff(traces: DataFrame, table: dict[str, np.ndarray], h: float, delta: int, r: float = 0.0, k: float = 1.0, sigma: float = 0.0, by: str = "state") -> DataFrame:
    """How many independent ratios of a stride the trajectories of each group are worth.

    Trajectories enter by their length only, so a row for each length and group reaches the sums; a length's sum over
    lags is read off two running sums of the covariance.
    """
    sizes = traces.groupBy("video", "traj_idx", by).agg(F.count(F.lit(1)).alias("t")).where(F.col("t") > 2 * delta)
    hist = sizes.groupBy(by, "t").agg(F.count(F.lit(1)).alias("n"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        m = g.t.to_numpy() - 2 * delta
        s = np.arange(1, m.max() + 1)
        c, info = score_covariance(s / delta, table, h, delta, r, k, sigma)
        flat, ramp = np.append(0.0, np.cumsum(c)), np.append(0.0, np.cumsum(s * c))
        one = m * info + 2 * (m * flat[m - 1] - ramp[m - 1])
        total, spread = float((2 * g.n * m).sum()), float((2 * g.n * one).sum())
        return pd.DataFrame({by: [g[by].iloc[0]], "n_ratios": [int(total)], "n_eff": [total**2 * info / spread if spread > 0 else float("nan")]})

    return hist.groupBy(by).applyInPandas(run, f"{by} int, n_ratios bigint, n_eff double")
