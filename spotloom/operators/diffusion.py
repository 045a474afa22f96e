"""Noise-aware diffusion statistics: displacement ratios over strides, fits of H, significance and drift."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotloom.functions import cauchy as C
from spotloom.operators.trajectory import by_frame
from spotloom.schemas import TRAJ

#: Denominators this small give no ratio.
LEAST = 1e-15


def stride_ratios(traces: DataFrame, max_delta: int) -> DataFrame:
    """Ratios (x[i+2d] - x[i+d]) / (x[i+d] - x[i]) by position for strides d up to max_delta, x and y."""
    ahead = traces.select(*TRAJ, "state", *[(F.lead(c, n).over(by_frame()) if n else F.col(c)).alias(f"{c}{n}") for n in range(2 * max_delta + 1) for c in "xy"])
    cells = []
    for d in range(1, max_delta + 1):
        for c in "xy":
            den = F.col(f"{c}{d}") - F.col(f"{c}0")
            r = F.when(F.abs(den) > LEAST, F.try_divide(F.col(f"{c}{2 * d}") - F.col(f"{c}{d}"), den))
            cells.append(F.struct(F.lit(d).alias("delta"), F.lit(c).alias("axis"), r.alias("ratio")))
    return ahead.select(*TRAJ, "state", F.explode(F.array(*cells)).alias("p")).select(*TRAJ, "state", "p.*").where("ratio is not null")


def ratio_counts(traces: DataFrame, max_delta: int, by: tuple[str, ...] = ()) -> DataFrame:
    """How many ratios there are positions for, by stride (and group): from the lengths' histogram alone."""
    lengths = traces.groupBy(*TRAJ, *by).agg(F.count(F.lit(1)).alias("t")).groupBy("t", *by).agg(F.count(F.lit(1)).alias("m"))
    d = lengths.select("t", "m", *by, F.explode(F.sequence(F.lit(1), F.lit(max_delta))).alias("delta"))
    return d.groupBy(*by, "delta").agg(F.sum(2 * F.col("m") * F.greatest(F.col("t") - 2 * F.col("delta"), F.lit(0))).alias("n"))


def h_grid(ratios: DataFrame, r: float = 0.0, k: float = 1.0, sigma: float = 0.0, points: int = 49, most: int | None = None) -> DataFrame:
    """H of highest likelihood on a grid of (0.02, 0.98), by state and stride; at least five ratios.

    What depends on stride and H alone is found once for each, for strides up to `most` (those that occur, unless given),
    and equal ratios are counted first, so that a distinct ratio costs a logarithm for each H.
    """
    spark = ratios.sparkSession
    strides = ratios.select("delta").distinct() if most is None else spark.range(1, most + 1).select(F.col("id").cast("int").alias("delta"))
    grid = strides.crossJoin(F.broadcast(spark.range(points).select((F.lit(0.02) + F.col("id") * (0.96 / (points - 1))).alias("h"))))
    grid = grid.withColumn("rho", C.rho(F.col("h"), F.col("delta").cast("double"), r, k, sigma)).withColumn("g2", 1 - F.col("rho") * F.col("rho"))
    grid = grid.withColumn("head", 0.5 * F.log("g2") - math.log(math.pi))
    counted = ratios.groupBy("state", "delta", "ratio").agg(F.count(F.lit(1)).alias("m"))
    off = F.col("ratio") - F.col("rho")
    each = counted.join(F.broadcast(grid), "delta").withColumn("ll", F.col("m") * (F.col("head") - F.log(off * off + F.col("g2"))))
    total = each.groupBy("state", "delta", "h").agg(F.sum("ll").alias("ll"), F.sum("m").alias("n"))
    return total.groupBy("state", "delta").agg(F.max_by("h", "ll").alias("h"), F.max("ll").alias("ll"), F.max("n").alias("n")).where("n >= 5")


def _rho(h: np.ndarray | float, d: float, r: float, k: float, sigma: float) -> np.ndarray | float:
    if r <= 1e-9:
        jv = d ** (2 * h)
        jc = jv * (2.0 ** (2 * h) - 2)
    else:
        a = 2 * h + 2
        one = (d + r) ** a + abs(d - r) ** a - 2 * d**a
        two = (2 * d + r) ** a + abs(2 * d - r) ** a - 2 * (2 * d) ** a
        scale = r * r * (2 * h + 1) * (2 * h + 2)
        jv, jc = (one - 2 * r**a) / scale, (two - 2 * one + 2 * r**a) / scale
    return (k * jc - sigma**2) / (2 * (k * jv + sigma**2))


def golden(f, a: float, b: float, tol: float = 1e-7) -> float:
    """Where f is smallest between a and b, by golden section."""
    g = (5**0.5 - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    while b - a > tol:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    return (a + b) / 2


def invert_rho(target: float, d: float, r: float, k: float, sigma: float) -> float:
    """H whose location is target, by bisection; the nearer end if there is none."""
    lo, hi = 0.02, 0.98
    a, b = float(_rho(lo, d, r, k, sigma)) - target, float(_rho(hi, d, r, k, sigma)) - target
    if a * b > 0:
        return lo if abs(a) < abs(b) else hi
    for _ in range(60):
        mid = (lo + hi) / 2
        m = float(_rho(mid, d, r, k, sigma)) - target
        lo, hi, a = (mid, hi, m) if a * m > 0 else (lo, mid, a)
    return (lo + hi) / 2


def h_fit(ratios: DataFrame, r: float = 0.0, k: float = 1.0, sigma: float = 0.0, bins: int = 4001) -> DataFrame:
    """H by maximum likelihood with its standard error, by state and stride.

    Ratios enter as counts in fine bins of their arc tangent, so a group is at most `bins` rows however many it holds. A
    column k of the ratios, the same throughout a state, goes before the number.
    """
    at = F.floor((F.atan("ratio") / np.pi + 0.5) * bins).cast("int")
    with_k = ratios if "k" in ratios.columns else ratios.withColumn("k", F.lit(float(k)))
    n = with_k.groupBy("state", "delta", "k", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.atan("ratio")).alias("a"))

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        d, w, x, k = float(g.delta.iloc[0]), g.n.to_numpy(), np.tan(g.a.to_numpy()), float(g.k.iloc[0])
        total = int(w.sum())
        if total < 5:
            h = se = p = float("nan")
        else:

            def nll(h: float) -> float:
                q = _rho(h, d, r, k, sigma)
                g2 = max(1 - q * q, 1e-12)
                return -float((w * (0.5 * np.log(g2) - np.log((x - q) ** 2 + g2))).sum())

            h = golden(nll, 0.02, 0.98)
            p = float(_rho(h, d, r, k, sigma))
            slope = (float(_rho(h + 1e-5, d, r, k, sigma)) - float(_rho(h - 1e-5, d, r, k, sigma))) / 2e-5
            info = slope**2 / (2 * (1 - p * p) ** 2)
            se = 1 / np.sqrt(info * total) if info > 0 else float("nan")
        return pd.DataFrame({"state": [int(g.state.iloc[0])], "delta": [int(d)], "H_estim": [h], "H_std": [se], "rho": [p], "n_ratios": [total]})

    return n.groupBy("state", "delta").applyInPandas(fit, "state int, delta int, H_estim double, H_std double, rho double, n_ratios bigint")


def snr_by_state(traces: DataFrame, sigma: float) -> DataFrame:
    """Mean squared step of one frame, the floor that localization noise sets, and their ratio."""
    d = lambda c: F.pow(F.lead(c).over(by_frame()) - F.col(c), F.lit(2.0))
    one = traces.select("state", d("x").alias("x2"), d("y").alias("y2")).where("x2 is not null")
    out = one.groupBy("state").agg(((F.avg("x2") + F.avg("y2")) / 2).alias("msd1"))
    floor = 2 * sigma * sigma
    return out.select("state", "msd1", F.lit(floor).alias("floor"), (F.col("msd1") / floor).alias("snr"))


def grid_scan(traces: DataFrame, most: int = 75, least: int = 30, points: int = 49) -> DataFrame:
    """h, se and n by state and stride without noise: the likeliest of a grid, and the least error any estimate can have."""
    h = h_grid(stride_ratios(traces, most), points=points, most=most).where(F.col("n") >= least)
    return h.select("state", "delta", "h", C.sigma_crlb(C.fisher_h(F.col("h"), F.col("delta").cast("double"), 0.0, 1.0, 0.0), F.col("n")).alias("se"), "n")


def z_pairs(scan: DataFrame) -> DataFrame:
    """Differences of H between strides of a state, in standard errors, with the chance of as much. A state has tens of strides."""
    a = scan.select("state", F.col("delta").alias("d1"), F.col("h").alias("h1"), F.col("se").alias("s1"))
    b = scan.select("state", F.col("delta").alias("d2"), F.col("h").alias("h2"), F.col("se").alias("s2"))
    z = (F.col("h1") - F.col("h2")) / F.sqrt(F.col("s1") ** 2 + F.col("s2") ** 2)
    return a.join(b, "state").where("d1 < d2").select("state", "d1", "d2", z.alias("z")).withColumn("p", two_sided(F.col("z")))


#: Coefficients of a Chebyshev fit of the complementary error function, good to 1.2e-7 of its value everywhere.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def two_sided(z: Column) -> Column:
    """The chance that a standard normal number is as far from 0 as z."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    s = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        s = s * t + c
    return t * F.exp(s - x * x)


def z_summary(pairs: DataFrame, q: float = 0.05) -> DataFrame:
    """By state: pairs, those beyond 2 and 3 standard errors, the furthest, and those significant at a false discovery rate."""
    a = F.abs("z")
    tested = benjamini_hochberg(pairs, "p", ["state"], q)
    count = lambda c: F.sum(c.cast("bigint"))
    return tested.groupBy("state").agg(
        F.count(F.lit(1)).alias("pairs"), count(a > 2).alias("over2"), count(a > 3).alias("over3"), F.max_by("z", F.struct(a, -F.col("d1"), -F.col("d2"))).alias("max_z"), count(F.col("rejected")).alias("significant"), F.coalesce(F.max(F.when(F.col("rejected"), F.col("p"))), F.lit(0.0)).alias("p_cut")
    )


def benjamini_hochberg(tests: DataFrame, p_col: str, by: list[str], q: float = 0.05) -> DataFrame:
    """Adds rejected: whether a test is among those with p at most that of the last rank r with p <= q r / m."""
    w = Window.partitionBy(*by)
    ranked = tests.withColumn("_r", F.row_number().over(w.orderBy(p_col))).withColumn("_m", F.count(F.lit(1)).over(w))
    cut = F.max(F.when(F.col(p_col) <= q * F.col("_r") / F.col("_m"), F.col("_r"))).over(w)
    return ranked.withColumn("rejected", F.coalesce(F.col("_r") <= cut, F.lit(False))).drop("_r", "_m")


def delta_drift(scan: DataFrame) -> DataFrame:
    """Changes of H from a stride to the next, by state: the greatest in standard errors and where (the later stride), and how many exceed 2 and 3."""
    w = Window.partitionBy("state").orderBy("delta")
    before = lambda c: F.lag(c).over(w)
    step = scan.select("state", "delta", (F.col("h") - before("h")).alias("dh"), F.sqrt(before("se") ** 2 + F.col("se") ** 2).alias("floor")).where("dh is not null and floor > 0")
    step = step.withColumn("z", F.abs("dh") / F.col("floor"))
    first = F.struct("z", -F.col("delta"))
    return step.groupBy("state").agg(F.max("z").alias("max_z"), F.max_by("dh", first).alias("max_drift"), F.max_by("delta", first).alias("at_delta"), F.sum((F.col("z") > 2).cast("bigint")).alias("over2"), F.sum((F.col("z") > 3).cast("bigint")).alias("over3"), F.count(F.lit(1)).alias("n"))


def precision_map(hs: DataFrame, r: float, k: float, sigma: float, points: int = 120, low: float = 1.0, high: float = 5.0) -> DataFrame:
    """The error of H for rows (h, delta) at even powers of ten of independent ratios, from 10^low to 10^high."""
    n = F.pow(F.lit(10.0), F.lit(low) + F.col("i") * ((high - low) / (points - 1)))
    each = hs.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("n_eff", n)
    return each.withColumn("se", C.sigma_crlb(C.fisher_h(F.col("h"), F.col("delta").cast("double"), r, k, sigma), F.col("n_eff")))


def trusted_by_all(trusted: DataFrame) -> DataFrame:
    """Strides that are trusted in every state that has them."""
    return trusted.groupBy("delta").agg(F.every("trusted").alias("trusted"))


def trust(table: DataFrame, r: float, k: float, sigma: float, eps: float) -> DataFrame:
    """Whether both the standard error and the spread that noise causes are within eps, for rows (h, delta, n)."""
    d = F.col("delta").cast("double")
    slope = C.drho_dh(F.col("h"), d, r, k, sigma)
    step = 1e-6
    noise = (C.rho(F.col("h"), d, r, k, (sigma**2 + step) ** 0.5) - C.rho(F.col("h"), d, r, k, (sigma**2 - step) ** 0.5)) / (2 * step)
    out = table.withColumn("se", C.sigma_crlb(C.fisher_h(F.col("h"), d, r, k, sigma), F.col("n"))).withColumn("spread", F.abs(noise / slope) * sigma**2)
    return out.withColumn("trusted", (F.col("se") <= eps) & (F.col("spread") <= eps))
