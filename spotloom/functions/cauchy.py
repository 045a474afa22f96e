"""The displacement-ratio model as expressions: fractional motion seen through exposure and localization noise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def j_var(h: Column | float, delta: Column | float, r: float) -> Column:
    """Variance of a displacement over delta frames, in units of K, at exposure share r."""
    h, d = _c(h), _c(delta)
    if r <= 1e-9:
        return F.pow(d, 2 * h)
    a = 2 * h + 2
    return (F.pow(d + r, a) + F.pow(F.abs(d - r), a) - 2 * F.pow(d, a) - 2 * F.pow(F.lit(r), a)) / (r * r * (2 * h + 1) * (2 * h + 2))


def j_cov(h: Column | float, delta: Column | float, r: float) -> Column:
    """Twice the covariance of two successive displacements, likewise."""
    h, d = _c(h), _c(delta)
    if r <= 1e-9:
        return F.pow(d, 2 * h) * (F.pow(F.lit(2.0), 2 * h) - 2)
    a = 2 * h + 2
    two = F.pow(2 * d + r, a) + F.pow(F.abs(2 * d - r), a) - 2 * F.pow(2 * d, a)
    one = F.pow(d + r, a) + F.pow(F.abs(d - r), a) - 2 * F.pow(d, a)
    return (two - 2 * one + 2 * F.pow(F.lit(r), a)) / (r * r * (2 * h + 1) * (2 * h + 2))


def rho(h: Column | float, delta: Column | float, r: float, k: float, sigma: float) -> Column:
    """The location of the ratios' Cauchy law."""
    s2 = sigma * sigma
    return (k * j_cov(h, delta, r) - s2) / (2 * (k * j_var(h, delta, r) + s2))


def rho_free(h: Column | float) -> Column:
    """The location without noise and exposure: 2^(2H-1) - 1."""
    return F.pow(F.lit(2.0), 2 * _c(h) - 1) - 1


def gamma(rho_: Column) -> Column:
    return F.sqrt(1 - rho_ * rho_)


def drho_dh(h: Column, delta: Column | float, r: float, k: float, sigma: float, step: float = 1e-5) -> Column:
    return (rho(h + step, delta, r, k, sigma) - rho(h - step, delta, r, k, sigma)) / (2 * step)


def fisher_h(h: Column, delta: Column | float, r: float, k: float, sigma: float) -> Column:
    """Information on H in one ratio."""
    p, slope = rho(h, delta, r, k, sigma), drho_dh(h, delta, r, k, sigma)
    return slope * slope / (2 * (1 - p * p) * (1 - p * p))


def sigma_crlb(fisher: Column, n: Column | float) -> Column:
    return 1 / F.sqrt(fisher * n)


def n_eff_from_variance(variance: Column, h: Column, delta: Column | float, r: float, k: float, sigma: float) -> Column:
    """How many independent ratios an estimate of H with this variance is worth; null without variance or information."""
    info = fisher_h(h, delta, r, k, sigma)
    return F.when((variance > 0) & (info > 0), 1 / (variance * info))


def log_density(ratio: Column, rho_: Column) -> Column:
    """Log density of a ratio under a Cauchy law of location rho and scale sqrt(1 - rho^2)."""
    g2 = 1 - rho_ * rho_
    return 0.5 * F.log(g2) - math.log(math.pi) - F.log((ratio - rho_) * (ratio - rho_) + g2)


def cauchy_pdf(x: Column, location: Column | float, scale: Column | float) -> Column:
    z = (x - _c(location)) / _c(scale)
    return 1 / (math.pi * _c(scale) * (1 + z * z))


def gaussian_pdf(x: Column, mean: Column | float, sigma: Column | float) -> Column:
    z = (x - _c(mean)) / _c(sigma)
    return F.exp(-0.5 * z * z) / (_c(sigma) * math.sqrt(2 * math.pi))


def thompson(s: float, pixel: float, photons: Column, background: float) -> Column:
    """Localization error by the photon count."""
    return F.sqrt((s * s + pixel * pixel / 12) / photons + 8 * math.pi * s**4 * background**2 / (pixel * pixel * photons * photons))
