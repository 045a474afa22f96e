"""Expressions for displacements and angles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(*parts: Column) -> Column:
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)


def rounded(length: Column, places: int) -> Column:
    """A number of no less than 0, rounded half up as doubles are; F.round goes through decimal digits, at many times the cost."""
    unit = float(10**places)
    scaled = length * unit
    low = F.floor(scaled).cast("double")
    up = F.when(scaled - low >= 0.5, 1.0).otherwise(0.0)
    return F.when(scaled < float(1 << 52), (low + up) / unit).otherwise(length)  # of larger ones and NaN nothing is to be rounded


def deflection(ux: str, uy: str, vx: str, vy: str) -> Column:
    """180 minus the angle between u and v in degrees; a zero vector gives 90."""
    u, v = norm(F.col(ux), F.col(uy)), norm(F.col(vx), F.col(vy))
    cos = F.coalesce(F.try_divide(F.col(ux), u), F.lit(0.0)) * F.coalesce(F.try_divide(F.col(vx), v), F.lit(0.0)) + F.coalesce(F.try_divide(F.col(uy), u), F.lit(0.0)) * F.coalesce(F.try_divide(F.col(vy), v), F.lit(0.0))
    return F.coalesce(180 - F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))), F.lit(0.0))


def polar(ux: str, uy: str, vx: str, vy: str) -> Column:
    """The signed turn from u to v, from 0 to 360 degrees."""
    cross = F.col(ux) * F.col(vy) - F.col(uy) * F.col(vx)
    dot = F.col(ux) * F.col(vx) + F.col(uy) * F.col(vy)
    a = F.degrees(F.atan2(cross, dot))
    return ((a % 360) + 360) % 360


def rotate(x: Column, y: Column, cx: Column, cy: Column, degrees: Column) -> tuple[Column, Column]:
    """x, y in the axes of a shape about (cx, cy) that is turned by an angle."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    dx, dy = x - cx, y - cy
    return dx * c + dy * s, dy * c - dx * s
