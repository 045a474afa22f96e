"""The scalar helpers as SQL functions of a session, each an expression that Catalyst sees into."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, parameters and expression; all are doubles.
HELPERS = {
    "spot_distance": ("x1 double, y1 double, x2 double, y2 double", "sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))"),
    "spot_polar": ("ux double, uy double, vx double, vy double", "pmod(degrees(atan2(ux * vy - uy * vx, ux * vx + uy * vy)), 360)"),
    "ratio_location": ("h double", "pow(2, 2 * h - 1) - 1"),
    "ratio_scale": ("rho double", "sqrt(1 - rho * rho)"),
    "ratio_log_density": ("ratio double, rho double", "0.5 * ln(1 - rho * rho) - ln(pi()) - ln((ratio - rho) * (ratio - rho) + 1 - rho * rho)"),
    "thompson_error": ("s double, pixel double, photons double, background double", "sqrt((s * s + pixel * pixel / 12) / photons + 8 * pi() * pow(s, 4) * background * background / (pixel * pixel * photons * photons))"),
    "nearest_half": ("v double", "rint(v)"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the helpers known to spark.sql and F.expr; returns their names."""
    for name, (parameters, expression) in HELPERS.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns double return {expression}")
    return list(HELPERS)
