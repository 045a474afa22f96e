"""Features of trajectories for predictors, lookups, matches between tables, and densities of H and K."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotloom.functions.geometry import norm
from spotloom.operators.trajectory import by_frame
from spotloom.schemas import TRAJ


def sliding_windows(traces: DataFrame, m: int) -> DataFrame:
    """Each run of m successive points of a trajectory: start (position from 0), xs and ys."""
    w = by_frame().rowsBetween(0, m - 1)
    out = traces.select(*TRAJ, (F.row_number().over(by_frame()) - 1).alias("start"), F.collect_list("x").over(w).alias("xs"), F.collect_list("y").over(w).alias("ys"))
    return out.where(F.size("xs") == m)


def signal(traces: DataFrame) -> DataFrame:
    """By point and axis: distance from the first point, shift from it, and summed steps, each scaled and over the length.

    The first two are divided by the mean step, the last by the axis's standard deviation (1e-10 at least).
    """
    every = Window.partitionBy(*TRAJ)
    step = norm(*[F.col(c) - F.lag(c).over(by_frame()) for c in "xy"])
    base = traces.select(*TRAJ, "frame", "x", "y", step.alias("step"), F.first("x").over(by_frame()).alias("x0"), F.first("y").over(by_frame()).alias("y0"))
    base = base.withColumn("n", F.count(F.lit(1)).over(every)).withColumn("mean", F.greatest(F.avg("step").over(every), F.lit(1e-10)))
    for c in "xy":
        sd = F.greatest(F.stddev_pop(c).over(every), F.lit(1e-10))
        base = base.withColumn(f"d{c}", F.coalesce(F.abs(F.col(c) - F.lag(c).over(by_frame())), F.lit(0.0)) / sd)
    run = by_frame().rowsBetween(Window.unboundedPreceding, 0)
    rad = norm(F.col("x") - F.col("x0"), F.col("y") - F.col("y0")) / F.col("mean") / F.col("n")
    base = base.withColumn("sx", F.sum("dx").over(run)).withColumn("sy", F.sum("dy").over(run))
    axis = lambda c: F.struct(F.lit(c).alias("axis"), rad.alias("radius"), ((F.col(c) - F.col(f"{c}0")) / F.col("mean") / F.col("n")).alias("shift"), (F.col(f"s{c}") / F.col("n")).alias("path"))
    return base.where("n >= 3").select(*TRAJ, "frame", F.explode(F.array(axis("x"), axis("y"))).alias("p")).select(*TRAJ, "frame", "p.*")


def model_length(n: Column) -> Column:
    """Which of the window lengths 3, 5 and 8 a trajectory of n points is predicted with."""
    return F.when(n.isin(3, 4), 3).when(n.between(5, 7), 5).when(n.between(8, 8191), 8).otherwise(5)


def normal_unbiased_quantile(values: Column, q: float) -> Column:
    """The quantile of a sorted array at place 0.375 + q (n + 0.25) - 1, linear between its neighbours."""
    n = F.size(values)
    at = F.greatest(F.lit(0.0), F.least(n - 1.0, 0.375 + q * (n + 0.25) - 1))
    low = F.floor(at).cast("int")
    a, b = F.element_at(values, low + 1), F.element_at(values, F.least(low + 2, n))
    return a + (b - a) * (at - low)


def k_feature(traces: DataFrame) -> DataFrame:
    """log10 of a trajectory's mean step, or from ten points of the mean of its quartiles; half where there is none."""
    step = norm(*[F.col(c) - F.lag(c).over(by_frame()) for c in "xy"])
    g = traces.select(*TRAJ, step.alias("s")).groupBy(*TRAJ).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("s")).alias("v"), F.avg("s").alias("mean"))
    mid = (normal_unbiased_quantile(F.col("v"), 0.25) + normal_unbiased_quantile(F.col("v"), 0.75)) / 2
    value = F.when(F.col("n") < 10, F.col("mean")).otherwise(mid)
    return g.select(*TRAJ, "n", F.when(value > 0, F.log10(value)).otherwise(0.5).alias("k_feature"))


def recent(traces: DataFrame, n: int = 10) -> DataFrame:
    """The last n points of each trajectory."""
    back = F.row_number().over(Window.partitionBy(*TRAJ).orderBy(F.desc("frame")))
    return traces.withColumn("_b", back).where(F.col("_b") <= n).drop("_b")


def folds(traces: DataFrame, k: int = 5) -> DataFrame:
    """Contiguous folds of each trajectory's points."""
    return traces.withColumn("fold", F.ntile(k).over(by_frame()) - 1)


def match_spots(traces: DataFrame, loc: DataFrame, digits: int = 3, least: int = 10, share: float = 0.5) -> DataFrame:
    """The spots that are points of trajectories, by frame and rounded place, for videos where enough are found."""
    key = lambda df: df.select("video", "frame", F.round("x", digits).alias("_x"), F.round("y", digits).alias("_y"))
    spots = loc.withColumn("_x", F.round("x", digits)).withColumn("_y", F.round("y", digits))
    found = spots.join(key(traces).distinct(), ["video", "frame", "_x", "_y"], "left_semi").drop("_x", "_y")
    size = loc.groupBy("video").agg(F.count(F.lit(1)).alias("n"))
    good = found.groupBy("video").agg(F.count(F.lit(1)).alias("m")).join(size, "video").where(F.col("m") >= F.greatest(F.lit(float(least)), share * F.col("n")))
    return found.join(good.select("video"), "video", "left_semi")


def nearest_grid(h: Column, grid: tuple[float, ...] = (0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875)) -> Column:
    """The value of a small grid nearest to h, the lower of two."""
    g = F.array(*[F.lit(x) for x in grid])
    return F.array_min(F.transform(g, lambda x: F.struct(F.abs(x - h).alias("d"), x.alias("x"))))["x"]


def runs_of(flags: DataFrame, by: list[str], order: str, flag: str) -> DataFrame:
    """First and last place of each run of true flags."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = flags.withColumn("_r", F.row_number().over(w)).where(F.col(flag))
    island = F.col("_r") - F.row_number().over(w)
    return rows.withColumn("_i", island).groupBy(*by, "_i").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("_i")


#: Bandwidths beyond which a point adds nothing to a density; a hair less, so that ends fall on the same side everywhere.
SUPPORT = 4 - 1e-9


def kde_hk(points: DataFrame, cells: int = 200) -> DataFrame:
    """An unnormalised density of H and log10 K on a grid over their range widened by four bandwidths (Scott's).

    A point adds to the places within four bandwidths alone, so it meets no more of the grid than those; places that no
    point reaches are left out.
    """
    p = points.where("H is not null and K > 0").select("H", F.log10("K").alias("L"))
    ends = p.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}_{c}") for c in "HL" for n, f in (("lo", F.min), ("hi", F.max), ("sd", F.stddev_samp))])
    for c in "HL":
        ends = ends.withColumn(f"b_{c}", F.col(f"sd_{c}") * F.pow("n", F.lit(-1 / 6)))
        ends = ends.withColumn(f"from_{c}", F.col(f"lo_{c}") - 4 * F.col(f"b_{c}")).withColumn(f"step_{c}", (F.col(f"hi_{c}") - F.col(f"lo_{c}") + 8 * F.col(f"b_{c}")) / (cells - 1))
    near = p.join(F.broadcast(ends)).where("b_H > 0 and b_L > 0")  # one row
    for c, k in (("H", "i"), ("L", "j")):
        place = lambda off: (F.col(c) + off * F.col(f"b_{c}") - F.col(f"from_{c}")) / F.col(f"step_{c}")  # noqa: E731, B023
        reach = F.sequence(F.greatest(F.floor(place(-4)), F.lit(0)), F.least(F.ceil(place(4)), F.lit(cells - 1)))
        z = (F.col(f"from_{c}") + F.col(k) * F.col(f"step_{c}") - F.col(c)) / F.col(f"b_{c}")
        near = near.withColumn(k, F.explode(reach)).withColumn(f"z_{c}", z).where(F.abs(f"z_{c}") < SUPPORT)
    return near.groupBy(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j")).agg(F.sum(F.exp(-0.5 * (F.col("z_H") ** 2 + F.col("z_L") ** 2))).alias("density"))
