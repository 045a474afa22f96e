"""Trajectory analytics: runs, steps, angles, ratios, displacement curves, summaries and histograms.

All windows are partitioned by trajectory; what is ordered globally has been aggregated first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from spotloom.functions import geometry as G
from spotloom.operators.linking import numbered
from spotloom.operators.quantiles import medians, quantiles
from spotloom.schemas import TRAJ

RUN = [*TRAJ, "run"]


def by_frame() -> WindowSpec:
    return Window.partitionBy(*TRAJ).orderBy("frame")


def by_run() -> WindowSpec:
    return Window.partitionBy(*RUN).orderBy("frame")


def state_runs(traces: DataFrame, cutoff_min: int = 1, cutoff_max: int = 1 << 30) -> DataFrame:
    """Adds run: a new one begins where the state changes, not at gaps. Runs outside the cutoffs go."""
    new = F.when(F.col("state") != F.lag("state").over(by_frame()), 1).otherwise(0)
    runs = traces.withColumn("_new", new).withColumn("run", F.sum("_new").over(by_frame().rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")
    if cutoff_min <= 1 and cutoff_max >= 1 << 30:
        return runs
    n = F.count(F.lit(1)).over(Window.partitionBy(*RUN))
    return runs.withColumn("_n", n).where(F.col("_n").between(cutoff_min, cutoff_max)).drop("_n")


def min_points(traces: DataFrame, cutoff: int = 3) -> DataFrame:
    """Trajectories of at least cutoff points."""
    return traces.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*TRAJ))).where(F.col("_n") >= cutoff).drop("_n")


def origin_shift(runs: DataFrame, pixel_um: float = 1.0, interval_s: float = 1.0) -> DataFrame:
    """Coordinates in µm from the run's first point, and time in seconds since it."""
    first = lambda c: F.first(c).over(by_run())
    return runs.select("*", ((F.col("x") - first("x")) * pixel_um).alias("rx"), ((F.col("y") - first("y")) * pixel_um).alias("ry"), ((F.col("frame") - first("frame")) * interval_s).alias("t"))


def steps(runs: DataFrame, pixel_um: float = 1.0) -> DataFrame:
    """Steps within runs: dframe, dx, dy and jump, in µm, at the later point."""
    d = lambda c: F.col(c) - F.lag(c).over(by_run())
    out = runs.select(*RUN, "state", "frame", d("frame").alias("dframe"), (d("x") * pixel_um).alias("dx"), (d("y") * pixel_um).alias("dy"))
    return out.where("dframe is not null").withColumn("jump", G.norm(F.col("dx"), F.col("dy")))


def kept_steps(runs: DataFrame, pixel_um: float = 1.0) -> DataFrame:
    """Steps between consecutive frames only."""
    return steps(runs, pixel_um).where("dframe = 1")


def step_pairs(runs: DataFrame, pixel_um: float = 1.0, strict_gaps: bool = False) -> DataFrame:
    """Kept steps with the kept step before them (pdx, pdy). With strict_gaps the two must share a point."""
    out = kept_steps(runs, pixel_um).select("*", F.lag("dx").over(by_run()).alias("pdx"), F.lag("dy").over(by_run()).alias("pdy"), F.lag("frame").over(by_run()).alias("pframe")).where("pdx is not null")
    return out.where("frame = pframe + 1") if strict_gaps else out


def angles(runs: DataFrame, strict_gaps: bool = False) -> DataFrame:
    """Deflection (180 is straight on) and polar angle (0 to 360) of successive steps."""
    p = step_pairs(runs, 1.0, strict_gaps)
    return p.select(*RUN, "state", "frame", G.deflection("pdx", "pdy", "dx", "dy").alias("angle"), G.polar("pdx", "pdy", "dx", "dy").alias("polar"))


def displacements_1d(runs: DataFrame, pixel_um: float = 1.0) -> DataFrame:
    s = kept_steps(runs, pixel_um)
    return s.select(*RUN, "state", "frame", F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.col("dx").alias("d")), F.struct(F.lit("y").alias("axis"), F.col("dy").alias("d")))).alias("p")).select(*RUN, "state", "frame", "p.axis", "p.d")


def ratios_1d(runs: DataFrame, strict_gaps: bool = False) -> DataFrame:
    """Ratios of successive one-dimensional steps; those over zero go."""
    p = step_pairs(runs, 1.0, strict_gaps)
    both = F.array(F.struct(F.lit("x").alias("axis"), F.try_divide("dx", "pdx").alias("r")), F.struct(F.lit("y").alias("axis"), F.try_divide("dy", "pdy").alias("r")))
    return p.select(*RUN, "state", "frame", F.explode(both).alias("p")).select(*RUN, "state", "frame", "p.axis", "p.r").where("r is not null and not isnan(r)")


def run_summary(runs: DataFrame, diffusion: DataFrame | None = None, pixel_um: float = 1.0, interval_s: float = 1.0) -> DataFrame:
    """A row for each run: mean jump between consecutive frames, duration, points and, with diffusion, H and K."""
    d = lambda c: F.col(c) - F.lag(c).over(by_run())
    one = runs.select(*RUN, "state", "frame", F.when(d("frame") == 1, G.norm(d("x"), d("y")) * pixel_um).alias("jump"))
    out = one.groupBy(*RUN, "state").agg(F.avg("jump").alias("mean_jump"), ((F.max("frame") - F.min("frame")) * interval_s).alias("duration"), F.count(F.lit(1)).alias("points"))
    if diffusion is None:
        return out
    return out.join(diffusion.select(*TRAJ, "H", "K"), TRAJ, "left")


def with_diffusion(traces: DataFrame, diffusion: DataFrame) -> DataFrame:
    """traces with H and K (null where unknown), z and state 0 where missing."""
    for c in ("z", "state"):
        traces = traces.withColumn(c, F.coalesce(c, F.lit(0)) if c in traces.columns else F.lit(0))
    return traces.join(diffusion.select(*TRAJ, "H", "K"), TRAJ, "left")


def state_summary(summary: DataFrame) -> DataFrame:
    """Counts, means and medians by video and state."""
    by = ["video", "state"]
    means = summary.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(n) for c, n in (("mean_jump", "mean_jump"), ("duration", "mean_duration"), ("H", "mean_h"), ("K", "mean_k"))])
    return means.join(medians(summary, by, "H", "K"), by, "left").select(*by, "n", "mean_jump", "mean_duration", "mean_h", "median_h", "mean_k", "median_k")


def population_share(summary: DataFrame) -> DataFrame:
    n = summary.groupBy("video", "state").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("video")))


def ea_sd(runs: DataFrame, pixel_um: float = 1.0, strict_gaps: bool = False) -> DataFrame:
    """Ensemble-averaged squared displacement over 4 by state and time.

    The t-th point stands for time t, if some point lies t frames after the first and t is before the last one.
    With strict_gaps a point stands for its own time.
    """
    r = origin_shift(runs, pixel_um).select(*RUN, "state", "t", ((F.col("rx") ** 2 + F.col("ry") ** 2) / 4).alias("sd"), (F.row_number().over(by_run()) - 1).alias("pos"), F.max("t").over(Window.partitionBy(*RUN)).alias("last"))
    if strict_gaps:
        pairs = r.select("state", F.col("t").cast("int").alias("t"), "sd")
    else:
        # A point stands for the time pos if some point of its run has that time: both meet on (run, time).
        times = r.select(*RUN, F.col("t").cast("int").alias("pos"))
        pairs = r.where(F.col("pos") < F.col("last")).join(times, [*RUN, "pos"], "left_semi").select("state", F.col("pos").alias("t"), "sd")
    return pairs.groupBy("state", "t").agg(F.avg("sd").alias("mean"), F.stddev_pop("sd").alias("std"), F.count(F.lit(1)).alias("n"))


def ta_ea_sd(runs: DataFrame, pixel_um: float = 1.0, max_lag: int | None = None) -> DataFrame:
    """Time-averaged, then ensemble-averaged squared displacement over 4 by state and lag.

    A pair of points counts if its lag in points is its lag in frames. Such points lie in one stretch without a gap, so
    the pairs are met by a join on (run, stretch), not on the run alone.
    """
    stretch = F.col("frame") - F.row_number().over(by_run())
    r = runs.select(*RUN, "state", "frame", stretch.alias("stretch"), "x", "y")
    b = r.select(*RUN, "stretch", F.col("frame").alias("f2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    p = r.join(b, [*RUN, "stretch"]).where("f2 > frame").select(*RUN, "state", (F.col("f2") - F.col("frame")).alias("lag"), ((((F.col("x2") - F.col("x")) ** 2 + (F.col("y2") - F.col("y")) ** 2)) * pixel_um**2 / 4).alias("sd"))
    if max_lag:
        p = p.where(F.col("lag") <= max_lag)
    each = p.groupBy(*RUN, "state", "lag").agg(F.avg("sd").alias("sd"))
    return each.groupBy("state", "lag").agg(F.avg("sd").alias("mean"), F.stddev_pop("sd").alias("std"), F.count(F.lit(1)).alias("n"))


def pooled_msd(traces: DataFrame, lags: int = 5, pixel_um: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of squared one-dimensional displacements at lags of 1 to `lags` points, x and y pooled, and its standard error.

    With by, a curve for each group; a point's displacements count to its own group.
    """
    at = lambda c, n: (F.lead(c, n).over(by_frame()) - F.col(c)) * pixel_um
    ahead = traces.select(*by, *[(at(c, n) ** 2).alias(f"{c}{n}") for n in range(1, lags + 1) for c in ("x", "y")])
    cells = F.array(*[F.struct(F.lit(n).alias("lag"), F.col(f"{c}{n}").alias("sd")) for n in range(1, lags + 1) for c in ("x", "y")])
    p = ahead.select(*by, F.explode(cells).alias("p")).select(*by, "p.lag", "p.sd").where("sd is not null")
    return p.groupBy(*by, "lag").agg(F.avg("sd").alias("msd"), (F.stddev_samp("sd") / F.sqrt(F.count(F.lit(1)))).alias("sem"), F.count(F.lit(1)).alias("n"))


def lag_pairs(traces: DataFrame, lags: int = 1, pixel_um: float = 1.0) -> DataFrame:
    """Displacements over 1 to `lags` points at the later one: dframe, dx, dy and jump, in µm, of trajectories of any length.

    Points are numbered over ranges and meet by number, so a trajectory that holds much of all rows is in no task whole, as
    it would be in a window.
    """
    keyed = traces.withColumn("_key", F.struct(*TRAJ))
    n = numbered(keyed.select("_key", *TRAJ, "state", "frame", "x", "y"), "_key", "frame", "_n")
    before = n.select("_key", F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag"), F.col("_n").alias("_from"), F.col("frame").alias("_f"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    d = lambda c, old: (F.col(c) - F.col(old)) * pixel_um
    both = n.join(before.withColumn("_n", F.col("_from") + F.col("lag")), ["_key", "_n"])
    return both.select(*TRAJ, "state", "frame", "lag", (F.col("frame") - F.col("_f")).alias("dframe"), d("x", "_x").alias("dx"), d("y", "_y").alias("dy")).withColumn("jump", G.norm(F.col("dx"), F.col("dy")))


def max_duration(traces: DataFrame) -> DataFrame:
    return traces.groupBy(*TRAJ).agg((F.max("frame") - F.min("frame")).alias("d")).agg(F.max("d").alias("max_duration"))


def centroids(traces: DataFrame) -> DataFrame:
    return traces.groupBy(*TRAJ).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("points"))


def state_rank(with_k: DataFrame) -> DataFrame:
    """New state numbers by ascending mean K."""
    means = with_k.groupBy("state").agg(F.avg("K").alias("mean_k"))
    return means.select("state", (F.dense_rank().over(Window.orderBy("mean_k")) - 1).alias("rank"), "mean_k")  # a row a state


def merge_offset(traces: DataFrame) -> DataFrame:
    """Trajectories of all videos under numbers of their own: those of a video follow those of the one before it."""
    most = traces.groupBy("video").agg((F.max("traj_idx") + 1).alias("size"))  # a row a video
    offset = F.coalesce(F.sum("size").over(Window.orderBy("video").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return traces.join(most.select("video", offset.alias("offset")), "video").withColumn("merged_idx", F.col("traj_idx") + F.col("offset")).drop("offset")


def histogram(values: DataFrame, column: str, bins: int, by: list[str] | None = None, density: bool = False, ends: tuple[float, float] | None = None) -> DataFrame:
    """Counts in equal bins, the last closed; share is percent of the group, or density.

    Groups share the bins, which reach from the least to the greatest value of all, so that none is left out; or over
    ends, where the scale is a closed one.
    """
    by = by or []
    v, lo, hi = F.col(column), F.col("_lo"), F.col("_hi")
    found = values.where(v.isNotNull() & ~F.isnan(v.cast("double")))
    row = found.agg(F.min(v).cast("double").alias("_lo"), F.max(v).cast("double").alias("_hi")) if ends is None else values.sparkSession.range(1).select(F.lit(ends[0]).alias("_lo"), F.lit(ends[1]).alias("_hi"))
    at = F.when(hi > lo, F.least(F.floor((v - lo) / ((hi - lo) / bins)), F.lit(bins - 1))).otherwise(0).cast("int")
    n = found.join(F.broadcast(row)).groupBy(*by, at.alias("bin"), "_lo", "_hi").agg(F.count(F.lit(1)).alias("n"))  # one row of ends
    total = F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))  # a row a bin
    share = F.col("n") / (total * ((hi - lo) / bins)) if density else 100 * F.col("n") / total
    return n.withColumn("share", share).drop("_lo", "_hi")


def geometric_histogram(values: DataFrame, column: str, bins: int, by: list[str]) -> DataFrame:
    """Percent by group in bins with shared geometric edges between the least and greatest positive value."""
    positive = values.where(F.col(column) > 0)
    ends = positive.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    at = F.least(F.floor(F.log(F.col(column) / F.col("lo")) / F.log(F.col("hi") / F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    n = positive.join(F.broadcast(ends)).groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def percentiles(values: DataFrame, column: str, *q: float) -> DataFrame:
    return quantiles(values, column, [], **{f"p{str(p).replace('.', '_')}": p for p in q})


def viz_value(summary: DataFrame, by_h: bool, least_points: int) -> Column:
    """What a trajectory is coloured by: H or log10 K, null for short ones."""
    v = F.col("H") if by_h else F.log10(F.greatest(F.col("K"), F.lit(1e-20)))
    return F.when(F.col("points") >= least_points, v)
