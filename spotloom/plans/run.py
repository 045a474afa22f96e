"""From files to tracks and statistics: reading, locating, tracking, estimates, and the files that are written.

Each step is a table that the next one reads; a file that can't be read is an entry in the error log and stops nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotloom import schemas
from spotloom.functions import lookup
from spotloom.operators import diffusion, estimators, features, forecast, graph, linking, localize, mixtures, postprocess
from spotloom.operators import trajectory as T
from spotloom.schemas import TRAJ
from spotloom.sources import stacks, tables
from spotloom.streaming import progress

#: Columns of a file of spots, and the folder's.
LOC_FILE = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in [*(f for f in schemas.LOC if f.name not in ("video", "spot_idx")), schemas.LOC[0]])
#: What a caller is told: the share of the work that is done, in percent, and what comes next.
Progress = Callable[[int, str], None]


@dataclass(frozen=True)
class Options:
    """Options of locating and tracking. jump None: from the data; alpha and k: networks, or None for free motion."""

    window: int = 7
    threshold: float = 1.0
    shift: int = 1
    deflations: int = 0
    depth: int = 3
    cutoff: int = 3
    jump: float | None = None
    post_process: bool = False
    alternatives: int | None = None
    alpha: Callable[[], dict] | None = None
    k: lookup.Affine | None = None
    progress: Progress = field(default=lambda percent, label: None)


def locate(frames: DataFrame, options: Options) -> DataFrame:
    """Spots of all pictures that could be read."""
    return localize.localize(frames.where("error is null") if "error" in frames.columns else frames, localize.Options(options.window, options.threshold, options.shift, options.deflations))


def jump_limit(loc: DataFrame, options: Options) -> float:
    """The jump that is given, or that the displacements of nearest spots suggest."""
    if options.jump:
        return options.jump
    jumps = graph.cut_lineage(linking.greedy_matches_with_parts(loc).select("dx", "dy"))
    return mixtures.gmm_jump_threshold(graph.cut_lineage(mixtures.trim_jumps(jumps)))


def track(loc: DataFrame, options: Options) -> DataFrame:
    """Trajectories; with post_process, those that hop between places are cut and numbered anew."""
    traces = graph.cut_lineage(forecast.track(loc, jump_limit(loc, options), options.depth, options.cutoff, alternatives=options.alternatives))
    if not options.post_process:
        return traces
    parts = postprocess.split_hops(graph.cut_lineage(postprocess.place_labels(traces))).drop("place")
    names = linking.numbered(parts.select(*TRAJ, "part").distinct().withColumn("_key", F.struct("traj_idx", "part")), "video", "_key", "_new")
    named = parts.join(names.select(*TRAJ, "part", "_new"), [*TRAJ, "part"])
    return named.withColumn("traj_idx", F.col("_new")).select(*traces.columns)


def diffusion_of(traces: DataFrame, options: Options) -> DataFrame:
    """H and K of each trajectory, by the networks that are given: H a half without one, K the mean step's without one."""
    k = features.k_feature(traces)
    log_k = lookup.k_of(F.col("k_feature"), F.col("n"), options.k) if options.k else F.col("k_feature")
    k = k.select(*TRAJ, F.pow(F.lit(10.0), log_k).alias("K"))
    if options.alpha is None:
        return k.withColumn("H", F.lit(0.5)).select(*TRAJ, "H", "K")
    return lookup.predict_exponents(traces, options.alpha).select(*TRAJ, "H").join(k, TRAJ)


def run(spark: SparkSession, path: str, out: str, options: Options | None = None) -> dict[str, DataFrame]:
    """Everything from the pictures under a path to files under out: loc, traces, diffusion, and errors of files."""
    options = options or Options()
    step = lambda low, high, label: progress.between(spark, options.progress, low, high, label)
    with step(0, 10, "reading"):
        frames = stacks.read_images(spark, path)
        tables.write_errors(frames, f"{out}/errors")
    with step(10, 50, "locating"):
        tables.write_localizations(locate(frames, options), f"{out}/loc")
        loc = read_written(spark, f"{out}/loc")
    with step(50, 80, "tracking"):
        traces = track(loc, options)
        tables.write_traces(traces, f"{out}/traces")
    with step(80, 100, "estimates"):
        found = diffusion_of(traces, options)
        tables.write_csv(found.select("video", "traj_idx", "H", "K"), f"{out}/diffusion", "video")
    options.progress(100, "done")
    return {"loc": loc, "traces": traces, "diffusion": found}


def read_written(spark: SparkSession, path: str) -> DataFrame:
    """Spots that were written in folders by video."""
    loc = spark.read.option("header", True).option("nanValue", "nan").schema(LOC_FILE).csv(path)
    spots = F.row_number().over(Window.partitionBy("video", "frame").orderBy("x", "y")) - 1
    return schemas.conform(loc.withColumn("spot_idx", spots), schemas.LOC)


def statistics(traces: DataFrame, sigma: float, r: float = 0.0, cutoff: int = 3) -> dict[str, DataFrame | dict]:
    """Advanced statistics by state, of trajectories of at least cutoff points.

    Curves and fits of all states; and for states with five trajectories whose K is above the least that a fit can
    give, the signal over noise, K, and the scan over strides with what follows from it. All states are fitted at once; a
    row a state comes to the driver, its K.
    """
    kept = T.min_points(traces, cutoff)
    runs = T.state_runs(kept)
    own = kept.withColumn("video", F.concat_ws("#", "video", "state"))  # what a trajectory does in a state is one of its own
    many = own.groupBy("state").agg(F.countDistinct(*TRAJ).alias("n")).where("n >= 5")
    ks = graph.cut_lineage(estimators.fit_k_by_state(own, sigma, r).join(many, "state", "left_semi").where("K > 1.01e-4"))
    out: dict = {
        "time_averaged": T.ta_ea_sd(runs), "displacements": estimators.displacement_histogram_fit(runs), "ratios": estimators.ratio_histogram_fit(runs), "snr": diffusion.snr_by_state(kept, sigma),
        "k": {x.state: x.K for x in ks.collect()}, "scan": None,
    }
    if out["k"]:
        out["scan"] = scan = graph.cut_lineage(estimators.scan_by_state(own, ks, sigma, r))
        plain = scan.where("converged and H_std > 0").select("state", "delta", F.col("H_estim").alias("h"), F.col("H_std").alias("se"))
        out["pairs"] = diffusion.z_pairs(plain)
        out["significance"] = diffusion.z_summary(out["pairs"])
        out["drift"] = diffusion.delta_drift(plain)
    return out
