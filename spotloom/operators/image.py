"""Pictures as pixel tables: normalisation, background, detection scores, maxima, spot statistics and rasters.

Pixels are rows (video, frame, r, c, v). Neighbourhoods are met by offsets and equality joins or by windows over
rows of one picture, so work spreads over pictures and their size bounds every group.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FRAME = ["video", "frame"]
PIXEL = [*FRAME, "r", "c"]


def pixels(frames: DataFrame) -> DataFrame:
    p = frames.select(*FRAME, "width", F.posexplode("pixels").alias("pos", "v"))
    return p.select(*FRAME, F.floor(F.col("pos") / F.col("width")).cast("int").alias("r"), (F.col("pos") % F.col("width")).alias("c"), F.col("v").cast("double").alias("v"))


def normalise(px: DataFrame) -> DataFrame:
    """Values scaled to [0, 1] over the stack, then by the greatest of each frame; s_min and frame_max_raw undo it."""
    ends = px.groupBy("video").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    top = px.groupBy(*FRAME).agg(F.max("v").alias("top"))
    g = lambda c: F.when(F.col("hi") > F.col("lo"), (F.col(c) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.col(c))
    scale = top.join(ends, "video").select(*FRAME, "lo", "hi", g("top").alias("gtop"), F.col("top").alias("frame_max_raw"))
    both = px.join(scale, FRAME)
    return both.select(*PIXEL, F.when(F.col("gtop") > 0, g("v") / F.col("gtop")).otherwise(g("v")).alias("v"), F.col("lo").alias("s_min"), "frame_max_raw")


def quantised(norm: DataFrame) -> DataFrame:
    """Per cent of the frame's greatest value, truncated."""
    top = F.max("v").over(Window.partitionBy(*FRAME))
    return norm.select(*PIXEL, F.when(top > 0, F.floor(F.round(F.col("v") / top * 100, 9))).otherwise(0).cast("int").alias("ival"))


def background(norm: DataFrame, rounds: int = 3, clip: float = 3.0) -> DataFrame:
    """Mode and spread of each frame's background: histogram mode, then clipping at 3 deviations, three times.

    Each round is an aggregation of the frame's histogram of at most 101 bins, not of its pixels.
    """
    hist = quantised(norm).groupBy(*FRAME, "ival").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*FRAME)
    cur = hist.withColumn("on", F.lit(True))
    top = F.greatest(F.max("ival").over(w), F.lit(1))
    cur = cur.withColumn("bin", F.least("ival", top - 1))
    whole = lambda c, digits: c.cast(f"decimal({digits},0)")
    for _ in range(rounds):
        n, i = F.when(F.col("on"), F.col("n")).otherwise(0), F.col("ival").cast("bigint")
        cur = cur.withColumn("bn", F.sum(n).over(Window.partitionBy(*FRAME, "bin")))
        cur = cur.withColumn("mode", -F.max(F.struct(F.col("bn"), (-F.col("bin")).alias("b"))).over(w)["b"])
        total, first, second = whole(F.sum(n).over(w), 10), whole(F.sum(n * i).over(w), 12), whole(F.sum(n * i * i).over(w), 14)
        # Within clip deviations of the middle of the mode, squared and times (200 total)^2: whole numbers, so that a value just as far is never within.
        off = 2 * F.col("ival") - 2 * F.col("mode") - 1
        cur = cur.withColumn("on", total * total * whole(off * off, 6) < F.lit(Decimal((2 * clip) ** 2)) * (total * second - first * first))
    kept = cur.where("on")
    i = F.col("ival").cast("bigint")
    out = kept.groupBy(*FRAME).agg(F.sum("n").alias("n"), F.sum(F.col("n") * i).alias("s1"), F.sum(F.col("n") * i * i).alias("s2"))
    mean = F.col("s1") / F.col("n") / 100
    return out.withColumn("bg_mean", mean).withColumn("bg_std", F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") / 10000 - mean * mean)))


def threshold(bg: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Detection threshold: max(1, 2 sd^2 / mean^2) times alpha."""
    t = F.when((F.col("bg_std") > 0) & (F.col("bg_mean") != 0), F.greatest(F.lit(1.0), 2 * F.col("bg_std") ** 2 / F.col("bg_mean") ** 2)).otherwise(1.0)
    return bg.withColumn("threshold", t * alpha)


def gauss_psf(window: int, radius: float) -> list[tuple[int, int, float]]:
    """Offsets and values of a point spread function on a window, over sqrt(pi) radius."""
    half = window // 2
    return [(i, j, float(np.exp(-(i * i + j * j) / (2 * radius * radius)) / (np.sqrt(np.pi) * radius))) for i in range(-half, half + 1) for j in range(-half, half + 1)]


def _offsets(df: DataFrame, rows: list[tuple], names: str) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame(rows, names))  # as many rows as a window has pixels


def likelihood(norm: DataFrame, bg: DataFrame, window: int = 5, radius: float = 1.0) -> DataFrame:
    """The log likelihood ratio of a spot at each pixel whose window lies inside the picture."""
    psf = gauss_psf(window, radius)
    mean_g = sum(g for _, _, g in psf) / len(psf)
    big_g = sum((g - mean_g) ** 2 for _, _, g in psf)
    n = window * window
    offs = _offsets(norm, [(i, j, g - mean_g) for i, j, g in psf], "dr int, dc int, g double")
    near = norm.join(offs).select(*FRAME, (F.col("r") - F.col("dr")).alias("r"), (F.col("c") - F.col("dc")).alias("c"), "v", "g")
    sums = near.groupBy(*PIXEL).agg(F.sum(F.col("v") * F.col("g")).alias("vg"), F.count(F.lit(1)).alias("k")).where(F.col("k") == n)
    both = sums.join(bg.select(*FRAME, "bg_mean"), FRAME)
    proj = F.greatest(F.lit(0.0), F.col("vg") / big_g)
    denom = n * F.col("bg_mean") ** 2 - n * F.col("bg_mean")
    denom = F.when(F.abs(denom) < 1e-12, 1e-12).otherwise(denom)
    ratio = proj * proj * big_g / denom
    return both.select(*PIXEL, (n / 2 * F.log(1 - F.when(ratio >= 1, 1 - 1e-7).otherwise(ratio))).alias("score"))


def local_maxima(scores: DataFrame, k: int = 1, column: str = "score") -> DataFrame:
    """Pixels that are the greatest within k rows and columns: two passes of windows over places, one a direction."""
    across = F.max(column).over(Window.partitionBy(*FRAME, "r").orderBy("c").rangeBetween(-k, k))
    down = F.max("_m").over(Window.partitionBy(*FRAME, "c").orderBy("r").rangeBetween(-k, k))
    return scores.withColumn("_m", across).withColumn("_d", down).where(F.col(column) == F.col("_d")).drop("_m", "_d")


def suppress(peaks: DataFrame, k: int = 2) -> DataFrame:
    """Greedy non-maximum suppression by frame: highest score first, none within k before or k - 1 after it."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["frame", "score", "r", "c"], ascending=[True, False, True, True], kind="stable")
        taken: dict = {}
        keep = np.zeros(len(g), bool)
        for i, (frame, r, c) in enumerate(zip(g.frame, g.r, g.c, strict=True)):
            held = taken.setdefault(frame, [])
            if not any(a - k <= r < a + k and b - k <= c < b + k for a, b in held):
                held.append((r, c))
                keep[i] = True
        return g[keep]

    return peaks.groupBy("video", F.floor(F.col("frame") / 64)).applyInPandas(run, peaks.schema)


#: Rows and columns of a tile of pixels.
TILE = 32


def annulus_stats(px: DataFrame, spots: DataFrame, inner: float = 3.0, outer: int = 6, window: int = 7, least: int = 10, even: bool = False) -> DataFrame:
    """Median and variance of the pixels around each spot (r, c), and its flux above the median.

    Spots with a window_size have one of their own. Halves are rounded away from zero or, if even, to the even neighbour.
    A spot meets the pixels of its tile, to which those around the tile go too, and is summed up there: nothing that was
    met is shuffled.
    """
    near = F.rint if even else F.round
    half = F.floor(F.coalesce(F.col("window_size"), F.lit(window)) / 2) if "window_size" in spots.columns else F.lit(window // 2)
    tile = lambda c: F.floor((c + outer) / TILE)
    touched = lambda c: F.explode(F.sequence(tile(F.col(c) - outer), tile(F.col(c) + outer)))
    own = spots.select(*FRAME, "spot_idx", near("r").cast("int").alias("r0"), near("c").cast("int").alias("c0"), half.alias("half")).withColumn("tr", tile(F.col("r0"))).withColumn("tc", tile(F.col("c0")))
    spread = px.select(*PIXEL, "v").withColumn("tr", touched("r")).withColumn("tc", touched("c"))
    met = own.hint("merge").join(spread.hint("merge"), [*FRAME, "tr", "tc"])
    dr, dc = F.col("r") - F.col("r0"), F.col("c") - F.col("c0")
    far = F.greatest(F.abs(dr), F.abs(dc))
    met = met.where(far <= outer).withColumn("ring", dr * dr + dc * dc > inner * inner).withColumn("core", far <= F.col("half"))
    ring = F.when(F.col("ring"), F.col("v"))
    out = met.groupBy(*FRAME, "tr", "tc", "spot_idx").agg(F.median(ring).alias("bg_median"), F.var_pop(ring).alias("bg_var"), F.count(ring).alias("n"), F.sum(F.when(F.col("core"), F.col("v"))).alias("s"), F.count(F.when(F.col("core"), 1)).alias("m")).where(F.col("n") >= least)
    return out.select(*FRAME, "spot_idx", "bg_median", "bg_var", (F.col("s") - F.col("m") * F.col("bg_median")).alias("integrated_flux"))


def recomputed_background(frames: DataFrame, loc: DataFrame) -> DataFrame:
    """loc with bg_median, bg_var and integrated_flux from the raw pictures, without taking other spots out; null with too few pixels."""
    spots = loc.select(*FRAME, "spot_idx", F.col("y").alias("r"), F.col("x").alias("c"), "window_size")
    stats = annulus_stats(pixels(frames), spots, even=True)
    return loc.drop("bg_median", "bg_var", "integrated_flux").join(stats, [*FRAME, "spot_idx"], "left").select(*loc.columns)


def fit_gaussians(px: DataFrame, spots: DataFrame, window: int = 7, repeat: int = 5) -> DataFrame:
    """Iterated weighted least squares of log intensity on a quadratic around each spot: centre, variances, amplitude.

    Where a window reaches beyond the picture, the pixels that are there are fitted. All spots of a batch are solved
    together.
    """
    half = window // 2
    offs = _offsets(px, [(i, j) for i in range(-half, half + 1) for j in range(-half, half + 1)], "dr int, dc int")
    met = spots.select(*FRAME, "spot_idx", F.col("r").alias("r0"), F.col("c").alias("c0")).join(offs).withColumn("r", F.col("r0") + F.col("dr")).withColumn("c", F.col("c0") + F.col("dc")).join(px, PIXEL)
    place = (F.col("dr") + half) * window + F.col("dc") + half
    patch = met.groupBy(*FRAME, "spot_idx", "r0", "c0").agg(F.collect_list(place).alias("at"), F.collect_list("v").alias("v")).where(F.size("at") >= 6)

    def run(batches):
        from spotloom.operators.localize import fit

        for g in batches:
            patches = np.full((len(g), window * window), np.nan)
            for p, at, v in zip(patches, g["at"], g["v"], strict=True):
                p[np.asarray(at, int)] = v
            rows = []
            for i, got in enumerate(fit(patches.reshape(-1, window, window), 0.0, repeat) if len(g) else []):
                if got is not None:
                    mu, cov, amp = got
                    rho = cov[0, 1] / np.sqrt(cov[0, 0] * cov[1, 1])
                    rows.append((g.video[i], g.frame[i], g.spot_idx[i], g.c0[i] + mu[0], g.r0[i] + mu[1], cov[0, 0], cov[1, 1], rho, amp))
            yield pd.DataFrame(rows, columns=["video", "frame", "spot_idx", "x", "y", "xvar", "yvar", "rho", "norm_cst"])

    return patch.mapInPandas(run, "video string, frame int, spot_idx int, x double, y double, xvar double, yvar double, rho double, norm_cst double")


def density_raster(loc: DataFrame, cell: float, half: int = 1) -> DataFrame:
    """Spots spread by a small Gaussian over cells of a grid, summed by cell."""
    offs = _offsets(loc, [(i, j, float(np.exp(-(i * i + j * j) / 2))) for i in range(-half, half + 1) for j in range(-half, half + 1)], "dr int, dc int, g double")
    at = loc.groupBy("video", F.floor(F.col("y") / cell).alias("r"), F.floor(F.col("x") / cell).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return at.join(offs).groupBy("video", (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c")).agg(F.sum(F.col("n") * F.col("g")).alias("density"))


def kde_1d(values: DataFrame, column: str, points: int = 200) -> DataFrame:
    """A Gaussian kernel density at even places from the least to the greatest value, with Scott's bandwidth."""
    v = values.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    s = v.agg(F.stddev_samp("v").alias("sd"), F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("bw", F.col("sd") * F.pow("n", F.lit(-0.2)))
    # Each value is spread over a grid of fixed size; sums are made before anything is shuffled.
    each = v.join(F.broadcast(s)).withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))  # one row
    at = F.col("lo") + F.col("id") * ((F.col("hi") - F.col("lo")) / (points - 1))
    z = (at - F.col("v")) / F.col("bw")
    return each.groupBy("id", at.alias("at")).agg((F.sum(F.exp(-0.5 * z * z)) / F.first(F.col("n") * F.col("bw") * float(np.sqrt(2 * np.pi)))).alias("density"))
