"""Splitting trajectories that hop between places: clusters of each one's points, then cuts where the cluster changes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotloom.schemas import TRAJ

#: Centres nearer than this are one place; a video is cut if this share of its trajectories stays this close to them.
MERGE, CLOSE, SHARE = 1.5, 1.0, 0.8


def components_for(n: int) -> int:
    return 2 if n <= 10 else 3 if n < 100 else 4


def spherical_mixture(xy: np.ndarray, k: int, steps: int = 100, tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Labels and centres of a mixture of round normal clusters, by EM from points far from each other."""
    centres = [xy[0]]
    for _ in range(k - 1):
        d = np.min([((xy - c) ** 2).sum(1) for c in centres], 0)
        centres.append(xy[int(d.argmax())])
    mean, share = np.array(centres), np.full(k, 1 / k)
    var = np.full(k, max(xy.var(0).mean(), 1e-6))
    last = -np.inf
    for _ in range(steps):
        d2 = ((xy[:, None, :] - mean) ** 2).sum(2)
        log = np.log(share) - np.log(2 * np.pi * var) - d2 / (2 * var)
        top = log.max(1, keepdims=True)
        norm = top[:, 0] + np.log(np.exp(log - top).sum(1))
        resp = np.exp(log - norm[:, None])
        n = resp.sum(0) + 1e-12
        share, mean = n / n.sum(), resp.T @ xy / n[:, None]
        var = (resp * ((xy[:, None, :] - mean) ** 2).sum(2)).sum(0) / (2 * n) + 1e-6
        if norm.sum() - last < tol * len(xy):
            break
        last = norm.sum()
    return resp.argmax(1), mean


def merge_near(labels: np.ndarray, centres: np.ndarray, near: float = MERGE) -> np.ndarray:
    """Labels with clusters joined whose centres are nearer than `near`, also by way of others."""
    name = np.arange(len(centres))
    for i in range(len(centres)):
        for j in range(i):
            if np.hypot(*(centres[i] - centres[j])) < near:
                name[name == name[i]] = name[j]
    return name[labels]


def place_labels(traces: DataFrame) -> DataFrame:
    """traces with place, the cluster of each point within its trajectory."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("frame", kind="stable")
        xy, k = g[["x", "y"]].to_numpy(float), min(components_for(len(g)), len(g))
        return g.assign(place=merge_near(*spherical_mixture(xy, k)).astype(np.int32))

    return traces.groupBy(*TRAJ).applyInPandas(run, traces.withColumn("place", F.lit(None).cast("int")).schema)


def split_hops(labelled: DataFrame) -> DataFrame:
    """New trajectories at each change of place, in videos whose trajectories mostly stay close to their places.

    A trajectory's spread is the largest mean distance of a place's points from their centre. Only sums by place and
    one number a trajectory are shuffled before the cut.
    """
    by_place = Window.partitionBy(*TRAJ, "place")
    off = labelled.withColumn("d", F.sqrt((F.col("x") - F.avg("x").over(by_place)) ** 2 + (F.col("y") - F.avg("y").over(by_place)) ** 2))
    spread = off.groupBy(*TRAJ, "place").agg(F.avg("d").alias("m")).groupBy(*TRAJ).agg(F.max("m").alias("m"))
    cut = spread.groupBy("video").agg((F.avg((F.col("m") < CLOSE).cast("double")) > SHARE).alias("cut"))
    w = Window.partitionBy(*TRAJ).orderBy("frame")
    change = F.coalesce((F.col("place") != F.lag("place").over(w)).cast("int"), F.lit(0))
    parts = labelled.withColumn("_c", change).withColumn("part", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_c")
    return parts.join(cut, "video").withColumn("part", F.when(F.col("cut"), F.col("part")).otherwise(0)).drop("cut")
