"""Regions: trajectories sorted into shapes or areas of the H-K plane, with statistics by region."""

from __future__ import annotations

import math
from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotloom.functions.geometry import rotate
from spotloom.operators.quantiles import medians
from spotloom.schemas import TRAJ


def in_rect(x: Column, y: Column, x1: float, y1: float, x2: float, y2: float, angle: float = 0.0) -> Column:
    u, v = rotate(x, y, F.lit((x1 + x2) / 2), F.lit((y1 + y2) / 2), F.lit(angle))
    return (F.abs(u) <= abs(x2 - x1) / 2) & (F.abs(v) <= abs(y2 - y1) / 2)


def in_ellipse(x: Column, y: Column, cx: float, cy: float, rx: float, ry: float, angle: float = 0.0) -> Column:
    u, v = rotate(x, y, F.lit(cx), F.lit(cy), F.lit(angle))
    return (u / rx) * (u / rx) + (v / ry) * (v / ry) <= 1


def shape_label(x: Column, y: Column, shapes: list[dict]) -> Column:
    """The number of the first shape that holds a point, -1 for none."""
    out = F.lit(-1)
    for i, s in reversed(list(enumerate(shapes))):
        if s["type"] == "line":  # holds nothing
            continue
        inside = in_rect(x, y, s["x1"], s["y1"], s["x2"], s["y2"], s.get("angle", 0.0)) if s["type"] == "rect" else in_ellipse(x, y, s["cx"], s["cy"], s["rx"], s["ry"], s.get("angle", 0.0))
        out = F.when(inside, i).otherwise(out)
    return out


def roi_by_mean(traces: DataFrame, shapes: list[dict]) -> DataFrame:
    c = traces.groupBy(*TRAJ).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return c.select(*TRAJ, shape_label(F.col("cx"), F.col("cy"), shapes).alias("roi"))


def roi_strict(traces: DataFrame, shapes: list[dict]) -> DataFrame:
    """The shape that holds all points of a trajectory, -1 if they differ."""
    p = traces.select(*TRAJ, shape_label(F.col("x"), F.col("y"), shapes).alias("l"))
    return p.groupBy(*TRAJ).agg(F.when(F.min("l") == F.max("l"), F.min("l")).otherwise(-1).alias("roi"))


def _draw(wall: np.ndarray, xs: np.ndarray, ys: np.ndarray, clip: bool) -> None:
    """Marks pixels and the four next to each; those beyond the grid are moved to its edge, or left out."""
    height, width = wall.shape
    for dx, dy in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)):
        r, c = ys + dy, xs + dx
        ok = np.ones(len(r), bool) if clip else (r >= 0) & (r < height) & (c >= 0) & (c < width)
        wall[np.clip(r, 0, height - 1)[ok], np.clip(c, 0, width - 1)[ok]] = True


def _line(wall: np.ndarray, a: tuple[float, float], b: tuple[float, float], clip: bool = False) -> None:
    n = max(int(max(abs(b[0] - a[0]), abs(b[1] - a[1]))), 1)
    _draw(wall, np.rint(np.linspace(a[0], b[0], n + 1)).astype(int), np.rint(np.linspace(a[1], b[1], n + 1)).astype(int), clip)


def _labels(wall: np.ndarray) -> np.ndarray:
    """Numbers from 0 of the connected parts of a grid without its walls; a wall pixel has that of the nearest part."""
    height, width = wall.shape
    labels, n = np.full(wall.shape, -1, int), 0
    for r, c in np.argwhere(~wall).tolist():
        if labels[r, c] < 0:
            labels[r, c] = n
            todo = deque([(r, c)])
            while todo:
                y, x = todo.popleft()
                for y2, x2 in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if 0 <= y2 < height and 0 <= x2 < width and not wall[y2, x2] and labels[y2, x2] < 0:
                        labels[y2, x2] = n
                        todo.append((y2, x2))
            n += 1
    # The nearest free pixel is next to a wall; of equally near ones, the first by row and column.
    around = np.pad(wall, 1)
    edge = ~wall & (around[:-2, 1:-1] | around[2:, 1:-1] | around[1:-1, :-2] | around[1:-1, 2:])
    free = np.argwhere(edge)
    for some in np.array_split(np.argwhere(wall), max(1, int(wall.sum()) // 256)) if len(free) else ():
        near = free[((some[:, None, :] - free[None, :, :]) ** 2).sum(2).argmin(1)]
        labels[tuple(some.T)] = labels[tuple(near.T)]
    return labels


def wall_grid(polylines: list[list[tuple[float, float]]], width: int, height: int) -> np.ndarray:
    """Labels of the regions that polylines (in pixels) divide a grid into; wall pixels take the nearest label."""
    wall = np.zeros((height, width), bool)
    for line in polylines:
        for a, b in zip(line[:-1], line[1:], strict=True):
            _line(wall, a, b)
    return _labels(wall)


def shape_grid(shapes: list[dict], width: int, height: int) -> np.ndarray:
    """Labels of the parts of the plane that the outlines of shapes (lines, rectangles, ellipses, in pixels) divide it into.

    Shapes that overlap make parts of their own; what is outside is a part like others.
    """
    wall = np.zeros((height, width), bool)
    for s in shapes:
        t = math.radians(s.get("angle", 0.0))
        turn = lambda x, y, cx, cy: (cx + x * math.cos(t) - y * math.sin(t), cy + x * math.sin(t) + y * math.cos(t))  # noqa: E731, B023
        if s["type"] == "line":
            _line(wall, tuple(s["p1"]), tuple(s["p2"]), True)
        elif s["type"] == "rect":
            cx, cy, hx, hy = (s["x1"] + s["x2"]) / 2, (s["y1"] + s["y2"]) / 2, (s["x2"] - s["x1"]) / 2, (s["y2"] - s["y1"]) / 2
            corners = [turn(x, y, cx, cy) for x, y in ((-hx, -hy), (hx, -hy), (hx, hy), (-hx, hy))]
            for a, b in zip(corners, corners[1:] + corners[:1], strict=True):
                _line(wall, a, b, True)
        else:
            n = max(int(2 * math.pi * max(s["rx"], s["ry"])), 200)
            a = np.linspace(0, 2 * math.pi, n, endpoint=False)
            xs, ys = turn(s["rx"] * np.cos(a), s["ry"] * np.sin(a), s["cx"], s["cy"])
            _draw(wall, np.rint(xs).astype(int), np.rint(ys).astype(int), True)
    return _labels(wall)


def _by_mean_x(labelled: DataFrame) -> DataFrame:
    """roi renumbered from 0 by ascending mean x of its trajectories; -1 stays."""
    means = labelled.where("roi >= 0").groupBy("roi").agg(F.avg("cx").alias("m"))  # a row a region
    rank = means.select(F.col("roi").alias("_r"), (F.dense_rank().over(Window.orderBy("m", "roi")) - 1).alias("rank"))
    out = labelled.join(F.broadcast(rank), F.col("roi") == F.col("_r"), "left")
    return out.select(*TRAJ, F.coalesce("rank", "roi").alias("roi"))


def roi_classes(traces: DataFrame, shapes: list[dict], bounds: tuple[float, float, float, float], width: int, height: int, strict: bool = False) -> DataFrame:
    """The region of each trajectory: of its mean place or, if strict, the one that all its points are in (-1: none).

    shapes are in pixels of the plot, as drawn; regions are numbered by the mean x of their trajectories.
    """
    grid = traces.sparkSession.createDataFrame([(shape_grid(shapes, width, height).ravel().tolist(),)], "grid array<int>")
    x0, x1, y0, y1 = bounds
    place = lambda v, a, b, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.rint((F.col(v) - a) / (b - a) * n).cast("int")))
    label = lambda x, y: F.element_at("grid", place(y, y0, y1, height) * width + place(x, x0, x1, width) + 1)
    if strict:
        p = traces.join(F.broadcast(grid)).select(*TRAJ, "x", label("x", "y").alias("l"))  # one row, of a plot's size
        return _by_mean_x(p.groupBy(*TRAJ).agg(F.avg("x").alias("cx"), F.when(F.min("l") == F.max("l"), F.min("l")).otherwise(-1).alias("roi")))
    c = traces.groupBy(*TRAJ).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return _by_mean_x(c.join(F.broadcast(grid)).select(*TRAJ, "cx", label("cx", "cy").alias("roi")))


def plot_bounds(traces: DataFrame) -> tuple[float, float, float, float]:
    """Least and greatest x and y, a twentieth wider on each side (1 at least), and then as wide as each other."""
    r = traces.agg(*[f(c).alias(n + c) for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    pad = {c: max((r["hi" + c] - r["lo" + c]) * 0.05, 1.0) for c in "xy"}
    half = max(r["hi" + c] - r["lo" + c] + 2 * pad[c] for c in "xy") / 2
    return tuple(v for c in "xy" for v in ((r["lo" + c] + r["hi" + c]) / 2 - half, (r["lo" + c] + r["hi" + c]) / 2 + half))


def on_plot(traces: DataFrame, side: int = 1000) -> DataFrame:
    """traces with px and py, their places on a plot of `side` by `side` pixels that all of them share (plot_bounds)."""
    lo, hi = ({c: f(c).alias(f"_{n}{c}") for c in "xy"} for n, f in (("lo", F.min), ("hi", F.max)))
    ends = traces.agg(*lo.values(), *hi.values())  # one row
    wide = lambda c: F.col(f"_hi{c}") - F.col(f"_lo{c}") + 2 * F.greatest((F.col(f"_hi{c}") - F.col(f"_lo{c}")) * 0.05, F.lit(1.0))
    half = F.greatest(wide("x"), wide("y")) / 2
    place = lambda c: (F.col(c) - ((F.col(f"_lo{c}") + F.col(f"_hi{c}")) / 2 - half)) / (2 * half) * side
    return traces.join(F.broadcast(ends)).withColumns({"px": place("x"), "py": place("y")}).select(*traces.columns, "px", "py")


def gate(points: DataFrame, x: Column, y: Column, labels: np.ndarray, order_by: str) -> DataFrame:
    """points with region: the label of the grid cell (x, y), renumbered by the ascending mean of order_by.

    The grid is that of a plot, so its size is fixed and it is an array literal.
    """
    height, width = labels.shape
    at = F.floor(y).cast("int") * width + F.floor(x).cast("int") + 1
    inside = (x >= 0) & (x < width) & (y >= 0) & (y < height)
    grid = points.sparkSession.createDataFrame([(labels.ravel().tolist(),)], "grid array<int>")
    got = points.join(F.broadcast(grid)).withColumn("_l", F.when(inside, F.element_at("grid", at))).drop("grid")
    rank = got.where("_l is not null").groupBy("_l").agg(F.avg(order_by).alias("_m")).withColumn("region", F.dense_rank().over(Window.orderBy("_m")) - 1)  # a row a region
    return got.join(F.broadcast(rank.drop("_m")), "_l", "left").drop("_l")


def region_stats(labelled: DataFrame, label: str) -> DataFrame:
    """Count, percent, and mean, median, deviation and range of H and K by region."""
    cells = [f(c).alias(f"{n}_{c.lower()}") for c in ("H", "K") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    out = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *cells).join(medians(labelled, [label], "H", "K"), label, "left")
    return out.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # a row a region


def members(traces: DataFrame, labelled: DataFrame, label: str, value: int) -> DataFrame:
    """The points of the trajectories of a region."""
    return traces.join(labelled.where(F.col(label) == value).select(*TRAJ), TRAJ, "left_semi")
