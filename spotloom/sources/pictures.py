"""Rasters as PNG files: densities of spots, and trajectories as lines. Grids and segments are made by Spark."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotloom.operators.trajectory import by_frame
from spotloom.schemas import TRAJ


#: Rows or columns of a picture that the driver may hold.
MOST_CELLS = 20_000


def png(pixels: np.ndarray) -> bytes:
    """A PNG of an array (rows, columns, 3) of bytes."""
    height, width, _ = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.astype(np.uint8).reshape(height, -1)], 1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def hot(values: np.ndarray) -> np.ndarray:
    """Black, red, yellow, white for values from 0 to 1."""
    v = np.clip(values, 0, 1)[..., None] * 3
    return (np.clip(v - np.array([0, 1, 2]), 0, 1) * 255).astype(np.uint8)


def density_picture(raster: DataFrame, height: int, width: int, top: float = 0.995) -> bytes:
    """A raster (r, c, density) of one video as a picture, clipped at a quantile of all its cells.

    The grid, whose size is given, is what comes to the driver.
    """
    if max(height, width) > MOST_CELLS:
        raise ValueError(f"a picture of {height} by {width} is too large for the driver")
    grid = np.zeros((height, width))
    for r, c, d in raster.where(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1)).select("r", "c", "density").collect():
        grid[r, c] = d
    flat = np.sort(grid.ravel())
    limit = flat[min(len(flat) - 1, int(len(flat) * top))] or grid.max() or 1.0
    return png(hot(np.minimum(grid, limit) / limit))


def segments(traces: DataFrame) -> DataFrame:
    """The lines between successive points of each trajectory."""
    after = lambda c: F.lead(c).over(by_frame())
    return traces.select(*TRAJ, "frame", F.col("x").alias("x1"), F.col("y").alias("y1"), after("x").alias("x2"), after("y").alias("y2")).where("x2 is not null")


def colours(ids: np.ndarray) -> np.ndarray:
    """A bright colour for each trajectory number."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return np.stack([64 + ((x >> np.uint64(s)) % np.uint64(192)).astype(int) for s in (5, 21, 40)], 1).astype(np.uint8)


def read_colours(data: bytes) -> np.ndarray:
    """Colours as triples of bytes."""
    return np.frombuffer(data, np.uint8)[: len(data) // 3 * 3].reshape(-1, 3)


def hk_picture(density: DataFrame, cells: int = 200, scale: int = 4) -> bytes:
    """A density of H and log10 K (i, j, density) as a picture, H to the right and K upwards. The grid comes to the driver."""
    if cells > MOST_CELLS:
        raise ValueError(f"{cells} cells a side are too many for the driver")
    grid = np.zeros((cells, cells))
    for i, j, d in density.where(F.col("i").between(0, cells - 1) & F.col("j").between(0, cells - 1)).select("i", "j", "density").collect():
        grid[cells - 1 - j, i] = d
    return png(np.kron(cool(grid / (grid.max() or 1.0)), np.ones((scale, scale, 1), np.uint8)))


def cool(values: np.ndarray) -> np.ndarray:
    """Black, deep blue, green, pale for values from 0 to 1."""
    v = np.clip(values, 0, 1)[..., None]
    return ((v ** np.array([2.2, 1.0, 0.7])) * np.array([220, 245, 200]) + np.array([11, 4, 5])).astype(np.uint8)


def trajectory_picture(lines: DataFrame, height: int, width: int, scale: int | None = None) -> bytes:
    """Segments of one video drawn at a whole multiple of the picture's size (about 1024 rows if it is small).

    Segments are dealt out to cells by Spark, so that only cells, as many as the picture has, come to the driver.
    """
    scale = scale or (max(1, 1024 // height) if height * width < 1024 * 1024 else 1)
    if max(height, width) * scale > MOST_CELLS:
        raise ValueError(f"a picture of {height} by {width} is too large for the driver")
    s = float(scale)
    steps = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))) * s
    n = F.greatest(F.ceil(steps), F.lit(1)).cast("int")
    at = lines.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    place = lambda c: F.round((F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * F.col("i") / F.col("n")) * s).cast("int")
    cells = at.select(place("y").alias("r"), place("x").alias("c"), "traj_idx").where(F.col("r").between(0, height * scale - 1) & F.col("c").between(0, width * scale - 1))
    got = cells.groupBy("r", "c").agg(F.max("traj_idx").alias("t")).collect()
    out = np.zeros((height * scale, width * scale, 3), np.uint8)
    if got:
        rct = np.array([tuple(x) for x in got], np.int64)
        out[rct[:, 0], rct[:, 1]] = colours(rct[:, 2])
    return png(out)
