"""Backgrounds at the very edge of clipping, rings around spots across tiles, and pictures of crowded frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotloom.operators import image
from spotloom.plans import adapters

# A frame's histogram in per cent: 28 is just three deviations from the middle of the mode, so it is not within them.
EDGE = {28: 1, 42: 1, 43: 1, 47: 2, 51: 1, 52: 1, 53: 1, 55: 3, 56: 1, 57: 1, 58: 1, 59: 3, 62: 1, 63: 2, 64: 1, 65: 2, 66: 2, 67: 4, 69: 1, 70: 3, 71: 5, 72: 1, 74: 3, 76: 1, 77: 2, 78: 1, 79: 2, 81: 3, 84: 1, 85: 4, 88: 1, 90: 2, 91: 1, 93: 1, 94: 1, 99: 1, 100: 1}


def test_a_value_just_at_the_clip_is_left_out(spark):
    values = [i / 100 for i, n in EDGE.items() for _ in range(n)]
    px = spark.createDataFrame([("v", f, p // 8, p % 8, values[(p * 7 + f) % 64]) for f in range(20) for p in range(64)], "video string, frame int, r int, c int, v double")
    assert {(r.n, r.s1, r.s2) for r in image.background(px).collect()} == {(63, 4436, 324036)}


@pytest.mark.parametrize("even", [False, True])
def test_rings_across_tiles_equal_plain_ones(spark, even):
    rng = np.random.default_rng(4)
    p = rng.uniform(0, 9, (90, 70))
    px = spark.createDataFrame([("v", 1, r, c, float(p[r, c])) for r in range(90) for c in range(70)], "video string, frame int, r int, c int, v double")
    at = [(i, float(r), float(c)) for i, (r, c) in enumerate([(0, 0), (25.5, 26), (26, 25), (31, 32), (57.5, 58.5), (89, 69), (-4, 3), (40, 66)])]
    spots = spark.createDataFrame([("v", 1, *s) for s in at], "video string, frame int, spot_idx int, r double, c double")
    df = image.annulus_stats(px, spots, even=even)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Exchange hashpartitioning") == 2  # pixels and spots, and nothing that was met
    got = {r.spot_idx: r for r in df.collect()}
    near = np.rint if even else lambda x: np.sign(x) * np.floor(abs(x) + 0.5)
    y, x = np.mgrid[:90, :70]
    for i, r, c in at:
        dy, dx = y - near(r), x - near(c)
        ring = p[(np.maximum(abs(dy), abs(dx)) <= 6) & (dy**2 + dx**2 > 9)]
        core = p[np.maximum(abs(dy), abs(dx)) <= 3]
        assert (got[i].bg_median, got[i].bg_var) == pytest.approx((np.median(ring), ring.var()))
        assert got[i].integrated_flux == (pytest.approx(core.sum() - core.size * np.median(ring)) if core.size else None)


def test_places_of_spots_come_to_python_flat(spark, sf_dir):
    frames = adapters.rendered(spark, sf_dir)
    plan = frames._jdf.queryExecution().analyzed().toString()
    assert "us#" in plan and "vs#" in plan
    one = frames.orderBy("video", "frame").first()
    y, x = np.mgrid[:48, :48]
    p = 100 + 5 * np.sin(1.7 * x + 2.3 * y)
    for s in adapters.loc(spark, sf_dir).where((F.col("video") == one.video) & (F.col("frame") == one.frame)).collect():
        p = p + 900 * np.exp(-((x - 4 - s.x % 40) ** 2 + (y - 4 - s.y % 40) ** 2) / 4)
    assert np.allclose(np.reshape(one.pixels, (48, 48)), p, rtol=1e-5)
