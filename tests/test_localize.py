"""Localization end to end, lookups, predictors, effective counts and histogram fits."""

import io
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spotloom import schemas
from spotloom.functions import lookup
from spotloom.operators import diffusion, estimators, features, image, localize, mixtures, precision
from spotloom.operators import trajectory as T

CENTRES = [(12.3, 14.7), (30.6, 10.2), (25.1, 36.4), (25.4, 40.9)]


def pictures(spark, n=3):
    rng = np.random.default_rng(2)
    yy, xx = np.mgrid[:48, :48]
    rows = []
    for f in range(n):
        v = 100 + sum(900 * np.exp(-((xx - x) ** 2 + (yy - y) ** 2) / (2 * 1.4**2)) for y, x in CENTRES)
        rows.append(("v", f, 48, 48, rng.normal(v, 3).clip(0).ravel().tolist()))
    rows.append(("v", n, 48, 48, []))
    return schemas.conform(spark.createDataFrame(rows, "video string, frame int, height int, width int, pixels array<double>"), schemas.FRAMES)


def test_pictures_become_spots(spark):
    inorder = lambda df: localize.localize(df).toPandas().sort_values(["frame", "spot_idx"], ignore_index=True)
    found = inorder(pictures(spark))
    assert list(found.columns) == [f.name for f in schemas.LOC]
    for i, (y, x) in enumerate(CENTRES):
        off = 0.1 if i < 2 else 0.6  # the last two overlap, so each fit is drawn to the other
        near = found[(abs(found.x - x) < off) & (abs(found.y - y) < off)]
        assert len(near) == 3
        assert near.yvar.between(1.5, 2.5).all() and near.bg_median.between(90, 112).all() and (near.integrated_flux > 6000).all()
    assert len(found) == 12
    assert found.equals(inorder(pictures(spark).repartition(3)))
    plan = localize.localize(pictures(spark))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    few, localize.FEW_VIDEOS = localize.FEW_VIDEOS, 0
    try:
        assert found.equals(inorder(pictures(spark)))
    finally:
        localize.FEW_VIDEOS = few


def test_later_rounds_find_what_a_brighter_spot_hid():
    yy, xx = np.mgrid[:40, :40]
    bell = lambda y, x: np.exp(-((xx - x) ** 2 + (yy - y) ** 2) / (2 * 1.3**2))
    v = 0.1 + 0.9 * bell(20, 20) + 0.35 * bell(20, 24) + np.random.default_rng(0).normal(0, 0.004, (40, 40))
    v = v.clip(0) / v.max()
    one, _ = localize.find_spots(v, localize.Options())
    more, _ = localize.find_spots(v, localize.Options(deflations=1))
    assert len(more) > len(one) and any(abs(s["x"] - 24) < 1.2 and abs(s["y"] - 20) < 1.2 for s in more)


def test_windows_borders_and_flat_pictures():
    assert localize.windows(4) == ((5, 1.0), [(3, 0.5), (5, 1.0), (7, 1.5)]) and localize.windows(8)[0] == (9, 2.0)
    p = np.random.default_rng(1).normal(5, 1, (30, 26))
    wide = localize.bordered(p, 12, np.random.default_rng(3))
    assert wide.shape == (54, 50) and (wide[12:42, 12:38] == p).all() and 4.5 < wide[:12].mean() < 5.5 and 0.6 < wide[:, :12].std() < 1.4
    assert localize.find_spots(np.zeros((16, 16)), localize.Options())[0] == []


def test_border_blocks_follow_their_neighbours_in_order():
    """Without spread, noise is its mean, so every block can be told by hand."""

    class Mean:
        def normal(self, mean, sd, shape):
            return np.full(shape, mean + 1000 * sd)

    flat = np.full((6, 6), 7.0)
    assert (localize.bordered(flat, 3, Mean()) == 7).all()
    p = np.kron(np.array([[1.0, 2.0], [3.0, 4.0]]), np.ones((3, 3)))  # blocks of one value
    wide = localize.bordered(p, 3, Mean())
    block = wide[1::3, 1::3]  # a pixel of each block
    assert all((wide[3 * i : 3 * i + 3, 3 * j : 3 * j + 3] == block[i, j]).all() for i in range(4) for j in range(4))
    # Top, from below it: [0, 1, 2] without the last; right, from before it; bottom; left. The corner at the top left is the
    # left strip's, taken from the top strip after it; that at the top right the right strip's.
    top, right, bottom, left = [None, 1, 2, None], [2, 2, 4, None], [None, 3, 4, 4], [1, 1, 3, 3]
    # Then inner blocks: the mean of both neighbours along the strip, in it at the top and left, inward of it otherwise.
    t1 = (left[0] + top[2]) / 2
    t2 = (t1 + right[0]) / 2
    r1 = (t2 + 4) / 2
    r2 = (2 + bottom[2]) / 2
    b1 = (left[2] + 4) / 2
    b2 = (3 + r2) / 2
    l1 = (left[0] + left[2]) / 2
    l2 = (l1 + left[3]) / 2
    assert block.tolist() == [[1, t1, t2, 2], [l1, 1, 2, r1], [l2, 3, 4, r2], [3, b1, b2, 4]]


def test_ring_is_smoothed_one_pixel_after_the_other():
    rng = np.random.default_rng(2)
    p = rng.normal(0, 1, (12, 11))
    got = p.copy()
    localize.smooth_ring(got, (slice(1, 8), slice(3, 10)))
    want = [row.tolist() for row in p]
    for _ in range(2):
        for r, c in [(r, c) for c in range(3, 10) for r in (1, 7)] + [(r, c) for r in range(1, 8) for c in (3, 9)]:
            near = [want[i][j] for i in range(max(0, r - 2), min(11, r + 2) + 1) for j in range(max(0, c - 2), min(10, c + 2) + 1)]
            want[r][c] = sum(near) / len(near)
    assert got == pytest.approx(np.array(want)) and (got[3:6, 5:8] == p[3:6, 5:8]).all()


def test_regions_give_way_twice_and_failed_fits_are_tried_again():
    score = np.array([[0, 0, 0, 0, 0, 0], [0, 5, 9, 7, 3, 0], [0, 0, 0, 0, 0, 0]], float)
    assert localize.regions(score, 1.0, 7, 1) == [(1, 2), (1, 4)] and localize.regions(score, 4.0, 7, 1) == [(1, 2)]
    assert localize.regions(score[:, ::-1], 1.0, 7, 1) == [(1, 3), (1, 1)] and localize.regions(score, 1.0, 7, 0) == [(1, 2)]
    yy, xx = np.mgrid[-3:4, -3:4]
    rng = np.random.default_rng(6)
    patches = np.array([0.2 + np.exp(-((xx - 0.3) ** 2 + yy**2) / 4), *[0.2 + rng.uniform(0, 1, (7, 7)) for _ in range(40)]])
    once = localize._solved(localize._lowered(patches, 0.2), 5)
    failed = [i for i, s in enumerate(once) if s is None]
    again = localize._solved(localize._lowered(localize._lowered(patches, 0.2)[failed], 0.2), 6)
    got = localize.fit(patches, 0.2)
    assert failed and got[0][0] == pytest.approx((0.3, 0), abs=0.05)
    for i, s in enumerate(got):
        want = again[failed.index(i)] if i in failed else once[i]
        assert (s is None) == (want is None) and (s is None or (s[0] == want[0]).all())


def plain_spots(picture, options, frame):
    """find_spots by plain loops over pixels, peaks and patches."""
    (first, radius), several = localize.windows(options.window)
    border = 2 * (first + 4)
    mean, sd = localize.background(picture)
    limit = options.alpha * (max(1.0, 2 * sd * sd / mean**2) if sd > 0 and mean != 0 else 1.0)
    wide = localize.bordered(picture, border, np.random.default_rng([options.seed, frame]))
    h, w = picture.shape
    out = []
    for n in range(1 + options.deflations):
        maps = {}
        for window, rad in several[::-1] if n else [(first, radius)]:
            half = window // 2
            g = np.exp(-(np.add.outer((np.arange(window) - half) ** 2.0, (np.arange(window) - half) ** 2.0)) / (2 * rad * rad)) / (np.sqrt(np.pi) * rad)
            g -= g.mean()
            score = np.zeros((h, w))
            for r in range(h):
                for c in range(w):
                    crop = wide[r + border - half : r + border + half + 1, c + border - half : c + border + half + 1]
                    hat = max(0.0, (crop * g).sum() / (g * g).sum())
                    base = window**2 * mean * mean - window**2 * mean
                    ratio = hat * hat * (g * g).sum() / base
                    score[r, c] = window**2 / 2 * np.log(1 - min(ratio, 1 - 1e-7)) if ratio < 1 else window**2 / 2 * np.log(1e-7)
            maps[window] = score * (several[0][0] ** 2 / window**2 if n else 1)
        for window, score in maps.items():
            half, peaks = window // 2, []
            if n == 0:
                tops = [(r, c) for r in range(h) for c in range(w) if score[r, c] > limit and score[r, c] == score[max(0, r - options.shift) : r + options.shift + 1, max(0, c - options.shift) : c + options.shift + 1].max()]
                hidden = set()
                for r, c in sorted(tops, key=lambda p: -score[p]):
                    if (r, c) not in hidden:
                        peaks.append((r, c))
                        hidden |= {(i, j) for i in range(r - half, r + half) for j in range(c - half, c + half)}
            else:
                peaks = localize.regions(score, limit, window, options.shift)
            taken = []
            for r, c in peaks:
                box = np.s_[r + border - half : r + border + half + 1, c + border - half : c + border + half + 1]
                spot, patch = None, wide[box].copy()
                for repeat in (5, 6):
                    patch = patch - mean
                    patch = patch - patch.min() + 0.01
                    y, x = np.mgrid[-half : half + 1, -half : half + 1].reshape(2, -1).astype(float)
                    design = np.stack([x * x, x, y * y, y, x * y, x * 0 + 1], 1)
                    model, coef = patch.ravel(), None
                    for _ in range(repeat):
                        new = np.linalg.lstsq(design * model[:, None], model * np.log(patch.ravel()), rcond=None)[0]
                        done = coef is not None and np.allclose(new, coef, rtol=1e-7, atol=0)
                        coef, model = new, np.exp(np.clip(design @ new, -25, 25))
                        if done:
                            break
                    spot = localize._spot(coef, half)
                    if spot is not None:
                        break
                if spot is None or not (-1 < r + spot[0][1] < h and -1 < c + spot[0][0] < w):
                    continue
                (dx, dy), cov, amp = spot
                out.append((min(max(c + dx, 0), w - 1), min(max(r + dy, 0), h - 1), cov[0, 0], cov[1, 1], amp, window))
                taken.append((box, localize._bell(window, spot[0], cov, amp)))
            if n < options.deflations:
                for box, bell in taken:
                    wide[box] = np.maximum(wide[box] - bell, mean)
                    localize.smooth_ring(wide, box, rounds=options.smooth)
    return out


@pytest.mark.parametrize("deflations, smooth", [(0, 0), (2, 0), (1, 2)])
def test_rounds_equal_plain_loops(deflations, smooth):
    yy, xx = np.mgrid[:26, :28]
    bell = lambda y, x, s=1.3: np.exp(-((xx - x) ** 2 + (yy - y) ** 2) / (2 * s * s))
    options = localize.Options(deflations=deflations, smooth=smooth)
    for seed in range(3):
        rng = np.random.default_rng(seed)
        v = 0.15 + sum(rng.uniform(0.3, 1) * bell(*rng.uniform(1, 25, 2), rng.uniform(1, 2)) for _ in range(7)) + rng.normal(0, 0.01, xx.shape)
        v = v.clip(0) / v.max()
        got, _ = localize.find_spots(v, options, seed)
        want = plain_spots(v, options, seed)
        assert len(got) == len(want) > 2
        for a, b in zip(got, want):
            assert (a["x"], a["y"], a["xvar"], a["yvar"], a["norm_cst"], a["window_size"]) == pytest.approx(b, rel=1e-5)


def test_background_equals_the_pixel_operators(spark):
    norm = image.normalise(image.pixels(pictures(spark, 2)))
    bg = {r.frame: r for r in image.background(norm).collect()}
    px = norm.toPandas().sort_values(["frame", "r", "c"])
    for f, g in px.groupby("frame"):
        assert localize.background(g.v.to_numpy().reshape(48, 48)) == pytest.approx((bg[f].bg_mean, bg[f].bg_std), abs=1e-9)


def test_lookups(spark):
    data = struct.pack("<2i", 2, 3) + np.array([0.5, 1.0, -1, 0, 1, 1, 2, 3, 4, 5, 6], "<f8").tobytes()
    q = lookup.read_quantiles(data)
    assert [lookup.quantile_at(q, a, k) for a, k in ((0.4, -2), (0.5, 0), (9, 9))] == [1, 6, 6]
    df = spark.createDataFrame([(0.4,), (0.5,), (7.0,)], "v double")
    assert [r[0] for r in df.select(lookup.beyond([0.5, 1.0], F.col("v"))).collect()] == [0, 1, 1]
    density = F.array(*[F.lit(float(i)) for i in range(39)])
    at = spark.createDataFrame([(0.0,), (0.6,), (500.0,)], "v double").select(F.exp(lookup.log_jump_density(F.col("v"), density)))
    assert [round(r[0], 3) for r in at.collect()] == [0.0, 1.0, 38.0]
    rng = np.random.default_rng(0)
    dims, w = (1, 4, 4, 3, 3, 1), [rng.normal(size=n).astype("<f4") for n in (4, 4, 12, 3, 3, 1)]
    net = lookup.read_affine(struct.pack("<6i", *dims) + b"".join(a.tobytes() for a in w))
    by_hand = lambda x: float((((x * w[0] + w[1]) @ w[2].reshape(4, 3)) + w[3]) @ w[4] + w[5][0])
    assert [net.slope * x + net.offset for x in (0.0, 2.0)] == pytest.approx([by_hand(0.0), by_hand(2.0)], rel=1e-5)
    got = spark.createDataFrame([(2.0, 5), (2.0, 1), (float("nan"), 5)], "f double, n int").select(lookup.k_of(F.col("f"), F.col("n"), net)).collect()
    assert [r[0] for r in got] == pytest.approx([by_hand(2.0), 0.5, 1.0], rel=1e-5)


def test_predicted_exponents(spark):
    rows = [("v", t, f, float(f * t), float(f), 0.0, 0) for t, n in ((0, 2), (1, 3), (2, 6), (3, 12)) for f in range(n)]
    traces = spark.createDataFrame(rows, schemas.TRACES)
    load = lambda: {m: (lambda x, m=m: np.full(len(x), m / 10.0)) for m in (3, 5, 8)}
    got = {r.traj_idx: r for r in lookup.predict_exponents(traces, load).collect()}
    assert [got[t].alpha for t in range(4)] == pytest.approx([1.0, 0.3, 0.5, 0.8]) and got[3].H == pytest.approx(0.4)
    rule = {r.n: r.m for r in spark.createDataFrame([(n,) for n in (3, 4, 5, 7, 8, 8191, 8192)], "n int").select("n", features.model_length(F.col("n")).alias("m")).collect()}
    assert {n: lookup.model_for(n, [3, 5, 8]) for n in rule} == rule
    x = lookup._signals(np.array([[[0.0, 0.0], [3.0, 4.0], [6.0, 8.0]]]))
    assert x.shape == (2, 3, 1, 3) and x[0, :, 0, 0].tolist() == pytest.approx([0, 1 / 3, 2 / 3]) and x[1, 2, 0, 1] == pytest.approx(8 / 15)


def test_effective_counts_equal_the_double_sum(spark):
    u = np.linspace(0, 3, 31)
    buffer = io.BytesIO()
    np.savez(buffer, u=u, S_rr=np.exp(-u), S_gg=0.5 * np.exp(-u), S_rg=0.1 * np.exp(-u))
    table = precision.read_table(buffer.getvalue())
    lengths = [3, 7, 7, 20]
    rows = [("v", i, f, 0.0, 0.0, 0.0, 0) for i, n in enumerate(lengths) for f in range(n)]
    got = precision.n_eff(spark.createDataFrame(rows, schemas.TRACES), table, 0.4, 2, 0.5, 0.1, 0.2).first()
    n = spread = 0.0
    for t in lengths:
        m = t - 4
        for i in range(max(m, 0)):
            for j in range(m):
                c, info = precision.score_covariance(np.array([abs(i - j) / 2]), table, 0.4, 2, 0.5, 0.1, 0.2)
                spread += 2 * (info if i == j else float(c[0]))
        n += 2 * max(m, 0)
    assert got.n_ratios == n and got.n_eff == pytest.approx(n * n * info / spread)
    assert precision.table_name(0.3) == "H0250" and precision.table_name(0.99) == "H0875"
    assert diffusion._rho(0.4, 2, 0.5, 0.1, 0.2) < 0


def test_histogram_fits(spark):
    rng = np.random.default_rng(4)
    steps = rng.normal((1.0, -2.0), (0.5, 2.0), (4000, 2)).cumsum(0)
    df = spark.createDataFrame(pd.DataFrame({"video": "v", "traj_idx": 0, "frame": np.arange(4000), "x": steps[:, 0], "y": steps[:, 1], "z": 0.0, "state": 0})).to(schemas.TRACES)
    got = {r.axis: r for r in estimators.displacement_histogram_fit(T.state_runs(df)).collect()}
    assert (got["x"].mu, got["x"].sigma, got["y"].mu, got["y"].sigma) == pytest.approx((1.0, 0.5, -2.0, 2.0), abs=0.15)
    few = estimators.displacement_histogram_fit(T.state_runs(df.where("frame < 5"))).collect()
    assert len(few) == 2 and all(r.mu is None for r in few)


def test_jump_threshold_by_mixture(spark):
    rng = np.random.default_rng(5)
    d = rng.normal(0, 3, (6000, 2))
    jumps = spark.createDataFrame(pd.DataFrame({"dx": np.append(d[:, 0], 400.0), "dy": np.append(d[:, 1], 0.0)}))
    kept = mixtures.trim_jumps(jumps)
    assert 5900 < kept.count() <= 6000
    assert mixtures.gmm_jump_threshold(kept) == pytest.approx(2.5 * np.sqrt(2) * 3 * 0.871, rel=0.05)  # a normal law cut at 1.96 deviations keeps 0.871 of its spread
    assert mixtures.gmm_jump_threshold(kept.where("dx > 1e9")) == 5.0


def test_tracker_places_every_spot_once_and_does_not_depend_on_alternatives_where_paths_are_clear(spark):
    from spotloom.operators import forecast

    rng = np.random.default_rng(8)
    rows = []
    for k, (x, y) in enumerate([(0, 0), (40, 0), (0, 40), (40, 40)]):
        walk = rng.normal(0, 1, (30, 2)).cumsum(0) + (x, y)
        rows += [("v", f + 1, k, float(a), float(b), 0.0) for f, (a, b) in enumerate(walk) if (f + k) % 9]
    loc = spark.createDataFrame(rows, "video string, frame int, spot_idx int, x double, y double, z double")
    kept = [sorted((r.traj_idx, r.frame, r.x) for r in forecast.track(loc, 8.0, 2, 1, alternatives=n).collect()) for n in (1, 4)]
    assert len(kept[0]) == len(rows) and len({t for t, _, _ in kept[1]}) == 4
    assert kept[0] == kept[1]


@pytest.mark.parametrize("horizon", [1, 2, 3])
@pytest.mark.parametrize("seed", range(3))
def test_crowded_paths_equal_those_of_the_whole_list(monkeypatch, seed, horizon):
    from spotloom.operators import forecast

    at = np.random.default_rng(seed).uniform(0, 12, (8, 5, 2))
    loc = pd.DataFrame([("v", f, i, *at[f, i], 0.0) for f in range(8) for i in range(5)], columns=["video", "frame", "spot_idx", "x", "y", "z"])
    tracks = []
    for crowd in (10**9, 0):
        monkeypatch.setattr(forecast, "CROWD", crowd)
        law = forecast.Law(7.0, horizon, 2**horizon, lambda p: 1.3 if len(p) > 3 else 1.0, forecast.exponential_jumps())
        tracks.append(forecast._Video(loc, law).run())
    assert tracks[0] == tracks[1]


def test_tracker_cuts_a_path_at_an_abnormal_step(spark):
    from spotloom.operators import forecast

    rows = [("v", f, 0, 0.5 * f, 0.0, 0.0) for f in range(1, 9)] + [("v", f, 0, 4.0 + 9.0 * (f - 8), 9.0 * (f - 8), 0.0) for f in range(9, 12)]
    loc = spark.createDataFrame(rows, "video string, frame int, spot_idx int, x double, y double, z double")
    whole = forecast.track(loc, 20.0, 3, 1).groupBy("traj_idx").count().collect()
    assert sum(r["count"] for r in whole) == 11 and len(whole) >= 1
    assert forecast.track(loc.where("false"), 20.0).count() == 0
    zigzag = [(9, 0), (10, 0), (11, 0), (12, 0), (13, 0)]
    x = np.cumsum([4.5, 19.0, -0.3, 19.0, -0.3])
    far = pd.DataFrame([("v", f, 0, float(a), 0.0, 0.0) for (f, _), a in zip(zigzag, x, strict=True)], columns=loc.columns)
    v = forecast._Video(pd.concat([loc.where("frame < 9").toPandas(), far]), forecast.Law(20.0, 3, 8, forecast.brownian, forecast.exponential_jumps()))
    v.tracks = [[(f, 0) for f in range(1, 9)]]
    total, at = v.score(0, zigzag, v.plain)
    assert total > forecast.CUT and at == 1
    assert v.score(0, zigzag[:1], v.plain)[1] is None
