"""The trajectory engine: every query against its SQL, hand fixtures, simulations and sources."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spotloom import schemas
from spotloom.functions import cauchy, tracking
from spotloom.operators import classify, diffusion, estimators, graph, image, linking, mixtures, quantiles
from spotloom.operators import trajectory as T
from spotloom.plans import adapters, catalogue
from spotloom.sources import shapes, stacks, tables
from spotloom.streaming import linker

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def cells(rows):
    fix = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(map(fix, r)) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = cells([r[c] for c in columns] for r in df.collect())
    want = duck.sql(catalogue.SQL[name])
    assert sorted(want.columns) == columns
    assert got == cells([r[want.columns.index(c)] for c in columns] for r in want.fetchall())


def gap_trajectory(spark):
    rows = [("a", 1, f, x, y, 0.0, 0) for f, x, y in ((1, 0.0, 0.0), (2, 1.0, 0.0), (3, 3.0, 0.0), (5, 3.0, 2.0), (6, 4.0, 2.0))]
    return spark.createDataFrame(rows, schemas.TRACES)


def test_a_trajectory_with_a_gap(spark):
    runs = T.state_runs(gap_trajectory(spark))
    s = T.run_summary(runs).first()
    assert s.mean_jump == pytest.approx(4 / 3) and s.duration == 5 and s.points == 5
    assert sorted((round(r.angle), round(r.polar)) for r in T.angles(runs).collect()) == [(180, 0), (180, 0)]
    assert T.angles(runs, strict_gaps=True).count() == 1
    assert sorted(r.r for r in T.ratios_1d(runs).collect()) == [0.5, 2.0]
    ea = {r.t: r["mean"] for r in T.ea_sd(runs).collect()}
    assert ea == {0: 0.0, 1: 0.25, 2: 2.25, 4: 5.0}
    assert {r.t: r["mean"] for r in T.ea_sd(runs, strict_gaps=True).collect()}[4] == 3.25
    assert {r.lag: r["mean"] for r in T.ta_ea_sd(runs).collect()} == {1: 0.5, 2: 2.25}
    msd = {r.lag: r for r in T.pooled_msd(gap_trajectory(spark)).collect()}
    assert msd[1].msd == pytest.approx(1.25) and msd[1].sem == pytest.approx(0.619620, abs=1e-6)
    ratios = diffusion.stride_ratios(gap_trajectory(spark), 2).collect()
    assert sorted(r.ratio for r in ratios if r.delta == 1) == [0, 0, 2] and [r.ratio for r in ratios if r.delta == 2] == [pytest.approx(1 / 3)]
    assert {r.delta: r.n for r in diffusion.ratio_counts(gap_trajectory(spark), 2).collect()} == {1: 6, 2: 2}


def test_state_runs_and_cutoffs(spark):
    df = spark.createDataFrame([("a", 1, f, 0.0, 0.0, 0.0, int(f > 3)) for f in range(1, 7)], schemas.TRACES)
    assert T.state_runs(df, 3).groupBy("run").count().count() == 2 and T.state_runs(df, 4).count() == 0


def test_numeric_anchors(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert [round(value(cauchy.rho_free(h)), 6) for h in (0.25, 0.5, 0.75)] == [-0.292893, 0.0, 0.414214]
    assert value(cauchy.j_var(0.5, 1.0, 0.5)) == pytest.approx(0.833333, abs=1e-6) and value(cauchy.j_cov(0.5, 1.0, 0.5)) == pytest.approx(0.166667, abs=1e-6)
    assert value(cauchy.rho(0.5, 1.0, 0.5, 0.1, 0.2)) == pytest.approx(-0.094595, abs=1e-6) and value(cauchy.rho(0.4, 3.0, 0.0, 0.1, 0.2)) == pytest.approx(-0.182230, abs=1e-6)
    lit = lambda *xs: tuple(F.lit(float(x)) for x in xs)
    for after, before, alpha, gap_before, gap, want in (((1, 0), (1, 0), 1, 0, 0, -2.992896), ((10, 0), (0.5, 0), 1, 0, 0, -5.580070), ((1, 1), (1, -1), 0.5, 0, 1, -3.792054)):
        cost, odd = tracking.step_cost(lit(*after), lit(*before), F.lit(float(alpha)), F.lit(gap_before), F.lit(gap))
        assert value(cost) == pytest.approx(want, abs=1e-5) and not value(odd)


def test_h_is_recovered_from_cauchy_samples(spark):
    rng = np.random.default_rng(3)
    rows = []
    for state, h in enumerate((0.25, 0.5, 0.75)):
        p = 2 ** (2 * h - 1) - 1
        x = p + math.sqrt(1 - p * p) * np.tan(np.pi * (rng.random(20_000) - 0.5))
        rows.append(pd.DataFrame({"state": state, "delta": 1, "ratio": x}))
    got = {r.state: r for r in diffusion.h_fit(spark.createDataFrame(pd.concat(rows))).collect()}
    for state, h in enumerate((0.25, 0.5, 0.75)):
        assert abs(got[state].H_estim - h) < 5 * got[state].H_std < 0.1


def walks(spark, n=200, length=40, seed=0):
    rng = np.random.default_rng(seed)
    xy = rng.normal(0, 1, (n, length, 2)).cumsum(1)
    rows = [("v", i, f + 1, float(xy[i, f, 0]), float(xy[i, f, 1]), 0.0, 0) for i in range(n) for f in range(length)]
    return spark.createDataFrame(rows, schemas.TRACES)


def test_estimators_on_brownian_walks(spark):
    df = walks(spark)
    k, h = estimators.fit_k(df, lags=6)
    assert k == pytest.approx(0.5, rel=0.1) and h == pytest.approx(0.5, abs=0.05)
    scan = estimators.multi_delta_scan(df, most=4)
    rows = scan.collect()
    assert len(rows) == 4 and all(abs(r.H_estim - 0.5) < 0.1 for r in rows)
    same = [r for r in estimators.sensitivity(scan, 1.0, 0.0, 0.0).collect() if r.factor == 1.0]
    assert all(abs(r.h - next(x.H_estim for x in rows if x.delta == r.delta)) < 1e-3 for r in same)
    assert abs(estimators.ratio_histogram_fit(T.state_runs(df)).first().h - 0.5) < 0.1
    assert estimators.longest_stride(df, 75) == 19


def test_precision_of_spots_follows_photons(spark):
    base = {"video": "v", "frame": 1, "spot_idx": 0, "x": 5.2, "y": 4.9, "z": 0.0, "xvar": 1.4, "yvar": 1.4, "rho": 0.0, "norm_cst": 1.0, "intensity": 1.0, "window_size": 9, "bg_median": 0.0, "bg_var": 4.0}
    loc = schemas.conform(spark.createDataFrame(pd.DataFrame([base | {"integrated_flux": f} for f in (500.0, 1000.0)] + [base | {"integrated_flux": 10.0, "xvar": -100.0}])), schemas.LOC)
    got = [r.sigma_loc for r in estimators.sigma_loc(loc).orderBy("integrated_flux").collect()]
    assert got[0] is None and got[1] == pytest.approx(2 * got[2], rel=1e-6)
    assert estimators.pooled_sigma(estimators.sigma_loc(loc)).first().median == pytest.approx((got[1] + got[2]) / 2)


@pytest.mark.parametrize("whole", [quantiles.WHOLE, 0])
def test_quantiles_equal_exact_ones(spark, monkeypatch, whole):
    monkeypatch.setattr(quantiles, "WHOLE", whole)
    rng = np.random.default_rng(8)
    n = 30_000 if whole else 150_000
    groups = {"few": rng.normal(size=7), "one": np.array([3.5]), "ties": rng.integers(0, 4, n).astype(float), "flat": np.full(n, 2.0), "many": rng.lognormal(0, 2, n)}
    if not whole:
        groups = {k: v for k, v in groups.items() if len(v) == n}  # bounds are for large groups
    rows = pd.DataFrame({"g": np.repeat(list(groups), [len(v) for v in groups.values()]), "v": np.concatenate(list(groups.values()))})
    named = {"a": 0.0, "b": 0.003, "c": 0.5, "d": 0.9987, "e": 1.0}
    df = spark.createDataFrame(rows).repartition(5)
    got = {r.g: r for r in quantiles.quantiles(df, "v", ["g"], **named).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert np.allclose([got[g][k] for k in named], np.quantile(v, list(named.values())), rtol=1e-12), g
    assert quantiles.quantiles(df.limit(0), "v", ["g"], m=0.5).isEmpty()


def test_mixture_finds_two_groups():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, 3000), rng.normal(8, 2, 1000)])
    edges = np.linspace(x.min(), x.max(), 201)
    folds = np.array([np.histogram(x[i::5], edges)[0] for i in range(5)], float)
    mid = (edges[1:] + edges[:-1]) / 2
    k = mixtures.components_by_folds(mid, folds)
    assert k >= 2
    assert sorted(estimators.mixture_1d(mid, folds.sum(0), 2)[1].round()) == [0, 8]
    n, edges = np.histogram(np.concatenate([rng.normal(0, 1, 6000), rng.normal(0, 6, 2000)]), 400)
    share, mean, var = mixtures.variational_mixture((edges[1:] + edges[:-1]) / 2, n.astype(float), 2)
    assert share.sum() == pytest.approx(1) and np.abs(mean).max() < 0.1
    assert (np.sort(var).tolist(), float(share.max())) == (pytest.approx([1, 36], rel=0.15), pytest.approx(0.75, abs=0.05))
    assert mixtures.digamma(np.array([1.0, 0.5, 10.0])) == pytest.approx([-0.5772156649, -1.9635100260, 2.2517525891])


def spots(spark):
    rows = [(1, 0, 0, 0), (1, 1, 10, 0), (2, 0, 1, 0), (2, 1, 10, 2), (2, 2, 50, 50), (4, 0, 2, 0)]
    return spark.createDataFrame([("v", f, i, float(x), float(y), 0.0) for f, i, x, y in rows], "video string, frame int, spot_idx int, x double, y double, z double")


def test_linking_fixture(spark):
    loc = spots(spark)
    assert [(r.frame, r.n) for r in graph.frame_spine(loc).orderBy("frame").collect()] == [(1, 2), (2, 3), (3, 0), (4, 1)]
    assert {r.frame: r.next_frame for r in graph.next_available_frame(loc).collect()} == {1: 2, 2: 4, 4: None}
    match = {(r.src_idx, r.dst_idx): r.d for r in linking.greedy_matches(loc).where("frame = 1").collect()}
    assert match == {(0, 0): 1.0, (1, 1): 2.0}
    edges = graph.candidate_edges(loc, 5.0, 3)
    assert sorted((r.src_frame, r.src_idx, r.dst_frame, r.dst_idx, r.gap) for r in edges.collect()) == [(1, 0, 2, 0, 0), (1, 0, 4, 0, 2), (1, 1, 2, 1, 0), (2, 0, 4, 0, 1)]
    assert edges.exceptAll(graph.candidate_edges(loc, 5.0, 3, grid=True)).isEmpty()
    parts = {}
    for r in graph.components(loc, edges).collect():
        parts.setdefault(r.component, set()).add((r.frame, r.spot_idx))
    assert sorted(map(sorted, parts.values())) == [[(1, 0), (2, 0), (4, 0)], [(1, 1), (2, 1)], [(2, 2)]]
    assert [tuple(r)[1:] for r in graph.orphans(loc, edges).collect()] == [(2, 2)]
    assert sorted(tuple(r)[1:] for r in graph.terminal_nodes(loc, edges).collect()) == [(2, 1), (2, 2), (4, 0)]
    got = linking.link(loc, 5.0, 3, cutoff=2)
    assert sorted((r.traj_idx, r.frame) for r in got.collect()) == [(0, 1), (0, 2), (0, 4), (1, 1), (1, 2)]


def test_links_are_chains_whatever_the_groups(spark):
    rng = np.random.default_rng(5)
    rows = [("v", f, i, float(x), float(y), 0.0) for f in range(1, 31) for i, (x, y) in enumerate(rng.uniform(0, 60, (12, 2)))]
    loc = spark.createDataFrame(rows, "video string, frame int, spot_idx int, x double, y double, z double")
    one, many = (sorted(map(tuple, linking.link(loc, 6.0, 2, together=n).collect())) for n in (1 << 30, 3))
    assert one == many and len({(r[2], r[3], r[4]) for r in one}) == len(one)
    by = {}
    for r in one:
        by.setdefault(r[1], []).append(r)
    for points in by.values():
        f = [p[2] for p in points]
        assert len(f) >= 3 and all(1 <= b - a <= 3 for a, b in zip(f[:-1], f[1:]))


def test_streaming_links_like_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "video string, frame int, x double, y double, z double"
    rows = [("v", f, 1.0 * f, 0.0, 0.0) for f in range(1, 9) if f != 4] + [("v", f, 50.0, 1.0 * f, 0.0) for f in range(1, 9)]
    rows.append(("v", 90, 0.0, 0.0, 0.0))  # a later frame, so that the eighth is complete
    split = [r for r in rows if r[1] == 5]  # half of the fifth comes in the second micro-batch
    first, second = [r for r in rows if r[1] < 5] + split[:1], split[1:] + [r for r in rows if r[1] > 5]
    for part in (first, second):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.option("maxFilesPerTrigger", 1).schema(schema).parquet(src)
    q = linker.link_stream(stream, 3.0, 2).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {}
    for r in spark.read.parquet(out).collect():
        got.setdefault(r.traj_idx, set()).add(r.frame)
    assert sorted(map(len, got.values())) == [7, 8]


def test_likelihood_and_threshold_anchors(spark):
    g = image.gauss_psf(5, 1.0)
    top = max(v for _, _, v in g)
    px = spark.createDataFrame([("v", 1, i + 2, j + 2, 0.1 + 0.5 * v / top) for i, j, v in g], "video string, frame int, r int, c int, v double")
    bg = spark.createDataFrame([("v", 1, 0.1, 0.1)], "video string, frame int, bg_mean double, bg_std double")
    assert image.likelihood(px, bg).first().score == pytest.approx(2.067920, abs=1e-5)
    assert image.likelihood(px.withColumn("v", F.lit(0.1)), bg).first().score == pytest.approx(0, abs=1e-9)
    t = image.threshold(spark.createDataFrame([("v", 1, 0.2, 0.1), ("v", 2, 0.1, 0.1), ("v", 3, 0.1, 0.0)], "video string, frame int, bg_mean double, bg_std double"))
    assert [r.threshold for r in t.orderBy("frame").collect()] == [1.0, 2.0, 1.0]
    px = spark.createDataFrame([("v", f, i // 2, i % 2, float(v)) for f, vs in ((1, (0, 10, 20, 40)), (2, (0, 5, 5, 20))) for i, v in enumerate(vs)], "video string, frame int, r int, c int, v double")
    got = image.normalise(px).orderBy("frame", "r", "c").collect()
    assert [r.v for r in got] == [0, 0.25, 0.5, 1, 0, 0.25, 0.25, 1] and {r.frame_max_raw for r in got} == {40, 20}


def test_spots_in_a_stack_are_located(spark, tmp_path):
    rng = np.random.default_rng(2)
    yy, xx = np.mgrid[:48, :48]
    centres = [(12.3, 14.7), (30.6, 10.2), (25.1, 36.4)]
    frames = np.zeros((3, 48, 48), np.uint16)
    for f in range(3):
        mean = 100 + sum(900 * np.exp(-((xx - x) ** 2 + (yy - y) ** 2) / (2 * 1.4**2)) for y, x in centres)
        frames[f] = rng.normal(mean, 3).clip(0)
    (tmp_path / "a.tif").write_bytes(stacks.write_tiff(frames, "finterval=0.02\nExposure = 10 ms"))
    (tmp_path / "b.tiff").write_bytes(b"junk")
    stack = stacks.read_stacks(spark, str(tmp_path))
    assert stack.where("error is not null").count() == 1
    good = stack.where("error is null")
    assert stacks.metadata(good.first().description) == {"interval": 0.02, "exposure": 0.01, "R": 0.5}
    px = image.pixels(good)
    bg = image.background(image.normalise(px))
    peaks = image.suppress(image.local_maxima(image.likelihood(image.normalise(px), bg, 7, 1.5)).where("score > 5"), 4)
    spots_ = peaks.withColumn("spot_idx", F.col("r") * 48 + F.col("c"))
    fits = image.fit_gaussians(px, spots_.select("video", "frame", "spot_idx", "r", "c")).collect()
    for y, x in centres:
        near = [r for r in fits if abs(r.x - x) < 0.15 and abs(r.y - y) < 0.15]
        assert len(near) == 3 and all(0.8 < r.xvar < 3.5 for r in near)


def test_tables_round_trip(spark, tmp_path):
    (tmp_path / "m_loc.csv").write_text("Frame, X ,Y\r\n1,2.5,3\r\n1,4,5\r\n2,bad,1\r\n")
    got = tables.read_localizations(spark, str(tmp_path / "m_loc.csv")).orderBy("frame", "spot_idx").collect()
    assert [(r.video, r.frame, r.spot_idx, r.x, r.z) for r in got] == [("m", 1, 0, 2.5, 0.0), ("m", 1, 1, 4.0, 0.0), ("m", 2, 0, None, 0.0)]
    with pytest.raises(schemas.MissingColumns):
        tables.read_traces(spark, str(tmp_path / "m_loc.csv"))
    tables.write_traces(gap_trajectory(spark), str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.count() == 5 and back.where("x = 3.0").count() == 2
    assert tables.output_name("a.tif.b", "_loc.csv") == "a.b_loc.csv"


def test_regions(spark):
    labels = classify.wall_grid([[(10, 0), (10, 19)]], 20, 20)
    assert set(labels.ravel()) == {0, 1} and labels[0, 0] != labels[0, 19]
    pts = spark.createDataFrame([(1, 2.0, 9.0), (2, 18.0, 1.0), (3, 25.0, 1.0)], "id int, x double, k double")
    got = {r.id: r.region for r in classify.gate(pts, F.col("x"), F.lit(5.0), labels, "k").collect()}
    assert got == {1: 1, 2: 0, 3: None}
    import struct

    roi = bytearray(64)
    roi[:4], roi[6] = b"Iout", 2
    struct.pack_into(">4h", roi, 8, 10, 20, 30, 60)
    assert shapes.load_rois(bytes(roi)) == ([{"type": "ellipse", "cx": 40.0, "cy": 20.0, "rx": 20.0, "ry": 10.0, "angle": 0.0}], 0)
    assert shapes.load_rois(b"x")[1] == 1


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_text_operators():
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for where, _, names in os.walk(os.path.join(top, "spotloom")):
        if not where.endswith("llm"):
            for n in names:
                if n.endswith(".py"):
                    assert "spotloom.llm" not in open(os.path.join(where, n)).read()


def test_scans_reach_the_longest_stride(spark):
    d = "/root/testdata/sf0.01"
    longest = estimators.longest_stride(adapters.traces(spark, d))
    for name in ("multi_delta_scan", "noise_sensitivity"):
        assert {r.delta for r in catalogue.QUERIES[name](spark, d).collect()} >= {11, 12, 13} and longest >= 13


def test_look_ahead_keeps_crossing_particles_apart(spark):
    from spotloom.operators import forecast

    rows = []
    for f in range(1, 22):
        rows += [("v", f, 0, 2.0 * f, 2.0 * f, 0.0), ("v", f, 1, 2.0 * f, 44.5 - 2.0 * f, 0.0)]
    loc = spark.createDataFrame([r for r in rows if not (r[1] == 5 and r[2] == 0)], "video string, frame int, spot_idx int, x double, y double, z double")
    got = {}
    for r in forecast.track(loc, 8.0, 2, 3, alpha=lambda p: 1.9).collect():
        got.setdefault(r.traj_idx, []).append((r.frame, r.y - 2 * r.frame if r.y == 2 * r.frame else None))
    assert sorted(map(len, got.values())) == [20, 21]
    assert sorted({b is None for _, b in t} == {True} or {b is None for _, b in t} == {False} for t in got.values()) == [True, True]


def test_look_ahead_costs_equal_the_expressions(spark):
    from spotloom.operators import forecast

    rng = np.random.default_rng(4)
    for _ in range(5):
        a, b = rng.normal(0, 3, 3), rng.normal(0, 3, 3)
        cost, odd = tracking.step_cost((F.lit(float(a[0])), F.lit(float(a[1]))), (F.lit(float(b[0])), F.lit(float(b[1]))), F.lit(0.7), F.lit(1), F.lit(0))
        r = spark.range(1).select(cost.alias("c"), odd.alias("o")).first()
        want = forecast.step_cost(a, b, 0.7, 1, 0)
        assert r.c == pytest.approx(want[0]) and r.o == want[1]


def test_look_ahead_uses_each_spot_once_within_reach(spark):
    from spotloom.operators import forecast

    rng = np.random.default_rng(6)
    rows = [("v", f, i, float(x), float(y), 0.0) for f in range(1, 21) for i, (x, y) in enumerate(rng.uniform(0, 40, (8, 2)))]
    loc = spark.createDataFrame(rows, "video string, frame int, spot_idx int, x double, y double, z double")
    got = forecast.track(loc, 5.0, 2, 2).collect()
    assert len({(r.frame, r.x, r.y) for r in got}) == len(got)
    by = {}
    for r in sorted(got, key=lambda r: r.frame):
        by.setdefault(r.traj_idx, []).append(r)
    for t in by.values():
        assert all(1 <= b.frame - a.frame <= 3 and math.hypot(b.x - a.x, b.y - a.y) < 5 for a, b in zip(t[:-1], t[1:]))


def decode_png(data):
    import struct
    import zlib

    width, height = struct.unpack(">II", data[16:24])
    at, body = 8, b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        assert zlib.crc32(data[at + 4 : at + 8 + n]) == struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]
        body += data[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + 3 * width)[:, 1:].reshape(height, width, 3)


def test_pictures(spark):
    from spotloom.sources import pictures

    df = spark.createDataFrame([("v", 7, f, float(x), float(y), 0.0, 0) for f, x, y in ((1, 1, 1), (2, 8, 1), (4, 8, 6))], schemas.TRACES)
    got = decode_png(pictures.trajectory_picture(pictures.segments(df), 10, 12, 1))
    lit = {tuple(p) for p in np.argwhere(got.any(2)).tolist()}
    assert lit == {(1, x) for x in range(1, 9)} | {(y, 8) for y in range(1, 7)}
    loc = df.select("video", "frame", F.lit(0).alias("spot_idx"), "x", "y", "z")
    dens = decode_png(pictures.density_picture(image.density_raster(loc, 1.0), 10, 12, 1.0))
    assert dens.shape == (10, 12, 3) and (dens[1, 1] == 255).all() and not dens[9, 0].any()


def test_nd2_frames(spark, tmp_path):
    import struct

    from spotloom.sources import nd2

    stack = np.random.default_rng(0).integers(0, 60000, (12, 5, 7, 2)).astype("<u2")
    out, places = bytearray(), {}
    size = b"\x06\x0d" + "dCalibration\0".encode("utf-16-le") + struct.pack("<d", 0.16)

    def put(name, body):
        places[name] = len(out)
        out.extend(struct.pack("<IIQ", nd2.MAGIC, len(name), len(body)) + name + body)

    number = lambda key, v: b"\x03" + bytes([len(key) + 1]) + (key + "\0").encode("utf-16-le") + struct.pack("<I", v)
    put(nd2.ATTRIBUTES, number("uiWidth", 7) + number("uiWidthBytes", 32) + number("uiHeight", 5) + number("uiComp", 2) + number("uiBpcInMemory", 16) + number("eCompression", 2))
    for i, page in enumerate(stack):
        rows = b"".join(r.tobytes().ljust(32, b"\0") for r in page)
        put(nd2.PICTURE + str(i).encode() + b"!", struct.pack("<d", 10.0 * i) + rows)
    put(nd2.CALIBRATION, size)
    put(nd2.TEXT, "Camera\nExposure: 8 ms\n".encode("utf-16-le"))
    body = b"".join(n + struct.pack("<QQ", at, 0) for n, at in places.items()) + nd2.SIGNATURE + bytes(8)
    at = len(out)
    put(b"ND2 FILEMAP SIGNATURE NAME 0001!", body)
    out.extend(nd2.SIGNATURE + struct.pack("<Q", at))
    (tmp_path / "a.nd2").write_bytes(bytes(out))
    assert nd2.metadata(bytes(out)) == pytest.approx({"pixel_um": 0.16, "interval": 0.01, "exposure": 0.008, "R": 0.8})
    (tmp_path / "b.nd2").write_bytes(nd2.JPEG2000 + bytes(100))
    got = nd2.read_stacks(spark, str(tmp_path)).collect()
    assert [r.error for r in got if r.video == "b"][0].startswith("ND2 of the older")
    pages = sorted((r for r in got if r.video == "a"), key=lambda r: r.frame)
    assert len(pages) == 12 and all((np.array(r.pixels).reshape(5, 7) == stack[i, :, :, 0]).all() for i, r in enumerate(pages))


def test_hops_are_cut_where_places_are_tight(spark):
    from spotloom.operators import postprocess

    rng = np.random.default_rng(8)
    rows = []
    for t in range(6):
        for f in range(30):
            x = 0.0 if f < 15 else 20.0
            rows.append(("tight", t, f, x + rng.normal(0, 0.2), rng.normal(0, 0.2), 0.0, 0))
            rows.append(("loose", t, f, x + rng.normal(0, 4), rng.normal(0, 4), 0.0, 0))
    df = spark.createDataFrame([(v, t, f, float(x), float(y), z, s) for v, t, f, x, y, z, s in rows], schemas.TRACES)
    got = postprocess.split_hops(postprocess.place_labels(df)).groupBy("video", "traj_idx").agg(F.countDistinct("part").alias("n"), F.min(F.when(F.col("part") > 0, F.col("frame"))).alias("first")).collect()
    assert all((r.n, r["first"]) == ((2, 15) if r.video == "tight" else (1, None)) for r in got) and len(got) == 12
