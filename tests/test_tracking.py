"""The look-ahead tracker in pieces, in ranges and as a stream, against one plain run over a whole video."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spotloom.operators import forecast, graph
from spotloom.plans import adapters
from spotloom.streaming import tracker

LOC = "video string, frame int, spot_idx int, x double, y double, z double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def bent(path):
    """An exponent that depends on how many points it is taken from."""
    return 1.0 if len(path) < 4 else 1.0 + min(len(path), 10) / 20


def plain(spots, law, cutoff):
    """Every video in one run, as (video, traj_idx, frame, x, y)."""
    out = []
    for video, own in spots.groupby("video"):
        v = forecast._Video(own, law)
        for n, nodes in enumerate(sorted(t for t in v.run() if len(t) >= cutoff)):
            out += [(video, n, f, *v.point((f, i))[:2].tolist()) for f, i in nodes]
    return sorted(out)


def found(traces):
    return sorted((r.video, r.traj_idx, r.frame, r.x, r.y) for r in traces.collect())


def crowd(seed, frames=18, spots=7, side=20.0, videos=2, gaps=True):
    """Walks in a small field, so that all spots of a video hang together; some frames have none."""
    rng = np.random.default_rng(seed)
    rows = []
    for v in range(videos):
        walk = rng.normal(0, 1.5, (frames, spots, 2)).cumsum(0) + rng.uniform(0, side, (spots, 2))
        for f in range(frames):
            if gaps and f % 11 in (5, 6, 7, 8, 9):
                continue
            for i in range(spots):
                if (f * 7 + i * 3 + v) % 9:
                    rows.append((f"v{v}", f + 1 + 3 * v, i, *walk[f, i].tolist(), 0.0))
    return rows


@pytest.mark.parametrize("seed, horizon, gaps, piece, windows", [(0, 3, True, 60, 64), (0, 3, True, 1, 4), (2, 1, True, 50_000, 64), (3, 2, False, 30, 4)])
def test_pieces_and_ranges_change_nothing(spark, seed, horizon, gaps, piece, windows):
    rows = crowd(seed, gaps=gaps)
    law = forecast.law(6.0, horizon, 4, bent)
    want = plain(pd.DataFrame(rows, columns=[c.split()[0] for c in LOC.split(", ")]), law, 2)
    loc = spark.createDataFrame(rows, LOC).repartition(5)
    assert found(forecast.track(loc, 6.0, horizon, 2, bent, 4, piece=piece, windows=windows)) == want and len(want) > 50


def test_given_spots_in_pieces_equal_a_whole_run(spark, sf_dir):
    loc = adapters.loc(spark, sf_dir)
    for threshold in (2.0, 40.0):
        assert found(forecast.track(loc, threshold, 3, 2, piece=25, windows=16)) == plain(loc.toPandas(), forecast.law(threshold), 2)


def test_components_are_dealt_into_pieces(spark, monkeypatch):
    rows = [("v", f, i, 50.0 * i + 0.3 * f, 0.0, 0.0) for i in range(60) for f in range(1, 6)]
    loc = spark.createDataFrame(rows, LOC)
    dealt, whole = [], forecast._dealt

    def watch(rows, parts, *how):
        dealt.append(rows.join(parts, graph.NODE).groupBy(F.pmod(F.xxhash64("video", "component"), F.lit(1 + rows.count() // how[1]))).count())
        return whole(rows, parts, *how)

    monkeypatch.setattr(forecast, "_dealt", watch)
    assert forecast.track(loc, 6.0, 3, 2, piece=50).select("video", "traj_idx").distinct().count() == 60
    sizes = [r["count"] for r in dealt[0].collect()]
    assert len(dealt) == 1 and sum(sizes) == 300 and len(sizes) >= 5 and max(sizes) <= 3 * 50


def test_components_of_too_few_frames_are_not_planned(spark, monkeypatch):
    """Crowds of one or two frames can have no track of three spots, but three in a row can."""
    rows = [("v", f, 10 * i + j, 50.0 * i + 0.1 * j, 0.0, 0.0) for i in range(20) for j in range(4) for f in range(1, 2 + i % 2)] + [("v", f, 500, -90.0, 0.3 * f, 0.0) for f in (1, 2, 3)]
    loc = spark.createDataFrame(rows, LOC)
    dealt, whole = [], forecast._dealt
    monkeypatch.setattr(forecast, "_dealt", lambda rows, parts, *how: dealt.append(parts.count()) or whole(rows, parts, *how))
    want = plain(pd.DataFrame(rows, columns=[c.split()[0] for c in LOC.split(", ")]), forecast.law(6.0), 3)
    assert found(forecast.track(loc, 6.0, 3, 3)) == want and len(want) == 3 and dealt == [3]


@pytest.fixture
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if old is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


class Arrivals:
    """Spots that come as files, a file a micro-batch, and a stream that is started anew for each round of them."""

    def __init__(self, spark, folder):
        self.spark, self.src, self.out, self.check = spark, str(folder / "src"), str(folder / "out"), str(folder / "check")

    def come(self, rows):
        self.spark.createDataFrame(rows, LOC).coalesce(1).write.mode("append").parquet(self.src)

    def run(self, **how):
        stream = self.spark.readStream.schema(LOC).option("maxFilesPerTrigger", 1).parquet(self.src)
        q = tracker.track_stream(stream, 6.0, alpha=bent, alternatives=4, **how).writeStream.option("checkpointLocation", self.check).trigger(availableNow=True).start(self.out)
        q.awaitTermination()

    def points(self):
        return self.spark.read.parquet(self.out)


@pytest.mark.parametrize("seed", [0, 1])
def test_stream_equals_the_batch_however_spots_are_split_and_goes_on_after_a_restart(spark, tmp_path, rocks, seed):
    rows = crowd(seed, frames=24)
    want = plain(pd.DataFrame(rows, columns=[c.split()[0] for c in LOC.split(", ")]), forecast.law(6.0, 3, 4, bent), 2)
    by_frame = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    cuts = [0, *sorted(np.random.default_rng(seed).choice(range(1, len(rows)), 5, replace=False).tolist()), len(rows)]
    a = Arrivals(spark, tmp_path)
    early = 0
    for n, (i, j) in enumerate(zip(cuts, cuts[1:])):
        part = by_frame[i:j]
        a.come(part[::-1])  # any order within a batch
        if n % 2:
            a.run(horizon=3)  # a new query each time, from the checkpoint
            early = max(early, a.points().count())
    assert 0 < early < len(rows)
    a.come([(v, None, None, None, None, None) for v in ("v0", "v1")])
    a.run(horizon=3)
    assert found(forecast.finish(a.points(), 2)) == want
    assert a.points().count() == len(rows)


def test_late_spots_within_the_patience_count_and_later_ones_do_not(spark, tmp_path, rocks):
    rows = [("v", f, 0, float(f), 0.0, 0.0) for f in range(1, 30)]
    a = Arrivals(spark, tmp_path)
    late = [r for r in rows if r[1] in (10, 13)]
    a.come([r for r in rows if r[1] <= 14 and r not in late])
    a.come(late)  # within 5 frames of the newest
    a.come([r for r in rows if r[1] > 14])
    a.come([("v", 2, 7, 2.0, 0.1, 0.0)])  # long complete
    a.come([("v", None, None, None, None, None), ("w", None, None, None, None, None)])
    a.run(horizon=3, lateness=5)
    got = found(forecast.finish(a.points(), 2))
    assert got == plain(pd.DataFrame(rows, columns=[c.split()[0] for c in LOC.split(", ")]), forecast.law(6.0, 3, 4, bent), 2)


def test_a_video_without_news_is_finished_in_time(spark, tmp_path, rocks):
    import time

    rows = [("v", f, 0, float(f), 0.0, 0.0) for f in range(1, 9)] + [("short", 1, 0, 0.0, 0.0, 0.0)]
    a = Arrivals(spark, tmp_path)
    a.come(rows)
    stream = spark.readStream.schema(LOC).parquet(a.src)
    q = tracker.track_stream(stream, 6.0, alpha=bent, alternatives=4, patience_ms=500).writeStream.option("checkpointLocation", a.check).trigger(processingTime="1 second").start(a.out)
    try:
        for _ in range(60):
            time.sleep(1)
            if q.recentProgress and a.points().count() == len(rows):
                break
    finally:
        q.stop()
    assert a.points().count() == len(rows)
    assert found(forecast.finish(a.points(), 1)) == plain(pd.DataFrame(rows, columns=[c.split()[0] for c in LOC.split(", ")]), forecast.law(6.0, 3, 4, bent), 1)


def test_a_table_of_quantiles_makes_long_jumps_abnormal_in_expressions_and_in_the_tracker(spark):
    from spotloom.functions import lookup, tracking

    table = lookup.Quantiles(np.array([0.8, 1.5]), np.array([0.4, 2.0]), np.array([[1.0, 2.0], [3.0, 1.2]]))
    rows = [(a, k, n, p) for a in (0.5, 1.0, 1.9) for k in (0.1, 0.5, 9.0) for n in (1.0, 2.9, 4.0, 7.6) for p in (1.0, 3.0)]
    df = spark.createDataFrame(rows, "alpha double, k double, after double, before double")
    zero = F.lit(0)
    parts = lambda c: (F.col(c), F.lit(0.5))
    cost = lambda *more: tracking.step_cost(parts("after"), parts("before"), F.col("alpha"), zero, zero, *more)
    jump = F.sqrt(F.col("after") ** 2 + 0.25)
    got = df.select("*", cost()[1].alias("plain"), cost(jump, lookup.quantile(table, F.col("alpha"), F.col("k")))[1].alias("odd"), cost()[0].alias("c")).collect()
    assert any(r.odd and not r.plain for r in got) and any(not r.odd for r in got)
    for r in got:
        law = forecast.law(1.0, alpha=lambda _, a=r.alpha: a, quantiles=table, k=lambda _, k=r.k: k)
        alpha, longest = law.motion(np.zeros((3, 3)))
        density, odd = forecast.step_cost(np.array([r.after, 0.5, 0.0]), np.array([r.before, 0.5, 0.0]), alpha, 0, 0, longest)
        assert density == pytest.approx(r.c) and odd == r.odd
        assert odd == (r.plain or np.hypot(r.after, 0.5) > 2.5 * lookup.quantile_at(table, r.alpha + 1e-4 * (r.alpha == 1), r.k))
    loc = spark.createDataFrame([("v", f, 0, 1.0 * f + 1.5 * max(0, min(f - 5, 2)), 0.0, 0.0) for f in range(1, 12)], LOC)
    whole = forecast.track(loc, 8.0, 3, 2)
    small = lookup.Quantiles(np.array([9.0]), np.array([9.0]), np.array([[0.9]]))
    split = forecast.track(loc, 8.0, 3, 2, quantiles=small)
    ends = lambda t: sorted((r.a, r.b) for r in t.groupBy("traj_idx").agg(F.min("frame").alias("a"), F.max("frame").alias("b")).collect())
    assert ends(whole) == [(1, 11)] and ends(split) == [(1, 5), (6, 11)]
