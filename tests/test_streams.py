"""Streams of pictures, and what is told of work under way."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotloom.operators import localize
from spotloom.sources import stacks
from spotloom.streaming import localizer, progress


def film(seed, frames=4):
    yy, xx = np.mgrid[:32, :32]
    rng = np.random.default_rng(seed)
    at = rng.uniform(8, 24, (2, 2))
    return np.stack([100 + rng.normal(0, 2, xx.shape) + sum(900 * np.exp(-((xx - x - 0.3 * f) ** 2 + (yy - y) ** 2) / 4) for y, x in at) for f in range(frames)]).astype(np.float32)


def rows(df):
    return sorted((r.video, r.frame, r.spot_idx, round(r.x, 6), round(r.y, 6), round(r.bg_median, 4)) for r in df.collect())


def test_pictures_that_arrive_are_located_as_those_at_rest(spark, tmp_path, monkeypatch):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    put = lambda name, content: (tmp_path / "in" / name).write_bytes(content)
    for i in range(3):
        put(f"a{i}.tif", stacks.write_tiff(film(i)))
    put("broken.tif", b"II*")
    put("notes.txt", b"x")
    run = lambda: localizer.localize_files(spark, src, out, check, files=2).awaitTermination()
    run()
    assert rows(localizer.read(spark, out)) == rows(localize.localize(stacks.read_images(spark, src).where("error is null")))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    put("later.TIFF", stacks.write_tiff(film(7)))
    good, calls = localize.localize, []

    def fails_once(*a):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("lost")
        return good(*a)

    monkeypatch.setattr(localize, "localize", fails_once)
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    monkeypatch.setattr(localize, "localize", good)
    assert rows(localizer.read(spark, out)) == rows(localize.localize(stacks.read_images(spark, src).where("error is null")))
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())


def test_shares_rise_within_a_stage(spark):
    told = []

    def slow(batches):
        for b in batches:
            time.sleep(0.4)
            yield b

    with progress.watched(spark, lambda stage, done, tasks: told.append((stage, done, tasks)), 0.05):
        spark.range(0, 16, 1, 16).mapInPandas(slow, "id long").collect()
    stage = max({t[0] for t in told}, key=lambda s: sum(t[0] == s for t in told))
    shares = [done for s, done, _ in told if s == stage]
    assert len(shares) >= 3 and shares == sorted(shares) and {t for s, _, t in told if s == stage} == {16}
    percents = []
    with progress.between(spark, lambda p, label: percents.append((p, label)), 20, 60, "step"):
        spark.range(0, 16, 1, 16).mapInPandas(slow, "id long").groupBy(F.col("id") % 3).count().collect()
    assert percents[0] == (20, "step") and percents[-1] == (60, "step") and percents == sorted(percents) and len(percents) >= 4
    with pytest.raises(RuntimeError), progress.watched(spark, print):
        raise RuntimeError


def test_streams_tell_of_their_batches(spark, tmp_path):
    told = []
    listener = progress.StreamProgress(lambda name, batch, rows, speed: told.append((name, batch, rows)))
    spark.streams.addListener(listener)
    try:
        for i in range(2):
            spark.range(5 + i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).writeStream.queryName("numbers").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
        for _ in range(50):
            if sum(t[2] for t in told) == 11:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert {t[0] for t in told} == {"numbers"} and sum(t[2] for t in told) == 11 and {t[1] for t in told if t[2]} == {0, 1}
