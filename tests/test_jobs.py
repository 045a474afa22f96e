"""The jobs over copies of the given tables that grow, fail, repeat and shrink."""

import math
import os
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import compare, recordings, registry
from spotloom import schemas
from spotloom.operators import trajectory as T

from .test_engine import cells, duck  # noqa: F401


def rows(df):
    return cells([r[c] for c in sorted(df.columns)] for r in df.collect())


def files(folder):
    return {os.path.join(at, n): os.stat(os.path.join(at, n)).st_mtime_ns for at, _, names in os.walk(folder) for n in names if n.endswith(".parquet")}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_job_leaves_what_its_sql_says(spark, sf_dir, duck, name):  # noqa: F811
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    df = registry.QUERIES[name](spark, sf_dir)
    want = duck.sql(registry.SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert rows(df) == cells([r[want.columns.index(c)] for c in sorted(df.columns)] for r in want.fetchall())
    assert before == {k: spark.conf.get(k, None) for k in before} and not spark.streams.active


@pytest.fixture
def arriving(spark, sf_dir, tmp_path):
    """Events in three parts: early days, late ones with some of the early days, and a copy of the first part."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    early = F.to_date("ts") < "2024-01-10"
    late_comer = F.col("event_id") % 17 == 3
    parts = [e.where(early & ~late_comer), e.where(~early | late_comer), e.where(early & ~late_comer)]
    odd = spark.createDataFrame([(None, 1.0, 2), (None, None, None)], "ts timestamp, value double, user_id long")

    def come(i):
        parts[i].unionByName(odd, allowMissingColumns=True).write.mode("append").parquet(str(tmp_path / "in"))

    paths = [str(tmp_path / n) for n in ("in", "out", "checkpoint")]
    return come, paths, lambda: recordings.statistics(recordings.as_points(e, recordings.load()))


def test_recordings_take_only_what_is_new(spark, arriving):
    come, paths, whole = arriving
    config = recordings.load()
    come(0)
    assert recordings.update(spark, config, *paths) == 1
    first = files(paths[1])
    assert recordings.update(spark, config, *paths) == 0 and files(paths[1]) == first
    come(1)
    assert recordings.update(spark, config, *paths) == 1
    second = files(paths[1])
    assert rows(recordings.read_report(spark, paths[1])) == rows(whole())
    kept = {p for p in first if second.get(p) == first[p]}
    assert all(p in kept for p in first if "/points/" in p)  # what came is never written again
    touched = {r.day for r in spark.read.schema(recordings.POINTS).parquet(paths[1] + "/points").where("batch = 1").select("day").distinct().collect()}
    assert {re.search("day=([-0-9]+)", p)[1] for p in second if "/report/" in p and p not in kept} == touched
    come(2)  # the first files again
    assert recordings.update(spark, config, *paths) == 1 and rows(recordings.read_report(spark, paths[1])) == rows(whole())


def test_recordings_go_on_after_a_failure_within_a_batch(spark, arriving, monkeypatch):
    come, paths, whole = arriving
    config = recordings.load() | {"files_per_batch": 1}
    come(0)
    come(1)
    good, calls = recordings.statistics, []

    def fails_once(points):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return good(points)

    monkeypatch.setattr(recordings, "statistics", fails_once)
    with pytest.raises(Exception, match="lost"):
        recordings.update(spark, config, *paths)
    assert not spark.streams.active
    recordings.update(spark, config, *paths)
    monkeypatch.setattr(recordings, "statistics", good)
    assert rows(recordings.read_report(spark, paths[1])) == rows(whole())


def test_recordings_by_hand(spark):
    at = lambda h, s=0: f"2024-01-01 {h:02d}:00:{s:02d}"
    seen = [(1, at(1), 7, 0.0, 0.0, 0), (2, at(2), 7, 3.0, 4.0, 0), (3, at(2, 9), 7, 99.0, 0.0, 0), (4, at(5), 7, 3.0, 5.0, 0), (5, at(6), 7, 0.0, 0.0, 1), (6, at(1), 8, 0.0, 0.0, 0), (6, at(1), 8, 0.0, 0.0, 0), (7, None, 8, 0.0, 0.0, 0), (8, at(1), None, 0.0, 0.0, 0), (9, at(1), 9, None, 0.0, 0)]
    df = spark.createDataFrame(seen, "id long, time string, particle long, x double, y double, state int").withColumn("video", F.lit("v/w"))
    points = recordings.as_points(df, {c: c for c in ("id", "time", "video", "particle", "x", "y", "state")} | {"frame_seconds": 3600})
    got = {r.state: r for r in recordings.statistics(points.where("day is not null")).collect()}
    assert (got[0].day, got[0].video, got[0].particles, got[0].runs, got[0].points, got[0].steps, got[0].mean_jump, got[0].mean_duration) == ("2024-01-01", "v/w", 2, 2, 4, 2, 3.0, 2.0)
    assert (got[1].runs, got[1].steps, got[1].mean_jump) == (1, 0, None) and got[0].percent == pytest.approx(200 / 3)


def plain_compare(chat, lags, unit):
    out, tracks = {}, {}
    for conv, turn, role, text in chat:
        if None not in (conv, turn, role):
            at = (len(text or ""), (text or "").count(" "))
            own = tracks.setdefault((role, conv), {})
            own[turn] = min(own.get(turn, at), at)
    for (role, _), own in tracks.items():
        p = [own[t] for t in sorted(own)]
        for lag in range(1, lags + 1):
            for a, b in zip(p, p[lag:]):
                out.setdefault((role, lag), []).append(math.dist(a, b) * unit)
    return out, tracks


def test_comparison_equals_plain_loops_and_is_replaced_whole(spark, sf_dir, tmp_path):
    chat = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hot = [(10**6, t, "user", "word " * (t % 7) + "x" * (t * t % 50)) for t in range(900)]  # most rows are of one
    odd = [(None, 1, "user", "x"), (1, None, "user", "x"), (1, 1, None, "x"), (10**6, 5, "user", "zzz"), (10**6, 5, "user", "zzz"), (77, 0, "lonely", None)]
    chat = [(a, b, c, t) for a, b, c, t in chat + hot + odd]
    path, out = str(tmp_path / "chat"), str(tmp_path / "out")
    write = lambda rows: spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3).write.mode("overwrite").parquet(path)
    write(chat)
    config = compare.load()
    compare.compare(spark, config, path, out)
    once = rows(compare.read_report(spark, out))
    compare.compare(spark, config, path, out)
    got = compare.read_report(spark, out)
    assert rows(got) == once
    jumps, tracks = plain_compare(chat, config["lags"], config["unit"])
    found = {(r.section, r.video, r["item"]): r for r in got.collect()}
    for (role, lag), d in jumps.items():
        r = found["msd", role, lag]
        assert r.n == len(d) and r.value == pytest.approx(sum(x * x for x in d) / len(d))
    assert found["size", "lonely", 0].n == 1 == found["size", "lonely", 1].n and found["size", "lonely", 0].value is None
    assert found["size", "user", 1].n == sum(len(own) for (role, _), own in tracks.items() if role == "user")
    assert found["percentiles", "user", 50].value == pytest.approx(sorted(jumps["user", 1])[len(jumps["user", 1]) // 2], abs=0.02)
    for role in {r for r, lag in jumps if lag == 1}:
        assert sum(r.n for (s, v, _), r in found.items() if (s, v) == ("jumps", role)) == len(jumps[role, 1])
    write([r for r in chat if r[2] != "lonely"])
    compare.compare(spark, config, path, out)
    assert got.sparkSession.read.schema(compare.OUT).parquet(out).where("video = 'lonely'").isEmpty()
    write([])
    compare.compare(spark, config, path, out)
    assert compare.read_report(spark, out).count() == 0


def test_pairs_by_number_equal_those_of_a_window(spark):
    shape = [("v", t, f * (1 + t % 2), float(f * f % 11), float(t), 0.0, 0) for t in range(5) for f in range(1 + 9 * t)]
    traces = spark.createDataFrame(shape, schemas.TRACES)
    got = sorted((r.traj_idx, r.frame, r.dframe, r.dx, r.dy) for r in T.lag_pairs(traces).collect())
    assert got == sorted((r.traj_idx, r.frame, r.dframe, r.dx, r.dy) for r in T.steps(traces.withColumn("run", F.lit(0))).collect())
    far = T.lag_pairs(traces, 3).groupBy("lag").count().collect()
    assert {r.lag: r["count"] for r in far} == {k: sum(max(0, 1 + 9 * t - k) for t in range(5)) for k in (1, 2, 3)}


@pytest.mark.parametrize("job, table, extra", [("recordings", "events*", ["--checkpoint"]), ("compare", "conversations", [])])
def test_command_lines(spark, sf_dir, tmp_path, job, table, extra):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = [sys.executable, "-m", f"jobs.{job}", "--input", f"{sf_dir}/{table}.parquet", "--output", str(tmp_path / "out"), *[x for e in extra for x in (e, str(tmp_path / e))]]
    run = subprocess.run(said, cwd=root, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    assert re.search(rf"jobs.{job} .*read [1-9]\d* ", run.stderr) and "wrote" in run.stderr
    left = recordings.read_report(spark, str(tmp_path / "out")) if job == "recordings" else compare.read_report(spark, str(tmp_path / "out"))
    assert left.count() > 0
