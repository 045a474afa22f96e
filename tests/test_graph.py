"""Reachability and removal on edge tables, against plain walks over dense random graphs."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spotloom.functions import geometry as G
from spotloom.operators import graph


@pytest.fixture(params=[0, 1, 2])
def dense(request, spark):
    rng = np.random.default_rng(request.param)
    at = {(v, f, i): (*rng.uniform(0, 9, 2).tolist(), 0.0) for v in ("a", "b") for f in range(1, 13) for i in range(rng.integers(0, 5))}
    loc = spark.createDataFrame([(*n, *p) for n, p in at.items()], "video string, frame int, spot_idx int, x double, y double, z double")
    edges = {(n, m) for n, m in itertools.product(at, at) if n[0] == m[0] and 0 < m[1] - n[1] <= 3 and math.dist(at[n], at[m]) < 4.0}
    return at, loc, edges, graph.candidate_edges(loc, 4.0, 2).repartition(3)


@pytest.mark.parametrize("most", [1, 4, 13])
def test_ancestors_equal_a_plain_walk(spark, dense, most):
    at, loc, edges, table = dense
    before = {n: {a for a, b in edges if b == n} for n in at}
    want = set()
    for n in at:
        seen, todo = set(), [n]
        while todo:
            for a in before[todo.pop()] - seen:
                seen.add(a)
                todo.append(a)
        want |= {(*n, a[1], a[2], i) for i, a in enumerate(sorted(seen, key=lambda a: (-a[1], -a[2]))[:most], 1)}
    got = [tuple(r) for r in graph.ancestors(table, loc, most).select("video", "frame", "spot_idx", "a_frame", "a_idx", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_removal_bypasses_one_after_the_other(spark, dense):
    at, loc, edges, table = dense
    for keep in (0, 1, 2):
        gone = sorted((n for n in at if hash((n[1], n[2])) % 3 != keep), key=lambda n: n[1])
        left = set(edges)
        for n in gone:
            into, out = {a for a, b in left if b == n}, {b for a, b in left if a == n}
            left = {e for e in left if n not in e} | {(a, b) for a in into for b in out if math.dist(at[a], at[b]) < 4.0}
        removed = spark.createDataFrame(gone, "video string, frame int, spot_idx int")
        got = [tuple(r) for r in graph.without(table, removed, loc, 4.0).select("video", "src_frame", "src_idx", "dst_frame", "dst_idx").collect()]
        assert sorted(got) == sorted((*a, *b[1:]) for a, b in left) and len(got) == len(set(got))
    assert graph.without(table, removed.where("false"), loc, 4.0).count() == len(edges)


def test_terminal_spots_among_the_free(spark, dense):
    at, loc, edges, table = dense
    nearest = {min((b for a, b in edges if a == n), key=lambda b: (round(math.dist(at[n], at[b]), 6), b)) for n in at if any(a == n for a, _ in edges)}
    assert {tuple(r) for r in graph.nearest_successors(table).collect()} == nearest
    got = {tuple(r) for r in graph.terminal_among_free(loc, table, graph.nearest_successors(table)).collect()}
    assert got == {n for n in at if not any(a == n and b not in nearest for a, b in edges)}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spots_are_merged_and_never_broadcast(spark, dense):
    at, loc, edges, table = dense
    near = graph.candidate_edges(loc, 4.0, 2)
    for df in (near, graph.orphans(loc, near), graph.terminal_among_free(loc, near, graph.nearest_successors(near)), graph.bypass_edges(near, loc, loc, 4.0), graph.adjacent_pairs(loc)):
        assert "BroadcastHashJoin" not in _plan(df) and "SortMergeJoin" in _plan(df)


def test_edges_by_blocks_of_frames_and_cells_meet_once(spark, dense):
    at, loc, edges, table = dense
    for grid in (True, False):
        got = [tuple(r) for r in graph.candidate_edges(loc, 4.0, 2, grid).select("video", "src_frame", "src_idx", "dst_frame", "dst_idx").collect()]
        assert sorted(got) == sorted((*a, *b[1:]) for a, b in edges)
    assert "gx" in _plan(graph.candidate_edges(loc, 4.0, 2)) and "block" in _plan(graph.candidate_edges(loc, 4.0, 2))


@pytest.mark.parametrize("kind", ["plain", "ties", "one place"])
def test_threshold_without_pairs_equals_that_of_all_pairs(spark, kind):
    rng = np.random.default_rng(3)
    value = {"plain": lambda: float(rng.normal(0, 40)), "ties": lambda: round(float(rng.exponential(50)), 0), "one place": lambda: 7.0}[kind]
    rows = [("v", f, i, value(), 0.0, 0.0) for f in (1, 2, 4, 9) for i in range(30)] + [("w", 3, 0, 1e6, 0.0, 0.0), ("v", 2, 30, None, 0.0, 0.0)]
    loc = spark.createDataFrame(rows, "video string, frame int, spot_idx int, x double, y double, z double")
    want = graph.jump_threshold(graph.adjacent_pairs(loc), "dx").first().threshold
    assert graph.jump_threshold_of(loc, "x").first().threshold == pytest.approx(want, rel=1e-9)
    assert graph.jump_threshold_of(loc.where("frame = 1"), "x").first().threshold is None


def test_ancestors_take_equal_edges_once(spark):
    edges = spark.createDataFrame([("v", 1, 0, 3, 0), ("v", 1, 0, 3, 0), ("v", 2, 0, 3, 0), ("v", 2, 0, 3, 0), ("v", 0, 5, 1, 0)], "video string, src_frame int, src_idx int, dst_frame int, dst_idx int")
    nodes = spark.createDataFrame([("v", 3, 0)], "video string, frame int, spot_idx int")
    got = sorted((r.a_frame, r.a_idx, r["rank"]) for r in graph.ancestors(edges, nodes, 3).collect())
    assert got == [(0, 5, 3), (1, 0, 2), (2, 0, 1)]


SPOTS = "video string, frame int, spot_idx int, x double, y double, z double"


def test_pairs_by_tiles_equal_all_pairs_and_a_crowded_frame_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(graph, "TILE", 4)
    monkeypatch.setattr(graph, "TILES", 2)
    rng = np.random.default_rng(4)
    sizes = {("v", 1): 3, ("v", 2): 8, ("v", 5): 9, ("v", 6): 33, ("v", 7): 4, ("w", 2): 1, ("w", 9): 17, ("one", 1): 5}
    rows = [(v, f, i, *rng.integers(0, 4, 2).astype(float).tolist(), 0.0) for (v, f), n in sizes.items() for i in range(n)]
    rows += [("v", 5, 0, 1.0, 1.0, 1.0), ("v", 5, 99, None, 1.0, None), ("v", None, 0, 1.0, 1.0, 1.0), (None, 3, 0, 1.0, 1.0, 1.0), (None, 4, 0, 1.0, 1.0, 1.0)]
    nxt = {("v", 1): 2, ("v", 2): 5, ("v", 5): 6, ("v", 6): 7, ("w", 2): 9}
    want = [(a[0], a[1], a[2], b[1], b[2], *((None, None) if None in (a[3], b[3]) else (b[3] - a[3], round(math.dist(a[3:], b[3:]), 9)))) for a in rows for b in rows if a[0] == b[0] and b[1] is not None and nxt.get(a[:2]) == b[1]]
    pairs = graph.adjacent_pairs(spark.createDataFrame(rows, SPOTS)).withColumn("task", F.spark_partition_id())
    got = [(*r[:5], r.dx, None if r.d is None else round(r.d, 9), r.task) for r in pairs.collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r[1:])
    assert sorted((r[:-1] for r in got), key=lambda r: (r[0], key(r))) == sorted(want, key=lambda r: (r[0], key(r)))
    assert len({r[-1] for r in got if r[:2] == ("v", 5)}) > 1


def test_pairs_take_few_bytes_in_files(spark, tmp_path):
    rng = np.random.default_rng(5)
    spots = [("v", f, i, float(rng.integers(0, 8)), float(rng.integers(0, 8)), 0.0) for f in (1, 2) for i in range(1501)]
    graph.adjacent_pairs(spark.createDataFrame(spots, SPOTS)).drop("dx", "dy").write.parquet(str(tmp_path / "pairs"))
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.5 * 1501**2


def test_lengths_are_rounded_as_doubles(spark):
    values = [0.0, 0.00005, 0.00015, 0.12344999, 1.5, 29.27, 12345.67895, 0.49999999999999994e-4, 1e13, math.inf, math.nan, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "d double").select(G.rounded(F.col("d"), 4)).collect()]
    half_up = lambda p: math.floor(p) + (p - math.floor(p) >= 0.5)
    assert got[:9] == [half_up(v * 1e4) / 1e4 for v in values[:9]]
    assert got[9] == math.inf and math.isnan(got[10]) and got[11] is None


@pytest.mark.parametrize("limit, by_rounds", [(1 << 30, False), (40, False), (2, True)])
def test_components_contract_slabs_and_need_no_rounds(spark, monkeypatch, limit, by_rounds):
    rng = np.random.default_rng(7)
    at = [(v, f, i) for v in "ab" for f in range(100) for i in range(4)]
    edges = [(v, f, int(rng.integers(4)), f + int(rng.integers(1, 4)), int(rng.integers(4))) for v in "ab" for f in range(96) for _ in range(2) if f != 50]
    parent = {n: n for n in at}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for v, f, i, g, j in edges:
        a, b = find((v, f, i)), find((v, g, j))
        parent[max(a, b)] = min(a, b)
    monkeypatch.setattr(graph, "EDGES_TOGETHER", limit)
    monkeypatch.setattr(graph, "SLAB", 8)
    rounds, labels = [], graph._labels
    monkeypatch.setattr(graph, "_labels", lambda e: rounds.append(e) or labels(e))
    table = spark.createDataFrame(edges, "video string, src_frame int, src_idx int, dst_frame int, dst_idx int")
    got = {tuple(r)[:3]: r.component for r in graph.components(spark.createDataFrame(at, "video string, frame int, spot_idx int"), table).collect()}
    assert got == {n: find(n)[1] * (1 << graph.SPOT_BITS) + find(n)[2] for n in at}
    assert by_rounds or not rounds


def test_stars_are_found_at_once_whatever_the_order():
    order = np.random.default_rng(8).permutation(5000)
    edges = [pd.DataFrame({"video": v, "u": order, "v": order + 1}) for v in ("a", "b")]
    got = pd.concat(graph._stars(iter(edges)))
    assert len(got) == 2 * 5001 and set(got.root) == {0} and set(got.video) == {"a", "b"}


@pytest.mark.parametrize("block", [4096, 5])
def test_all_ancestors_are_found_by_blocks(spark, dense, monkeypatch, block):
    monkeypatch.setattr(graph, "ANCESTORS", block)
    at, loc, edges, table = dense
    before = {n: {a for a, b in edges if b == n} for n in at}
    want = set()
    for n in at:
        seen, todo = set(), [n]
        while todo:
            for a in before[todo.pop()] - seen:
                seen.add(a)
                todo.append(a)
        want |= {(*n, a[1], a[2], i) for i, a in enumerate(sorted(seen, key=lambda a: (-a[1], -a[2])), 1)}
    assert max(w[-1] for w in want) > 13
    got = [tuple(r) for r in graph.ancestors(table.unionByName(table.limit(5)), loc).select("video", "frame", "spot_idx", "a_frame", "a_idx", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    some = [tuple(r)[:3] for r in graph.ancestors(table, loc.where("spot_idx = 1")).collect()]
    assert sorted(some) == sorted(w[:3] for w in want if w[2] == 1)


def test_query_of_ancestors_keeps_them_all(spark, tmp_path):
    from spotloom.plans import spot_queries

    n = 16  # spots of one place, an hour apart, so that the last has 15 ancestors
    spark.range(n).selectExpr("id as event_id", "timestamp'2024-01-01 00:10:00' + make_interval(0, 0, 0, 0, cast(id as int)) as ts", "0L as user_id", "'view' as event_type", "1.0D as value", "'{}' as props").write.parquet(str(tmp_path / "events.parquet"))
    got = spot_queries.QUERIES["ancestors"](spark, str(tmp_path))
    assert got.count() == n * (n - 1) // 2 and got.agg(F.max("rank")).first()[0] == n - 1


@pytest.mark.parametrize("steps", [1, 1 << 30])
def test_bypasses_of_crowded_spots_are_told_apart_where_they_meet(spark, dense, monkeypatch, steps):
    monkeypatch.setattr(graph, "STEPS", steps)
    at, loc, edges, table = dense
    want = {(a, d) for a, b in edges for c, d in edges if b == c and b[2] != 1}
    gone = loc.where("spot_idx <> 1")
    got = [tuple(r)[:5] for r in graph.bypass_edges(table, gone.unionByName(gone), loc, 4.0).collect()]
    assert sorted(got) == sorted((*a, *d[1:]) for a, d in want if math.dist(at[a], at[d]) < 4.0)


@pytest.mark.parametrize("paths", [3, 1 << 30])
def test_no_row_leaves_a_group_for_each_path(monkeypatch, paths):
    monkeypatch.setattr(graph, "PATHS", paths)
    into = pd.DataFrame([("v", u, m) for u in (1, 2, 3) for m in range(10, 40)] + [("w", 1, 10), ("w", 1, 99)], columns=["video", "u", "m"])
    onward = pd.DataFrame([("v", m, v) for m in range(10, 40) for v in (50, 60)] + [("w", 11, 50)], columns=["video", "m", "v"])
    got = list(graph._met(into, onward).itertuples(index=False, name=None))
    assert sorted(got) == [("v", u, v) for u in (1, 2, 3) for v in (50, 60)]
    assert not len(graph._met(into[:0], onward)) and not len(graph._met(into, onward[:0]))
