"""Files in and out: packings of TIFF, readers by ending, tables beside each other, the whole run and the command line."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotloom import schemas
from spotloom.functions import register
from spotloom.operators import graph, image
from spotloom.plans import run as plan
from spotloom.operators import estimators
from spotloom.sources import pictures, shapes, stacks, tables


def pack_lzw(data: bytes) -> bytes:
    """Codes as the reader expects them: begin, table from 258, one bit wider an entry early."""
    out, held, bits, width = bytearray(), 0, 0, 9
    table = {bytes([i]): i for i in range(256)}
    size = 258

    def put(code):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256)
    word = b""
    for b in data:
        if word + bytes([b]) in table:
            word += bytes([b])
            continue
        put(table[word])
        table[word + bytes([b])] = size
        size += 1
        if size == 4094:
            put(256)
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        elif size in (512, 1024, 2048):
            width += 1
        word = bytes([b])
    if word:
        put(table[word])
    if size + 1 in (512, 1024, 2048):
        width += 1
    put(257)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def tiff(page: np.ndarray, packing: int = 1, tile: int = 0, wide: bool = False, ahead: bool = False) -> bytes:
    """One page, packed and cut as asked."""
    height, width = page.shape
    rows = page.astype(np.int64)
    if ahead:
        rows = np.diff(rows, axis=1, prepend=0)
    pack = {1: bytes, 5: pack_lzw, 8: zlib.compress}[packing]
    as_bytes = lambda a: pack((a % (1 << 16)).astype("<u2").tobytes())
    if tile:
        whole = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile), np.int64)
        whole[:height, :width] = page
        cut = [whole[r : r + tile, c : c + tile] for r in range(0, whole.shape[0], tile) for c in range(0, whole.shape[1], tile)]
        parts = [as_bytes(np.diff(x, axis=1, prepend=0) if ahead else x) for x in cut]
    else:
        parts = [as_bytes(rows[r : r + 5]) for r in range(0, height, 5)]
    out = bytearray(b"II" + (struct.pack("<HHHQ", 43, 8, 0, 0) if wide else struct.pack("<HI", 42, 0)))
    places = []
    for p in parts:
        places.append(len(out))
        out += p
    word = "Q" if wide else "I"

    def listed(values):
        if len(values) * struct.calcsize(word) <= (8 if wide else 4):
            return struct.pack("<" + word * len(values), *values)
        at = len(out)
        out.extend(struct.pack("<" + word * len(values), *values))
        return struct.pack("<" + word, at)

    kind = 16 if wide else 4
    names = (324, 325) if tile else (273, 279)
    tags = [(256, kind, [width]), (257, kind, [height]), (258, kind, [16]), (259, kind, [packing]), (277, kind, [1]), (317, kind, [2 if ahead else 1])]
    tags += [(322, kind, [tile]), (323, kind, [tile])] if tile else [(278, kind, [5])]
    tags += [(names[0], kind, places), (names[1], kind, [len(p) for p in parts])]
    entries = b"".join(struct.pack("<HH" + word, t, k, len(v)) + listed(v) for t, k, v in sorted(tags))
    at = len(out)
    out += struct.pack("<Q" if wide else "<H", len(tags)) + entries + struct.pack("<" + word, 0)
    struct.pack_into("<" + word, out, 8 if wide else 4, at)
    return bytes(out)


@pytest.mark.parametrize("packing", [1, 5, 8])
@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("ahead", [False, True])
def test_pages_are_read_however_they_are_packed(packing, tile, wide, ahead):
    page = np.random.default_rng(packing).integers(0, 4000, (37, 41)) + np.arange(41) * 30
    content = tiff(page, packing, tile, wide, ahead)
    (tags,) = stacks.tiff_pages(content)
    assert (stacks.tiff_array(content, tags) == page).all()
    with pytest.raises((stacks.UnsupportedImage, struct.error, zlib.error)):
        for tags in stacks.tiff_pages(content[: len(content) // 2]):
            stacks.tiff_array(content[: len(content) // 2], tags)


def test_long_lzw_data():
    data = np.random.default_rng(1).integers(0, 40, 60_000).astype(np.uint8).tobytes()
    assert stacks.unpack_lzw(pack_lzw(data)) == data


def test_readers_are_chosen_by_ending(spark, tmp_path):
    page = np.arange(30).reshape(5, 6)
    (tmp_path / "a.TIF").write_bytes(tiff(page))
    (tmp_path / "b.tiff").write_bytes(tiff(page)[:40])
    (tmp_path / "c.txt").write_bytes(b"no picture")
    got = {r.video: r for r in stacks.read_images(spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "b"} and list(got["a"].pixels) == page.ravel().tolist() and got["b"].error
    frames = stacks.read_images(spark, str(tmp_path), others=True)
    assert {r.video: r.error for r in frames.collect()}["c.txt"].startswith("neither")
    tables.write_errors(frames, str(tmp_path / "log"))
    tables.write_errors(frames, str(tmp_path / "log"))
    said = [r.value for r in spark.read.text(str(tmp_path / "log")).collect()]
    assert len(said) == 4 and any("] c.txt - reading: neither" in x for x in said)
    many = spark.createDataFrame([("v", i, None) for i in range(1, 121)] + [("w", i, None) for i in range(1, 8)], "video string, frame int, error string")
    kept = {r.video: (r.a, r.b) for r in stacks.centre(many).groupBy("video").agg(F.min("frame").alias("a"), F.max("frame").alias("b")).collect()}
    assert kept == {"v": (36, 85), "w": (1, 7)}
    assert (stacks.read_dump(np.arange(24, dtype="<f4").tobytes(), 3, 4) == np.arange(24).reshape(2, 3, 4)).all()


def test_files_beside_each_other(spark, tmp_path):
    (tmp_path / "v_traces.csv").write_text("traj_idx,frame,x,y\n1,1,0.5,0.5\n1,1,0.7,0.5\n2,1,3,4\n")
    (tmp_path / "v_diffusion.csv").write_text("traj_idx,H,K\n1,0.4,0.2\n")
    (tmp_path / "v_loc.csv").write_text("frame,x,y\n1,0,0\n")
    (tmp_path / "v.tif").write_bytes(b"")
    (tmp_path / "v_roi_2_traces.csv").write_text("traj_idx,frame,x,y,state\n7,2,1,1,3\n")
    root = f"file://{tmp_path}"
    found = tables.siblings(spark, f"{root}/v_roi_2_traces.csv")
    assert found == {"loc": f"{root}/v_loc.csv", "video": f"{root}/v.tif"}
    got = tables.read_datasets(spark, [f"{root}/v_traces.csv", f"{root}/v_roi_2_traces.csv", f"{root}/v_traces.csv"]).orderBy("video", "traj_idx", "x").collect()
    assert [(r.video, r.traj_idx, r.x, r.state, r.H) for r in got] == [("v", 1, 0.5, 0, 0.4), ("v", 1, 0.7, 0, 0.4), ("v", 2, 3.0, 0, None), ("v_roi_2", 7, 1.0, 3, None)]
    loc = spark.createDataFrame([(1,), (3,)], "frame int")
    assert sorted(r.frame for r in tables.union_batches([loc, loc, loc], [5, 4, 9]).collect()) == [1, 3, 6, 8, 10, 12]


def test_json_colours_and_pictures(spark, tmp_path):
    drawn = [{"type": "rect", "x1": 1.0, "y1": 2.0, "x2": 3.0, "y2": 4.0, "angle": 5.0}, {"type": "line", "p1": [0.0, 1.0], "p2": [2.0, 3.0]}]
    tables.write_json(spark, str(tmp_path / "s.json"), shapes=drawn)
    assert [r.type for r in shapes.read_shapes(spark, str(tmp_path / "s.json")).collect()] == ["rect", "line"]
    lines = [[(0.1, -1.0), (0.5, 2.0)]]
    tables.write_json(spark, str(tmp_path / "b.json"), boundaries=lines)
    assert shapes.boundaries((tmp_path / "b.json").read_text()) == lines
    assert pictures.read_colours(bytes(range(7))).tolist() == [[0, 1, 2], [3, 4, 5]]
    density = spark.createDataFrame([(0, 0, 1.0), (9, 9, 2.0), (50, 1, 9.0)], "i int, j int, density double")
    assert pictures.hk_picture(density, 10, 2)[:8] == b"\x89PNG\r\n\x1a\n"
    with pytest.raises(ValueError):
        pictures.hk_picture(density, 1 << 20)
    scan = spark.createDataFrame([(0, 1, 0.5, 0.1, True)], "state int, delta int, H_estim double, H_std double, converged boolean")
    tables.write_scan(scan, str(tmp_path / "scan"), K=0.2, R=None)
    assert (tmp_path / "scan" / "state=0").is_dir() and (tmp_path / "scan" / "_notes.json").read_text() == '{"K": 0.2, "R": null}'


def test_helpers_in_sql(spark):
    assert len(register.register(spark)) == len(register.HELPERS)
    got = spark.sql("select spot_distance(0, 0, 3, 4) as d, spot_polar(1, 0, 0, -1) as p, ratio_location(0.5) as r, nearest_half(2.5) as h, thompson_error(1.3, 0.16, 100, 2) as t").first()
    assert (got.d, got.p, got.r, got.h) == (5.0, 270.0, 0.0, 2.0) and got.t == pytest.approx(1.57, abs=2)


def test_nodes_of_crowded_frames_are_kept_apart(spark):
    """Spot 2^20 of a frame is no spot of the next."""
    big = 1 << 20
    loc = spark.createDataFrame([("v", 1, big, 0.0), ("v", 2, 0, 50.0), ("v", 2, 5, 0.0), ("v", 3, 0, 50.0)], "video string, frame int, spot_idx int, x double").withColumn("y", F.lit(0.0)).withColumn("z", F.lit(0.0))
    parts = {}
    for r in graph.components(loc, graph.candidate_edges(loc, 2.0, 1)).collect():
        parts.setdefault(r.component, set()).add((r.frame, r.spot_idx))
    assert sorted(map(sorted, parts.values())) == [[(1, big), (2, 5)], [(2, 0), (3, 0)]]


def test_background_from_raw_pictures(spark):
    rng = np.random.default_rng(0)
    raw = rng.integers(0, 100, (20, 20)).astype(np.float32)
    frames = spark.createDataFrame([("v", 1, 20, 20, raw.ravel().tolist())], "video string, frame int, height int, width int, pixels array<float>")
    loc = schemas.conform(spark.createDataFrame([("v", 1, 0, 8.5, 9.5, 7), ("v", 1, 1, 0.0, 0.0, 5)], "video string, frame int, spot_idx int, x double, y double, window_size int"), schemas.LOC)
    got = {r.spot_idx: r for r in image.recomputed_background(frames, loc).collect()}
    for i, (cx, cy, w) in enumerate([(8, 10, 7), (0, 0, 5)]):
        y, x = np.mgrid[max(0, cy - 6) : min(20, cy + 7), max(0, cx - 6) : min(20, cx + 7)]
        ring = raw[y, x][(y - cy) ** 2 + (x - cx) ** 2 > 9].astype(float)
        core = raw[max(0, cy - w // 2) : cy + w // 2 + 1, max(0, cx - w // 2) : cx + w // 2 + 1].astype(float)
        assert got[i].bg_median == np.median(ring) and got[i].bg_var == pytest.approx(ring.var()) and got[i].integrated_flux == pytest.approx(core.sum() - core.size * np.median(ring))


def test_the_whole_run_and_the_command_line(spark, tmp_path):
    from spotloom.__main__ import main

    yy, xx = np.mgrid[:40, :40]
    stack = np.stack([100 + 5 * np.sin(1.7 * xx + 2.3 * yy) + sum(900 * np.exp(-((xx - cx - 0.5 * f) ** 2 + (yy - cy) ** 2) / 4) for cx, cy in ((8, 8), (12, 28))) for f in range(8)]).astype(np.float32)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "film.tif").write_bytes(stacks.write_tiff(stack))
    (tmp_path / "in" / "broken.tif").write_bytes(b"II*\0")
    told = []
    out = plan.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), plan.Options(jump=3.0, progress=lambda p, label: told.append(p)))
    assert told == sorted(told) and told[-1] == 100
    lengths = sorted(r["count"] for r in out["traces"].groupBy("video", "traj_idx").count().collect())
    assert lengths[-2:] == [8, 8] and out["diffusion"].count() == len(lengths)
    assert "broken" in spark.read.text(str(tmp_path / "out" / "errors")).first().value
    assert main(["run", str(tmp_path / "in"), str(tmp_path / "cli"), "--jump", "3", "--quiet", "--postprocess"], spark) == 1
    assert main(["localize", str(tmp_path / "in" / "film.tif"), str(tmp_path / "loc"), "--quiet"], spark) == 0
    assert list((tmp_path / "cli" / "traces").glob("video=film/*.csv")) and list((tmp_path / "loc" / "loc").glob("video=film/*.csv"))
    source = next((tmp_path / "loc" / "loc").glob("video=film/*.csv"))
    (tmp_path / "film_loc.csv").write_bytes(source.read_bytes())
    assert main(["track", str(tmp_path / "film_loc.csv"), str(tmp_path / "tracks"), "--jump", "3", "--quiet"], spark) == 0
    assert list((tmp_path / "tracks" / "traces").glob("video=film/*.csv"))


def test_statistics_by_state(spark):
    rng = np.random.default_rng(4)
    rows = [("v", t, f, *map(float, p), 0.0, t % 2) for t in range(40) for f, p in enumerate(np.cumsum(rng.normal(0, 1, (60, 2)), 0))]
    rows += [("v", 99, f, 0.0, 0.0, 0.0, 7) for f in range(5)]
    got = plan.statistics(spark.createDataFrame(rows, schemas.TRACES), 0.1)
    assert set(got["k"]) == {0, 1} and all(0.2 < k < 1 for k in got["k"].values())
    assert {r.state for r in got["significance"].collect()} == {0, 1} == {r.state for r in got["drift"].collect()}
    for state, k in got["k"].items():  # all at once gives what each state gives by itself
        own = spark.createDataFrame([r for r in rows if r[6] == state], schemas.TRACES)
        assert estimators.fit_k(own, 0.1) == pytest.approx((k, estimators.fit_k(own, 0.1)[1]))
        alone = {r.delta: (r.H_estim, r.H_std, r.n_ratios) for r in estimators.multi_delta_scan(own, k, 0.1).collect()}
        assert {r.delta: (r.H_estim, r.H_std, r.n_ratios) for r in got["scan"].where(F.col("state") == state).collect()} == {d: pytest.approx(v, rel=1e-5) for d, v in alone.items()}
    assert {r.state for r in got["snr"].collect()} == {0, 1, 7} and got["pairs"].where("p < 0 or p > 1").isEmpty()


def test_statistics_of_more_than_a_hundred_states(spark):
    from spotloom.plans import run as plan

    rng = np.random.default_rng(4)
    rows = [("v", 6 * s + t, f, *map(float, p), 0.0, s) for s in range(120) for t in range(6) for f, p in enumerate(np.cumsum(rng.normal(0, 1 + s % 3, (20, 2)), 0))]
    got = plan.statistics(spark.createDataFrame(rows, schemas.TRACES), 0.1)
    assert set(got["k"]) == set(range(120)) == {r.state for r in got["scan"].select("state").distinct().collect()}
