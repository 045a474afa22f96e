"""Stacks that are split within files, against the reader of whole files."""

import struct

import numpy as np
import pytest

from spotloom.sources import large, nd2, stacks


def nd2_file(pages):
    """Chunks of pictures with a time stamp each, attributes, and the map at the end."""
    out, where = bytearray(b"\xda\xce\xbe\x0a" + b"\0" * 12), {}

    def put(name, body):
        where[name] = len(out)
        out.extend(struct.pack("<IIQ", nd2.MAGIC, len(name), len(body)) + name + body)

    number = lambda key, v: (key + "\0").encode("utf-16-le") + struct.pack("<I", v)
    h, w = pages[0].shape
    put(nd2.ATTRIBUTES, b"".join(number(k, v) for k, v in (("uiWidth", w), ("uiHeight", h), ("uiComp", 1), ("uiBpcInMemory", 16), ("uiWidthBytes", 2 * w), ("eCompression", 2))))
    for i, p in reversed(list(enumerate(pages))):  # out of order
        put(nd2.PICTURE + str(i).encode() + b"!", struct.pack("<d", i * 10.0) + p.astype("<u2").tobytes())
    body = b"".join(name + struct.pack("<QQ", at, 0) for name, at in where.items()) + nd2.SIGNATURE
    at = len(out)
    out.extend(struct.pack("<IIQ", nd2.MAGIC, 0, len(body)) + body + nd2.SIGNATURE + struct.pack("<Q", at))
    return bytes(out)


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(3)
    film = rng.integers(0, 60_000, (23, 9, 7)).astype(np.uint16)
    (tmp_path / "film.tif").write_bytes(stacks.write_tiff(film, "finterval=0.5"))
    (tmp_path / "one.TIFF").write_bytes(stacks.write_tiff(film[:1]))
    (tmp_path / "wide.nd2").write_bytes(nd2_file(film[:11]))
    (tmp_path / "cut.tif").write_bytes(stacks.write_tiff(film)[:2000])
    (tmp_path / "not.nd2").write_bytes(b"nothing" * 300)
    (tmp_path / "notes.txt").write_bytes(b"x")
    return str(tmp_path)


def rows(df):
    return sorted((r.video, r.frame, r.height, r.width, tuple(r.pixels), r.description, r.error is not None) for r in df.collect())


@pytest.mark.parametrize("split", [large.SPLIT, 1500, 100])
def test_split_stacks_equal_those_read_whole(spark, folder, split):
    df = large.read_large(spark, folder, split_bytes=split)
    whole = rows(stacks.read_images(spark, folder))
    got = rows(df)
    # A damaged file that is split loses its links, so it is read, and fails, whole: with the same pictures before.
    assert got == whole and {r[0] for r in got if r[-1]} == {"cut", "not"}
    if split == 100:
        assert df.rdd.getNumPartitions() > 23 + 11
    one = large.read_large(spark, folder + "/film.tif", split_bytes=split)
    assert rows(one) == [r for r in whole if r[0] == "film"]
    assert rows(large.read_large(spark, "file://" + folder, 5, 8, split)) == [r for r in whole if 5 <= r[1] <= 8]


def test_bounds_of_frames_reach_the_source(spark, folder):
    old = spark.conf.get("spark.sql.python.filterPushdown.enabled", None)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        spark.dataSource.register(large.Stacks)
        df = spark.read.format("stack").option("splitBytes", 300).load(folder)
        whole = rows(stacks.read_images(spark, folder))
        for said, keep in (("frame > 3 and frame <= 6", lambda r: 3 < r[1] <= 6), ("frame = 2 and video = 'film'", lambda r: r[:2] == ("film", 2)), ("video in ('wide', 'one') and frame >= 1 and height > 2", lambda r: r[0] in ("wide", "one") and r[1] >= 1), ("frame = 0", lambda r: r[1] == 0), ("frame < 0", lambda r: False)):
            assert rows(df.where(said)) == [r for r in whole if keep(r)], said
        assert df.where("frame between 4 and 6 and video = 'film'").rdd.getNumPartitions() < df.where("video = 'film'").rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", old) if old is not None else spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_sparse_file_of_over_2_gb_is_read_in_place(spark, tmp_path):
    """Two pages, the second beyond what a row could hold; the file is a hole in between."""
    page = np.arange(63, dtype=np.uint16).reshape(7, 9)
    small = stacks.write_tiff(np.stack([page, page + 1]))
    order, wide, _ = stacks.tiff_start(small)
    first, second = stacks.tiff_places(small)
    far = 3 << 30
    tags = stacks.tiff_tags(small, order, wide, second)
    path = tmp_path / "big.tif"
    with open(path, "wb") as f:
        f.write(small[:second])
        f.seek(far)
        (n,) = struct.unpack_from("<H", small, second)
        f.write(small[second:])
        f.seek(first + 2 + 12 * struct.unpack_from("<H", small, first)[0])
        f.write(struct.pack("<I", far))
    assert n and tags[256] == [9] and path.stat().st_size > 2 << 30
    got = large.read_large(spark, str(path), split_bytes=1 << 30).orderBy("frame").collect()
    assert [(r.frame, r.error) for r in got] == [(1, None), (2, None)] and got[1].pixels == (page + 1).ravel().tolist()
