"""Image stacks: TIFF files read page by page, and metadata from their descriptions.

Files come through Spark's binaryFile source, so any store that Spark reads will do. A task decodes one file at a time
and yields a row for each page.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8, 16: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


class UnsupportedImage(ValueError):
    """The file is no image that can be read here."""


def take(data: bytes, form: str, at: int) -> tuple:
    """Numbers of a form at a place of data, which may be anything that can be sliced."""
    return struct.unpack(form, bytes(data[at : at + struct.calcsize(form)]))


def tiff_start(data: bytes) -> tuple[str, bool, int]:
    """Byte order, whether places have 64 bits, and the first page's place."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    kind = take(data, order + "H", 2)[0] if order else 0
    if kind not in (42, 43):
        raise UnsupportedImage("not a TIFF file")
    wide = kind == 43
    if wide and take(data, order + "HH", 4) != (8, 0):
        raise UnsupportedImage("places of another size than 8 bytes")
    return order, wide, take(data, order + ("Q" if wide else "I"), 8 if wide else 4)[0]


def tiff_places(data: bytes) -> Iterator[int]:
    """The places of all pages, read from the links between them alone."""
    order, wide, at = tiff_start(data)
    seen = set()
    while at and at not in seen:
        seen.add(at)
        yield at
        (n,) = take(data, order + ("Q" if wide else "H"), at)
        (at,) = take(data, order + ("Q" if wide else "I"), at + (8 + 20 * n if wide else 2 + 12 * n))


def tiff_tags(data: bytes, order: str, wide: bool, at: int) -> dict[int, list]:
    """The tags of the page at a place."""
    word, counter, entry, inline = ("Q", "Q", 20, 8) if wide else ("I", "H", 12, 4)
    (n,) = take(data, order + counter, at)
    first = at + struct.calcsize(counter)
    tags: dict[int, list] = {0: [order]}
    for i in range(n):
        tag, of, count = take(data, order + "HH" + word, first + entry * i)
        size = _SIZES.get(of, 1) * count
        value = first + entry * (i + 1) - inline
        place = value if size <= inline else take(data, order + word, value)[0]
        if of == 2:
            tags[tag] = [bytes(data[place : place + count]).rstrip(b"\0").decode("utf-8", "replace")]
        elif of in _CODES:
            tags[tag] = list(take(data, f"{order}{count}{_CODES[of]}", place))
        elif of == 5:
            tags[tag] = [a / b if b else 0.0 for a, b in zip(*[iter(take(data, f"{order}{2 * count}I", place))] * 2, strict=True)]
    return tags


def tiff_pages(data: bytes) -> Iterator[dict[int, list]]:
    """The tags of each page, of classic files and of those with 64-bit places."""
    order, wide, _ = tiff_start(data)
    for at in tiff_places(data):
        yield tiff_tags(data, order, wide, at)


def unpack_bits(raw: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(raw):
        c, i = raw[i], i + 1
        if c < 128:
            out += raw[i : i + c + 1]
            i += c + 1
        elif c > 128:
            out += raw[i : i + 1] * (257 - c)
            i += 1
    return bytes(out)


def unpack_lzw(raw: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, highest bit first, 256 to begin anew and 257 to end."""
    out, table, last = bytearray(), [], None
    bits, held, width = 0, 0, 9
    for byte in raw:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, last, width = [bytes([i]) for i in range(256)] + [b"", b""], None, 9
            continue
        if not table or code > len(table) or last is None and code > 255:
            raise UnsupportedImage("damaged LZW data")
        found = table[code] if code < len(table) else last + last[:1]
        out += found
        if last is not None:
            table.append(last + found[:1])
        last = found
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return bytes(out)


_UNPACK = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}


def tiff_array(data: bytes, tags: dict[int, list]) -> np.ndarray:
    """The first sample of each pixel of a page in strips or tiles, plain or packed by LZW, deflate or PackBits."""
    width, height = tags[256][0], tags[257][0]
    bits, fmt, samples = tags.get(258, [8])[0], tags.get(339, [1])[0], tags.get(277, [1])[0]
    name = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (1, 64): "u8", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}.get((fmt, bits))
    packing, ahead = tags.get(259, [1])[0], tags.get(317, [1])[0]
    if name is None or packing not in _UNPACK or ahead not in (1, 2):
        raise UnsupportedImage(f"{bits} bits of format {fmt}" if name is None else f"compression {packing}, predictor {ahead}")
    kind, apart = np.dtype(name).newbyteorder(tags[0][0]), tags.get(284, [1])[0] == 2
    each = 1 if apart else samples
    tiled = 322 in tags
    w, h = (tags[322][0], tags[323][0]) if tiled else (width, min(tags.get(278, [height])[0], height))
    places, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    across, down = -(-width // w), -(-height // h)
    out = np.zeros((down * h, across * w), np.float32)
    for i, (at, n) in enumerate(zip(places[: across * down], sizes, strict=False)):
        r, c = i // across * h, i % across * w
        rows = h if tiled else min(h, height - r)
        flat = np.frombuffer(_UNPACK[packing](bytes(data[at : at + n])), kind)[: rows * w * each]
        if len(flat) < rows * w * each:
            raise UnsupportedImage("too few pixels")
        part = flat.reshape(rows, w, each)
        if ahead == 2:
            part = np.cumsum(part.astype(kind.newbyteorder("=")), 1, dtype=kind.newbyteorder("="))
        out[r : r + rows, c : c + w] = part[:, :, 0]
    return out[:height, :width]


def write_tiff(frames: np.ndarray, description: str = "") -> bytes:
    """A multi-page TIFF of an array (pages, rows, columns), for fixtures and exports."""
    fmt, bits = {"u": 1, "i": 2, "f": 3}[frames.dtype.kind], frames.dtype.itemsize * 8
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in frames:
        text = description.encode() + b"\0"
        pixels = page.astype(frames.dtype.newbyteorder("<")).tobytes()
        text_at = len(out)
        out += text
        out += bytes(len(out) % 2)
        pixels_at = len(out)
        out += pixels
        out += bytes(len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        entries = [(256, 4, 1, page.shape[1]), (257, 4, 1, page.shape[0]), (258, 3, 1, bits), (259, 3, 1, 1), (270, 2, len(text), text_at), (273, 4, 1, pixels_at), (277, 3, 1, 1), (278, 4, 1, page.shape[0]), (279, 4, 1, len(pixels)), (339, 3, 1, fmt)]
        out += struct.pack("<H", len(entries))
        for tag, kind, count, value in entries:
            inline = kind == 2 and count <= 4
            out += struct.pack("<HHI", tag, kind, count) + (text.ljust(4, b"\0") if inline else struct.pack("<I", value))
        link = len(out)
        out += bytes(4)
    return bytes(out)


FRAMES = "video string, frame int, height int, width int, pixels array<float>, description string, error string"


def _rows(video: str, decode: Callable[[bytes], Iterator[tuple[np.ndarray, str | None]]], content: bytes) -> Iterator[pd.DataFrame]:
    """A row for each picture of a file; an unreadable one ends in a row of frame 0 that says why."""
    i = 0
    try:
        for i, (a, said) in enumerate(decode(content), 1):
            yield pd.DataFrame({"video": [video], "frame": [i], "height": [a.shape[0]], "width": [a.shape[1]], "pixels": [a.ravel()], "description": [said], "error": [None]})
        if not i:
            raise UnsupportedImage("no pictures")
    except (UnsupportedImage, struct.error, KeyError, IndexError, zlib.error, ValueError) as e:
        yield pd.DataFrame({"video": [video], "frame": [0], "height": [0], "width": [0], "pixels": [np.zeros(0, np.float32)], "description": [None], "error": [str(e) or type(e).__name__]})


def _tiff(content: bytes) -> Iterator[tuple[np.ndarray, str | None]]:
    for tags in tiff_pages(content):
        yield tiff_array(content, tags), tags.get(270, [None])[0]


def _nd2(content: bytes) -> Iterator[tuple[np.ndarray, str | None]]:
    from spotloom.sources import nd2

    for a in nd2.frames(content):
        yield a, None


def _other(content: bytes) -> Iterator[tuple[np.ndarray, str | None]]:
    raise UnsupportedImage("neither .tif, .tiff nor .nd2")


def read_images(spark: SparkSession, path: str, glob: str = "*", others: bool = False) -> DataFrame:
    """Frames (video, frame from 1, height, width, pixels, description, error) of all TIFF and ND2 files under a path.

    The reader is chosen by the name's ending, in either case. Files that can't be read have a row of frame 0 whose error
    says why; with others=True, so do files of other kinds, which are left out otherwise. A file is a row of Spark's
    binaryFile source, so it has 2 GB at most.
    """
    return decoded(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path), others)


def decoded(files: DataFrame, others: bool = False) -> DataFrame:
    """Frames of files that are rows of path and content, at rest or as a stream."""
    if not others:
        files = files.where(F.lower("path").rlike(r"\.(tiff?|nd2)$"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, content in zip(batch.path, batch.content, strict=True):
                name = where.rsplit("/", 1)[-1]
                stem, _, ending = name.rpartition(".")
                decode = {"tif": _tiff, "tiff": _tiff, "nd2": _nd2}.get(ending.lower(), _other)
                yield from _rows(stem if decode is not _other else name, decode, content)

    return files.select("path", "content").mapInPandas(run, FRAMES)


def read_stacks(spark: SparkSession, path: str, glob: str = "*.{tif,tiff,TIF,TIFF}") -> DataFrame:
    """read_images of TIFF files."""
    return read_images(spark, path, glob)


def read_dump(content: bytes, height: int, width: int) -> np.ndarray:
    """Pictures of a file that is nothing but 32-bit floats."""
    flat = np.frombuffer(content, "<f4")
    if len(flat) % (height * width):
        raise UnsupportedImage(f"{len(flat)} numbers are no whole pictures of {height} by {width}")
    return flat.reshape(-1, height, width)


def centre(frames: DataFrame, n: int = 50) -> DataFrame:
    """The n pictures in the middle of each video."""
    total = frames.where("frame > 0").groupBy("video").agg(F.max("frame").alias("_total"))
    start = F.greatest(F.lit(0), F.floor(F.col("_total") / 2) - n // 2)
    return frames.join(total, "video").where((F.col("frame") > start) & (F.col("frame") <= start + n)).drop("_total")


def metadata(description: str) -> dict[str, float]:
    """Frame interval and exposure in seconds, pixel size, and their ratio R where it lies in (0, 1.01]."""
    out: dict[str, float] = {}
    number = r"([0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)"
    if m := re.search(rf"finterval=\s*{number}", description):
        out["interval"] = float(m[1])
    if m := re.search(rf"Exposure\s*=\s*{number}\s*ms", description) or re.search(rf"Exposure time \(text\)\s*[:=]\s*{number}\s*ms", description):
        out["exposure"] = float(m[1]) / 1000
    if m := re.search(rf"dCalibration\s*[:=]\s*{number}", description):
        out["pixel_um"] = float(m[1])
    if out.get("interval") and "exposure" in out and 0 < (r := out["exposure"] / out["interval"]) <= 1.01:
        out["R"] = min(1.0, r)
    return out
