"""ND2 stacks with a chunk map: frames of the first channel, uncompressed."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from spotloom.sources.stacks import UnsupportedImage, read_images, take

# Fixed values of the format: the magic number of a chunk, that of the older JPEG 2000 files, the signature before the
# chunk map's place, and the names of chunks and attributes.
MAGIC, JPEG2000 = 0x0ABECEDA, b"\x00\x00\x00\x0cjP  "
SIGNATURE = b"ND2 CHUNK MAP SIGNATURE 0000001!"
ATTRIBUTES, PICTURE = b"ImageAttributesLV!", b"ImageDataSeq|"
CALIBRATION, TEXT = b"ImageCalibrationLV|0!", b"ImageTextInfoLV!"


def chunk(data: memoryview, at: int) -> memoryview:
    """The body of the chunk at a place."""
    magic, name, size = take(data, "<IIQ", at)
    if magic != MAGIC or at + 16 + name + size > len(data):
        raise UnsupportedImage(f"no chunk at {at}")
    return data[at + 16 + name : at + 16 + name + size]


def chunk_map(data: memoryview) -> dict[bytes, int]:
    """Places of the chunks by name."""
    if bytes(data[:8]) == JPEG2000:
        raise UnsupportedImage("ND2 of the older, JPEG 2000 kind")
    if len(data) < 56 or bytes(data[-40:-8]) != SIGNATURE:
        raise UnsupportedImage("no ND2 chunk map")
    body = bytes(chunk(data, struct.unpack("<Q", data[-8:])[0]))
    out, at = {}, 0
    while (end := body.find(b"!", at)) >= 0 and end + 17 <= len(body):
        name = body[at : end + 1]
        if name == SIGNATURE:
            break
        out[name], at = struct.unpack_from("<Q", body, end + 1)[0], end + 17
    return out


def attribute(body: bytes, key: str, default: int | None = None) -> int:
    """An unsigned number that follows its UTF-16 name."""
    at = body.find((key + "\0").encode("utf-16-le"))
    if at < 0:
        if default is None:
            raise UnsupportedImage(f"no {key}")
        return default
    return struct.unpack_from("<I", body, at + 2 * len(key) + 2)[0]


def places(where: dict[bytes, int]) -> list[int]:
    """Places of the pictures, in order."""
    return [at for _, at in sorted((int(n[len(PICTURE) : -1]), at) for n, at in where.items() if n.startswith(PICTURE) and n[len(PICTURE) : -1].isdigit())]


@dataclass(frozen=True)
class Layout:
    """How a picture's bytes lie: its size, the bytes of a row, samples a pixel and their kind."""

    height: int
    width: int
    row: int
    channels: int
    kind: str


def layout(data: memoryview, where: dict[bytes, int]) -> Layout:
    if ATTRIBUTES not in where:
        raise UnsupportedImage("no attributes")
    about = bytes(chunk(data, where[ATTRIBUTES]))
    if attribute(about, "eCompression", 2) not in (2, 0xFFFFFFFF):
        raise UnsupportedImage("compressed pictures")
    width, height = attribute(about, "uiWidth"), attribute(about, "uiHeight")
    channels, bits = attribute(about, "uiComp", 1), attribute(about, "uiBpcInMemory", 16)
    kind = {8: "<u1", 16: "<u2", 32: "<f4"}.get(bits)
    if kind is None:
        raise UnsupportedImage(f"{bits} bits a sample")
    return Layout(height, width, attribute(about, "uiWidthBytes", width * channels * bits // 8), channels, kind)


def picture(data: memoryview, of: Layout, at: int) -> np.ndarray:
    """The first channel of the picture at a place."""
    pixels = bytes(chunk(data, at)[8:])  # a time stamp stands first
    used = of.width * of.channels * np.dtype(of.kind).itemsize
    rows = np.frombuffer(pixels[: of.row * of.height], np.uint8).reshape(of.height, of.row)[:, :used]
    return np.ascontiguousarray(rows).view(of.kind).reshape(of.height, of.width, of.channels)[:, :, 0].astype(np.float32)


def frames(content: bytes) -> Iterator[np.ndarray]:
    data = memoryview(content)
    where = chunk_map(data)
    of = layout(data, where)
    for at in places(where):
        yield picture(data, of, at)


def _stamps(data: memoryview, where: dict[bytes, int], most: int = 50) -> list[float]:
    return [struct.unpack_from("<d", chunk(data, at))[0] for at in places(where)[:most]]


def metadata(content: bytes) -> dict[str, float]:
    """Pixel size in µm, frame interval and exposure in seconds, and their ratio R where it lies in (0, 1.01].

    The interval is the median of the positive steps between the time stamps of the first fifty pictures.
    """
    data, out = memoryview(content), {}
    where = chunk_map(data)
    for name, at in where.items():
        body = bytes(chunk(data, at)) if name.startswith(CALIBRATION) else b""
        found = body.find("dCalibration\0".encode("utf-16-le"))
        if found >= 0 and (size := struct.unpack_from("<d", body, found + 26)[0]) > 0:
            out["pixel_um"] = size
    steps = np.diff(_stamps(data, where))
    if (steps > 0).any():
        out["interval"] = float(np.median(steps[steps > 0])) / 1000
    text = "\n".join(bytes(chunk(data, at)).decode("utf-16-le", "replace") for name, at in where.items() if name.startswith(TEXT))
    if m := re.search(r"Exposure[^\n]*?:\s*([\d.]+)\s*(ms|s)\b", text, re.I):
        out["exposure"] = float(m[1]) / (1000 if m[2].lower() == "ms" else 1)
    if out.get("interval") and out.get("exposure") and (r := out["exposure"] / out["interval"]) <= 1.01:
        out["R"] = min(1.0, r)
    return out


def read_stacks(spark: SparkSession, path: str, glob: str = "*.{nd2,ND2}") -> DataFrame:
    """stacks.read_images of ND2 files."""
    return read_images(spark, path, glob)
