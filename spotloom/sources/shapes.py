"""Regions from files: shapes and boundaries as JSON, and ImageJ ROI files, single or zipped."""

from __future__ import annotations

import io
import json
import math
import struct
import zipfile

from pyspark.sql import DataFrame, SparkSession

SHAPE = "type string, x1 double, y1 double, x2 double, y2 double, cx double, cy double, rx double, ry double, angle double, p1 array<double>, p2 array<double>"


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """A row for each shape of JSON files {"shapes": [...]}."""
    return spark.read.schema(f"shapes array<struct<{SHAPE.replace(' ', ':').replace(',:', ', ')}>>").option("multiLine", True).json(path).selectExpr("inline(shapes)")


def boundaries(text: str) -> list[list[tuple[float, float]]]:
    """The polylines of {"boundaries": [[[h, log10 k], ...], ...]}."""
    return [[(float(h), float(k)) for h, k in line] for line in json.loads(text)["boundaries"]]


def parse_roi(data: bytes) -> dict | None:
    """A shape from one ROI, or None if it is of a kind that has none here."""
    if len(data) < 64 or data[:4] != b"Iout":
        return None
    kind = data[6]
    top, left, bottom, right = struct.unpack_from(">4h", data, 8)
    x1, y1, x2, y2 = struct.unpack_from(">4f", data, 18)
    (subtype,) = struct.unpack_from(">h", data, 48)
    if kind == 7 and subtype in (3, 5):
        length = math.hypot(x2 - x1, y2 - y1)
        ratio = struct.unpack_from(">f", data, 52)[0]
        angle, cx, cy = math.degrees(math.atan2(y2 - y1, x2 - x1)), (x1 + x2) / 2, (y1 + y2) / 2
        if subtype == 3:
            return {"type": "ellipse", "cx": cx, "cy": cy, "rx": length / 2, "ry": length * ratio / 2, "angle": angle}
        return {"type": "rect", "x1": cx - length / 2, "y1": cy - ratio / 2, "x2": cx + length / 2, "y2": cy + ratio / 2, "angle": angle}
    if kind == 1:
        return {"type": "rect", "x1": float(left), "y1": float(top), "x2": float(right), "y2": float(bottom), "angle": 0.0}
    if kind == 2:
        return {"type": "ellipse", "cx": (left + right) / 2, "cy": (top + bottom) / 2, "rx": (right - left) / 2, "ry": (bottom - top) / 2, "angle": 0.0}
    if kind == 3:
        return {"type": "line", "p1": [x1, y1], "p2": [x2, y2]}
    return None


def load_rois(data: bytes) -> tuple[list[dict], int]:
    """Shapes of a ROI file or a zip of them, and how many were skipped."""
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            found = [parse_roi(z.read(n)) for n in z.namelist() if n.lower().endswith(".roi")]
    else:
        found = [parse_roi(data)]
    return [s for s in found if s], sum(s is None for s in found)
