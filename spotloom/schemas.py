"""Schemas of the tables, and checks that a frame has what an operator needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

_TYPES = {"STRING": StringType(), "INT": IntegerType(), "BIGINT": LongType(), "DOUBLE": DoubleType(), "FLOAT": FloatType(), "BOOLEAN": BooleanType(), "ARRAY<FLOAT>": ArrayType(FloatType())}


def _schema(ddl: str) -> StructType:
    """A schema from "name TYPE, ..." without a session."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in ddl.split(","))])


FRAMES = _schema("video STRING, frame INT, height INT, width INT, pixels ARRAY<FLOAT>, s_min FLOAT, frame_max_raw FLOAT")
LOC = _schema(
    "video STRING, frame INT, spot_idx INT, x DOUBLE, y DOUBLE, z DOUBLE, xvar DOUBLE, yvar DOUBLE, rho DOUBLE, norm_cst DOUBLE, "
    "intensity DOUBLE, window_size INT, bg_median DOUBLE, bg_var DOUBLE, integrated_flux DOUBLE"
)
TRACES = _schema("video STRING, traj_idx BIGINT, frame INT, x DOUBLE, y DOUBLE, z DOUBLE, state INT")
DIFFUSION = _schema("video STRING, traj_idx BIGINT, H DOUBLE, K DOUBLE, state INT")
EDGES = _schema("video STRING, src_frame INT, src_idx INT, dst_frame INT, dst_idx INT, gap INT, jump_d DOUBLE")
SCAN = _schema("video STRING, state INT, delta INT, H_estim DOUBLE, H_std DOUBLE, rho DOUBLE, n_eff DOUBLE, n_ratios BIGINT, converged BOOLEAN")

TRAJ = ["video", "traj_idx"]


class MissingColumns(ValueError):
    """A table lacks columns that an operator needs."""


def require(df: DataFrame, *columns: str) -> DataFrame:
    gone = [c for c in columns if c not in df.columns]
    if gone:
        raise MissingColumns(f"missing {gone}; there are {df.columns}")
    return df


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The schema's columns, cast; those that are missing are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
