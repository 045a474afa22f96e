"""Reading and writing the engine's tables: spots, traces, diffusion rows and scans as CSV or Parquet."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotloom import schemas

_VIDEO = r"([^/]+?)(?:_traces|_diffusion|_loc)?\.csv$"


def video_name(path: str = "_path"):
    """A video's name from the path of one of its files."""
    return F.regexp_extract(path, _VIDEO, 1)


def output_name(name: str, suffix: str) -> str:
    """The name of a result: the first .tif, .tiff or .nd2 is dropped wherever it stands."""
    for ending in (".tiff", ".tif", ".nd2"):
        if ending in name:
            return name.replace(ending, "", 1) + suffix
    return name + suffix


def _csv(spark: SparkSession, path: str, *required: str) -> DataFrame:
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    named = raw.toDF(*[c.strip().strip("\r﻿").lower() for c in raw.columns]).withColumn("_path", F.col("_metadata.file_path"))
    return schemas.require(named, *required)


def _number(df: DataFrame, name: str, kind: str, default: float | None = None):
    col = F.col(name).try_cast(kind) if name in df.columns else F.lit(None).cast(kind)
    return (col if default is None else F.coalesce(col, F.lit(default).cast(kind))).alias(name)


def read_localizations(spark: SparkSession, path: str) -> DataFrame:
    """Spots of one or more files: frame, x and y are needed, z is 0 and other columns are null where missing.

    spot_idx is the order within the frame, by the place in the file.
    """
    raw = _csv(spark, path, "frame", "x", "y").withColumn("_at", F.monotonically_increasing_id())
    fields = [f.name for f in schemas.LOC if f.name not in ("video", "frame", "spot_idx", "z", "window_size")]
    loc = raw.select(video_name().alias("video"), _number(raw, "frame", "int"), _number(raw, "z", "double", 0.0), _number(raw, "window_size", "int"), *[_number(raw, n, "double") for n in fields], "_at").where("frame is not null")
    idx = (F.row_number().over(Window.partitionBy("video", "frame").orderBy("_at")) - 1).cast("int")
    return schemas.conform(loc.withColumn("spot_idx", idx), schemas.LOC)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Points of trajectories, all that the files have; z and state are 0 where missing."""
    raw = _csv(spark, path, "traj_idx", "frame", "x", "y")
    out = raw.select(video_name().alias("video"), _number(raw, "traj_idx", "bigint"), _number(raw, "frame", "int"), _number(raw, "x", "double"), _number(raw, "y", "double"), _number(raw, "z", "double", 0.0), _number(raw, "state", "int", 0))
    return schemas.conform(out, schemas.TRACES)


def read_diffusion(spark: SparkSession, path: str) -> DataFrame:
    raw = _csv(spark, path, "traj_idx", "h", "k")
    out = raw.select(video_name().alias("video"), _number(raw, "traj_idx", "bigint"), _number(raw, "h", "double").alias("H"), _number(raw, "k", "double").alias("K"), _number(raw, "state", "int", 0))
    return schemas.conform(out, schemas.DIFFUSION)


def write_csv(df: DataFrame, path: str, *partition: str) -> None:
    """df as CSV with a header, in folders by the partition columns if there are any; missing numbers are nan."""
    writer = df.write.mode("overwrite").option("header", True).option("nullValue", "nan")
    (writer.partitionBy(*partition) if partition else writer).csv(path)


def write_localizations(loc: DataFrame, path: str) -> None:
    """The 13 columns of a spot table, frames first to last."""
    columns = [f.name for f in schemas.LOC if f.name not in ("video", "spot_idx")]
    write_csv(schemas.conform(loc, schemas.LOC).select("video", *columns), path, "video")


def write_traces(traces: DataFrame, path: str) -> None:
    write_csv(traces.select("video", "traj_idx", "frame", "x", "y", "z"), path, "video")


def write_diffusion(alpha_k: DataFrame, path: str) -> None:
    """H = alpha / 2 and K = 10 ^ log_k from predictions (video, traj_idx, alpha, log_k)."""
    write_csv(alpha_k.select("video", "traj_idx", (F.col("alpha") / 2).alias("H"), F.pow(F.lit(10.0), "log_k").alias("K")), path, "video")


def export_regions(traces: DataFrame, labelled: DataFrame, label: str, path: str) -> None:
    """The points of each trajectory under its video and region, "excluded" for -1."""
    region = F.when(F.col(label) < 0, F.lit("excluded")).otherwise(F.col(label).cast("string"))
    write_csv(traces.join(labelled.select(*schemas.TRAJ, label), schemas.TRAJ).select("video", region.alias(label), "traj_idx", "frame", "x", "y", "z"), path, "video", label)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def siblings(spark: SparkSession, traces_path: str) -> dict[str, str]:
    """The files that belong to a traces file: diffusion, loc and video, those that there are.

    Exports of a region have names with more words than their video's, so up to three words are taken off the end in the
    search for spots and the video.
    """
    base = traces_path.removesuffix("_traces.csv")
    folder, _, name = base.rpartition("/")
    words = name.split("_")
    shorter = [f"{folder}/{'_'.join(words[: len(words) - i])}" for i in range(min(4, len(words)))]
    tries = {"diffusion": [f"{base}_diffusion.csv"], "loc": [f"{b}_loc.csv" for b in shorter], "video": [f"{b}.{e}" for b in shorter for e in ("tif", "tiff", "nd2")]}
    found = {kind: next((p for p in paths if _exists(spark, p)), None) for kind, paths in tries.items()}
    return {kind: p for kind, p in found.items() if p}


def _header(spark: SparkSession, path: str) -> str:
    """The first line of a file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        java = spark._jvm.java.io
        return java.BufferedReader(java.InputStreamReader(stream, "UTF-8")).readLine() or ""
    finally:
        stream.close()


def _read_alike(spark: SparkSession, paths: list[str], read: Callable[[SparkSession, list[str]], DataFrame]) -> DataFrame:
    """Files read together where they have the same columns, as Spark takes those of the first for all."""
    groups: dict[str, list[str]] = {}
    for p in paths:
        groups.setdefault(_header(spark, p).strip().lower(), []).append(p)
    return reduce(DataFrame.unionByName, [read(spark, group) for group in groups.values()])


def read_datasets(spark: SparkSession, traces_paths: list[str]) -> DataFrame:
    """Traces of files, each once, whatever columns each has, with H and K of the diffusion files beside them (null without)."""
    paths = sorted(set(traces_paths))
    beside = [b["diffusion"] for p in paths if "diffusion" in (b := siblings(spark, p))]
    traces = _read_alike(spark, paths, read_traces)
    diffusion = _read_alike(spark, beside, read_diffusion) if beside else spark.createDataFrame([], schemas.DIFFUSION)
    return traces.join(diffusion.select(*schemas.TRAJ, "H", "K"), schemas.TRAJ, "left")


def union_batches(batches: list[DataFrame], frames: list[int]) -> DataFrame:
    """Spots of batches of pictures as one table: frames of a batch follow those of the batches before, whose numbers are given."""
    out, first = None, 0
    for df, n in zip(batches, frames, strict=True):
        part = df.withColumn("frame", (F.col("frame") + first).cast("int"))
        out, first = part if out is None else out.unionByName(part), first + n
    return out


def write_scan(scan: DataFrame, path: str, **notes: float | str | None) -> None:
    """A scan over strides as CSV by video and state, and what it was made with as JSON beside it."""
    write_csv(scan.withColumn("converged", F.col("converged").cast("int")), path, *[c for c in ("video", "state") if c in scan.columns])
    _put(scan.sparkSession, f"{path}/_notes.json", json.dumps(notes))


def _put(spark: SparkSession, path: str, text: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_json(spark: SparkSession, path: str, *, shapes: list[dict] | None = None, boundaries: list | None = None) -> None:
    """Shapes or boundaries as the files that shapes.read_shapes and shapes.boundaries read."""
    _put(spark, path, json.dumps({"shapes": shapes} if shapes is not None else {"boundaries": boundaries}))


def write_errors(frames: DataFrame, path: str, stage: str = "reading") -> None:
    """Appends a line for each file that could not be read: time, name, stage and why."""
    bad = frames.where("error is not null")
    said = F.format_string("[%s] %s - %s: %s", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"), F.col("video"), F.lit(stage), F.col("error"))
    bad.select(said.alias("value")).write.mode("append").text(path)
