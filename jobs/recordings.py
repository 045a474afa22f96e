"""Keeps the movement statistics of each day's recordings up to date as files of detections arrive.

A day of a video is a recording. Each run takes the files that came since the last one (a file stream until it has caught
up, with a checkpoint), adds their points to those at hand, and computes the statistics of the days that they touch anew;
other days are not read. Detections may come late, in any order, and more than once.

    <output>/points/batch=<n>/day=<d>   points as they came, a folder for each micro-batch, written by it alone
    <output>/report/day=<d>             particles, runs, points, steps, mean jump and duration, and share, by video and state

A batch that is run again, after a failure anywhere, overwrites its own points and the reports of its days with the same
rows. Of detections of a particle in the same frame the one of the lowest id counts, so a repeated file changes nothing.
Detections without time, particle or place are left out and their number is logged.

    python -m jobs.recordings --input DIR_OR_PATTERN --output DIR --checkpoint DIR [--config FILE]
"""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotloom import schemas
from spotloom.operators import trajectory as T

log = logging.getLogger("jobs.recordings")
CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "recordings.json")
POINTS = "id bigint, video string, particle bigint, frame int, x double, y double, state int, batch bigint, day string"
REPORT = "video string, state int, particles bigint, runs bigint, points bigint, steps bigint, mean_jump double, mean_duration double, percent double, day string"


def as_points(detections: DataFrame, config: dict) -> DataFrame:
    """Detections as points of a day: frames are counted from midnight. Those that lack what is needed have a null day."""
    time = F.expr(config["time"]).cast("timestamp")
    second = F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)
    cells = {"id": "bigint", "video": "string", "particle": "bigint", "x": "double", "y": "double", "state": "int"}
    points = detections.select(*[F.expr(config[c]).cast(kind).alias(c) for c, kind in cells.items()], F.floor(second / config["frame_seconds"]).cast("int").alias("frame"), F.date_format(time, "yyyy-MM-dd").alias("_day"))
    return points.withColumn("day", F.when(F.col("particle").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull(), F.col("_day"))).drop("_day")


def statistics(points: DataFrame) -> DataFrame:
    """A row for each day, video and state. A particle has at most a point a frame, so no day of one is large."""
    first = points.groupBy("day", "video", "particle", "frame").agg(F.min(F.struct("id", "x", "y", "state")).alias("p"))
    recording = F.concat_ws("/", "day", "video")
    traces = schemas.conform(first.select(recording.alias("video"), F.col("particle").alias("traj_idx"), "frame", "p.x", "p.y", F.lit(0.0).alias("z"), F.coalesce("p.state", F.lit(0)).alias("state")), schemas.TRACES)
    runs = T.state_runs(traces)
    summary, by = T.run_summary(runs), ["video", "state"]
    counts = summary.groupBy(*by).agg(F.count_distinct("traj_idx").alias("particles"), F.sum("points").alias("points"), F.avg("duration").alias("mean_duration"))
    steps = T.steps(runs).groupBy(*by).agg(F.count(F.lit(1)).alias("steps"), F.avg("jump").alias("mean_jump"))
    out = counts.join(T.population_share(summary).withColumnRenamed("n", "runs"), by).join(steps, by, "left")
    return out.select(
        F.substring("video", 12, 1 << 30).alias("video"), "state", "particles", "runs", "points", F.coalesce("steps", F.lit(0)).cast("bigint").alias("steps"), "mean_jump", "mean_duration", "percent",
        F.substring("video", 1, 10).alias("day"),
    )


def update(spark: SparkSession, config: dict, input_path: str, output: str, checkpoint: str) -> int:
    """Takes what is new, and returns the number of micro-batches that took."""

    def take(batch: DataFrame, number: int) -> None:
        session, path = batch.sparkSession, f"{output}/points/batch={number}"
        as_points(batch, config).where("day is not null").write.mode("overwrite").partitionBy("day").parquet(path)
        every = session.read.schema(POINTS).parquet(f"{output}/points")
        own = every.where(F.col("batch") == number)
        days = own.select("day").distinct()
        report = statistics(every.join(days, "day", "left_semi"))
        report.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{output}/report")
        wrote = read_report(session, output).join(days, "day", "left_semi").agg(F.count(F.lit(1)), F.min("day"), F.max("day")).first()
        log.info("batch %d: read %d detections, kept %d; wrote %d rows of days %s to %s", number, batch.count(), own.count(), *wrote)

    schema = spark.read.parquet(input_path).schema
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", config.get("files_per_batch", 1000)).parquet(input_path)
    query = files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    batches = len({p["batchId"] for p in query.recentProgress if p["numInputRows"]})
    log.info("took %d batches from %s", batches, input_path)
    return batches


def read_report(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(REPORT).parquet(f"{output}/report")


def load(path: str = CONFIG) -> dict:
    with open(path) as f:
        return json.load(f)


def main() -> None:
    said = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("input", "output", "checkpoint"):
        said.add_argument(f"--{name}", required=True)
    said.add_argument("--config", default=CONFIG)
    args = said.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("recordings").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        update(spark, load(args.config), args.input, args.output, args.checkpoint)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
