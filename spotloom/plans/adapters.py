"""The driver's tables as traces, spots, diffusion rows and frames, in Spark and in SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotloom import schemas


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.regexp_extract("props", "(-?[0-9]+)", 1).try_cast("double")
    return e.select(
        "event_id", "user_id", F.concat(F.lit("v"), F.col("user_id") % 3).alias("video"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day"),
        F.hour("ts").alias("hour"), F.col("value").alias("x"), F.coalesce(k, F.lit(0.0)).alias("y"), (F.length("event_type") % 2).alias("state"),
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trajectory for each user, a point for each day with an event: that of the lowest id."""
    e = _events(spark, sf_dir)
    first = e.groupBy("video", "user_id", "day").agg(F.min(F.struct("event_id", "x", "y", "state")).alias("p"))
    return first.select("video", F.col("user_id").alias("traj_idx"), F.col("day").alias("frame"), "p.x", "p.y", F.lit(0.0).alias("z"), "p.state")


def loc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spots: one for each event, with the hour since the start as its frame."""
    e = _events(spark, sf_dir).withColumn("frame", F.col("day") * 24 + F.col("hour"))
    spot = F.row_number().over(Window.partitionBy("video", "frame").orderBy("event_id")) - 1
    return e.select("video", "frame", spot.alias("spot_idx"), "x", "y", F.lit(0.0).alias("z"))


def diffusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H and K for each user."""
    e = _events(spark, sf_dir)
    return e.groupBy("video", F.col("user_id").alias("traj_idx")).agg((F.avg("y") / 100).alias("H"), (F.avg("x") / 100).alias("K"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8 by 8 picture for each embedding."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return schemas.conform(e.select(F.lit("emb").alias("video"), F.col("vec_id").cast("int").alias("frame"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.col("embedding").alias("pixels")), schemas.FRAMES)


def rendered(spark: SparkSession, sf_dir: str, side: int = 48) -> DataFrame:
    """A picture of each frame with spots: a bell for each spot, wrapped into the picture, over an even background."""
    spots = loc(spark, sf_dir).groupBy("video", "frame").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("at"))
    spots = spots.select("video", "frame", F.col("at.x").alias("us"), F.col("at.y").alias("vs"))  # flat, as in Python each nested array is an object

    def run(batches):
        y, x = np.mgrid[:side, :side]
        for b in batches:
            out = []
            for us, vs in zip(b.us, b.vs, strict=True):
                p = 100 + 5 * np.sin(1.7 * x + 2.3 * y)
                for u, v in zip(us, vs, strict=True):
                    p = p + 900 * np.exp(-((x - 4 - u % (side - 8)) ** 2 + (y - 4 - v % (side - 8)) ** 2) / 4)
                out.append(p.ravel().astype(np.float32))
            yield pd.DataFrame({"video": b.video, "frame": b.frame, "height": side, "width": side, "pixels": out})

    # Spots are few bytes and pictures many, so their number of tasks is set by cores rather than by the size of spots.
    # A hash of the keys, as a repartition by the keys themselves counts as done by the aggregation, whose tasks are merged.
    spots = spots.repartition(spark.sparkContext.defaultParallelism, F.xxhash64("video", "frame"))
    return schemas.conform(spots.mapInPandas(run, "video string, frame int, height int, width int, pixels array<float>"), schemas.FRAMES)


EVENTS_SQL = """ev as (select event_id, user_id, 'v' || (user_id % 3) as video, date_diff('day', date '2024-01-01', cast(ts as date)) as day,
  extract(hour from ts) as hour, value as x, coalesce(try_cast(regexp_extract(props, '(-?[0-9]+)', 1) as double), 0) as y, length(event_type) % 2 as state from events)"""
TRACES_SQL = EVENTS_SQL + """, tr as (select video, user_id as traj_idx, cast(day as integer) as frame, x, y, 0.0 as z, state from ev
  qualify row_number() over (partition by video, user_id, day order by event_id) = 1)"""
LOC_SQL = EVENTS_SQL + """, loc as (select video, cast(day * 24 + hour as integer) as frame, row_number() over (partition by video, day * 24 + hour order by event_id) - 1 as spot_idx, x, y from ev)"""
DIFFUSION_SQL = "df as (select video, user_id as traj_idx, avg(y) / 100 as H, avg(x) / 100 as K from ev group by 1, 2)"
FRAMES_SQL = "fr as (select cast(vec_id as integer) as frame, cast(unnest(range(64)) as integer) as pos, cast(unnest(embedding) as double) as v from embeddings)"
