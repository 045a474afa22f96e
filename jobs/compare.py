"""Compares groups of trajectories in a table of any shape: jumps, their spread, and mean squared displacement by lag.

The config says, as SQL expressions over the table's columns, what group a row belongs to (video), what is followed
(particle), its order (frame) and its place (x, y). The one at hand follows how long the messages of a speaker are, in
characters and spaces, from turn to turn of a conversation.

    <output>/section=<s>/video=<v>   rows (item, n, value): `jumps` is a histogram with bins shared by all groups (value:
    percent), `percentiles` of jumps (n: jumps), `msd` by lag (value: mean, in unit^2) and `sem` its standard error, `size`
    (item 0: trajectories, item 1: points; value: the mean jump)

The output is replaced as a whole by each run, so a run that is repeated leaves the same rows, and groups that are gone
leave none. Of rows of a particle in the same frame that of the least place counts. Rows without group, particle, frame or
place are left out and their number is logged. A particle may have any share of all rows: its points are numbered over
ranges and meet by number, so none is in one task whole.

    python -m jobs.compare --input PATH --output DIR [--config FILE]
"""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spotloom import schemas
from spotloom.operators import graph
from spotloom.operators import trajectory as T
from spotloom.operators.quantiles import quantiles

log = logging.getLogger("jobs.compare")
CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "compare.json")
OUT = "item double, n bigint, value double, section string, video string"


def as_points(rows: DataFrame, config: dict) -> DataFrame:
    """The numbers that the config says of each row."""
    kinds = {"video": "string", "particle": "bigint", "frame": "int", "x": "double", "y": "double"}
    return rows.select(*[F.expr(config[c]).cast(kind).alias(c) for c, kind in kinds.items()])


def as_traces(points: DataFrame) -> DataFrame:
    """Points, those that lack something left out, as trajectories."""
    first = points.dropna().groupBy("video", "particle", "frame").agg(F.min(F.struct("x", "y")).alias("p"))
    return schemas.conform(first.select("video", F.col("particle").alias("traj_idx"), "frame", "p.x", "p.y", F.lit(0.0).alias("z"), F.lit(0).alias("state")), schemas.TRACES)


def sections(traces: DataFrame, config: dict) -> DataFrame:
    pairs = graph.cut_lineage(T.lag_pairs(traces, config["lags"], config["unit"]))
    jumps = pairs.where("lag = 1")

    def put(name: str, rows: DataFrame, item: Column, n: Column, value: Column) -> DataFrame:
        return rows.select(item.cast("double").alias("item"), n.cast("bigint").alias("n"), value.cast("double").alias("value"), F.lit(name).alias("section"), "video")

    col = F.col
    shares = put("jumps", T.histogram(jumps, "jump", config["bins"], ["video"]), col("bin"), col("n"), col("share"))
    named = {f"q{i}": p / 100 for i, p in enumerate(config["percentiles"])}
    n = jumps.groupBy("video").agg(F.count(F.lit(1)).alias("n"), F.avg("jump").alias("mean_jump"))
    spread = quantiles(jumps, "jump", ["video"], **named).join(n, "video")
    cells = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("item"), col(f"q{i}").alias("value")) for i, p in enumerate(config["percentiles"])]))
    spread = put("percentiles", spread.select("video", "n", cells.alias("c")), col("c.item"), col("n"), col("c.value"))
    curve = pairs.groupBy("video", "lag").agg(F.count(F.lit(1)).alias("n"), F.avg(col("jump") ** 2).alias("mean"), F.stddev_samp(col("jump") ** 2).alias("sd"))
    msd = put("msd", curve, col("lag"), col("n"), col("mean"))
    sem = put("sem", curve.where("n > 1"), col("lag"), col("n"), col("sd") / F.sqrt("n"))
    each = traces.groupBy("video", "traj_idx").agg(F.count(F.lit(1)).alias("points")).groupBy("video").agg(F.count(F.lit(1)).alias("0"), F.sum("points").alias("1"))
    size = each.join(n.select("video", "mean_jump"), "video", "left").unpivot(["video", "mean_jump"], ["0", "1"], "item", "n")
    parts = [shares, spread, msd, sem, put("size", size, col("item"), col("n"), col("mean_jump"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compare(spark: SparkSession, config: dict, input_path: str, output: str) -> None:
    points = graph.cut_lineage(as_points(spark.read.format(config["format"]).load(input_path), config))  # texts are read once
    log.info("read %d rows of %s, kept %d", points.count(), input_path, points.dropna().count())
    found = sections(graph.cut_lineage(as_traces(points)), config)
    found.repartition("section", "video").write.mode("overwrite").partitionBy("section", "video").parquet(output)
    log.info("wrote %d rows to %s", read_report(spark, output).count(), output)


def read_report(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(OUT).parquet(output)


def load(path: str = CONFIG) -> dict:
    with open(path) as f:
        return json.load(f)


def main() -> None:
    said = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("input", "output"):
        said.add_argument(f"--{name}", required=True)
    said.add_argument("--config", default=CONFIG)
    args = said.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("compare").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        compare(spark, load(args.config), args.input, args.output)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
