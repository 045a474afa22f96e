"""The command line: python -m spotloom run|localize|track INPUT OUTPUT [options]."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from spotloom.plans import run as plan
from spotloom.sources import stacks, tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("spotloom", description="Spots and trajectories from stacks of pictures.")
    p.add_argument("mode", choices=("run", "localize", "track"), help="all steps, or one of them; INPUT is a file, a folder or a glob")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--window", type=int, default=7)
    p.add_argument("--threshold", type=float, default=1.0)
    p.add_argument("--shift", type=int, default=1)
    p.add_argument("--depth", type=int, default=3)
    p.add_argument("--cutoff", type=int, default=3)
    p.add_argument("--jump", type=float, default=None, help="the longest jump in pixels; from the data unless given")
    p.add_argument("--postprocess", action="store_true")
    p.add_argument("--quiet", action="store_true")
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("spotloom").getOrCreate()
    tell = (lambda *_: None) if a.quiet else lambda percent, label: print(f"PROGRESS:{percent}:{label}", file=sys.stderr)
    options = plan.Options(a.window, a.threshold, a.shift, 0, a.depth, a.cutoff, a.jump, a.postprocess, progress=tell)
    if a.mode == "run":
        plan.run(spark, a.input, a.output, options)
    elif a.mode == "localize":
        frames = stacks.read_images(spark, a.input)
        tables.write_errors(frames, f"{a.output}/errors")
        tables.write_localizations(plan.locate(frames, options), f"{a.output}/loc")
    else:
        tables.write_traces(plan.track(tables.read_localizations(spark, a.input), options), f"{a.output}/traces")
    return 1 if a.mode != "track" and not spark.read.text(f"{a.output}/errors").isEmpty() else 0


if __name__ == "__main__":
    sys.exit(main())
