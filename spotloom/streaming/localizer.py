"""Locating spots in pictures as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from spotloom.operators import localize
from spotloom.schemas import LOC
from spotloom.sources import stacks

#: What Spark's binaryFile source has of a file.
_FILES = "path string, modificationTime timestamp, length long, content binary"


def localize_files(spark: SparkSession, folder: str, out: str, checkpoint: str, options: localize.Options | None = None, files: int = 100, once: bool = True) -> StreamingQuery:
    """Spots of all TIFF and ND2 files that come to a folder, at most so many files a micro-batch.

    A file is a video, so its range is known when it comes. A micro-batch writes the folder out/batch=<n>, by itself and
    whole, so one that is run again after a failure leaves the same rows; `read` reads them all. Files that can't be read
    give no spots. With once, the stream ends when it has caught up.
    """

    def locate(batch: DataFrame, number: int) -> None:
        frames = stacks.decoded(batch).where("error is null")
        localize.localize(frames, options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", files).load(folder)
    writer = stream.writeStream.foreachBatch(locate).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read(spark: SparkSession, out: str) -> DataFrame:
    """The spots that were written, without the number of their batch."""
    return spark.read.schema(LOC).parquet(f"{out}/batch=*")
