"""Tables, scratch space, batches and hot keys: what the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows handed to a function together; documents can be long, so they are few. Spark bounds a batch to 64 MB by itself.
ROWS = 256
#: Rows of one key from which it counts as hot, and the most hot keys that are broadcast.
HOT_ROWS, HOT_KEYS = 20_000, 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(columns: list[str], name: str) -> int:
    """Where a column is: by its exact name first, then regardless of case."""
    return columns.index(name) if name in columns else [c.lower() for c in columns].index(name.lower())


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Columns of df under new names: pick(df, doc_id="id", text="body") has doc_id and text.

    Columns are found by `place`, so other columns of any name, also ones that differ only in case, do no harm.
    """
    places = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return places.select(*[F.col(f"_{place(df.columns, old)}").alias(new) for new, old in wanted.items()])


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n; a null id counts as 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % n, F.lit(0))


def small(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, without a copy."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """mapInArrow with a function of one small batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    if len({c.lower() for c in df.columns}) < len(df.columns):  # names that differ only in case can't be looked up
        df = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return df.mapInArrow(run, schema)


def crc_remainder(value: object, n: int) -> int:
    return zlib.crc32(str(value).encode()) % n


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a session in one process may go without, with one of its own."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spotloom-")
    return _own[app]


_watched: list[list[Scratch]] = []


class Scratch:
    """Tables written to the cluster's shared folder, which cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/spotloom-{uuid.uuid4().hex}"
        for made in _watched:
            made.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df, written as Parquet and read again."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def close(self) -> None:
        """Removes all tables; DataFrames that read them are of no use any more."""
        self._delete(self.root)


@contextlib.contextmanager
def tidy() -> Iterator[None]:
    """Within, results must be used up; at the end, the tables that operators made in the meantime are removed.

    Spark drops shuffles, broadcasts and generated classes when the driver's JVM finds that nothing refers to them, so
    it is told to look.
    """
    made: list[Scratch] = []
    _watched.append(made)
    try:
        yield
    finally:
        _watched.remove(made)
        for scratch in made:
            scratch.close()
        gc.collect()
        for session in {scratch.spark for scratch in made}:
            session._jvm.java.lang.System.gc()


def hot_keys(counts: DataFrame, n: str = "n", rows: int = HOT_ROWS, most: int = HOT_KEYS) -> DataFrame:
    """Of counted keys, those with many rows: at least `rows`, or so many more that there are at most `most` such keys.

    Their number is thus bounded, whatever the input, and they may be broadcast.
    """
    while counts.where(F.col(n) >= rows).count() > most:
        rows *= 2
    return counts.where(F.col(n) >= rows).withColumn("parts", F.ceil(F.col(n) / rows).cast("int"))


def deal(left: DataFrame, key: str, scratch: Scratch, name: str, rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """left with _part, which deals the rows of each hot key into parts of about `rows`, and the hot keys, None without any.

    A join on (key, _part) with `copies` then gives no task a hot key whole. left must read the same twice, as a
    written table does, and its rows must differ from each other.
    """
    often = left.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= rows)
    hot = hot_keys(scratch.keep(often, name), rows=rows).select(F.col(key).alias("_hot"), "parts")  # counted once
    if hot.isEmpty():
        return left.withColumn("_part", F.lit(0)), None
    part = F.pmod(F.xxhash64(*left.columns), F.coalesce("parts", F.lit(1))).cast("int")
    return left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_part", part).drop("_hot", "parts"), hot


def copies(right: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """right with a copy of each row for every part of its key."""
    if hot is None:
        return right.withColumn("_part", F.lit(0))
    both = right.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    return both.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("_hot", "parts")
