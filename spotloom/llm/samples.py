"""Bounded samples of labelled rows, drawn by a hash of what a row holds, so that every run draws the same ones.

The order and number of files make no difference: rows are ranked by their hash, and equal rows count once, however many
there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_GRAIN = 1 << 30


def row_hash(*columns: str) -> Column:
    return F.xxhash64(*[F.col(c).cast("string") for c in columns])


def per_class(rows: DataFrame, label: str, h: Column, most: int, size: Column | None = None, most_bytes: int = 0, total: int = 1 << 62) -> tuple[DataFrame, dict]:
    """label and h: the smallest hashes of each class, and each class's share of rows that it stands for.

    Rows of a class that agree in h count once. Of each class are drawn: at most `most`, and `total` over the number of
    classes but one at least; and, given the size of a row in bytes, at most `most_bytes`, but one row at least. Only
    hashes and sizes are ranked, about twice as many as are drawn.
    """
    hashed = rows.select(label, h.alias("h"), (F.lit(0) if size is None else size).cast("bigint").alias("_size"))
    counted = hashed.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h", 0.05).alias("d")).collect()  # a row a class
    if not counted:
        return hashed.limit(0).select(label, "h"), {}
    most = max(1, min(most, total // len(counted)))
    # What is far above the rank that will be cut at goes first: twice the share that is wanted, by the hash itself.
    near = [(r[0], int(min(1.0, (2 * most + 100) / r.d) * _GRAIN)) for r in counted]
    near = rows.sparkSession.createDataFrame(near, f"_label {rows.schema[label].dataType.simpleString()}, _near bigint")
    place = F.pmod("h", F.lit(_GRAIN))
    kept = hashed.join(F.broadcast(near), F.col(label) == F.col("_label")).where(place < F.col("_near")).groupBy(label, "h").agg(F.max("_size").alias("_size"))
    by = Window.partitionBy(label).orderBy(place, "h")
    ranked = kept.select(label, "h", F.row_number().over(by).alias("_r"), F.sum("_size").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("_bytes"))
    fits = F.lit(True) if size is None else (F.col("_bytes") <= most_bytes) | (F.col("_r") == 1)
    return ranked.where((F.col("_r") <= most) & fits).select(label, "h"), {r[0]: min(1.0, most / r.n) for r in counted}
