"""Exact quantiles of groups of any size, in bounded memory.

Sketches bound where a quantile lies; what lies below is counted, and only distinct values within the bounds, a small
share of the group, are ranked. Groups of so few values that the bounds would be some ranks apart are ranked whole. A rank
outside the bounds, which a sketch that keeps its promise can't give, is an error rather than a neighbouring value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Inverse of a sketch's error in ranks, and how far to each side of a quantile its bounds are taken.
ACCURACY, ASIDE = 10_000, 3e-4
#: Groups up to this size are ranked whole; in larger ones the bounds leave the sketch 20 ranks more than its error.
WHOLE = 100_000


def medians(values: DataFrame, by: list[str], *columns: str) -> DataFrame:
    """A row a group with the median of each column as median_<column>; null where a column has no values."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)]))
    tall = values.select(*by, cells.alias("_c")).select(*by, F.col("_c.i").alias("_i"), F.col("_c.v").alias("_x"))
    found = quantiles(tall, "_x", [*by, "_i"], median=0.5)
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_i") == i, F.col("median"))).alias(f"median_{c.lower()}") for i, c in enumerate(columns)])


def quantiles(values: DataFrame, column: str, by: list[str], **named: float) -> DataFrame:
    """A row a group with each quantile under its name, linear between neighbours as `percentile` has them.

    Null values are left out, as are groups without others. named is like median=0.5.
    """
    v = values.where(F.col(column).isNotNull()).select(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], F.col(column).cast("double").alias("_v"))
    keys = [f"_b{i}" for i in range(len(by))]
    ends = F.array(*[F.lit(min(1.0, max(0.0, q + s))) for q in named.values() for s in (-ASIDE, ASIDE)])
    bounds = v.groupBy(*keys).agg(F.approx_percentile("_v", ends, ACCURACY).alias("_e"), F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    edge = lambda i, q, s: F.col("_min") if q + s <= ASIDE else F.col("_max") if q + s >= 1 - ASIDE else F.element_at("_e", i)
    near = F.col("_n") <= WHOLE
    for i, q in enumerate(named.values()):
        near = near | F.col("_v").between(edge(2 * i + 1, q, -ASIDE), edge(2 * i + 2, q, ASIDE))
    bounds = bounds.withColumnsRenamed({k: f"_{k}" for k in keys})
    both = v.join(bounds, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]) if keys else v.join(F.broadcast(bounds))  # one row
    # Values between the bounds are counted by value; others by the gap between bounds that they lie in.
    gap = sum((F.element_at("_e", i + 1) < F.col("_v")).cast("int") for i in range(2 * len(named)))
    ranked = both.select(*keys, "_n", F.when(near, F.col("_v")).alias("_v"), F.when(~near, gap).alias("_g"), F.when(~near, F.col("_v")).alias("_far"))
    counted = ranked.groupBy(*keys, "_n", "_v", "_g").agg(F.count(F.lit(1)).alias("_k"), F.min("_far").alias("_far"))
    order = Window.partitionBy(*keys).orderBy(F.coalesce("_v", "_far")).rowsBetween(Window.unboundedPreceding, 0)
    upto = counted.withColumn("_to", F.sum("_k").over(order))
    at = lambda rank: F.min(F.when(F.col("_to") > rank, F.struct(F.coalesce("_v", "_far").alias("o"), F.col("_v").alias("v"))))
    sure = lambda x: F.coalesce(x["v"], F.raise_error(F.lit("a sketch's bounds miss the quantile")))
    cells = []
    for name, q in named.items():
        place = q * (F.col("_n") - 1)
        cells += [sure(at(F.floor(place))).alias(f"{name}_lo"), sure(at(F.ceil(place))).alias(f"{name}_hi")]
    out = upto.groupBy(*keys, "_n").agg(*cells)
    between = lambda name, q: F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * (q * (F.col("_n") - 1) - F.floor(q * (F.col("_n") - 1)))
    return out.select(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)], *[between(name, q).alias(name) for name, q in named.items()])
