"""URL filter: rules on hosts and paths, looked up in cascades of Bloom filters.

A rule is a host, a path and a verdict; it fits its host and all subdomains where a url's path starts with the rule's. A
url's keys are what rules could say of it: a last part of its host with a first part of its path, for the numbers of
labels and characters that rules have. The keys of all urls are the universe. A cascade encodes which of them are listed:
its first filter holds the listed keys, the second those of the others that the first takes for listed, the third the
listed keys that the second takes for false ones, and so on until nothing is mistaken. The first filter that lacks a key
then says for certain whether it is listed, so every url is judged by itself, without a join. There is a cascade for the
keys to block and one for those to allow.

The first filter has about log2(others / listed) bits for a listed key and those after it about one bit a key, the sizes
that make the whole least. Where more than LISTED keys are listed, keys are dealt into parts by hash, each with a cascade
of its own, and urls are judged by a part at a time, so that what a task holds stays under about 40 bytes for each of
LISTED keys.

Only built-in functions are used. Defined cases: a null url, and one without "://", has an empty host and path, no rule and
is allowed, as is any url that no rule fits. Of rules that fit, the longest wins; of equally long ones that of the longer
host. Of rules alike the one that blocks wins. Rules with null in any column, or an empty host, fit nothing. Urls may repeat;
each row is judged. Without rules, or without urls, the results are as one expects. Other columns, also ones that differ
from the wanted only in case, do no harm.
"""

from __future__ import annotations

import functools
import math
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spotloom.llm import frames

#: Listed keys of a part.
LISTED = 4_000_000
#: Bits of a word of a filter, and hashes of a first filter at most.
WORD, HASHES = 64, 30


@dataclass
class Level:
    """A filter of a cascade: how many bits and hashes it has, and the table of its words."""

    bits: int
    hashes: int
    table: str


def _places(key: Column, at: int, level: Level) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(1000 * at + k), key), F.lit(level.bits)) for k in range(level.hashes)]


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(parts))


def _write(keys: DataFrame, at: int, bits: int, hashes: int, scratch: frames.Scratch, name: str) -> Level:
    """A filter of keys, written as one row with an array of words; its length is set by the listed keys of a part."""
    level, spark = Level(bits, hashes, scratch.path(name)), keys.sparkSession
    place = keys.select(F.explode(F.array(*_places(F.col("key"), at, level))).alias("place"))
    mask = place.select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("mask"))
    every = spark.range(-(-bits // WORD)).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("mask"))
    words = mask.unionByName(every).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    scratch.keep(words.agg(F.array_sort(F.collect_list(F.struct("word", "mask"))).alias("w")).select(F.col("w.mask").alias("words")), name)
    return level


def _holds(spark: SparkSession, key: Column, at: int, level: Level) -> Column:
    """Whether a filter may hold a key; a query reads the filter once, as a scalar subquery."""
    words = spark.read.schema("words array<bigint>").parquet(level.table).scalar()
    bits = [F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(WORD - 1).cast("int")) == 1 for p in _places(key, at, level)]
    return functools.reduce(operator.and_, bits)


def is_listed(spark: SparkSession, key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed: if the number of filters that hold it before one lacks it is odd."""
    said = F.lit(len(levels) % 2 == 1)
    for at in reversed(range(len(levels))):
        said = F.when(_holds(spark, key, at, levels[at]), said).otherwise(F.lit(at % 2 == 1))
    return said


def build(universe: DataFrame, listed: DataFrame, scratch: frames.Scratch, name: str) -> list[list[Level]]:
    """Cascades by part for the listed among the distinct keys of a universe; both have a column key."""
    spark, parts = universe.sparkSession, max(1, -(-listed.count() // LISTED))
    cascades = []
    for p in range(parts):
        own, all_ = (df.where(_part(F.col("key"), parts) == p) for df in (listed, universe))
        n, others = own.count(), all_.count()
        levels: list[Level] = []
        if n:
            hashes = max(1, min(HASHES, math.ceil(math.log2(max(2.0, math.sqrt(2) * others / n)))))
            levels = [_write(own, 0, math.ceil(n * hashes / math.log(2)), hashes, scratch, f"{name}-{p}-0")]
            # Held keys are the listed ones and about 0.7 times as many others: all that the rest of the cascade is about.
            marked = own.select("key", F.lit(True).alias("listed"))
            held = scratch.keep(all_.where(_holds(spark, F.col("key"), 0, levels[0])).join(marked, "key", "left"), f"{name}-{p}-held")
            ours, mistaken = held.where("listed"), held.where("listed is null")
            while n := mistaken.count():
                at = len(levels)
                levels.append(_write(mistaken, at, math.ceil(n / math.log(2)), 1, scratch, f"{name}-{p}-{at}"))
                ours, mistaken = mistaken, scratch.keep(ours.where(_holds(spark, F.col("key"), at, levels[at])), f"{name}-{p}-mistaken-{at}")
        cascades.append(levels)
    return cascades


def _fold(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _labels(host: Column) -> Column:
    return F.char_length(host) - F.char_length(F.replace(host, F.lit("."), F.lit(""))) + 1


def split_urls(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """urls with host and path."""
    after = F.locate("://", url_col)
    rest = F.when(after > 0, F.substring(F.col(url_col), after + 3, F.char_length(url_col))).otherwise("")
    part = lambda n: F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", n)
    return urls.withColumns({"host": F.coalesce(_fold(part(1)), F.lit("")), "path": F.coalesce(part(2), F.lit(""))})


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule (null where none fits) and verdict for each url; rules have host, path and verdict, block or allow."""
    spark, scratch = urls.sparkSession, frames.Scratch(urls.sparkSession)
    rules = frames.pick(rules, host="host", path="path", verdict="verdict").withColumn("host", _fold(F.col("host"))).where("host <> '' and path is not null")
    rules = scratch.keep(rules.select(F.concat("host", "path").alias("key"), _labels(F.col("host")).alias("labels"), F.char_length("path").alias("chars"), "verdict").distinct(), "rules")
    block, allow = (rules.where(F.col("verdict") == v).select("key") for v in ("block", "allow"))
    out = split_urls(frames.pick(urls, id=id_col, url=url_col)).drop("url")
    #: Kinds of keys: few, as hosts have few labels and rules' paths few lengths.
    kinds = sorted(tuple(r) for r in rules.select("labels", "chars").distinct().collect())
    host, path = F.col("host"), F.col("path")
    key = lambda labels, chars: F.when((host != "") & (_labels(host) >= labels) & (F.char_length(path) >= chars), F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, chars)))
    keys = [(labels, key(labels, chars)) for labels, chars in kinds]
    none = F.lit(None).cast("struct<size: int, labels: int, key: string, verdict: string>")
    out = out.withColumn("best", none)
    if keys:
        universe = scratch.keep(out.select(F.explode(F.array(*[k for _, k in keys])).alias("key")).where("key is not null").distinct(), "universe")
        todo = [(v, p, levels, len(parts)) for v, rows in (("block", block), ("allow", allow.join(block, "key", "left_anti"))) for parts in [build(universe, rows, scratch, v)] for p, levels in enumerate(parts) if levels]
        for i, (verdict, p, levels, parts) in enumerate(todo):
            found = [F.when((_part(k, parts) == p) & is_listed(spark, k, levels), F.struct(F.char_length(k).alias("size"), F.lit(n).alias("labels"), k.alias("key"), F.lit(verdict).alias("verdict"))) for n, k in keys]
            out = out.withColumn("best", F.array_max(F.array("best", *found)))
            if parts > 1 and i + 1 < len(todo):
                out = scratch.keep(out, f"judged-{i}")  # so that the filters of one part are held at a time
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
