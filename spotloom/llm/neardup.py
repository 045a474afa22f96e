"""Near-duplicates by MinHash: one-permutation hashing with optimal densification, banded buckets, star edges.

1. A pass over the texts takes each document's set of word shingles as 64-bit hashes. One hash a shingle fills all
   bins of a signature: its leading bits choose the bin, and a bin keeps its smallest value. Empty bins copy the bin
   that a hash of (bin, attempt) names, attempts going on until that bin was filled.
2. Documents with equal sets (a 128-bit digest) form a class, of which only one goes on.
3. Bands of the signature are bucket keys. In each bucket, every member is paired with one star, not with the others.
4. Pairs are confirmed on their full sets, |A and B| / |A or B| >= threshold, and linked ones are joined into
   components. Rounds follow with other stars, but only for members that are not yet in their star's component.
5. What is left, members of a bucket outside its largest component, is searched for links to other components by
   the rarest shingles of each (a prefix filter, which loses nothing), so that no pair that shares a bucket and lies
   in two components goes unchecked, however large the bucket is.

With 32 bands of 4 a pair of similarity 0.8 shares no bucket with probability 5e-8.

Defined cases: a null text, or one without words, has an empty set, is linked with nothing and kept. A text of fewer
words than a shingle has its whole sequence as its only shingle. Rows that repeat an id are told apart by their text:
each belongs to the class of its own set. Rows with a null id belong to no component and are kept. Ties: the smallest id
stands for its class and its component. Columns of other names are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotloom.llm import bytewords as W
from spotloom.llm import frames
from spotloom.llm.components import components

BINS, BAND = 128, 4
#: Rounds with one star a bucket before what is left is compared in full.
STAR_ROUNDS = 2
#: Parts that the texts of a group are dealt into where they get the group's name.
NAME_PARTS = 16


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, offs = W.word_hashes(column, W.NOT_SPACE)
    grams = W.ngrams(h, k)
    out = []
    for _, a, b in W.rows(offs):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(W.ngrams(h[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(h[:0])
    return out


_PROBES: list[np.ndarray] = []


def _probe(attempt: int) -> np.ndarray:
    while len(_PROBES) <= attempt:
        at = np.arange(BINS, dtype=np.uint64) + np.uint64(BINS * (len(_PROBES) + 1))
        _PROBES.append((W.mix(at) % np.uint64(BINS)).astype(np.int64))
    return _PROBES[attempt]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BINS values for each set, which must not be empty."""
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)
    sig = np.zeros((len(sets), BINS), np.uint64)
    filled = np.zeros((len(sets), BINS), bool)
    for i, s in enumerate(sets):
        at = np.searchsorted(s, edges)
        has = np.append(at[1:], len(s)) > at
        filled[i] = has
        sig[i, has] = s[at[has]]
    first, full = sig.copy(), filled.copy()
    row, bin_ = np.nonzero(~filled)
    attempt = 0
    while len(row):
        probe = _probe(attempt)[bin_]
        hit = filled[row, probe]
        first[row[hit], bin_[hit]] = sig[row[hit], probe[hit]]
        full[row[hit], bin_[hit]] = True
        row, bin_, attempt = row[~hit], bin_[~hit], attempt + 1
    return first


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature, as signed integers."""
    bands = sig.reshape(len(sig), BINS // BAND, BAND)
    key = np.broadcast_to(np.arange(1, BINS // BAND + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), bands.shape[:2]).copy()
    for j in range(BAND):
        key = W.mix(key ^ bands[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
    return W.mix(key).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 |A and B| >= percent |A or B|, of two sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = int(np.isin(a, b, assume_unique=True, kind="sort").sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _text_key(text: str | Column) -> Column:
    """What tells the texts of rows that repeat an id apart."""
    return F.coalesce(F.md5(F.coalesce(text, F.lit("")).cast("binary")), F.lit(""))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles, component_id and kept for each row; percent is the least similarity, in hundredths."""
    return _sorted_out(docs, id_col, text_col, shingle, percent).drop("key").withColumnRenamed("id", id_col)


def _sorted_out(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """id, key (of the text), n_shingles, component_id and kept for each row."""
    spark = docs.sparkSession
    scratch = frames.Scratch(spark)
    df = frames.pick(docs, id=id_col, text=text_col)
    kind = df.schema["id"].dataType.simpleString()
    df = df.withColumn("key", _text_key(F.col("text")))

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(1), shingle)
        live = [i for i, s in enumerate(sets) if len(s)]
        keys: list = [None] * len(sets)
        if live:
            for i, row in zip(live, band_keys(signatures([sets[i] for i in live])), strict=True):
                keys[i] = row
        named = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(map(len, sets), pa.int64()), pa.array(named, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
            ["id", "key", "n", "set", "keys"],
        )

    signed = scratch.keep(frames.map_batches(df, sign, f"id {kind}, key string, n bigint, set binary, keys array<bigint>"), "signed")
    # A class of equal sets is a node of the graph, with a number of its own, as ids may repeat with other texts. Its
    # text is that of its smallest id.
    classes = signed.where("set is not null and id is not null").groupBy("set").agg(F.min(F.struct("id", "key")).alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    classes = scratch.keep(classes.select(F.monotonically_increasing_id().alias("node"), "set", "first.id", "first.key", "n", "keys"), "classes")

    # Buckets with two members or more.
    member = classes.select(F.explode(F.array_distinct("keys")).alias("bucket"), "node", "n")
    crowded = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = scratch.keep(member.join(crowded.hint("merge"), "bucket"), "shared")
    # A member with many others in its buckets is likely to be what they are copies of.
    near = shared.groupBy("node").agg(F.sum("c").alias("near"))
    buckets = scratch.keep(shared.drop("c").join(near.hint("merge"), "node"), "buckets")
    # The live ones grow with the input, so they are never broadcast; the plan is alike at every size.
    live = classes.join(near.select("node").hint("merge"), "node", "left_semi").select("node", F.col("id").alias("i"), F.col("key").alias("k"))
    texts = df.join(live.hint("merge"), (F.col("id") == F.col("i")) & (F.col("key") == F.col("k")))
    # Equal texts of one id are side by side after the join, so making them one takes no other shuffle.
    texts = texts.groupBy("i", "k").agg(F.first("node").alias("node"), F.first("text").alias("text")).select("node", "text")
    texts = scratch.keep(texts, "texts")

    def confirm(batch: pa.RecordBatch) -> pa.RecordBatch:
        # Rows come in runs of one star, whose set is made once.
        star, held = None, None
        left, good = shingle_sets(batch.column(2), shingle), []
        right = batch.column(3)
        for i, s in enumerate(left):
            if star is None or batch.column(1)[i] != star:
                star, held = batch.column(1)[i], shingle_sets(right.slice(i, 1), shingle)[0]
            good.append(similar(s, held, percent))
        return batch.select([0, 1]).filter(pa.array(good))

    def confirmed(pairs: DataFrame, step: int) -> DataFrame:
        """The pairs whose full sets are similar enough. A star may have very many members, which are dealt into parts."""
        dealt, hot = frames.deal(pairs, "b", scratch, f"hot-{step}")
        one = dealt.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")).hint("merge"), "a")
        stars = frames.copies(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b", hot)
        two = one.join(stars.hint("merge"), ["b", "_part"]).select("a", "b", "ta", "tb")
        return frames.map_batches(two, confirm, "a bigint, b bigint")

    def sized(pairs: DataFrame) -> DataFrame:
        """Pairs (a member, a star) whose sizes allow for the similarity, each once, not those compared before."""
        fit = pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        fit = fit.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.max("b").alias("b"))
        for done in compared:
            fit = fit.join(done.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).hint("merge"), ["lo", "hi"], "left_anti")
        return fit.select(F.when(F.col("b") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("a"), "b")

    def reachable(around: DataFrame, lone: DataFrame) -> DataFrame:
        """Pairs of a lone document (s) and one of another component that may be similar, found without loss.

        With the shingles of each document ordered from rare to frequent, two similar ones have a first shingle in
        common so early in both that what follows it suffices for the similarity. Only shingles that early are
        joined. Rare ones are mostly a document's own, so frequent ones seldom come into it.
        """
        spread = frames.map_batches(texts.join(around.select("node").hint("merge"), "node", "left_semi"), explode_shingles, "node bigint, h bigint")
        spread = scratch.keep(spread, "spread")
        counts = spread.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
        place = F.row_number().over(Window.partitionBy("node").orderBy("df", "h")) - 1
        early = spread.join(counts.hint("merge"), "h").withColumn("at", place).join(around.hint("merge"), "node")
        early = scratch.keep(early.where((F.col("df") > 1) & (100 * (F.col("n") - F.col("at")) >= percent * F.col("n"))).select("h", "node", "at", "n", "c"), "early")
        ones = early.join(lone.select(F.col("s").alias("node")).hint("merge"), "node", "left_semi").select("h", F.col("node").alias("s"), F.col("at").alias("sat"), F.col("n").alias("sn"), F.col("c").alias("sc"))
        least = percent * (F.col("n") + F.col("sn"))
        enough = (100 + percent) * F.least(F.col("n") - F.col("at"), F.col("sn") - F.col("sat")) >= least
        # A shingle may be early in very many documents, which are dealt into parts.
        dealt, hot = frames.deal(early, "h", scratch, "hot-shingles")
        return dealt.join(frames.copies(ones, "h", hot).hint("merge"), ["h", "_part"]).where((F.col("c") != F.col("sc")) & enough)

    def explode_shingles(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(1), shingle)
        at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))], ["node", "h"])

    compared: list[DataFrame] = []
    labels = None
    for step in range(STAR_ROUNDS + 1):
        at = buckets.withColumn("c", F.col("node"))
        if labels is not None:
            at = buckets.join(labels.select(F.col("id").alias("node"), F.col("component").alias("c0")).hint("merge"), "node", "left").withColumn("c", F.coalesce("c0", "node"))
        sizes = at.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("k"))
        most = sizes.groupBy("bucket").agg(F.max(F.struct("k", "c")).alias("x"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("bucket", "k", F.col("x.c").alias("top"))
        if step < STAR_ROUNDS:
            # The star of a bucket: the member with most others around it; in later rounds a weighted draw.
            order = F.col("near") if step == 0 else F.col("near") * (F.pmod(F.xxhash64("node", F.lit(step)), F.lit(1 << 20)) + 1)
            star = at.groupBy("bucket").agg(F.max(F.struct(order.alias("o"), F.col("node").alias("s"), F.col("n").alias("sn"), F.col("c").alias("sc"))).alias("x")).select("bucket", "x.s", "x.sn", "x.sc")
            pairs = at.join(star.hint("merge"), "bucket").where("c <> sc")
        else:
            # A pair in a bucket of two has been compared.
            lone = at.join(most.where("k > 2").hint("merge"), "bucket").where("c <> top").select("bucket", F.col("node").alias("s"), F.col("n").alias("sn"), F.col("c").alias("sc"))
            lone = scratch.keep(lone, "lone")
            if lone.isEmpty():
                break
            around = at.join(lone.select("bucket").distinct().hint("merge"), "bucket", "left_semi").select("node", "n", "c").distinct()
            pairs = reachable(scratch.keep(around, "around"), lone.drop("bucket").distinct())
        pairs = pairs.select(F.col("node").alias("a"), F.col("s").alias("b"), F.col("n").alias("na"), F.col("sn").alias("nb"))
        tried = scratch.keep(sized(pairs), f"tried-{step}")
        if tried.isEmpty():
            continue
        compared.append(tried)
        edges = scratch.keep(confirmed(tried, step), f"linked-{step}")
        if labels is not None:
            edges = edges.unionByName(labels.select(F.col("id").alias("a"), F.col("component").alias("b")))
        labels = scratch.keep(components(edges, scratch, f"parts-{step}"), f"labels-{step}")

    named = classes.select("node", "set", F.col("id").alias("rep"))
    if labels is None:
        named = named.withColumn("component", F.col("rep"))
    else:
        named = scratch.keep(named.join(labels.select(F.col("id").alias("node"), F.col("component").alias("top")).hint("merge"), "node", "left"), "named")
        # Most texts are linked with none, and a group may hold a third of all: neither meets the groups' names in one task.
        linked = named.where("top is not null")
        first = linked.groupBy("top").agg(F.min("rep").alias("component"))
        dealt = first.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(NAME_PARTS - 1))))
        linked = linked.withColumn("_part", F.pmod(F.xxhash64("set"), F.lit(NAME_PARTS)).cast("int")).join(dealt.hint("merge"), ["top", "_part"])
        named = named.where("top is null").select("set", F.col("rep").alias("component")).unionByName(linked.select("set", "component"))
    named = named.select(F.col("set").alias("s"), "component")
    found = signed.drop("keys").join(named.hint("merge"), F.col("set") == F.col("s"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    out = found.select("id", "key", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
    out = frames.Scratch(spark).keep(out, "result")
    scratch.close()
    return out


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stand for their group, with all columns.

    Rows go by their own text, so of an id that repeats, a text that is no copy stays. Of rows that repeat both id and
    text, one stays. Rows with a null id all stay.
    """
    judged = _sorted_out(docs, id_col, text_col, shingle, percent).where("id is not null")
    at, text = (frames.place(docs.columns, c) for c in (id_col, text_col))
    rows = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))]).withColumn("_key", _text_key(F.col(f"_{text}")))
    pair = lambda df: df.select(F.col("id").alias(f"_{at}"), F.col("key").alias("_key"))
    # What goes is as much as the input has copies, so it is never broadcast.
    rows = rows.join(pair(judged.where("not kept")).distinct().hint("merge"), [f"_{at}", "_key"], "left_anti")
    again = pair(judged.where("kept").groupBy("id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    if not again.isEmpty():
        one = rows.join(again.hint("merge"), [f"_{at}", "_key"], "left_semi").dropDuplicates([f"_{at}", "_key"])
        rows = rows.join(again.hint("merge"), [f"_{at}", "_key"], "left_anti").unionByName(one)
    return rows.select(*[f"_{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
