"""Graphs of spots as edge tables: candidate edges, orphans, terminal nodes, bypasses and components."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotloom.functions import geometry as G
from spotloom.operators.quantiles import quantiles

NODE = ["video", "frame", "spot_idx"]


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; without one, as only a local session may be, one of our own."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spotloom-")
    return _own[app]


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared one."""
    return f"{shared_folder(spark)}/spotloom-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, checkpointed in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: of large ones, a fraction of a checkpoint's bytes."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def frame_spine(loc: DataFrame) -> DataFrame:
    """Every frame from the first to the last of a video and its number of spots, also 0."""
    ends = loc.groupBy("video").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    spine = ends.select("video", F.explode(F.sequence("a", "b")).alias("frame"))
    n = loc.groupBy("video", "frame").agg(F.count(F.lit(1)).alias("n"))
    return spine.join(n, ["video", "frame"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def mean_particles(loc: DataFrame) -> DataFrame:
    return frame_spine(loc).groupBy("video").agg(F.avg("n").alias("mean_particles"), F.count(F.lit(1)).alias("frames"))


def next_available_frame(loc: DataFrame) -> DataFrame:
    w = Window.partitionBy("video").orderBy("frame")
    return loc.select("video", "frame").distinct().select("video", "frame", F.lead("frame").over(w).alias("next_frame"))


def _distance(a: str, b: str) -> Column:
    return G.norm(*[F.col(f"{b}.{c}") - F.col(f"{a}.{c}") for c in ("x", "y", "z")])


#: Spots in a tile of a frame, and tiles of it that go to a task together.
TILE, TILES = 256, 16


def adjacent_pairs(loc: DataFrame) -> DataFrame:
    """All pairs of spots of a frame and the next frame that has any, with their distance.

    Spots of a frame are sorted by place and put in tiles, and tile meets tile, so that numbers, and distances of spots that
    share places, repeat within a page of a written file and take few bytes. Tiles of a crowded frame are dealt out in
    pieces, to each of which all of the frame before goes. Only tiles are shuffled; pairs are made last.
    """
    by_frame = Window.partitionBy("video").orderBy("frame")
    sizes = loc.groupBy("video", "frame").agg(F.count(F.lit(1)).alias("n"))
    nxt = sizes.select("video", "frame", F.lead("frame").over(by_frame).alias("dst_frame"), F.lead("n").over(by_frame).alias("dst_n")).where("dst_frame is not null")
    rank = F.row_number().over(Window.partitionBy("video", "frame").orderBy("x", "y", "z", "spot_idx")) - 1
    spot = F.struct("x", "y", "z", "spot_idx")
    tiles = loc.select("video", "frame", spot.alias("spot"), F.floor(rank / TILE).alias("tile")).groupBy("video", "frame", "tile").agg(F.array_sort(F.collect_list("spot")).alias("spots"))
    piece = F.explode(F.sequence(F.lit(0), F.floor((F.col("dst_n") - 1) / (TILE * TILES)).cast("int"))).alias("piece")
    a = tiles.join(nxt.hint("merge"), ["video", "frame"]).select("video", "frame", "dst_frame", piece, F.col("spots").alias("a"))
    b = tiles.select("video", F.col("frame").alias("dst_frame"), F.floor(F.col("tile") / TILES).cast("int").alias("piece"), F.col("spots").alias("b"))
    # Tiles are few bytes and pairs many, so the number of tasks is set by cores rather than by the size of tiles.
    spark, key = loc.sparkSession, ["video", "dst_frame", "piece"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    met = a.repartition(tasks, *key).hint("merge").join(b.repartition(tasks, *key).hint("merge"), key)
    met = met.select("video", "frame", "dst_frame", "b", F.inline("a").alias("ax", "ay", "az", "src_idx"))
    met = met.select("video", "frame", "src_idx", "dst_frame", "ax", "ay", "az", F.inline("b").alias("bx", "by", "bz", "dst_idx"))
    dx, dy, dz = (F.col(f"b{c}") - F.col(f"a{c}") for c in "xyz")
    return met.select("video", "frame", "src_idx", "dst_frame", "dst_idx", G.norm(dx, dy, dz).alias("d"), dx.alias("dx"), dy.alias("dy"))


#: Width of a cell of candidate edges, in thresholds: a spot's surroundings touch 1.7 cells a direction on average.
CELL = 3


def candidate_edges(loc: DataFrame, threshold: float, horizon: int = 3, grid: bool = True) -> DataFrame:
    """Edges between spots at most horizon frames apart beyond the next one, and nearer than the threshold.

    The join is by equality on blocks of as many frames as an edge may span and, unless grid is False, on cells of three
    thresholds, so that crowded frames don't meet whole. One side is in each block and cell that its surroundings touch,
    some five on average, the other in its own, so a pair meets once. Both grow with the input, so they are merged.
    """
    span, wide = horizon + 1, CELL * threshold
    block = lambda f: F.floor(f / span)
    cell = lambda c: F.floor(c / wide)
    a = loc.withColumn("block", F.explode(F.sequence(block(F.col("frame") + 1), block(F.col("frame") + span))))
    b = loc.withColumn("block", block(F.col("frame")))
    if grid:
        near = lambda c: F.sequence(cell(F.col(c) - threshold), cell(F.col(c) + threshold))
        a = a.withColumn("gx", F.explode(near("x"))).withColumn("gy", F.explode(near("y")))
        b = b.withColumn("gx", cell(F.col("x"))).withColumn("gy", cell(F.col("y")))
    a, b = a.hint("merge").alias("a"), b.hint("merge").alias("b")
    on = (F.col("a.video") == F.col("b.video")) & (F.col("a.block") == F.col("b.block"))
    if grid:
        on = on & (F.col("a.gx") == F.col("b.gx")) & (F.col("a.gy") == F.col("b.gy"))
    gap = F.col("b.frame") - F.col("a.frame") - 1
    out = a.join(b, on & gap.between(0, horizon) & (_distance("a", "b") < threshold))
    return out.select(
        F.col("a.video").alias("video"), F.col("a.frame").alias("src_frame"), F.col("a.spot_idx").alias("src_idx"), F.col("b.frame").alias("dst_frame"), F.col("b.spot_idx").alias("dst_idx"),
        gap.alias("gap"), _distance("a", "b").alias("jump_d"),
    )


def _sources(edges: DataFrame) -> DataFrame:
    return edges.select("video", F.col("src_frame").alias("frame"), F.col("src_idx").alias("spot_idx"))


def orphans(loc: DataFrame, edges: DataFrame) -> DataFrame:
    ends = F.explode(F.array(*[F.struct(F.col(f"{p}_frame").alias("frame"), F.col(f"{p}_idx").alias("spot_idx")) for p in ("src", "dst")]))
    linked = edges.select("video", ends.alias("end")).select("video", "end.*").distinct()
    return loc.select(*NODE).join(linked.hint("merge"), NODE, "left_anti")


def terminal_nodes(loc: DataFrame, edges: DataFrame) -> DataFrame:
    """Spots that no edge leaves."""
    return loc.select(*NODE).join(_sources(edges).distinct().hint("merge"), NODE, "left_anti")


def terminal_among_free(loc: DataFrame, edges: DataFrame, taken: DataFrame) -> DataFrame:
    """Spots from which no edge leads to a spot that is not taken yet; those that are taken are asked too."""
    gone = taken.select("video", F.col("frame").alias("dst_frame"), F.col("spot_idx").alias("dst_idx")).distinct()
    return terminal_nodes(loc, edges.join(gone.hint("merge"), ["video", "dst_frame", "dst_idx"], "left_anti"))


def nearest_successors(edges: DataFrame) -> DataFrame:
    """The spots that are the nearest successor of some spot; ties go to the earlier frame and lower number."""
    best = edges.groupBy("video", "src_frame", "src_idx").agg(F.min(F.struct(F.round("jump_d", 6), "dst_frame", "dst_idx")).alias("b"))
    return best.select("video", F.col("b.dst_frame").alias("frame"), F.col("b.dst_idx").alias("spot_idx")).distinct()


#: Ancestors that a task looks for together; those of a frame are never parted.
ANCESTORS = 4096


def _reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each spot of a component, those of a block of frames from which edges lead to it, the latest first.

    Spots come sorted, with the spots that their edges lead to, from the block's first frame on. A bit for each spot of
    the block goes along the edges, and is held only until its spot has come.
    """
    group, bits, members = None, {}, []
    for batch in batches:
        out = []
        for video, c, block, own, f, i, asked, to_f, to_i in batch.itertuples(index=False, name=None):
            if (video, c, block) != group:
                group, bits, members = (video, c, block), {}, []
            here = bits.pop((f, i), 0)
            if here and asked:
                found = [members[k] for k in range(here.bit_length() - 1, -1, -1) if here >> k & 1]
                out.append((video, f, i, block, len(found), [m[0] for m in found], [m[1] for m in found]))
            if own == block:
                here |= 1 << len(members)
                members.append((f, i))
            if here and to_f is not None:
                for to in zip(to_f.tolist(), to_i.tolist(), strict=True):
                    bits[to] = bits.get(to, 0) | here
        yield pd.DataFrame(out, columns=["video", "frame", "spot_idx", "block", "n", "a_frame", "a_idx"])


def ancestors(edges: DataFrame, nodes: DataFrame, most: int | None = None) -> DataFrame:
    """All spots from which edges lead to each node, or the `most` latest of them, with their rank from 1, the latest first.

    Edges lead to later frames. Components share nothing, and in each the ancestors are looked for by blocks of frames of
    about ANCESTORS spots, each in a task that goes through what is later, so no task holds more than a block's bits of
    the spots that edges are about to lead to. Rows, which may be as many as pairs of spots, are made last. Ties in a
    frame go to the higher number.
    """
    if most is not None:
        return _latest_ancestors(edges, nodes, most)
    tasks = 4 * edges.sparkSession.sparkContext.defaultParallelism
    types = {f.name: f.dataType.simpleString() for f in edges.schema}
    edges = written(edges.select("video", "src_frame", "src_idx", "dst_frame", "dst_idx"))
    leads = edges.groupBy("video", F.col("src_frame").alias("frame"), F.col("src_idx").alias("spot_idx")).agg(F.collect_set(F.struct("dst_frame", "dst_idx")).alias("to"))
    ends = _sources(edges).unionByName(edges.select("video", F.col("dst_frame").alias("frame"), F.col("dst_idx").alias("spot_idx"))).distinct()
    parts = written(components(ends, edges))
    frames = parts.groupBy("video", "component", "frame").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("video", "component").orderBy("frame")) - F.col("n")
    frames = frames.select("video", "component", "frame", F.floor(before / ANCESTORS).cast("int").alias("own"))
    rows = parts.join(leads.hint("merge"), NODE, "left").join(nodes.select(*NODE, F.lit(True).alias("asked")).distinct().hint("merge"), NODE, "left")
    rows = rows.join(frames.hint("merge"), ["video", "component", "frame"])
    rows = rows.select("video", "component", F.explode(F.sequence(F.lit(0), "own")).alias("block"), "own", "frame", "spot_idx", F.coalesce("asked", F.lit(False)).alias("asked"), F.col("to.dst_frame").alias("to_f"), F.col("to.dst_idx").alias("to_i"))
    rows = rows.repartition(tasks, "video", "component", "block").sortWithinPartitions("video", "component", "block", "frame", "spot_idx")
    frame, spot = types["dst_frame"], types["dst_idx"]
    found = written(rows.mapInPandas(_reached, f"video string, frame {frame}, spot_idx {spot}, block int, n bigint, a_frame array<{types['src_frame']}>, a_idx array<{types['src_idx']}>"))
    later = F.sum("n").over(Window.partitionBy(*NODE).orderBy(F.desc("block"))) - F.col("n")
    first = found.select(*NODE, "block", "n").withColumn("later", later).where("later > 0").select(*NODE, "block", "later")
    found = found.join(first.hint("merge"), [*NODE, "block"], "left")
    pairs = found.select(*NODE, F.coalesce("later", F.lit(0)).alias("later"), F.posexplode(F.arrays_zip("a_frame", "a_idx")).alias("at", "a"))
    return pairs.select(*NODE, "a.a_frame", "a.a_idx", (F.col("later") + F.col("at") + 1).cast("int").alias("rank"))


def _latest_ancestors(edges: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """The `most` latest ancestors of each node.

    What lies between a node and one of its latest ancestors is later still, so only the latest are kept at any time, of
    the edges into a spot too, and `most` rounds are enough, each a join by key. A round asks only for what can still
    come before the last of a full list, and nodes for which nothing can are set aside. Ties in a frame go to the higher
    number. Each round is checkpointed.
    """
    into = edges.select("video", F.col("dst_frame").alias("frame"), F.col("dst_idx").alias("spot_idx"), F.col("src_frame").alias("a_frame"), F.col("src_idx").alias("a_idx"))
    latest = Window.partitionBy(*NODE).orderBy(F.desc("a_frame"), F.desc("a_idx"))
    last = F.max(F.when(F.col("rank") == most, F.struct(F.col("a_frame").alias("frame"), F.col("a_idx").alias("spot")))).over(Window.partitionBy(*NODE))
    live = F.max("front").over(Window.partitionBy(*NODE))

    def ranked(rows: DataFrame, number: Column) -> DataFrame:
        kept = rows.withColumn("rank", number.over(latest)).where(F.col("rank") <= most).withColumn("last", last)
        open_ = F.col("new") & (F.col("last").isNull() | (F.col("a_frame") > F.col("last.frame")))
        return kept.withColumn("front", open_).withColumn("live", live).drop("new")

    # Equal edges share their rank, so that a repeat takes no other's place.
    first = cut_lineage(ranked(into.withColumn("new", F.lit(True)), F.dense_rank()).distinct())
    back = first.select("video", F.col("frame").alias("a_frame"), F.col("spot_idx").alias("a_idx"), F.col("a_frame").alias("p_frame"), F.col("a_idx").alias("p_idx"))
    now = first.join(nodes.select(*NODE).distinct().hint("merge"), NODE, "left_semi")
    out = [*NODE, "a_frame", "a_idx", "rank"]
    done = now.where("not live").select(*out)
    for _ in range(most - 1):
        now = now.where("live")
        front = now.where("front").select(*NODE, "a_frame", "a_idx", "last")
        step = front.join(back.hint("merge"), ["video", "a_frame", "a_idx"]).where(F.col("last").isNull() | (F.struct(F.col("p_frame").alias("frame"), F.col("p_idx").alias("spot")) > F.col("last")))
        step = step.select(*NODE, F.col("p_frame").alias("a_frame"), F.col("p_idx").alias("a_idx"), F.lit(True).alias("new"))
        both = step.unionByName(now.select(*NODE, "a_frame", "a_idx", F.lit(False).alias("new"))).groupBy(*NODE, "a_frame", "a_idx").agg(F.every("new").alias("new"))
        now = cut_lineage(ranked(both, F.row_number()))
        done = done.unionByName(now.where("not live").select(*out))
        if now.where("live").isEmpty():
            return done
    return done.unionByName(now.where("live").select(*out))


#: Edges into middle spots that a group meets, the frames of those that stay together, and steps met at a time.
STEPS, STEP_FRAMES, PATHS = 100_000, 8, 4_000_000


def _met(into: pd.DataFrame, onward: pd.DataFrame) -> pd.DataFrame:
    """Distinct pairs u, v of which into leads from u to some m, and onward from m to v, some paths at a time."""
    if not len(into) or not len(onward):
        return pd.DataFrame({"video": [], "u": [], "v": []}).astype({"video": object, "u": np.int64, "v": np.int64})
    of, names = pd.factorize(pd.concat([into.video, onward.video]))
    dense = lambda c: np.unique(c, return_inverse=True)
    (m, at), (u, i), (v, j) = dense(np.concatenate([into.m, onward.m])), dense(into.u), dense(onward.v)
    key, n = of * len(m) + at, len(into)
    order = np.argsort(key[n:], kind="stable")
    j, head = j[order], of[:n] * len(u) + i
    first = np.argsort(head, kind="stable")  # all of a source is met together, so that its pairs are told apart at once
    head, there = head[first], key[n:][order]
    start, stop = (np.searchsorted(there, key[:n][first], side) for side in ("left", "right"))
    count = stop - start
    ends, out = np.cumsum(count), []
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(PATHS, ends[-1], PATHS)), n)).tolist()
    for low, high in zip([0, *cuts[:-1]], cuts, strict=True):
        c = count[low:high]
        place = np.arange(c.sum()) + np.repeat(start[low:high] - np.cumsum(c) + c, c)
        out.append(np.unique(np.repeat(head[low:high], c) * len(v) + j[place]))
    source, target = np.divmod(np.unique(np.concatenate(out)), len(v))
    return pd.DataFrame({"video": names[source // len(u)], "u": u[source % len(u)], "v": v[target]})


def _through(into: DataFrame, onward: DataFrame) -> DataFrame:
    """Distinct pairs of spots of which an edge of into leads from the first to a spot, and one of onward from there to the second.

    Paths are many more than pairs, so frames of middle spots are met in groups, of which only distinct pairs come.
    """
    types = {f.name: f.dataType.simpleString() for f in into.schema}
    groups = 1 + into.count() // STEPS
    group = lambda f: F.pmod(F.xxhash64("video", F.floor(F.col(f) / STEP_FRAMES)), F.lit(groups))
    a = into.select("video", group("dst_frame").alias("g"), node_code("src_frame", "src_idx").alias("u"), node_code("dst_frame", "dst_idx").alias("m"))
    b = onward.select(F.col("video").alias("video"), group("src_frame").alias("g"), node_code("src_frame", "src_idx").alias("m"), node_code("dst_frame", "dst_idx").alias("v"))
    # Groups are few, and the work of each much, so they are dealt out whatever their bytes.
    tasks = 4 * into.sparkSession.sparkContext.defaultParallelism
    a, b = (side.repartition(tasks, "g") for side in (a, b))
    met = a.groupBy("g").cogroup(b.groupBy("g")).applyInPandas(_met, "video string, u bigint, v bigint").distinct()
    frame, spot = (lambda c: F.shiftright(c, SPOT_BITS)), (lambda c: F.col(c).bitwiseAND((1 << SPOT_BITS) - 1))
    ends = [x.cast(types[f"{p}_{n}"]).alias(f"{p}_{n}") for p, c in (("src", "u"), ("dst", "v")) for n, x in (("frame", frame(c)), ("idx", spot(c)))]
    return met.select("video", *ends)


def without(edges: DataFrame, removed: DataFrame, loc: DataFrame, threshold: float) -> DataFrame:
    """Edges between the spots that stay when others are removed, the earliest first, and each bypassed.

    A bypass leads from a spot to what the removed one led to, where that is nearer than the threshold; it may lead to
    another spot that goes, which is bypassed in turn. Rounds are as many as such spots follow each other within the
    threshold of the first. Edges are written once, with whether their ends go; a round adds only what is new.
    """
    gone = cut_lineage(removed.select(*NODE).distinct())
    end = lambda p: gone.select("video", F.col("frame").alias(f"{p}_frame"), F.col("spot_idx").alias(f"{p}_idx"), F.lit(True).alias(f"{p}_gone")).hint("merge")
    at = lambda p: loc.select("video", F.col("frame").alias(f"{p}_frame"), F.col("spot_idx").alias(f"{p}_idx"), *[F.col(c).alias(f"{p}_{c}") for c in "xyz"]).hint("merge")
    src, dst = ["video", "src_frame", "src_idx"], ["video", "dst_frame", "dst_idx"]
    pair = [*src, *dst[1:]]
    goes = lambda p: F.col(f"{p}_gone").isNotNull()
    every = edges.select(*pair, "jump_d").join(end("dst"), dst, "left").join(end("src"), src, "left")
    every = written(every.select(*pair, "jump_d", goes("src").alias("src_goes"), goes("dst").alias("dst_goes")))
    onward = every.where("src_goes")
    distance = G.norm(*[F.col(f"dst_{c}") - F.col(f"src_{c}") for c in "xyz"])
    front = every.where("not src_goes and dst_goes").select(*pair)
    seen, kept = front, every.where("not src_goes and not dst_goes").select(*pair, "jump_d")
    more = None
    while True:
        step = _through(front, onward).join(at("src"), src).join(at("dst"), dst).select(*pair, distance.alias("jump_d")).where(F.col("jump_d") < threshold)
        near = step.join(end("dst"), dst, "left").select(*pair, "jump_d", goes("dst").alias("dst_goes"))
        near = written(near)
        found = near.where("not dst_goes").select(*pair, "jump_d")
        more = found if more is None else more.unionByName(found)
        front = written(near.where("dst_goes").select(*pair).join(seen.hint("merge"), pair, "left_anti"))
        if front.isEmpty():
            return kept.unionByName(more.dropDuplicates(pair).join(kept.select(*pair).hint("merge"), pair, "left_anti"))
        seen = seen.unionByName(front)


def bypass_edges(edges: DataFrame, removed: DataFrame, loc: DataFrame, threshold: float) -> DataFrame:
    """Edges from predecessors to successors of removed nodes that are nearer than the threshold."""
    gone = removed.select("video", F.col("frame").alias("dst_frame"), F.col("spot_idx").alias("dst_idx")).distinct()
    every = written(edges.select("video", "src_frame", "src_idx", "dst_frame", "dst_idx"))
    pairs = _through(every.join(gone.hint("merge"), ["video", "dst_frame", "dst_idx"], "left_semi"), every)
    at = lambda p: loc.select("video", F.col("frame").alias(f"{p}_frame"), F.col("spot_idx").alias(f"{p}_idx"), *[F.col(c).alias(f"{p}_{c}") for c in "xyz"])
    both = pairs.join(at("src").hint("merge"), ["video", "src_frame", "src_idx"]).join(at("dst").hint("merge"), ["video", "dst_frame", "dst_idx"])
    d = G.norm(*[F.col(f"dst_{c}") - F.col(f"src_{c}") for c in "xyz"])
    return both.select("video", "src_frame", "src_idx", "dst_frame", "dst_idx", d.alias("jump_d")).where(F.col("jump_d") < threshold)


#: Bits of a spot's number in a node's code; frames and spots are 32-bit numbers, so codes never meet.
SPOT_BITS = 31


def node_code(frame: str, spot: str) -> Column:
    return F.col(frame).cast("bigint") * (1 << SPOT_BITS) + F.col(spot)


#: Edges that a task joins into stars at a time, and frames whose edges it gets together.
EDGES_TOGETHER, SLAB = 1_000_000, 32


def _least(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least that the edges a, b connect it to."""
    label = np.arange(n)
    while True:
        a, b = label[a], label[b]
        low, high = np.minimum(a, b), np.maximum(a, b)
        a, b = low[low < high], high[low < high]
        if not len(a):
            return label
        np.minimum.at(label, b, a)
        while (label[label] != label).any():
            label = label[label]


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each node the least that the edges at hand connect it to, itself for the least."""

    def out(edges: pd.DataFrame) -> pd.DataFrame:
        of, names = pd.factorize(edges.video)
        of, code = np.tile(of, 2), np.concatenate([edges.u.to_numpy(), edges.v.to_numpy()])
        order = np.lexsort((code, of))
        of, code = of[order], code[order]
        first = np.append(True, (of[1:] != of[:-1]) | (code[1:] != code[:-1]))
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(first) - 1
        of, code = of[first], code[first]
        return pd.DataFrame({"video": names[of], "n": code, "root": code[_least(*np.split(place, 2), len(code))]})

    held, taken = [], 0
    for batch in batches:
        held, taken = [*held, batch], taken + len(batch)
        if taken >= EDGES_TOGETHER:
            yield out(pd.concat(held, ignore_index=True))
            held, taken = [], 0
    if taken:
        yield out(pd.concat(held, ignore_index=True))


def _labels(edges: DataFrame) -> DataFrame:
    """video, n, c: nodes of edges u, v with the least they are connected to, found in rounds that follow the logarithm of the longest path."""
    both = cut_lineage(edges.unionByName(edges.select("video", F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut_lineage(both.groupBy("video", F.col("u").alias("n")).agg(F.least(F.col("u"), F.min("v")).alias("c")))
    while True:
        around = both.join(labels.select("video", F.col("n").alias("v"), F.col("c").alias("vc")).hint("merge"), ["video", "v"]).groupBy("video", F.col("u").alias("n")).agg(F.min("vc").alias("m"))
        near = labels.join(around.hint("merge"), ["video", "n"]).select("video", "n", "c", F.least("c", "m").alias("l"))
        jump = near.select("video", F.col("n").alias("l"), F.col("l").alias("ll"))
        new = cut_lineage(near.join(jump.hint("merge"), ["video", "l"]).select("video", "n", "c", F.least("l", "ll").alias("k")))
        same = new.where("k <> c").isEmpty()
        labels = new.select("video", "n", F.col("k").alias("c"))
        if same:
            return labels


def components(loc: DataFrame, edges: DataFrame) -> DataFrame:
    """Each spot with the smallest node, as frame * 2^31 + spot_idx, it is connected to.

    Edges of some frames are joined into stars by a task, so what is left is a graph of the stars' roots, with a link for
    each node that two tasks have. It is far smaller and goes the same way, at last in one task; where it does not
    shrink, labels spread in rounds. Only spots with an edge take part; the others are their own component.
    """
    tasks = 4 * loc.sparkSession.sparkContext.defaultParallelism
    left = edges.select("video", node_code("src_frame", "src_idx").alias("u"), node_code("dst_frame", "dst_idx").alias("v"))
    homes, before = [], math.inf
    while True:
        if before > EDGES_TOGETHER:
            left = left.repartition(tasks, "video", F.floor(F.col("u") / (SLAB << SPOT_BITS))).sortWithinPartitions("video", "u")
        else:
            left = left.coalesce(1)
        roots = left.mapInPandas(_stars, "video string, n bigint, root bigint").groupBy("video", "n").agg(F.array_sort(F.collect_set("root")).alias("roots"))
        roots = written(roots.select("video", "n", F.col("roots")[0].alias("c"), F.slice("roots", 2, 1 << 30).alias("others")))
        homes.append(roots.select("video", "n", "c"))
        left = roots.where("size(others) > 0").select("video", F.col("c").alias("u"), F.explode("others").alias("v")).distinct()
        if before <= EDGES_TOGETHER:
            break
        left = written(left)
        size = left.count()
        if not size:
            break
        if EDGES_TOGETHER < size and size > before / 2:
            homes.append(_labels(left))
            break
        before = size
    labels = homes.pop()
    while homes:
        higher = labels.select("video", F.col("n").alias("c"), F.col("c").alias("higher"))
        labels = homes.pop().join(higher.hint("merge"), ["video", "c"], "left").select("video", "n", F.coalesce("higher", "c").alias("c"))
    nodes = loc.select("video", "frame", "spot_idx", node_code("frame", "spot_idx").alias("n"))
    return nodes.join(labels.hint("merge"), ["video", "n"], "left").select("video", "frame", "spot_idx", F.coalesce("c", "n").alias("component"))


def match_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    """For each path (video, path, nodes) of after, the first path of before, of two nodes at least, whose last node it holds; null for none."""
    ends = before.where(F.size("nodes") > 1).select("video", F.col("path").alias("prev"), F.element_at("nodes", -1).alias("node"))
    return after.select("video", "path", F.explode("nodes").alias("node")).join(ends, ["video", "node"], "left").groupBy("video", "path").agg(F.min("prev").alias("prev"))


def shared_frames(loc: DataFrame) -> DataFrame:
    """Frames that have spots in every video."""
    videos = loc.agg(F.count_distinct("video").alias("_all"))  # one row
    return loc.select("video", "frame").distinct().groupBy("frame").agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(videos)).where("_n = _all").select("frame")


def empirical_pdf(distances: DataFrame, column: str = "d", bins: int = 39, top: float = 20.0) -> DataFrame:
    """Density of distances over equal bins of [0, top], the last closed."""
    width = top / bins
    at = F.least(F.floor(F.col(column) / width), F.lit(bins - 1)).cast("int")
    n = distances.where(F.col(column).between(0, top)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("density", F.col("n") / (F.sum("n").over(Window.partitionBy(F.lit(0))) * width))  # a row a bin


def jump_law(distances: DataFrame, column: str = "d", bins: int = 39, top: float = 20.0, least: int = 1000) -> DataFrame:
    """bin, density: the density of jumps by every bin of [0, top]; of fewer than `least` jumps, that of an exponential law of mean one."""
    width = top / bins
    every = distances.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    measured = empirical_pdf(distances, column, bins, top).select("bin", "density")
    n = distances.agg(F.count(column).alias("_n"))  # one row
    at = F.col("bin") * width
    law = (F.exp(-at) - F.exp(-(at + width))) / width
    out = every.join(measured, "bin", "left").join(F.broadcast(n))
    return out.select("bin", F.when(F.col("_n") < least, law).otherwise(F.coalesce("density", F.lit(0.0))).alias("density"))


def jump_threshold(distances: DataFrame, column: str = "d") -> DataFrame:
    """Two and a half standard deviations of distances between their 2.5 and 97.5 percentiles, five at least."""
    ends = quantiles(distances, column, [], lo=0.025, hi=0.975)
    inner = distances.join(F.broadcast(ends)).where(F.col(column).between(F.col("lo"), F.col("hi")))  # a single row
    return inner.agg(F.greatest(F.lit(5.0), 2.5 * F.stddev_pop(column)).alias("threshold"))


def adjacent_values(loc: DataFrame, column: str) -> DataFrame:
    """A row a frame that another follows: the distinct values of a column there (a) and in that other (b), with how many spots have each."""
    n = loc.where(F.col(column).isNotNull() & ~F.isnan(column)).groupBy("video", "frame", F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    own = n.groupBy("video", "frame").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("of"))
    part = lambda c: [F.col(f"{c}.v").alias(c), F.col(f"{c}.n").alias(f"{c}_n")]
    a = own.join(next_available_frame(loc).where("next_frame is not null").hint("merge"), ["video", "frame"]).select("video", F.col("next_frame").alias("frame"), F.col("of").alias("a"))
    return a.join(own.withColumnRenamed("of", "b").hint("merge"), ["video", "frame"]).select(*part("a"), *part("b"))


def _upto(a: np.ndarray, b: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of v and of a, how many of b (sorted) have a rounded difference b - a of at most v."""
    v = np.asarray(v, float)[..., None]
    at = np.searchsorted(b, a + v, "right")
    while (back := (at > 0) & (b[np.maximum(at - 1, 0)] - a > v)).any():
        at[back] -= 1
    while (on := (at < len(b)) & (b[np.minimum(at, len(b) - 1)] - a <= v)).any():
        at[on] += 1
    return at


#: Places at which differences are counted in a round, and rounds: a bracket of doubles is 2^64 wide at most, and 65^11 is more.
PROBES, ROUNDS = 64, 11


def _ordinal(x: float) -> int:
    """The place of a double among all, so that halving a bracket halves the numbers in it."""
    i = int(np.float64(x).view(np.int64))
    return i if i >= 0 else -(i & 0x7FFFFFFFFFFFFFFF)


def _double(i: int) -> float:
    return float(np.int64(i).view(np.float64)) if i >= 0 else -float(np.int64(-i).view(np.float64))


def jump_threshold_of(loc: DataFrame, column: str = "x") -> DataFrame:
    """jump_threshold of the differences of a column between all spots of a frame and the next, without a row a pair.

    A frame's values are sorted, so that those of its differences up to a number are counted by searches. Ranks are
    enclosed by counting at some places in each round, exactly; only counts come to the driver. Sums between the
    percentiles are running sums over the sorted values.
    """
    spark = loc.sparkSession
    # Values are few bytes and searches many, so the number of tasks is set by cores.
    pairs = written(adjacent_values(loc, column).repartition(4 * spark.sparkContext.defaultParallelism))
    ends = pairs.agg(F.min(F.element_at("b", 1) - F.element_at("a", -1)).alias("lo"), F.max(F.element_at("b", -1) - F.element_at("a", 1)).alias("hi")).first()
    total_of = F.aggregate("a_n", F.lit(0.0), lambda s, x: s + x) * F.aggregate("b_n", F.lit(0.0), lambda s, x: s + x)
    total = int(pairs.agg(F.sum(total_of.cast("decimal(38,0)"))).first()[0] or 0)
    if not total:
        return spark.createDataFrame([(None,)], "threshold double")

    def counts(places: list[float]) -> dict[float, int]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                n = np.zeros(len(places), np.int64)
                for a, a_n, b, b_n in zip(batch.a, batch.a_n, batch.b, batch.b_n, strict=True):
                    upto = np.append(0.0, np.cumsum(b_n))
                    for i in range(0, len(places), PROBES):
                        n[i : i + PROBES] += (upto[_upto(a, b, places[i : i + PROBES])] @ a_n).astype(np.int64)
                yield pd.DataFrame({"at": range(len(places)), "n": n})

        rows = pairs.mapInPandas(run, "at int, n bigint").groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
        return {places[r["at"]]: int(r.n) for r in rows}

    ranks = [(q, f(q * (total - 1))) for q in (0.025, 0.975) for f in (math.floor, math.ceil)]
    # The value of a rank is the least with more differences up to it than the rank: above low, and at most high.
    low = {k: _ordinal(ends.lo) - 1 for _, k in ranks}
    high = {k: _ordinal(ends.hi) for _, k in ranks}
    for _ in range(ROUNDS):
        probes = {k: [low[k] + (high[k] - low[k]) * i // (PROBES + 1) for i in range(1, PROBES + 1)] for k in low if high[k] - low[k] > 1}
        if not probes:
            break
        found = counts(sorted({_double(p) for places in probes.values() for p in places}))
        for k, places in probes.items():
            for p in places:
                if found[_double(p)] > k:
                    high[k] = min(high[k], p)
                else:
                    low[k] = max(low[k], p)
    value = [_double(high[k]) for _, k in ranks]
    share = [q * (total - 1) - k for q, k in ranks[::2]]
    lo, hi = (value[2 * i] + (value[2 * i + 1] - value[2 * i]) * share[i] for i in range(2))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        below = math.nextafter(lo, -math.inf)
        for batch in batches:
            n = s = q = 0.0
            for a, a_n, b, b_n in zip(batch.a, batch.a_n, batch.b, batch.b_n, strict=True):
                start, stop = _upto(a, b, below), _upto(a, b, hi)
                of = [np.append(0.0, np.cumsum(b_n * b**p)) for p in range(3)]
                n0, n1, n2 = (c[stop] - c[start] for c in of)
                n, s, q = n + (a_n * n0).sum(), s + (a_n * (n1 - a * n0)).sum(), q + (a_n * (n2 - 2 * a * n1 + a * a * n0)).sum()
            yield pd.DataFrame({"n": [n], "s": [s], "q": [q]})

    out = pairs.mapInPandas(sums, "n double, s double, q double").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    return out.select(F.greatest(F.lit(5.0), 2.5 * F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean))).alias("threshold"))
