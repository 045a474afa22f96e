"""Benchmark decontamination by winnowing.

Words are hashed; a fingerprint is a hash of `K` words, and of each run of `WINDOW` fingerprints the smallest is kept.
Any span of K + WINDOW - 1 = 10 words that a document shares with an item therefore shares a kept fingerprint with
it. Kept fingerprints of documents are looked up among those of the benchmark; around each hit the ten-word windows
that hold it are compared, which extends the hit to the whole shared span. Items of fewer than ten words are one
window of their own length and are looked up by it.

The benchmark's windows are handed to the tasks while they number at most `BROADCAST_WINDOWS` (a proven bound: they
are counted first). A larger benchmark is joined: fingerprints meet in a shuffle, and only documents with a known one,
and windows around it, go on.

Defined cases: null and empty texts have no words and are clean; an item without words has no window; an item with a
null id is left out; items with equal texts are all found; an empty benchmark leaves all documents clean. Documents
that repeat an id are judged by row. Texts are taken whole. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotloom.llm import bytewords as W
from spotloom.llm import frames

SPAN, K = 10, 5
WINDOW = SPAN - K + 1
#: At 16 bytes each this is 32 MB a task.
BROADCAST_WINDOWS = 2_000_000


def winnow(grams: np.ndarray) -> np.ndarray:
    """Whether each of a text's fingerprints is the smallest in some full window (ties: all of them)."""
    least = W.sliding_min(grams, WINDOW)
    keep = np.zeros(len(grams), bool)
    for j in range(WINDOW):
        keep[j : j + len(least)] |= grams[j : j + len(least)] == least
    return keep


def item_windows(column: pa.Array) -> list[tuple[int, np.ndarray]]:
    """Window length and hashes of the windows of each item."""
    h, offs = W.word_hashes(column, W.ALNUM)
    return [(min(SPAN, b - a), W.ngrams(h[a:b], min(SPAN, b - a)) if b > a else h[:0]) for _, a, b in W.rows(offs)]


def item_prints(column: pa.Array) -> list[np.ndarray]:
    """The kept fingerprints of each item of ten words or more."""
    h, offs = W.word_hashes(column, W.ALNUM)
    out = []
    for _, a, b in W.rows(offs):
        grams = W.ngrams(h[a:b], K) if b - a >= SPAN else h[:0]
        out.append(np.unique(grams[winnow(grams)]) if len(grams) else grams)
    return out


class Index:
    """The windows of a benchmark: sorted hashes by length, each with the items that hold it, and fingerprints."""

    def __init__(self, ids: list, texts: pa.Array) -> None:
        self.names = sorted({str(i) for i in ids})
        number = {n: i for i, n in enumerate(self.names)}
        rows: dict[int, list[tuple[np.ndarray, int]]] = {}
        for name, (length, hashes) in zip(ids, item_windows(texts), strict=True):
            if length:
                rows.setdefault(length, []).append((np.unique(hashes), number[str(name)]))
        self.windows = {}
        for length, got in rows.items():
            hashes = np.concatenate([h for h, _ in got])
            items = np.repeat([i for _, i in got], [len(h) for h, _ in got])
            order = np.lexsort((items, hashes))
            keys, first = np.unique(hashes[order], return_index=True)
            self.windows[length] = keys, np.append(first, len(hashes)), items[order]
        prints = item_prints(texts)
        self.prints = np.unique(np.concatenate([*prints, np.zeros(0, np.uint64)]))


def _member(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of values in sorted keys, -1 where there is none."""
    if not len(keys):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, -1)


class Filter:
    """A bitmap that rules most values out before they are searched for among sorted keys."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(16, min(24, int(len(keys) * 32).bit_length()))
        self.keys = keys
        self.map = np.zeros(1 << self.bits, bool)
        self.map[(keys >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def find(self, values: np.ndarray) -> np.ndarray:
        """Indices of the values that are keys."""
        maybe = np.flatnonzero(self.map[(values >> np.uint64(64 - self.bits)).astype(np.int64)])
        return maybe[_member(values[maybe], self.keys) >= 0]


def judge(column: pa.Array, index: Index, filters: dict) -> tuple[list[int], list[int], list[list[str]], list[list[tuple[int, int]]]]:
    """Words, hit words, ids of items found, and the hit spans (word numbers) of each text."""
    h, offs = W.word_hashes(column, W.ALNUM)
    n = len(offs) - 1
    hit = np.zeros(len(h) + 1, np.int64)
    found: list[set] = [set() for _ in range(n)]
    row_of = lambda at: np.searchsorted(offs, at, "right") - 1

    def mark(starts: np.ndarray, length: int, keys: np.ndarray, first: np.ndarray, items: np.ndarray, hashes: np.ndarray) -> None:
        starts = np.unique(starts)
        starts = starts[starts + length <= offs[row_of(starts) + 1]]
        where = _member(hashes[starts], keys)
        starts, where = starts[where >= 0], where[where >= 0]
        np.add.at(hit, starts, 1)
        np.add.at(hit, starts + length, -1)
        rows_ = row_of(starts)
        for r, w in set(zip(rows_.tolist(), where.tolist(), strict=True)):
            found[r].update(items[first[w] : first[w + 1]].tolist())

    for length, (keys, first, items) in index.windows.items():
        grams = W.ngrams(h, length)
        if not len(grams):
            continue
        if length < SPAN:
            mark(filters[length].find(grams), length, keys, first, items, grams)
            continue
        fives = W.ngrams(h, K)
        at = filters["prints"].find(fives)
        if not len(at):
            continue
        # Winnowing is a matter of each text; what it keeps is looked at only where a print might be.
        keep = []
        for r in np.unique(row_of(at)).tolist():
            a, b = int(offs[r]), int(offs[r + 1])
            if b - a >= SPAN:
                kept = winnow(fives[a : b - K + 1])
                mine = at[(at >= a) & (at <= b - K)]
                keep.append(mine[kept[mine - a]])
        at = np.concatenate([*keep, np.zeros(0, np.int64)]).astype(np.int64)
        row = row_of(at)
        around = at[:, None] - np.arange(WINDOW)[None, :]
        around = around[around >= offs[row][:, None]]
        mark(around, length, keys, first, items, grams)
    covered = np.cumsum(hit)[:-1] > 0
    words, hits, spans = np.diff(offs).tolist(), [], []
    total = np.append(0, np.cumsum(covered))
    hits = (total[offs[1:]] - total[offs[:-1]]).tolist()
    for r, a, b in W.rows(offs):
        if not hits[r]:
            spans.append([])
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], covered[a:b].astype(np.int8), [0]])))
        spans.append(list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)))
    return words, hits, [sorted(index.names[i] for i in f) for f in found], spans


_OUT = "id {}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start: bigint, end: bigint>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _by_index(df: DataFrame, bench: DataFrame, kind: str) -> DataFrame:
    rows = bench.toArrow()
    index = Index(rows.column(0).to_pylist(), rows.column(1).combine_chunks())
    shared = df.sparkSession.sparkContext.broadcast(index)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, hits, items, spans = judge(batch.column(1), shared.value, _filters(shared.value))
        cells = [[{"start": a, "end": b} for a, b in s] for s in spans]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(cells, _SPANS)], ["id", "n_words", "n_hit", "items", "spans"])

    return frames.map_batches(df, one, _OUT.format(kind))


def _filters(index: Index) -> dict:
    if not hasattr(index, "filters"):
        index.filters = {n: Filter(keys) for n, (keys, _, _) in index.windows.items()} | {"prints": Filter(index.prints)}
    return index.filters


def _by_join(df: DataFrame, bench: DataFrame, scratch: frames.Scratch) -> DataFrame:
    """row, n_hit, items and spans of the documents with a hit, by joins, for a benchmark of any size.

    df has row (a number of its own for each document) and text, and is a written table. Documents go on only if a
    print of theirs is known, and windows only if they hold such a print.
    """
    text = bench.select(F.col("id").cast("string").alias("id"), "text")

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [(n, np.unique(h)) for n, h in item_windows(batch.column(1))]
        at = pa.array(np.repeat(np.arange(len(got)), [len(h) for _, h in got]))
        hashes = np.concatenate([*(h for _, h in got), np.zeros(0, np.uint64)])
        lengths = np.repeat([n for n, _ in got], [len(h) for _, h in got]).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(lengths), pa.array(hashes.view(np.int64))], ["item", "len", "w"])

    def prints(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([*item_prints(batch.column(1)), np.zeros(0, np.uint64)]).view(np.int64))], ["p"])

    held = scratch.keep(frames.map_batches(text, windows, "item string, len int, w bigint"), "windows")
    lengths = sorted(r[0] for r in held.select("len").distinct().collect() if r[0] < SPAN)  # at most nine
    # An item of fewer words than a span is looked up by its one window.
    known = frames.map_batches(text.select("id", "text"), prints, "p bigint").select(F.lit(SPAN).alias("len"), "p")
    known = scratch.keep(known.unionByName(held.where(F.col("len") < SPAN).select("len", F.col("w").alias("p"))).distinct(), "known")

    def doc_prints(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Each document's places of kept prints, with the prints: row, at, len and p."""
        h, offs = W.word_hashes(batch.column(1), W.ALNUM)
        fives, short = W.ngrams(h, K), {n: W.ngrams(h, n) for n in lengths}
        rows, at, size, p = [], [], [], []
        for r, a, b in W.rows(offs):
            found = [(n, np.arange(b - a - n + 1), short[n][a : b - n + 1]) for n in lengths if b - a >= n]
            if b - a >= SPAN:
                kept = np.flatnonzero(winnow(fives[a : b - K + 1]))
                found.append((SPAN, kept, fives[a + kept]))
            for n, places, hashes in found:
                rows.append(np.full(len(places), r))
                at.append(places)
                size.append(np.full(len(places), n, np.int32))
                p.append(hashes)
        flat = [np.concatenate([*v, np.zeros(0, t)]) for v, t in ((rows, np.int64), (at, np.int64), (size, np.int32), (p, np.uint64))]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(flat[0])), pa.array(flat[1]), pa.array(flat[2]), pa.array(flat[3].view(np.int64))], ["row", "at", "len", "p"])

    spots = frames.map_batches(df.select("row", "text"), doc_prints, "row bigint, at bigint, len int, p bigint")
    spots = scratch.keep(spots.join(known, ["len", "p"], "left_semi").select("row", "at", "len"), "spots")
    live = df.select("row", "text").join(spots.groupBy("row").agg(F.collect_set(F.struct("len", "at")).alias("at")), "row")

    def around(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The windows that hold a known print: row, start, len and w."""
        h, offs = W.word_hashes(batch.column(1), W.ALNUM)
        grams = {n: W.ngrams(h, n) for n in (*lengths, SPAN)}
        rows, starts, size, hashes = [], [], [], []
        for r, a, b in W.rows(offs):
            for n, s in _starts(batch.column(2)[r].as_py(), b - a):
                rows.append(np.full(len(s), r))
                starts.append(s)
                size.append(np.full(len(s), n, np.int32))
                hashes.append(grams[n][a + s])
        flat = [np.concatenate([*v, np.zeros(0, t)]) for v, t in ((rows, np.int64), (starts, np.int64), (size, np.int32), (hashes, np.uint64))]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(flat[0])), pa.array(flat[1]), pa.array(flat[2]), pa.array(flat[3].view(np.int64))], ["row", "start", "len", "w"])

    near = frames.map_batches(live, around, "row bigint, start bigint, len int, w bigint")
    matched = scratch.keep(near.join(held.select("len", "w").distinct(), ["len", "w"], "left_semi"), "matched")
    items = matched.select("row", "len", "w").distinct().join(held, ["len", "w"]).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    # Spans that touch or overlap are one: a new one begins past the furthest end so far.
    order = Window.partitionBy("row").orderBy("start", "len")
    furthest = F.max(F.col("start") + F.col("len")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = matched.withColumn("new", F.coalesce((F.col("start") > furthest).cast("int"), F.lit(1)))
    apart = apart.withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = apart.groupBy("row", "span").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("len")).alias("end"))
    spans = spans.groupBy("row").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    return spans.join(items, "row")


def _starts(spots: list[dict], words: int) -> list[tuple[int, np.ndarray]]:
    """By window length, where the windows begin that hold a print at one of the spots; words is the text's number."""
    by: dict[int, list[int]] = {}
    for s in spots:
        by.setdefault(s["len"], []).append(s["at"])
    if SPAN in by:
        starts = np.unique((np.array(by[SPAN])[:, None] - np.arange(WINDOW)[None, :]).ravel())
        by[SPAN] = starts[(starts >= 0) & (starts + SPAN <= words)]
    return [(n, np.unique(s)) for n, s in by.items()]


def _numbered(df: DataFrame, scratch: frames.Scratch) -> DataFrame:
    """df, written with row, a number for each row. Ids may repeat or be null, so they don't tell rows apart."""
    return scratch.keep(df.withColumn("row", F.monotonically_increasing_id()), "numbered")


def _benchmark(benchmark: DataFrame, item_id: str, item_text: str) -> tuple[DataFrame, float]:
    """Items with id and text, and a bound on their windows: an item has at most half as many words as bytes and one more."""
    bench = frames.pick(benchmark, id=item_id, text=item_text).where("id is not null and text is not null")
    return bench, bench.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, item_id: str = "item_id", item_text: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """A row for each document: id, n_words, n_hit, items (ids as sorted strings) and the hit spans in words."""
    df = frames.pick(docs, id=id_col, text=text_col)
    bench, bound = _benchmark(benchmark, item_id, item_text)
    kind = df.schema["id"].dataType.simpleString()
    if bound <= broadcast_windows:
        return _by_index(df, bench, kind).withColumnRenamed("id", id_col)
    scratch = frames.Scratch(df.sparkSession)
    numbered = _numbered(df, scratch)

    def count_words(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, offs = W.word_hashes(batch.column(1), W.ALNUM)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offs)), batch.column(2)], ["id", "n_words", "row"])

    out = frames.map_batches(numbered.select("id", "text", "row"), count_words, f"id {kind}, n_words bigint, row bigint").join(_by_join(numbered, bench, scratch), "row", "left")
    empty = F.expr("cast(array() as array<string>)"), F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")
    out = out.select("id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("items", empty[0]).alias("items"), F.coalesce("spans", empty[1]).alias("spans"))
    return out.withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, item_id: str = "item_id", item_text: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """The rows of docs without a hit, all columns as they are, whatever their ids.

    While the benchmark's windows are within the bound this is one pass without a shuffle; beyond it, rows with a hit
    are joined out by numbers of their own.
    """
    bench, bound = _benchmark(benchmark, item_id, item_text)
    at = frames.place(docs.columns, text_col)
    if bound > broadcast_windows:
        scratch = frames.Scratch(docs.sparkSession)
        names = [f"c{i}" for i in range(len(docs.columns))]
        numbered = _numbered(docs.toDF(*names), scratch)
        hit = _by_join(numbered.select("row", F.col(names[at]).alias("text")), bench, scratch).select("row")
        return numbered.join(hit, "row", "left_anti").select(*names).toDF(*docs.columns)
    rows = bench.toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(Index(rows.column(0).to_pylist(), rows.column(1).combine_chunks()))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, hits, _, _ = judge(batch.column(at), shared.value, _filters(shared.value))
        return batch.filter(pa.array([n == 0 for n in hits]))

    return frames.map_batches(docs, one, docs.schema)
