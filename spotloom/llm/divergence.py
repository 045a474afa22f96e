"""Divergence of sources: how far each source's use of terms is from every other source's and from its language's.

Terms are counted by document and task before anything is shuffled. The terms that a language keeps are dealt into blocks
by hash, and its sources too where they are many; a tile, the sources of one or two blocks by the terms of one, is a dense
int64 matrix in one task. In it all pairs of sources meet by broadcasting, and each source keeps a heap of its most
over-used terms. Partial matrices of pairs are then summed, and heaps merged.

Probabilities are whole numbers, p = 1 + floor(SCALE * (n + 1) / (N + V)), found by long division, and a term's part of a
divergence is floor((p - q)^2 / q). Nothing is rounded elsewhere and no step overflows while N + V is under 9e15. A sum
over all terms is at most about (SCALE + V)^2, which int64 holds for V up to 2e9.

Defined cases: null text, language and source count as ''. A document is a row, so repeated rows count each. A source
without terms is compared all the same; in a language that keeps no term all divergences are 0. Ties are ranked by item,
in the order of its UTF-8 bytes. An empty table has no rows. Other columns, also ones that differ from the wanted only in
case, do no harm.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotloom.llm import frames

SCALE = 1_000_000_000
#: Terms and sources of a block, on average; a tile has one block of terms and at most two of sources.
TERMS, SOURCES = 2048, 128
#: Distinct terms, summed over groups, that a task holds before it passes its counts on.
HELD = 300_000
#: Bytes of a text that are split at a time, and cells of a tile that meet at a time.
PIECE, CELLS = 1 << 20, 1 << 20
#: Parts that the terms of a language are dealt into where they meet the language's sums.
PARTS = 64

#: Letters of ASCII, lower-cased, and all bytes beyond ASCII; others become spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: A document more in the upper bits, an occurrence more in the lower.
_DOC = 1 << 40


def terms(text: bytes) -> Counter[bytes]:
    """Occurrences of each term of a text in UTF-8, split a piece at a time."""
    folded, found, at = text.translate(_FOLD), Counter(), 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        found.update(folded[at:end].split())
        at = end
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, dict[bytes, int]] = {}
    n = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in held.items():
            v = np.fromiter(own.values(), np.int64, len(own))
            names = pa.array(list(own), pa.binary()).view(pa.string())
            key = lambda k: pa.array([k], pa.string()).take(pa.array(np.zeros(len(own), np.int32)))
            yield from frames.small([pa.RecordBatch.from_arrays([key(lang), key(source), names, pa.array(v % _DOC), pa.array(v // _DOC)], ["lang", "source", "term", "n", "docs"])], 1 << 16)

    for batch in batches:
        keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        for key, text in zip(keys, batch.column(2).view(pa.binary()), strict=True):
            own = held.setdefault(key, {})
            n -= len(own)
            for term, k in terms(text.as_py()).items():
                own[term] = own.get(term, 0) + k + _DOC
            n += len(own)
            if n > HELD:
                yield from out()
                held, n = {}, 0
    yield from out()


def count_terms(docs: DataFrame, least_docs: int = 3) -> DataFrame:
    """lang, source, term, n, lang_n (both occurrences) and first, true in one row of each term, of terms in at least so many documents of their language."""
    part = docs.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    # Dealt by term once: the groups and the windows below need no other shuffle.
    n = part.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    all_ = n.withColumns({"lang_n": F.sum("n").over(w), "lang_docs": F.sum("docs").over(w), "first": F.col("source") == F.min("source").over(w)})
    return all_.where(F.col("lang_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", "first")


def shares(n: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / size), by long division in three steps of a thousand."""
    rest = n + 1
    p = rest // size
    rest = rest - p * size
    for _ in range(3):
        rest = rest * 1000
        digit = rest // size
        p, rest = p * 1000 + digit, rest - digit * size
    return p + 1


def meet(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The divergence of each row of p from each row of q over the terms of a tile."""
    out = np.zeros((len(p), len(q)), np.int64)
    step = max(1, CELLS // max(1, q.size))
    for a in range(0, len(p), step):
        d = p[a : a + step, None, :] - q[None, :, :]
        out[a : a + step] = (d * d // q[None, :, :]).sum(2)
    return out


_OUT = "lang string, source string, part string, item string, value bigint"


def _tile(rows: pa.Table, heap: int) -> pa.Table:
    """Partial divergences of all pairs of a tile's sources; within one block of them, also the heap of each."""
    rows = rows.combine_chunks()
    col = lambda t, c: t.column(c).to_numpy()
    roster, cells = rows.filter(pc.is_null(rows.column("term"))), rows.filter(pc.is_valid(rows.column("term")))
    sources, names = roster.column("source").combine_chunks(), pc.unique(cells.column("term"))
    names = names.take(pc.sort_indices(names))  # by bytes
    g, t = (pc.index_in(cells.column(c), value_set=v).to_numpy() for c, v in (("source", sources), ("term", names)))
    n, lang_n = np.zeros((len(sources), len(names)), np.int64), np.zeros(len(names), np.int64)
    n[g, t], lang_n[t] = col(cells, "n"), col(cells, "lang_n")
    v, block = int(col(roster, "terms")[0]), col(roster, "block")
    size = (col(roster, "n") + v)[:, None]
    p, none = (shares(c, size) if v else c for c in (n, np.zeros((len(sources), 1), np.int64)))
    absent = int(col(roster, "width")[0]) - len(names)  # terms that none of these sources has
    lang, source, part, item, value = [], [], [], [], []

    def put(kind: str, of: np.ndarray, items: pa.Array, values: np.ndarray) -> None:
        source.append(sources.take(pa.array(of)))
        part.append(pa.array([kind]).take(pa.array(np.zeros(len(of), np.int32))))
        item.append(items)
        value.append(pa.array(values))

    i, j = (rows.column(c)[0].as_py() for c in ("i", "j"))
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    for a, b in {(i, j): (left, right), (j, i): (right, left)}.values():
        d = meet(p[a], p[b])
        if absent:
            d += absent * meet(none[a], none[b])
        x, y = np.nonzero(a[:, None] != b[None, :])
        put("pair", a[x], sources.take(pa.array(b[y])), d[x, y])
    if i == j and len(names):
        q = shares(lang_n, int(col(roster, "lang_n")[0]) + v)
        d = (p - q) ** 2 // q
        for k in range(len(sources)):
            at = np.flatnonzero((n[k] > 0) & (p[k] > q))
            at = at[np.lexsort((at, -d[k, at]))[:heap]]
            put("term", np.full(len(at), k), names.take(pa.array(at)), d[k, at])
    source, part, item, value = (pa.chunked_array(c) for c in (source, part, item, value))
    lang = pa.array([rows.column("lang")[0].as_py()], pa.string()).take(pa.array(np.zeros(len(source), np.int32)))
    return pa.table({"lang": lang, "source": source, "part": part, "item": item, "value": value})


def diverge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 3, heap: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: a source's divergence from each other of its language, and its most over-used terms."""
    scratch = frames.Scratch(docs.sparkSession)
    docs = frames.pick(docs, lang=lang_col, source=source_col, text=text_col).fillna("")
    kept = scratch.keep(count_terms(docs, least_docs), "terms")
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sums = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum(F.col("first").cast("bigint")).alias("terms"))
    groups = docs.select("lang", "source").distinct()
    blocks = lambda c, most: F.ceil(F.greatest(F.col(c), F.lit(1)) / most).cast("int")
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(sums, "lang", "left").fillna(0, ["lang_n", "terms"])
    langs = scratch.keep(langs.select("lang", "lang_n", "terms", blocks("terms", TERMS).alias("tiles"), blocks("sources", SOURCES).alias("blocks")), "langs")
    roster = groups.join(sizes, ["lang", "source"], "left").fillna(0, ["n"]).join(langs, "lang")
    # Rows of one language are many, so they meet its sums in parts.
    dealt = langs.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).drop("lang_n")
    cells = kept.withColumn("_part", F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int")).join(dealt, ["lang", "_part"])
    cells = cells.withColumn("tile", F.pmod(F.xxhash64("term", F.lit(1)), "tiles").cast("int"))
    widths = cells.groupBy("lang", "tile").agg(F.sum(F.col("first").cast("bigint")).alias("width"))
    roster = roster.withColumns({"term": F.lit(None).cast("string"), "tile": F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))}).join(widths, ["lang", "tile"], "left").fillna(0, ["width"])
    columns = ["lang", "tile", "source", "term", "n", "lang_n", "terms", "blocks"]
    rows = cells.select(*columns, F.lit(0).cast("bigint").alias("width")).unionByName(roster.select(*columns, "width")).withColumn("block", F.pmod(F.xxhash64("source"), "blocks").cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"i": F.least("block", "_other"), "j": F.greatest("block", "_other")}).drop("_other", "blocks")
    tiles = scratch.keep(rows.groupBy("lang", "tile", "i", "j").applyInArrow(lambda t: _tile(t, heap), _OUT), "tiles")
    pairs = tiles.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = tiles.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= heap)
    return pairs.withColumn("rank", rank).unionByName(best)
