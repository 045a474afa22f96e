"""Language identification: multinomial logistic regression on TF-IDF of character n-grams.

Features are hashed n-grams of 1 to 3 lower-cased characters, weighted by the inverse document frequency over all
rows that may be learned from, and divided by the text's length. Weights are trained by follow-the-regularised-leader
(proximal) with an elastic-net penalty, which keeps them sparse, on at most `fit_per_class` rows of each language
(those of the smallest hashes, equal rows once); a fifth of these rows is kept out and sets the temperature by which scores are calibrated.

Defined cases: texts without any letter (also null and empty ones) are "und" with score 0; rows without a language
teach nothing; without any labelled row all texts are "und". Whole texts are read, in pieces, however long. Rows are
judged one by one, so repeated rows agree. Ties go to the language that sorts first. An empty table has no predictions.
Other columns of the input, also ones that differ from the wanted only in case, do no
harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotloom.llm import frames
from spotloom.llm.samples import per_class, row_hash

BITS = 17
BUCKETS = 1 << BITS
ORDERS = (1, 2, 3)
#: Characters looked at together.
PIECE = 1 << 19
#: FTRL: step, its damping, and the two penalties; passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.1, 2
#: Scale of features, as shares of a text are small.
SCALE = 10.0


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, and the offsets of the rows in them."""
    texts = pc.utf8_lower(pc.fill_null(column, "")).to_pylist()
    offs = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offs


def grams(codes: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(place, buckets) of the n-grams of each order and piece; BUCKETS stands for one that crosses rows."""
    for at in range(0, len(codes), PIECE):
        piece = codes[at : at + PIECE + max(ORDERS) - 1]
        here = min(PIECE, len(codes) - at)
        h = np.zeros(len(piece), np.uint32)
        for n in ORDERS:
            m = len(piece) - n + 1
            h = h[: max(m, 0)] * np.uint32(0x9E3779B1) + piece[n - 1 :] if n > 1 else piece + np.uint32(0)
            x = (h + np.uint32(n)) * np.uint32(0x85EBCA6B)
            x ^= x >> np.uint32(15)
            b = ((x * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)).astype(np.int32)[:here]
            if n > 1:
                ends = offs[(offs > at) & (offs <= at + here + n)] - at
                cross = (ends[:, None] - np.arange(1, n)[None, :]).ravel()
                b[cross[(cross >= 0) & (cross < len(b))]] = BUCKETS
            yield at, b


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the texts (column text) each bucket occurs, over all of them, and how many texts there are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, stamp, rows = np.zeros(BUCKETS + 1, np.int64), np.full(BUCKETS + 1, -1, np.int64), 0
        for batch in frames.small(batches):
            codes, offs = _codes(batch.column(0))
            rows += batch.num_rows
            found = list(grams(codes, offs))
            for r, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
                stamp_id = rows * 1_000_003 + r
                for at, x in found:
                    if at < b and a < at + len(x):
                        own = x[max(0, a - at) : b - at]
                        fresh = own[stamp[own] != stamp_id]
                        # The last of equal buckets stays; each of the others is overwritten.
                        stamp[fresh] = np.arange(len(fresh)) - len(fresh) - 1
                        once = fresh[stamp[fresh] == np.arange(len(fresh)) - len(fresh) - 1]
                        df[once] += 1
                        stamp[once] = stamp_id
        at = np.flatnonzero(df[:BUCKETS])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at]), pa.array(np.zeros(len(at), np.int64))], ["b", "df", "rows"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int64()), pa.array([rows], pa.int64())], ["b", "df", "rows"])

    total = texts.mapInArrow(run, "b int, df bigint, rows bigint").groupBy("b").agg(F.sum("df").alias("df"), F.sum("rows").alias("rows")).toArrow()
    b, df, rows = (total.column(i).to_numpy() for i in range(3))
    out = np.zeros(BUCKETS, np.int64)
    out[b[b >= 0]] = df[b >= 0]
    return out, int(rows.sum())


def _sample(batch: pa.RecordBatch) -> pa.RecordBatch:
    """lang, hash, and the buckets and their shares of a text, as bytes."""
    codes, offs = _codes(batch.column(2))
    found = list(grams(codes, offs))
    buckets, shares = [], []
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        own = np.concatenate([*(x[max(0, a - at) : max(0, b - at)] for at, x in found), np.zeros(0, np.int32)])
        u, n = np.unique(own[own < BUCKETS], return_counts=True)
        buckets.append(u.astype("<i4").tobytes())
        shares.append((n / max(1, n.sum())).astype("<f4").tobytes())
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(buckets, pa.binary()), pa.array(shares, pa.binary())], ["lang", "h", "b", "x"])


@dataclass
class Model:
    languages: list[str]
    #: Weights times inverse document frequencies, a row of languages for each bucket and a row of zeros.
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over (class, buckets, values); the last row of the weights is the bias, not penalised by L1."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
    l1 = np.full((BUCKETS + 1, 1), L1)
    l1[BUCKETS] = 0

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zz = z[at]
        return -np.sign(zz) * np.maximum(np.abs(zz) - l1[at], 0) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for y, b, x in rows:
            b, x = np.append(b, BUCKETS), np.append(x, 1.0)
            w = weights(b)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[b] + g * g) - np.sqrt(n[b])) / ALPHA
            z[b] += g - sigma * w
            n[b] += g * g
    w = weights(slice(None))
    return w[:BUCKETS], w[BUCKETS]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, fit_per_class: int = 1000, fit_bytes: int = 16 << 20, fit_rows: int = 100_000) -> Model:
    """Learns every language from all rows of docs: frequencies from every text with one, weights from a bounded sample.

    Of each language at most fit_per_class rows are drawn, of at most fit_bytes together, and of all about fit_rows; one of
    each at least. Rows that agree in id and text count once.
    """
    df = frames.pick(docs, id=id_col, text=text_col, lang=lang_col).where("lang is not null").withColumn("lang", F.col("lang").cast("string"))
    freq, n = document_frequencies(df.select("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    drawn, _ = per_class(df, "lang", row_hash("id", "text"), fit_per_class, size, fit_bytes, fit_rows)
    # About fit_rows hashes; rows that agree in one are equal.
    hashed = df.select("lang", row_hash("id", "text").alias("h"), "text").join(F.broadcast(drawn), ["lang", "h"], "left_semi")
    texts = hashed.groupBy("lang", "h").agg(F.first("text").alias("text"))
    got = frames.map_batches(texts, _sample, "lang string, h bigint, b binary, x binary").toArrow()
    if not n or not got.num_rows:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0), 1.0)
    idf = np.log((1 + n) / (1 + freq)) + 1
    langs = sorted(set(got.column(0).to_pylist()))
    rows = []
    for lang, _, b, x in sorted(zip(*(c.to_pylist() for c in got.columns), strict=True)):
        b = np.frombuffer(b, "<i4")
        rows.append((langs.index(lang), b, np.frombuffer(x, "<f4") * idf[b] * SCALE))
    rows = [rows[i] for i in np.random.default_rng(7).permutation(len(rows))]
    kept_out = rows[: len(rows) // 5]
    w, bias = train(rows[len(rows) // 5 :], len(langs))
    logits = np.array([x @ w[b] + bias for _, b, x in kept_out]).reshape(len(kept_out), len(langs))
    y = np.array([r[0] for r in kept_out], np.int64)

    def loss(t: float) -> float:
        return -float(np.log(_softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean()) if len(y) else 0.0

    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    t = float(grid[int(np.argmin([loss(t) for t in grid]))]) if len(y) else 1.0
    table = np.zeros((BUCKETS + 1, len(langs)), np.float32)
    table[:BUCKETS] = w * idf[:, None] * SCALE
    return Model(langs, table, bias, t)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score, the calibrated probability of lang_pred, for each row."""
    df = frames.pick(docs, id=id_col, text=text_col)
    df = df.withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    kind = df.schema["id"].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of a number for each language

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        if not m.languages:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(["und"] * batch.num_rows), pa.array(np.zeros(batch.num_rows))], ["id", "lang_pred", "score"])
        codes, offs = _codes(batch.column(1))
        sums, total = np.zeros((batch.num_rows, len(m.languages))), np.zeros(batch.num_rows)
        size = np.diff(offs)
        for n in ORDERS:
            total += np.maximum(size - n + 1, 0)
        for at, b in grams(codes, offs):
            lo = np.clip(offs[:-1] - at, 0, len(b))
            hi = np.clip(offs[1:] - at, 0, len(b))
            live = np.flatnonzero(hi > lo)
            if len(live):
                sums[live] += np.add.reduceat(m.weights[b], lo[live], axis=0)
        p = _softmax((sums / np.maximum(total, 1)[:, None] + m.bias) / m.temperature)
        best = p.argmax(1)
        letters = batch.column(2).to_numpy(zero_copy_only=False)
        names = [m.languages[i] if ok else "und" for i, ok in zip(best.tolist(), letters.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(np.where(letters, p[np.arange(len(best)), best], 0.0))], ["id", "lang_pred", "score"])

    return frames.map_batches(df, one, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
