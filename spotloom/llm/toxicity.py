"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its words and the words' first 4 and 6 bytes (so that inflected forms share a term), hashed and
taken once. The score is a logistic function of a bias, a weight for each term and, for each pair of terms, the
product of their factors: an insult and the mention of a group count for more together than apart. Weights are
trained by follow-the-regularised-leader with an L1 penalty, which leaves neutral terms without any weight; only terms
that have one get factors, which are trained by AdaGrad. At most `fit_per_class` rows of each label and `fit_bytes` of
their texts are used (bounds that do not grow with the corpus), those of the smallest hashes; their shares correct the bias.

Defined cases: null and empty texts get the score of a text without terms; labels that are null teach nothing; if only
one label is known, its share is every text's score; several labels of one id count each; an empty table has no scores.
Equal texts have equal scores. Whole texts are read. Other columns, also ones that differ from the wanted only in case, do
no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotloom.llm import bytewords as W
from spotloom.llm import frames
from spotloom.llm.samples import per_class, row_hash

BITS, FACTORS = 20, 8
#: FTRL step, damping and penalties of the weights (L1 by the root of the sample's size, as noise in the sums grows so);
#: AdaGrad step and penalty of the factors; passes; least rows a term is in.
ALPHA, BETA, L1, L2, RATE, DECAY, EPOCHS, LEAST = 0.3, 1.0, 0.1, 0.05, 0.05, 0.02, 4, 3
PREFIXES = (4, 6)


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all terms, row after row, and the offsets of the rows in them."""
    low = pc.utf8_lower(pc.fill_null(column, ""))
    words, offs = W.word_hashes(low, W.ALNUM)
    parts, _ = W.prefix_hashes(low, W.ALNUM, PREFIXES)
    every = np.stack([words, *parts], 1).ravel() if len(words) else words
    return (every >> np.uint64(64 - BITS)).astype(np.int64), offs * (1 + len(PREFIXES))


@dataclass
class Model:
    bias: float
    weights: np.ndarray
    #: Row of each bucket in factors, -1 for none.
    place: np.ndarray
    factors: np.ndarray

    def logits(self, buckets: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        at = np.flatnonzero(self.weights[buckets])
        row = np.searchsorted(offs, at, "right") - 1
        pair = np.unique(row << BITS | buckets[at])
        row, b = pair >> BITS, pair & ((1 << BITS) - 1)
        out = self.bias + np.bincount(row, self.weights[b], n)
        v = self.factors[self.place[b]]
        for f in range(v.shape[1]):
            out += 0.5 * (np.bincount(row, v[:, f], n) ** 2 - np.bincount(row, v[:, f] ** 2, n))
        return out


def train(rows: list[tuple[int, np.ndarray]]) -> Model:
    """A model from (label, distinct buckets) rows."""
    size, l1 = 1 << BITS, L1 * len(rows) ** 0.5
    z, n = np.zeros(size), np.zeros(size)
    place = np.full(size, -1, np.int64)
    rng = np.random.default_rng(11)
    v, g2 = np.zeros((0, FACTORS)), np.zeros((0, FACTORS))
    bias = np.log((1 + sum(y for y, _ in rows)) / (1 + sum(1 - y for y, _ in rows)))
    bias_n = 1.0
    for epoch in range(EPOCHS):
        for y, b in rows:
            zz = z[b]
            w = np.where(np.abs(zz) > l1, -(zz - np.sign(zz) * l1) / ((BETA + np.sqrt(n[b])) / ALPHA + L2), 0.0)
            live = b[w != 0]
            logit = bias + w.sum()
            if epoch:
                fresh = live[place[live] < 0]
                if len(fresh):
                    place[fresh] = np.arange(len(v), len(v) + len(fresh))
                    v = np.concatenate([v, rng.normal(0, 0.02, (len(fresh), FACTORS))])
                    g2 = np.concatenate([g2, np.ones((len(fresh), FACTORS))])
                at = place[live]
                own = v[at]
                total = own.sum(0)
                logit += 0.5 * float(total @ total - (own * own).sum())
            e = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y
            sigma = (np.sqrt(n[b] + e * e) - np.sqrt(n[b])) / ALPHA
            z[b] += e - sigma * w
            n[b] += e * e
            bias_n += e * e
            bias -= 0.1 * e / np.sqrt(bias_n)
            if epoch and len(live) > 1:
                grad = e * (total[None, :] - own) + DECAY * own
                g2[at] += grad * grad
                v[at] -= RATE * grad / np.sqrt(g2[at])
    w = np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
    held = np.flatnonzero(w)
    factors, where = np.zeros((len(held), FACTORS)), np.full(size, -1, np.int64)
    where[held] = np.arange(len(held))
    has = place[held] >= 0
    factors[has] = v[place[held][has]]
    return Model(float(bias), w, where, factors)


def _sample(batch: pa.RecordBatch) -> pa.RecordBatch:
    buckets, offs = terms(batch.column(2))
    got = [np.unique(buckets[a:b]).astype("<i4").tobytes() for _, a, b in W.rows(offs)]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.binary())], ["label", "h", "b"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, fit_per_class: int = 5000, fit_bytes: int = 32 << 20) -> Model:
    """Learns from at most fit_per_class ids of each label, and as many texts (an id's texts that differ count each) of at most fit_bytes together."""
    df = frames.pick(docs, id=id_col, text=text_col)
    lab = frames.pick(labels, lid=id_col, label=label_col).where("label in (0, 1) and lid is not null").select("lid", F.col("label").cast("int").alias("label")).distinct()
    drawn, share = per_class(lab, "label", row_hash("lid"), fit_per_class)
    drawn = lab.withColumn("h", row_hash("lid")).join(F.broadcast(drawn), ["label", "h"], "left_semi")
    # At most 2 fit_per_class ids. Their texts may repeat without a bound, so equal ones are made one, and ranked by hash
    # and size alone; those drawn are split into terms where they are.
    texts = df.join(F.broadcast(drawn), F.col("id") == F.col("lid")).select("label", row_hash("id", "text").alias("h"), "text")
    scratch = frames.Scratch(df.sparkSession)
    texts = scratch.keep(texts.groupBy("label", "h").agg(F.first("text").alias("text")), "texts")
    few, _ = per_class(texts, "label", F.col("h"), fit_per_class, F.coalesce(F.octet_length("text"), F.lit(0)), fit_bytes)
    got = frames.map_batches(texts.join(F.broadcast(few), ["label", "h"], "left_semi").select("label", "h", "text"), _sample, "label int, h bigint, b binary").toArrow()
    scratch.close()
    rows = sorted(zip(*(c.to_pylist() for c in got.columns), strict=True))
    rows = [(y, np.frombuffer(b, "<i4")) for y, _, b in rows]
    seen = np.zeros(1 << BITS, np.int64)
    for _, b in rows:
        seen[b] += 1
    rows = [(y, b[seen[b] >= LEAST]) for y, b in rows]
    rows = [rows[i] for i in np.random.default_rng(5).permutation(len(rows))]
    if len({y for y, _ in rows}) < 2:
        only = rows[0][0] if rows else 0
        return Model(6.0 if only else -6.0, np.zeros(1 << BITS), np.full(1 << BITS, -1, np.int64), np.zeros((0, FACTORS)))
    model = train(rows)
    model.bias += float(np.log(share[0] / share[1]))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score, the probability that the label is 1, for each row."""
    df = frames.pick(docs, id=id_col, text=text_col)
    kind = df.schema["id"].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)  # 16 MB and the factors of the few terms with a weight

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        logit = shared.value.logits(*terms(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(logit, -500, 500))))], ["id", "score"])

    return frames.map_batches(df, one, f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep_below(docs: DataFrame, model: Model, limit: float, text_col: str = "text") -> DataFrame:
    """The rows of docs with a score under limit, all columns as they are, in one pass without a shuffle."""
    at = frames.place(docs.columns, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        logit = shared.value.logits(*terms(batch.column(at)))
        return batch.filter(pa.array(1 / (1 + np.exp(-np.clip(logit, -500, 500))) < limit))

    return frames.map_batches(docs, one, docs.schema)
