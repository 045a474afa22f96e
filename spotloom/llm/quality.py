"""Quality: a regularised quadratic discriminant over statistics of each text.

Statistics (length, word length, shares of kinds of characters, repetition of words and lines) are transformed by
logarithms to be nearer to normal. Each class has its mean and a covariance that is shrunk towards the pooled one and
its diagonal; sums are gathered over all labelled rows, by task and then by class. The Cholesky factors are made once,
and the score is a logistic function of the difference of the two log densities.

Defined cases: null and empty texts have statistics too (those of no words); null labels teach nothing; if a class has
fewer than two rows, the score is the share of label 1 for every text, one half if there is no label at all. Several
labels of one id count each. Whole texts are read. Rows are judged one by one, so equal texts have equal scores; an empty
table has none. Other columns of the input, also ones that differ from the wanted only in case, do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotloom.llm import bytewords as W
from spotloom.llm import frames

#: Weight of the pooled covariance, and of the diagonal, in each class's.
POOLED, DIAGONAL = 0.05, 0.02
#: Differences of log densities are divided by this, as texts are less certain than normal variables.
SOFTEN = 2.0
NAMES = ("words", "length", "upper", "lower", "digit", "beyond", "space", "lines", "stops", "commas", "marks", "symbols", "pipes", "variety", "common", "repeat", "line_repeat")


def _classes() -> np.ndarray:
    c = np.zeros(256, np.uint8)
    for i, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"", b" \t\r", b"\n", b".", b",;:", b"!?", b"*#%&$@^~<>=+\\_{}[]", b"|"), 1):
        for b in chars:
            c[b] = i
    c[128:] = 4
    return c


_CLASS = _classes()
_KINDS = 11
#: All bytes but line ends.
_LINE = W.Alphabet(np.arange(256) != 10)


def statistics(column: pa.Array) -> np.ndarray:
    """A row of statistics for each text."""
    raw, offs = W.text_buffers(column)
    n = len(offs) - 1
    counts = np.zeros((n, _KINDS))
    kinds = _CLASS[raw]
    live = np.flatnonzero(np.diff(offs) > 0)
    for k in range(1, _KINDS + 1):
        if len(live):
            counts[live, k - 1] = np.add.reduceat(kinds == k, offs[live], dtype=np.int64)
    size = np.diff(offs).astype(float)
    h, at = W.word_hashes(column, W.NOT_SPACE)
    lines, lat = W.word_hashes(column, _LINE)
    words = np.diff(at).astype(float)
    same = np.append(False, h[1:] == h[:-1])
    distinct, common, repeat, line_same = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for i, a, b in W.rows(at):
        if b > a:
            _, c = np.unique(h[a:b], return_counts=True)
            distinct[i], common[i], repeat[i] = len(c), c.max(), same[a + 1 : b].sum()
    for i, a, b in W.rows(lat):
        line_same[i] = b - a - len(np.unique(lines[a:b])) if b - a > 1 else 0
    share = lambda x, y, c=0.5: np.log((x + c) / (y + 20 * c))
    cols = [np.log1p(words), np.log((size + 1) / (words + 1))]
    cols += [share(counts[:, k], size) for k in range(5)]
    cols += [share(counts[:, k], words) for k in range(5, _KINDS)]
    cols += [np.log1p(distinct) / np.log(words + 2), share(common, words), share(repeat, words), share(line_same, np.diff(lat))]
    return np.stack(cols, 1)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and stats, an array of the statistics named in NAMES."""
    df = frames.pick(docs, id=id_col, text=text_col)
    kind = df.schema["id"].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = statistics(batch.column(1))
        flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([batch.column(0), flat], ["id", "stats"])

    return frames.map_batches(df, one, f"id {kind}, stats array<double>").withColumnRenamed("id", id_col)


@dataclass
class Model:
    prior: float
    means: np.ndarray | None = None
    #: Inverses of the Cholesky factors of both covariances, and the logarithms of the determinants.
    factors: np.ndarray | None = None
    logdets: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        log = [-0.5 * (((x - self.means[k]) @ self.factors[k].T) ** 2).sum(1) - 0.5 * self.logdets[k] for k in (0, 1)]
        odds = (log[1] - log[0]) / SOFTEN + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(NAMES)
    n, s, ss = np.zeros(2, np.int64), np.zeros((2, d)), np.zeros((2, d, d))
    for batch in batches:
        y = batch.column(0).to_numpy()
        x = batch.column(1).flatten().to_numpy().reshape(-1, d)
        for k in (0, 1):
            own = x[y == k]
            n[k] += len(own)
            s[k] += own.sum(0)
            ss[k] += own.T @ own
    if n.any():
        cells = [np.concatenate([[n[k]], s[k], ss[k].ravel()]) for k in (0, 1)]
        place = np.tile(np.arange(len(cells[0])), 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], len(cells[0])).astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(np.concatenate(cells))], ["label", "place", "v"])


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """A model from measured texts and all their labels; only sums come to the driver."""
    lab = frames.pick(labels, lid=id_col, label=label_col).where("label in (0, 1)").select("lid", F.col("label").cast("int").alias("label"))
    own = frames.pick(stats, id=id_col, stats="stats")
    rows = own.join(lab, F.col("id") == F.col("lid")).select("label", "stats").mapInArrow(_sums, "label int, place int, v double")
    d = len(NAMES)
    sums = np.zeros((2, 1 + d + d * d))
    for label, place, v in rows.groupBy("label", "place").agg(F.sum("v")).collect():
        sums[label, place] = v
    n = sums[:, 0]
    if min(n) < 2:
        return Model(float(n[1] / n.sum()) if n.sum() else 0.5)
    means = sums[:, 1 : 1 + d] / n[:, None]
    own_cov = [sums[k, 1 + d :].reshape(d, d) / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (n[0] * own_cov[0] + n[1] * own_cov[1]) / n.sum()
    factors, logdets = [], []
    for k in (0, 1):
        few = d / (d + n[k])
        c = (1 - POOLED) * (1 - few) * own_cov[k] + (POOLED + few - POOLED * few) * pooled
        c = (1 - DIAGONAL) * c + DIAGONAL * np.diag(np.diag(c)) + 1e-4 * np.eye(d)
        chol = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(chol))
        logdets.append(2 * np.log(np.diag(chol)).sum())
    return Model(float(n[1] / n.sum()), means, np.stack(factors), np.array(logdets))


def score(stats: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """id and score, the probability that the label is 1, for each measured row."""
    df = frames.pick(stats, id=id_col, stats="stats")
    kind = df.schema["id"].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = batch.column(1).flatten().to_numpy().reshape(-1, len(NAMES))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], ["id", "score"])

    return frames.map_batches(df, one, f"id {kind}, score double").withColumnRenamed("id", id_col)
