"""Quality classifier: naive Bayes support vectors (operator 7).

Indicators of n-grams (three bytes of a text in a row; eight words in a row, each by whether it is the one
before it again) are scaled by the class's log-count ratios; a linear hinge loss is fitted on them by
coordinate descent in the dual. The margin becomes a probability by a logistic curve that is fitted on
rows that the weights have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import _fit as C
from . import _spark as S
from . import _words as W

#: Labelled rows that are fitted on at most; passes of the descent; its cost; smoothing of counts.
ROWS, PASSES, COST, SMOOTH = 4000, 15, 1.0, 1.0
#: From this score on, a document is predicted to be of quality 1.
THRESHOLD = 0.3
#: Words in a row of which it is told whether each is the one before it again; a place for each case, before those of the bytes.
AGAIN = 8


def places(texts: list[str]) -> list[np.ndarray]:
    """The distinct places of each text's indicators."""
    out, stamp = [], np.zeros(C.PLACES, np.int64)
    for i, j in S.chunks(texts):
        raw = [t.encode() for t in texts[i:j]]
        h, off = W.many(raw)
        for k, data in enumerate(raw):
            b = np.frombuffer(b" " + data + b" ", np.uint8).astype(np.uint32)
            code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:] if data else b[:0]
            code = (1 << AGAIN) + ((code * np.uint32(0x9E3779B1)).astype(np.uint64) * np.uint64(C.PLACES - (1 << AGAIN)) >> np.uint64(32)).astype(np.int64)
            n = np.arange(len(code))
            stamp[code] = n
            words = h[off[k] : off[k + 1]]
            same = (words[1:] == words[:-1]).astype(np.int64)
            runs = sum(same[i : len(same) - AGAIN + 1 + i] << i for i in range(AGAIN)) if len(same) >= AGAIN else same[:0]
            out.append(np.concatenate((np.unique(runs), code[stamp[code] == n])))
    return out


class Model(NamedTuple):
    """weight: of each place, scaled; by the square root of the sum of squared ratios, as the rows are."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    offset: float

    @property
    def learned(self) -> bool:
        """Whether there were labels of both classes to learn from."""
        return bool(self.weight.any())

    def margin(self, at: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weight[a].sum() / np.sqrt(self.square[a].sum() + 1e-9) + self.bias for a in at])

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1, by texts alone."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(places(texts)) + self.offset, -40, 40)))


def descend(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge loss by dual coordinate descent; rows have length one."""
    xs = [scale[a] for a in rows]
    xs = [x / (np.sqrt((x * x).sum()) + 1e-9) for x in xs]
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    # Classes count alike, however unequal they are.
    cost = np.where(y > 0, COST * len(y) / (2 * max(1, (y > 0).sum())), COST * len(y) / (2 * max(1, (y < 0).sum())))
    order = np.random.default_rng(seed)
    for _ in range(PASSES):
        for i in order.permutation(len(rows)):
            g = y[i] * (xs[i] @ w[rows[i]] + bias) - 1
            new = min(max(alpha[i] - g / 2, 0.0), cost[i])  # a row's square, with its constant, is 2
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * xs[i]
                bias += step
                alpha[i] = new
    return w, bias


def fit_rows(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """Model of indicators and labels 0 or 1; with fewer than two classes, every score is that label's share."""
    zero = np.zeros(C.PLACES)
    if len(y) < 10 or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        return Model(zero, zero, 0.0, 1.0, float(np.log(p / (1 - p))))
    sign = np.where(y > 0, 1.0, -1.0)
    seen, unseen = np.arange(len(y)) % 5 != 0, np.arange(len(y)) % 5 == 0

    def weights(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        ids = np.flatnonzero(which)
        p, q = (SMOOTH + sum((np.bincount(rows[i], minlength=C.PLACES) for i in ids if sign[i] == s), np.zeros(C.PLACES)) for s in (1, -1))
        scale = np.log((p / p.sum()) / (q / q.sum()))
        w, bias = descend([rows[i] for i in ids], scale, sign[ids])
        return w * scale, scale * scale, bias

    part = Model(*weights(seen), 1.0, 0.0)
    slope, offset = C.calibrate(part.margin([rows[i] for i in np.flatnonzero(unseen)]), y[unseen])
    w, square, bias = weights(np.ones(len(y), bool))
    return Model(w.astype(np.float32), square.astype(np.float32), bias, max(slope, 0.1), offset)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = ROWS) -> Model:
    """Model fitted on at most ``most`` labelled rows outside fold 0 (see _fit.sample)."""
    ones = lambda texts: [(a, np.ones(0, np.float32)) for a in places(texts)]
    rows, y = C.sample(docs, labels, label, ones, most)
    return fit_rows([r[0] for r in rows], (y > 0).astype(np.int64))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``, from whole texts.

    A null or empty text has no indicators and gets the score of the bias alone. Rows may repeat; no
    row is dropped; a null doc_id is kept and counts as held out. No shuffle.
    """
    S.tune(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.score(b.column(1).to_pylist())
            yield S.batch(schema, b.column(0), b.column(2), pa.array(p), (p >= threshold).astype(np.int32))

    rows = S.id_text(docs).withColumn("held_out", C.fold() == 0)
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier does not reject; all where the labels are of
    one class or too few, so that nothing can be learned. Null texts are empty; repeated rows get the same score."""
    model = fit(docs, labels)
    return S.keep_rows(docs, lambda texts: model.score(texts) >= threshold) if model.learned else docs


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.read(spark, sf_dir, "documents")
    return score(docs, fit(docs, S.read(spark, sf_dir, "labels")))
