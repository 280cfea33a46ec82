"""Toxicity: cumulative-link ordinal regression (operator 6).

Severity grades are 0 (none) to 3. A text's features are its words and the beginnings of its words,
with the logarithm of their counts. One weight vector is shared by the ordered thresholds:
P(grade <= k) = logistic(threshold_k - features . weights), and the result is the expected grade.

Labels say only toxic or not. Toxic training rows are graded 1 to 3 by thirds of how often the words
occur in them that set the labels apart; rows that are not toxic have grade 0.
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

#: Labelled rows that are fitted on at most; grades above 0; training rows that a feature needs.
ROWS, GRADES, LEAST = 6000, 3, 4
#: Lengths (bytes) of the beginnings of words that are features beside whole words.
PREFIXES = (5, 6, 7, 8)
#: P(grade > 0) from which a text counts as toxic where there are too few rows to choose it by.
THRESHOLD = 0.5


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and values of each text's features."""
    out = []
    for i, j in S.chunks(texts, 1 << 19):
        raw = [t.lower().translate(PLAIN).encode() for t in texts[i:j]]
        data = b"\n".join(raw)
        start, end, h = W.words(data)
        off = np.searchsorted(start, np.concatenate(([0], np.cumsum([len(t) + 1 for t in raw]))))
        doc = np.repeat(np.arange(j - i), np.diff(off))
        owner, code = [doc], [h]
        whole = np.frombuffer(data, np.uint8).astype(np.uint64)
        acc = np.zeros(len(start), np.uint64)
        for k in range(max(PREFIXES)):
            rows = end - start > k
            acc[rows] = W.mix(acc[rows] ^ (whole[start[rows] + k] + np.uint64(1)))
            if k + 1 in PREFIXES:
                longer = end - start > k + 1
                owner.append(doc[longer])
                code.append(acc[longer])
        key = np.concatenate(owner) * C.PLACES + (np.concatenate(code) >> np.uint64(46)).astype(np.int64)
        key, n = np.unique(key, return_counts=True)
        cut = np.searchsorted(key, np.arange(j - i + 1) * C.PLACES)
        value = np.log1p(n)
        out += [(key[a:b] % C.PLACES, value[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    return out


PLAIN = {i: " " for i in range(128) if not chr(i).isalnum()}


class Model(NamedTuple):
    weight: np.ndarray
    cuts: np.ndarray
    threshold: float = THRESHOLD

    def above(self, texts: list[str]) -> np.ndarray:
        """P(grade > k) for k from 0, one row a text."""
        return self.above_rows(features(texts))

    def above_rows(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        z = np.array([self.weight[at] @ x if len(at) else 0.0 for at, x in rows])
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - z[:, None], -40, 40)))


def grade(rows: list, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grades of the rows, and the places that are kept as features with their log-odds."""
    hit, miss = np.zeros(C.PLACES), np.zeros(C.PLACES)
    for (at, _), t in zip(rows, y, strict=True):
        (hit if t else miss)[at] += 1
    a, b = max(1, y.sum()), max(1, len(y) - y.sum())
    odds = np.log((hit + 0.5) / (a + 1)) - np.log((miss + 0.5) / (b + 1))
    odds[hit + miss < LEAST] = 0
    telling = (odds > 2.5) & (hit >= LEAST)
    share = np.array([x[telling[at]].sum() / (1 + np.sqrt(x.sum())) for at, x in rows])
    edges = np.quantile(share[y > 0], [1 / 3, 2 / 3])
    return np.where(y > 0, 1 + np.searchsorted(edges, share, side="left"), 0), odds


def fit_rows(rows: list, y: np.ndarray, steps: int = 300, decay: float = 2e-4) -> Model:
    """Weights and ascending thresholds by Adam on the likelihood of the grades; no randomness."""
    if len(y) < 10 or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99)
        return Model(np.zeros(C.PLACES, np.float32), np.log((1 - p) / p) + np.arange(GRADES))
    g, odds = grade(rows, y)
    used = np.flatnonzero(np.abs(odds) > 1)
    new = np.full(C.PLACES, -1)
    new[used] = np.arange(len(used))
    at = [new[a][new[a] >= 0] for a, _ in rows]
    x = np.concatenate([v[new[a] >= 0] for a, v in rows])
    col = np.concatenate(at)
    row = np.repeat(np.arange(len(rows)), [len(a) for a in at])
    # A row of either label has equal weight in all.
    weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w, t = np.zeros(len(used)), np.array([0.0, *np.full(GRADES - 1, 0.5)])  # t: first threshold, gaps as logarithms
    m, v = np.zeros(len(w) + len(t)), np.zeros(len(w) + len(t))
    for step in range(1, steps + 1):
        z = np.bincount(row, x * w[col], minlength=len(rows))
        cuts = np.concatenate(([-1e9], t[0] + np.concatenate(([0], np.cumsum(np.exp(t[1:])))), [1e9]))
        up, low = (1 / (1 + np.exp(-np.clip(cuts[g + k] - z, -40, 40))) for k in (1, 0))
        p = np.maximum(up - low, 1e-9)
        du, dl = up * (1 - up) / p, low * (1 - low) / p
        dz = weight * (du - dl) / len(rows)  # of -log p
        gw = np.bincount(col, x * dz[row], minlength=len(w)) + decay * w
        dc = np.zeros(GRADES + 2)
        np.add.at(dc, g + 1, -weight * du / len(rows))
        np.add.at(dc, g, weight * dl / len(rows))
        gt = np.array([dc[1:-1].sum(), *(np.exp(t[k]) * dc[1 + k : -1].sum() for k in range(1, GRADES))])
        d = np.concatenate((gw, gt))
        m, v = 0.9 * m + 0.1 * d, 0.999 * v + 0.001 * d * d
        d = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, t = w - d[: len(w)], t - d[len(w) :]
    full = np.zeros(C.PLACES, np.float32)
    full[used] = w
    return Model(full, t[0] + np.concatenate(([0], np.cumsum(np.exp(t[1:])))))


def fit_chosen(rows: list, y: np.ndarray) -> Model:
    """fit_rows(), with the threshold that best parts a fifth of the rows by weights fitted on the rest.

    Best is the largest sum of both labels' shares on the right side: halfway between the two scores that
    it parts, in log-odds; of equal places the lowest.
    """
    model, aside = fit_rows(rows, y), np.arange(len(y)) % 5 == 0
    if len(set(y[aside].tolist())) < 2 or len(set(y[~aside].tolist())) < 2:
        return model
    part = fit_rows([r for r, a in zip(rows, aside, strict=True) if not a], y[~aside])
    p = part.above_rows([r for r, a in zip(rows, aside, strict=True) if a])[:, 0]
    p = np.log(np.clip(p, 1e-9, 1 - 1e-9) / (1 - np.clip(p, 1e-9, 1 - 1e-9)))
    order = np.argsort(p, kind="stable")
    p, hit = p[order], y[aside][order]
    # Everything from place k on counts as toxic.
    right = np.concatenate(([0], np.cumsum(1 - hit))) / max(1, (1 - hit).sum()) + (hit.sum() - np.concatenate(([0], np.cumsum(hit)))) / max(1, hit.sum())
    inner = right[1:-1] * (p[1:] > p[:-1])
    if not len(inner) or inner.max() <= 1:
        return model
    k = int(np.argmax(inner))
    return model._replace(threshold=float(1 / (1 + np.exp(-(p[k] + p[k + 1]) / 2))))


def fit(docs: DataFrame, labels: DataFrame, most: int = ROWS) -> Model:
    """Model fitted on at most ``most`` labelled rows outside fold 0 (see _fit.sample)."""
    rows, y = C.sample(docs, labels, "toxic", features, most)
    return fit_chosen(rows, (y > 0).astype(np.int64))


def score(docs: DataFrame, model: Model, threshold: float | None = None) -> DataFrame:
    """doc_id, severity (expected grade), grade (the likeliest), p_toxic and toxic of every row.

    Whole texts are read; a null or empty text has no features, so its severity is that of the
    thresholds alone. Repeated rows and null ids are kept, other columns ignored. No shuffle.
    """
    S.tune(docs.sparkSession)
    threshold = model.threshold if threshold is None else threshold
    schema = pa.schema([("doc_id", pa.int64()), ("severity", pa.float64()), ("grade", pa.int32()), ("p_toxic", pa.float64()), ("toxic", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            above = model.above(b.column(1).to_pylist())
            each = -np.diff(np.concatenate((np.ones((len(above), 1)), above, np.zeros((len(above), 1))), axis=1))
            yield S.batch(schema, b.column(0), above.sum(1), each.argmax(1), above[:, 0], (above[:, 0] >= threshold).astype(np.int32))

    return S.id_text(docs).mapInArrow(run, "doc_id long, severity double, grade int, p_toxic double, toxic int")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.read(spark, sf_dir, "documents")
    return score(docs, fit(docs, S.read(spark, sf_dir, "labels")))
