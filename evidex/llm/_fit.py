"""Labelled rows for the classifiers: a bounded, reproducible sample, and sparse features in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _spark as S

#: Fold of a document: rows of fold 0 are held out from all fitting.
FOLDS = 5
#: Features are hashed into this many places.
PLACES = 1 << 18


def fold() -> Column:
    """crc32 of doc_id as text, modulo FOLDS (a null doc_id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS


def sample(docs: DataFrame, labels: DataFrame, label: str, features: Callable[[list[str]], list[tuple[np.ndarray, np.ndarray]]], most: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Features (places, values) and labels of at most ``most`` labelled rows outside fold 0.

    The rows are those with the smallest hash of doc_id, half of them of either label where there are
    so many; the bound makes what comes to the driver independent of the corpus. Null labels and ids
    don't count; a document labelled twice counts twice.
    """
    S.tune(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null").where(fold() != 0)
    some = None
    for y in (0, 1):
        part = known.where((F.col("y") > 0) == F.lit(bool(y))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2)
        some = part if some is None else some.union(part)
    rows = S.id_text(docs).join(F.broadcast(some), "doc_id").select("doc_id", "text", "y")  # at most ``most`` pairs of numbers
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("at", pa.binary()), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = features(b.column(1).to_pylist())
            yield S.batch(schema, b.column(0), b.column(2), [a.astype(np.int32).tobytes() for a, _ in got], [x.astype(np.float32).tobytes() for _, x in got])

    found = sorted(rows.mapInArrow(run, "doc_id long, y int, at binary, x binary").collect())
    return [(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32)) for r in found], np.array([r[1] for r in found], np.int64)


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve that best gives y (0 or 1) from margins."""
    a, b = 1.0, 0.0
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        g = np.array([((p - t) * margin).sum() + 1e-3 * (a - 1), (p - t).sum()])
        v = p * (1 - p)
        h = np.array([[(v * margin * margin).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)
