"""What is computed within a document: its texts meet by one shuffle, and what they hold is never rows of a shuffle."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a batch that goes back to Spark, about.
OUT = 20_000


def _column(parts: list, kind: pa.DataType) -> pa.Array:
    if all(isinstance(p, np.ndarray) for p in parts):
        return pa.array(np.concatenate(parts), kind)
    return pa.array([x for p in parts for x in p], kind)


def of_each(rows: DataFrame, key: Sequence[str], found: Callable, schema: str, order: Sequence[str] = ()) -> DataFrame:
    """The columns of ``key`` and those of ``schema``: what ``found`` makes of the rows of each key.

    found(list of the other columns, each a list, in the order of ``order``) gives blocks of rows, each a tuple of columns (lists or arrays). Rows of a key meet by
    one shuffle and come in order, so a task holds one key's rows and about OUT rows of what is found. A null is a key like others.
    """
    key, kinds = list(key), dict(rows.dtypes)
    full = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), schema])
    out = to_arrow_schema(StructType.fromDDL(full))
    n = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list] = [[] for _ in out]
        size = 0

        def batch() -> pa.RecordBatch:
            nonlocal size
            b = pa.RecordBatch.from_arrays([_column(p, f.type) for p, f in zip(parts, out, strict=True)], schema=out)
            size = 0
            for p in parts:
                p.clear()
            return b

        def made(k: tuple, own: list[list]) -> Iterator[pa.RecordBatch]:
            nonlocal size
            for block in found(own):
                m = len(block[0])
                if m:
                    for p, x in zip(parts, [*([x] * m for x in k), *block], strict=True):
                        p.append(x)
                    size += m
                    if size >= OUT:
                        yield batch()

        held: tuple | None = None
        own: list[list] = []
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            keys = list(zip(*columns[:n], strict=True))
            at = 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if keys[at] != held:
                    if held is not None:
                        yield from made(held, own)
                    held, own = keys[at], [[] for _ in columns[n:]]
                for o, c in zip(own, columns[n:], strict=True):
                    o += c[at:end]
                at = end
        if held is not None:
            yield from made(held, own)
        if size:
            yield batch()

    dealt = rows.repartition(*key).sortWithinPartitions(*key, *order)
    return dealt.select(*key, *[c for c in rows.columns if c not in key]).mapInArrow(run, full)


def lines_of(texts: list[str | None], term: re.Pattern) -> dict[int, list[str]]:
    """Place of each line that holds a term -> its terms in order; lines at the same place of several texts are one."""
    out: dict[int, list[str]] = {}
    for t in texts:
        for i, line in enumerate((t or "").split("\n")):
            if found := term.findall(line):
                if i in out:
                    out[i] += found
                else:
                    out[i] = found
    return out


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as Spark's round() does: half cases of the decimal that is written go away from zero."""
    from decimal import ROUND_HALF_UP, Decimal

    x = np.asarray(x, float)
    y = np.abs(x) * 10.0**digits
    out = np.floor(y + 0.5)
    for i in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(abs(x[i])))).scaleb(digits).quantize(Decimal(1), ROUND_HALF_UP))
    return np.copysign(out / 10.0**digits, x)
