"""Document fingerprints: threshold-scaled sketches (operator 3).

A sketch keeps every hash of a text's runs of five words that lies below a fixed fraction of the hash
range. Texts of a few runs, of which hardly any lie there, keep the FLOOR smallest instead. Its bound tells below
which hash it is complete: two sketches are compared below the smaller bound, where both hold every
hash of their text. So the share of one text's shingles that another has is estimated alike for very
unequal texts, and the sketch of a union is the union of the sketches, cut in the same way.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spark as S
from . import _words as W

#: Words of a shingle, share of hashes kept, hashes kept at least (if there are as many: texts of under 64 runs have fewer below the share).
SHINGLE, FRACTION, FLOOR = 5, 1 / 4, 16
ALL = (1 << 64) - 1
Sketch = tuple[np.ndarray, int]


def cut(hashes: np.ndarray, bound: int = ALL, fraction: float = FRACTION, floor: int = FLOOR) -> Sketch:
    """Sketch of hashes that are complete below ``bound``: sorted distinct hashes and its own bound."""
    below = np.uint64(int(fraction * 2**64))
    kept = np.unique(hashes[hashes < below])
    if len(kept) < floor:
        kept = np.unique(hashes)
        if len(kept) <= floor:
            return kept, bound
        kept = kept[: max(floor, int(np.searchsorted(kept, below)))]
    return kept, min(bound, max(int(below), int(kept[-1]) + 1))


def merge(a: Sketch, b: Sketch, fraction: float = FRACTION, floor: int = FLOOR) -> Sketch:
    """Sketch of the shingles of both."""
    bound = min(a[1], b[1])
    both = np.union1d(a[0], b[0])
    return cut(both if bound == ALL else both[both < np.uint64(bound)], bound, fraction, floor)


def likeness(a: Sketch, b: Sketch) -> tuple[float, float]:
    """Estimated containment of the text with fewer shingles in the other, and resemblance (Jaccard).

    Both 1 if neither text has a word; 0 if one has none, or if nothing of one lies below the bound.
    """
    bound = min(a[1], b[1])
    x, y = (s[0] if bound == ALL else s[0][: np.searchsorted(s[0], np.uint64(bound))] for s in (a, b))
    if not len(a[0]) and not len(b[0]):
        return 1.0, 1.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    least = min(len(x), len(y))
    return (both / least, both / (len(x) + len(y) - both)) if least else (0.0, 0.0)


def text_of(s: Sketch) -> str:
    """The bound, a colon and the hashes in ascending order, as hex digits."""
    return f"{s[1]:016x}:{s[0].astype('>u8').tobytes().hex()}"


def parse(s: str) -> Sketch:
    """The sketch that text_of() wrote."""
    bound, _, rest = s.partition(":")
    return np.frombuffer(bytes.fromhex(rest), ">u8").astype(np.uint64), int(bound, 16)


def of_texts(texts: list[str], fraction: float = FRACTION, floor: int = FLOOR) -> list[Sketch]:
    """Sketch of each text, a few at a time."""
    out = []
    for i, j in S.chunks(texts, 1 << 19):
        h, off = W.shingles(*W.many([t.encode() for t in texts[i:j]]), SHINGLE)
        out += [cut(h[a:b], ALL, fraction, floor) for a, b in itertools.pairwise(off.tolist())]
    return out


def sketches(docs: DataFrame, fraction: float = FRACTION, floor: int = FLOOR) -> DataFrame:
    """doc_id and ``fingerprint`` of every row's whole text (null: empty: no hashes).

    Case of A-Z and white space do not count; a text of one to four words is one shingle. Repeated
    rows give equal rows, other columns are ignored, an empty table gives no rows. No shuffle.
    """
    S.tune(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield S.batch(schema, b.column(0), [text_of(s) for s in of_texts(b.column(1).to_pylist(), fraction, floor)])

    return S.id_text(docs).mapInArrow(run, "doc_id long, fingerprint string")


def _numbers(values: list[int]) -> Column:
    """A constant array, one literal however long it is."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _place(borders: list[int], at: Column) -> Column:
    """How many of the ascending borders are at most ``at``: first in steps of the square root, then within a step."""
    if not borders:
        return F.lit(0)
    step = math.isqrt(len(borders)) + 1
    below = lambda some: F.size(F.filter(some, lambda b: b <= at))
    steps = below(_numbers(borders[::step]))
    return F.when(steps == 0, 0).otherwise((steps - 1) * step + below(F.slice(_numbers(borders), (steps - 1) * step + 1, F.lit(step))))


def in_sequence(docs: DataFrame) -> DataFrame:
    """Rows (part, carried, doc_id, text), sorted within partitions, in which each part is a range of
    doc_id with all its rows in order, followed by the first row after it (carried = 1).

    The ranges have about equal numbers of rows; only their borders and the first id of each come to
    the driver. After the last range comes the first row of all. A null doc_id counts as the smallest;
    rows of the same id are in order of their texts.
    """
    spark = docs.sparkSession
    rows = S.id_text(docs).withColumn("at", F.coalesce("doc_id", F.lit(-(1 << 63))))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = 4 * parts  # a partition holds several ranges, so that their numbers of rows even out
    borders = rows.agg(F.percentile_approx("at", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []
    borders = sorted(set(borders))
    rows = rows.withColumn("part", _place(borders, F.col("at")))
    first = dict(rows.groupBy("part").agg(F.min("at")).collect())  # a long for each range
    used = sorted(first) or [0]
    before = {p: used[i - 1] for i, p in enumerate(used)}
    lookup = lambda d, none: F.element_at(_numbers([d.get(i, none) for i in range(len(borders) + 1)]), F.col("part") + 1)
    own, carried = F.struct("part", F.lit(0).alias("carried")), F.struct(lookup(before, 0).cast("int").alias("part"), F.lit(1).alias("carried"))
    places = F.when(F.col("at") == lookup(first, 0), F.array(own, carried)).otherwise(F.array(own))
    placed = rows.select("doc_id", "text", "at", F.explode(places).alias("p")).select("p.part", "p.carried", "doc_id", "at", "text")
    return placed.repartition(parts, "part").sortWithinPartitions("part", "carried", "at", "text").drop("at")


def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str], list[bool]]]:
    """From rows of in_sequence(): ids, texts and whether the next row is the text's successor.

    Each list but the last of a partition ends with a row that begins the next list again.
    """
    kept: list[tuple] = []
    for b in batches:
        rows = kept + list(zip(*(c.to_pylist() for c in b.columns), strict=True))
        texts = [r[3] for r in rows]
        for i, j in S.chunks(texts, 1 << 19):
            if j == len(rows) and i > 0 and j - i == 1:
                continue
            some = rows[i : min(j + 1, len(rows))]
            yield [r[2] for r in some], [r[3] for r in some], [x[0] == y[0] and not x[1] for x, y in itertools.pairwise(some)] + [False]
        kept = rows[-1:]


FIELDS = [("doc_id", "long"), ("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double"), ("edited_resemblance", "double"), ("next_resemblance", "double")]
KINDS = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def against_edited(docs: DataFrame) -> DataFrame:
    """Every row's sketch against that of its edited text and that of the next row (by doc_id).

    In the edited text the last quarter (rounded down, in code points) is replaced by as much of the
    next text's beginning. near_* are containments, *_resemblance estimates of Jaccard likeness. A row
    alone in the table is its own successor; see in_sequence() for null and repeated ids.
    """
    S.tune(docs.sparkSession)
    schema = pa.schema([(n, KINDS[k]) for n, k in FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, follows in pairs(batches):
            own = of_texts(texts)
            rows = [i for i, f in enumerate(follows) if f]
            edited = [texts[i][: len(texts[i]) - len(texts[i]) // 4] + texts[i + 1][: len(texts[i]) // 4] for i in rows]
            marks = of_texts(edited)
            out = []
            for i, e, m in zip(rows, edited, marks, strict=True):
                a, b = likeness(own[i], m), likeness(own[i], own[i + 1])
                out.append((ids[i], len(texts[i]), hashlib.sha256(e.encode()).hexdigest(), text_of(own[i]), text_of(m), a[0], b[0], a[1], b[1]))
            if out:
                yield S.batch(schema, *zip(*out, strict=True))

    return in_sequence(docs).mapInArrow(run, ", ".join(f"{n} {k}" for n, k in FIELDS))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return against_edited(S.read(spark, sf_dir, "documents"))
