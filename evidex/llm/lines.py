"""Line dedup: sharded cuckoo filters over exact reference counts (operator 2).

The exact tables hold, for each key of a line and each document, how many lines refer to it. What is
dropped follows from them alone, so a deleted document takes back what it caused. Cuckoo filters, one
for each beginning of the key's 128-bit hash, say of most keys that a table cannot hold them; only
the rest is looked up.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spark as S
from .cuckoo import Cuckoo, build

#: Code points of a key, and documents that hold it, from which its lines are dropped.
LENGTH, DOCUMENTS = 40, 5
#: Bytes of filters that are broadcast at most; beyond it, every key is looked up in the tables.
BROADCAST = 48 << 20


def key(line: bytes, length: int = LENGTH) -> bytes | None:
    """128-bit hash of a line's key, or None for a key of fewer code points."""
    k = line.strip().lower()  # ASCII white space, ASCII letters
    if len(k) < length or (len(k) < 4 * length and not k.isascii() and len(k.decode()) < length):
        return None
    return xxhash.xxh3_128_digest(k)


REFS = pa.schema([("k", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64())])


def line_refs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """k (hash of a key), doc_id and n (lines): the exact reference counts of the documents' lines."""
    S.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ks, ids, ns = [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found: dict[bytes, int] = {}
                for line in t.encode().split(b"\n"):
                    if len(line) >= length and (k := key(line, length)) is not None:
                        found[k] = found.get(k, 0) + 1
                ks += found
                ids += [d] * len(found)
                ns += found.values()
            yield S.batch(REFS, ks, ids, ns)

    rows = S.id_text(docs).mapInArrow(run, "k binary, doc_id long, n long")
    return rows.groupBy("k", "doc_id").agg(F.sum("n").alias("n"))


def repeated(refs: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """k and keep_id (the largest doc_id) of keys in at least so many documents.

    Counts are combined before the shuffle, so a line of a third of all documents is a few rows.
    """
    return refs.groupBy("k").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keep_id")).where(F.col("docs") >= documents).drop("docs")


def _numbers(k: pa.Array) -> np.ndarray:
    """First eight bytes of each hash."""
    flat = np.frombuffer(b"".join(k.to_pylist()), np.int64)
    return flat[::2].copy()


def filters(keys: DataFrame, width: int = 1) -> DataFrame:
    """shard (first bytes) and bits (a filter's table) of distinct keys ``k``."""
    schema = pa.schema([("shard", pa.binary()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((s, n) for b in batches for s, n in zip(b.column(0).to_pylist(), _numbers(b.column(1)).tolist(), strict=True))
        for shard, own in itertools.groupby(rows, lambda r: r[0]):
            yield S.batch(schema, [shard], [build(np.array([n for _, n in own], np.int64)).table.tobytes()])

    shards = keys.select(F.substring("k", 1, width).alias("shard"), "k").repartition("shard").sortWithinPartitions("shard")
    return shards.mapInArrow(run, "shard binary, bits binary")


def _maybe(shards: dict[int, Cuckoo], k: pa.Array) -> np.ndarray:
    """Which keys their shard's filter may hold."""
    numbers = _numbers(k)
    first = numbers.view(np.uint8).reshape(-1, 8)[:, 0] if len(numbers) else np.zeros(0, np.uint8)
    keep = np.zeros(len(numbers), bool)
    for s in np.unique(first).tolist():
        if s in shards:
            at = np.flatnonzero(first == s)
            keep[at] = shards[s].contains(numbers[at])
    return keep


def passing(refs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``refs`` that the filters of ``keys`` let pass; all rows if the filters are too large to send."""
    n = keys.count()
    if n * 5 + 256 * 16 > BROADCAST:  # two bytes a slot, of which at least 0.42 are full
        return refs
    shards = refs.sparkSession.sparkContext.broadcast({r[0][0]: r[1] for r in filters(keys).collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {s: Cuckoo(table=np.frombuffer(x, np.uint16).reshape(-1, 4)) for s, x in shards.value.items()}
        for b in batches:
            yield b.filter(pa.array(_maybe(own, b.column(0))))

    return refs.mapInArrow(run, refs.schema)


def drops(refs: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """drop_id and drop_keys: the keys whose lines each document loses."""
    keys = S.stored(repeated(refs, documents))
    # A key with a third of all references is a skewed join, which adaptive execution splits.
    lost = passing(refs, keys).join(keys, "k").where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return lost.groupBy(F.col("doc_id").alias("drop_id")).agg(F.collect_list("k").alias("drop_keys"))


def split_kept(text: str, gone: set[bytes], length: int = LENGTH) -> tuple[str, int]:
    """The text without lines of these keys, and how many are dropped."""
    lines = text.split("\n")
    kept = [x for x in lines if len(x) < length or key(x.encode(), length) not in gone]
    return "\n".join(kept), len(lines) - len(kept)


def dedup(docs: DataFrame, length: int = LENGTH, documents: int = DOCUMENTS) -> DataFrame:
    """doc_id, text (what stays), n_lines (before) and n_dropped of every row.

    Lines end at \\n; a null or empty text is one empty line. Keys are lines without ASCII white space
    at both ends and with A-Z as a-z; keys of at least ``length`` code points in at least ``documents``
    documents lose all lines but those of the largest doc_id that holds them. Rows of one doc_id are one
    document; rows without doc_id are one document too, smaller than all others. Columns other than
    doc_id and text are ignored. Keys are compared as 128-bit hashes.
    """
    return _applied(S.id_text(docs), length, documents, counts=True)


def dedup_rows(docs: DataFrame, length: int = LENGTH, documents: int = DOCUMENTS) -> DataFrame:
    """``docs`` with all its columns and rows, its texts as dedup() leaves them and n_chars, if there, made to fit."""
    return _applied(docs, length, documents, counts=False)


def _applied(docs: DataFrame, length: int, documents: int, counts: bool) -> DataFrame:
    refs = S.stored(line_refs(docs, length))
    lost = drops(refs, documents)
    names = docs.columns
    longer = max(names, key=len) + "_"  # a name that no column has
    joined = docs.join(lost, docs["doc_id"].eqNullSafe(lost["drop_id"]), "left").select(*[docs[c] for c in names], lost["drop_keys"].alias(longer))
    place, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, lists, columns = b.column(place), b.column(len(names)), b.columns[: len(names)]
            lose = pc.is_valid(lists)
            dropped = np.zeros(len(text), np.int64)
            at = np.flatnonzero(lose.to_numpy(zero_copy_only=False))
            if len(at):  # only the texts that lose lines become objects, one at a time
                kept, sizes = [], []
                for i in at.tolist():
                    new, dropped[i] = split_kept(text[i].as_py(), set(lists[i].as_py()), length)
                    kept.append(new)
                    sizes.append(len(new))
                columns[place] = pc.replace_with_mask(text, lose, pa.array(kept, text.type))
                if chars is not None and not counts:
                    columns[chars] = pc.replace_with_mask(b.column(chars), lose, pa.array(sizes, b.column(chars).type))
            fields = [pa.field(n, c.type) for n, c in zip(names, columns, strict=True)]
            if counts:
                lines = pc.add(pc.fill_null(pc.count_substring(text, "\n"), 0), 1)
                columns += [lines.cast(pa.int64()), pa.array(dropped)]
                fields += [pa.field("n_lines", pa.int64()), pa.field("n_dropped", pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    schema = docs.schema
    if counts:
        schema = schema.add("n_lines", "long").add("n_dropped", "long")
    return joined.mapInArrow(run, schema)


class LineIndex:
    """Incremental line dedup in a folder: insert and delete documents, then ask what is dropped now.

    ``refs`` holds signed reference counts, one batch a call, so that a deletion takes back exactly
    what its documents added; a key's count is the sum. ``filters`` holds the cuckoo filters of the
    keys with references: an insertion looks up only those of its keys that the filters may hold, and
    a deletion takes the keys without references out of them. The batch of ``refs`` is written last;
    a call that was cut off leaves a batch of filters that the next call overwrites. A shard is the keys with
    the same first ``width`` bytes: two make 65,536 shards, each a few MB for 100,000 million keys. Filters stay on the executors.
    """

    def __init__(self, spark: SparkSession, path: str, length: int = LENGTH, width: int = 2):
        self.spark, self.path, self.length, self.width, self.batch = S.tune(spark), path.rstrip("/"), length, width, 0
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/refs")
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        while fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/refs/batch={self.batch + 1}/_SUCCESS")):
            self.batch += 1

    def refs(self) -> DataFrame:
        """k, doc_id, n of the documents that are in."""
        if not self.batch:
            return self.spark.createDataFrame([], "k binary, doc_id long, n long")
        rows = self.spark.read.schema("k binary, doc_id long, n long").parquet(*[f"{self.path}/refs/batch={i + 1}" for i in range(self.batch)])
        return rows.groupBy("k", "doc_id").agg(F.sum("n").alias("n")).where("n > 0")

    def _filters(self) -> DataFrame:
        if not self.batch:
            return self.spark.createDataFrame([], "shard binary, bits binary")
        return self.spark.read.schema("shard binary, bits binary").parquet(f"{self.path}/filters/batch={self.batch}")

    def _write(self, refs: DataFrame, bits: DataFrame) -> None:
        bits.write.mode("overwrite").parquet(f"{self.path}/filters/batch={self.batch + 1}")
        refs.write.mode("overwrite").parquet(f"{self.path}/refs/batch={self.batch + 1}")
        self.batch += 1

    def _changed(self, keys: DataFrame, add: bool) -> DataFrame:
        """The filters with keys added, or taken out; a shard that overflows is made anew from the counts."""

        def run(shard, old, new):  # noqa: ANN001, ANN202
            numbers = _numbers(new.column("k").combine_chunks()) if new.num_rows else np.zeros(0, np.int64)
            table = old.column("bits")[0].as_py() if old.num_rows else None
            f = Cuckoo(table=np.frombuffer(table, np.uint16).reshape(-1, 4).copy()) if table else Cuckoo(64)
            full = False
            if add:
                full = not f.insert(np.unique(numbers))
            else:
                f.delete(np.unique(numbers))
            return pa.table({"shard": pa.array([shard[0].as_py()], pa.binary()), "bits": pa.array([b"" if full else f.table.tobytes()], pa.binary())})

        new = self._sharded(keys)
        done = S.stored(self._filters().groupBy("shard").cogroup(new.groupBy("shard")).applyInArrow(run, "shard binary, bits binary"))
        over = done.where("length(bits) = 0")
        held = self.refs().select("k").union(keys) if add else self.refs().select("k")
        anew = filters(held.distinct().join(over.select("shard"), F.substring("k", 1, self.width) == F.col("shard"), "left_semi"), self.width)
        return done.where("length(bits) > 0").union(anew)

    def _sharded(self, keys: DataFrame) -> DataFrame:
        return keys.select(F.substring("k", 1, self.width).alias("shard"), "k")

    def _probed(self, keys: DataFrame) -> DataFrame:
        """k and whether its shard's filter may hold it."""

        def run(shard, old, new):  # noqa: ANN001, ANN202
            k = new.column("k").combine_chunks() if new.num_rows else pa.array([], pa.binary())
            table = old.column("bits")[0].as_py() if old.num_rows else None
            maybe = Cuckoo(table=np.frombuffer(table, np.uint16).reshape(-1, 4)).contains(_numbers(k)) if table and len(k) else np.zeros(len(k), bool)
            return pa.table({"k": k, "maybe": pa.array(maybe)})

        return self._filters().groupBy("shard").cogroup(self._sharded(keys).groupBy("shard")).applyInArrow(run, "k binary, maybe boolean")

    def insert(self, docs: DataFrame) -> None:
        """Adds documents; ValueError if one with keys is in the index already."""
        new = S.stored(line_refs(docs, self.length))
        if self.refs().join(new.select("doc_id").distinct(), "doc_id", "left_semi").limit(1).count():
            raise ValueError("a document is in the index already: delete it first")
        maybe = S.stored(self._probed(new.select("k").distinct()))
        sure, ask = maybe.where("not maybe").select("k"), maybe.where("maybe").select("k")
        fresh = sure.union(ask.join(self.refs().select("k").distinct(), "k", "left_anti"))
        self._write(new, self._changed(fresh, add=True))

    def delete(self, ids: DataFrame) -> None:
        """Takes documents (doc_id) out; ids that are not in change nothing."""
        refs = self.refs()
        gone = S.stored(refs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select("k", "doc_id", (-F.col("n")).alias("n")))
        left = refs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")
        empty = gone.select("k").distinct().join(left.select("k").distinct(), "k", "left_anti")
        self._write(gone, self._changed(empty, add=False))

    def drops(self, documents: int = DOCUMENTS) -> DataFrame:
        """drop_id and drop_keys, as drops() gives them for the documents that are in now."""
        return drops(self.refs(), documents)


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup(S.read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
repeated AS (
  SELECT k, max(doc_id) AS keep_id FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT keyed.*, keep_id IS NOT NULL AND keep_id <> doc_id AS gone FROM keyed LEFT JOIN repeated USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
