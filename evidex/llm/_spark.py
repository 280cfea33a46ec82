"""What the operators share on the Spark side."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch, however long the documents are (but one row at least).
BATCH_ROWS, BATCH_BYTES = 1000, "8m"


def tune(spark: SparkSession) -> SparkSession:
    """Arrow batches of a bounded number of rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what is computed within: rows of a few numbers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_checkpoint(spark: SparkSession) -> None:
    """The session's own checkpoint folder. Where none is named, one of this machine serves a local session only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
    sc.setCheckpointDir(path or os.path.join(tempfile.gettempdir(), "evidex-checkpoints"))


def stored(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, with its lineage cut."""
    shared_checkpoint(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate results, wherever Spark keeps it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """Only doc_id and text (null: empty), so that no other column can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def chunks(texts: list, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters together; a longer text is alone in its range."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def keep_rows(df: DataFrame, keep) -> DataFrame:
    """The rows of ``df``, with all columns, for which keep(texts) is true; ``text`` null: empty."""
    place = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(keep([t or "" for t in b.column(place).to_pylist()]), pa.bool_()))

    return df.mapInArrow(run, df.schema)
