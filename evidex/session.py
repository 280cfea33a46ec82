"""Session builder with the settings every plan in this package assumes."""

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "evidex", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow; ``conf`` uses ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


#: Rows and bytes of an Arrow batch, however long a row is (but one row at least): what a Python worker holds at once.
BATCH_ROWS, BATCH_BYTES = 1000, "8m"


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


#: Tables of long texts, of which a row is much work.
TEXTS = {"documents", "pages"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``; any path Spark's readers open is fine.

    A table of texts that has fewer splits than the session has cores (a small file of one row group) is
    dealt out to all of them; a large one is read as it is, without a shuffle. Arrow batches of what is made of it are bounded.
    """
    bounded_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXTS and df.rdd.getNumPartitions() < cores else df


def stored(df: DataFrame) -> DataFrame:
    """df computed once and kept in the session's checkpoint folder, with its lineage cut.

    Where no folder is named, one of this machine serves a local session; on a cluster it is an error. Checkpoints of
    frames that are no longer used go if the session was built by build_session() (cleanCheckpoints).
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        sc.setCheckpointDir(path or os.path.join(tempfile.gettempdir(), "evidex-checkpoints"))
    return df.checkpoint(eager=True)
