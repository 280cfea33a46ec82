"""Structured Streaming over event and document files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored


def files(spark: SparkSession, sf_dir: str, name: str, per_trigger: int = 8) -> DataFrame:
    """A stream of a table's Parquet files; the schema is read once from the files that are there."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{sf_dir}/{name}.parquet*")


def windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and sum of values in each window and type; events later than ``late`` are too late."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def once(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event_id once, remembered for as long as its watermark allows."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and returns what it wrote.

    Output and progress lie in the session's checkpoint folder, which executors share.
    """
    spark = stream.sparkSession
    stored(spark.range(1))  # sets the folder where none is named
    root = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4()}"
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def _each_batch(stream: DataFrame, do, mode: str = "append", every: str | None = None) -> str:  # noqa: ANN001
    """Runs do(batch, number, folder) for each batch of a stream until all that is there is read; the folder of the run.

    A batch that is run again after a failure has the same number.
    """
    spark = stream.sparkSession
    stored(spark.range(1))  # sets the folder where none is named
    root = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4()}"
    w = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, n: do(batch, n, root)).option("checkpointLocation", f"{root}/progress")
    q = (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
    if every:
        q.processAllAvailable()
        q.stop()
    else:
        q.awaitTermination()
    return root


def upserted(stream: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key after a stream has been drained.

    The state of a key is its latest row so far; a batch gives out the keys that it changed, so what is written and what the view
    reads are rows of changed keys, not of the stream.
    """
    latest = stream.groupBy(key).agg(F.max_by(F.struct(*stream.columns), F.col(order)).alias("row"))
    root = _each_batch(latest, lambda batch, n, root: batch.write.mode("overwrite").parquet(f"{root}/out/batch={n}"), "update")
    rows = stream.sparkSession.read.option("basePath", f"{root}/out").parquet(f"{root}/out/batch=*")
    return rows.groupBy(key).agg(F.max_by("row", "batch").alias("row")).select("row.*")


def changed_only(stream: DataFrame, known: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows of a stream whose digest is not the known one of their key, batch by batch; each batch is a partition of its own.

    A batch that is run again after a failure overwrites its own folder, so nothing is written twice.
    """
    known = stored(known.select(key, digest))
    root = _each_batch(stream, lambda batch, n, root: batch.join(known, [key, digest], "left_anti").write.mode("overwrite").parquet(f"{root}/out/batch={n}"))
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out/batch=*")


def progress(stream: DataFrame, every: str | None = None) -> DataFrame:
    """batch, n of all batches of a stream, however many; with ``every`` it is triggered at that interval until all is read.

    A row for each batch comes to the driver, which counts it as it comes: events that the query keeps go after a hundred.
    """
    counts: dict[int, int] = {}
    _each_batch(stream, lambda batch, n, root: counts.update({n: batch.count()}), every=every)
    return stream.sparkSession.createDataFrame([(n, m) for n, m in sorted(counts.items()) if m], "batch long, n long")


def assembled(parts: DataFrame) -> DataFrame:
    """doc_id, n_parts, n_chars of each document once all its parts (doc_id, i, of, n) have come in, in any order and batch.

    The state of a document is how many parts have come and their characters; it goes when the document is whole.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, batches, state: GroupState):  # noqa: ANN001, ANN202
        n, chars = state.get if state.exists else (0, 0)
        of = 0
        for df in batches:
            n, chars, of = n + len(df), chars + int(df["n"].sum()), int(df["of"].max())
        if n >= of:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"doc_id": [key[0]], "n_parts": [n], "n_chars": [chars]})
        else:
            state.update((n, chars))

    return parts.groupBy("doc_id").applyInPandasWithState(run, "doc_id long, n_parts long, n_chars long", "n long, chars long", "append", GroupStateTimeout.NoTimeout)
