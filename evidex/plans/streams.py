"""Streaming queries, each drained over the files that are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import events as E


def ext_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = E.drained(E.windows(E.files(spark, sf_dir, "events"), "1 hour", "2 hours"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def ext_stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = E.drained(E.once(E.files(spark, sf_dir, "events")))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_ids"))


def str01_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents streamed in, cut into lines on the way: lines and characters of each document."""
    d = E.files(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("body")).where(F.trim("body") != "")
    return E.drained(d).groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.sum(F.length("body")).alias("n_chars"))


def str02_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = E.upserted(E.files(spark, sf_dir, "events"), "user_id", "event_id")
    return e.select("user_id", "event_id", "event_type")


def str03_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents streamed in that are not known with their digest."""
    d = E.files(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    known = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "old").otherwise(F.md5("text")).alias("h"))
    return E.changed_only(d, known, "doc_id", "h").select("doc_id", "h")


def str04_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the progress events of a stream tell of."""
    return E.progress(E.files(spark, sf_dir, "pages").select("page_id")).agg(F.sum("n").alias("n"))


def str05_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a stream that looks for new files at an interval."""
    return E.progress(E.files(spark, sf_dir, "labels"), "1 second").agg(F.sum("n").alias("n"))


def str06_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents put together again from their lines."""
    lines = F.split("text", "\n")
    parts = E.files(spark, sf_dir, "documents").select("doc_id", F.size(lines).alias("of"), F.posexplode(lines).alias("i", "body")).select("doc_id", "i", "of", F.length("body").alias("n"))
    return E.drained(E.assembled(parts))


QUERIES = {f.__name__: f for f in (ext_stream_windows, ext_stream_once, str01_ingest, str02_latest, str03_changed, str04_progress, str05_refreshed, str06_assembled)}
ORACLE = {
    # Windows that the watermark (the newest event less two hours) has passed.
    "ext_stream_windows": """WITH w AS (SELECT date_trunc('hour', ts) AS s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL)
        SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, event_type, n, total FROM w WHERE s + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""",
    "ext_stream_once": "SELECT event_type, count(DISTINCT event_id) AS n, count(DISTINCT event_id) AS n_ids FROM events GROUP BY event_type",
    "str01_ingest": "SELECT doc_id, count(*) AS n_blocks, sum(length(body))::BIGINT AS n_chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS body FROM documents) WHERE trim(body) <> '' GROUP BY doc_id",
    "str02_latest": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "str03_changed": "SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 3 = 0 OR doc_id % 4 = 0",
    "str04_progress": "SELECT count(*) AS n FROM pages",
    "str05_refreshed": "SELECT count(*) AS n FROM labels",
    "str06_assembled": "SELECT doc_id, len(string_split(text, chr(10))) AS n_parts, (length(text) - len(string_split(text, chr(10))) + 1)::BIGINT AS n_chars FROM documents",
}
COVERAGE = {"ext_stream_windows": ("EXT",), "ext_stream_once": ("EXT",), "str01_ingest": ("STR01",), "str02_latest": ("STR02",), "str03_changed": ("STR03",), "str04_progress": ("STR04",), "str05_refreshed": ("STR05",), "str06_assembled": ("STR06", "NAT07")}
