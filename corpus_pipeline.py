"""A corpus pipeline over ``documents``: quality, line dedup, near-duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet
and read again as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from evidex.llm import _spark as S
from evidex.llm import bpe, lines, quality, similar, tiling


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects; labels are those of the corpus (of one class: all stay).
    A null text is scored as an empty one; repeated rows share their score."""
    return quality.keep(docs, S.read(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated long lines out of the texts; every row stays, with null and empty texts as they are and rows of one
    doc_id as one document."""
    return lines.dedup_rows(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of texts with 0.8 or more of their runs of
    five words in common: links of SimHash by vantage-point trees (operator 4), verified on the runs, and those
    beyond its radius (see similar.similar() for missing and repeated ids)."""
    return similar.dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a benchmark item is found; null and empty texts and items match nothing."""
    return tiling.decontaminate(docs, S.read(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the tokens and of the text that they decode to, of every row; a null text is empty."""
    return bpe.digests(docs)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", decontaminate),
    ("bpe", tokenize),
]

#: No stage but the second can be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder and read again.

    An empty table gives no rows. A stage's output goes when the next one's is written; the last stays, as the result reads it.
    """
    S.shared_checkpoint(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = S.read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}-{name}")
        docs = spark.read.parquet(f"{root}/{k}-{name}")
        if k:
            S.remove(spark, f"{root}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
