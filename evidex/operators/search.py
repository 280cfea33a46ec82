"""Ranked block search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def term_hits(blocks: DataFrame, terms: Sequence[str]) -> DataFrame:
    """One row for each block and term that occurs in it, with the number of occurrences."""
    low = F.lower("body")
    pairs = F.explode(
        F.array(*[F.struct(F.lit(t).alias("term"), ((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t)).cast("long").alias("h")) for t in terms])
    )
    found = blocks.select("doc_id", "pos", F.length("body").alias("len"), pairs.alias("x"))
    return found.select("doc_id", "pos", "len", "x.term", "x.h").where("h > 0")


def block_search(blocks: DataFrame, terms: Sequence[str], limit: int, per_document: int) -> DataFrame:
    """The best ``limit`` blocks, at most ``per_document`` of each document, scored as BM25-lite.

    The statistics (blocks, mean length, blocks per term) are over all blocks. They are a handful
    of rows, so they are joined as broadcast frames of fixed size.
    """
    found = term_hits(blocks, terms)
    size = blocks.agg(F.count("*").alias("n"), F.avg(F.length("body")).alias("avg_len"))
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    part = (
        F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        * (F.col("h") / (F.col("h") + 1.2))
        / (0.75 + 0.25 * F.col("len") / F.col("avg_len"))
    )
    scored = (
        found.join(F.broadcast(df), "term")
        .crossJoin(F.broadcast(size))
        .groupBy("doc_id", "pos")
        .agg(F.count("*").alias("matched_terms"), F.sum(part).alias("s"))
        .withColumn("score", F.round(F.col("s") * (0.65 + 0.35 * F.col("matched_terms") / len(terms)), 6))
    )
    doc = Window.partitionBy("doc_id")
    return (
        scored.withColumn("rank_in_doc", F.row_number().over(doc.orderBy(F.desc("score"), "pos")))
        .withColumn("doc_hits", F.count("*").over(doc))
        .where(F.col("rank_in_doc") <= per_document)
        .orderBy(F.desc("score"), "doc_id", "pos")
        .limit(limit)
        .select("doc_id", "pos", "matched_terms", "score", "rank_in_doc", "doc_hits")
    )
