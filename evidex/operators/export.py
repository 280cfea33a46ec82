"""Exports: blocks and documents as JSON, Markdown and retrieval records; checks of what is exported."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_documents(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id and ``json``: a document with its blocks in order."""
    b = blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "body"))).alias("blocks"))
    return docs.join(b, "doc_id", "left").select("doc_id", F.to_json(F.struct("doc_id", "source", "lang", "blocks")).alias("json"))


def from_json_documents(rows: DataFrame) -> DataFrame:
    """doc_id, pos, body of what json_documents() wrote; missing fields are null."""
    schema = "doc_id long, source string, lang string, blocks array<struct<pos: int, body: string>>"
    return rows.select(F.from_json("json", schema).alias("d")).select("d.doc_id", F.inline("d.blocks"))


def markdown_documents(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id and ``markdown``: the source as title, lines as paragraphs."""
    b = blocks.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "body"))), lambda r: r["body"]), "\n\n").alias("t"))
    return docs.join(b, "doc_id", "left").select("doc_id", F.concat(F.lit("# "), "source", F.lit("\n\n"), F.coalesce("t", F.lit("")), F.lit("\n")).alias("markdown"))


def rag_records(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """id, page_content and metadata (JSON) of each block."""
    meta = F.to_json(F.struct("doc_id", "source", "lang", F.col("pos").alias("block")))
    return blocks.join(docs.select("doc_id", "source", "lang"), "doc_id").select(F.concat_ws(":", "doc_id", "pos").alias("id"), F.col("body").alias("page_content"), meta.alias("metadata"))


def violations(docs: DataFrame) -> DataFrame:
    """doc_id and pointer of each broken rule: required fields, allowed languages, n_chars as counted."""
    rules = [("/text", F.col("text").isNull()), ("/lang", ~F.coalesce(F.col("lang").isin("en", "fr", "de"), F.lit(False))), ("/n_chars", ~F.col("n_chars").eqNullSafe(F.length("text").cast("long")))]
    broken = F.filter(F.array(*[F.when(c, F.lit(p)) for p, c in rules]), lambda x: x.isNotNull())
    return docs.select("doc_id", F.explode(broken).alias("pointer"))
