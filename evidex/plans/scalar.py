"""Queries of the scalar functions and the text sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import table
from ..sources.text import blocks
from .search import BLOCKS_SQL


def fn03_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    t = F.concat(F.lit("﻿"), d["text"], F.lit("  \n<!-- page: 3 -->"))
    return d.select("doc_id", F.sha2(X.retrieval_text(X.without_bom(t)), 256).alias("clean_sha256"))


def fn08_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.hits(d["text"], "tion").alias("n_tion"), X.hits(d["text"], "The").alias("n_the"))


def fn09_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.snippet(d["text"], "estion").alias("snippet")).where("snippet is not null")


def fn10_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("path", F.element_at(F.array(*map(F.lit, ("Contents", "Page header", "References", "Appendix A", "Footnotes", "Metadata", "Chapter 1"))), (F.col("doc_id") % 7 + 1).cast("int")))
    r = X.region(F.col("path"))
    return d.select("doc_id", r.alias("region"), X.region_weight(r).alias("weight"))


def fn13_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(table(spark, sf_dir, "documents"))
    return b.groupBy(X.matching(F.col("body"), X.TAGS).alias("tags"), X.matching(F.col("body"), X.INTENTS).alias("intents")).agg(F.count("*").alias("n"))


def fn15_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(X.numbers(d["text"])).alias("value")).groupBy("doc_id", "value").agg(F.count("*").alias("n"))


def fn16_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(table(spark, sf_dir, "documents"))
    return b.select("doc_id", F.col("pos").cast("long"), X.needs_next(F.col("body")).alias("needs_next"), X.read_chars(F.length("body")).cast("long").alias("read_chars"))


def fn18_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.boundary(d["text"], 400).cast("long").alias("cut"))


def fn27_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.stable_id("doc", d["source"], d["lang"], d["text"]).alias("stable_id"), X.script(d["text"]).alias("script"))


def fn01_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.length(X.normalized(d["text"], "NFD")).cast("long").alias("nfd_chars"), F.sha2(X.search_form(d["text"]), 256).alias("search_sha256"))


def src03_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(table(spark, sf_dir, "documents"))
    return b.select("doc_id", F.col("pos").cast("long"), F.length("body").cast("long").alias("n_chars"), F.sha2("body", 256).alias("content_hash"))


def _when(patterns: dict[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(lower(body), '{p}') THEN '{n}' END" for n, p in patterns.items()) + ")"


QUERIES = {f.__name__: f for f in (fn01_normal_forms, fn03_clean, fn08_hits, fn09_snippet, fn10_regions, fn13_tags, fn15_numbers, fn16_next, fn18_boundary, fn27_ids, src03_blocks)}
ORACLE = {
    "fn03_clean": r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[ \t]+(\n|$)', '\1', 'g'), '^\s+|\s+$', '', 'g')) AS clean_sha256 FROM documents",
    "fn08_hits": """SELECT doc_id, (length(text) - length(replace(lower(text), 'tion', ''))) // 4 AS n_tion,
        (length(text) - length(replace(lower(text), 'the', ''))) // 3 AS n_the FROM documents""",
    "fn09_snippet": r"""WITH a AS (SELECT doc_id, text, strpos(lower(text), 'estion') AS p0 FROM documents),
        b AS (SELECT *, greatest(p0 - 40, 1) AS s, least(p0 + 46, length(text) + 1) AS e FROM a WHERE p0 > 0)
        SELECT doc_id, (CASE WHEN s > 1 THEN '…' ELSE '' END) || trim(regexp_replace(substring(text, s, e - s), '\s+', ' ', 'g')) || (CASE WHEN e <= length(text) THEN '…' ELSE '' END) AS snippet FROM b""",
    "fn10_regions": """WITH a AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'toc' WHEN 1 THEN 'header_footer' WHEN 2 THEN 'references' WHEN 3 THEN 'appendix' WHEN 4 THEN 'footnote' WHEN 5 THEN 'metadata' ELSE 'body' END AS region FROM documents)
        SELECT doc_id, region, CASE region WHEN 'toc' THEN 0.3e0 WHEN 'header_footer' THEN 0.3e0 WHEN 'footnote' THEN 0.45e0 WHEN 'references' THEN 0.6e0 WHEN 'metadata' THEN 0.6e0 ELSE 1e0 END AS weight FROM a""",
    "fn13_tags": f"WITH {BLOCKS_SQL} SELECT {_when(X.TAGS)} AS tags, {_when(X.INTENTS)} AS intents, count(*) AS n FROM blocks GROUP BY ALL",
    "fn15_numbers": f"WITH a AS (SELECT doc_id, replace(unnest(regexp_extract_all(text, '{X.NUMBER}')), ' ', '') AS value FROM documents) SELECT doc_id, value, count(*) AS n FROM a GROUP BY ALL",
    "fn16_next": f"WITH {BLOCKS_SQL} SELECT doc_id, pos, contains(body, '|') OR right(rtrim(body), 1) NOT IN ('.', '!', '?', '。', '！', '？') AS needs_next, least(3000, greatest(800, length(body)))::BIGINT AS read_chars FROM blocks",
    "fn18_boundary": r"""WITH a AS (SELECT doc_id, length(text) AS n, length(regexp_extract(substring(text, 1, 400), '^((?s:.*)(?:[.!?]|\n))', 1)) AS any_end,
        length(regexp_extract(substring(text, 1, 400), '^((?s:.*)(?:[.!?]\s|[.!?]$|\n))', 1)) AS l, substring(text, 1, 400) AS head FROM documents)
        SELECT doc_id, (CASE WHEN n <= 400 THEN n WHEN l > 0 THEN CASE WHEN regexp_matches(substring(head, l - 1, 2), '^[.!?]\s$') AND head[l] <> chr(10) THEN l - 1 ELSE l END ELSE 400 END)::BIGINT AS cut FROM a""",
    "fn27_ids": r"""SELECT doc_id, 'doc_' || substring(sha256(concat_ws(chr(31), source, lang, text)), 1, 24) AS stable_id,
        CASE WHEN regexp_matches(text, '[A-Za-z\x{00C0}-\x{024F}]') THEN 'Latin' ELSE 'Unknown' END AS script FROM documents""",
    "src03_blocks": f"WITH {BLOCKS_SQL} SELECT doc_id, pos, length(body) AS n_chars, sha256(body) AS content_hash FROM blocks",
}
COVERAGE = {
    "fn01_normal_forms": ("FN01", "FN02"), "fn03_clean": ("FN03", "FN04"), "fn08_hits": ("FN08",), "fn09_snippet": ("FN09",), "fn10_regions": ("FN10", "FN11"), "fn13_tags": ("FN13", "FN14"),
    "fn15_numbers": ("FN15",), "fn16_next": ("FN16", "FN17"), "fn18_boundary": ("FN18",), "fn27_ids": ("FN27", "FN05"), "src03_blocks": ("SRC03",),
}
