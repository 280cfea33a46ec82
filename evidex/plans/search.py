"""Ranked block search; a block is a line of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import block_search
from ..session import table
from ..sources.text import blocks

TERMS = ("the", "tion", "estion")


def rnk04_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_search(blocks(table(spark, sf_dir, "documents")), TERMS, limit=20, per_document=3)


BLOCKS_SQL = """
blocks AS (
  SELECT doc_id, pos, body FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS body,
           generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
    FROM documents)
  WHERE trim(body) <> '')"""

QUERIES = {"rnk04_block_search": rnk04_block_search}
ORACLE = {
    "rnk04_block_search": f"""
WITH {BLOCKS_SQL},
terms AS (SELECT * FROM (VALUES {', '.join(f"('{t}')" for t in TERMS)}) t(term)),
size AS (SELECT count(*) AS n, avg(length(body)) AS avg_len FROM blocks),
hits AS (
  SELECT doc_id, pos, term, length(body) AS len,
         (length(lower(body)) - length(replace(lower(body), term, ''))) // length(term) AS h
  FROM blocks CROSS JOIN terms),
found AS (SELECT * FROM hits WHERE h > 0),
df AS (SELECT term, count(*) AS df FROM found GROUP BY term),
scored AS (
  SELECT doc_id, pos, count(*) AS matched_terms,
         round(sum(ln(1.0e0 + (n - df + 0.5e0) / (df + 0.5e0)) * (h / (h + 1.2e0)) / (0.75e0 + 0.25e0 * len / avg_len))
               * (0.65e0 + 0.35e0 * count(*) / {len(TERMS)}), 6) AS score
  FROM found JOIN df USING (term) CROSS JOIN size GROUP BY doc_id, pos),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank_in_doc,
         count(*) OVER (PARTITION BY doc_id) AS doc_hits FROM scored)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, matched_terms, score, CAST(rank_in_doc AS INTEGER) AS rank_in_doc, doc_hits
FROM ranked WHERE rank_in_doc <= 3 ORDER BY score DESC, doc_id, pos LIMIT 20""",
}
COVERAGE = {"rnk04_block_search": ("RNK04", "RNK05", "WIN01", "WIN02", "LIM01", "SRC03")}
