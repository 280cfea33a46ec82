"""Queries of the term aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import terms as T
from ..session import table
from ..sources.text import blocks
from .search import BLOCKS_SQL


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.leaf_terms(blocks(table(spark, sf_dir, "documents")))


def agg01_leaf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaves(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), "term", "tf")


def agg03_section_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.section_terms(table(spark, sf_dir, "documents"), "source")


def agg05_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.keywords_of(table(spark, sf_dir, "documents"))


def agg11_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.document_frequency(_leaves(spark, sf_dir))


def agg02_follower_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.follower_entropy(blocks(table(spark, sf_dir, "documents"))).where("tf >= 20")


def agg14_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sketches(blocks(table(spark, sf_dir, "documents"))).select("doc_id", F.sha2("sketch", 256).alias("sketch_sha256"))


def agg17_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.simhash(blocks(table(spark, sf_dir, "documents")))


def agg15_subtree_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    b = blocks(d).groupBy("doc_id").agg(F.sum(F.length("body")).alias("c"), F.count("*").alias("leaves"))
    g = d.select("doc_id", "source").join(b, "doc_id").groupBy("source").agg(F.sum("c").alias("c"), F.sum("leaves").alias("n_leaves"), F.count("*").alias("n_pages"))
    return g.select("source", F.greatest(F.lit(1), F.expr("c div 4")).cast("long").alias("subtree_cost"), "n_leaves", "n_pages")


LEAVES_SQL = f"""{BLOCKS_SQL},
occ AS (SELECT doc_id, pos, unnest(regexp_extract_all(lower(body), '{T.TERM}')) AS term FROM blocks),
leaves AS (SELECT doc_id, pos, term, count(*) AS tf FROM occ GROUP BY ALL)"""

QUERIES = {f.__name__: f for f in (agg01_leaf_terms, agg02_follower_entropy, agg03_section_terms, agg05_keywords, agg11_document_frequency, agg14_sketch, agg15_subtree_cost, agg17_simhash)}
ORACLE = {
    "agg01_leaf_terms": f"WITH {LEAVES_SQL} SELECT doc_id, pos, term, tf FROM leaves",
    "agg02_follower_entropy": f"""WITH {BLOCKS_SQL}, w AS (SELECT regexp_extract_all(lower(body), '{T.TERM}') AS w FROM blocks),
        p AS (SELECT unnest(w) AS term, unnest(list_concat(w[2:], ['<EOS>'])) AS nxt FROM w WHERE len(w) > 0),
        n AS (SELECT term, nxt, count(*) AS n FROM p GROUP BY ALL)
        SELECT term, sum(n)::BIGINT AS tf, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 5) AS entropy FROM n GROUP BY term HAVING sum(n) >= 20""",
    "agg03_section_terms": f"""WITH {LEAVES_SQL}, d AS (SELECT doc_id, term, sum(tf) AS tf FROM leaves GROUP BY ALL)
        SELECT source, term, sum(tf)::BIGINT AS tf, count(*) AS support FROM d JOIN documents USING (doc_id) GROUP BY ALL""",
    "agg05_keywords": f"""WITH {LEAVES_SQL}, d AS (SELECT doc_id, term, sum(tf)::BIGINT AS tf, count(*) AS support FROM leaves GROUP BY ALL),
        s AS (SELECT *, tf * greatest(1, support) * least(length(term), 8) AS score FROM d)
        SELECT doc_id, row_number() OVER w AS rank, term, tf, support, score FROM s
        WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, tf DESC, support DESC, term DESC) QUALIFY rank <= 12""",
    "agg11_document_frequency": f"""WITH {LEAVES_SQL}, n AS (SELECT count(*) AS n FROM (SELECT DISTINCT doc_id, pos FROM leaves))
        SELECT term, count(*) AS df, count(DISTINCT doc_id) AS docs, round(ln(1 + (any_value(n) + 0.5e0) / (count(*) + 0.5e0)), 6) AS idf FROM leaves CROSS JOIN n GROUP BY term""",
    "agg14_sketch": f"""WITH {BLOCKS_SQL}, f AS (SELECT doc_id, regexp_extract(body, '^[^.!?]*[.!?]?') AS s, min(pos) AS pos FROM blocks GROUP BY ALL)
        SELECT doc_id, sha256(substring(string_agg(s, ' ' ORDER BY pos, s), 1, 360)) AS sketch_sha256 FROM f GROUP BY doc_id""",
    "agg15_subtree_cost": f"""WITH {BLOCKS_SQL} SELECT source, greatest(1, sum(length(body))::BIGINT // 4)::BIGINT AS subtree_cost, count(*) AS n_leaves, count(DISTINCT doc_id) AS n_pages
        FROM blocks JOIN documents USING (doc_id) GROUP BY source""",
    "agg17_simhash": f"""WITH {LEAVES_SQL}, t AS (SELECT doc_id, ('0x' || substring(md5(term), 1, 8))::BIGINT AS h, sum(tf)::BIGINT AS n FROM leaves GROUP BY doc_id, term),
        b AS (SELECT doc_id, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN n ELSE -n END) AS s FROM t CROSS JOIN range(32) r(b) GROUP BY ALL)
        SELECT doc_id, sum(CASE WHEN s >= 0 THEN 1::BIGINT << b ELSE 0 END)::BIGINT AS simhash FROM b GROUP BY doc_id""",
}
COVERAGE = {
    "agg01_leaf_terms": ("AGG01",), "agg02_follower_entropy": ("AGG02", "FN21"), "agg03_section_terms": ("AGG03",), "agg05_keywords": ("AGG05", "TOK01", "PIP21"),
    "agg11_document_frequency": ("AGG11",), "agg14_sketch": ("AGG14",), "agg15_subtree_cost": ("AGG15",), "agg17_simhash": ("AGG17",),
}
