"""Queries of collection search, windows, joins and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators import terms as T
from ..operators.ranking import signal_score
from ..session import table
from ..sources.text import blocks
from .search import BLOCKS_SQL

UNITS = ("the", "tion", "with")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(table(spark, sf_dir, "documents"))


def _hits(spark: SparkSession, sf_dir: str, units: tuple[str, ...] = UNITS) -> DataFrame:
    return R.scored(R.all_or_any(R.unit_hits(_blocks(spark, sf_dir), units), len(units)), len(units))


def rnk01_collection_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).orderBy(F.desc("score"), "doc_id", "pos").limit(100).select("doc_id", F.col("pos").cast("long"), "matched", "hits", "score", "match_mode")


def rnk01_any_term_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, ("with", "no such phrase at all")).groupBy("match_mode").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


def rnk03_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rollup(_hits(spark, sf_dir))


def win01_capped_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("doc_id")
    hits = _hits(spark, sf_dir).withColumn("doc_rank", F.row_number().over(own.orderBy(F.desc("score"), "pos")).cast("long")).withColumn("doc_hit_count", F.count("*").over(own))
    order = (F.desc("score"), "doc_id", "pos")
    return R.page(hits.where("doc_rank <= 2"), 10, 25, *order).select("doc_id", F.col("pos").cast("long"), "score", "doc_rank", "doc_hit_count", "has_more")


def win03_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("pos"))
    return _blocks(spark, sf_dir).select("doc_id", F.col("pos").cast("long"), F.lag("pos", 1, -1).over(order).cast("long").alias("prev_pos"), F.lead("pos", 1, -1).over(order).cast("long").alias("next_pos"))


def win04_source_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _blocks(spark, sf_dir).withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")))
    seed = b.where(F.col("body").contains("ention")).select("doc_id", F.col("rn").alias("seed"))
    near = seed.select("doc_id", "seed", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("shift")).withColumn("rn", F.col("seed") + F.col("shift"))
    return near.join(b, ["doc_id", "rn"]).select("doc_id", F.col("seed").cast("long"), F.col("shift").cast("long"), F.col("pos").cast("long"))


def joi24_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    g = d.groupBy("content_hash").agg(F.min("doc_id").alias("kept_id"), F.count("*").alias("copies"))
    return g.where("copies > 1")


NUMBERS = r"[0-9]+(?:[.,][0-9]+)*"


def joi19_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within a source: marks of 64 bits within three, the same numbers, and token counts that differ by two or a tenth at most."""
    docs, b = table(spark, sf_dir, "documents"), _blocks(spark, sf_dir)
    numbers = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({NUMBERS})"), 1))), " ")
    n = T.term_rows(b, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = docs.select("doc_id", "source", numbers.alias("numbers")).join(n, "doc_id").join(T.simhash(b, bits=64), "doc_id")
    firsts = rows.groupBy("source", "numbers", "n", "simhash").agg(F.min("doc_id").alias("id"))  # equal ones are one row before they are paired
    close = F.abs(F.col("a_n") - F.col("b_n")) <= F.greatest(F.lit(2.0), 0.1 * F.greatest("a_n", "b_n"))
    return R.near_pairs(firsts, 64, 3, ("source", "numbers"), close)


def joi09_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _blocks(spark, sf_dir)
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("body") + 2).over(order), F.lit(0))
    spans = b.select("doc_id", F.col("pos").cast("long").alias("block"), start.alias("start"), (start + F.length("body")).alias("end"))
    clauses = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.expr("(n_chars - 1) div 300"))).alias("clause")).select("doc_id", "clause", (F.col("clause") * 300).alias("start"), (F.col("clause") * 300 + 250).alias("end"))
    return R.overlapping(clauses, spans, "doc_id", 500).select("doc_id", F.col("l_clause").cast("long").alias("clause"), F.col("r_block").alias("block"))


def _old(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of the documents: the old one lacks some, has others changed and some that are gone."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    old = d.where("doc_id % 7 <> 0").withColumn("h", F.when(F.col("doc_id") % 5 == 0, F.sha2("h", 256)).otherwise(F.col("h")))
    return old, d.where("doc_id % 11 <> 0")


def joi16_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old(spark, sf_dir)
    both = old.withColumnRenamed("h", "old_h").join(new.withColumnRenamed("h", "new_h"), "doc_id", "full_outer")
    change = F.when(F.col("old_h").isNull(), "added").when(F.col("new_h").isNull(), "removed").when(~F.col("old_h").eqNullSafe(F.col("new_h")), "changed")
    return both.select("doc_id", change.alias("change")).where("change is not null")


def joi02_index_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old(spark, sf_dir)
    fresh = new.join(old, ["doc_id", "h"], "left_semi").select("doc_id", F.lit("fresh").alias("state"))
    missing = new.join(old, "doc_id", "left_anti").select("doc_id", F.lit("missing_from_index").alias("state"))
    orphan = old.join(new, "doc_id", "left_anti").select("doc_id", F.lit("orphan").alias("state"))
    stale = old.alias("o").join(new.alias("n"), "doc_id").where(~F.col("o.h").eqNullSafe(F.col("n.h"))).select("doc_id", F.lit("stale").alias("state"))
    return fresh.union(missing).union(orphan).union(stale)


def rnk15_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hits(spark, sf_dir).withColumn("cost", F.greatest(F.lit(1), F.expr("length(body) div 4")))
    return R.fitting(rows, "cost", 300, "doc_id", F.desc("score"), "pos").select("doc_id", F.col("pos").cast("long"), "score", F.col("spent").cast("long"))


def rnk12_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hits of a document; what a hit covers is its share of the units, and how it fits is what it shows of figures, dates and names."""
    b = _hits(spark, sf_dir)
    marks = T.simhash(b, "doc_id", "pos", bits=64)
    cost = F.greatest(F.lit(1), F.expr("length(body) div 4")).cast("long")
    rows = b.join(marks, ["doc_id", "pos"]).select("doc_id", F.col("pos").cast("long").alias("id"), "score", cost.alias("cost"), "simhash", (F.col("matched") / len(UNITS)).alias("coverage"), signal_score(F.col("body")).alias("intent"))
    return R.mmr(rows, "doc_id", 400, "doc_id long, id long, score double, cost long, simhash long, coverage double, intent double, place long")


def ctx08_first_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hits of a document; the best one is mandatory."""
    hits = _hits(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "pos")))
    rows = hits.select("doc_id", F.col("pos").cast("long").alias("id"), F.greatest(F.lit(1), F.expr("length(body) div 4")).cast("long").alias("cost"), "score", (F.col("n") == 1).alias("mandatory"))
    return R.first_fit(rows, "doc_id", 200, "doc_id long, id long, cost long, score double, mandatory boolean")


def rnk11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest by cosine for each vector whose id is divisible by 50; queries are taken against all rows."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return R.nearest(v, v.where("id % 50 = 0"), 5).withColumnRenamed("id", "vec_id")


def rnk11_text_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of each text by hashed features of whole texts, at the least similarity of a neighbour; every text is a query."""
    v = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), R.feature_vectors(F.col("text")).alias("v"))
    return R.nearest(v, v, 5, R.NEAREST)


_HITS = f"""{BLOCKS_SQL},
u AS (SELECT *, [{', '.join(f"(length(body) - length(replace(lower(body), '{x}', ''))) // {len(x)}" for x in UNITS)}] AS h,
      [{', '.join(f"strpos(lower(body), '{x}')" for x in UNITS)}] AS p FROM blocks),
m AS (SELECT *, len(list_filter(h, lambda x: x > 0)) AS matched, list_sum(h)::BIGINT AS hits,
      list_max(list_filter(p, lambda x: x > 0)) - list_min(list_filter(p, lambda x: x > 0)) AS span FROM u),
k AS (SELECT * FROM m WHERE matched > 0),
f AS (SELECT max(matched) = {len(UNITS)} AS whole FROM k),
hits AS (SELECT doc_id, pos, body, matched::BIGINT AS matched, hits, CASE WHEN whole THEN 'all_terms' ELSE 'any_term' END AS match_mode,
      round((hits / (hits + 1.2e0)) * (0.65e0 + 0.35e0 * matched / {len(UNITS)}) * (0.85e0 + 0.15e0 * CASE WHEN matched = 1 THEN 1e0 ELSE 1e0 / (1e0 + span / 80e0) END), 6) AS score
      FROM k CROSS JOIN f WHERE matched = {len(UNITS)} OR NOT whole)"""

_OLD = """d AS (SELECT doc_id, sha256(text) AS h FROM documents),
o AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN sha256(h) ELSE h END AS h FROM d WHERE doc_id % 7 <> 0),
n AS (SELECT * FROM d WHERE doc_id % 11 <> 0)"""

QUERIES = {
    f.__name__: f
    for f in (ctx08_first_fit, joi02_index_health, joi09_overlaps, joi16_snapshot_diff, joi19_near_duplicates, joi24_exact_duplicates, rnk01_any_term_fallback, rnk01_collection_search, rnk03_rollup, rnk11_nearest, rnk11_text_neighbours, rnk12_mmr, rnk15_budget, win01_capped_page, win03_neighbours, win04_source_window)
}
ORACLE = {
    "rnk01_collection_search": f"WITH {_HITS} SELECT doc_id, pos, matched, hits, score, match_mode FROM hits ORDER BY score DESC, doc_id, pos LIMIT 100",
    "rnk01_any_term_fallback": f"""WITH {BLOCKS_SQL}, c AS (SELECT (length(body) - length(replace(lower(body), 'with', ''))) // 4 AS h FROM blocks)
        SELECT 'any_term' AS match_mode, count(*) AS n, round(avg(round((h / (h + 1.2e0)) * (0.65e0 + 0.35e0 * 1 / 2) * 1e0, 6)), 6) AS mean_score FROM c WHERE h > 0""",
    "rnk03_rollup": f"""WITH {_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS n FROM hits)
        SELECT doc_id, count(*) AS hit_count, max(score) AS best_score, max(pos) FILTER (WHERE n = 1) AS top_pos, string_agg(pos::VARCHAR, ',' ORDER BY n) FILTER (WHERE n <= 3) AS top_blocks FROM r GROUP BY doc_id""",
    "win01_capped_page": f"""WITH {_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS doc_rank, count(*) OVER (PARTITION BY doc_id) AS doc_hit_count FROM hits),
        c AS (SELECT *, count(*) OVER () > 35 AS has_more FROM r WHERE doc_rank <= 2)
        SELECT doc_id, pos, score, doc_rank, doc_hit_count, has_more FROM c ORDER BY score DESC, doc_id, pos LIMIT 25 OFFSET 10""",
    "win03_neighbours": f"WITH {BLOCKS_SQL} SELECT doc_id, pos, lag(pos, 1, -1) OVER w AS prev_pos, lead(pos, 1, -1) OVER w AS next_pos FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY pos)",
    "win04_source_window": f"""WITH {BLOCKS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM blocks)
        SELECT s.doc_id, s.rn AS seed, r.rn - s.rn AS shift, r.pos FROM r s JOIN r ON s.doc_id = r.doc_id AND r.rn BETWEEN s.rn - 1 AND s.rn + 1 WHERE contains(s.body, 'ention')""",
    "joi24_exact_duplicates": "SELECT sha256(text) AS content_hash, min(doc_id) AS kept_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
    "joi09_overlaps": f"""WITH {BLOCKS_SQL}, s AS (SELECT doc_id, pos AS block, length(body) AS len, coalesce(sum(length(body) + 2) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM blocks),
        c AS (SELECT doc_id, unnest(range(0, (n_chars - 1) // 300 + 1)) AS clause FROM documents)
        SELECT doc_id, clause, block FROM c JOIN s USING (doc_id) WHERE clause * 300 < a + len AND clause * 300 + 250 > a""",
    "joi16_snapshot_diff": f"""WITH {_OLD} SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change
        FROM o FULL JOIN n ON o.doc_id = n.doc_id WHERE o.h IS DISTINCT FROM n.h""",
    "joi02_index_health": f"""WITH {_OLD} SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'missing_from_index' WHEN n.doc_id IS NULL THEN 'orphan' WHEN o.h = n.h THEN 'fresh' ELSE 'stale' END AS state
        FROM o FULL JOIN n ON o.doc_id = n.doc_id""",
    "rnk15_budget": f"""WITH {_HITS}, s AS (SELECT doc_id, pos, score, sum(greatest(1, length(body) // 4)) OVER (PARTITION BY doc_id ORDER BY score DESC, pos ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM hits)
        SELECT * FROM s WHERE spent <= 300""",
    "rnk11_nearest": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS similarity FROM v JOIN v q ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
        SELECT query_id, vec_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s QUALIFY rank <= 5""",
}
from .terms import LEAVES_SQL  # noqa: E402

ORACLE["joi19_near_duplicates"] = f"""WITH {LEAVES_SQL}, t AS (SELECT doc_id, ('0x' || substring(md5(term), 9, 8))::BIGINT AS lo, ('0x' || substring(md5(term), 1, 8))::BIGINT AS hi, sum(tf)::BIGINT AS n FROM leaves GROUP BY doc_id, term),
        u AS (SELECT doc_id, b.b AS b, sum(CASE WHEN (lo >> b.b) & 1 = 1 THEN n ELSE -n END) AS s, sum(CASE WHEN (hi >> b.b) & 1 = 1 THEN n ELSE -n END) AS z, sum(n) AS n FROM t CROSS JOIN range(32) b(b) GROUP BY ALL),
        m AS (SELECT doc_id, sum(CASE WHEN s >= 0 THEN 1::BIGINT << b ELSE 0 END)::BIGINT AS lo, sum(CASE WHEN z >= 0 THEN 1::BIGINT << b ELSE 0 END)::BIGINT AS hi, max(n)::BIGINT AS n FROM u GROUP BY doc_id),
        f AS (SELECT source, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{NUMBERS}'))), ' ') AS numbers, n, lo, hi, min(doc_id) AS id FROM m JOIN documents USING (doc_id) GROUP BY ALL)
        SELECT x.id AS a, y.id AS b FROM f x JOIN f y ON x.source = y.source AND x.numbers = y.numbers AND x.id < y.id
        WHERE bit_count(xor(x.lo, y.lo)) + bit_count(xor(x.hi, y.hi)) <= 3 AND abs(x.n - y.n) <= greatest(2e0, 0.1e0 * greatest(x.n, y.n))"""
COVERAGE = {
    "rnk01_collection_search": ("RNK01", "RNK02", "RNK06", "SRT01", "SRT02"), "rnk01_any_term_fallback": ("RNK01",), "rnk03_rollup": ("RNK03",), "win01_capped_page": ("WIN01", "WIN02", "WIN05", "LIM01", "LIM02"),
    "win03_neighbours": ("WIN03", "SRT06"), "win04_source_window": ("WIN04",), "joi24_exact_duplicates": ("JOI24",), "joi19_near_duplicates": ("JOI19", "FN20"), "joi09_overlaps": ("JOI09", "SUM13"),
    "joi16_snapshot_diff": ("JOI16", "CG09"), "joi02_index_health": ("JOI02", "JOI03", "JOI04"), "rnk15_budget": ("RNK15",), "rnk12_mmr": ("RNK12",), "ctx08_first_fit": ("CTX08", "SKL06"), "rnk11_nearest": ("RNK11",), "rnk11_text_neighbours": ("RNK11",),
}
