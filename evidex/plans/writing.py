"""Queries of reflow, written formats, providers and routes."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators import terms as T
from ..operators import writing as W
from ..session import table
from ..sources import markup as M
from .layout import _LINES, _lines
from .terms import LEAVES_SQL


def snk03_reflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five lines a block; most reach both edges, some are short, indented or far below the one above."""
    n = F.col("n")
    rows = _lines(spark, sf_dir).select("doc_id", F.expr("pos div 5").alias("block"), "pos", F.when(n % 5 == 0, 40.0).otherwise(20.0).alias("x0"), F.when(n % 4 == 0, 300.0).otherwise(580.0).alias("x1"), (F.col("pos") % 5 * 15.0 + F.when(n % 6 == 0, 9.0).otherwise(0.0)).alias("y0"), F.lit(10.0).alias("size"), F.when(n % 3 == 0, F.concat("body", F.lit("."))).otherwise(F.regexp_replace("body", "[.!?]+$", "")).alias("body"))
    out = W.reflowed(rows.withColumn("y1", F.col("pos") % 5 * 15.0 + 10.0))
    return out.select("doc_id", F.col("block").cast("long"), F.col("run").cast("long"), "n_lines", F.md5("body").alias("body_md5"))


def snk07_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.written(table(spark, sf_dir, "documents").select("doc_id", "source", "text", "n_chars"))


def src12_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read by a strict parser, or by the lenient one where that fails; both and the reason are columns."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            rows = []
            for i, html in zip(df["page_id"], df["html"].fillna(""), strict=True):
                try:
                    n, used, why = sum(e.tag in ("p", "li", "h1", "h2", "h3") for e in ET.fromstring(html).iter()), "strict", None
                except ET.ParseError:
                    n, used, why = len(M.html_blocks(html)), "lenient", "PARSE_ERROR"
                rows.append((i, "strict", used, used != "strict", why, n))
            yield pd.DataFrame(rows, columns=["page_id", "requested", "provider", "fallback", "reason_code", "n_blocks"])

    return table(spark, sf_dir, "pages").select("page_id", "html").mapInPandas(run, "page_id long, requested string, provider string, fallback boolean, reason_code string, n_blocks long")


def ctx05_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.concat(F.element_at(F.array(*map(F.lit, ("overview of ", "impact of ", "what does it depend on: ", "find "))), (F.col("doc_id") % 4 + 1).cast("int")), "source")
    intent, precision, route = W.route(q, F.col("doc_id") % 3, F.lit(3), F.col("doc_id") % 5 != 0)
    return table(spark, sf_dir, "documents").select("doc_id", intent.alias("intent"), precision.alias("precision"), route.alias("route"))


def qlt07_doctor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.doctor(spark)


def udf08_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best keywords by a provider that is not there: by the one that takes its place, which is told."""
    used, why = W.keyword_provider("lexicon")
    k = T.keywords_of(table(spark, sf_dir, "documents"), 3)
    return k.select("doc_id", F.col("rank").cast("long"), "term", F.lit("lexicon").alias("requested"), F.lit(used).alias("provider"), F.lit(why).alias("reason"))


def joi10_rebased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of a joined text of every second stretch of 300 characters, mapped back to where they stand in the source."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    c = d.select("doc_id", F.explode(F.sequence(F.lit(0), F.expr("greatest(n_chars - 1, 0) div 600"))).alias("k"), "n_chars").select("doc_id", (F.col("k") * 600).cast("long").alias("source"), F.least(F.lit(300), F.col("n_chars") - F.col("k") * 600).alias("n")).where("n > 0")
    w = Window.partitionBy("doc_id").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    spans = c.withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("end", F.col("start") + F.col("n"))
    total = spans.groupBy("doc_id").agg(F.max("end").alias("total"))
    clauses = total.select("doc_id", "total", F.explode(F.sequence(F.lit(0), F.expr("(total - 1) div 200"))).alias("i")).select("doc_id", (F.col("i") * 200).alias("start"), F.least(F.col("i") * 200 + 200, F.col("total")).alias("end"))
    both = R.overlapping(clauses, spans, "doc_id", 300)
    at = F.col("r_source") + F.greatest(F.lit(0), F.col("l_start") - F.col("r_start"))
    return both.select("doc_id", F.col("l_start").cast("long").alias("clause"), at.cast("long").alias("start"), (F.col("r_source") + F.least("r_end", "l_end") - F.col("r_start")).cast("long").alias("end"))


def nat06_selected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the pages asked for are read: the filter reaches the scan."""
    return table(spark, sf_dir, "pages").where("page_id between 10 and 40 or page_id = 99").select("page_id", F.length("html").cast("long").alias("n_chars"))


def nat10_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three focus lines of a page (the largest, then the highest) and the one that the eye goes to next."""
    own = Window.partitionBy("doc_id", "page")
    top = _lines(spark, sf_dir).withColumn("r", F.row_number().over(own.orderBy(F.desc("size"), "y0", "pos")).cast("long")).where("r <= 3")
    return top.select("doc_id", "page", "r", "pos", F.lead("pos", 1, -1).over(own.orderBy("r")).cast("long").alias("next_pos"))


QUERIES = {f.__name__: f for f in (ctx05_routes, joi10_rebased, nat06_selected_pages, nat10_attention, qlt07_doctor, snk03_reflow, snk07_formats, src12_providers, udf08_providers)}
ORACLE = {
    "snk03_reflow": f"""WITH {_LINES}, t AS (SELECT doc_id, pos // 5 AS block, pos, n, CASE WHEN n % 5 = 0 THEN 40e0 ELSE 20e0 END AS a, CASE WHEN n % 4 = 0 THEN 300e0 ELSE 580e0 END AS z, pos % 5 * 15e0 + CASE WHEN n % 6 = 0 THEN 9e0 ELSE 0e0 END AS t0, pos % 5 * 15e0 + 10e0 AS t1,
          CASE WHEN n % 3 = 0 THEN body || '.' ELSE regexp_replace(body, '[.!?]+$', '') END AS body FROM l),
        e AS (SELECT *, min(a) OVER (PARTITION BY doc_id, block) AS bx0, max(z) OVER (PARTITION BY doc_id, block) AS bx1 FROM t),
        j AS (SELECT *, CASE WHEN lag(z) OVER w >= bx1 - greatest(10e0, 0.05e0 * (bx1 - bx0)) AND lag(z - a) OVER w >= 0.85e0 * (bx1 - bx0) AND NOT regexp_matches(rtrim(lag(body) OVER w), '[.!?。！？]$') AND abs(a - bx0) <= 5 AND t0 - lag(t1) OVER w BETWEEN -2 AND 8
          AND NOT regexp_matches(body, '^([-*•]|[0-9]+[.)])\\s') THEN 0 ELSE 1 END AS brk FROM e WINDOW w AS (PARTITION BY doc_id, block ORDER BY pos)),
        i AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id, block ORDER BY pos)::BIGINT AS run FROM j)
        SELECT doc_id, block, run, count(*) AS n_lines, md5(string_agg(body, ' ' ORDER BY pos)) AS body_md5 FROM i GROUP BY doc_id, block, run""",
    "snk07_formats": "SELECT f AS format, count(*) AS n, true AS ok FROM documents, (SELECT unnest(['json', 'csv', 'text', 'parquet']) AS f) GROUP BY f",
    "ctx05_routes": """WITH a AS (SELECT doc_id, doc_id % 4 AS q, CASE WHEN doc_id % 3 = 0 THEN 'no-match' WHEN doc_id % 3 = 1 THEN 'low-precision' ELSE 'pass' END AS precision FROM documents)
        SELECT doc_id, CASE q WHEN 0 THEN 'overview' WHEN 1 THEN 'impact' ELSE 'lookup' END AS intent, precision, CASE WHEN doc_id % 5 = 0 THEN 'lexical-only' WHEN q = 0 THEN 'overview' WHEN q < 3 THEN 'graph-first' WHEN precision <> 'pass' THEN 'graph-fallback' ELSE 'lexical-only' END AS route FROM a""",
    "qlt07_doctor": """SELECT unnest(['python', 'pyspark', 'pyarrow', 'pandas', 'numpy', 'adaptive', 'utc']) AS "check", true AS required, true AS ok""",
    "udf08_providers": f"""WITH {LEAVES_SQL}, d AS (SELECT doc_id, term, sum(tf) AS tf, count(*) AS support FROM leaves GROUP BY ALL)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY tf * support * least(length(term), 8) DESC, tf DESC, support DESC, term DESC) AS rank, term, 'lexicon' AS requested, 'ngram' AS provider, 'lexicon: model files are not there' AS reason FROM d QUALIFY rank <= 3""",
    "joi10_rebased": """WITH c AS (SELECT doc_id, n_chars, unnest(range(0, greatest(n_chars - 1, 0) // 600 + 1)) * 600 AS source FROM documents), s AS (SELECT doc_id, source, least(300, n_chars - source) AS n FROM c WHERE n_chars > source),
        p AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM s), t AS (SELECT doc_id, max(a + n) AS total FROM p GROUP BY doc_id),
        l AS (SELECT doc_id, i * 200 AS x, least(i * 200 + 200, total) AS y FROM (SELECT doc_id, total, unnest(range(0, (total::BIGINT - 1) // 200 + 1)) AS i FROM t))
        SELECT doc_id, x::BIGINT AS clause, (source + greatest(0, x - a))::BIGINT AS start, (source + least(a + n, y) - a)::BIGINT AS "end" FROM l JOIN p USING (doc_id) WHERE x < a + n AND y > a""",
    "nat06_selected_pages": "SELECT page_id, length(html) AS n_chars FROM pages WHERE page_id BETWEEN 10 AND 40 OR page_id = 99",
    "nat10_attention": f"""WITH {_LINES}, t AS (SELECT doc_id, page, pos, row_number() OVER (PARTITION BY doc_id, page ORDER BY size DESC, y0, pos) AS r FROM l QUALIFY r <= 3) SELECT doc_id, page, r, pos, lead(pos, 1, -1) OVER (PARTITION BY doc_id, page ORDER BY r) AS next_pos FROM t""",
}
COVERAGE = {
    "ctx05_routes": ("CTX05",), "joi10_rebased": ("JOI10",), "nat06_selected_pages": ("NAT06",), "nat10_attention": ("NAT10",), "qlt07_doctor": ("QLT07",), "snk03_reflow": ("SNK03",), "snk07_formats": ("SNK07", "NAT23"), "src12_providers": ("SRC12",), "udf08_providers": ("UDF08",),
}
