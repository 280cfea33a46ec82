"""Queries of the page layout. Lines of documents stand for blocks; their places and sizes are made from their lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout as L
from ..session import table
from ..sources.text import blocks
from .search import BLOCKS_SQL

WIDTH, HEIGHT = 600.0, 800.0


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, pos, body, n, size, x0, y0, x1, y1: twenty lines a page in two columns, some of them wide."""
    n = F.length("body")
    b = blocks(table(spark, sf_dir, "documents")).select("doc_id", F.expr("cast(pos div 20 as bigint)").alias("page"), F.col("pos").cast("long").alias("pos"), "body", n.alias("n"))
    size = F.when(F.col("n") % 7 == 0, 14.0).otherwise(10.0 + F.col("n") % 3 * 0.5)
    y0 = (F.col("pos") % 20) * 40.0
    wide = F.col("n") % 6 == 0
    x0 = F.when(~wide & (F.col("pos") % 2 == 1), 320.0).otherwise(20.0)
    x1 = F.when(wide, 580.0).when(F.col("pos") % 2 == 1, 580.0).otherwise(280.0)
    return b.select("*", size.alias("size"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), (y0 + 25.0).alias("y1"))


def pip02_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("role", F.when(F.col("pos") % 20 == 0, "page_header").otherwise("text"))
    return L.reading_order(rows.withColumnRenamed("pos", "id"))


def pip03_superscripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _lines(spark, sf_dir).select("doc_id", "pos", F.explode(F.split("body", " ")).alias("w"))
    size = F.when(F.length("w") % 5 == 0, 6.0).otherwise(10.0)
    spans = words.select("doc_id", "pos", size.alias("size"), size.alias("height"), (F.length("w") % 2 * 3.0).alias("top"))
    marked = L.superscripts(spans, "doc_id", "pos")
    return marked.groupBy("doc_id", "pos").agg(F.count("*").alias("n_spans"), F.count_if("superscript").alias("n_superscripts"))


def pip05_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("repeats_top", (F.col("pos") % 20 == 1) & (F.col("n") % 4 == 0)).withColumn("repeats_bottom", (F.col("pos") % 20 == 18) & (F.col("n") % 4 == 0))
    body = F.when(F.col("n") % 11 == 0, F.concat(F.substring("body", 1, 20), F.lit("..... 12"))).otherwise(F.col("body"))
    return L.roles(rows.withColumn("body", body), HEIGHT).select("doc_id", "pos", "role")


def pip06_toc_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.when(F.col("doc_id") % 3 == 0, "xiv").otherwise(F.col("doc_id").cast("string"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.col("source")).otherwise(F.concat("source", F.lit(" part ....... "), page)).alias("line"))
    title, label = L.toc_item(F.col("line"))
    return d.select("doc_id", title.alias("title"), label.alias("label"))


def pip08_heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings are lines larger than 1.2 times the size of their document's body."""
    rows = _lines(spark, sf_dir).withColumn("size", F.when(F.col("n") % 7 == 0, 14.0 + F.col("n") % 4).otherwise(F.col("size")))
    heads = rows.join(L.body_size(rows), "doc_id").where("size >= 1.2 * body_size")
    return L.heading_levels(heads).select("doc_id", "pos", F.col("level").cast("long"), "body_size")


def pip10_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.element_at(F.array(*map(F.lit, ("", "- ", "3) ", "Figure 2: ", "def f", "(4) ", "Table A.1 "))), (F.col("pos") % 7 + 1).cast("int"))
    return _lines(spark, sf_dir).groupBy(L.block_kind(F.concat(lead, "body")).alias("kind")).agg(F.count("*").alias("n"))


def pip11_continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select("doc_id", F.col("pos").alias("page"), "pos", "size", F.when(F.col("n") % 2 == 0, F.concat("body", F.lit("-"))).otherwise(F.lower("body")).alias("body"))
    rows = rows.withColumn("size", F.lit(10.0)).withColumn("body", F.regexp_replace("body", r"[.!?:;]+$", ""))
    return L.continuations(rows).select("doc_id", F.col("first_pos").cast("long"), "n_parts", F.sha2("body", 256).alias("body_sha256"))


def pip14_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = L.image_kind(F.col("x1") - F.col("x0"), F.col("n") % 90 + 5.0, WIDTH * HEIGHT, F.when(F.col("n") % 9 == 0, "A chart").otherwise("a view"))
    return _lines(spark, sf_dir).groupBy("doc_id", kind.alias("kind")).agg(F.count("*").alias("n"))


def pip16_toc_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir)
    heads = rows.where("n % 3 = 0").select("doc_id", "pos", "page", F.substring("body", 1, 25).alias("title"))
    items = rows.where("n % 2 = 0").select("doc_id", F.col("pos").alias("item"), F.concat(F.lit("  "), F.substring("body", 1, 25)).alias("title"), F.when(F.col("n") % 5 != 0, F.col("page")).otherwise(99).alias("page"))
    return L.toc_links(items, heads)


def pip18_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk-to-source relations of the sources' documents, each once however often it is stated."""
    rows = _lines(spark, sf_dir).select(F.lit("chunk_source").alias("type"), F.concat_ws(":", "doc_id", F.expr("pos div 4")).alias("source"), F.concat_ws(":", "doc_id", F.expr("pos div 8")).alias("target"), F.col("pos").alias("n"))
    return L.relations_once(rows)


def pip20_numbered_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (F.col("n") % 4).cast("string"), (F.col("n") % 3).cast("string")
    number = F.when(F.col("n") % 2 == 0, a).when(F.col("n") % 5 == 0, F.concat(a, F.lit("."), b, F.lit("."), a)).otherwise(F.concat(a, F.lit("."), b))
    rows = _lines(spark, sf_dir).select("doc_id", "pos", F.concat(number, F.lit(" "), "body").alias("body"))
    return L.numbered_parents(rows)


def pip24_page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    foot = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("- "), F.col("doc_id").cast("string"), F.lit(" -"))).when(F.col("doc_id") % 4 == 1, " xii. ").otherwise(F.concat(F.lit("page "), F.col("doc_id").cast("string")))
    kind = F.when(F.col("doc_id") % 5 == 0, "slide").when(F.col("doc_id") % 5 == 1, "worksheet").otherwise("pdf")
    return table(spark, sf_dir, "documents").select("doc_id", L.citation_label(F.col("doc_id"), L.printed_label(foot), kind).alias("label"))


def nat12_lattices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each document, drawn by ruled edges: a flat one above each of 1 to 5 rows and below, an upright one about each of 1 to 4 columns, all in two pieces that touch."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), (F.col("n_chars") % 5 + 1).alias("r"), (F.col("n_chars") % 4 + 1).alias("c"))
    line = lambda x0, y0, x1, y1: F.struct(*[v.cast("double").alias(n) for n, v in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))])
    at = lambda i: 100 + i * 50
    lo, mid = F.lit(100), F.lit(110)
    flat = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), "r"), lambda i: F.array(line(lo, at(i), mid, at(i)), line(mid + 1, at(i), at(F.col("c")), at(i)))))
    upright = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), "c"), lambda i: F.array(line(at(i), lo, at(i), mid), line(at(i), mid, at(i), at(F.col("r"))))))
    return L.lattices(d.select("key", F.inline(F.concat(flat, upright)))).withColumnRenamed("key", "doc_id")


def agg24_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters per thousand square points of each page, and whether it is so empty that it would be read by OCR."""
    g = _lines(spark, sf_dir).groupBy("doc_id", "page").agg(F.sum("n").alias("chars"))
    density = F.col("chars") / (WIDTH * HEIGHT / 1000)
    return g.select("doc_id", "page", F.round(density, 6).alias("density"), (density < 0.05).alias("needs_ocr"))


def agg25_body_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.body_size(_lines(spark, sf_dir))


QUERIES = {f.__name__: f for f in (agg24_density, agg25_body_size, nat12_lattices, pip02_reading_order, pip03_superscripts, pip05_roles, pip06_toc_items, pip08_heading_levels, pip10_kinds, pip11_continuations, pip14_images, pip16_toc_links, pip18_relations, pip20_numbered_parents, pip24_page_labels)}
_LINES = f"""{BLOCKS_SQL},
l AS (SELECT doc_id, (pos // 20)::BIGINT AS page, pos::BIGINT AS pos, body, length(body) AS n,
        CASE WHEN length(body) % 7 = 0 THEN 14e0 ELSE 10e0 + length(body) % 3 * 0.5e0 END AS size, (pos % 20) * 40e0 AS y0, (pos % 20) * 40e0 + 25e0 AS y1,
        CASE WHEN length(body) % 6 <> 0 AND pos % 2 = 1 THEN 320e0 ELSE 20e0 END AS x0, CASE WHEN length(body) % 6 = 0 OR pos % 2 = 1 THEN 580e0 ELSE 280e0 END AS x1 FROM blocks)"""
_BODY_SIZE = """s AS (SELECT doc_id, size, sum(n) AS n FROM {rows} GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY size) AS run, sum(n) OVER (PARTITION BY doc_id) AS total FROM s),
f AS (SELECT doc_id, min(size) AS body_size FROM r WHERE run * 2 >= total GROUP BY doc_id)"""
ORACLE = {
    "nat12_lattices": "SELECT doc_id, 100e0 AS x0, 100e0 AS y0, (150 + n_chars % 4 * 50)::DOUBLE AS x1, (150 + n_chars % 5 * 50)::DOUBLE AS y1, n_chars % 5 + 1 AS n_rows, n_chars % 4 + 1 AS n_columns FROM documents",
    "pip03_superscripts": f"""WITH {_LINES}, w AS (SELECT doc_id, pos, unnest(string_split(body, ' ')) AS w FROM l),
        s AS (SELECT doc_id, pos, CASE WHEN length(w) % 5 = 0 THEN 6e0 ELSE 10e0 END AS size, length(w) % 2 * 3e0 AS top FROM w),
        m AS (SELECT *, median(size) OVER p AS ms, median(top) OVER p AS mt, count(*) OVER p AS c FROM s WINDOW p AS (PARTITION BY doc_id, pos))
        SELECT doc_id, pos, count(*) AS n_spans, count(*) FILTER (WHERE (size <= ms * 0.78e0 OR size <= ms * 0.8e0) AND top < mt AND c >= 2) AS n_superscripts FROM m GROUP BY ALL""",
    "pip05_roles": f"""WITH {_LINES}, t AS (SELECT * REPLACE (CASE WHEN n % 11 = 0 THEN substring(body, 1, 20) || '..... 12' ELSE body END AS body) FROM l),
        m AS (SELECT *, median(size) OVER (PARTITION BY doc_id, page) AS ms FROM t)
        SELECT doc_id, pos, CASE WHEN y0 > 688 AND size < 0.95e0 * ms AND regexp_matches(body, '^\\s*[0-9]{{1,3}}[.)]?\\s*[A-Za-z]') THEN 'footnote' WHEN y0 <= 48 THEN 'page_header' WHEN pos % 20 = 1 AND n % 4 = 0 THEN 'page_header'
          WHEN y1 >= 752 THEN 'page_footer' WHEN pos % 20 = 18 AND n % 4 = 0 THEN 'page_footer' WHEN n % 11 = 0 THEN 'toc'
          WHEN size >= 1.25e0 * ms AND length(trim(body)) BETWEEN 1 AND 120 THEN 'heading' ELSE 'text' END AS role FROM m""",
    "pip06_toc_items": "SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN source || ' part' END AS title, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'xiv' ELSE doc_id::VARCHAR END AS label FROM documents",
    "pip08_heading_levels": f"""WITH {_LINES}, t AS (SELECT * REPLACE (CASE WHEN n % 7 = 0 THEN 14e0 + n % 4 ELSE size END AS size) FROM l), {_BODY_SIZE.format(rows="t")}
        SELECT doc_id, pos, least(6, dense_rank() OVER (PARTITION BY doc_id ORDER BY size DESC)) AS level, body_size FROM t JOIN f USING (doc_id) WHERE size >= 1.2e0 * body_size""",
    "pip10_kinds": f"""WITH {_LINES}, k AS (SELECT pos % 7 AS lead, body FROM l)
        SELECT CASE WHEN lead IN (3, 6) THEN 'caption' WHEN lead IN (1, 2, 5) THEN 'list' WHEN lead = 0 AND regexp_matches(body, '^\\s*(figure|fig\\.?|table)\\s*([0-9]+|[a-zA-Z](\\.[0-9]+)?)(\\s*[:.)-]|\\s+)', 'i') THEN 'caption'
          WHEN lead = 0 AND regexp_matches(body, '^\\s*([-+*•]\\s|([0-9]+|[A-Za-z])[.)]\\s|\\([0-9]+\\)\\s|\\[[0-9]+\\]\\s)') THEN 'list'
          WHEN regexp_matches(CASE WHEN lead = 4 THEN 'def f' ELSE '' END || body, '^(\\s*(```|~~~|//|(def|class|function|import|fn|impl|use|interface|enum)\\s|[A-Za-z_$][A-Za-z0-9_.$]*\\()|\\t| {{4}}\\S)') THEN 'code' ELSE 'plain' END AS kind, count(*) AS n FROM k GROUP BY 1""",
    "pip14_images": f"""WITH {_LINES}, k AS (SELECT doc_id, x1 - x0 AS w, n % 90 + 5e0 AS h, n FROM l)
        SELECT doc_id, CASE WHEN greatest(w / h, h / w) >= 8 OR w * h <= 2400 THEN 'decorative' WHEN n % 9 = 0 THEN 'chart_candidate' ELSE 'image' END AS kind, count(*) AS n FROM k GROUP BY ALL""",
    "pip16_toc_links": f"""WITH {_LINES}, h AS (SELECT doc_id, pos, page, lower(trim(regexp_replace(substring(body, 1, 25), '\\s+', ' ', 'g'))) AS k FROM l WHERE n % 3 = 0),
        i AS (SELECT doc_id, pos AS item, lower(trim(regexp_replace('  ' || substring(body, 1, 25), '\\s+', ' ', 'g'))) AS k, CASE WHEN n % 5 <> 0 THEN page ELSE 99 END AS page FROM l WHERE n % 2 = 0),
        a AS (SELECT doc_id, k, min(pos) AS t1 FROM h GROUP BY ALL), b AS (SELECT doc_id, page, min(pos) AS t2 FROM h GROUP BY ALL)
        SELECT doc_id, item, coalesce(t1, t2, -1) AS target, CASE WHEN t1 IS NOT NULL THEN 'HIGH' WHEN t2 IS NOT NULL THEN 'LOW' ELSE 'UNRESOLVED' END AS confidence FROM i LEFT JOIN a USING (doc_id, k) LEFT JOIN b USING (doc_id, page)""",
    "pip18_relations": f"WITH {_LINES} SELECT 'chunk_source' AS type, doc_id || ':' || pos // 4 AS source, doc_id || ':' || pos // 8 AS target, min(pos) AS n FROM l GROUP BY ALL",
    "pip20_numbered_parents": f"""WITH {_LINES}, k AS (SELECT doc_id, pos, CASE WHEN n % 2 = 0 THEN (n % 4)::VARCHAR WHEN n % 5 = 0 THEN (n % 4) || '.' || (n % 3) || '.' || (n % 4) ELSE (n % 4) || '.' || (n % 3) END AS number FROM l),
        u AS (SELECT *, regexp_replace(number, '\\.?[0-9]+$', '') AS above FROM k)
        SELECT c.doc_id, c.pos, c.number, coalesce(max(p.pos), -1) AS parent_pos, c.above <> '' AND max(p.pos) IS NULL AS unresolved FROM u c LEFT JOIN k p ON c.doc_id = p.doc_id AND c.above = p.number AND p.pos < c.pos GROUP BY c.doc_id, c.pos, c.number, c.above""",
    "pip24_page_labels": """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Slide ' || doc_id WHEN 1 THEN 'Worksheet "' || doc_id || '"' ELSE 'PDF p.' || doc_id || CASE doc_id % 4 WHEN 0 THEN ' (printed p.' || doc_id || ')' WHEN 1 THEN ' (printed p.xii)' ELSE '' END END AS label FROM documents""",
    "agg24_density": f"WITH {_LINES} SELECT doc_id, page, round(sum(n) / 480e0, 6) AS density, sum(n) / 480e0 < 0.05 AS needs_ocr FROM l GROUP BY ALL",
    "agg25_body_size": f"WITH {_LINES}, {_BODY_SIZE.format(rows='l')} SELECT * FROM f",
}
COVERAGE = {
    "agg24_density": ("AGG24", "SRC20"), "agg25_body_size": ("AGG25",), "nat12_lattices": ("NAT12",), "pip02_reading_order": ("PIP02", "NAT08", "NAT17"), "pip03_superscripts": ("PIP03",), "pip05_roles": ("PIP05",), "pip06_toc_items": ("PIP06",), "pip08_heading_levels": ("PIP08",),
    "pip10_kinds": ("PIP10",), "pip11_continuations": ("PIP11", "PIP12"), "pip14_images": ("PIP14",), "pip16_toc_links": ("PIP16", "NAT14"), "pip18_relations": ("PIP18", "PIP23"), "pip20_numbered_parents": ("PIP20",), "pip24_page_labels": ("PIP24", "FN12"),
}
