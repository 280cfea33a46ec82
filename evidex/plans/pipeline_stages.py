"""Queries of parsed sources, enriching stages and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import export as E
from ..operators import stages as P
from ..session import table
from ..sources import markup as M
from ..sources.text import blocks
from .search import BLOCKS_SQL


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def src05_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.parsed(table(spark, sf_dir, "pages"), "page_id", "html", "html")


def src05_html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


def src05_html_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = M.html_elements(table(spark, sf_dir, "pages"), "page_id", "html")
    links = F.array_join(F.transform("links", lambda x: F.concat_ws(" -> ", x["label"], x["target"])), "; ")
    return e.select(F.col("id").alias("page_id"), "pos", "type", "level", "body", "element_id", F.array_join("classes", " ").alias("classes"), links.alias("links"))


def src03_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("# "), "source", F.lit("\n\n## "), "lang", F.lit("\n```\n# no heading\n```\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")))
    b = M.parsed(_docs(spark, sf_dir).select("doc_id", text.alias("t")), "doc_id", "t", "markdown")
    return b.groupBy("doc_id").agg(*[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in ("heading", "code", "paragraph")])


def src07_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Subject: about "), "source", F.lit("\nFrom: a@example.org\nDate: Mon, 01 Jan 2024 10:00:00 +0000\nContent-Type: text/plain; charset=utf-8\n\n"), "lang", F.lit("\n"))
    b = M.parsed(_docs(spark, sf_dir).select("doc_id", text.alias("t")), "doc_id", "t", "email")
    return b.select("doc_id", "pos", "type", "body")


def src08_notebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.struct(F.when(F.col("role") == "user", "code").otherwise("markdown").alias("cell_type"), F.col("text").alias("source"))
    nb = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.transform(F.sort_array(F.collect_list(F.struct("turn", cell.alias("c")))), lambda r: r["c"]).alias("cells"))).alias("t"))
    return M.parsed(nb, "conv_id", "t", "notebook").groupBy("conv_id").agg(F.count_if(F.col("type") == "code").alias("n_code"), F.count_if(F.col("type") == "paragraph").alias("n_text"))


def src02_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.element_at(F.array(*map(F.lit, ("a.HTML", "b.md", "c.doc", "d.xlsm", "e.eml", "f.ipynb", "g.bin", "h"))), (F.col("doc_id") % 8 + 1).cast("int"))
    return _docs(spark, sf_dir).groupBy(M.format_of(names).alias("format")).agg(F.count("*").alias("n"))


def src15_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(M.decoded(raw), 256).alias("text_sha256"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a source as one document; each is a page between a header and a footer line."""
    d = _docs(spark, sf_dir)
    b = blocks(d).join(d.select("doc_id", "source"), "doc_id")
    head = d.select("source", "doc_id", F.lit(-1).alias("pos"), F.concat(F.lit("Report "), "source").alias("body"))
    foot = d.where("doc_id % 3 <> 0").select("source", "doc_id", F.lit(1 << 20).alias("pos"), F.lit("Confidential").alias("body"))
    return b.select("source", "doc_id", "pos", "body").union(head).union(foot)


def pip04_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    page = Window.partitionBy("doc_id")
    rows = _pages(spark, sf_dir).withColumn("place", F.row_number().over(page.orderBy("pos"))).withColumn("last", F.count("*").over(page))
    return P.furniture(rows.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "place", "last", "body"), 1)


def _geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines set on pages of 20 lines, indented and spaced by their lengths."""
    n = F.length("body")
    b = blocks(_docs(spark, sf_dir)).select("doc_id", F.expr("pos div 20").alias("page"), F.col("pos").cast("long").alias("pos"), "body", n.alias("n"))
    x0 = F.col("n") % 3 * 150.0
    y0 = (F.col("pos") % 20) * 40.0 + F.when(F.col("n") % 5 == 0, 30.0).otherwise(0.0)
    return b.select("doc_id", "page", "pos", "body", x0.alias("x0"), y0.alias("y0"), (x0 + 200.0).alias("x1"), (y0 + 25.0).alias("y1"))


def pip09_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.paragraphs(_geometry(spark, sf_dir))
    return p.select("doc_id", "page", F.col("para").cast("long"), "n_lines", "x0", "y0", "x1", "y1", F.length("body").cast("long").alias("n_chars"))


def pip09_thread_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = P.islands(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")
    return runs.groupBy("conv_id", "island", "role").agg(F.count("*").alias("n_turns"), F.min("turn").alias("first_turn")).select("conv_id", F.col("island").cast("long"), "role", "n_turns", "first_turn")


def pip19_heading_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(_docs(spark, sf_dir)).select("doc_id", F.col("pos").cast("long"), F.when(F.length("body") % 4 == 0, 1 + F.length("body") % 6).otherwise(0).alias("level"))
    return P.heading_parents(b).select("doc_id", "pos", "parent_pos")


def pip17_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _geometry(spark, sf_dir).select("doc_id", "page", F.col("pos").alias("id"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), F.length("body").alias("n"))
    return P.nearest(g.where("n % 4 = 1"), g.where("n % 4 = 3"))


def pip15_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(_docs(spark, sf_dir)).select("doc_id", F.col("pos").cast("long"), (F.length("body") % 9).cast("long").alias("marker"), F.length("body").alias("n"))
    out = P.first_match(b.where("n % 2 = 0").select("doc_id", "pos", "marker"), b.where("n % 2 = 1").select("doc_id", "marker", "pos"), ["doc_id", "marker"], "pos")
    return out.select("doc_id", "pos", "marker", F.coalesce("target", F.lit(-1)).cast("long").alias("target"), "status")


def pip22_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.chunks(blocks(_docs(spark, sf_dir)), 600).select("doc_id", F.col("chunk").cast("long"), F.col("n_chars").cast("long"), "n_lines")


def pip13_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.transform(F.split("body", r" \| "), lambda c: F.split(c, " "))
    b = blocks(_docs(spark, sf_dir)).where(F.col("body").contains(" | ")).select("doc_id", F.col("pos").cast("long"), rows.alias("r"))
    return b.select("doc_id", "pos", P.markdown_table("r").alias("markdown"))


def snk01_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return E.from_json_documents(E.json_documents(d, blocks(d))).select("doc_id", F.col("pos").cast("long"), F.sha2("body", 256).alias("body_sha256"))


def snk02_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return E.markdown_documents(d, blocks(d)).select("doc_id", F.sha2("markdown", 256).alias("markdown_sha256"))


def snk04_rag_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return E.rag_records(d, blocks(d)).select("id", "metadata", F.sha2("page_content", 256).alias("content_sha256"))


def snk08_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.violations(_docs(spark, sf_dir))


def snk09_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(_docs(spark, sf_dir))
    return b.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.sum(F.length("body")).alias("n_chars"), F.count_if(F.col("body").contains(" | ")).alias("n_tables"))


QUERIES = {
    f.__name__: f
    for f in (pip04_furniture, pip09_paragraphs, pip09_thread_runs, pip13_tables, pip15_footnotes, pip17_captions, pip19_heading_parents, pip22_chunks, snk01_json_round_trip, snk02_markdown, snk04_rag_records, snk08_violations, snk09_inspect, src02_formats, src03_markdown, src05_html_blocks, src05_html_elements, src05_html_links, src07_email, src08_notebook, src15_decoded)
}
_GEO = f"""{BLOCKS_SQL},
g AS (SELECT doc_id, (pos // 20)::BIGINT AS page, pos, body, length(body) AS n, (length(body) % 3) * 150e0 AS x0, (pos % 20) * 40e0 + CASE WHEN length(body) % 5 = 0 THEN 30e0 ELSE 0e0 END AS y0 FROM blocks)"""
ORACLE = {
    "src05_html_links": """SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY ALL""",
    "src03_markdown": f"WITH {BLOCKS_SQL} SELECT doc_id, 2::BIGINT AS n_heading, 1::BIGINT AS n_code, count(body) AS n_paragraph FROM documents LEFT JOIN blocks USING (doc_id) GROUP BY doc_id",
    "src07_email": """SELECT doc_id, 0::BIGINT AS pos, 'heading' AS type, 'about ' || source AS body FROM documents
        UNION ALL SELECT doc_id, 1, 'paragraph', 'Sender: a@example.org' || chr(10) || 'Date: 2024-01-01T10:00:00+00:00' FROM documents UNION ALL SELECT doc_id, 2, 'paragraph', lang FROM documents""",
    "src08_notebook": "SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS n_code, count(*) FILTER (WHERE role <> 'user') AS n_text FROM conversations GROUP BY conv_id",
    "src02_formats": """SELECT CASE doc_id % 8 WHEN 0 THEN 'html' WHEN 1 THEN 'markdown' WHEN 2 THEN 'error:legacy_format' WHEN 3 THEN 'error:macro_format' WHEN 4 THEN 'email' WHEN 5 THEN 'notebook' ELSE 'error:unsupported_format' END AS format, count(*) AS n FROM documents GROUP BY 1""",
    "src15_decoded": "SELECT doc_id, sha256(text) AS text_sha256 FROM documents",
    "pip04_furniture": f"""WITH {BLOCKS_SQL}, a AS (SELECT source, doc_id, pos, body FROM blocks JOIN documents USING (doc_id)
          UNION ALL SELECT source, doc_id, -1, 'Report ' || source FROM documents UNION ALL SELECT source, doc_id, 1048576, 'Confidential' FROM documents WHERE doc_id % 3 <> 0),
        p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place, count(*) OVER (PARTITION BY doc_id) AS last FROM a),
        r AS (SELECT *, CASE WHEN place <= 1 THEN 'header' WHEN place > last - 1 THEN 'footer' END AS role FROM p WHERE length(body) BETWEEN 1 AND 220),
        n AS (SELECT source, count(DISTINCT doc_id) AS pages FROM a GROUP BY source)
        SELECT source AS doc_id, role, lower(body) AS key, count(DISTINCT r.doc_id) AS on_pages FROM r JOIN n USING (source) WHERE role IS NOT NULL GROUP BY source, role, lower(body), pages
        HAVING count(DISTINCT r.doc_id) >= 3 AND count(DISTINCT r.doc_id) >= ceil(0.2 * pages)""",
    "pip09_paragraphs": f"""WITH {_GEO},
        j AS (SELECT *, CASE WHEN y0 - lag(y0 + 25e0) OVER w BETWEEN -2 AND 45 AND least(x0, lag(x0) OVER w) + 200 - greatest(x0, lag(x0) OVER w) >= 90 THEN 0 ELSE 1 END AS brk FROM g WINDOW w AS (PARTITION BY doc_id, page ORDER BY pos)),
        i AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id, page ORDER BY pos)::BIGINT AS para FROM j)
        SELECT doc_id, page, para, count(*) AS n_lines, min(x0) AS x0, min(y0) AS y0, max(x0) + 200 AS x1, max(y0) + 25 AS y1, (sum(n) + count(*) - 1)::BIGINT AS n_chars FROM i GROUP BY doc_id, page, para""",
    "pip09_thread_runs": """WITH c AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS brk FROM conversations),
        i AS (SELECT *, sum(brk) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS island FROM c)
        SELECT conv_id, island, role, count(*) AS n_turns, min(turn) AS first_turn FROM i GROUP BY conv_id, island, role""",
    "pip19_heading_parents": f"""WITH {BLOCKS_SQL}, l AS (SELECT doc_id, pos, CASE WHEN length(body) % 4 = 0 THEN 1 + length(body) % 6 ELSE 0 END AS level FROM blocks)
        SELECT x.doc_id, x.pos, coalesce(max(y.pos), -1)::BIGINT AS parent_pos FROM l x LEFT JOIN l y ON x.doc_id = y.doc_id AND y.pos < x.pos AND y.level > 0 AND (x.level = 0 OR y.level < x.level) GROUP BY x.doc_id, x.pos""",
    "pip17_captions": f"""WITH {_GEO}, d AS (SELECT c.doc_id, c.pos AS caption, f.pos AS figure, round(abs(c.x0 - f.x0) + abs(c.y0 - f.y0), 4) AS distance FROM g c JOIN g f ON c.doc_id = f.doc_id AND c.page = f.page AND c.n % 4 = 1 AND f.n % 4 = 3)
        SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY doc_id, caption ORDER BY distance, figure) = 1""",
    "pip15_footnotes": f"""WITH {BLOCKS_SQL}, b AS (SELECT doc_id, pos, (length(body) % 9)::BIGINT AS marker, length(body) % 2 AS odd FROM blocks),
        t AS (SELECT doc_id, marker, min(pos) AS target FROM b WHERE odd = 1 GROUP BY ALL)
        SELECT doc_id, pos, marker, coalesce(target, -1) AS target, CASE WHEN target IS NULL THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS status FROM b LEFT JOIN t USING (doc_id, marker) WHERE odd = 0""",
    "pip22_chunks": f"""WITH RECURSIVE {BLOCKS_SQL},
        p AS (SELECT doc_id, pos, k, least(600, length(body) - k * 600) AS n FROM (SELECT *, unnest(range(0, (length(body) - 1) // 600 + 1)) AS k FROM blocks)),
        o AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY pos, k) AS i FROM p),
        f(doc_id, i, chunk, used, n) AS (SELECT doc_id, 1, 0, n, n FROM o WHERE i = 1
          UNION ALL SELECT o.doc_id, o.i, CASE WHEN used + 1 + o.n <= 600 THEN chunk ELSE chunk + 1 END, CASE WHEN used + 1 + o.n <= 600 THEN used + 1 + o.n ELSE o.n END, o.n FROM f JOIN o ON o.doc_id = f.doc_id AND o.i = f.i + 1)
        SELECT doc_id, chunk::BIGINT AS chunk, (sum(n) + count(*) - 1)::BIGINT AS n_chars, count(*) AS n_lines FROM f GROUP BY doc_id, chunk""",
    "snk01_json_round_trip": f"WITH {BLOCKS_SQL} SELECT doc_id, pos, sha256(body) AS body_sha256 FROM blocks",
    "snk02_markdown": f"""WITH {BLOCKS_SQL} SELECT doc_id, sha256('# ' || source || chr(10) || chr(10) || coalesce(string_agg(body, chr(10) || chr(10) ORDER BY pos), '') || chr(10)) AS markdown_sha256
        FROM documents LEFT JOIN blocks USING (doc_id) GROUP BY doc_id, source""",
    "snk04_rag_records": f"""WITH {BLOCKS_SQL} SELECT doc_id || ':' || pos AS id, '{{"doc_id":' || doc_id || ',"source":"' || source || '","lang":"' || lang || '","block":' || pos || '}}' AS metadata, sha256(body) AS content_sha256 FROM blocks JOIN documents USING (doc_id)""",
    "snk08_violations": "SELECT doc_id, '/lang' AS pointer FROM documents WHERE lang NOT IN ('en', 'fr', 'de') UNION ALL SELECT doc_id, '/n_chars' FROM documents WHERE n_chars <> length(text) UNION ALL SELECT doc_id, '/text' FROM documents WHERE text IS NULL",
    "snk09_inspect": f"WITH {BLOCKS_SQL} SELECT doc_id, count(*) AS n_blocks, sum(length(body))::BIGINT AS n_chars, count(*) FILTER (WHERE contains(body, ' | ')) AS n_tables FROM blocks GROUP BY doc_id",
}
COVERAGE = {
    "src05_html_blocks": ("SRC05", "SRC06"), "src05_html_links": ("SRC05",), "src05_html_elements": ("SRC05",), "src03_markdown": ("SRC03", "SRC04"), "src07_email": ("SRC07",), "src08_notebook": ("SRC08",), "src02_formats": ("SRC02",), "src15_decoded": ("SRC15",),
    "pip04_furniture": ("PIP04", "NAT09"), "pip09_paragraphs": ("PIP09",), "pip09_thread_runs": ("PIP09",), "pip13_tables": ("PIP13",), "pip15_footnotes": ("PIP15", "JOI05"), "pip17_captions": ("PIP17", "FN19"), "pip19_heading_parents": ("PIP19",),
    "pip22_chunks": ("PIP22",), "snk01_json_round_trip": ("SNK01", "SRC18"), "snk02_markdown": ("SNK02",), "snk04_rag_records": ("SNK04",), "snk08_violations": ("SNK08",), "snk09_inspect": ("SNK09",),
}
