"""Queries of office files and of what callers plug in."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import extension as X
from ..sources import office as O
from ..session import table
from ..sources.text import blocks
from .search import BLOCKS_SQL


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _made(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """id, content: an office file of all lines of each document, whole; every ninth is broken. Control characters, which XML has not, become '?'."""
    lines = F.transform(F.split("text", "\n"), lambda t: F.concat(F.lit("L "), F.regexp_replace(t, r"[\x00-\x1f]", "?")))
    d = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "source", lines.alias("lines"))

    def run(it):  # noqa: ANN001, ANN202
        for df in it:
            out = []
            for i, s, x in zip(df["id"], df["source"], df["lines"], strict=True):
                x = list(x)
                raw = O.make_docx(s, x) if kind == "docx" else O.make_pptx([(s, t) for t in x]) if kind == "pptx" else O.make_xlsx(x)
                out.append((i, raw[:40] if i % 9 == 0 else raw))
            yield pd.DataFrame(out, columns=["id", "content"])

    return d.mapInPandas(run, "id long, content binary")


def src09_docx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.docx(_made(spark, sf_dir, "docx")).select("id", "place", "type", "level", "body")


def src10_pptx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.pptx(_made(spark, sf_dir, "pptx"))


def src13_xlsx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.xlsx(_made(spark, sf_dir, "xlsx"))


def src13_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of B1:C3: a range is a filter."""
    return src13_xlsx(spark, sf_dir).where("sheet = 'Data' and row between 1 and 3 and col between 2 and 3")


def nat22_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of package parts resolved by an equi-join: parts' brands to the folder that holds them."""
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("ppt/"), "p_brand").alias("part"), F.concat(F.lit("rId"), (F.col("p_size") % 5).cast("string")).alias("rel"))
    rels = p.groupBy("part", "rel").agg(F.count("*").alias("n")).select("part", "rel", F.concat("part", F.lit("/_rels/"), "rel").alias("target"), "n")
    return p.distinct().join(rels, ["part", "rel"])


def fn06_language_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.concat("lang", F.element_at(F.array(*map(F.lit, ("", "_US", "-Latn-DE", "--x", "-toolongsubtag", "!"))), (F.col("doc_id") % 6 + 1).cast("int")))
    clean = F.replace(tag, F.lit("_"), F.lit("-"))
    return _docs(spark, sf_dir).select("doc_id", F.when((clean == "auto") | clean.rlike(r"^(?:[A-Za-z]{2,8}(?:-[A-Za-z0-9]{1,8})*|x(?:-[A-Za-z0-9]{1,8})+)$"), clean).alias("tag"))


def fn07_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query units of made-up queries: quoted phrases first, then bare words, each once whatever its case."""
    q = F.concat("source", F.lit(' "Capital Buffer" RATIO ratio '), "lang", F.lit(' ! "x y"'))
    phrases = F.transform(F.regexp_extract_all(q, F.lit('"([^"]+)"'), 1), lambda p: F.trim(p))
    bare = F.filter(F.split(F.trim(F.regexp_replace(q, '"[^"]+"', " ")), r"\s+"), lambda w: w.rlike(r"[\p{L}\p{N}_]"))
    units = F.array_distinct(F.transform(F.concat(phrases, bare), lambda u: F.lower(u)))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(units, "|").alias("units"))


def fn22_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return d.select("doc_id", X.tokens(F.col("text"), "whitespace").alias("n_tokens"), F.md5(X.truncated(F.col("text"), 50)).alias("first_md5"))


def fn28_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots, logarithms and shares, rounded; eighths to two digits are half cases, which go to the even neighbour."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(F.sqrt("p_retailprice"), 4).alias("root"), F.round(F.log1p("p_retailprice"), 6).alias("log"), F.bround(F.col("p_size") / 7, 4).alias("share"), F.bround(F.col("p_size") / 8, 2).alias("half"), X.rounded(F.col("p_size") / 8, 2).alias("exact_half"))


def agg16_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The branch (child of the root) of every node below it."""
    from ..operators.graph import tree_closure
    from .graph import tree

    t = tree(spark, sf_dir)
    return tree_closure(t, 3).join(t.where("parent = 'root'").select(F.col("node").alias("ancestor")), "ancestor").select("node", F.col("ancestor").alias("branch"))


def _spans(text: str, k: int) -> list[tuple[int, int]]:
    """The first k sentences."""
    out, at = [], 0
    while len(out) < k and at < len(text):
        end = text.find(".", at) + 1 or len(text)
        out.append((at, end))
        at = end
    return out


def udf01_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider of the first two sentences, held to its contract."""
    return X.summarised(_docs(spark, sf_dir), _spans, 2).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("end").alias("end"), F.max("status").alias("status"))


def udf03_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return X.enriched(p, lambda df: df.assign(words=df["p_name"].str.split().str.len())[["p_partkey", "words"]], "p_partkey long, words long")


def udf05_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a line's first word stands in the document's last characters; lines of an odd length are not determined."""
    d = _docs(spark, sf_dir).select("doc_id", F.lower(F.substring("text", -200, 200)).alias("evidence"))
    b = blocks(_docs(spark, sf_dir)).select("doc_id", F.when(F.length("body") % 2 == 0, F.lower(F.split("body", " ")[0])).alias("claim"))

    def check(c: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else x in y for x, y in zip(c, e, strict=True)], dtype="object")

    return X.checked(b.join(d, "doc_id"), check)


def pip25_stage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three stages over the documents' lines, with the rows and mean length after each."""
    stages = [("split", blocks), ("long_lines", lambda d: d.where(F.length("body") >= 40)), ("first_lines", lambda d: d.where("pos < 3"))]
    return X.staged(_docs(spark, sf_dir), stages, lambda d: F.round(F.avg(F.length("body")), 4))[1]


def udf07_data_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of the regions read through a Python data source, a partition each."""
    X.register(spark)
    names = [r.r_name for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]  # five rows
    rows = spark.read.format("evidex_lines").option("texts", "\x1e".join(f"{n}\nregion" for n in names)).load()
    return rows.where("pos = 0").select("doc", "body")


def udf09_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a small lexicon in each text, the longest at each place."""
    hits = F.explode(X.longest_matches(F.col("text"), ["the", "there", "keit", "heit", "tion", "tions"]))
    return _docs(spark, sf_dir).select("doc_id", hits.alias("entry")).groupBy("doc_id", "entry").agg(F.count("*").alias("n"))


def nat25_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common words of six letters or more, as a dictionary, wherever they occur in the texts, inside other words too; those of ten or more go before others."""
    d = _docs(spark, sf_dir)
    words = d.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{6,})"), 1)).alias("entry")).groupBy("entry").agg(F.count("*").alias("n")).where("n >= 5")
    found = X.dictionary_matches(d.select(F.col("doc_id").alias("id"), "text"), words.select("entry", (F.length("entry") >= 10).cast("long").alias("priority")))
    return found.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n"), F.count_distinct("entry").alias("n_entries"), F.sum("start").alias("starts"))


def nat26_affect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polarity of each document by a lexicon of its own common words (by length), joined on the word."""
    w = _docs(spark, sf_dir).select("doc_id", F.explode(F.split(F.lower("text"), r"[ \n]")).alias("term")).where("term <> ''")
    lexicon = w.groupBy("term").agg(F.count("*").alias("n")).where("n >= 5").select("term", F.when(F.length("term") % 3 == 0, "joy").when(F.length("term") % 3 == 1, "fear").otherwise("calm").alias("category"), (F.length("term") % 3 - 1).cast("long").alias("polarity"))
    return X.lexicon_hits(w, lexicon).groupBy("doc_id", "category").agg(F.count("*").alias("n"), F.sum("polarity").alias("polarity"))


def sum03_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of at most 2,000 characters, cut after the last line end in their second half where there is one."""
    most, half = 2000, 1000
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("ends"))

    def step(s, _):  # noqa: ANN001, ANN202
        head = F.substring("text", s["at"], F.lit(most))
        last = F.length(F.regexp_extract(F.substring(head, half + 1, most - half), r"^((?s:.*)\n)", 1))
        full = F.length(head) == most
        n = F.when(full & (s["at"] + most <= F.length("text")) & (last > 0), last + half).otherwise(F.length(head))
        done = s["at"] > F.length("text")
        return F.when(done, s).otherwise(F.struct((s["at"] + n).alias("at"), F.concat(s["ends"], F.array((s["at"] + n - 1).cast("int"))).alias("ends")))

    d = _docs(spark, sf_dir).where("text <> ''")
    steps = F.sequence(F.lit(1), F.expr(f"length(text) div {half} + 1"))
    return d.select("doc_id", F.posexplode(F.aggregate(steps, start, step)["ends"]).alias("w", "end")).select("doc_id", F.col("w").cast("long").alias("window"), F.col("end").cast("long"))


def sum11_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings (lines of a length divisible by seven) that stay as context: those with a kept line (of an even length) before the next heading."""
    b = blocks(_docs(spark, sf_dir)).select("doc_id", F.col("pos").cast("long").alias("pos"), F.length("body").alias("n"))
    head = F.col("n") % 7 == 0
    run = F.sum(head.cast("int")).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    g = b.withColumn("run", run).groupBy("doc_id", "run").agg(F.min(F.when(head, F.col("pos"))).alias("pos"), F.count_if(~head & (F.col("n") % 2 == 0)).alias("kept"))
    return g.where("pos is not null and kept > 0").select("doc_id", "pos", "kept")


def pip07_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figure regions: lines of the twelve before a caption on its page that lie in its column by nine tenths; two at least."""
    from .layout import _lines

    rows = _lines(spark, sf_dir)
    c = rows.where("n % 9 = 4").select("doc_id", "page", F.col("pos").alias("caption"), F.col("x0").alias("cx0"), F.col("x1").alias("cx1"))
    met = rows.join(c, ["doc_id", "page"]).where("pos < caption and pos >= caption - 12")
    inside = (F.least("x1", "cx1") - F.greatest("x0", "cx0")) >= 0.9 * (F.col("x1") - F.col("x0"))
    return met.where(inside).groupBy("doc_id", "caption").agg(F.count("*").alias("n_members"), F.min("y0").alias("top")).where("n_members >= 2")


QUERIES = {
    f.__name__: f
    for f in (agg16_branches, fn06_language_tags, fn07_queries, fn22_tokens, fn28_rounding, nat22_relations, nat25_matches, nat26_affect, pip07_figures, pip25_stage_report, src09_docx, src10_pptx, src13_range, src13_xlsx, sum03_windows, sum11_context, udf01_provider, udf03_enriched, udf05_support, udf07_data_source, udf09_lexicon)
}
_MADE = r"m AS (SELECT doc_id AS id, source, 'L ' || regexp_replace(x, '[\x00-\x1f]', '?', 'g') AS t, i - 1 AS i FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"
_CELLS = "w AS (SELECT id, t, i + 1 AS row, length(t) AS n, first_value(length(t)) OVER (PARTITION BY id ORDER BY i) AS n1 FROM m WHERE id % 9 <> 0)"
_B = f"{BLOCKS_SQL}, b AS (SELECT doc_id, pos::BIGINT AS pos, body, length(body) AS n FROM blocks)"
from .graph import _TREE  # noqa: E402
from .layout import _LINES  # noqa: E402

ORACLE = {
    "src09_docx": f"""WITH {_MADE}, g AS (SELECT id, source, i FROM m WHERE id % 9 <> 0) SELECT id, i + 1 AS place, 'paragraph' AS type, 0::BIGINT AS level, t AS body FROM m WHERE id % 9 <> 0 UNION ALL SELECT doc_id, 0, 'heading', 1, source FROM documents WHERE doc_id % 9 <> 0
        UNION ALL SELECT id, max(i) + 2, 'table', 0, 'a' || chr(9) || any_value(source) FROM g GROUP BY id UNION ALL SELECT doc_id, 0, 'error', 0, NULL FROM documents WHERE doc_id % 9 = 0""",
    "src10_pptx": f"""WITH {_MADE} SELECT id, 2 * i AS place, 'heading' AS type, 1::BIGINT AS level, source AS body, 10e0 AS x0, 20e0 AS y0 FROM m WHERE id % 9 <> 0 UNION ALL SELECT id, 2 * i + 1, 'paragraph', 0, t, 10e0, 90e0 FROM m WHERE id % 9 <> 0
        UNION ALL SELECT doc_id, 0, 'error', 0, NULL, NULL, NULL FROM documents WHERE doc_id % 9 = 0""",
    "src13_xlsx": f"""WITH {_MADE}, {_CELLS} SELECT id, 'Data' AS sheet, row, 1::BIGINT AS col, 'string' AS kind, t AS value, NULL AS formula FROM w UNION ALL SELECT id, 'Data', row, 2, 'number', n::VARCHAR, NULL FROM w
        UNION ALL SELECT id, 'Data', row, 3, 'number', (n * n1)::VARCHAR, 'B' || row || '*$B$1' FROM w UNION ALL SELECT doc_id, '', 0, 0, 'error', NULL, NULL FROM documents WHERE doc_id % 9 = 0""",
    "src13_range": f"""WITH {_MADE}, {_CELLS} SELECT id, 'Data' AS sheet, row, 2::BIGINT AS col, 'number' AS kind, n::VARCHAR AS value, NULL AS formula FROM w WHERE row <= 3
        UNION ALL SELECT id, 'Data', row, 3, 'number', (n * n1)::VARCHAR, 'B' || row || '*$B$1' FROM w WHERE row <= 3""",
    "nat22_relations": "SELECT 'ppt/' || p_brand AS part, 'rId' || p_size % 5 AS rel, 'ppt/' || p_brand || '/_rels/rId' || p_size % 5 AS target, count(*) AS n FROM part GROUP BY ALL",
    "fn06_language_tags": "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN lang WHEN 1 THEN lang || '-US' WHEN 2 THEN lang || '-Latn-DE' END AS tag FROM documents",
    "fn07_queries": "WITH u AS (SELECT doc_id, unnest(['capital buffer', 'x y', lower(source), 'ratio', lang]) AS u, unnest([1, 2, 3, 4, 5]) AS i FROM documents), d AS (SELECT doc_id, u, min(i) AS i FROM u GROUP BY ALL) SELECT doc_id, string_agg(u, '|' ORDER BY i) AS units FROM d GROUP BY doc_id",
    "fn22_tokens": r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, len(w) AS n_tokens, md5(array_to_string(w[1:50], ' ')) AS first_md5 FROM w",
    "fn28_rounding": "SELECT p_partkey, round(sqrt(p_retailprice), 4) AS root, round(ln(1 + p_retailprice), 6) AS log, round(p_size / 7, 4) AS share, round_even(p_size / 8, 2) AS half, round_even(p_size / 8, 2) AS exact_half FROM part",
    "agg16_branches": f"WITH RECURSIVE {_TREE} SELECT c.node, c.ancestor AS branch FROM c JOIN t ON t.node = c.ancestor WHERE t.parent = 'root'",
    "udf01_provider": "WITH a AS (SELECT doc_id, text, strpos(text, '.') AS p FROM documents WHERE text <> ''), b AS (SELECT *, CASE WHEN p = 0 THEN length(text) ELSE p END AS e FROM a), c AS (SELECT *, strpos(substring(text, e + 1), '.') AS q FROM b) SELECT doc_id, CASE WHEN e >= length(text) THEN 1 ELSE 2 END::BIGINT AS n, CASE WHEN e >= length(text) THEN e WHEN q = 0 THEN length(text) ELSE e + q END::BIGINT AS \"end\", 'ok' AS status FROM c",
    "udf03_enriched": "SELECT p_partkey, len(string_split(p_name, ' ')) AS words FROM part",
    "udf05_support": f"""WITH {_B}, c AS (SELECT doc_id, CASE WHEN n % 2 = 0 THEN contains(lower(right(text, 200)), lower(string_split(body, ' ')[1])) END AS v FROM b JOIN documents USING (doc_id))
        SELECT doc_id, round(coalesce(avg(v::INT), 0), 6) AS supported_ratio, count(*) FILTER (WHERE v IS NULL) AS undetermined FROM c GROUP BY doc_id""",
    "pip25_stage_report": f"""WITH {_B} SELECT 0::BIGINT AS place, 'split' AS stage, count(*) AS n, round(avg(n), 4) AS measure FROM b UNION ALL SELECT 1, 'long_lines', count(*), round(avg(n), 4) FROM b WHERE n >= 40 UNION ALL SELECT 2, 'first_lines', count(*), round(avg(n), 4) FROM b WHERE n >= 40 AND pos < 3""",
    "udf07_data_source": "SELECT (row_number() OVER (ORDER BY r_regionkey) - 1)::INTEGER AS doc, r_name AS body FROM region",
    "udf09_lexicon": "WITH h AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), 'there|tions|heit|keit|tion|the')) AS entry FROM documents) SELECT doc_id, entry, count(*) AS n FROM h GROUP BY ALL",
    "nat26_affect": r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[ \n]')) AS t FROM documents), v AS (SELECT * FROM w WHERE t <> ''), l AS (SELECT t FROM v GROUP BY t HAVING count(*) >= 5)
        SELECT doc_id, CASE length(t) % 3 WHEN 0 THEN 'joy' WHEN 1 THEN 'fear' ELSE 'calm' END AS category, count(*) AS n, sum(length(t) % 3 - 1)::BIGINT AS polarity FROM v JOIN l USING (t) GROUP BY ALL""",
    "sum11_context": f"""WITH {_B}, r AS (SELECT *, sum((n % 7 = 0)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM b), g AS (SELECT doc_id, run, min(pos) FILTER (WHERE n % 7 = 0) AS pos, count(*) FILTER (WHERE n % 7 <> 0 AND n % 2 = 0) AS kept FROM r GROUP BY ALL)
        SELECT doc_id, pos, kept FROM g WHERE pos IS NOT NULL AND kept > 0""",
    "pip07_figures": f"""WITH {_LINES} SELECT l.doc_id, c.pos AS caption, count(*) AS n_members, min(l.y0) AS top FROM l JOIN l c ON l.doc_id = c.doc_id AND l.page = c.page AND c.n % 9 = 4 AND l.pos < c.pos AND l.pos >= c.pos - 12
        WHERE least(l.x1, c.x1) - greatest(l.x0, c.x0) >= 0.9e0 * (l.x1 - l.x0) GROUP BY ALL HAVING count(*) >= 2""",
}
COVERAGE = {
    "agg16_branches": ("AGG16",), "fn06_language_tags": ("FN06",), "fn07_queries": ("FN07",), "fn22_tokens": ("FN22", "UDF02"), "fn28_rounding": ("FN28",), "nat22_relations": ("NAT22",), "nat25_matches": ("NAT25", "UDF09"), "nat26_affect": ("NAT26",), "pip07_figures": ("PIP07", "NAT15"), "pip25_stage_report": ("PIP25", "UDF06"),
    "src09_docx": ("SRC09", "NAT20", "SRC01"), "src10_pptx": ("SRC10", "NAT21"), "src13_xlsx": ("SRC13", "NAT18", "NAT19"), "src13_range": ("SRC13",), "sum03_windows": ("SUM03",), "sum11_context": ("SUM11",), "udf01_provider": ("UDF01", "SUM01"), "udf03_enriched": ("UDF03",), "udf05_support": ("UDF05",),
    "udf07_data_source": ("UDF07",), "udf09_lexicon": ("UDF09", "NAT25"),
}
