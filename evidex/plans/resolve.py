"""Queries of resolving joins; rows of the tables stand for nodes, names and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import resolve as R
from ..session import table
from ..sources.text import blocks
from .graph import _TREE, tree
from .search import BLOCKS_SQL


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(table(spark, sf_dir, "documents")).select("doc_id", F.col("pos").cast("long").alias("pos"), "body", F.length("body").alias("n"))


def joi01_hits_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of two terms, their blocks and documents; only documents of the registry's active sources."""
    b = _blocks(spark, sf_dir)
    postings = b.select("doc_id", "pos", F.explode(F.array_distinct(F.split(F.lower("body"), " "))).alias("term")).where(F.col("term").isin("the", "de"))
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").where("lang in ('en', 'fr')")
    return postings.join(b.select("doc_id", "pos", "n"), ["doc_id", "pos"]).join(d, "doc_id").groupBy("source", "lang", "term").agg(F.count("*").alias("n_blocks"), F.sum("n").alias("n_chars"))


def joi06_either_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers (for blocks) that a supplier (for a table) names by its own number or by ten times it: by either key, each at most once."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k1"), (F.col("s_suppkey") * 10).alias("k2"), "s_suppkey")
    return R.either(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_custkey"), s, "key", ["k1", "k2"], ["s_suppkey"]).select("s_suppkey", "c_custkey")


def joi08_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations between a document's lines, as relations of the pairs of lines that hold them."""
    b = _blocks(spark, sf_dir)
    name = lambda p: F.concat_ws(":", "doc_id", p)
    held = b.where("pos % 5 <> 4").groupBy("doc_id", F.expr("pos div 2").alias("p")).agg(F.collect_list(F.col("pos")).alias("ps"))
    held = held.select(F.concat(F.lit("b"), name("p")).alias("block"), F.transform("ps", lambda x: F.concat_ws(":", F.col("doc_id"), x)).alias("sources"))
    rel = b.select(name(F.col("pos")).alias("source"), name(F.col("pos") + 1).alias("target"), F.when(F.col("n") % 2 == 0, "next").otherwise("refers").alias("type"))
    return R.projected(rel, held)


def joi11_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names are references; parts whose names begin with the word (by brand) and colours resolve them."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("w"), "p_brand", "p_size")
    names = p.select(F.explode("w").alias("ref")).distinct()
    exact = p.where("p_size = 1").select(F.element_at("w", 1).alias("ref"), F.concat(F.lit("a"), F.col("p_brand")).alias("target"))
    second = p.where("p_size <= 3").select(F.element_at("w", 2).alias("ref"), F.concat(F.lit("b"), F.col("p_brand")).alias("target"))
    loose = p.where("p_size <= 10").select(F.element_at("w", -1).alias("ref"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("target"))
    return R.cascade(names, exact, second, loose)


def joi12_selected_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    nodes = p.select(F.col("p_partkey").cast("string").alias("node"), F.col("p_brand").alias("qualified_name"), F.col("p_type").alias("display_name"))
    wanted = nodes.select(F.explode(F.array("node", "qualified_name", "display_name")).alias("selector")).distinct()
    return R.selected(nodes, wanted)


def joi13_like_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    low = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    n = sum((low.contains(t).cast("long") for t in ("steel", "blue", "#3")), F.lit(0).cast("long"))
    return p.select("p_partkey", n.alias("n_terms")).where("n_terms > 0")


def joi15_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached enrichments of documents that fit in provider, version and text; others are to be made."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("hash"))
    cache = d.where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "old").otherwise(F.col("hash")).alias("hash"), F.lit("p").alias("provider"), F.when(F.col("doc_id") % 5 == 0, 1).otherwise(2).alias("version"), F.lit(True).alias("there"))
    want = d.withColumn("provider", F.lit("p")).withColumn("version", F.lit(2))
    return want.join(cache, ["doc_id", "hash", "provider", "version"], "left").select("doc_id", F.coalesce("there", F.lit(False)).alias("cached"))


def joi17_block_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _blocks(spark, sf_dir).select(F.concat_ws(":", "doc_id", "pos").alias("id"), F.col("body").alias("text"), F.col("pos").alias("place"), F.col("n").cast("double").alias("x"), F.lit(1.0).alias("y"), "n")
    new = b.where("n % 7 <> 0").select("id", F.when(F.col("n") % 5 == 0, F.reverse("text")).otherwise(F.col("text")).alias("text"), (F.col("place") + F.when(F.col("n") % 4 == 0, 1).otherwise(0)).alias("place"), (F.col("x") + F.when(F.col("n") % 3 == 0, 0.6).otherwise(0.4)).alias("x"), "y")
    extra = b.where("n % 6 = 1").select(F.concat(F.lit("new"), "id").alias("id"), "text", "place", "x", "y")
    return R.block_changes(b.drop("n"), new.union(extra)).groupBy("change").agg(F.count("*").alias("n"))


def joi17_cell_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.transform(F.split("body", r"\. "), lambda r: F.split(r, " "))
    b = _blocks(spark, sf_dir).select(F.concat_ws(":", "doc_id", "pos").alias("id"), rows.alias("rows"))
    new = b.select("id", F.transform("rows", lambda r: F.transform(r, lambda c: F.when(F.length(c) % 7 == 0, F.lit("x")).otherwise(c))).alias("rows"))
    return R.cell_changes(b, new).groupBy("id").agg(F.count("*").alias("n_cells"), F.max("row").cast("long").alias("last_row"))


def joi18_prefix_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _blocks(spark, sf_dir)
    gold = b.where("n % 3 = 0").select("doc_id", F.col("pos").alias("gold"), F.substring("body", 1, 12).alias("prefix"))
    return R.prefix_matches(gold, b.select("doc_id", "pos", F.col("body").alias("text")), 12)


def joi20_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits at all levels of the tree, scored by characters; what stands above a hit of 0.6 of its score goes."""
    t = tree(spark, sf_dir)
    c = G.tree_closure(t, 3)
    score = c.join(t.select("node", "chars"), "node").groupBy("ancestor").agg(F.max("chars").alias("best"), F.sum("chars").alias("s"))
    hits = score.select(F.col("ancestor").alias("node"), (F.col("best") + F.sqrt("s")).alias("score")).where("score > 20")
    return R.without_covered(hits, c).select("node", F.round("score", 4).alias("score"))


def joi21_best_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A skill's name resolves to the one of highest priority; two of the same priority make it ambiguous."""
    p = table(spark, sf_dir, "part").select(F.element_at(F.split("p_name", " "), 1).alias("name"), "p_partkey", "p_size")
    top = p.withColumn("r", F.rank().over(Window.partitionBy("name").orderBy(F.desc("p_size")))).where("r = 1")
    return top.groupBy("name").agg(F.min("p_partkey").alias("target"), (F.count("*") > 1).alias("ambiguous"))


def joi23_cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of each nation, whichever end of them it is: orders between a customer's and a supplier's nation."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey")).join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")
    rel = l.join(o, "o_orderkey").groupBy(F.col("c_nationkey").alias("source"), F.col("s_nationkey").alias("target")).agg(F.count("*").alias("n"))
    ends = rel.select(F.col("source").alias("nation"), "source", "target", "n").union(rel.select("target", "source", "target", "n")).distinct()
    return ends.groupBy("nation").agg(F.count("*").alias("n_relations"), F.sum("n").alias("n"))


QUERIES = {f.__name__: f for f in (joi01_hits_in_documents, joi06_either_key, joi08_projected, joi11_resolution, joi12_selected_nodes, joi13_like_search, joi15_enriched, joi17_block_changes, joi17_cell_changes, joi18_prefix_gold, joi20_uncovered, joi21_best_name, joi23_cross_references)}
ORACLE = {
    "joi01_hits_in_documents": f"""WITH {BLOCKS_SQL}, t AS (SELECT doc_id, pos, length(body) AS n, unnest(list_distinct(string_split(lower(body), ' '))) AS term FROM blocks)
        SELECT source, lang, term, count(*) AS n_blocks, sum(n)::BIGINT AS n_chars FROM t JOIN documents USING (doc_id) WHERE term IN ('the', 'de') AND lang IN ('en', 'fr') GROUP BY ALL""",
    "joi06_either_key": "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_suppkey = c_custkey OR s_suppkey * 10 = c_custkey",
    "joi08_projected": f"""WITH {BLOCKS_SQL}, e AS (SELECT doc_id, pos AS a, pos + 1 AS b, CASE WHEN length(body) % 2 = 0 THEN 'next' ELSE 'refers' END AS type FROM blocks),
        h AS (SELECT doc_id, pos, 'b' || doc_id || ':' || pos // 2 AS o FROM blocks WHERE pos % 5 <> 4),
        j AS (SELECT coalesce(x.o, e.doc_id || ':' || a) AS source, coalesce(y.o, e.doc_id || ':' || b) AS target, type FROM e LEFT JOIN h x ON x.doc_id = e.doc_id AND x.pos = a LEFT JOIN h y ON y.doc_id = e.doc_id AND y.pos = b)
        SELECT DISTINCT * FROM j WHERE source <> target""",
    "joi11_resolution": """WITH p AS (SELECT *, string_split(p_name, ' ') AS w FROM part),
        c AS (SELECT w[1] AS ref, 'a' || p_brand AS target, 0 AS p FROM p WHERE p_size = 1 UNION ALL SELECT w[2], 'b' || p_brand, 1 FROM p WHERE p_size <= 3 UNION ALL SELECT w[-1], 'c' || p_partkey, 2 FROM p WHERE p_size <= 10),
        b AS (SELECT ref, target FROM c QUALIFY rank() OVER (PARTITION BY ref ORDER BY p) = 1), n AS (SELECT ref, count(DISTINCT target) AS n, min(target) AS target FROM b GROUP BY ref),
        r AS (SELECT DISTINCT unnest(w) AS ref FROM p)
        SELECT ref, CASE WHEN n <= 8 THEN target END AS target, CASE WHEN n = 1 THEN 'RESOLVED' WHEN n <= 8 THEN 'POSSIBLE' ELSE 'UNRESOLVED' END AS status, coalesce(n, 0) AS n FROM r LEFT JOIN n USING (ref)""",
    "joi12_selected_nodes": """WITH a AS (SELECT p_partkey::VARCHAR AS selector, p_partkey::VARCHAR AS node, 0::BIGINT AS priority FROM part UNION ALL SELECT p_brand, p_partkey::VARCHAR, 1 FROM part UNION ALL SELECT p_type, p_partkey::VARCHAR, 2 FROM part)
        SELECT selector, node, min(priority) AS priority FROM a GROUP BY selector, node QUALIFY row_number() OVER (PARTITION BY selector ORDER BY min(priority), node) <= 12""",
    "joi13_like_search": "WITH a AS (SELECT p_partkey, lower(p_name || ' ' || p_brand || ' ' || p_type) AS t FROM part), b AS (SELECT p_partkey, (contains(t, 'steel')::INT + contains(t, 'blue')::INT + contains(t, '#3')::INT)::BIGINT AS n_terms FROM a) SELECT * FROM b WHERE n_terms > 0",
    "joi15_enriched": "SELECT doc_id, doc_id % 3 <> 0 AND doc_id % 4 <> 0 AND doc_id % 5 <> 0 AS cached FROM documents",
    "joi17_block_changes": f"""WITH {BLOCKS_SQL}, n AS (SELECT length(body) AS n, body <> reverse(body) AS differs FROM blocks), c AS (
          SELECT 'missing' AS change FROM n WHERE n % 7 = 0 UNION ALL SELECT 'added' FROM n WHERE n % 6 = 1 UNION ALL SELECT 'text' FROM n WHERE n % 7 <> 0 AND n % 5 = 0 AND differs
          UNION ALL SELECT 'order' FROM n WHERE n % 7 <> 0 AND n % 4 = 0 UNION ALL SELECT 'moved' FROM n WHERE n % 7 <> 0 AND n % 3 = 0) SELECT change, count(*) AS n FROM c GROUP BY change""",
    "joi17_cell_changes": f"""WITH {BLOCKS_SQL}, r AS (SELECT doc_id || ':' || pos AS id, unnest(string_split(body, '. ')) AS r, generate_subscripts(string_split(body, '. '), 1) - 1 AS row FROM blocks),
        c AS (SELECT id, row, unnest(string_split(r, ' ')) AS c, generate_subscripts(string_split(r, ' '), 1) AS col FROM r),
        d AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row, col) AS n FROM c WHERE CASE WHEN length(c) % 7 = 0 THEN 'x' ELSE c END <> c)
        SELECT id, count(*) AS n_cells, max(row)::BIGINT AS last_row FROM d WHERE n <= 50 GROUP BY id""",
    "joi20_uncovered": f"""WITH RECURSIVE {_TREE}, s AS (SELECT ancestor AS node, max(chars) + sqrt(sum(chars)) AS score FROM c JOIN t USING (node) GROUP BY ancestor), h AS (SELECT * FROM s WHERE score > 20),
        b AS (SELECT c.ancestor, max(h.score) AS best FROM c JOIN h USING (node) WHERE distance > 0 GROUP BY c.ancestor)
        SELECT node, round(score, 4) AS score FROM h LEFT JOIN b ON node = ancestor WHERE best IS NULL OR best < 0.6e0 * score""",
    "joi21_best_name": "WITH t AS (SELECT string_split(p_name, ' ')[1] AS name, p_partkey FROM part QUALIFY rank() OVER (PARTITION BY string_split(p_name, ' ')[1] ORDER BY p_size DESC) = 1) SELECT name, min(p_partkey) AS target, count(*) > 1 AS ambiguous FROM t GROUP BY name",
    "joi23_cross_references": """WITH r AS (SELECT c_nationkey AS a, s_nationkey AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
        SELECT n_nationkey AS nation, count(*) AS n_relations, sum(n)::BIGINT AS n FROM nation JOIN r ON n_nationkey = a OR n_nationkey = b GROUP BY n_nationkey""",
}
COVERAGE = {
    "joi01_hits_in_documents": ("JOI01",), "joi06_either_key": ("JOI06",), "joi08_projected": ("JOI07", "JOI08", "CTX01"), "joi11_resolution": ("JOI11", "CG04"), "joi12_selected_nodes": ("JOI12",), "joi13_like_search": ("JOI13",), "joi15_enriched": ("JOI15", "CG13"),
    "joi17_block_changes": ("JOI17",), "joi17_cell_changes": ("JOI17",), "joi18_prefix_gold": ("JOI18",), "joi20_uncovered": ("JOI20",), "joi21_best_name": ("JOI21",), "joi23_cross_references": ("JOI23",),
}
