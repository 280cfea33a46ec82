"""Graph queries over who supplies whose parts and over the block tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..session import table
from ..sources.text import blocks
from .search import BLOCKS_SQL

# Suppliers stand for modules: each imports the IMPORTS suppliers that come most often after it in an order, over all rows of lineitem.
IMPORTS = 3
_EDGES = f"""e AS (
  SELECT source, target FROM (
    SELECT source, target, count(*) AS n FROM (
      SELECT l_suppkey AS source, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS target FROM lineitem)
    WHERE target IS NOT NULL AND target <> source GROUP BY source, target)
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, target) <= {IMPORTS})"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    after = F.lead("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    pairs = rows.select(F.col("l_suppkey").alias("source"), after.alias("target")).where("target is not null and target <> source").groupBy("source", "target").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "target"))
    return pairs.withColumn("place", place).where(F.col("place") <= IMPORTS).select("source", "target")


def ctx06_bounded_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return G.bounded_bfs(e, e.select(F.min("source").alias("node")), 2)


def cg10_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is affected, up to five hops against the edges, by a change of the largest supplier key."""
    e = edges(spark, sf_dir)
    back = e.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return G.bounded_bfs(back, e.select(F.max("target").alias("node")), 5)


def cg08_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.fan_metrics(edges(spark, sf_dir))


def cg07_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cycles(edges(spark, sf_dir))


def cg20_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    nodes = e.select("source").union(e.select("target")).distinct()
    return e.agg(F.count("*").alias("n_edges")).crossJoin(nodes.agg(F.count("*").alias("n_nodes")))


def ctx09_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = G.fan_metrics(edges(spark, sf_dir)).withColumn("degree", F.col("fan_in") + F.col("fan_out"))
    return m.orderBy(F.desc("degree"), "node").limit(3).select("node", "degree")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, parent, title, chars of the block tree: root, sources, documents, lines."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    b = blocks(table(spark, sf_dir, "documents"))
    doc = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    root = spark.range(1).select(F.lit("root").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("chars"))
    sections = d.select("source").distinct().select(F.col("source").alias("node"), F.lit("root").alias("parent"), F.lit(0).alias("chars"))
    pages = d.select(doc.alias("node"), F.col("source").alias("parent"), F.lit(0).alias("chars"))
    leaves = b.select(F.concat(doc, F.lit("."), F.col("pos").cast("string")).alias("node"), doc.alias("parent"), F.length("body").alias("chars"))
    return root.union(sections).union(pages).union(leaves)


def tre02_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    c = G.tree_closure(t, 3)
    return c.join(t.select("node", "chars"), "node").groupBy("ancestor").agg(F.count("*").alias("n_nodes"), F.sum("chars").alias("chars"), F.max("distance").alias("height")).where("height >= 1")


def tre03_heading_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = G.tree_closure(tree(spark, sf_dir).where("node not like '%.%'"), 3).where("ancestor <> 'root'")
    g = c.groupBy("node").agg(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("o"), "ancestor"))).alias("x"))
    return g.select("node", F.array_join(F.transform("x", lambda r: r["ancestor"]), " > ").alias("path"))


def tre01_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    n = t.groupBy("parent").agg(F.count("*").alias("children_count"))
    top = t.where("parent = 'root' or node = 'root'").select("node")
    return top.join(n, top["node"] == n["parent"]).select("node", "children_count")


QUERIES = {f.__name__: f for f in (cg07_cycles, cg08_metrics, cg10_impact, cg20_counts, ctx06_bounded_bfs, ctx09_hubs, tre01_outline, tre02_rollup, tre03_heading_path)}
_REACH = """r(node, depth) AS (
  SELECT * FROM (SELECT {pick} AS node, 0::BIGINT AS depth FROM e)
  UNION SELECT {to}, depth + 1 FROM r JOIN e ON {on} = r.node WHERE depth < {hops})"""
_TREE = f"""{BLOCKS_SQL},
t AS (SELECT 'root' AS node, NULL AS parent, 0 AS chars UNION ALL SELECT DISTINCT source, 'root', 0 FROM documents
  UNION ALL SELECT 'd' || doc_id, source, 0 FROM documents UNION ALL SELECT 'd' || doc_id || '.' || pos, 'd' || doc_id, length(body) FROM blocks),
c(ancestor, node, distance) AS (SELECT node, node, 0 FROM t UNION ALL SELECT t.parent, c.node, distance + 1 FROM c JOIN t ON t.node = c.ancestor WHERE t.parent IS NOT NULL)"""
ORACLE = {
    "ctx06_bounded_bfs": f"WITH RECURSIVE {_EDGES}, {_REACH.format(pick='min(source)', to='e.target', on='e.source', hops=2)} SELECT node, min(depth) AS depth FROM r GROUP BY node",
    "cg10_impact": f"WITH RECURSIVE {_EDGES}, {_REACH.format(pick='max(target)', to='e.source', on='e.target', hops=5)} SELECT node, min(depth) AS depth FROM r GROUP BY node",
    "cg08_metrics": f"""WITH {_EDGES}, m AS (SELECT source AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT target, 1, 0 FROM e)
        SELECT node, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out, round(sum(o)::DOUBLE / (sum(i) + sum(o)), 6) AS instability FROM m GROUP BY node""",
    "cg07_cycles": f"""WITH RECURSIVE {_EDGES}, f AS (SELECT * FROM e),
        r(a, b) AS (SELECT source, target FROM f UNION SELECT r.a, f.target FROM r JOIN f ON f.source = r.b)
        SELECT x.a AS node, least(x.a, min(x.b)) AS component, count(*) AS size FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a""",
    "cg20_counts": f"WITH {_EDGES} SELECT (SELECT count(*) FROM e) AS n_edges, (SELECT count(*) FROM (SELECT source FROM e UNION SELECT target FROM e)) AS n_nodes",
    "ctx09_hubs": f"WITH {_EDGES}, m AS (SELECT source AS node FROM e UNION ALL SELECT target FROM e) SELECT node, count(*) AS degree FROM m GROUP BY node ORDER BY degree DESC, node LIMIT 3",
    "tre02_rollup": f"WITH RECURSIVE {_TREE} SELECT ancestor, count(*) AS n_nodes, sum(chars)::BIGINT AS chars, max(distance)::BIGINT AS height FROM c JOIN t USING (node) GROUP BY ancestor HAVING max(distance) >= 1",
    "tre03_heading_path": f"WITH RECURSIVE {_TREE} SELECT node, string_agg(ancestor, ' > ' ORDER BY distance DESC) AS path FROM c WHERE node NOT LIKE '%.%' AND ancestor <> 'root' GROUP BY node",
    "tre01_outline": "SELECT 'root' AS node, count(DISTINCT source) AS children_count FROM documents UNION ALL SELECT source, count(*) FROM documents GROUP BY source",
}
COVERAGE = {
    "ctx06_bounded_bfs": ("CTX06", "JOI14"), "cg10_impact": ("CG10",), "cg08_metrics": ("CG08", "AGG19"), "cg07_cycles": ("CG07",), "cg20_counts": ("AGG20",), "ctx09_hubs": ("CTX09", "SRT05"),
    "tre02_rollup": ("TRE02", "PIP19", "AGG15"), "tre03_heading_path": ("TRE03",), "tre01_outline": ("TRE01",),
}
