"""General relational coverage over the star schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

Tables = Callable[[str], DataFrame]


def _of(spark: SparkSession, sf_dir: str) -> Tables:
    return lambda name: table(spark, sf_dir, name)


def ext_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"))


def ext_region_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _of(spark, sf_dir)
    o = t("orders").select("o_orderkey", "o_custkey")
    li = t("lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("price"))
    c = t("customer").select("c_custkey", "c_nationkey").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    by_order = li.groupBy("l_orderkey").agg(F.sum("price").alias("price"))
    return by_order.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "r_name", "n_name"), F.col("o_custkey") == F.col("c_custkey")).groupBy("r_name", "n_name").agg(F.round(F.sum("price"), 2).alias("revenue"), F.count("*").alias("n_orders"))


def ext_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    g = p.rollup("p_brand", "p_size").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))
    return g.select(F.coalesce("p_brand", F.lit("all")).alias("p_brand"), F.coalesce("p_size", F.lit(-1)).cast("long").alias("p_size"), "n", "level")


def ext_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return c.select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "n", "total")


def ext_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders")
    return e.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).select("o_orderpriority", *[F.coalesce(c, F.lit(0)).cast("long").alias(f"n_{c.lower()}") for c in ("F", "O", "P")])


def ext_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _of(spark, sf_dir)
    o = t("orders").select(F.col("o_custkey").alias("c_custkey"))
    c = t("customer")
    state = lambda df, s: df.groupBy("c_mktsegment").agg(F.count("*").alias("n")).select("c_mktsegment", F.lit(s).alias("state"), "n")
    return state(c.join(o, "c_custkey", "left_semi"), "ordered").union(state(c.join(o, "c_custkey", "left_anti"), "none"))


def ext_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _of(spark, sf_dir)
    a, b = t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").select(F.col("s_nationkey").alias("k"))
    tag = lambda df, s: df.select(F.col("k").cast("long").alias("k"), F.lit(s).alias("op"))
    return tag(a.intersect(b), "intersect").union(tag(a.subtract(b), "except")).union(tag(a.union(b).distinct(), "union"))


def ext_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_orderpriority").agg(F.round(F.percentile("o_totalprice", F.lit(0.5)), 4).alias("p50"), F.round(F.percentile("o_totalprice", F.lit(0.9)), 4).alias("p90"), F.round(F.stddev("o_totalprice"), 4).alias("sd"))


def ext_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k int")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("sum_k"), F.countDistinct("k").alias("n_k"))


def ext_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users: a gap of over 30 minutes begins a new one."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w)
    e = table(spark, sf_dir, "events").withColumn("s", F.when(gap <= 1_800_000_000, 0).otherwise(1))
    return e.groupBy("user_id").agg(F.sum("s").alias("n_sessions"), F.count("*").alias("n_events"))


QUERIES = {f.__name__: f for f in (ext_cube, ext_json, ext_percentiles, ext_pivot, ext_pricing_summary, ext_region_revenue, ext_rollup, ext_semi_anti, ext_sessions, ext_set_operations)}
ORACLE = {
    "ext_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "ext_region_revenue": """SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS n_orders
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
    "ext_rollup": "SELECT coalesce(p_brand, 'all') AS p_brand, coalesce(p_size, -1)::BIGINT AS p_size, count(*) AS n, grouping_id(p_brand, p_size)::BIGINT AS level FROM part GROUP BY ROLLUP (p_brand, p_size)",
    "ext_cube": "SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "ext_pivot": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1",
    "ext_semi_anti": "SELECT c_mktsegment, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'ordered' ELSE 'none' END AS state, count(*) AS n FROM customer GROUP BY ALL",
    "ext_set_operations": """SELECT k::BIGINT AS k, op FROM (SELECT k, 'intersect' AS op FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)
        UNION ALL SELECT k, 'except' FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'union' FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier))""",
    "ext_percentiles": "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.9), 4) AS p90, round(stddev(o_totalprice), 4) AS sd FROM orders GROUP BY 1",
    "ext_json": "SELECT event_type, sum((props->>'k')::INT)::BIGINT AS sum_k, count(DISTINCT (props->>'k')::INT) AS n_k FROM events GROUP BY 1",
    "ext_sessions": """WITH g AS (SELECT user_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 1800000000 THEN 0 ELSE 1 END AS s FROM events)
        SELECT user_id, sum(s)::BIGINT AS n_sessions, count(*) AS n_events FROM g GROUP BY 1""",
}
COVERAGE = {name: ("EXT",) for name in QUERIES}
