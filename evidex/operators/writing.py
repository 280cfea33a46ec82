"""Reflowed text, written formats, routes of a query and what an environment offers."""

from __future__ import annotations

import importlib.util
import sys
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored


def reflowed(lines: DataFrame) -> DataFrame:
    """doc_id, block, run, n_lines, body: lines (doc_id, block, pos, x0, x1, y0, y1, size, body) of a block joined where they were wrapped.

    A line goes on with the one before it if that reaches the right edge and is nearly as wide as the block, ends no
    sentence and has its size, and if this begins at the left edge, no list item, at the usual distance.
    """
    own = Window.partitionBy("doc_id", "block")
    w = own.orderBy("pos")
    left, right = F.min("x0").over(own), F.max("x1").over(own)
    em = F.percentile("size", F.lit(0.5)).over(own)
    rows = lines.withColumn("bx0", left).withColumn("bx1", right).withColumn("em", em)
    before = lambda c: F.lag(c).over(w)
    width, gap = F.col("bx1") - F.col("bx0"), F.col("y0") - before("y1")
    wide = (before("x1") >= F.col("bx1") - F.greatest(F.col("em"), 0.05 * width)) & (before(F.col("x1") - F.col("x0")) >= 0.85 * width)
    on = wide & ~F.rtrim(before("body")).rlike(r"[.!?。！？]$") & (before("size") == F.col("size")) & (F.abs(F.col("x0") - F.col("bx0")) <= 0.5 * F.col("em")) & (gap >= -0.2 * F.col("em")) & (gap <= 0.8 * F.col("em")) & ~F.col("body").rlike(r"^(?:[-*•]|[0-9]+[.)])\s")
    rows = rows.withColumn("_new", F.when(on, 0).otherwise(1)).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"]), " ")
    return rows.groupBy("doc_id", "block", "run").agg(F.count("*").alias("n_lines"), text.alias("body"))


def written(df: DataFrame) -> DataFrame:
    """format, n, ok of a frame written as JSON lines, CSV, text and Parquet and read again.

    Spark's committer makes a write visible as a whole; the folder is the session's checkpoint folder.
    """
    spark = df.sparkSession
    df = stored(df)
    root = f"{spark.sparkContext.getCheckpointDir()}/sink-{uuid.uuid4()}"
    # All values are quoted, white space at their ends stays, and null is a word that no text can hold, as an empty text is one, too.
    csv = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": "", "nullValue": f"null-{uuid.uuid4()}"}
    df.write.json(f"{root}/json")
    df.write.options(quoteAll=True, lineSep="\n", **csv).csv(f"{root}/csv")
    df.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{root}/text")
    df.write.parquet(f"{root}/parquet")
    back = {
        "json": spark.read.schema(df.schema).json(f"{root}/json"),
        "csv": spark.read.schema(df.schema).options(multiLine=True, **csv).csv(f"{root}/csv"),
        "text": spark.read.text(f"{root}/text").select(F.from_json("value", df.schema).alias("r")).select("r.*"),
        "parquet": spark.read.parquet(f"{root}/parquet"),
    }
    digest = lambda d: d.select(F.xxhash64(*d.columns).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.sum("h").alias("h"))
    want, out = digest(df).select(F.col("h").alias("want")), None
    for name, d in back.items():
        row = digest(d).crossJoin(F.broadcast(want)).select(F.lit(name).alias("format"), "n", F.col("h").eqNullSafe(F.col("want")).alias("ok"))  # one row each
        out = row if out is None else out.union(row)
    return out


def route(query: Column, matched: Column, n_terms: Column, fresh: Column) -> tuple[Column, Column, Column]:
    """Intent, precision and route of a query; a graph that is not up to date is not walked."""
    low = F.lower(query)
    intent = F.when(low.contains("overview"), "overview").when(low.contains("impact"), "impact").otherwise("lookup")
    precision = F.when(matched == 0, "no-match").when((n_terms >= 3) & (matched <= 1), "low-precision").otherwise("pass")
    wants = F.when(intent == "overview", "overview").when((intent == "impact") | low.rlike("depend|impact|relation"), "graph-first").otherwise("lexical-first")
    walks = fresh & ((wants != "lexical-first") | (precision != "pass"))
    return intent, precision, F.when(walks, F.when(wants == "lexical-first", "graph-fallback").otherwise(wants)).otherwise("lexical-only")


def doctor(spark: SparkSession) -> DataFrame:
    """check, required, ok: what the engine needs and what it can use."""
    has = lambda m: importlib.util.find_spec(m) is not None
    rows = [("python", True, sys.version_info >= (3, 10)), ("pyspark", True, has("pyspark")), ("pyarrow", True, has("pyarrow")), ("pandas", True, has("pandas")), ("numpy", True, has("numpy")), ("adaptive", True, spark.conf.get("spark.sql.adaptive.enabled") == "true"), ("utc", True, spark.conf.get("spark.sql.session.timeZone") == "UTC")]
    return spark.createDataFrame(rows, "check string, required boolean, ok boolean")


PROVIDERS = {"ngram": True, "lexicon": False}


def keyword_provider(requested: str) -> tuple[str, str | None]:
    """The provider that is used and why it is not the one asked for."""
    if requested not in PROVIDERS:
        raise ValueError(f"no keyword provider: {requested}")
    return (requested, None) if PROVIDERS[requested] else ("ngram", f"{requested}: model files are not there")
