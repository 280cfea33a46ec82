"""Stages that enrich blocks: layout, grouping, links, hierarchy and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def furniture(blocks: DataFrame, band: int) -> DataFrame:
    """Text keys that repeat in the first or last ``band`` places of pages: role by place.

    ``blocks``: doc_id, page, place (from 1), last (places of the page), body. A key repeats on at
    least three pages and a fifth of its document's pages.
    """
    role = F.when(F.col("place") <= band, "header").when(F.col("place") > F.col("last") - band, "footer")
    rows = blocks.withColumn("role", role).where("role is not null and length(body) between 1 and 220")
    pages = blocks.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))
    n = rows.groupBy("doc_id", "role", F.lower("body").alias("key")).agg(F.countDistinct("page").alias("on_pages"))
    return n.join(pages, "doc_id").where("on_pages >= 3 and on_pages >= ceil(0.2 * pages)").select("doc_id", "role", "key", "on_pages")


def islands(rows: DataFrame, key: str, order: str, same: str) -> DataFrame:
    """Adds ``island``: the number of changes of ``same`` up to each row of a key, in order."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.when(F.lag(same).over(w).eqNullSafe(F.col(same)), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def paragraphs(lines: DataFrame) -> DataFrame:
    """Merges lines (doc_id, page, pos, x0, y0, x1, y1, body) that stand close below one another.

    A line goes on with the one above if the gap is between -2 and max(1.8 median heights, 18), they
    overlap in x by 0.45 of the narrower, and the one above is no sentence's end at a short line.
    """
    page = Window.partitionBy("doc_id", "page")
    w = page.orderBy("pos")
    height = F.percentile(F.col("y1") - F.col("y0"), F.lit(0.5)).over(page)
    gap = F.col("y0") - F.lag("y1").over(w)
    overlap = F.least("x1", F.lag("x1").over(w)) - F.greatest("x0", F.lag("x0").over(w))
    narrow = F.least(F.col("x1") - F.col("x0"), F.lag(F.col("x1") - F.col("x0")).over(w))
    joins = (gap >= -2) & (gap <= F.greatest(1.8 * height, F.lit(18.0))) & (overlap >= 0.45 * narrow)
    rows = lines.withColumn("_new", F.when(joins, 0).otherwise(1)).withColumn("para", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = rows.groupBy("doc_id", "page", "para").agg(
        F.count("*").alias("n_lines"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "body"))), lambda r: r["body"]), " ").alias("body"),
    )
    return g


def heading_parents(rows: DataFrame) -> DataFrame:
    """doc_id, pos, parent_pos: for each heading the last earlier one of a lower level, for other blocks the last heading.

    ``rows``: doc_id, pos, level (0: no heading). Six running maxima instead of a stack.
    """
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.max(F.when(F.col("level") == k, F.col("pos"))).over(before) for k in range(1, 7)}
    w = rows.select("doc_id", "pos", "level", *[c.alias(f"h{k}") for k, c in last.items()])
    parent = F.lit(None).cast("long")
    for k in range(6, 1, -1):
        parent = F.when(F.col("level") == k, F.greatest(*[F.col(f"h{i}") for i in range(1, k)]) if k > 2 else F.col("h1")).otherwise(parent)
    parent = F.when(F.col("level") == 0, F.greatest(*[F.col(f"h{i}") for i in range(1, 7)])).otherwise(parent)
    return w.select("doc_id", "pos", "level", F.coalesce(parent, F.lit(-1)).cast("long").alias("parent_pos"))


def nearest(captions: DataFrame, figures: DataFrame) -> DataFrame:
    """For each caption the figure on its page with the least Manhattan distance of centres; ties by id."""
    far = F.abs(F.col("c.x") - F.col("f.x")) + F.abs(F.col("c.y") - F.col("f.y"))
    both = captions.alias("c").join(figures.alias("f"), (F.col("c.doc_id") == F.col("f.doc_id")) & (F.col("c.page") == F.col("f.page")))
    g = both.groupBy(F.col("c.doc_id").alias("doc_id"), F.col("c.id").alias("caption")).agg(F.min(F.struct(far.alias("far"), F.col("f.id").alias("id"))).alias("m"))
    return g.select("doc_id", "caption", F.col("m.id").alias("figure"), F.round("m.far", 4).alias("distance"))


def first_match(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Left join to the first of the right rows with the same keys; status RESOLVED or UNRESOLVED."""
    first = right.groupBy(*keys).agg(F.min(order).alias("target"))
    return left.join(first, keys, "left").withColumn("status", F.when(F.col("target").isNull(), "UNRESOLVED").otherwise("RESOLVED"))


def chunks(blocks: DataFrame, most: int = 1200) -> DataFrame:
    """doc_id, chunk, n_chars, n_lines: lines packed greedily to ``most`` characters, longer ones cut first.

    A fold over a document's lines, all in the JVM; the state is a number of chunk and its length.
    """
    cut = F.transform(F.sequence(F.lit(0), F.expr(f"(length(body) - 1) div {most}")), lambda i: F.substring("body", i * most + 1, F.lit(most)))
    parts = blocks.select("doc_id", "pos", F.posexplode(cut).alias("k", "part"))
    own = parts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "k", F.length("part").alias("n")))).alias("x"))
    start = F.struct(F.lit(0).alias("c"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("at"))

    def step(s, r):  # noqa: ANN001, ANN202
        fits = (s["used"] == 0) | (s["used"] + 1 + r["n"] <= most)
        c = F.when(fits, s["c"]).otherwise(s["c"] + 1)
        used = F.when(s["used"] == 0, r["n"]).when(fits, s["used"] + 1 + r["n"]).otherwise(r["n"])
        return F.struct(c.alias("c"), used.alias("used"), F.concat(s["at"], F.array(c)).alias("at"))

    placed = own.select("doc_id", "x", F.aggregate("x", start, step)["at"].alias("at"))
    rows = placed.select("doc_id", F.explode(F.arrays_zip("x", "at")).alias("z")).select("doc_id", F.col("z.x.n").alias("n"), F.col("z.at").alias("chunk"))
    return rows.groupBy("doc_id", "chunk").agg((F.sum("n") + F.count("*") - 1).alias("n_chars"), F.count("*").alias("n_lines"))


def markdown_table(rows: str) -> F.Column:
    """A table (array of arrays of cells) as Markdown: ragged rows padded, pipes escaped, first row on top."""
    wide = F.array_max(F.transform(rows, lambda r: F.size(r)))
    cell = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.concat(r, F.array_repeat(F.lit(""), wide - F.size(r))), cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), wide), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1)))), "\n")
