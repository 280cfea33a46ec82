"""Joins that resolve names, endpoints and gold texts, and that hold two versions against one another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .documents import of_each


def either(left: DataFrame, right: DataFrame, on: str, keys: list[str], columns: list[str]) -> DataFrame:
    """Left rows that meet right rows by any of several keys: a union of equi-joins, each pair once."""
    parts = [left.join(right.select(F.col(k).alias(on), *columns), on) for k in keys]
    return reduce(DataFrame.union, parts).distinct()


def projected(relations: DataFrame, blocks: DataFrame) -> DataFrame:
    """source, target, type of relations (source, target, type) between source blocks, as relations of the blocks that hold them.

    ``blocks``: block, sources (array); of several blocks with a source the smallest holds it. Endpoints that no block
    holds stay as they are, loops go.
    """
    owner = blocks.select("block", F.explode("sources").alias("s")).groupBy("s").agg(F.min("block").alias("owner"))
    a, b = owner.select(F.col("s").alias("source"), F.col("owner").alias("o1")), owner.select(F.col("s").alias("target"), F.col("owner").alias("o2"))
    both = relations.join(a, "source", "left").join(b, "target", "left")
    out = both.select(F.coalesce("o1", "source").alias("source"), F.coalesce("o2", "target").alias("target"), "type")
    return out.where("source <> target").distinct()


def cascade(names: DataFrame, *candidates: DataFrame) -> DataFrame:
    """ref, target, status, n of references by the first candidate table that knows them.

    ``names``: ref; ``candidates``: ref, target, most trusted first. One target of the best table: RESOLVED; up to
    eight: POSSIBLE, the smallest of them; more or none: UNRESOLVED.
    """
    rows = reduce(DataFrame.union, [c.select("ref", "target", F.lit(i).alias("priority")) for i, c in enumerate(candidates)])
    best = rows.join(names.select("ref").distinct(), "ref", "left_semi").withColumn("r", F.rank().over(Window.partitionBy("ref").orderBy("priority"))).where("r = 1")
    n = best.groupBy("ref").agg(F.countDistinct("target").alias("n"), F.min("target").alias("target"))
    status = F.when(F.col("n") == 1, "RESOLVED").when(F.col("n") <= 8, "POSSIBLE").otherwise("UNRESOLVED")
    return names.select("ref").distinct().join(n, "ref", "left").select("ref", F.when(F.col("n") <= 8, F.col("target")).alias("target"), status.alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


#: Targets of a name alone from which it is left unresolved.
POSSIBLE = 8


def code_references(rows: DataFrame, bound: DataFrame) -> DataFrame:
    """path, owner, kind, name, line, target, status, n of the calls, bases and decorators in code rows.

    ``rows``: path, row, kind, name, owner, line (nodes and occurrences); ``bound``: path, kind, scope, name, target (what names stand
    for). A name is, in turn: what an import or a known type of its first part makes of it, a method of the own class or, one
    step up, of its bases, a symbol of the module; the first of these that is a node is it (RESOLVED). What an
    import brings from outside is EXTERNAL. Else nodes with the same last name are POSSIBLE, up to eight, of which ``target`` is the
    smallest. Each way is an equi-join.
    """
    nodes = rows.where("row = 'node'").select(F.col("name").alias("target"), "kind", "path").distinct()
    module = nodes.where("kind = 'module'").select("path", F.col("target").alias("module"))
    rest = lambda c: F.regexp_extract(c, r"^[^.]+\.(.+)$", 1)
    first = lambda c: F.regexp_extract(c, r"^[^.]+", 0)
    after = lambda base, tail: F.when(tail == "", base).otherwise(F.concat(base, F.lit("."), tail))
    refs = rows.where("row = 'occurrence' and kind in ('call', 'base', 'decorator') and name <> ''").select("path", "owner", "kind", "name", "line").distinct()
    refs = refs.join(module, "path").withColumn("first", first("name")).withColumn("rest", rest("name")).withColumn("above", F.regexp_replace("owner", r"\.[^.]+$", ""))
    alias = bound.where("kind = 'alias'").select("path", F.col("name").alias("first"), F.col("target").alias("meant"))
    # A written type or base is what an import makes of it, or a symbol of its module.
    meant = bound.where("kind <> 'alias'").withColumn("first", first("target")).withColumn("tail", rest("target")).join(alias, ["path", "first"], "left").join(module, "path")
    meant = meant.select("kind", "scope", "name", F.when(F.col("meant").isNotNull(), after(F.col("meant"), F.col("tail"))).otherwise(F.concat_ws(".", "module", "target")).alias("type"))
    types = meant.where("kind = 'type'").select("scope", F.col("name").alias("var"), "type")
    bases = meant.where("kind = 'base'").select(F.col("scope").alias("above"), "type")
    own = refs.where("first = 'self' and rest <> ''")
    keys = ["path", "owner", "kind", "name", "line"]
    ways = [
        refs.join(alias, ["path", "first"]).select(*keys, after(F.col("meant"), F.col("rest")).alias("target"), F.lit(0).alias("way")),
        refs.where("rest <> ''").join(types, (F.col("owner") == F.col("scope")) & (F.col("first") == F.col("var"))).select(*keys, F.concat_ws(".", "type", "rest").alias("target"), F.lit(0).alias("way")),
        own.join(types, (F.col("above") == F.col("scope")) & (first("rest") == F.col("var"))).where(rest("rest") != "").select(*keys, F.concat_ws(".", "type", rest("rest")).alias("target"), F.lit(0).alias("way")),
        own.select(*keys, F.concat_ws(".", "above", "rest").alias("target"), F.lit(1).alias("way")),
        own.join(bases, "above").select(*keys, F.concat_ws(".", "type", "rest").alias("target"), F.lit(2).alias("way")),
        refs.select(*keys, F.concat_ws(".", "module", "name").alias("target"), F.lit(3).alias("way")),
    ]
    last = lambda c: F.regexp_extract(c, r"[^.]+$", 0)
    alike = nodes.where("kind <> 'module'").select(last("target").alias("last"), "target").distinct()
    by_name = refs.withColumn("last", last("name")).join(alike, "last").select(*keys, "target", F.lit(4).alias("way"))
    known = reduce(DataFrame.union, ways).join(nodes.select("target").distinct(), "target", "left_semi").select(*keys, "target", "way").union(by_name)
    best = known.withColumn("r", F.rank().over(Window.partitionBy(*keys).orderBy("way"))).where("r = 1").groupBy(*keys).agg(F.min("target").alias("target"), F.min("way").alias("way"), F.countDistinct("target").alias("n"))
    roots = nodes.where("kind = 'module'").select(first("target").alias("root"), F.lit(True).alias("inside")).distinct()
    outside = refs.join(alias, ["path", "first"]).withColumn("root", first("meant")).join(roots, "root", "left").where("inside is null").groupBy(*keys).agg(F.min(after(F.col("meant"), F.col("rest"))).alias("external"))
    out = refs.select(*keys).join(outside, keys, "left").join(best, keys, "left")
    sure = (F.col("way") < 4) & (F.col("n") == 1)
    loose = F.col("n") <= POSSIBLE
    status = F.when(sure, "RESOLVED").when(F.col("external").isNotNull(), "EXTERNAL").when(loose, "POSSIBLE").otherwise("UNRESOLVED")
    target = F.when(sure, F.col("target")).when(F.col("external").isNotNull(), F.col("external")).when(loose, F.col("target"))
    return out.select(*keys, target.alias("target"), status.alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def selected(nodes: DataFrame, selectors: DataFrame, most: int = 12) -> DataFrame:
    """selector, node, priority of the nodes that a selector names: by id, else qualified, else display name; ``most`` each."""
    parts = [selectors.join(nodes, selectors["selector"] == nodes[c]).select("selector", "node", F.lit(p).cast("long").alias("priority")) for p, c in enumerate(("node", "qualified_name", "display_name"))]
    best = reduce(DataFrame.union, parts).groupBy("selector", "node").agg(F.min("priority").alias("priority"))
    return best.withColumn("n", F.row_number().over(Window.partitionBy("selector").orderBy("priority", "node"))).where(F.col("n") <= most).drop("n")


def block_changes(old: DataFrame, new: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """id and change (added, missing, text, order, moved) of blocks (id, text, place, x, y) of two versions."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.id") == F.col("n.id"), "full_outer")
    there = F.col("o.id").isNotNull() & F.col("n.id").isNotNull()
    far = (F.abs(F.col("o.x") - F.col("n.x")) > tolerance) | (F.abs(F.col("o.y") - F.col("n.y")) > tolerance)
    changes = F.filter(F.array(
        F.when(F.col("o.id").isNull(), "added"), F.when(F.col("n.id").isNull(), "missing"),
        F.when(there & (F.col("o.text") != F.col("n.text")), "text"), F.when(there & (F.col("o.place") != F.col("n.place")), "order"), F.when(there & far, "moved"),
    ), lambda x: x.isNotNull())
    return both.select(F.coalesce("o.id", "n.id").alias("id"), F.explode(changes).alias("change"))


def cell_changes(old: DataFrame, new: DataFrame, most: int = 50) -> DataFrame:
    """id, row, col, old, new of cells of tables (id, rows: array of arrays) that differ; ``most`` of a table, in order."""
    cells = lambda d, name: d.select("id", F.posexplode("rows").alias("row", "r")).select("id", "row", F.posexplode("r").alias("col", name))
    both = cells(old, "old").join(cells(new, "new"), ["id", "row", "col"], "full_outer").where(F.coalesce("old", F.lit("")) != F.coalesce("new", F.lit("")))
    return both.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("row", "col"))).where(F.col("n") <= most).drop("n")


def prefix_matches(gold: DataFrame, blocks: DataFrame, n: int) -> DataFrame:
    """Gold texts matched to blocks that begin with them, the first block not taken yet: doc_id, gold, pos (-1: none).

    ``gold``: doc_id, gold (place), prefix (n characters or more); ``blocks``: doc_id, pos, text. Gold texts and blocks of a document meet in its
    task, by their first n characters; the greedy choice runs over its candidates.
    """

    def found(own: list[list]):  # noqa: ANN202
        heads: dict[str, list[tuple[int, str]]] = {}
        wanted: dict[int, list[str]] = {}
        for g, p, text in zip(*own, strict=True):
            if p is not None:
                heads.setdefault(text[:n], []).append((p, text))
            elif g is not None:
                wanted.setdefault(g, []).append(text)
        taken: set[int] = set()
        out = []
        for g in sorted(wanted):
            free = [p for prefix in wanted[g] if prefix is not None for p, text in heads.get(prefix[:n], ()) if p not in taken and text.startswith(prefix)]
            out.append(min(free, default=-1))
            taken.update(out[-1:] if free else [])
        yield sorted(wanted), out

    none = F.lit(None).cast("long")
    rows = gold.select("doc_id", F.col("gold").cast("long").alias("gold"), none.alias("pos"), F.col("prefix").alias("text"))
    rows = rows.union(blocks.where("doc_id is not null and text is not null and pos is not null").select("doc_id", none, F.col("pos").cast("long"), "text"))
    return of_each(rows, ["doc_id"], found, "gold long, pos long")


def without_covered(hits: DataFrame, closure: DataFrame, share: float = 0.6) -> DataFrame:
    """Hits (node, score) without those above a hit that has ``share`` of their score (closure: ancestor, node, distance)."""
    below = closure.where("distance > 0").join(hits.select("node", F.col("score").alias("s")), "node").groupBy("ancestor").agg(F.max("s").alias("best"))
    rows = hits.join(below, hits["node"] == below["ancestor"], "left")
    return rows.where(F.col("best").isNull() | (F.col("best") < share * F.col("score"))).select(*hits.columns)
