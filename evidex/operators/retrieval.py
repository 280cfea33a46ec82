"""Collection search, roll-up, de-duplication, windows and budgets over hits."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import stored
from .documents import of_each


def unit_hits(blocks: DataFrame, units: Sequence[str]) -> DataFrame:
    """Blocks with at least one unit (term or phrase): matched units, hits in all and first places."""
    low = F.lower("body")
    count = lambda u: ((F.length(low) - F.length(F.replace(low, F.lit(u), F.lit("")))) / len(u)).cast("long")
    found = blocks.withColumn("h", F.array(*map(count, units))).withColumn("p", F.array(*[F.locate(u, low) for u in units]))
    return (
        found.withColumn("matched", F.size(F.filter("h", lambda x: x > 0)).cast("long"))
        .where("matched > 0")
        .withColumn("hits", F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + x))
        .withColumn("span", F.array_max(F.filter("p", lambda x: x > 0)) - F.array_min(F.filter("p", lambda x: x > 0)))
    )


def all_or_any(hits: DataFrame, n_units: int) -> DataFrame:
    """Hits of all units; if no block has them all, hits of any. One plan: the flag is a row."""
    flag = hits.agg(F.max(F.col("matched") == n_units).alias("whole"))
    rows = hits.crossJoin(F.broadcast(flag)).where((F.col("matched") == n_units) | ~F.col("whole"))
    return rows.withColumn("match_mode", F.when(F.col("whole"), "all_terms").otherwise("any_term")).drop("whole")


def scored(hits: DataFrame, n_units: int) -> DataFrame:
    """Coverage, proximity and a score: hits saturate, near units count more."""
    proximity = F.when(F.col("matched") == 1, 1.0).otherwise(1 / (1 + F.col("span") / 80))
    score = (F.col("hits") / (F.col("hits") + 1.2)) * (0.65 + 0.35 * F.col("matched") / n_units) * (0.85 + 0.15 * proximity)
    return hits.withColumn("score", F.round(score, 6))


def first_of_each(rows: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The first row, in order, of each value of ``key``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def rollup(hits: DataFrame, most: int = 3) -> DataFrame:
    """doc_id, hit_count (of all hits), best_score, top_pos and the places of the best blocks."""
    best = F.struct((-F.col("score")).alias("s"), F.col("pos").alias("p"))
    own = Window.partitionBy("doc_id").orderBy(F.desc("score"), "pos")
    ranked = hits.withColumn("_n", F.row_number().over(own))
    return ranked.groupBy("doc_id").agg(
        F.count("*").alias("hit_count"), F.max("score").alias("best_score"), F.min(best)["p"].cast("long").alias("top_pos"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_n") <= most, F.struct("_n", "pos")))), lambda x: x["pos"].cast("string")), ",").alias("top_blocks"),
    )


def page(rows: DataFrame, offset: int, limit: int, *order: Column | str) -> DataFrame:
    """A page of rows in order and whether more follow; limits are held to 1..100."""
    limit, offset = min(100, max(1, limit)), max(0, offset)
    some = rows.orderBy(*order).offset(offset).limit(limit + 1)
    n = Window.partitionBy(F.lit(0))  # at most limit + 1 rows
    numbered = some.withColumn("_i", F.row_number().over(n.orderBy(*order))).withColumn("has_more", F.count("*").over(n) > limit)
    return numbered.where(F.col("_i") <= limit).drop("_i")


def fitting(rows: DataFrame, cost: str, budget: int, key: str, *order: Column | str) -> DataFrame:
    """The longest beginning of each key's rows, in order, whose cost fits the budget."""
    run = F.sum(cost).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("spent", run).where(F.col("spent") <= budget)


def first_fit(rows: DataFrame, key: str, budget: int, schema: str) -> DataFrame:
    """Mandatory rows first, then by score; a row that does not fit is left out and the next one tried.

    Columns ``key``, id, cost, score, mandatory; ties go to the smaller id. The result has ``status`` besides: 'kept', or 'over_budget' for a
    mandatory row that does not fit. A task holds the rows of one key.
    """
    columns = [f.name for f in StructType.fromDDL(schema) if f.name != key]

    def found(own: list[list]):  # noqa: ANN202
        of = dict(zip(columns, own, strict=True))
        left, out = budget, []
        for i in sorted(range(len(own[0])), key=lambda i: (not of["mandatory"][i], of["score"][i] is None, -(of["score"][i] or 0.0), of["id"][i])):
            fits = of["cost"][i] <= left
            left -= of["cost"][i] if fits else 0
            if fits or of["mandatory"][i]:
                out.append((*(c[i] for c in own), "kept" if fits else "over_budget"))
        if out:
            yield tuple(zip(*out, strict=True))

    rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])
    kinds = dict(rows.dtypes)
    return of_each(rows.select(key, *columns), [key], found, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", status string").select(*kinds, "status")


# Share of relevance against repetition, least factor of a fit to the intent, power of the cost.
RELEVANCE, LEAST_INTENT, COST_POWER = 0.75, 0.25, 0.15


def mmr(rows: DataFrame, key: str, budget: int, schema: str) -> DataFrame:
    """Maximal marginal relevance under a token cap: id, score, cost, simhash (long, 64 bits), and, if there, coverage and intent (factors) a row.

    The next row is, of those that still fit, the one of the highest utility; ties go to the higher score, then the smaller id.
    A group is the hits of one ``key``; likeness to what is chosen is kept as one number a row.
    """

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        cost, marks = np.maximum(df["cost"].to_numpy(float), 1), df["simhash"].to_numpy(np.int64).view(np.uint64)
        relevant = df["score"].to_numpy(float) / (df["score"].max() or 1.0)
        given = lambda c: df[c].to_numpy(float) if c in df else np.ones(len(df))
        factor = given("coverage") * np.maximum(LEAST_INTENT, given("intent")) / (1 + cost) ** COST_POWER
        near, free, spent, chosen = np.zeros(len(df)), np.ones(len(df), bool), 0.0, []
        while (fits := free & (spent + cost <= budget)).any():
            utility = np.where(fits, (RELEVANCE * relevant - (1 - RELEVANCE) * near) * factor, -np.inf)
            best = int(utility.argmax())  # rows are in order of ties
            chosen.append(best)
            free[best] = False
            spent += cost[best]
            near = np.maximum(near, 1 - np.bitwise_count(marks ^ marks[best]) / 64)
        out = df.iloc[chosen].copy()
        out["place"] = range(1, len(out) + 1)
        return out

    return rows.groupBy(key).applyInPandas(run, schema)


def near_pairs(rows: DataFrame, bits: int = 32, most: int = 3, within: Sequence[str] = (), agree: Column | None = None) -> DataFrame:
    """a, b (a < b) of ids whose ``simhash`` differ in at most ``most`` bits: an equal band of most + 1, then the count.

    Pairs are looked for among rows with the same ``within`` (columns); ``agree`` is what else must hold of a pair, as a
    condition on columns of ``rows`` with a_ and b_ before their names.
    """
    width = bits // (most + 1)
    band = lambda i: F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("simhash", i * width).bitwiseAND(F.lit((1 << width) - 1)).alias("v"))
    keys = [*within, "band", "v"]
    banded = rows.select("*", F.explode(F.array(*map(band, range(most + 1)))).alias("x")).select(*rows.columns, "x.band", "x.v")
    side = lambda n: banded.select(*[F.col(c).alias(c if c in keys else f"{n}_{c}") for c in banded.columns])
    pairs = side("a").join(side("b"), keys).where("a_id < b_id")
    near = pairs.where(F.bit_count(F.col("a_simhash").bitwiseXOR(F.col("b_simhash"))) <= most)
    near = near if agree is None else near.where(agree)
    return near.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()


# Width of feature vectors, weight of a number, least similarity of a neighbour.
DIMENSIONS, NUMBER, NEAREST = 192, 4, 0.08
_TOKENS = re.compile(r"[a-z0-9_+\-]+|[\u4e00-\u9fff]+")


#: Tokens whose features a worker keeps at most.
KEPT_TOKENS = 200_000
_kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _features(token: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and signed counts of a token's features; a text's vector is the sum over its tokens."""
    if (known := _kept.get(token)) is not None:
        return known
    features: Counter[str] = Counter({f"w:{token}": 1})
    if token.isdigit():
        features[f"n:{token}"] += NUMBER
    letters = token.replace("_", "").replace("-", "")
    size = 2 if letters and all("\u4e00" <= c <= "\u9fff" for c in letters) else 3
    if size == 2 or len(letters) >= 4:
        features.update(f"c{size}:{letters[i : i + size]}" for i in range(len(letters) - size + 1))
    digests = [hashlib.blake2b(name.encode(), digest_size=8).digest() for name in features]
    own = np.array([int.from_bytes(h[:4], "little") % DIMENSIONS for h in digests], np.int16), np.array([n if h[4] & 1 else -n for h, n in zip(digests, features.values(), strict=True)], float)
    if len(_kept) >= KEPT_TOKENS:
        _kept.clear()
    if len(token) <= 64:
        _kept[token] = own
    return own


def feature_vector(text: str) -> np.ndarray:
    """A vector of length one (or zero) from hashed features: words, numbers, pairs of Han characters, threes of Latin letters."""
    tokens = Counter(_TOKENS.findall(text.casefold()))
    if not tokens:
        return np.zeros(DIMENSIONS)
    own = [_features(t) for t in tokens]
    times = np.repeat(np.fromiter(tokens.values(), float, len(tokens)), [len(at) for at, _ in own])
    out = np.bincount(np.concatenate([at for at, _ in own]), np.concatenate([n for _, n in own]) * times, DIMENSIONS)
    size = np.sqrt((out * out).sum())
    return out / size if size else out


def feature_vectors(text: Column) -> Column:
    """feature_vector() of a column, array<double>; null: zero."""

    @F.pandas_udf("array<double>")
    def run(t: pd.Series) -> pd.Series:
        return t.fillna("").map(lambda x: feature_vector(x).tolist())

    return run(text)


#: Rows of a block: so many queries are compared with so many rows at once, a part of these at a time; blocks of a task's rows.
QUERIES_AT_ONCE, ROWS_AT_ONCE, BLOCKS = 4096, 1024, 16


def _blocks_of(vectors: DataFrame, parts: int, rows: int) -> DataFrame:
    """ids and vectors (of length one) of blocks of rows, stored in so many partitions."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vs, n = [], [], 0

        def block() -> pa.RecordBatch:
            v = np.concatenate(vs)
            v /= np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-300)
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], names=["ids", "vectors"])

        for b in batches:
            for at in range(0, len(b), rows):
                some = b.slice(at, rows)
                if n and n + len(some) > rows:
                    yield block()
                    ids, vs, n = [], [], 0
                ids.append(some.column(0).to_numpy().astype(np.int64))
                vs.append(np.array(some.column(1).flatten(), float).reshape(len(some), -1))
                n += len(some)
        if n:
            yield block()

    return stored(vectors.where("v is not null").select(F.col("id").cast("long").alias("id"), "v").mapInArrow(pack, "ids binary, vectors binary").repartition(parts))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, least: float = -1.0) -> DataFrame:
    """query_id, id, similarity, rank: for each of a stated set of ``queries`` (id, v) the k nearest of all ``vectors`` (id, v) by cosine.

    Both are stored once as blocks of QUERIES_AT_ONCE; every block of queries meets every block of vectors, in tasks of BLOCKS of the latter, and
    a task shuffles the k best of its rows for a query only. A worker holds two blocks and a part of their products, however many rows there
    are; the work is the product of the two numbers. A row is no neighbour of itself; ``least`` is the least similarity.
    """
    at_once, cores = QUERIES_AT_ONCE, vectors.sparkSession.sparkContext.defaultParallelism
    right = max(1, -(-vectors.count() // (at_once * BLOCKS)))
    rows = _blocks_of(vectors, right, at_once)
    left = max(-(-queries.count() // (at_once * 4)), -(-4 * cores // right))
    asked = rows.repartition(left) if queries is vectors else _blocks_of(queries, left, max(1, min(at_once, -(-queries.count() // left))))

    def better(q: np.ndarray, s: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, ...]:
        """The k best of each query."""
        order = np.lexsort((of, -s, q))
        q, s, of = q[order], s[order], of[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[keep], s[keep], of[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def out() -> pa.RecordBatch:
            on = s >= max(least, -1.5)
            return pa.RecordBatch.from_arrays([pa.array(ids[q[on]]), pa.array(of[on]), pa.array(s[on])], names=["query_id", "id", "similarity"])

        for b in batches:
            for i in range(len(b)):
                qi, qv, ri, rv = (c[i].as_py() for c in b.columns)
                if qi != held:
                    if held is not None:
                        yield out()
                    held, ids = qi, np.frombuffer(qi, np.int64)
                    wide = np.frombuffer(qv, float).reshape(len(ids), -1)
                    short = wide.astype(np.float32)
                    q, s, of = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
                    floor, first = np.full(len(ids), float(least)), True
                    margin = 2e-6 + 1.2e-7 * wide.shape[1]  # more than what 32-bit products differ from rounded exact ones
                every, vectors_ = np.frombuffer(ri, np.int64), np.frombuffer(rv, float)
                vectors_ = vectors_.reshape(len(every), -1)
                for at in range(0, len(every), ROWS_AT_ONCE):
                    own, v = every[at : at + ROWS_AT_ONCE], vectors_[at : at + ROWS_AT_ONCE]
                    near = short @ v.T.astype(np.float32)
                    if first:  # at most one of these is the query itself, where ids differ
                        floor_ = np.partition(near, max(0, len(own) - k - 1), 1)[:, max(0, len(own) - k - 1)] - margin if len(own) > k and len(np.unique(own)) == len(own) else floor
                        bound, first = np.maximum(floor, floor_), False
                    else:
                        bound = floor
                    x, y = np.nonzero(near >= (bound - margin)[:, None].astype(np.float32))
                    on = ids[x] != own[y]
                    x, y = x[on], y[on]
                    exact = np.concatenate([np.zeros(0), *(np.round(np.einsum("ij,ij->i", wide[x[j : j + 16_384]], v[y[j : j + 16_384]]), 6) for j in range(0, len(x), 16_384))])
                    q, s, of = better(np.concatenate((q, x)), np.concatenate((s, exact)), np.concatenate((of, own[y])))
                    full = np.flatnonzero(np.bincount(q, minlength=len(ids)) >= k)
                    floor[full] = np.maximum(floor[full], s[np.searchsorted(q, full, side="right") - 1])
        if held is not None:
            yield out()

    pairs = asked.select(F.col("ids").alias("a"), F.col("vectors").alias("b")).hint("shuffle_replicate_nl").crossJoin(rows)
    found = pairs.mapInArrow(run, "query_id long, id long, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def overlapping(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs of intervals [start, end) of a key that overlap: joined on bins of ``width``, each pair kept in the first common bin."""
    bins = lambda d, s: d.select(F.col(key), *[F.col(c).alias(f"{s}_{c}") for c in d.columns if c != key], F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(end - 1) div {width}"))).alias("bin"))
    both = bins(left, "l").join(bins(right, "r"), [key, "bin"])
    return both.where((F.col("l_start") < F.col("r_end")) & (F.col("l_end") > F.col("r_start"))).where(F.col("bin") == F.expr(f"greatest(l_start, r_start) div {width}")).drop("bin")
