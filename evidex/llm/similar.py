"""Similarity join of texts by their sets of word runs, exact at the threshold (near-dedup of the pipeline).

SimHash comes first, as in operator 4: fingerprints of 64 bits, linked at a radius of 4 by vantage-point trees. That finds
the nearest copies, and little beyond: at a similarity of 0.8 fingerprints differ in ten bits of 64 on average, and no
longer SimHash tells 0.8 surely. A text whose runs repeat can also have another's fingerprint and resemble it little.
So SimHash's links are candidates, which are verified like all others, and a join of the sets of runs of five words finds
what is beyond its radius. Two sets that resemble by 0.8 share a run among the first fifth of either's, in any order that is the same for
all sets, so the shards of these runs lose no pair at any size of the corpus. Runs that are frequent in a
sample of the texts come last in the order: which pairs meet depends on it, never which are linked. What meets
is thinned by bounds on size, place and bitmaps that refuse no true pair, and each link is verified on the two sets.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark as S
from . import _words as W
from . import simhash
from .components import components

#: Words of a run; bits of a bitmap at least (it has as many as its set has members, or up to twice as many).
RUN, BITS = 5, 512
#: One text of so many is looked at for frequent runs; frequent runs that are remembered at most (9 bytes each).
EVERY, FREQUENT = 16, 1 << 19
#: Members from which a shard is dealt out in cells of pairs of parts; members that a task holds at most to count them.
MEMBERS, HELD = 1024, 1 << 16
#: Parts in which the sets of a frequent run are dealt out, each by itself.
SALTS = 64
#: Ids that are broadcast at most (8 bytes each); more of them are joined.
LARGE = 200_000
#: Set names that a task remembers, so as not to give out copies again.
SEEN = 1 << 18
#: Rows of numbers in an Arrow batch.
ROWS = 16_384

EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def least_whole(n, similarity: float):  # noqa: ANN001, ANN201
    """The smallest whole number that is at least ``similarity`` of n."""
    return np.ceil(np.asarray(n) * similarity - 1e-9).astype(np.int64)


def run_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """Each text's distinct hashes of its runs of RUN words, sorted; a text of fewer words has one, one of none has none."""
    for i, j in S.chunks(texts, 1 << 19):
        h, off = W.shingles(*W.many([t.encode() for t in texts[i:j]]), RUN)
        for a, b in itertools.pairwise(off.tolist()):
            yield np.unique(h[a:b])


def signed(x: int) -> int:
    """The signed long of the same bits."""
    return x - (1 << 64) if x >> 63 else x


def name_of(h: np.ndarray) -> int:
    """A set's name: the hash of its sorted members, as a signed long."""
    return signed(xxhash.xxh64_intdigest(h.tobytes(), 42))


def prefix(h: np.ndarray, similarity: float, keys: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, int]:
    """The first members of a set, of which two sets that resemble by ``similarity`` share one at least, and how many are not frequent.

    They share ceil(similarity n) of either's n members, so the first they share is not among the last ceil(similarity n) - 1
    of either. The order is that of the hashes; those in ``keys`` (sorted) come after all others, by their ``ranks``.
    """
    if not len(h):
        return h, 0
    size, plain = len(h) - int(least_whole(len(h), similarity)) + 1, len(h)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        there = keys[at] == h
        if there.any():
            late = h[there]
            h = np.concatenate((h[~there], late[np.argsort(ranks[at[there]], kind="stable")]))
            plain = len(h) - len(late)
    return h[:size], min(size, plain)


def bitmap(h: np.ndarray, bits: int = 0) -> np.ndarray:
    """Longs; a bit tells whether an odd number of members fall on it, so two sets differ in as many members at least as their bitmaps in bits."""
    bits = bits or max(BITS, 1 << (len(h) - 1).bit_length() if len(h) else 0)
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").view(np.uint64)


def folded(x: np.ndarray, longs: int) -> np.ndarray:
    """The bitmap of the same set in fewer longs."""
    while len(x) > longs:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def most_different(n, similarity: float):  # noqa: ANN001, ANN201
    """In how many members two sets of n members together may differ."""
    return n - 2 * least_whole(n, similarity / (1 + similarity))


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Runs that two or more texts of a sample have, sorted, and a rank for each: the logarithm of how many.

    The sample is one text of EVERY by its hash, copies once. At most FREQUENT runs come to the driver, the most
    frequent ones.
    """
    some = S.id_text(docs).where("doc_id is not null").withColumn("t", F.xxhash64("text")).where(F.pmod("t", F.lit(EVERY)) == 0).dropDuplicates(["t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h in run_sets(b.column(0).to_pylist()):
                for at in range(0, len(h), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(h[at : at + (1 << 16)].view(np.int64))], names=["key"])

    rows = some.select("text").mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    rows = S.stored(rows.select("key", F.floor(F.log2(F.col("m") * F.col("m"))).cast("byte").alias("r")))
    many, least = dict(rows.groupBy("r").count().collect()), 127
    while least > 2 and sum(n for r, n in many.items() if r >= least - 1) <= FREQUENT:
        least -= 1
    found = rows.where(F.col("r") >= least).limit(FREQUENT).toArrow()
    keys, ranks = found.column("key").to_numpy().view(np.uint64), found.column("r").to_numpy()
    order = np.argsort(keys)
    return keys[order], ranks[order]


def _marks(docs: DataFrame, similarity: float) -> DataFrame:
    """doc_id, t (hash of the text), s (name of the set of runs), n (its size), its bitmap, whole and folded, its prefix and the text's SimHash
    f (both null where the id is, or the task has given the set out) and how many of the prefix are plain, of every row."""
    context = docs.sparkSession.sparkContext
    often = context.broadcast(frequent(docs))
    longs = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("s", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("fold", pa.binary()), ("prefix", longs), ("plain", pa.int32()), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks = often.value
        seen: set[int] = set()
        for b in batches:
            ids, texts, hashes = b.column(0), b.column(1).to_pylist(), b.column(2)
            named = ids.is_valid().to_pylist()
            for i, j in S.chunks(texts, 1 << 19):
                out = []
                for text, has_id, h in zip(texts[i:j], named[i:j], run_sets(texts[i:j]), strict=True):
                    name, bits = name_of(h), bitmap(h)
                    first = has_id and name not in seen
                    if first and len(seen) < SEEN:
                        seen.add(name)
                    own, plain = prefix(h, similarity, keys, ranks) if first else (None, 0)
                    f = signed(simhash.fingerprint(text)) if first else None
                    out.append((name, len(h), bits.tobytes(), folded(bits, BITS // 64).tobytes(), None if own is None else own.view(np.int64), plain, f))
                s, n, bits, fold, own, plain, f = zip(*out, strict=True)
                yield S.batch(schema, ids[i:j], hashes[i:j], s, n, bits, fold, pa.array(own, longs), plain, f)

    rows = S.id_text(docs).withColumn("t", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, t long, s long, n long, bits binary, fold binary, prefix array<long>, plain int, f long")


def simhash_pairs(marks: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets that connect what SimHash links: those of one fingerprint, and of fingerprints within its radius, by vantage-point trees."""
    of = S.stored(marks.where("doc_id is not null and f is not null").select("f", "s").distinct())
    least = S.stored(of.groupBy("f").agg(F.min("s").alias("b")))
    same = of.join(least, "f").select(F.col("s").alias("a"), "b")
    edges = simhash.shard_edges(least.select(F.col("f").alias("node"), "f"))
    near = edges.join(least.select(F.col("f").alias("a"), F.col("b").alias("x")), "a").join(least.select(F.col("f").alias("b"), F.col("b").alias("y")), "b")
    pairs = same.union(near.select("x", "y")).where("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


SHARDS = pa.schema([(c, pa.int64()) for c in ("key", "salt", "s", "n", "i", "m", "t", "k")])


def _shards(marks: DataFrame) -> DataFrame:
    """key (a run), salt, s, n, i (place of the run), m, t, k of the sets, two or more, that have the run in their prefix.

    t and k are name and size of another member of nearly the same size. m is the number of members; -1 where it is not
    known: sets of frequent runs are dealt out by a salt of their name, and more than HELD are never held.
    """
    rows = marks.where("doc_id is not null and prefix is not null").select("s", "n", "plain", F.posexplode("prefix").alias("i", "key"))
    salt = F.when(F.col("i") < F.col("plain"), 0).otherwise(1 + F.pmod("s", F.lit(SALTS)))
    rows = rows.select("key", salt.cast("long").alias("salt"), "s", "n", F.col("i").cast("long"))
    rows = rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "s")

    def told(rows: np.ndarray, over: bool) -> Iterator[pa.RecordBatch]:
        """Whole shards, or some of one that is larger (``over``)."""
        if not len(rows):
            return
        start = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1)))
        m = np.diff(np.append(start, len(rows)))
        m = np.repeat(np.where(over | (rows[start, 1] > 0), -1, m), m)
        rows, m = rows[m != 1], m[m != 1]
        if not len(rows):
            return
        order = np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))
        rows, m = rows[order], m[order]
        after = np.append(False, (rows[1:, :2] == rows[:-1, :2]).all(1))
        t, k = np.roll(rows[:, 2], 1), np.roll(rows[:, 3], 1)
        yield S.batch(SHARDS, *rows.T, m, pa.array(t, mask=~after), pa.array(k, mask=~after))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, over = np.zeros((0, 5), np.int64), False
        for b in itertools.chain(batches, (None,)):
            if b is not None:
                held = np.concatenate((held, np.stack([c.to_numpy() for c in b.columns], 1)))
                held = held[np.append(True, (held[1:, :3] != held[:-1, :3]).any(1))]  # copies from other tasks
            if not len(held):
                continue
            cut = np.flatnonzero((held[1:, :2] != held[:-1, :2]).any(1)) + 1
            end = len(held) if b is None else int(cut[-1]) if len(cut) else 0
            first = end if not over else int(cut[0]) if len(cut) else len(held) if b is None else 0
            if over and first:
                yield from told(held[:first], True)
                over = False
            else:
                first = 0
            yield from told(held[first:end], False)
            held = held[end:]
            if len(held) > HELD:
                yield from told(held[:-1], True)  # the last row stays, to tell copies of it
                held, over = held[-1:], True

    return rows.mapInArrow(run, "key long, salt long, s long, n long, i long, m long, t long, k long")


def _possible_pairs(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) that can resemble by ``similarity`` by their sizes and bitmaps."""
    of = lambda x: nodes.select(F.col("s").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b.column(2).to_numpy(), b.column(3).to_numpy()
            keep = np.minimum(n, m) >= least_whole(np.maximum(n, m), similarity)
            most = most_different(n + m, similarity)
            for i in np.flatnonzero(keep).tolist():
                x, y = (np.frombuffer(b.column(c)[i].as_buffer(), np.uint64) for c in (4, 5))
                longs = min(len(x), len(y))
                keep[i] = int(np.bitwise_count(folded(x, longs) ^ folded(y, longs)).sum(dtype=np.int64)) <= most[i]
            yield S.batch(EDGES, b.column(0), b.column(1)).filter(pa.array(keep))

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def _cell_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of sets of different components that meet in a shard and can resemble; ``rows``: key, m, s, n, i, c, fold.

    A shard of more than MEMBERS is cut into parts, and each pair of parts is a cell, so no task compares more than
    two parts at once and every pair of members meets in a cell. Where two sets meet first, in their common order, at
    places i and j, they share at most what is left from there on.
    """
    parts = F.ceil(F.col("m") / MEMBERS).cast("long")
    rows = rows.withColumn("p", F.pmod(F.xxhash64("s"), parts)).withColumn("q", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.select("fold", "key", F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), "p", "s", "n", "i", "c")
    rows = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "s")

    def pairs(ids: np.ndarray, fold: np.ndarray) -> Iterator[np.ndarray]:
        order = np.argsort(ids[:, 5], kind="stable")
        ids, fold = ids[order], fold[order]
        across, n, left = ids[0, 1] != ids[0, 2], ids[:, 5], ids[:, 5] - ids[:, 6]
        high = np.searchsorted(least_whole(n, similarity), n, "right")  # sets up to there are not too large for the first
        for at in range(0, len(ids), 64):
            to, end = min(len(ids), at + 64), int(high[min(len(ids), at + 64) - 1])
            i, j = np.arange(at, to)[:, None], np.arange(at + 1, end)[None, :]
            fit = (j > i) & (j < high[at:to, None]) & (ids[at:to, None, 7] != ids[None, at + 1 : end, 7])
            if across:
                fit &= ids[at:to, None, 3] != ids[None, at + 1 : end, 3]
            fit &= np.minimum(left[at:to, None], left[None, at + 1 : end]) >= least_whole(n[at:to, None] + n[None, at + 1 : end], similarity / (1 + similarity))
            i, j = np.nonzero(fit)
            i, j = i + at, j + at + 1
            ok = np.bitwise_count(fold[i] ^ fold[j]).sum(-1, dtype=np.int64) <= most_different(n[i] + n[j], similarity)
            if ok.any():
                yield np.stack((ids[i[ok], 4], ids[j[ok], 4]), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for b in itertools.chain(batches, (None,)):
            if b is not None:
                now = (np.stack([c.to_numpy() for c in b.columns[1:]], 1), np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64).reshape(-1, BITS // 64))
                held = now if held is None else tuple(map(np.concatenate, zip(held, now, strict=True)))
            if held is None or not len(held[0]):
                continue
            ids, fold = held
            cut = np.flatnonzero((ids[1:, :3] != ids[:-1, :3]).any(1)) + 1
            start, end = np.concatenate(([0], cut)), np.append(cut, len(ids))
            if b is not None:  # the last cell may go on
                start, end, held = start[:-1], end[:-1], (ids[start[-1] :], fold[start[-1] :])
            got = [p for s, e in zip(start.tolist(), end.tolist(), strict=True) if e - s > 1 for p in pairs(ids[s:e], fold[s:e])]
            if got:
                found = np.concatenate(got)
                found = np.unique(np.stack((found.min(1), found.max(1)), 1), axis=0)
                yield S.batch(EDGES, *found.T)

    return rows.mapInArrow(run, "a long, b long").distinct()


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b: names of sets) that resemble by ``similarity``, from the sets themselves."""
    pairs = S.stored(pairs)
    wanted = S.stored(pairs.select(F.col("a").alias("s")).union(pairs.select("b")).distinct().join(nodes.select("s", "first.doc_id"), "s"))
    ids = wanted.select(F.col("doc_id").alias("wanted_id")).distinct()
    schema = pa.schema([("s", pa.int64()), ("h", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in S.chunks(texts, 1 << 19):
                h = list(run_sets(texts[i:j]))
                yield S.batch(schema, [name_of(x) for x in h], [x.tobytes() for x in h])

    few = wanted.limit(LARGE + 1).count() <= LARGE
    rows = S.id_text(docs).join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("wanted_id"), "left_semi").mapInArrow(sets, "s long, h binary")
    rows = S.stored(rows.join(wanted.select("s"), "s", "left_semi").dropDuplicates(["s"]))
    both = pairs.join(rows.select(F.col("s").alias("a"), F.col("h").alias("g")), "a").join(rows.select(F.col("s").alias("b"), "h"), "b").select("a", "b", "g", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for g, h in zip(b.column(2), b.column(3), strict=True):
                g, h = np.frombuffer(g.as_buffer(), np.uint64), np.frombuffer(h.as_buffer(), np.uint64)
                shared = len(np.intersect1d(g, h, assume_unique=True))
                keep.append(shared >= int(least_whole(len(g) + len(h) - shared, similarity)))
            yield S.batch(EDGES, b.column(0), b.column(1)).filter(pa.array(keep, pa.bool_()))

    return S.stored(both.mapInArrow(run, "a long, b long"))


def similar_edges(docs: DataFrame, marks: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b: names) that connect exactly what pairs of sets at ``similarity`` or more connect.

    What SimHash links and each two neighbours of a shard are compared first, which links a group of near copies by few pairs;
    then all pairs of a shard whose components differ still.
    """
    with S.batch_rows(docs.sparkSession, ROWS):
        shards = S.stored(_shards(marks))
    near = shards.where(F.col("k") >= F.col("n") * similarity - 1e-9).select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).where("a <> b")
    near = near.union(simhash_pairs(marks)).distinct()
    first = _verified(docs, nodes, _possible_pairs(near, nodes, similarity), similarity)
    found = components(first).withColumnRenamed("node", "s").withColumnRenamed("component", "c")
    rows = S.stored(shards.select("key", "s", "n", "i", "m").join(found, "s", "left").withColumn("c", F.coalesce("c", "s")))
    whole = rows.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("*").alias("all")).where("x <> y").select("key", "all")
    rows = rows.join(whole, "key").withColumn("m", F.when(F.col("m") < 0, F.col("all")).otherwise(F.col("m"))).drop("all").join(nodes.select("s", "fold"), "s")
    pairs = _possible_pairs(S.stored(_cell_pairs(rows, similarity)), nodes, similarity)
    return first.union(_verified(docs, nodes, pairs, similarity))


def similar(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id, t (xxhash64 of the text), component_id and stays of every row of ``docs``: texts linked at a resemblance of ``similarity`` or more.

    Resemblance is that of the sets of runs of five words (64-bit hashes), found by SimHash and a join of the sets and verified exactly. component_id is the
    smallest doc_id that chains of links reach. One (doc_id, text) of each component stays: that of the smallest doc_id
    and, of rows that share it, of the smallest t. Equal sets are one node, so copies are never paired; texts without a
    word are alike. Rows whose doc_id is null link nobody and stay; they have the component of their set, or
    null. Null texts are empty; other columns are ignored; an empty table gives no rows.
    """
    S.tune(docs.sparkSession)
    marks = S.stored(_marks(docs, similarity))
    one = lambda c: F.first(c).alias(c)
    nodes = S.stored(marks.where("doc_id is not null").groupBy("s").agg(F.min(F.struct("doc_id", "t")).alias("first"), one("n"), one("bits"), one("fold")))
    found = components(similar_edges(docs, marks, nodes, similarity)).withColumnRenamed("node", "s")
    labels = nodes.select("s", "first").join(found, "s", "left").select("s", "first", F.coalesce("component", "s").alias("component"))
    kept = labels.groupBy("component").agg(F.min("first").alias("kept"))
    rows = marks.select("doc_id", "t", "s").join(labels.join(kept, "component").select("s", "kept"), "s", "left")
    stays = F.col("doc_id").isNull() | ((F.col("doc_id") == F.col("kept.doc_id")) & (F.col("t") == F.col("kept.t")))
    return rows.select("doc_id", "t", F.col("kept.doc_id").alias("component_id"), stays.alias("stays"))


def dedup(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay by similar(); equal rows stay or go together."""
    gone = S.stored(similar(docs, similarity).where("not stays").select(F.col("doc_id").alias("gone_id"), F.col("t").alias("gone_t")).distinct())
    few = gone.limit(LARGE + 1).count() <= LARGE
    same = (docs["doc_id"].cast("long") == gone["gone_id"]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == gone["gone_t"])
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
