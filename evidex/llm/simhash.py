"""SimHash near-duplicates with vantage-point trees (operator 4).

Fingerprints are partitioned by Hamming distance, in vantage-point trees at two levels. Across the cluster, the
64 bits are cut into three parts: a pair at distance 4 differs in at most one bit of one of them. Each part has
a tree whose vantage points follow from a node's place in it, so it needs no data, has no root in one place and is as
deep as the corpus asks for: a branch ends where few members are left to expect. A node parts its members by their distance
to its point; those within one bit of the border may have a partner beyond it (triangle inequality) and go to both sides.
Leaves are shards, so every linked pair meets in one at least. Within a shard a tree splits the fingerprints at the distance
to one of them: on the bits of the shard's part, with borders of one bit, as long as these tell its members apart, and
then over all 64, with borders of the whole radius.

All 64 bits at once would not do for the cluster's tree: distances between unrelated texts lie so close to 32 that three
quarters of the members are within 4 of any border. Shards that stay crowded, as more than some 2**22 values of
a part can't be told apart, are divided by choices of blocks of bits on which a linked pair agrees.

Equal fingerprints are one node; a shard gives at most one link a member (a spanning forest of what
is linked there), never all pairs.

64 bits and a radius of 4 find little beyond copies; module similar links texts at a similarity of 0.8.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spark as S
from . import _words as W
from .components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Members of a tree's leaf; a split whose larger side holds more than this share is none.
LEAF, SPLIT = 128, 0.9
#: Members in all nodes of a tree, for each fingerprint, from which the rest is searched without one.
SPENT = 64
#: Parts of the bits with a tree each across the cluster; members that its leaves should have; its levels at most (a path is a long).
PARTS, SHARD, LEVELS = 3, 1024, 48
#: Members from which a shard is divided by more bits, and blocks of bits that are matched at most.
CROWD, DEEPEST = 1 << 16, 4
#: Large shards whose names are broadcast at most (20 bytes each); more of them are joined.
LARGE = 200_000


def fingerprint(text: str, k: int = SHINGLE) -> int:
    """SimHash of a text's runs of k words: a bit is 1 if set in over half of their XXH64."""
    data = text.encode().lower()  # ASCII letters only
    words = data.split()  # ASCII white space
    if not words:
        return 0
    if len(words) <= k:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate(([0], end[:-1] + 1))
    ones, n, digest = np.zeros(64, np.int64), len(words) - k + 1, xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 14):
        to = min(n, at + (1 << 14))
        h = np.array([digest(line[s:e], SEED) for s, e in zip(start[at:to].tolist(), end[at + k - 1 : to + k - 1].tolist(), strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("f", pa.int64())])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint ``f`` (a signed long of the same bits) of every row; null text: empty."""
    S.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield S.batch(FINGERPRINTS, b.column(0), pa.array(np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)))

    return S.id_text(docs).mapInArrow(run, "doc_id long, f long")


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits set in each fingerprint; those of several words have them on the last axis, as a third one here."""
    n = np.bitwise_count(x)
    return n[..., 0] if n.shape[-1] == 1 else n.sum(-1, dtype=np.int64)


def _leaf(f: np.ndarray, r: int) -> np.ndarray:
    """Pairs (indices) that connect the members of a leaf, all compared at once."""
    n = len(f)
    near, label = _bits(f[:, None] ^ f[None, :]) <= r, np.arange(n)
    if np.count_nonzero(near) == n:  # each only itself
        return np.zeros((0, 2), np.int64)
    while True:
        new = np.where(near, label[None, :], n).min(1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    i = np.flatnonzero(label != np.arange(n))
    return np.stack((i, label[i]), 1)


def _dense(f: np.ndarray, r: int) -> np.ndarray:
    """The same for members that no vantage point tells apart, a block at a time.

    Members go out of the comparison as soon as they are reached, so a group of near copies takes a
    few blocks and not the square of its size.
    """
    left, pairs = np.arange(len(f)), []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            block, front = front[:64], front[64:]
            near = _bits(f[left][:, None] ^ f[block][None, :]) <= r
            hit = near.any(1)
            pairs.append(np.stack((left[hit], block[near[hit].argmax(1)]), 1))
            front, left = np.concatenate((front, left[hit])), left[~hit]
    return np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)


def _forest(n: int, pairs: np.ndarray) -> np.ndarray:
    """Pairs that connect what ``pairs`` of n members connect: each member and the first of its group, so n - 1 at most."""
    (a, b), label = pairs.T, np.arange(n)
    while True:
        least, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    i = np.flatnonzero(label != np.arange(n))
    return np.stack((i, label[i]), 1)


def _vantage(f: np.ndarray) -> np.ndarray:
    """Distances to the one of five members that spreads the others most."""
    d = _bits(f[None, :] ^ f[:: max(1, len(f) // 5)][:5, None])
    return d[d.std(1).argmax()]


def links(f: np.ndarray, r: int = RADIUS, mask: int = 0, near: int = 0) -> np.ndarray:
    """Pairs (indices) that connect exactly what is connected by pairs at distance r or less: a member and the first of its group.

    ``f``: distinct fingerprints, uint64 or rows of several. The tree splits at the distance to a vantage point that makes the larger
    side smallest; a pair within r has distances to it that differ by r at most (triangle inequality),
    so the outer side also takes what lies within r inside the border, and no link is lost. A set of
    which the larger side would still hold nearly all is a dense group, and is searched as one, as is what
    is left when borders have taken up members SPENT times.

    With a ``mask``, only pairs that differ in ``near`` or fewer of its bits have to be connected: the distances are those on
    these bits, with a border of ``near``, until they part a set no more.
    """
    f = f.reshape(len(f), -1)
    spent, out, todo = 0, [], [(np.arange(len(f)), bool(mask))]
    while todo:
        at, part = todo.pop()
        if len(at) <= LEAF:
            out.append(at[_leaf(f[at], r)])
            continue
        spent += len(at)
        if spent > SPENT * len(f):
            out.append(at[_dense(f[at], r)])
            continue
        border = near if part else r
        d = _vantage(f[at] & np.uint64(mask) if part else f[at])
        below = np.cumsum(np.bincount(d, minlength=64 * f.shape[1] + 1))  # members at a distance up to c
        inside = np.concatenate((np.zeros(border, np.int64), below))[: len(below)]  # up to c - border
        larger = np.maximum(below, len(at) - inside)
        cut = int(np.argmin(larger))
        if larger[cut] <= SPLIT * len(at):
            todo += [(at[d <= cut], part), (at[d > cut - border], part)]
        elif part:
            todo.append((at, False))
        else:
            out.append(at[_dense(f[at], r)])
    return _forest(len(f), np.concatenate(out)) if out else np.zeros((0, 2), np.int64)


def masks(k: int, r: int = RADIUS) -> list[int]:
    """Choices of bits on which a shard's members agree: k of r + k blocks, as every pair at distance r does on one choice."""
    blocks = [sum(1 << i for i in b.tolist()) for b in np.array_split(np.arange(64), r + k)]
    return [sum(c) for c in itertools.combinations(blocks, k)]


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def part_masks() -> list[int]:
    """The bits of each part."""
    return [sum(1 << i for i in b.tolist()) for b in np.array_split(np.arange(64), PARTS)]


def shares(bits: int, near: int) -> tuple[float, float]:
    """The inner and the outer side of a split, as shares of its members, if they spread as those of unrelated texts do."""
    at = [math.comb(bits, d) / 2**bits for d in range(bits + 1)]
    cut = bits // 2
    return sum(at[: cut + 1]), sum(at[max(0, cut - near + 1) :])


def levels(n: int, r: int = RADIUS) -> int:
    """Levels after which any leaf has about SHARD of n fingerprints, if they spread as those of unrelated texts do."""
    larger = max(shares(64 // PARTS, r // PARTS))
    return min(LEVELS, math.ceil(math.log(n / SHARD) / -math.log(larger))) if n > SHARD else 0


def tree_places(f: np.ndarray, mask: int, which: int, depth: int, near: int, n: float = math.inf) -> tuple[np.ndarray, np.ndarray]:
    """Leaves of one part's tree and, for each, which of the fingerprints is in it.

    A branch ends after ``depth`` levels, or sooner where SHARD or fewer of ``n`` fingerprints are left to expect; that
    follows from its place alone.
    """
    at, path, size, bits = np.arange(len(f)), np.ones(len(f), np.uint64), np.full(len(f), float(n)), np.uint64(mask)
    cut, (least, most), leaves = mask.bit_count() // 2, shares(mask.bit_count(), near), []
    for _ in range(depth):
        if (small := size <= SHARD).any():
            leaves.append((path[small], at[small]))
            at, path, size = at[~small], path[~small], size[~small]
        point = W.mix(path * np.uint64(2 * PARTS + 1) + np.uint64(which)) & bits
        d = np.bitwise_count((f[at] & bits) ^ point).astype(np.int64)
        inner, outer = d <= cut, d > cut - near
        at, path = np.concatenate((at[inner], at[outer])), np.concatenate((path[inner] * np.uint64(2), path[outer] * np.uint64(2) + np.uint64(1)))
        size = np.concatenate((size[inner] * least, size[outer] * most))
    return tuple(map(np.concatenate, zip(*leaves, (path, at), strict=True)))


ROWS = pa.schema([(c, pa.int64()) for c in ("choice", "key", "node", "f")])


def tree_shards(nodes: DataFrame, n: int, r: int = RADIUS) -> DataFrame:
    """choice (part), key (leaf), node, f: each of the n ``nodes`` (node, f) in all leaves whose borders it may touch."""
    depth, masks_, near = levels(n, r), part_masks(), r // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, f = b.column(0).to_numpy(), b.column(1).to_numpy()
            for which, mask in enumerate(masks_):
                path, at = tree_places(f.view(np.uint64), mask, which, depth, near, n)
                yield S.batch(ROWS, np.full(len(at), which), path.view(np.int64), node[at], f[at])

    return nodes.select("node", "f").mapInArrow(run, "choice long, key long, node long, f long")


def _apart(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows of shards (choice, key) of at most CROWD members, and the nodes of the others (None: there are none)."""
    crowds = S.stored(rows.groupBy("choice", "key").agg(F.count("*").alias("m")).where(F.col("m") > CROWD).drop("m"))
    if not (n := crowds.limit(LARGE + 1).count()):
        return rows, None
    crowds = F.broadcast(crowds) if n <= LARGE else crowds
    return rows.join(crowds, ["choice", "key"], "left_anti"), S.stored(rows.join(crowds, ["choice", "key"], "left_semi").select("node", "f").distinct())


def shard_edges(nodes: DataFrame, r: int = RADIUS) -> DataFrame:
    """Edges (a, b: nodes) that connect what is within r bits; ``nodes``: node, f, each f once.

    What is in a leaf of more than CROWD is dealt out anew by one block of bits, then by two, and so on: a linked pair meets in
    a small shard, or both go on. So shards stay bounded for any number of fingerprints and in any large group, unless more
    than CROWD agree on four of eight blocks.
    """
    S.tune(nodes.sparkSession)
    few, crowd = _apart(tree_shards(nodes, nodes.count(), r))
    out = _tree_edges(few, r, part_masks())
    for k in range(1, DEEPEST + 1):
        if crowd is None:
            break
        signed = [m - (1 << 64) if m >> 63 else m for m in masks(k, r)]
        rows = crowd.select("node", "f", F.posexplode(F.array(*[F.col("f").bitwiseAND(F.lit(m)) for m in signed])).alias("choice", "key"))
        few, crowd = _apart(rows) if k < DEEPEST else (rows, None)
        out = out.union(_tree_edges(few, r))
    return out.distinct()


def _tree_edges(rows: DataFrame, r: int, parts: list[int] | None = None) -> DataFrame:
    """Edges within each shard (choice, key) of ``rows`` (node, f); with ``parts``, choice is one of them, of which linked pairs differ in few bits."""
    shards = rows.select("choice", "key", "node", "f").repartition("choice", "key").sortWithinPartitions("choice", "key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 4
        for b in itertools.chain(batches, (None,)):
            if b is not None:
                kept = [np.concatenate((k, c.to_numpy())) for k, c in zip(kept, b.columns, strict=True)]
            node, f, which, key = kept
            if not len(node):
                continue
            cut = np.flatnonzero((which[1:] != which[:-1]) | (key[1:] != key[:-1])) + 1
            ends = [*cut.tolist(), len(node)] if b is None else cut.tolist()
            found, at = [], 0
            for end in ends:
                if end - at > 1:
                    found.append(node[at + links(f[at:end].view(np.uint64), r, parts[which[at]] if parts else 0, r // PARTS)])
                at = end
            kept = [k[at:] for k in kept]
            if found and len(pairs := np.concatenate(found)):
                yield S.batch(EDGES, pa.array(pairs[:, 0]), pa.array(pairs[:, 1]))

    return shards.select("node", "f", F.col("choice").cast("long"), "key").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, r: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``.

    component_id is the smallest doc_id that chains of fingerprints at r or fewer differing bits
    reach, the document itself included. A null or empty text, or one of white space, has the
    fingerprint zero and is linked like any other; fewer than four words count as one shingle; equal
    rows give equal rows. Rows whose doc_id is null form links for nobody and have a null component
    unless their fingerprint's other documents have one. An empty table gives no rows.
    """
    marks = S.stored(fingerprints(docs))
    nodes = S.stored(marks.where("doc_id is not null").groupBy("f").agg(F.min("doc_id").alias("node")))
    found = components(shard_edges(nodes, r))
    labels = nodes.join(found, "node", "left").select("f", F.coalesce("component", "node").alias("component_id"))
    # Partial first: a fingerprint with a third of the rows is a skewed join, which is split at run time.
    out = marks.join(labels, "f", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(S.read(spark, sf_dir, "documents"))
