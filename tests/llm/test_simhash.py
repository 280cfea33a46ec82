import re

import numpy as np
import pytest
import xxhash

from evidex.llm import components, simhash


def brute(text):
    words = [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))] if text.isascii() else re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    runs = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprint_is_the_majority_of_hashes():
    for t in ("", " ", "a", "a b", "a b c d", "A b C d e", "é É ß x y z   w", "the quick brown fox " * 9):
        assert simhash.fingerprint(t) == brute(t)


@pytest.mark.parametrize("kind", ["random", "clusters", "dense"])
def test_links_connect_what_brute_force_connects(kind):
    g = np.random.default_rng(3)
    n = 2500
    if kind == "random":
        f = g.integers(0, 2**63, n).astype(np.uint64)
    else:
        centres = g.integers(0, 2**63, 12 if kind == "clusters" else 1).astype(np.uint64)
        f = centres[g.integers(0, len(centres), n)]
        for _ in range(5 if kind == "clusters" else 3):
            f = f ^ (np.uint64(1) << g.integers(0, 64, n).astype(np.uint64))
    f = np.unique(f)
    near = np.nonzero(np.triu(np.bitwise_count(f[:, None] ^ f[None, :]) <= 4, 1))
    pairs = simhash.links(f)
    assert groups(len(f), zip(*map(np.ndarray.tolist, near), strict=True)) == groups(len(f), pairs.tolist())
    assert len(pairs) <= 40 * len(f)


def dense(n, seed):
    """Distinct fingerprints of a group of near copies: bits near a majority differ often, the others never."""
    g = np.random.default_rng(seed)
    weak = g.choice(64, 24, replace=False).astype(np.uint64)
    return g.permutation(np.unique(((g.random((8 * n, 24)) < 0.25).astype(np.uint64) << weak).sum(1, dtype=np.uint64)))[:n]


@pytest.mark.parametrize("n", [300, 3000])
def test_a_group_gives_one_link_a_member(n):
    """However many leaves of the tree its members lie in."""
    for some in (dense(n, 1), np.concatenate((dense(n, 2), np.random.default_rng(2).integers(0, 2**63, 2 * n).astype(np.uint64)))):
        pairs = simhash.links(some)
        assert len(pairs) == len(some) - len(set(groups(len(some), pairs.tolist()))) > 0.7 * n


def test_edges_of_a_group_grow_with_its_size(spark):
    """Rows that the shards give, before copies of them are dropped: at most one a member of each."""
    for n in (500, 3000):
        f = dense(n, 3)
        nodes = spark.createDataFrame([(i, int(x)) for i, x in enumerate(f.view(np.int64))], "node long, f long")
        rows = simhash.tree_shards(nodes, len(f)).cache()
        shards, members = rows.select("choice", "key").distinct().count(), rows.count()
        edges = [tuple(e) for e in simhash._tree_edges(rows, 4).collect()]
        near = np.nonzero(np.triu(np.bitwise_count(f[:, None] ^ f[None, :]) <= 4, 1))
        assert 0.7 * n < len(edges) <= members - shards
        assert groups(n, edges) == groups(n, zip(*map(np.ndarray.tolist, near), strict=True))


def bunch(n, seed):
    """Distinct fingerprints around centres, at all distances up to four and more."""
    g = np.random.default_rng(seed)
    f = g.integers(0, 2**63, max(1, n // 15)).astype(np.uint64)[g.integers(0, max(1, n // 15), n)]
    for _ in range(4):
        f = f ^ (np.uint64(1) << g.integers(0, 64, n).astype(np.uint64))
    return np.unique(f)


@pytest.mark.parametrize(("crowd", "shard"), [(1, 1024), (6, 1024), (50, 1024), (1 << 16, 1), (1 << 16, 20), (50, 20)])
def test_shards_lose_no_link(spark, monkeypatch, crowd, shard):
    """Leaves of trees of several depths across the cluster, and crowded ones divided by blocks."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "SHARD", shard)
    f = bunch(600, 9)
    near = np.nonzero(np.triu(np.bitwise_count(f[:, None] ^ f[None, :]) <= 4, 1))
    nodes = spark.createDataFrame([(i, int(x)) for i, x in enumerate(f.view(np.int64))], "node long, f long")
    edges = [tuple(e) for e in simhash.shard_edges(nodes).collect()]
    assert groups(len(f), edges) == groups(len(f), zip(*map(np.ndarray.tolist, near), strict=True))


def test_every_linked_pair_has_a_leaf_in_common():
    """Pairs at distance 4, however the bits lie, in trees of twelve levels; unrelated ones rarely meet."""
    g = np.random.default_rng(8)
    f = g.integers(0, 2**63, 4000).astype(np.uint64)
    other = f.copy()
    for k in range(4):
        other ^= np.uint64(1) << np.uint64((7 + 11 * k) % 64) if k % 2 else np.uint64(1) << g.integers(0, 64, len(f)).astype(np.uint64)
    met, chance = np.zeros(len(f), bool), np.zeros(len(f), bool)
    for which, mask in enumerate(simhash.part_masks()):
        leaves = [[set() for _ in f] for _ in range(2)]
        for side, some in zip(leaves, (f, other), strict=True):
            for p, i in zip(*map(np.ndarray.tolist, simhash.tree_places(some, mask, which, 12, 1)), strict=True):
                side[i].add(p)
        met |= [bool(a & b) for a, b in zip(*leaves, strict=True)]
        chance |= [bool(a & b) for a, b in zip(leaves[0], leaves[1][1:] + leaves[1][:1], strict=True)]
    assert met.all() and chance.mean() < 0.1


def test_trees_split_at_the_size_of_the_tables(spark, monkeypatch):
    """10,000 fingerprints: the cluster's tree has several levels, and the trees of its leaves have several leaves."""
    f = np.unique(np.random.default_rng(6).integers(0, 2**63, 10_000).astype(np.uint64))
    assert simhash.levels(len(f)) >= 4 and simhash.levels(1 << 40) == simhash.LEVELS
    nodes = spark.createDataFrame([(i, int(x)) for i, x in enumerate(f.view(np.int64))], "node long, f long")
    shards = {}
    for r in simhash.tree_shards(nodes, len(f)).collect():
        shards.setdefault((r.choice, r.key), []).append(r.f)
    assert len(shards) > 60 and max(map(len, shards.values())) < 2 * simhash.SHARD
    leaves, leaf = [], simhash._leaf
    monkeypatch.setattr(simhash, "_leaf", lambda some, r: leaves.append(len(some)) or leaf(some, r))
    simhash.links(np.array(next(iter(shards.values())), np.int64).view(np.uint64))
    assert len(leaves) > 4 and max(leaves) <= simhash.LEAF


def test_leaves_stay_small_at_millions(spark):
    """One of a hundred of four million fingerprints: leaves go on splitting, and fingerprints don't lie in many."""
    n, f = 4_000_000, np.unique(np.random.default_rng(7).integers(0, 2**63, 40_000).astype(np.uint64))
    nodes = spark.createDataFrame([(i, int(x)) for i, x in enumerate(f.view(np.int64))], "node long, f long")
    sizes = [r[0] for r in simhash.tree_shards(nodes, n).groupBy("choice", "key").count().select("count").collect()]
    assert max(sizes) * 100 < 32 * simhash.SHARD and sum(sizes) < 50 * len(f)


def test_shards_are_split_on_the_bits_of_their_part(monkeypatch):
    """A shard of 8,000: each pair that differs in one bit of the part at most is connected, and members lie in few leaves."""
    g, mask = np.random.default_rng(5), simhash.part_masks()[1]
    f = g.integers(0, 2**63, 4000).astype(np.uint64)
    inside, outside = ([np.uint64(1 << i) for i in range(64) if (mask >> i & 1) == x] for x in (1, 0))
    other = f ^ g.choice(inside, len(f))
    for _ in range(3):
        other = other ^ g.choice(outside, len(f))
    f = np.unique(np.concatenate((f, other)))
    met, leaf = [], simhash._leaf
    monkeypatch.setattr(simhash, "_leaf", lambda some, r: met.append(len(some)) or leaf(some, r))
    pairs = simhash.links(f, 4, mask, 1)
    near = np.nonzero(np.triu((np.bitwise_count(f[:, None] ^ f[None, :]) <= 4) & (np.bitwise_count((f[:, None] ^ f[None, :]) & np.uint64(mask)) <= 1), 1))
    assert len(near[0]) >= 3900 and groups(len(f), zip(*map(np.ndarray.tolist, near), strict=True)) == groups(len(f), pairs.tolist())
    assert max(met) <= simhash.LEAF and sum(met) < 8 * len(f)


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_a_pair_within_the_radius_agrees_on_a_choice_of_bits(n):
    masks = simhash.masks(n)
    g = np.random.default_rng(n)
    for _ in range(500):
        d = sum(1 << int(b) for b in g.choice(64, 4, replace=False))
        assert any(not d & m for m in masks)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (2, 1), (9, 8), (8, 7), (7, 6), (6, 5), (5, 4), *[(100, 100 + i) for i in range(1, 400)], *[(1000 + i, 1001 + i) for i in range(60)]]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {n: 1 for n in (1, 2, 3)} | {n: 4 for n in range(4, 10)} | {n: 100 for n in range(100, 500)} | {n: 1000 for n in range(1000, 1061)}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_documents(spark, odd_docs, odd_rows, no_docs):
    got = sorted(map(tuple, simhash.near_duplicates(odd_docs).collect()), key=repr)
    f = [simhash.fingerprint(t or "") for _, t in odd_rows]
    label = groups(len(f), [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 4])
    least = {}
    for (d, _), c in zip(odd_rows, label, strict=True):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    want = [(d, f"{x:016x}", least.get(c)) for (d, _), x, c in zip(odd_rows, f, label, strict=True)]
    assert got == sorted(want, key=repr)
    assert simhash.near_duplicates(no_docs).count() == 0
