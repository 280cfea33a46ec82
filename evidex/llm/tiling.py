"""Benchmark decontamination: greedy string tiling (operator 9).

A running Karp-Rabin hash of MATCH words finds the seeds that a document shares with a benchmark item; each is
checked on the words. Seeds in a row on one diagonal are a match; the longest match of unmarked words is marked as a tile,
again and again, until none of MATCH words is left. An item is found in a document if tiles cover a
given share of its words, wherever they stand in the document: passages with parts in another order
are caught as well.
"""

from __future__ import annotations

import functools
import heapq
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spark as S
from . import _words as W

#: Words of a seed and of a tile at least; share of an item's words under tiles that counts.
MATCH, COVERAGE = 5, 0.8
#: Characters of items that are sent to the executors at once; more items are taken in several passes.
BLOCK = 16_000_000
BITS = 22
#: Pairs of equal seeds of one document that are held at once (some 24 bytes each).
PAIRS = 1 << 21


def matches(i: np.ndarray, j: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches (document place, item place, length) of seeds of k words at places i and j: seeds in a row on one diagonal."""
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    start = np.flatnonzero(np.concatenate(([True], (np.diff(i - j) != 0) | (np.diff(i) != 1))))
    return i[start], j[start], np.diff(np.append(start, len(i))) + k - 1


def matches_by_row(doc: np.ndarray, item: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same from the seeds of a document and an item, where pairs of equal seeds are too many to be held.

    Goes through the item place by place and keeps, for each place of the document, how long the match is that ends there:
    memory for the matches and a row, not for pairs.
    """
    order = np.argsort(doc, kind="stable")
    low, high = np.searchsorted(doc[order], item, "left"), np.searchsorted(doc[order], item, "right")
    length, before, out = np.zeros(len(doc) + 2, np.int64), np.zeros(0, np.int64), []
    row_of = np.full((2, len(doc) + 2), -9)  # of each place, the last even and odd row that had it
    for q in range(len(item) + 1):
        now = order[low[q] : high[q]] if q < len(item) else before[:0]
        row_of[q % 2, now] = q
        ends = before[row_of[q % 2, before + 1] != q]
        if len(ends):
            n = length[ends]
            out.append((ends - n + 1, q - n, n + k - 1))
        length[now] = np.where(row_of[1 - q % 2, now - 1] == q - 1, length[now - 1], 0) + 1
        before = now
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (before, before, before)


def tiles(i: np.ndarray, j: np.ndarray, length: np.ndarray, k: int, n_doc: int, n_item: int) -> list[tuple[int, int, int]]:
    """Tiles (document place, item place, length) from matches of k words or more.

    The longest comes first; of equals, the one first in the item, then in the document. What earlier
    tiles took from a match is cut off, and the rest goes back among the matches.
    """
    heap = [(-n, q, p) for n, q, p in zip(length.tolist(), j.tolist(), i.tolist(), strict=True)]
    heapq.heapify(heap)
    doc, item, out = np.zeros(n_doc, bool), np.zeros(n_item, bool), []
    while heap:
        n, q, p = heapq.heappop(heap)
        n = -n
        taken = doc[p : p + n] | item[q : q + n]
        if not taken.any():
            doc[p : p + n] = item[q : q + n] = True
            out.append((p, q, n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([True], taken, [True])).astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= k:
                heapq.heappush(heap, (a - b, q + a, p + a))
    return out


class Items:
    """Seeds of the items of a block."""

    def __init__(self, ids: list, texts: list[str], match: int = MATCH, coverage: float = COVERAGE):
        h, off = W.many([t.encode() for t in texts])
        self.ids, self.words, self.off, self.size, self.match, self.coverage = ids, h, off, np.diff(off), match, coverage
        #: By words of a seed (items of fewer than ``match`` words are one seed): bits, hashes, items, places.
        self.seeds = {}
        for k in range(1, match + 1):
            own = np.flatnonzero((self.size == k) if k < match else self.size >= match)
            if not len(own):
                continue
            words = np.concatenate([h[off[i] : off[i + 1]] for i in own])
            seed, at = W.running(words, np.concatenate(([0], np.cumsum(self.size[own]))), k)
            item = np.repeat(own, np.diff(at))
            place = np.arange(len(seed)) - np.repeat(at[:-1], np.diff(at))
            order = np.argsort(seed, kind="stable")
            bits = np.zeros(1 << BITS, bool)
            bits[(seed >> np.uint64(64 - BITS)).astype(np.int64)] = True
            self.seeds[k] = bits, seed[order], item[order], place[order]

    def found(self, texts: list[str]) -> list[tuple[int, int, float, int, int]]:
        """(text, item, coverage, tiles, words under tiles) of each pair that reaches the coverage."""
        out = []
        for a, b in S.chunks(texts):
            h, off = W.many([t.encode() for t in texts[a:b]])
            for k, (bits, seeds, item, place) in self.seeds.items():
                s, at = W.running(h, off, k)
                hit = np.flatnonzero(bits[(s >> np.uint64(64 - BITS)).astype(np.int64)])
                low, high = np.searchsorted(seeds, s[hit], "left"), np.searchsorted(seeds, s[hit], "right")
                hit, low, n = hit[high > low], low[high > low], (high - low)[high > low]
                doc = np.searchsorted(at, hit, "right") - 1
                cut = np.concatenate(([0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)])) if len(doc) else np.zeros(1, np.int64)
                for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    d = int(doc[lo])
                    words = h[off[d] : off[d + 1]]
                    if n[lo:hi].sum() <= PAIRS:
                        got = self._held(words, hit[lo:hi] - at[d], low[lo:hi], n[lo:hi], item, place, k)
                    else:
                        got = self._by_row(words, s[at[d] : at[d + 1]], seeds, item, place, low[lo:hi], n[lo:hi], k)
                    out += [(a + d, *g) for g in got]
        return out

    def _judged(self, t: int, i: np.ndarray, j: np.ndarray, length: np.ndarray, n_doc: int, k: int) -> Iterator[tuple[int, float, int, int]]:
        got = tiles(i, j, length, k, n_doc, int(self.size[t]))
        under = sum(g[2] for g in got)
        if under >= self.coverage * self.size[t]:
            yield t, under / int(self.size[t]), len(got), under

    def _held(self, words: np.ndarray, at: np.ndarray, low: np.ndarray, n: np.ndarray, item: np.ndarray, place: np.ndarray, k: int) -> Iterator[tuple[int, float, int, int]]:
        """What is found in a document of which all pairs of equal seeds are held at once."""
        take = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        i, x, y = np.repeat(at, n), item[take], place[take]
        same = np.ones(len(i), bool)
        for w in range(k):  # equal hashes are checked on the words
            same &= words[i + w] == self.words[self.off[x] + y + w]
        i, x, y = i[same], x[same], y[same]
        order = np.lexsort((y, x))
        i, x, y = i[order], x[order], y[order]
        cut = [0, *(np.flatnonzero(np.diff(x)) + 1).tolist(), len(x)] if len(x) else []
        for lo, hi in itertools.pairwise(cut):
            t, places = int(x[lo]), np.unique(y[lo:hi])
            # Words under any seed are as many as tiles can cover.
            if k + np.minimum(np.diff(places), k).sum() >= self.coverage * self.size[t]:
                yield from self._judged(t, *matches(i[lo:hi], y[lo:hi], k), len(words), k)

    def _by_row(self, words: np.ndarray, s: np.ndarray, seeds: np.ndarray, item: np.ndarray, place: np.ndarray, low: np.ndarray, n: np.ndarray, k: int) -> Iterator[tuple[int, float, int, int]]:
        """The same item by item, for a document and items that repeat their words; seeds are numbered by their words first."""
        used = np.zeros(len(seeds) + 1, np.int64)
        first, many = np.unique(low), np.zeros(len(seeds) + 1, np.int64)
        many[low] = n
        np.add.at(used, first, 1)
        np.add.at(used, first + many[first], -1)
        for t in np.unique(item[np.cumsum(used[:-1]) > 0]).tolist():
            own = self.words[self.off[t] : self.off[t + 1]]
            _, number = np.unique(np.concatenate((words, own)), return_inverse=True)
            both = np.lib.stride_tricks.sliding_window_view(number, k)
            mine, theirs = both[: len(words) - k + 1], both[len(words) :]
            _, number = np.unique(np.concatenate((mine, theirs)), axis=0, return_inverse=True)
            number = number.ravel()
            yield from self._judged(t, *matches_by_row(number[: len(mine)], number[len(mine) :], k), len(words), k)


def blocks(items: DataFrame, match: int = MATCH, coverage: float = COVERAGE) -> Iterator[Items]:
    """The items in blocks of bounded size, one at a time on the driver."""
    ids, texts, size = [], [], 0
    rows = items.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))).distinct()
    for i, t in rows.toLocalIterator():
        if texts and size + len(t) > BLOCK:
            yield Items(ids, texts, match, coverage)
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(t)
        size += len(t)
    if texts:
        yield Items(ids, texts, match, coverage)


FOUND = "doc_id long, item_id long, coverage double, n_tiles long, n_words long"


def _passes(items: DataFrame, match: int, coverage: float, apply: Callable[[Items], DataFrame]) -> DataFrame | None:
    """What ``apply`` gives for all blocks of items: of one block as a plan; of several each pass is stored, so that no more than one
    block is held by the driver or a worker at once. None without items."""
    todo = blocks(items, match, coverage)
    one, two = next(todo, None), next(todo, None)
    if two is None:
        return None if one is None else apply(one)
    return functools.reduce(DataFrame.union, [S.stored(apply(block)) for block in itertools.chain((one, two), todo)])


def contaminated(docs: DataFrame, items: DataFrame, match: int = MATCH, coverage: float = COVERAGE) -> DataFrame:
    """Every pair of a document and an item of which tiles cover ``coverage`` of the words.

    Words are runs without white space, A-Z as a-z. Items of fewer than ``match`` words must occur
    whole; items and documents without a word match nothing; equal rows of items count once, equal
    documents each. Null texts are empty; null ids stay. The documents are read once for each block
    of items (one block here) and never shuffled.
    """
    spark = S.tune(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int64()), ("n_words", pa.int64())])

    def apply(block: Items) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(0).to_pylist()
                if got := block.found(b.column(1).to_pylist()):
                    yield S.batch(schema, *zip(*((ids[d], block.ids[t], *rest) for d, t, *rest in got), strict=True))

        return S.id_text(docs).mapInArrow(run, FOUND)

    out = _passes(items, match, coverage, apply)
    return spark.createDataFrame([], FOUND) if out is None else out


def decontaminate(docs: DataFrame, items: DataFrame, match: int = MATCH, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item is found.

    With one block of items each row is judged where it lies. With several, what each pass finds is told by doc_id and a hash of the
    text, and goes by one join.
    """
    S.tune(docs.sparkSession)
    todo = blocks(items, match, coverage)
    one, two = next(todo, None), next(todo, None)
    if two is None:
        return docs if one is None else S.keep_rows(docs, lambda texts: _clean(one, texts))
    rows = S.id_text(docs).withColumn("t", F.xxhash64("text"))

    def hits(block: Items) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                gone = pa.array(~_clean(block, b.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column(0).filter(gone), b.column(2).filter(gone)], names=["gone_id", "gone_t"])

        return S.stored(rows.mapInArrow(run, "gone_id long, gone_t long").distinct())

    gone = functools.reduce(DataFrame.union, [hits(block) for block in itertools.chain((one, two), todo)]).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == gone["gone_t"])
    return docs.join(gone, same, "left_anti")


def _clean(block: Items, texts: list[str]) -> np.ndarray:
    keep = np.ones(len(texts), bool)
    keep[[d for d, *_ in block.found(texts)]] = False
    return keep


def op9_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(S.read(spark, sf_dir, "documents"), S.read(spark, sf_dir, "benchmark"))
