"""BPE encoding and decoding with a pair occurrence index (operator 10).

The distinct words of a batch lie in one array of symbols with links to their neighbours. An index
maps each pair of neighbours to all its positions; a heap holds the ranks of pairs that occur. Ranks
are taken in ascending order, each applied to all its positions at once from left to right, and the
lists of the pairs that vanish and appear are brought up to date. As every merge makes a token of its
own that later merges alone use (checked on loading), this equals merging each word by itself.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spark as S

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose tokens a worker remembers; beyond it, the memory starts anew.
KNOWN = 250_000
#: Characters of texts that are split and merged together.
CHUNK = 2 << 20
#: No rank, and the symbol of a place that has gone.
NEVER = 1 << 30


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary -> the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary in the format of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.bytes_of = {i: raw(s) for s, i in model["vocab"].items()}
        self.first = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.first[b] = model["vocab"][c]
        ranks: dict[int, int] = {}
        #: Left, right and new token of each rank.
        self.by_rank: list[tuple[int, int, int]] = []
        made = {i: -1 for i in self.first.tolist()}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            x, y, new = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            if new in made or not (made.get(x, rank) < rank and made.get(y, rank) < rank):
                raise ValueError(f"merge {rank} makes a token twice or uses one that no earlier merge makes")
            made[new] = rank
            ranks[x << 32 | y] = rank
            self.by_rank.append((x, y, new))
        self.pairs = np.array([*sorted(ranks), NEVER << 32], np.int64)
        self.pair_ranks = np.array([*(ranks[p] for p in self.pairs[:-1].tolist()), NEVER])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in what is around them")
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(PATTERN).findall
        self.table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.known: dict[str, bytes] = {}

    def ranks(self, pairs: np.ndarray) -> np.ndarray:
        """Rank of each pair, given as left token << 32 | right token; NEVER for one that no merge has."""
        at = np.searchsorted(self.pairs, pairs)
        return np.where(self.pairs[at] == pairs, self.pair_ranks[at], NEVER)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Tokens (little-endian unsigned 32-bit) of each word, all words merged together."""
        if not words:
            return []
        size = np.array([len(w) for w in words])
        end = np.cumsum(size)
        n = int(end[-1])
        # Place n stands for "no neighbour"; its symbol occurs in no pair.
        sym = np.append(self.first[np.frombuffer(b"".join(words), np.uint8)], NEVER)
        left, right = np.arange(-1, n), np.arange(1, n + 2)
        left[(end - size)[size > 0]], right[end[size > 0] - 1], left[n], right[n] = n, n, n, n
        lists: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            """Puts the pairs that begin at these places into the index."""
            rank = self.ranks(sym[at] << 32 | sym[right[at]])
            at, rank = at[rank != NEVER], rank[rank != NEVER]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1 if len(rank) else []
            for r, some in zip(rank[[0, *cut]].tolist() if len(rank) else (), np.split(at, cut) if len(at) else (), strict=True):
                if r in lists:
                    lists[r].append(some)
                else:
                    lists[r] = [some]
                    heapq.heappush(heap, r)

        add(np.flatnonzero(right[:n] != n))
        while heap:
            rank = heapq.heappop(heap)
            a, b, new = self.by_rank[rank]
            at = np.concatenate(lists.pop(rank))
            j = right[at]
            at = at[(sym[at] == a) & (sym[j] == b)]
            if a == b and len(at):  # in a run of equal symbols, every second place
                at.sort()
                keep, last = [], -1
                for i, k in zip(at.tolist(), right[at].tolist(), strict=True):
                    if i != last:
                        keep.append(i)
                        last = k
                at = np.array(keep)
            if not len(at):
                continue
            j = right[at]
            k = right[j]
            sym[at], sym[j], right[at] = new, NEVER, k
            left[k] = at
            left[n] = n
            h = left[at]
            add(np.unique(np.concatenate((at, h[h != n]))))
        got, start = sym[:n], end - size
        many = np.concatenate(([0], np.cumsum(got != NEVER)))
        flat = got[got != NEVER].astype("<u4").tobytes()
        return [flat[x:y] for x, y in zip((4 * many[start]).tolist(), (4 * many[start + size]).tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Tokens of each text as little-endian unsigned 32-bit numbers."""
        parts = [self.split.split(t) if self.split and any(s in t for s in self.special) else [t] for t in texts]
        cut = [[[p] if k % 2 else self.words(p) for k, p in enumerate(ps)] for ps in parts]
        if len(self.known) > KNOWN:
            self.known.clear()
        known = self.known
        fresh = {w for ps in cut for k, ws in enumerate(ps) if k % 2 == 0 for w in ws if w not in known}
        fresh = sorted(fresh)
        for w, ids in zip(fresh, self.merge([w.encode() for w in fresh]), strict=True):
            known[w] = ids
        get = known.__getitem__
        return [b"".join(b"".join(map(get, ws)) if k % 2 == 0 else self.special[ws[0]].to_bytes(4, "little") for k, ws in enumerate(ps)) for ps in cut]

    def decode(self, ids: bytes) -> str:
        """The text of tokens; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


TOKENS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
TEXTS = pa.schema([*TOKENS, ("text", pa.string())])


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ``ids`` (binary: little-endian unsigned 32-bit tokens) of every row's whole text.

    A null text is empty, an empty one has no tokens; each row is a row of the result, repeated ids
    and a null doc_id included; other columns are ignored. Special tokens inside texts are recognised.
    There is no shuffle: the result is as large as the input's share of each task.
    """
    S.tune(docs.sparkSession)
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            texts, ids = b.column(1).to_pylist(), b.column(0)
            for i, j in S.chunks(texts, CHUNK):
                yield S.batch(TOKENS, ids[i:j], v.encode(texts[i:j]))

    return S.id_text(docs).mapInArrow(run, "doc_id long, ids binary")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and the ``text`` that the tokens stand for (null ids: empty)."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            yield S.batch(TEXTS, b.column(0), b.column(1), [v.decode(x or b"") for x in b.column(1).to_pylist()])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """encode() and decode() in one pass of the executors' Python: doc_id, ids, text (decoded from ids).

    One worker a core holds one vocabulary and one memory of words; a pass for each step takes three.
    """
    S.tune(docs.sparkSession)
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            texts, rows = b.column(1).to_pylist(), b.column(0)
            for i, j in S.chunks(texts, CHUNK):
                ids = v.encode(texts[i:j])
                yield S.batch(TEXTS, rows[i:j], ids, [v.decode(x) for x in ids])

    return S.id_text(docs).mapInArrow(run, "doc_id long, ids binary, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, computed from ids and decoded text."""
    return round_trip(docs, path).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(S.read(spark, sf_dir, "documents"))
