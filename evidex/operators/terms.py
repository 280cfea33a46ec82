"""Term statistics over blocks, documents and sections."""

from __future__ import annotations

import functools
import heapq
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .documents import lines_of, of_each

TERM = r"[a-z][a-z0-9_+-]+"


def term_rows(blocks: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and term, one row an occurrence."""
    return blocks.select(*keys, F.explode(F.regexp_extract_all(F.lower("body"), F.lit(f"({TERM})"), 1)).alias("term"))


def leaf_terms(blocks: DataFrame) -> DataFrame:
    """doc_id, pos, term, tf."""
    return term_rows(blocks, "doc_id", "pos").groupBy("doc_id", "pos", "term").agg(F.count("*").alias("tf"))


def rolled_up(leaves: DataFrame, *keys: str) -> DataFrame:
    """Exact bottom-up merge: sum of tf and number of leaves (support) of each term below ``keys``."""
    return leaves.groupBy(*keys, "term").agg(F.sum("tf").alias("tf"), F.count("*").alias("support"))


def keywords(stats: DataFrame, *keys: str, k: int = 12) -> DataFrame:
    """The k best terms by tf * max(1, support) * min(length, 8); ties by tf, support and term, all descending."""
    score = F.col("tf") * F.greatest(F.lit(1), F.col("support")) * F.least(F.length("term"), F.lit(8))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("tf"), F.desc("support"), F.desc("term"))
    return stats.withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


_TERM = re.compile(TERM)


def _counts(texts: list) -> tuple[Counter, Counter, int]:
    """tf and support (lines) of the terms in a document's texts, and how many lines hold a term."""
    lines = lines_of(texts, _TERM)
    return Counter(itertools.chain.from_iterable(lines.values())), Counter(itertools.chain.from_iterable(map(set, lines.values()))), len(lines)


def _lowered(docs: DataFrame, *more: str) -> DataFrame:
    return docs.where("text is not null").select("doc_id", F.lower("text").alias("text"), *more)


def keywords_of(docs: DataFrame, k: int = 12) -> DataFrame:
    """doc_id, rank, term, tf, support, score: keywords() of whole documents (doc_id, text), counted within each; no term is a row of a shuffle."""

    def found(own: list[list]):  # noqa: ANN202
        tf, support, _ = _counts(own[0])
        if best := heapq.nlargest(k, ((n * support[t] * min(len(t), 8), n, support[t], t) for t, n in tf.items())):
            score, n, lines, term = zip(*best, strict=True)
            yield range(1, len(best) + 1), term, n, lines, score

    return of_each(_lowered(docs), ["doc_id"], found, "rank long, term string, tf long, support long, score long")


def weighted_terms_of(docs: DataFrame, k: int = 12) -> DataFrame:
    """doc_id, rank, term, support, score: the k best terms of a document by tf * support * support; ties by support, then the smaller term."""

    def found(own: list[list]):  # noqa: ANN202
        tf, support, _ = _counts(own[0])
        if best := heapq.nsmallest(k, ((-n * support[t] * support[t], -support[t], t) for t, n in tf.items())):
            score, lines, term = zip(*best, strict=True)
            yield range(1, len(best) + 1), term, [-n for n in lines], [-x for x in score]

    return of_each(_lowered(docs), ["doc_id"], found, "rank long, term string, support long, score long")


def section_terms(docs: DataFrame, section: str) -> DataFrame:
    """``section`` (a column), term, tf, support (documents): counted within each document first. A document in several rows counts, whole, in the section of each."""

    def found(own: list[list]):  # noqa: ANN202
        tf = _counts(own[0])[0]
        for s in own[1]:
            yield [s] * len(tf), list(tf), list(tf.values())

    # A text that is null may have a section, too.
    rows = docs.where("doc_id is not null").select("doc_id", F.lower("text").alias("text"), F.col(section).alias("section"))
    own = of_each(rows, ["doc_id"], found, f"section {dict(docs.dtypes)[section]}, term string, tf long")
    return own.groupBy(F.col("section").alias(section), "term").agg(F.sum("tf").alias("tf"), F.count("*").alias("support"))


def document_frequency(leaves: DataFrame) -> DataFrame:
    """term, df (leaves), docs and idf over all leaves."""
    n = leaves.select("doc_id", "pos").distinct().agg(F.count("*").alias("n"))
    df = leaves.groupBy("term").agg(F.count("*").alias("df"), F.countDistinct("doc_id").alias("docs"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", "docs", F.round(F.log(1 + (F.col("n") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


def follower_entropy(blocks: DataFrame, *keys: str) -> DataFrame:
    """``keys``, term, tf and the entropy of what follows the term (the next term, or <EOS> at the end of its block)."""
    words = F.regexp_extract_all(F.lower("body"), F.lit(f"({TERM})"), 1)
    after = F.concat(F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))), F.array(F.lit("<EOS>")))
    pairs = blocks.select(*keys, words.alias("w")).select(*keys, F.inline(F.zip_with("w", after, lambda t, n: F.struct(t.alias("term"), n.alias("next"))))).where("term is not null")
    n = pairs.groupBy(*keys, "term", "next").agg(F.count("*").alias("n"))
    # The entropy from sums that combine before the shuffle: ln(N) - sum(n ln n) / N.
    return n.groupBy(*keys, "term").agg(F.sum("n").alias("tf"), F.round(F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n"), 5).alias("entropy"))


def sketches(blocks: DataFrame, most: int = 360) -> DataFrame:
    """First sentence of each line of a document, distinct, in order, joined and cut to ``most`` characters."""
    first = F.regexp_extract("body", r"^[^.!?]*[.!?]?", 0)
    rows = blocks.select("doc_id", "pos", first.alias("s")).groupBy("doc_id", "s").agg(F.min("pos").alias("pos"))
    ordered = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("x"))
    return ordered.select("doc_id", F.substring(F.array_join(F.transform("x", lambda r: r["s"]), " "), 1, most).alias("sketch"))


def simhash(blocks: DataFrame, *keys: str, bits: int = 32) -> DataFrame:
    """``keys`` (doc_id) and a signed-counter SimHash of their terms' digests, of 32 or 64 bits; keys without a term have no row."""
    keys = keys or ("doc_id",)
    terms = term_rows(blocks, *keys).groupBy(*keys, "term").agg(F.count("*").alias("n"))
    digest = F.md5("term")
    # Words of 32 bits, the last one first, so that 32 bits are the digest's beginning.
    words = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i}") for i in reversed(range(bits // 32))]
    terms = terms.select(*keys, "n", *words)
    word = lambda b: F.col(f"h{bits // 32 - 1 - b // 32}").bitwiseAND(F.lit(1 << b % 32)) != 0
    out = terms.groupBy(*keys).agg(*[F.sum(F.when(word(b), F.col("n")).otherwise(-F.col("n"))).alias(f"b{b}") for b in range(bits)])
    value = lambda b: F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long")
    return out.select(*keys, functools.reduce(Column.bitwiseOR, (F.when(F.col(f"b{b}") >= 0, value(b)).otherwise(F.lit(0).cast("long")) for b in range(bits))).alias("simhash"))


#: Entries of a lexicon that are sent to the executors at most, at some 30 bytes each; of a larger one each text gets its own by a join.
LEXICON = 16_000_000
#: Places of a batch of texts that are filled in at once, times the longest entry.
CELLS = 1 << 22
#: What a character that no entry holds counts, beside the rarest entry.
UNKNOWN = 5.0


def best_path(text: str, weight: dict[str, float], longest: int, unknown: float) -> list[str]:
    """The words of a text by the best path through the graph of entries that occur in it: the highest sum of weights.

    A character may stand alone at ``unknown``; of equal paths the one whose last word is longest, from the end on.
    """
    best, back = [0.0], [0]
    for end in range(1, len(text) + 1):
        top, at = best[end - 1] + weight.get(text[end - 1], unknown), end - 1
        for start in range(max(0, end - longest), end - 1):
            w = weight.get(text[start:end])
            if w is not None and (best[start] + w > top or (best[start] + w == top and start < at)):
                top, at = best[start] + w, start
        best.append(top)
        back.append(at)
    out, end = [], len(text)
    while end:
        out.append(text[back[end] : end])
        end = back[end]
    return out[::-1]


class Table:
    """Entries by two hashes of 64 bits each: sorted by the first, found by its leading bits, and told by both."""

    def __init__(self, first: np.ndarray, second: np.ndarray, weight: np.ndarray, longest: int):
        order = np.argsort(first)
        self.first, self.second, self.weight, self.longest = first[order], second[order], weight[order], longest
        self.bits = max(1, int(len(order)).bit_length())
        self.starts = np.searchsorted(self.first, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)
        self.starts = np.append(self.starts, np.int32(len(order)))
        self.most = int(np.diff(self.starts).max())
        # One bit of sixteen or more an entry, so that most of what is no entry is told at once.
        self.mask = np.uint64((1 << (self.bits + 4)) - 1)
        seen = np.zeros(1 << (self.bits + 4), bool)
        seen[(self.second & self.mask).astype(np.int64)] = True
        self.seen = np.packbits(seen, bitorder="little")

    @staticmethod
    def keys(n: int) -> np.ndarray:
        return np.random.default_rng(20_992).integers(0, 1 << 64, (2, n + 1), dtype=np.uint64) | np.uint64(1)

    @staticmethod
    def points(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)

    def found(self, points: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length, starts and weights of the entries in joined texts; left: how many characters of its text each place has, itself included."""
        keys = self.keys(self.longest)
        h = [np.full(len(points), keys[i, -1]) for i in (0, 1)]
        for size in range(1, self.longest + 1):
            n = len(points) - size + 1
            if n < 1:
                return
            for i in (0, 1):
                h[i] = h[i][:n] + keys[i, size - 1] * points[size - 1 :]
            low = h[1] & self.mask
            at = np.flatnonzero((self.seen[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 & (left[:n] >= size))
            bucket = (h[0][at] >> np.uint64(64 - self.bits)).astype(np.int64)
            place, end = self.starts[bucket].astype(np.int64), self.starts[bucket + 1]
            starts, weights = [], []
            for _ in range(self.most):
                on = place < end
                at, place, end = at[on], place[on], end[on]
                if not len(at):
                    break
                same = (self.first[place] == h[0][at]) & (self.second[place] == h[1][at])
                starts.append(at[same])
                weights.append(self.weight[place[same]])
                at, place, end = at[~same], place[~same] + 1, end[~same]
            if starts:
                yield size, np.concatenate(starts), np.concatenate(weights)


def hashed(lexicon: DataFrame, longest: int) -> DataFrame:
    """first, second (hashes, as longs) and w of a lexicon (entry, w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = Table.keys(longest)
        for b in batches:
            points = [Table.points(e) for e in b.column(0).to_pylist()]
            h = [(np.array([(keys[i, : len(p)] * p).sum(dtype=np.uint64) for p in points], np.uint64) + keys[i, -1]).view(np.int64) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, h), b.column(1)], names=["first", "second", "w"])

    return lexicon.select("entry", "w").mapInArrow(run, "first long, second long, w double")


def best_paths(texts: list[str], table: Table, unknown: float) -> list[list[str]]:
    """best_path() of each text; texts of similar length take each step together."""
    out: list[list[str]] = [[] for _ in texts]
    todo = sorted((i for i, t in enumerate(texts) if t), key=lambda i: -len(texts[i]))
    k, at = table.longest, 0
    while at < len(todo):
        width = len(texts[todo[at]])
        some = todo[at : at + max(1, CELLS // (k * width))]
        at += len(some)
        sizes = np.array([len(texts[i]) for i in some])
        points = Table.points("".join(texts[i] for i in some))
        base = np.cumsum(sizes) - sizes
        text = np.repeat(np.arange(len(some)), sizes)
        place = np.arange(len(points)) - base[text]
        matches = table.found(points, sizes[text] - place)
        if len(some) < 4 and width > 2_000:  # few and long: a step for each would cost more than the lookups
            own: list[dict] = [{} for _ in some]
            for size, starts, weights in matches:
                for x, p, w in zip(text[starts].tolist(), place[starts].tolist(), weights.tolist(), strict=True):
                    own[x][texts[some[x]][p : p + size]] = w
            for i, found in zip(some, own, strict=True):
                out[i] = best_path(texts[i], found, k, unknown)
            continue
        # weight[text, end - 1, k - size]: of what ends there; best[text, k - 1 + end]
        weight = np.full((len(some), width, k), -np.inf)
        weight[:, :, k - 1] = unknown
        for size, starts, weights in matches:
            weight[text[starts], place[starts] + size - 1, k - size] = weights
        best = np.full((len(some), k + width), -np.inf)
        best[:, k - 1] = 0.0
        size_of = np.zeros((len(some), width), np.int32)
        active = np.searchsorted(-sizes, -np.arange(1, width + 1), side="right")  # texts that reach this end: the first ones
        row = np.arange(len(some))
        for end in range(width):
            m = active[end]
            value = best[:m, end : end + k] + weight[:m, end]
            top = value.argmax(1)  # of equal ones the longest
            best[:m, k + end] = value[row[:m], top]
            size_of[:m, end] = k - top
        for x, i in enumerate(some):
            t, back, end, words = texts[i], size_of[x].tolist(), len(texts[i]), []
            while end:
                start = end - back[end - 1]
                words.append(t[start:end])
                end = start
            out[i] = words[::-1]
    return out


def segmented(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """id and words (array) of texts (id, text) without spaces, by a lexicon (entry, n: how often it occurs).

    An entry weighs the logarithm of its share. A null or empty text has no words. Entries are sent as hashes of 128 bits, never as cuts of the
    texts that are joined, up to LEXICON of them.
    """
    n, total, longest, rarest = lexicon.agg(F.count("*"), F.sum("n"), F.max(F.length("entry")), F.min("n")).first()
    rows = texts.select("id", F.coalesce("text", F.lit("")).alias("text"))
    if not n:
        return rows.select("id", F.filter(F.split("text", ""), lambda c: c != "").alias("words"))
    unknown = math.log(rarest / total) - UNKNOWN
    weighed = lexicon.select("entry", F.log(F.col("n") / total).alias("w"))
    kind, names = dict(texts.dtypes)["id"], ["id", "words"]
    if n <= LEXICON:
        sent = hashed(weighed, longest).toArrow()
        first, second, w = (c.to_numpy() for c in sent.columns)
        table = texts.sparkSession.sparkContext.broadcast(Table(first.view(np.uint64), second.view(np.uint64), w, longest))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best_paths(b.column(1).to_pylist(), table.value, unknown), pa.list_(pa.string()))], names=names)

        return rows.mapInArrow(run, f"id {kind}, words array<string>")
    size = F.length("text")
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda k: F.substring("text", i, k))))
    met = rows.select("id", F.explode(F.array_distinct(cuts)).alias("entry")).distinct().join(weighed, "entry")
    rows = rows.join(met.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("entry", "w"))).alias("found")), "id", "left")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [best_path(t, dict(f or ()), longest, unknown) for t, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.string()))], names=names)

    return rows.select("id", "text", "found").mapInArrow(joined, f"id {kind}, words array<string>")
