"""Extractive summaries: sentences ranked on their likeness graph, then chosen greedily."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import discourse, signal_score

# The ranking of sentences; weights of relevance, coverage, novelty and signals in the choice, of centrality in relevance;
# likeness from which a sentence repeats one that is chosen, least value of a choice; weights of the proxy that bounds candidates.
DAMPING, STEPS, TOLERANCE = 0.85, 50, 1e-4
CHOICE, CENTRALITY, REPEATS, LEAST = (0.50, 0.25, 0.15, 0.10), 0.80, 0.8, 0.35
PROXY = (0.60, 0.30, 0.10)
TERMS = re.compile(r"[a-z][a-z0-9_+-]+|[\u4e00-\u9fff]+")


class OptionsError(ValueError):
    """Options that no summary can be made with."""


@dataclass(frozen=True)
class Options:
    """What a summary is made with; checked when it is made. A threshold of None is not applied.

    top_k: sentences at most; similarity: bm25 or lexical (cosine of term counts); least: value that a choice needs; repeats: likeness from
    which a sentence repeats a chosen one; min_chars: characters of a sentence; window: characters that are read at once; text_form: raw
    or normalized (white space as single spaces); preserve_order: in order of the text, else of choice.
    """

    top_k: int = 8
    similarity: str = "bm25"
    least: float | None = LEAST
    repeats: float | None = REPEATS
    min_chars: int = 8
    window: int = 40_000
    text_form: str = "normalized"
    preserve_order: bool = True

    def __post_init__(self):
        wrong = {
            "top_k": self.top_k < 1, "similarity": self.similarity not in ("bm25", "lexical"), "min_chars": self.min_chars < 1, "window": self.window < 1_000, "text_form": self.text_form not in ("raw", "normalized"),
            "least": self.least is not None and not 0 <= self.least <= 1, "repeats": self.repeats is not None and not 0 <= self.repeats <= 1,
        }
        if any(wrong.values()):
            raise OptionsError(f"unfit: {', '.join(f'{n}={getattr(self, n)!r}' for n, w in wrong.items() if w)}")


def most_candidates(k: int) -> int:
    return max(256, min(1024, 2 * k))


def sentences(blocks: DataFrame) -> DataFrame:
    """doc_id, n (in order) and sentence of every block's sentences of at least three words."""
    s = F.regexp_extract_all("body", F.lit(r"([^.!?]+[.!?]?)"), 1)
    rows = blocks.select("doc_id", "pos", F.posexplode(s).alias("k", "sentence")).withColumn("sentence", F.trim("sentence")).where(F.size(F.split("sentence", " ")) >= 3)
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "k")).cast("long")).select("doc_id", "n", "sentence")


def portable_terms(text: str) -> list[str]:
    """Latin tokens; single Han characters and pairs of them."""
    out = []
    for t in TERMS.findall(text.lower()):
        out += [t] if t.isascii() else [*t, *(t[i : i + 2] for i in range(len(t) - 1))]
    return out


def likeness(texts: list[str], k1: float = 1.2, b: float = 0.75) -> np.ndarray:
    """Symmetric BM25 of each two texts on the terms they share, v / (1 + v); nothing on the diagonal."""
    terms = [portable_terms(t) for t in texts]
    names = {t: i for i, t in enumerate(dict.fromkeys(t for own in terms for t in own))}
    tf = np.zeros((len(texts), len(names)))
    np.add.at(tf, (np.repeat(np.arange(len(terms)), [len(t) for t in terms]), [names[t] for own in terms for t in own]), 1)
    has, size = (tf > 0).astype(float), tf.sum(1, keepdims=True)
    df = has.sum(0)
    part = np.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / max(size.mean(), 1e-9)) + (tf == 0))
    v = part @ has.T
    v = (v + v.T) / 2
    np.fill_diagonal(v, 0)
    return v / (1 + v)


def cosine(texts: list[str]) -> np.ndarray:
    """Cosine of the counts of portable terms; nothing on the diagonal."""
    terms = [portable_terms(t) for t in texts]
    names = {t: i for i, t in enumerate(dict.fromkeys(t for own in terms for t in own))}
    tf = np.zeros((len(texts), len(names)))
    np.add.at(tf, (np.repeat(np.arange(len(terms)), [len(t) for t in terms]), [names[t] for own in terms for t in own]), 1)
    tf /= np.maximum(np.sqrt((tf * tf).sum(1, keepdims=True)), 1e-300)
    out = np.clip(tf @ tf.T, 0, 1)
    np.fill_diagonal(out, 0)
    return out


def page_rank(weights: np.ndarray) -> np.ndarray:
    """Ranks by power iteration; a node without links spreads evenly."""
    n = len(weights)
    total = weights.sum(1, keepdims=True)
    step = np.where(total > 0, weights / np.where(total > 0, total, 1), 1 / n)
    rank = np.full(n, 1 / n)
    for _ in range(STEPS):
        new = (1 - DAMPING) / n + DAMPING * rank @ step
        if np.abs(new - rank).sum() < TOLERANCE:
            return new
        rank = new
    return rank


def choose(texts: list[str], told: np.ndarray, signal: np.ndarray, k: int, options: Options | None = None) -> list[int]:
    """Places of up to k sentences, in order of the text (or as ``options`` say), taken one at a time by relevance, what they cover, novelty and signals.

    ``told``: the discourse score of each, below which its relevance does not fall. What a sentence covers is the mean
    rise, over all sentences, of the greatest likeness to one that is chosen.
    """
    options = options or Options()
    alike = (likeness if options.similarity == "bm25" else cosine)(texts)
    least, repeats = (0.0 if options.least is None else options.least), (2.0 if options.repeats is None else options.repeats)
    rank = page_rank(alike)
    relevance = np.clip(np.maximum(CENTRALITY * rank / max(rank.max(), 1e-6), told), 0, 1)
    reach = alike + np.eye(len(texts))
    covered, near, free = np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
    chosen: list[int] = []
    while len(chosen) < min(k, len(texts)):
        gain = np.maximum(reach - covered, 0).mean(1)
        value = np.clip(np.stack((relevance, gain, 1 - near, signal), 1) @ CHOICE, 0, 1)
        value[~free | (near >= repeats) | (value < least)] = -1
        best = int(value.argmax())
        if value[best] < 0:
            break
        chosen.append(best)
        free[best] = False
        covered, near = np.maximum(covered, reach[best]), np.maximum(near, alike[best])
    return sorted(chosen) if options.preserve_order else chosen


def candidates(rows: DataFrame, most: int) -> DataFrame:
    """Of documents with more than ``most`` sentences (doc_id, n from 1, sentence, told, signal) three quarters of that by a proxy
    of their value, and a quarter evenly spaced from the first to the last; adds ``of``, how many there were."""
    own, few, spread = Window.partitionBy("doc_id"), most * 3 // 4, most - most * 3 // 4
    proxy = PROXY[0] * F.col("told") + PROXY[1] * F.col("signal") + PROXY[2] * F.least(F.length("sentence"), F.lit(100)) / 100
    rows = rows.withColumn("of", F.count("*").over(own)).withColumn("place", F.row_number().over(own.orderBy(F.desc(proxy), "n")))
    # The k-th of ``spread`` places is k (of - 1) / (spread - 1), rounded down: a place is one if the next k leads back to it.
    step = F.expr(f"((n - 1) * {spread - 1} + of - 2) div greatest(1, of - 1)")
    even = F.expr("n - 1") == F.floor(step * (F.col("of") - 1) / (spread - 1))
    return rows.where((F.col("of") <= most) | (F.col("place") <= few) | even).drop("place")


def summaries(blocks: DataFrame, k: int = 3, options: Options | None = None) -> DataFrame:
    """doc_id, n, sentence of each document's summary, and the document's number of sentences.

    A document's candidates are bounded (candidates()) before they meet in one group, so its matrix is bounded, too. ``options`` set
    the number of sentences, too; OptionsError if they are unfit.
    """
    k = options.top_k if options else k
    rows = sentences(blocks)
    if options:
        rows = rows.where(F.length("sentence") >= options.min_chars)
        rows = rows.withColumn("sentence", F.regexp_replace("sentence", r"\s+", " ")) if options.text_form == "normalized" else rows
    rows = rows.withColumn("told", discourse(F.col("sentence"))).withColumn("signal", signal_score(F.col("sentence")))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("n")
        return df.iloc[choose(df["sentence"].tolist(), df["told"].to_numpy(), df["signal"].to_numpy(), k, options)][["doc_id", "n", "sentence", "of"]]

    return candidates(rows, most_candidates(k)).groupBy("doc_id").applyInPandas(run, "doc_id long, n long, sentence string, of long")


def markdown_blocks(lines: DataFrame) -> DataFrame:
    """doc_id, block, kind, depth, first, last of Markdown lines (doc_id, pos, line): runs of lines of one kind.

    Kinds: code (fenced or indented), heading (also underlined), break, quote, list, table, paragraph. Headings, breaks
    and list items are blocks of their own; blank lines part blocks. ``depth`` is a heading's level or a list's indentation.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    line, after = F.col("line"), F.lead("line", 1, "").over(w)
    fence = line.rlike(r"^ {0,3}(?:```|~~~)")
    inside = F.sum(fence.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1
    kind = (
        F.when(fence | inside, "code").when(F.trim(line) == "", "blank").when(line.rlike(r"^#{1,6}\s"), "heading").when(line.rlike(r"^ {0,3}(?:=+|-+)\s*$") & (F.trim(F.lag("line", 1, "").over(w)) != ""), "underline")
        .when(line.rlike(r"^ {0,3}(?:[-*_]\s*){3,}$"), "break").when(line.rlike(r"^\s*>"), "quote").when(line.rlike(r"^\s*(?:[-+*]|[0-9]+[.)])\s"), "list").when(line.rlike(r"^\s*\|.*\|\s*$"), "table")
        .when(line.rlike(r"^ {4}\S"), "code").when(after.rlike(r"^ {0,3}(?:=+|-+)\s*$"), "heading").otherwise("paragraph")
    )
    depth = F.when(F.col("kind") == "heading", F.greatest(F.length(F.regexp_extract("line", r"^(#*)", 1)), F.lit(1))).when(F.col("kind") == "list", F.length(F.regexp_extract("line", r"^( *)", 1)) / 2).otherwise(0).cast("long")
    rows = lines.withColumn("kind", kind).withColumn("depth", depth)
    new = ~F.col("kind").eqNullSafe(F.lag("kind").over(w)) | F.col("kind").isin("heading", "break", "list")
    rows = rows.withColumn("block", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("kind not in ('blank', 'underline')")
    return rows.groupBy("doc_id", "block", "kind").agg(F.max("depth").alias("depth"), F.min("pos").alias("first"), F.max("pos").alias("last"))
