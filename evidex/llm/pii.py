"""Personal data: rules and a character-level BiLSTM-CRF (operator 5).

The rules find what follows the usual written forms. The tagger adds what it is sure of in other forms.
A span of any kind contains a digit, an at sign or a cue of one that is written out (CUES), and reaches at most REACH
characters from one, so only the stretches around those are tagged. A stretch is cut into overlapping windows; each
character's scores are those of the windows it stands in, weighed by how far it is from their edges, and one
path of tags is decoded over the whole stretch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spark as S
from . import tagger as T

#: Characters of context on either side of an anchor; windows decoded at once.
REACH, AT_ONCE = T.LENGTH, 1024
#: Probability that each character's tag must have for a span to be added; chosen on labelled texts with decoys made by another seed.
SURE = 0.7
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CHAIN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
PART = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+")
ANCHOR = re.compile(r"[0-9@]")
#: At signs and full stops that are written out: what a text must contain, and where it counts.
CUES = (
    ("dot", re.compile(r"(?<![A-Za-z])dot(?![A-Za-z])")), ("DOT", re.compile(r"(?<![A-Za-z])DOT(?![A-Za-z])")),
    ("(", re.compile(r"\( ?(?:at|AT) ?\)")), ("[", re.compile(r"\[ ?(?:at|AT) ?\]")), (" at ", re.compile(r" at (?=[A-Za-z0-9-]+\.[A-Za-z])")),
)
#: An address with its signs written out: local part, at sign, host.
WORD = r"[A-Za-z0-9._%+-]+"
STOP = r"(?: ?[(\[]?(?:dot|DOT|\.)[)\]]? ?)"
SPELT = re.compile(rf"({WORD}(?:{STOP}{WORD})*?)( ?[(\[] ?(?:@|at|AT) ?[)\]] ?| @ | (?:at|AT) |@)([A-Za-z0-9-]+(?:{STOP}[A-Za-z0-9-]+)+)")
#: Characters of a stretch that are decoded as one path at most; a longer one is cut where nothing stands, surest.
LONG = 4096


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at sign back over its local part and on over its domain: linear in the text."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Groups of four parts of each maximal chain of numbers and full stops."""
    for chain in CHAIN.finditer(text):
        parts = [*PART.finditer(text, *chain.span())]
        for i in range(0, len(parts) - 3, 4):
            if all(len(n := p[0].lstrip("0")) <= 3 and int(n or 0) <= 255 for p in parts[i : i + 4]):
                yield parts[i].start(), parts[i + 3].end()


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for i, d in enumerate(reversed(digits))) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        s = m[0].rstrip(" ().-")
        if len(s) >= 4 and 9 <= sum(c.isdigit() for c in s) <= 15:
            yield m.start(), m.start() + len(s)


RULES = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def base(text: str) -> list[tuple[str, int, int]]:
    """Spans by the rules: kind, start, end (code points), by kind and start."""
    found = {k: () for k in T.KINDS}
    if "@" in text:
        found["email"] = emails(text)
    if "+" in text:
        found["phone"] = phones(text)
    if ANCHOR.search(text):
        found["ip"], found["card"] = ips(text), cards(text)
    return [(k, a, b) for k in T.KINDS for a, b in found[k]]


def anchors(text: str) -> list[int]:
    """Places of digits, at signs and cues, ascending."""
    out = [m.start() for m in ANCHOR.finditer(text)]
    more = [m.start() for cue, pattern in CUES if cue in text for m in pattern.finditer(text)]
    return sorted(out + more) if more else out


def stretches(text: str) -> list[tuple[int, int]]:
    """Ranges around anchors, joined where they touch."""
    out: list[list[int]] = []
    for at in anchors(text):
        a, b = max(0, at - REACH), min(len(text), at + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def plausible(kind: str, s: str) -> bool:
    """Whether a tagged string has what its kind needs."""
    digits = sum(c in "0123456789" for c in s)
    if kind == "email":
        if not (m := SPELT.fullmatch(s)) or len(s) < 6 or not s[-1].isalnum():
            return False
        # "look at this.example" is no address: a bare "at" takes a written-out stop, or a local part with a sign or digit.
        return m[2].strip().lower() != "at" or bool(re.search("dot", s, re.I) or re.search("[._0-9]", m[1]))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= digits <= 19 and s[0] in "3456" and s[-1] in "0123456789" and not re.search(r"[A-Za-z]", s)
    return 9 <= digits <= 15 and s[-1] in "0123456789" and not re.search(r"[A-Za-z]", s)


class Tagger:
    """Spans of many texts by the trained weights."""

    def __init__(self, weights: T.Weights, sure: float = SURE):
        self.w, self.sure = weights, sure

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Scores of the tags of windows."""
        return np.concatenate([T.lstm(self.w, rows[i : i + AT_ONCE]) for i in range(0, len(rows), AT_ONCE)]).astype(np.float64)

    def paths(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best path of each row of scores and the probability of each of its tags."""
        move = self.w.move.astype(np.float64)
        path = T.viterbi(move, score)
        p, _, _ = T.marginals(move, score)
        return path, np.take_along_axis(p, path[:, :, None], 2)[:, :, 0]

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """Plausible spans of each text."""
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        todo: list[tuple[int, int, int, np.ndarray]] = []
        size = 0
        for d, text in enumerate(texts):
            for a, b in stretches(text):
                x = T.codes(text[a:b])
                todo.append((d, a, b, x))
                size += len(x)
                if size > 1 << 17:
                    self._decode(texts, todo, out)
                    todo, size = [], 0
        self._decode(texts, todo, out)
        return out

    def _decode(self, texts: list[str], todo: list, out: list) -> None:
        if not todo:
            return
        half, starts = T.LENGTH // 2, []
        for _, _, _, x in todo:
            starts.append(list(range(0, max(1, len(x) - half), half)))
        rows = np.zeros((sum(map(len, starts)), T.LENGTH), np.int64)
        k = 0
        for (_, _, _, x), s in zip(todo, starts, strict=True):
            for at in s:
                part = x[at : at + T.LENGTH]
                rows[k, : len(part)] = part
                k += 1
        score = self.scores(rows)
        inward = np.minimum(np.arange(T.LENGTH) + 1, np.arange(T.LENGTH, 0, -1)).astype(float)
        pieces, k = [], 0
        for (d, a, _, x), s in zip(todo, starts, strict=True):
            total, weight = np.zeros((len(x), T.TAGS)), np.zeros(len(x))
            for i, at in enumerate(s):
                n = min(T.LENGTH, len(x) - at)
                total[at : at + n] += inward[:n, None] * score[k + i, :n]
                weight[at : at + n] += inward[:n]
            k += len(s)
            total /= weight[:, None]
            while len(total) > LONG:
                outside = total[LONG - T.LENGTH : LONG, 0] - total[LONG - T.LENGTH : LONG, 1:].max(1)
                cut = LONG - T.LENGTH + int(outside.argmax()) + 1
                pieces.append((d, a, total[:cut]))
                a, total = a + cut, total[cut:]
            pieces.append((d, a, total))
        pieces.sort(key=lambda p: len(p[2]))
        while pieces:  # pieces of about one length are decoded together
            longest = len(pieces[-1][2])
            n = next((i for i in range(1, len(pieces)) if (i + 1) * longest > 1 << 16 or len(pieces[-1 - i][2]) < 0.7 * longest), len(pieces))
            some, pieces = pieces[-n:], pieces[:-n]
            padded = np.full((n, longest, T.TAGS), -20.0)
            padded[:, :, 0] = 20.0
            for row, (_, _, x) in zip(padded, some, strict=True):
                row[: len(x)] = x
            for (d, a, x), path, sure in zip(some, *self.paths(padded), strict=True):
                out[d] += self._read(texts[d], a, path[: len(x)], sure[: len(x)])

    def _read(self, text: str, a: int, tag: np.ndarray, p: np.ndarray) -> Iterator[tuple[str, int, int]]:
        """The plausible spans of a path that begins at place a of the text."""
        begins = np.flatnonzero(tag % 2 == 1)
        for i in begins.tolist():
            kind, j = (int(tag[i]) - 1) // 2, i + 1
            while j < len(tag) and tag[j] == 2 + 2 * kind:
                j += 1
            if p[i:j].min() >= self.sure and plausible(T.KINDS[kind], text[a + i : a + j]):
                left, right = text[a + i - 1 : a + i] if a + i else "", text[a + j : a + j + 1]
                if not (left.isalnum() or right.isalnum()):
                    yield T.KINDS[kind], a + i, a + j


def written(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end of each span, by kind as listed, then start; joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (T.KINDS.index(s[0]), s[1], s[2])))


def find(docs: DataFrame, sure: float = SURE, weights: T.Weights | None = None) -> DataFrame:
    """doc_id, base (spans by the rules, as text) and spans (these and what the tagger adds) of every row.

    Offsets count code points, ends are exclusive. A tagged span that touches one of the rules' is not
    added. A null or empty text has no spans; repeated rows and null ids are kept; other columns are
    ignored. Long texts are tagged stretch by stretch. No shuffle; the weights are some 60 KB.
    """
    S.tune(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("base", pa.string()), ("spans", pa.string())])
    weights = weights or T.train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(weights, sure)
        for b in batches:
            texts, bases, every = b.column(1).to_pylist(), [], []
            for i, j in S.chunks(texts):
                for text, more in zip(texts[i:j], tagger.spans(texts[i:j]), strict=True):
                    own = base(text)
                    bases.append(written(own))
                    every.append(written(own + [m for m in more if all(m[2] <= a or m[1] >= e for _, a, e in own)]))
            yield S.batch(schema, b.column(0), bases, every)

    return S.id_text(docs).mapInArrow(run, "doc_id long, base string, spans string")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(S.read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter(F.split("base", ","), lambda x: F.startswith(x, F.lit(f"{kind}:")))).cast("long").alias(f"n_{kind}")
    n_all = F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).cast("long")
    return found.select("doc_id", *map(count, T.KINDS), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", n_all.alias("n_spans"))
