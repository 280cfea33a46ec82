"""Word and shingle hashes of many texts at once, in numpy.

A word is a run of bytes other than ASCII white space; A-Z count as a-z. The hash of a word is a
polynomial of random 64-bit letters, computed for all words of a block from one running sum, and
mixed. All sums wrap modulo 2**64 and the base is odd, so that its powers can be inverted.
"""

from __future__ import annotations

import functools

import numpy as np

U = np.uint64
BASE, INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
BLOCK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@functools.cache
def _letters() -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
    t[65:91] = t[97:123]
    return t


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, BLOCK + 4096)
        for k, p in enumerate((BASE, INVERSE)):
            a = np.full(n, p, U)
            a[0] = 1
            a = np.multiply.accumulate(a)
            _POWERS[k : k + 1] = [a]
    return _POWERS[0], _POWERS[1]


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes) and hash of each word."""
    whole = np.frombuffer(data, np.uint8)
    gaps = SPACE[whole]
    found, at = [], 0
    while at < len(whole):
        end = min(len(whole), at + BLOCK)
        while end < len(whole) and not gaps[end]:  # to the end of the word
            step = gaps[end : end + 4096]
            end += int(step.argmax()) if step.any() else len(step)
        gap = np.concatenate(([True], gaps[at:end], [True]))
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        s, e = edge[::2], edge[1::2]
        if len(s):
            up, down = _powers(end - at)
            run = np.zeros(end - at + 1, U)
            np.cumsum(_letters()[whole[at:end]] * up[: end - at], out=run[1:])
            found.append((s + at, e + at, mix((run[e] - run[s]) * down[s] + (e - s).astype(U))))
        at = end
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def many(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's begin (one more at the end)."""
    starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)
    s, _, h = words(b"\n".join(texts))
    return h, np.searchsorted(s, starts)


def shingles(h: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of k words, and where each text's begin.

    A text of fewer words, but some, has one: all its words. One of none has none.
    """
    n = np.diff(off)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out = np.concatenate(([0], np.cumsum(count)))
    acc = np.zeros(max(0, len(h) - k + 1), U)
    for j in range(k):
        acc += mix(h[j : j + len(acc)] + U(j + 1)) * U(2 * j + 1)
    first = off[:-1]
    place = np.arange(out[-1]) - np.repeat(out[:-1] - first, count)
    short = (n < k) & (n > 0)
    if short.any():
        got = np.zeros(len(place), U)
        long_rows = np.repeat(~short, count)
        got[long_rows] = acc[place[long_rows]]
        for i in np.flatnonzero(short):
            got[out[i]] = sum((int(mix(h[off[i] + j : off[i] + j + 1] + U(j + 1))[0]) * (2 * j + 1) for j in range(n[i])), int(n[i])) & (2**64 - 1)
    else:
        got = acc[place]
    return mix(got), out


def running(h: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Running (Karp-Rabin) hashes of each text's runs of k words, and where each text's begin; fewer words: none.

    One sum runs over all words, each times a power of the base; a window's hash is the difference of the sum at
    its two ends, brought to the same power, so that each step costs the same however long the window is.
    """
    count = np.maximum(np.diff(off) - k + 1, 0)
    out = np.concatenate(([0], np.cumsum(count)))
    place = np.arange(out[-1]) - np.repeat(out[:-1] - off[:-1], count)
    found = np.zeros(len(place), U)
    for at in range(0, max(0, len(h) - k + 1), BLOCK):  # the powers stay few
        end = min(len(h), at + BLOCK + k - 1)
        up, down = _powers(end - at)
        total = np.zeros(end - at + 1, U)
        np.cumsum(h[at:end] * up[: end - at], out=total[1:])
        lo, hi = np.searchsorted(place, (at, at + BLOCK))
        p = place[lo:hi] - at
        found[lo:hi] = (total[p + k] - total[p]) * down[p]
    return mix(found), out
