"""A character-level bidirectional LSTM with CRF transitions in numpy: training and decoding."""

from __future__ import annotations

import functools
import random
from typing import NamedTuple

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: Tags: outside, and for each kind the first and a further character.
TAGS = 1 + 2 * len(KINDS)
HIDDEN, LENGTH = 16, 96
#: Labelled windows, passes over them, windows a step, rate of Adam, seed.
WINDOWS, PASSES, BATCH, RATE, SEED = 4500, 9, 48, 0.02, 7
#: Characters: padding, each printable ASCII character, white space, other letters, others.
SIZE = 1 + 95 + 3
_ASCII = np.full(128, 98)
_ASCII[32:127] = np.arange(1, 96)
_ASCII[[9, 10, 11, 12, 13]] = 96


def codes(text: str) -> np.ndarray:
    """A number below SIZE for each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full(len(points), 98)
    plain = points < 128
    out[plain] = _ASCII[points[plain]]
    for i in np.flatnonzero(~plain).tolist():
        c = text[i]
        out[i] = 97 if c.isalpha() else 96 if c.isspace() else 98
    return out


class Weights(NamedTuple):
    """w: (2, SIZE, 4 HIDDEN) input of either direction; u: recurrent; o: (2, HIDDEN, TAGS); b; move: (TAGS, TAGS)."""

    w: np.ndarray
    u: np.ndarray
    o: np.ndarray
    b: np.ndarray
    move: np.ndarray


#: A further character only follows the first or a further one of its kind.
BARRED = np.zeros((TAGS, TAGS))
for _k in range(len(KINDS)):
    BARRED[:, 2 + 2 * _k] = -1e4
    BARRED[1 + 2 * _k, 2 + 2 * _k] = BARRED[2 + 2 * _k, 2 + 2 * _k] = 0
FIRST = np.where(np.arange(TAGS) % 2 + (np.arange(TAGS) == 0) > 0, 0.0, -1e4)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def lstm(p: Weights, x: np.ndarray, keep: bool = False):
    """Tag scores (rows, LENGTH, TAGS) of rows of codes; with ``keep`` also what training needs."""
    n, t = x.shape
    both = np.stack((x, x[:, ::-1]))
    h, c = np.zeros((2, n, HIDDEN), p.w.dtype), np.zeros((2, n, HIDDEN), p.w.dtype)
    hs, kept = np.empty((t, 2, n, HIDDEN), p.w.dtype), []
    side = np.arange(2)[:, None]
    for i in range(t):
        z = p.w[side, both[:, :, i]] + h @ p.u
        s, g = _sigmoid(z[..., : 3 * HIDDEN]), np.tanh(z[..., 3 * HIDDEN :])
        new = s[..., HIDDEN : 2 * HIDDEN] * c + s[..., :HIDDEN] * g
        r = np.tanh(new)
        if keep:
            kept.append((s, g, c, r, h))
        c, h = new, s[..., 2 * HIDDEN :] * r
        hs[i] = h
    out = np.einsum("tnh,hk->ntk", hs[:, 0], p.o[0]) + np.einsum("tnh,hk->ntk", hs[::-1, 1], p.o[1]) + p.b
    return (out, both, hs, kept) if keep else out


def marginals(move: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(tag) at each place, the sums of P(pair of tags) and the logarithm of the sum over all paths."""
    n, t, k = score.shape
    step = np.exp(move + BARRED)
    e = np.exp(score - score.max(2, keepdims=True))
    top = score.max(2)
    a, scale = np.empty((t, n, k)), np.empty((t, n))
    for i in range(t):
        v = e[:, i] * (np.exp(FIRST) if i == 0 else a[i - 1] @ step)
        scale[i] = v.sum(1)
        a[i] = v / scale[i][:, None]
    b = np.ones((t, n, k))
    pairs = np.zeros((k, k))
    for i in range(t - 2, -1, -1):
        v = e[:, i + 1] * b[i + 1] / scale[i + 1][:, None]
        pairs += a[i].T @ v
        b[i] = v @ step.T
    return (a * b).transpose(1, 0, 2), pairs * step, np.log(scale).sum(0) + top.sum(1)


def viterbi(move: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The best path of each row."""
    n, t, k = score.shape
    step, best = move + BARRED, score[:, 0] + FIRST
    back = np.empty((t, n, k), np.int8)
    for i in range(1, t):
        all_ = best[:, :, None] + step
        back[i] = all_.argmax(1)
        best = all_.max(1) + score[:, i]
    out = np.empty((n, t), np.int64)
    out[:, -1] = best.argmax(1)
    for i in range(t - 1, 0, -1):
        out[:, i - 1] = back[i][np.arange(n), out[:, i]]
    return out


def gradient(p: Weights, x: np.ndarray, y: np.ndarray) -> tuple[float, Weights]:
    """Mean loss a row (negative log-likelihood of the paths y) and its gradient."""
    n, t = x.shape
    score, both, hs, kept = lstm(p, x, keep=True)
    prob, pairs, total = marginals(p.move, score)
    rows, at = np.arange(n)[:, None], np.arange(t)
    gold = score[rows, at, y].sum(1) + (p.move + BARRED)[y[:, :-1], y[:, 1:]].sum(1)
    d = prob.copy()
    d[rows, at, y] -= 1
    d /= n
    g_move = pairs / n
    np.add.at(g_move, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1 / n)
    g = Weights(np.zeros_like(p.w), np.zeros_like(p.u), np.stack((np.einsum("tnh,ntk->hk", hs[:, 0], d), np.einsum("tnh,ntk->hk", hs[::-1, 1], d))), d.sum((0, 1)), g_move)
    down = np.stack((d @ p.o[0].T, d[:, ::-1] @ p.o[1].T))  # (2, n, t, h) in each direction's order
    dh, dc = np.zeros((2, n, HIDDEN)), np.zeros((2, n, HIDDEN))
    flat = g.w.reshape(-1, 4 * HIDDEN)
    for i in range(t - 1, -1, -1):
        s, c_in, c_old, r, h_old = kept[i]
        dh = dh + down[:, :, i]
        o = s[..., 2 * HIDDEN :]
        dc = dc + dh * o * (1 - r * r)
        ds = np.concatenate((dc * c_in, dc * c_old, dh * r), 2) * s * (1 - s)
        dz = np.concatenate((ds, dc * s[..., :HIDDEN] * (1 - c_in * c_in)), 2)
        np.add.at(flat, both[:, :, i] + np.array([[0], [SIZE]]), dz)
        g.u[:] += h_old.transpose(0, 2, 1) @ dz
        dh = dz @ p.u.transpose(0, 2, 1)
        dc = dc * s[..., HIDDEN : 2 * HIDDEN]
    return float((total - gold).mean()), g


def _word(r: random.Random) -> str:
    parts = r.choice((("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"), ("en", "er", "ch", "ei", "un", "ge", "st", "ü", "ß", "lich"), ("é", "è", "que", "ou", "ai", "le", "ment", "tion"), ("ción", "es", "o", "a", "ñ", "ar", "mente")))
    w = _name(r) if r.random() < 0.2 else "".join(r.choices(parts, k=r.randint(1, 4)))
    w = w.capitalize() if r.random() < 0.1 else w.upper() if r.random() < 0.05 else w
    return w + r.choice(("", "", "", "", "", ",", ".", ":", "!!", "%%%", ")"))


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choices("0123456789", k=n))


def _name(r: random.Random) -> str:
    """Letters at random or consonants and vowels in turn, as names and hosts have them."""
    if r.random() < 0.4:
        return "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9)))
    ends = "bcdfghjklmnprstvwxz"
    return "".join(r.choice(("", "", "s", "st", "m")) + r.choice(ends) + r.choice(("a", "e", "i", "o", "u", "ai", "ee", "y")) for _ in range(r.randint(1, 3))) + r.choice(("", "n", "th", "r", "l", "x", "ple"))


def example(r: random.Random, kind: str) -> str:
    """A labelled span of a kind, in one of the ways people write it."""
    if kind == "email":
        local = r.choice(("{a}.{b}", "{a}", "{a}{n}", "{a}_{b}", "{a}.{n}", "{a}+{b}")).format(a=_name(r), b=_name(r), n=r.randint(1, 99))
        host = ".".join([_name(r) + r.choice(("", "", str(r.randint(1, 9)))), *([_name(r)] if r.random() < 0.4 else []), r.choice(("com", "org", "net", "de", "fr", "es", "io"))])
        if r.random() < 0.55:
            at = r.choice(("@", "@", "@", " @ ", "(@)", "[@]"))
            return local + at + (host if r.random() < 0.75 else host.replace(".", r.choice((" dot ", "(dot)", "[.]", " . "))))
        at, dot = r.choice(((" at ", " dot "), (" at ", " dot "), (" (at) ", " (dot) "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" AT ", " DOT "), (" (at) ", "."), ("[at]", ".")))
        return (local.replace(".", dot) if r.random() < 0.3 else local) + at + host.replace(".", dot)
    if kind == "ip":
        parts = [str(r.randint(0, 255)) for _ in range(4)]
        return r.choice((".", ".", ".", "[.]", "(.)", " . ")).join(parts)
    if kind == "card":
        d = r.choice("3456") + _digits(r, 15)
        sep = r.choice(("", "", " ", "-", ".", "/"))
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))
    a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    return r.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{r.randint(20, 99)} {a} {b} {c}", f"00{r.randint(20, 99)} {a} {b}{c}", f"0{_digits(r, 2)} {_digits(r, 2)} {_digits(r, 2)} {_digits(r, 2)} {_digits(r, 2)}", f"+{r.randint(20, 99)}/{a}/{b}{c}"))


def decoy(r: random.Random) -> str:
    """Something with digits or an at sign that is no personal data."""
    hexes = "".join(r.choices("0123456789abcdef", k=r.choice((8, 16, 32, 40, 40, 64))))
    return r.choice((
        f'token = "{hexes}"', hexes, f"{r.randint(1, 9)}.{r.randint(0, 9)}", f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}", str(r.randint(0, 99999)), _digits(r, r.randint(5, 9)), _digits(r, r.randint(20, 30)),
        f"{r.randint(1900, 2040)}-{r.randint(1, 12):02}-{r.randint(1, 31):02}", f"{r.randint(1, 31)}/{r.randint(1, 12)}/{r.randint(1900, 2040)}", f"{r.randint(0, 23):02}:{r.randint(0, 59):02}", f"{r.randint(1, 999)},{_digits(r, 3)}.{_digits(r, 2)}", f"${r.randint(1, 9999)}", f"{r.randint(1, 100)}%",
        f"{_name(r)} at {_name(r)}", f"look at {_name(r)}.{_name(r)}", f"at the dot of {_name(r)}", f"the {_name(r)} dot,", f"(at {_name(r)})", f"see {_name(r)}.com at once",
        f"@{_name(r)}", f"https://{_name(r)}.com/en/{r.randint(1, 999)}.html?page={r.randint(1, 9)}", f"CC BY-NC {r.randint(1, 4)}.0", f"version {r.randint(1, 9)}", f"[{r.randint(1, 99)}]", f"{_name(r)}{r.randint(1, 99)}", f"{r.randint(1000, 9999)} {r.randint(1000, 9999)}", f"0x{hexes[:8]}", f"{hexes[:8]}-{hexes[1:5]}-{hexes[2:6]}-{hexes[3:7]}-{hexes[4:12]}"[:36],
    ))


def labelled(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of text (codes) and the tags of their labelled spans."""
    r = random.Random(seed)
    xs, ys = np.zeros((n, LENGTH), np.int64), np.zeros((n, LENGTH), np.int64)
    for row in range(n):
        text, tags = "", []
        while len(text) < 2 * LENGTH:
            u = r.random()
            if u < 0.16:
                k = r.randrange(len(KINDS))
                s = example(r, KINDS[k])
                tags += [1 + 2 * k, *[2 + 2 * k] * (len(s) - 1)]
            else:
                s = decoy(r) if u < 0.3 else _word(r)
                tags += [0] * len(s)
            gap = r.choice((" ", " ", " ", " ", "\n", ", ", ". ", " ("))
            text, tags = text + s + gap, tags + [0] * len(gap)
        start = r.randint(0, LENGTH // 2)
        while tags[start] and tags[start] % 2 == 0:  # not within a span
            start += 1
        size = LENGTH if r.random() < 0.8 else r.randint(8, LENGTH)
        x, y = codes(text)[start : start + size], tags[start : start + size]
        at = r.choice((0, LENGTH - len(x)))
        xs[row, at : at + len(x)], ys[row, at : at + len(y)] = x, y
    return xs, ys


@functools.lru_cache(maxsize=2)
def train(windows: int = WINDOWS, passes: int = PASSES, seed: int = SEED) -> Weights:
    """Weights fitted to labelled windows by Adam; the same call gives the same weights."""
    x, y = labelled(windows, seed)
    g = np.random.default_rng(seed)
    b = np.zeros((2, SIZE, 4 * HIDDEN))
    b[:, :, HIDDEN : 2 * HIDDEN] = 1.0
    p = Weights(b + g.normal(0, 0.2, b.shape), g.normal(0, HIDDEN**-0.5, (2, HIDDEN, 4 * HIDDEN)), g.normal(0, 0.2, (2, HIDDEN, TAGS)), np.zeros(TAGS), np.zeros((TAGS, TAGS)))
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    total = passes * -(-windows // BATCH)
    for _ in range(passes):
        order = g.permutation(windows)
        for at in range(0, windows, BATCH):
            step += 1
            _, d = gradient(p, x[order[at : at + BATCH]], y[order[at : at + BATCH]])
            norm = np.sqrt(sum((a * a).sum() for a in d))
            rate = RATE * (1 - (step - 1) / total) ** 0.5 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for a, da, ma, va in zip(p, d, m, v, strict=True):
                da = da * min(1.0, 5 / norm)
                ma += 0.1 * (da - ma)
                va += 0.001 * (da * da - va)
                a -= rate * ma / (np.sqrt(va) + 1e-8)
    return Weights(*(a.astype(np.float32) for a in p))
