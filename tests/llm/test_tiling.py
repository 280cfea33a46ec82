import random
import tracemalloc

import numpy as np
import pytest

from evidex.llm import _words, tiling


def brute_tiles(a, b, k):
    """Longest common unmarked run first, again and again."""
    fa, fb, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0,)
        for j in range(len(b)):
            for i in range(len(a)):
                n = 0
                while i + n < len(a) and j + n < len(b) and fa[i + n] and fb[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n >= k and (n, -j, -i) > best:
                    best = (n, -j, -i)
        if best == (0,):
            return out
        n, j, i = best[0], -best[1], -best[2]
        for x in range(n):
            fa[i + x] = fb[j + x] = False
        out.append(n)


@pytest.mark.parametrize("pairs", [tiling.PAIRS, 0])
def test_tiles_against_brute_force(monkeypatch, pairs):
    """Also where pairs of equal seeds are never held."""
    monkeypatch.setattr(tiling, "PAIRS", pairs)
    r = random.Random(3)
    for _ in range(60):
        words = r.choice(("ab", "abcdef", "abcdefghijklmnopqrstuvwxyz"))
        item = [r.choice(words) for _ in range(r.randint(5, 25))]
        doc = [r.choice(words) for _ in range(r.randint(0, 10))]
        for _ in range(3):
            at = r.randrange(len(item))
            doc += item[at : at + r.randint(1, 12)] + [r.choice(words) for _ in range(r.randint(0, 4))]
        want = brute_tiles(doc, item, 5)
        got = tiling.Items([7], [" ".join(item)], 5, 1e-9).found([" ".join(doc)])
        assert (sum(want), len(want)) == ((got[0][4], got[0][3]) if got else (0, 0))


ITEM = " ".join(f"w{i}" for i in range(40))


def test_reordered_and_partial_passages(spark):
    w = ITEM.split()
    docs = [
        (1, "before " + ITEM.upper() + " after"), (2, " ".join(w[20:] + ["x", "y"] + w[:20])), (3, " ".join(w[:31])), (4, " ".join(w[:33])), (5, " ".join(w[::-1])),
        (6, " ".join(x for i in range(0, 40, 4) for x in [*w[i : i + 4], "z"])), (7, None), (8, ""), (9, "tiny item"), (9, "a tiny  ITEM here"), (None, ITEM), (10, "w0 w1"),
    ]
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, "tiny item"), (3, ""), (4, None), (None, "w5 w6 w7 w8 w9")], "item_id long, text string")
    df = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, item_id string")
    got = sorted(((r.doc_id, r.item_id, r.n_words) for r in tiling.contaminated(df, items).collect()), key=repr)
    long = [(1, 1, 40), (2, 1, 40), (4, 1, 33), (None, 1, 40)]
    short = [(d, None, 5) for d in (1, 2, 3, 4, None)]
    assert got == sorted([*long, *short, (9, 2, 2), (9, 2, 2)], key=repr)
    kept = tiling.decontaminate(df, items)
    assert kept.schema == df.schema
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [10, 5, 6, 7, 8]
    assert tiling.contaminated(df, items.limit(0)).count() == 0 and tiling.contaminated(df.limit(0), items).count() == 0


def test_items_in_several_blocks(spark, monkeypatch, odd_docs):
    monkeypatch.setattr(tiling, "BLOCK", 10)
    items = spark.createDataFrame([(i, f"word{i} and four others follow") for i in range(5)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"so word{i} and four others follow {'pad ' * 50}") for i in range(5)], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in tiling.contaminated(docs, items).collect()) == [(i, i) for i in range(5)]
    assert tiling.contaminated(odd_docs, items).count() == 0
    kept = tiling.decontaminate(odd_docs, items)
    assert kept.schema == odd_docs.schema and sorted(map(repr, kept.collect())) == sorted(map(repr, odd_docs.collect()))
    more = docs.union(spark.createDataFrame([(None, "word3 and four others follow"), (2, "other text of the same id"), (None, None), (9, "word4 and four others")], docs.schema))
    assert sorted(map(repr, (tuple(r) for r in tiling.decontaminate(more, items).collect()))) == sorted(map(repr, [(2, "other text of the same id"), (None, None), (9, "word4 and four others")]))


def test_running_hashes_are_of_their_window_alone(monkeypatch):
    monkeypatch.setattr(_words, "BLOCK", 16)
    monkeypatch.setattr(_words, "_POWERS", [])
    r = random.Random(1)
    texts = [[r.choice("abc") for _ in range(r.randint(0, 60))] for _ in range(30)]
    h, off = _words.many([" ".join(t).encode() for t in texts])
    for k in (1, 3, 5):
        got, at = _words.running(h, off, k)
        windows = [tuple(t[i : i + k]) for t in texts for i in range(len(t) - k + 1)]
        assert len(got) == len(windows) == at[-1]
        of = {}
        for w, x in zip(windows, got.tolist(), strict=True):
            assert of.setdefault(w, x) == x
        assert len(set(of.values())) == len(of)


def test_equal_hashes_are_checked_on_the_words(monkeypatch):
    """With one hash for all windows, what is found is the same."""
    docs = ["x w1 w2 w3 w4 w5 w6 y", "a b c d e f g"]
    want = tiling.Items([1], ["w1 w2 w3 w4 w5 w6"]).found(docs)
    running = _words.running
    monkeypatch.setattr(_words, "running", lambda h, off, k: (running(h, off, k)[0] * np.uint64(0), running(h, off, k)[1]))
    for pairs in (tiling.PAIRS, 0):
        monkeypatch.setattr(tiling, "PAIRS", pairs)
        assert tiling.Items([1], ["w1 w2 w3 w4 w5 w6"]).found(docs) == want and len(want) == 1


def test_repeats_of_a_word_take_linear_memory():
    """20,000 equal words against an item of 2,000: 40 million pairs of equal seeds."""
    block = tiling.Items([1, 2], ["a " * 2000, "b " * 3 + "a " * 1990])
    tracemalloc.start()
    got = block.found(["a " * 20000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(t, i, n, w) for t, i, _, n, w in got] == [(0, 0, 1, 2000), (0, 1, 1, 1990)] and peak < 100e6
