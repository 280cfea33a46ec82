import hashlib
import random

import numpy as np

from evidex.llm import _words, sketch


def runs(text, k=5):
    w = text.encode().lower().split()  # ASCII white space and letters
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def text_of(words, n, seed):
    return " ".join(random.Random(seed).choices(words, k=n))


def test_word_hashes_do_not_depend_on_what_stands_around():
    a, off = _words.many([b"Ab cd", b"", b"  cd\tab\x0b", b"ab"])
    assert off.tolist() == [0, 2, 2, 4, 5]
    assert a[0] == a[3] == a[4] and a[1] == a[2] and a[0] != a[1]
    big = b"word " * 400_000 + b"x" * 3_000_000 + b" word"
    h, _ = _words.many([big])
    assert len(h) == 400_002 and len(set(h.tolist())) == 2


def test_shingles_of_short_texts():
    h, off = _words.many([b"a b c", b"", b"a b c d e f", b"a b c"])
    s, at = _words.shingles(h, off, 5)
    assert np.diff(at).tolist() == [1, 0, 2, 1] and s[0] == s[3] and s[0] != s[1]


def test_likeness_of_unequal_texts():
    words = [f"w{i}" for i in range(5000)]
    big, small = text_of(words, 20000, 1), text_of(words, 3000, 2)
    both = big + " " + small
    a, b, c = sketch.of_texts([big, small, both])
    assert abs(sketch.likeness(b, c)[0] - 1) < 0.1
    assert abs(sketch.likeness(b, c)[1] - 3000 / 23000) < 0.05
    assert sketch.likeness(a, b)[0] < 0.05
    merged = sketch.merge(a, b)
    assert sketch.likeness(merged, c)[0] > 0.97
    assert sketch.likeness(*sketch.of_texts(["", " "]))[0] == 1 and sketch.likeness(*sketch.of_texts(["", "a"]))[0] == 0


def test_text_form_and_merging_of_small_sketches():
    a, b = sketch.of_texts(["a b c d e f g", "a b c d e x y"])
    for s in (a, b):
        again = sketch.parse(sketch.text_of(s))
        assert again[1] == s[1] and (again[0] == s[0]).all()
    assert len(sketch.merge(a, b)[0]) == 5


def brute_containment(*texts):
    """The estimate from whole sets of hashes: of each, what lies below the fraction, or the FLOOR smallest; compared below the smaller bound."""
    share, kept, bounds = int(sketch.FRACTION * 2**64), [], []
    for t in texts:
        h = sorted(set(_words.shingles(*_words.many([t.encode()]), 5)[0].tolist()))
        below = [x for x in h if x < share]
        some = below if len(below) >= sketch.FLOOR else h[: sketch.FLOOR]
        kept.append(set(some))
        bounds.append(2**64 if len(some) == len(h) and len(below) < sketch.FLOOR else max(share, some[-1] + 1))
    if not any(kept):
        return 1.0
    x, y = ({v for v in k if v < min(bounds)} for k in kept)
    return len(x & y) / min(len(x), len(y)) if min(len(x), len(y)) else 0.0


def test_odd_documents(spark, odd_docs, odd_rows, no_docs):
    got = sorted((tuple(r)[:7] for r in sketch.against_edited(odd_docs).collect()), key=repr)
    texts = sorted(((d is not None, d or 0, t or "", d) for d, t in odd_rows))
    assert len(got) == len(texts)
    want = []
    for i, (_, _, t, d) in enumerate(texts):
        nxt = texts[(i + 1) % len(texts)][2]
        q = len(t) // 4
        e = t[: len(t) - q] + nxt[:q]
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest()))
        g = [x for x in got if x[:3] == want[-1]]
        assert g, (d, t[:20])
        likeness = brute_containment(t, e), brute_containment(t, nxt)
        assert any(abs(x[5] - likeness[0]) < 1e-9 and abs(x[6] - likeness[1]) < 1e-9 for x in g)  # repeated rows have other successors
        a, b = runs(t), runs(e)
        if a and b and max(len(a), len(b)) <= sketch.FLOOR:  # all runs are kept
            assert abs(g[0][5] - len(a & b) / min(len(a), len(b))) < 1e-9
    assert sketch.against_edited(no_docs).count() == 0
    one = spark.createDataFrame([(5, "a b c d e f")], "doc_id long, text string")
    r = sketch.against_edited(one).first()
    assert r.near_next == 1.0
    marks = {r[0]: r[1] for r in sketch.sketches(odd_docs.where("doc_id in (20, 21)")).collect()}
    assert marks[20] == marks[21]


def test_a_sketch_is_every_hash_below_the_fraction():
    """Texts of 64 runs or more nearly always have FLOOR hashes there, so nothing else decides what is kept."""
    bound, above = np.uint64(int(sketch.FRACTION * 2**64)), 0
    for n in (70, 150, 400, 3000):
        for seed in range(20):
            text = " ".join(f"w{random.Random(1000 * n + seed * 7 + i).randrange(10**6)}" for i in range(n))
            h, _ = _words.shingles(*_words.many([text.encode()]), sketch.SHINGLE)
            below = np.unique(h[h < bound])
            (kept, complete), above = sketch.of_texts([text])[0], above + (len(below) >= sketch.FLOOR)
            if len(below) >= sketch.FLOOR:
                assert kept.tolist() == below.tolist() and complete == int(bound)
    assert above >= 70


def test_containment_of_longer_texts_against_exact_sets():
    r, errors = random.Random(4), []
    for _ in range(60):
        a = [f"w{r.randrange(3000)}" for _ in range(r.randint(200, 2000))]
        b = a[: len(a) * r.randint(1, 9) // 10] + [f"w{r.randrange(3000)}" for _ in range(r.randint(1, 4000))]
        x, y = runs(" ".join(a)), runs(" ".join(b))
        errors.append(sketch.likeness(*sketch.of_texts([" ".join(a), " ".join(b)]))[0] - len(x & y) / min(len(x), len(y)))
    assert np.abs(errors).max() < 0.25 and abs(np.mean(errors)) < 0.03


def test_places_among_borders(spark):
    from pyspark.sql import functions as F

    borders = sorted(random.Random(1).sample(range(-1000, 1000), 90))
    got = spark.range(-1100, 1100, 7).select("id", sketch._place(borders, F.col("id"))).collect()
    assert all(p == sum(b <= i for b in borders) for i, p in got)
