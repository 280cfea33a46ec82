import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from evidex.llm import cuckoo, lines


def key_of(line, length=40):
    k = line.strip(" \t\n\x0b\x0c\r")
    k = "".join(c.lower() if "A" <= c <= "Z" else c for c in k)
    return k if len(k) >= length else None


def brute(rows, length=40, documents=5):
    holders = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if (k := key_of(x, length)) is not None:
                holders[k].add(d)
    keep = {k: max(h, key=lambda d: (d is not None, d or 0)) for k, h in holders.items() if len(h) >= documents}
    out = []
    for d, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if (k := key_of(x, length)) not in keep or keep[k] == d]
        out.append((d, "\n".join(kept), len(every), len(every) - len(kept)))
    return out


def test_filters_hold_what_was_put_in():
    g = np.random.default_rng(0)
    for n in (0, 1, 7, 300, 60000):
        keys = np.unique(g.integers(-(2**63), 2**63 - 1, n))
        f = cuckoo.build(keys)
        assert f.contains(keys).all() and int((f.table > 0).sum()) == len(keys)
        assert f.contains(g.integers(-(2**63), 2**63 - 1, 20000)).mean() < 0.001
        f.delete(keys[: n // 2])
        assert f.contains(keys[n // 2 :]).all() and int((f.table > 0).sum()) == len(keys) - n // 2


def corpus(n=300, seed=5):
    r = random.Random(seed)
    pool = [f"a common line number {i} that is longer than forty characters é" for i in range(30)] + ["short", "", "é" * 39, "é" * 40]
    out = []
    for d in range(n):
        some = [r.choice(pool) for _ in range(r.randint(0, 6))] + [f"a line of document {d} alone, longer than forty characters"] * r.randint(0, 2)
        r.shuffle(some)
        out.append((d, "\n".join(x.upper() if x.isascii() and r.random() < 0.3 else " " + x + "\t" if r.random() < 0.3 else x for x in some)))
    return out


def test_against_brute_force(spark):
    rows = corpus() + [(1, "a common line number 1 that is longer than forty characters é"), (None, "\n".join(f"a common line number {i} that is longer than forty characters é" for i in range(30)))]
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter(brute(rows))


def test_without_filters_the_result_is_the_same(spark, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST", 0)
    rows = corpus(120, 6)
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter(brute(rows))


def test_odd_documents(spark, odd_docs, odd_rows, no_docs):
    assert Counter(map(tuple, lines.dedup(odd_docs).collect())) == Counter(brute(odd_rows))
    whole = lines.dedup_rows(odd_docs)
    assert whole.schema == odd_docs.schema
    for r, (d, t, _, gone) in zip(sorted(whole.collect(), key=repr), sorted(brute(odd_rows), key=lambda x: repr(x[:1])), strict=True):
        assert r.n_lines == "x"
        if d == r.doc_id and gone:
            assert r.n_chars == len(r.text)
    assert lines.dedup(no_docs).count() == 0


def dropped(index):
    return {(r.drop_id, k) for r in index.drops(5).collect() for k in map(bytes, r.drop_keys)}


def test_index_is_reversible(spark, tmp_path):
    rows = corpus(90, 7)
    frame = lambda some: spark.createDataFrame(some, "doc_id long, text string")
    index = lines.LineIndex(spark, f"file://{tmp_path}/a")
    index.insert(frame(rows[:50]))
    first = dropped(index)
    assert first
    index.insert(frame(rows[50:]))
    assert dropped(index) != first
    index = lines.LineIndex(spark, f"file://{tmp_path}/a")  # opened anew
    assert index.batch == 2
    index.delete(frame(rows[50:]).select("doc_id"))
    assert dropped(index) == first
    keys = {bytes(r.k) for r in index.refs().select("k").distinct().collect()}
    tables = [np.frombuffer(r.bits, np.uint16) for r in index._filters().collect()]
    assert sum(int((t > 0).sum()) for t in tables) == len(keys)
    with pytest.raises(ValueError):
        index.insert(frame(rows[:1]))


def test_equal_keys_count_once_in_a_filter():
    keys = np.repeat(np.arange(3, dtype=np.int64), 20)
    f = cuckoo.build(keys)
    assert f.contains(keys).all() and int((f.table > 0).sum()) == 3
