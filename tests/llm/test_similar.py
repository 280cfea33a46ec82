import numpy as np
import pytest

from evidex.llm import similar
from test_simhash import groups


def runs(text, k=5):
    words = text.lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def resemblance(a, b):
    a, b = runs(a), runs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(g, words, n):
    out = list(words)
    for i in g.choice(len(out), n, replace=False).tolist():
        out[i] = f"new{g.integers(1 << 30)}"
    return " ".join(out)


def test_similar_on_odd_documents(spark, odd_docs, odd_rows, no_docs):
    got = [(r.doc_id, r.component_id) for r in similar.similar(odd_docs).collect()]
    assert len(got) == len(odd_rows) and similar.similar(no_docs).count() == 0
    of = dict(got)
    assert of[0] == of[1] == of[2] == 0 and of[4] == of[3] == 3 and of[5] == 5 and of[21] == of[20] == 20 and of[7] == 7


def partly(g, k, n):
    """Texts of n words and copies of them with a block appended, cut off or replaced, at a resemblance of 0.8 to 0.85."""
    out = []
    for i in range(k):
        base = [f"b{i}x{j}" for j in range(n)]
        more = [f"c{i}x{j}" for j in range(n // 6)]
        changed = base + more if i % 3 == 0 else base[: -(n // 6)] if i % 3 == 1 else [*base[: n // 2], *more[: n // 14], *base[n // 2 + n // 14 :]]
        out += [" ".join(base), " ".join(changed)]
    return out


def exact_groups(texts):
    sets = [runs(t) for t in texts]
    near = [(i, j) for i, a in enumerate(sets) for j in range(i) if 5 * len(a & sets[j]) >= 4 * len(a | sets[j])]
    return groups(len(texts), near), near


def found(spark, texts):
    got = {r.doc_id: r.component_id for r in similar.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    return [got[i] for i in range(len(texts))]


def test_appended_and_truncated_copies_are_found_at_any_size(spark):
    texts = partly(np.random.default_rng(0), 60, 150)
    want, near = exact_groups(texts)
    assert len(near) == 60 and found(spark, texts) == want


def test_short_texts_below_the_threshold_are_kept(spark):
    """Nine words of which the last differs share four of six runs; 30 words of which the last differs, 25 of 27."""
    texts = []
    for i in range(60):
        for n in (9, 30):
            base = [f"s{i}n{n}x{j}" for j in range(n)]
            texts += [" ".join(base), " ".join(base[:-1] + ["other"])]
    want, near = exact_groups(texts)
    assert len(near) == 60 and found(spark, texts) == want


def test_a_large_group_of_near_copies_and_unrelated_texts_of_the_same_words(spark, monkeypatch):
    monkeypatch.setattr(similar, "MEMBERS", 40)
    g = np.random.default_rng(5)
    make = lambda: [f"w{int(i)}" for i in (g.random(250) ** 2 * 400).astype(int)]
    texts = []
    for _ in range(20):
        base = make()
        texts += [" ".join(base)] + [edited(g, base, 5) for _ in range(3)]
    base = make()
    texts += [" ".join(base)] + [edited(g, base, 3) for _ in range(150)] + [" ".join(make()) for _ in range(80)]
    want, near = exact_groups(texts)
    assert len(near) > 4000 and found(spark, texts) == want


def test_two_sets_at_the_threshold_share_a_member_of_their_prefixes():
    g = np.random.default_rng(2)
    for _ in range(2000):
        n, m = g.integers(1, 60, 2)
        pool = np.unique(g.integers(0, 1 << 63, 200).astype(np.uint64))
        a = np.sort(g.choice(pool, n, replace=False))
        b = np.union1d(g.choice(a, g.integers(max(1, n - n // 5), n + 1), replace=False), g.choice(pool, m // 8, replace=False))
        late, ranks = np.sort(g.choice(pool, 40, replace=False)), g.integers(2, 5, 40)
        shared = len(np.intersect1d(a, b))
        if 5 * shared >= 4 * (len(a) + len(b) - shared):
            (p, f), (q, _) = similar.prefix(a, 0.8, late, ranks), similar.prefix(b, 0.8, late, ranks)
            assert set(p.tolist()) & set(q.tolist())
            assert not np.isin(p[:f], late).any() and np.isin(p[f:], late).all()
            assert np.bitwise_count(similar.bitmap(a) ^ similar.bitmap(b)).sum() <= similar.most_different(len(a) + len(b), 0.8)


def test_bitmaps_of_unequal_width_are_compared_in_the_narrower():
    g = np.random.default_rng(4)
    a = np.unique(g.integers(0, 1 << 63, 3000).astype(np.uint64))
    assert len(similar.bitmap(a)) == 64 and len(similar.bitmap(a[:500])) == 8 and len(similar.bitmap(a[:0])) == 8
    for longs in (8, 16, 32, 64):
        assert (similar.folded(similar.bitmap(a), longs) == similar.bitmap(a, 64 * longs)).all()


@pytest.mark.parametrize(("members", "held", "every"), [(10, 1 << 16, 16), (10, 20, 1000), (1024, 30, 1)])
def test_small_groups_in_a_crowded_shard_are_found(spark, monkeypatch, members, held, every):
    """All texts have most of their runs in common, so a shard holds all of them; only pairs of them are near copies.

    With every text in the sample the common runs come last and are dealt out; with none, a shard is larger than is held.
    """
    for name, value in (("MEMBERS", members), ("HELD", held), ("EVERY", every)):
        monkeypatch.setattr(similar, name, value)
    template, texts = [f"t{i}" for i in range(170)], []
    for i in range(60):
        own = [f"o{i}x{j}" for j in range(30)]
        texts += [" ".join(template + own), " ".join(template + own[:-1] + ["other"])]
    want, near = exact_groups(texts)
    assert len(near) == 60 and found(spark, texts) == want


def test_one_row_of_a_repeated_id_stays(spark):
    """Rows (5, B) and (5, A and a word): only the near copy of A goes; of two texts of the least id one stays."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (5, b), (5, a + " more"), (7, c), (7, c + " more"), (8, c), (9, b), (9, b), (None, a)]
    got = sorted(map(tuple, similar.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert len(got) == 4 and {(1, a), (5, b), (None, a)} <= set(got) and sum(r[0] == 7 for r in got) == 1


def test_dedup_keeps_columns_and_rows_without_words(spark, odd_docs, no_docs):
    got = similar.dedup(odd_docs)
    assert got.schema.simpleString() == odd_docs.schema.simpleString()
    ids = sorted(r.doc_id for r in got.collect() if r.doc_id is not None)
    assert ids == [0, 3, 5, 7, 10, 11, 12, 13, 14, 15, 20] and got.where("doc_id is null").count() == 2
    assert similar.dedup(no_docs).count() == 0


def test_simhash_links_without_the_join_of_sets(spark, monkeypatch):
    """Near copies within 4 bits are linked by the trees over fingerprints alone, where they also resemble by 0.8."""
    g = np.random.default_rng(12)
    texts, shards = [], similar._shards
    for i in range(40):
        base = [f"w{i}x{j}" for j in range(400)]
        texts += [" ".join(base), " ".join([*base, f"end{g.integers(1 << 30)}"])]
    for i in range(2):  # one fingerprint, that of the run in most places, but hardly a run in common
        texts.append(" ".join(["so"] * 300 + [f"v{i}x{j}" for j in range(100)]))
    f = [similar.simhash.fingerprint(t) for t in texts]
    near = [(i, j) for i, a in enumerate(f) for j in range(i) if (a ^ f[j]).bit_count() <= 4]
    assert len(near) > 20 and (81, 80) in near and resemblance(texts[80], texts[81]) < 0.1
    monkeypatch.setattr(similar, "_shards", lambda marks: shards(marks.where("false")))
    got = found(spark, texts)
    assert got == groups(len(texts), [(i, j) for i, j in near if resemblance(texts[i], texts[j]) >= 0.8])
    monkeypatch.undo()
    assert found(spark, texts) == exact_groups(texts)[0]


def test_a_row_without_id_takes_no_link_from_its_copy(spark):
    """The set of a text is given out for the row that has an id, though one without comes first in its task."""
    base = [f"w{j}" for j in range(60)]
    near, none = " ".join([*base, "end"]), " ".join(base)
    docs = spark.createDataFrame([(None, none), (5, none), (3, near)], "doc_id long, text string").coalesce(1)
    assert sorted((r.doc_id or 0, r.component_id) for r in similar.similar(docs).collect()) == [(0, 3), (3, 3), (5, 3)]
