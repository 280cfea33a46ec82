import random
import zlib

import numpy as np

from evidex.llm import _fit, quality, toxicity


def corpus(n=500):
    r = random.Random(8)
    words = ["".join(r.choices(["th", "er", "on", "an", "re"], k=r.randint(1, 4))) for _ in range(400)]
    docs, labels = [], []
    for d in range(n):
        bad, toxic = r.random() < 0.3, r.random() < 0.3
        w = r.choices(words, k=r.randint(30, 120))
        if toxic:
            for _ in range(r.randint(1, 12)):
                w.insert(r.randrange(len(w)), r.choice(["zblam", "zgrott", "zfleck"]))
        text = " ".join(x.upper() + "!!" if bad else x for x in w)
        docs.append((d, text))
        labels.append((d, int(not bad), int(toxic)))
    return docs, labels


def test_fold_is_crc32(spark):
    df = spark.createDataFrame([(d,) for d in (*range(-3, 200), None)], "doc_id long")
    for r in df.select("doc_id", _fit.fold().alias("f")).collect():
        assert r.f == zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5


def test_dual_coordinate_descent_reaches_the_optimum(monkeypatch):
    g = np.random.default_rng(2)
    rows = [np.flatnonzero(g.random(12) < 0.4) for _ in range(60)]
    y = np.where([(3 in r) ^ (g.random() < 0.1) for r in rows], 1.0, -1.0)
    scale = g.normal(1, 0.2, 12)
    monkeypatch.setattr(quality, "PASSES", 400)
    w, b = quality.descend(rows, scale, y)
    x = np.array([[scale[j] * (j in r) for j in range(12)] for r in rows])
    x /= np.sqrt((x * x).sum(1, keepdims=True)) + 1e-9
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum())) * quality.COST

    def primal(w, b):
        return 0.5 * (w @ w + b * b) + (cost * np.maximum(0, 1 - y * (x @ w + b))).sum()

    best = primal(w, b)
    for _ in range(300):
        assert primal(w + g.normal(0, 0.02, 12), b + g.normal(0, 0.02)) >= best - 1e-6


def test_held_out_quality(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(d, lab)
    got = {r.doc_id: r for r in quality.score(d, model).collect()}
    held = [x for x in labels if got[x[0]].held_out]
    assert held and all(got[x].held_out == (zlib.crc32(str(x).encode()) % 5 == 0) for x, _ in docs)
    assert np.mean([got[x].predicted == q for x, q, _ in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    # Labels of held-out rows play no part.
    flipped = spark.createDataFrame([(x, 1 - q if got[x].held_out else q, t) for x, q, t in labels], "doc_id long, quality int, toxic int")
    assert np.array_equal(quality.fit(d, flipped).weight, model.weight)


def test_held_out_toxicity(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert (np.diff(model.cuts) > 0).all()
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    held = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    assert np.mean([got[x].toxic == t for x, _, t in held]) > 0.93
    hits = {x: sum(w.lower().startswith("z") for w in t.split()) for x, t in docs}
    severity = lambda few, many: np.mean([got[x].severity for x, _, t in held if t and few <= hits[x] <= many])
    assert severity(8, 12) > severity(1, 3) + 0.5


def test_ordinal_likelihood_falls_along_the_gradient():
    docs, labels = corpus(200)
    rows = toxicity.features([t for _, t in docs])
    y = np.array([t for _, _, t in labels])
    g, _ = toxicity.grade(rows, y)
    assert set(g[y == 0]) == {0} and set(g[y == 1]) == {1, 2, 3}

    def loss(model):
        above = model.above([t for _, t in docs])
        p = -np.diff(np.concatenate((np.ones((len(above), 1)), above, np.zeros((len(above), 1))), axis=1))
        return -np.log(np.maximum(p[np.arange(len(g)), g], 1e-12)).mean()

    assert loss(toxicity.fit_rows(rows, y, steps=200)) < loss(toxicity.fit_rows(rows, y, steps=20)) < loss(toxicity.fit_rows(rows, y, steps=1))


def test_odd_documents(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([(None, 1, 1), (3, None, None), (4, 1, 0), (4, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        model = module.fit(odd_docs, labels)
        assert module.score(odd_docs, model).count() == len(odd_rows)
        assert module.score(no_docs, model).count() == 0
        module.fit(no_docs, labels.limit(0))
    docs, lab = corpus(300)
    model = quality.fit_rows(quality.places([t for _, t in docs]), np.array([x[1] for x in lab]))
    got = {(r.doc_id, r.score) for r in quality.score(odd_docs, model).collect()}
    assert all(0 <= s <= 1 for _, s in got)
    assert len({s for d, s in got if d in (0, 1)}) == 1


def test_quality_model_against_a_dense_fit(monkeypatch):
    """Log-count ratios by counting, and the dual by projected gradients on the whole kernel matrix."""
    monkeypatch.setattr(quality, "PASSES", 600)
    monkeypatch.setattr(_fit, "PLACES", 30)
    g = np.random.default_rng(5)
    y = (g.random(50) < 0.6).astype(int)
    rows = [np.flatnonzero(g.random(30) < np.where(np.arange(30) % 3 == (0 if t else 1), 0.5, 0.2)) for t in y]
    model = quality.fit_rows(rows, y)
    x = np.array([[float(j in r) for j in range(30)] for r in rows])
    p, q = 1 + x[y == 1].sum(0), 1 + x[y == 0].sum(0)
    scale = np.log(p / p.sum()) - np.log(q / q.sum())
    z = x * scale
    z = np.c_[z / (np.sqrt((z * z).sum(1, keepdims=True)) + 1e-9), np.ones(50)]
    s = np.where(y > 0, 1.0, -1.0)
    k, a = (z * s[:, None]) @ (z * s[:, None]).T, np.zeros(50)
    cost = np.where(y > 0, 50 / (2 * (y > 0).sum()), 50 / (2 * (y == 0).sum()))
    for _ in range(200_000):
        a = np.clip(a - (k @ a - 1) / np.linalg.norm(k, 2), 0, cost)
    w = (a * s) @ z
    assert np.abs(model.margin(rows) - z @ w).max() < 1e-3


def test_severity_model_against_plain_descent():
    """The same penalised likelihood, brought down by numeric gradients with line search from other starts."""
    g = np.random.default_rng(7)
    y = (g.random(150) < 0.4).astype(int)
    rows = []
    for t in y:
        at = np.flatnonzero(g.random(6) < (np.array([0.7, 0.6, 0.5, 0.1, 0.1, 0.3]) if t else np.array([0.05, 0.1, 0.05, 0.6, 0.5, 0.3])))
        rows.append((at, g.uniform(0.5, 2, len(at))))
    grades, odds = toxicity.grade(rows, y)
    used = np.flatnonzero(np.abs(odds[:6]) > 1)
    x = np.array([[dict(zip(at.tolist(), v.tolist(), strict=True)).get(j, 0.0) for j in used] for at, v in rows])
    weight = np.where(y > 0, 75 / y.sum(), 75 / (150 - y.sum()))

    def loss(t):
        cuts = np.concatenate(([-1e9], t[0] + np.concatenate(([0], np.cumsum(np.exp(t[1:3])))), [1e9]))
        z = x @ t[3:]
        up, low = (1 / (1 + np.exp(-np.clip(cuts[grades + k] - z, -40, 40))) for k in (1, 0))
        return (weight * -np.log(np.maximum(up - low, 1e-9))).mean() + 1e-4 * (t[3:] ** 2).sum()

    found = []
    for start in (np.zeros(3 + len(used)), g.normal(0, 0.5, 3 + len(used))):
        t, step = start, 1.0
        for _ in range(4000):
            d = np.array([(loss(t + e) - loss(t - e)) / 2e-5 for e in 1e-5 * np.eye(len(t))])
            while step > 1e-9 and loss(t - step * d) > loss(t) - 0.3 * step * d @ d:
                step /= 2
            if step <= 1e-9:
                break
            t, step = t - step * d, 2 * step
        found.append(t)
    model = toxicity.fit_rows(rows, y, steps=6000)
    mine = np.concatenate(([model.cuts[0]], np.log(np.diff(model.cuts)), model.weight[used]))
    assert abs(loss(found[0]) - loss(found[1])) < 1e-3 and loss(mine) < min(map(loss, found)) + 1e-3
    cuts = found[0][0] + np.concatenate(([0], np.cumsum(np.exp(found[0][1:3]))))
    want = 1 / (1 + np.exp(cuts[None] - (x @ found[0][3:])[:, None]))
    assert np.abs(model.above_rows(rows) - want).max() < 0.05


def test_runs_of_marks_are_counted_by_hand():
    text = "a b b b c d d e f g h h"
    w = text.split()
    same = [int(x == y) for x, y in zip(w, w[1:])]
    want = {sum(same[i + j] << j for j in range(quality.AGAIN)) for i in range(len(same) - quality.AGAIN + 1)}
    got = quality.places([text, "", "a a a"])
    assert {p for p in got[0].tolist() if p < 1 << quality.AGAIN} == want and len(set(got[0].tolist())) == len(got[0])
    assert len(got[1]) == 0 and all(p >= 1 << quality.AGAIN for p in got[2].tolist())


def test_labels_of_one_class_reject_nothing(spark):
    docs, labels = corpus(60)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for label in (0, 1):
        same = spark.createDataFrame([(x, label) for x, _, _ in labels], "doc_id long, quality int")
        assert quality.keep(d, same).count() == 60
    assert quality.keep(d, same.limit(0)).count() == 60
