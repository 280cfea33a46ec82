import random
import re

import numpy as np
import pytest

from evidex.llm import pii, tagger


def brute(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_rules_are_the_patterns():
    r = random.Random(4)
    bits = ["a", ".", "@", "-", "+", "1", "2", "25", "255", "4111111111111111", " ", "(", ")", "é", "_", "b.c", "@x.y", "0" * 20, "٣"]
    for _ in range(30000):
        t = "".join(r.choices(bits, k=r.randint(0, 14)))
        assert pii.base(t) == brute(t), t


def test_rules_take_linear_time():
    for t in ("a" * 10**6 + "@", "1" * 10**6, "+1" + "(" * 10**6, "@" * 10**6, "1 " * 10**6):
        assert pii.base(t) == []
    assert len(pii.base("1." * 10**6)) == 250_000


@pytest.fixture(scope="module")
def weights():
    return tagger.train()


def test_gradient_is_the_slope():
    g = np.random.default_rng(0)
    x, y = tagger.labelled(3, 1)
    h, k = tagger.HIDDEN, tagger.TAGS
    p = tagger.Weights(g.normal(0, 0.2, (2, tagger.SIZE, 4 * h)), g.normal(0, 0.2, (2, h, 4 * h)), g.normal(0, 0.2, (2, h, k)), np.zeros(k), g.normal(0, 0.1, (k, k)))
    _, d = tagger.gradient(p, x, y)
    for a, da in zip(p, d, strict=True):
        at = np.unravel_index(np.abs(da).argmax(), a.shape)
        old, e = a[at], 1e-5
        a[at] = old + e
        up = tagger.gradient(p, x, y)[0]
        a[at] = old - e
        slope = (up - tagger.gradient(p, x, y)[0]) / (2 * e)
        a[at] = old
        assert abs(slope - da[at]) < 1e-4 * max(1, abs(slope))


def test_viterbi_against_all_paths():
    import itertools

    g = np.random.default_rng(1)
    score, move = g.normal(0, 1, (4, 4, tagger.TAGS)), g.normal(0, 1, (tagger.TAGS, tagger.TAGS))
    step = move + tagger.BARRED
    for row, got in zip(score, tagger.viterbi(move, score), strict=True):
        value = lambda p: tagger.FIRST[p[0]] + sum(row[i, k] for i, k in enumerate(p)) + sum(step[a, b] for a, b in itertools.pairwise(p))  # noqa: E731, B023
        assert tuple(got) == max(itertools.product(range(tagger.TAGS), repeat=4), key=value)


def spans_of(tags):
    out = set()
    for r, row in enumerate(tags):
        i = 0
        while i < len(row):
            j = i + 1
            if row[i]:
                while j < len(row) and row[j] == 2 * ((row[i] + 1) // 2):
                    j += 1
                out.add((r, int(row[i]), i, j))
            i = j
    return out


def test_held_out_spans(weights):
    x, y = tagger.labelled(300, 99)
    t = pii.Tagger(weights)
    path, sure = t.paths(t.scores(x))
    want = spans_of(y)
    got = {s for s in spans_of(path) if sure[s[0], s[2] : s[3]].min() >= pii.SURE}
    assert len(got & want) / len(got) > 0.95 and len(got & want) / len(want) > 0.75


def test_windows_are_joined_in_long_texts(weights):
    t = pii.Tagger(weights)
    text = "words " * 30 + "call (559) 555-3817 now " + "and more 12 words " * 40 + "or 192[.]168[.]1[.]20 there"
    found = {(k, text[a:b]) for k, a, b in t.spans([text])[0]}
    assert ("phone", "(559) 555-3817") in found and ("ip", "192[.]168[.]1[.]20") in found
    assert t.spans(["", "no digits at all", "On 2024-01-05 version 4.0.12 of 123456 items", 'token = "c80fd45a66f8564ae70609f7b2a26100e64e830e"']) == [[]] * 4


def test_addresses_that_are_written_out(weights):
    t = pii.Tagger(weights)
    said = ["john.smith at example dot com", "john (at) example (dot) org", "mary_jones[at]server[dot]net", "kim88 AT mail DOT de", "anna.b (at) firma.de"]
    texts = [f"words and more of them, write to {s} for the rest" for s in said]
    found = [[text[a:b] for k, a, b in spans if k == "email"] for text, spans in zip(texts, t.spans(texts), strict=True)]
    assert sum(f == [s] for f, s in zip(found, said, strict=True)) >= 4, found
    assert t.spans(["We met at noon. The dot is small.", "look at this.example and at the dot", "at home (at last) dot dot dot", "He was at work.And then"]) == [[]] * 4


def test_the_gate_costs_no_span(weights):
    """Held-out labelled texts, tagged as a whole and in the stretches around anchors: every kind is found as often."""
    r = random.Random(321)
    texts, want = [], []
    for i in range(200):
        kind = tagger.KINDS[i % 4]
        s, before, after = tagger.example(r, kind), " ".join(tagger._word(r) for _ in range(40)), " ".join(tagger._word(r) for _ in range(40))
        texts.append(f"{before} {s} {after}")
        want.append((kind, len(before) + 1, len(before) + 1 + len(s)))
    t = pii.Tagger(weights)
    gated = t.spans(texts)
    whole: list = [[] for _ in texts]
    t._decode(texts, [(d, 0, len(x), tagger.codes(x)) for d, x in enumerate(texts)], whole)
    assert all(any(a <= s[1] and s[2] <= b for a, b in pii.stretches(x)) for x, s in zip(texts, want, strict=True))
    hit = [sum(s in got for s, got in zip(want, some, strict=True)) for some in (gated, whole)]
    assert hit[0] >= hit[1] - 3 and hit[0] > 120
    assert sum(len(set(g) - {s}) for g, s in zip(gated, want, strict=True)) <= 10


def test_one_path_over_a_long_stretch(weights, monkeypatch):
    t = pii.Tagger(weights)
    text = " ".join(f"item {i} call (559) 555-38{i:02}" if i % 5 == 0 else f"number {i}" for i in range(60))
    whole = t.spans([text])
    assert sum(k == "phone" for k, _, _ in whole[0]) >= 10
    monkeypatch.setattr(pii, "LONG", 200)
    cut = t.spans([text])
    assert len(set(cut[0]) ^ set(whole[0])) <= 1


def test_odd_documents(spark, odd_docs, odd_rows, no_docs, weights):
    extra = [(50, "a.b@c.de and +1 (559) 555-3817, 10.0.0.1; 4111 1111 1111 1111"), (51, "é" * 1000 + " x@y.z " * 3)]
    docs = odd_docs.select("doc_id", "text", "f").union(spark.createDataFrame([(*r, "c") for r in extra], "doc_id long, text string, f string"))
    got = {r.doc_id: r for r in pii.find(docs, weights=weights).collect()}
    for d, t in extra:
        assert got[d].base == pii.written(brute(t))
        assert set(got[d].base.split(",")) <= set(got[d].spans.split(","))
    assert all(not got[d].base for d, _ in odd_rows)
    assert pii.find(docs, weights=weights).count() == len(odd_rows) + 2
    assert pii.find(no_docs, weights=weights).count() == 0
