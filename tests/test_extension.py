import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidex.functions import extension as X
from evidex.operators import catalogue as C
from evidex.operators import ranking as K
from evidex.operators import resolve as R
from evidex.sources import code, office


def test_shared_formulas_move_what_is_relative():
    assert office.shifted("A1+$B$2*C$3+SUM($D4:E5)", 2, 1) == "B3+$B$2*D$3+SUM($D6:F7)"
    assert office.shifted("LOG10(A1)", 1, 0) == "LOG10(A2)"
    assert [office.column_name(office.column_number(n)) for n in ("A", "Z", "AA", "AZ", "XFD")] == ["A", "Z", "AA", "AZ", "XFD"]


def test_office_files_that_are_none(spark):
    df = spark.createDataFrame([(1, b"no zip"), (2, None), (3, office.make_docx("T", []))], "id long, content binary")
    assert [(r.id, r.type) for r in office.docx(df).orderBy("id", "place").collect()] == [(1, "error"), (2, "error"), (3, "heading"), (3, "table")]
    assert {r.kind for r in office.xlsx(df).where("id < 3").collect()} == {"error"}


def test_code_rows():
    rows = code.rows_of("a/__init__.py", "import b\nclass C(D):\n    @p\n    async def m(self):\n        getattr(x, 'y')()\n")
    got = {(r[1], r[2], r[3]) for r in rows}
    assert got == {("node", "module", "a"), ("occurrence", "import", "b"), ("node", "class", "a.C"), ("occurrence", "base", "D"), ("node", "method", "a.C.m"), ("occurrence", "decorator", "p"), ("blindspot", "DYNAMIC_CALL", ""), ("blindspot", "DYNAMIC_CALL", "getattr")}
    assert ("blindspot", "SYNTAX_ERROR") in {(r[1], r[2]) for r in code.rows_of("x.py", "def (")}
    assert [r[2] for r in code.rows_of("x.py", None)] == ["module"]


def test_relative_imports(spark):
    rows = [("a.b.c", False, ".x", "a.b.x"), ("a.b.c", False, "..x", "a.x"), ("a.b", True, ".x", "a.b.x"), ("a", False, "...x", "x"), ("a.b", False, "os", "os"), ("a.b.c", False, "..", "a")]
    df = spark.createDataFrame(rows, "m string, p boolean, n string, want string")
    assert all(r[0] == r[1] for r in df.select(code.absolute(F.col("m"), F.col("p"), F.col("n")), "want").collect())


def test_counters(spark):
    df = spark.createDataFrame([("a  b\nc",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(X.tokens(F.col("t"), "whitespace")).collect()] == [3, 0, None]
    X.register_counter("letters", lambda s: s.str.len())
    assert [r[0] for r in df.select(X.tokens(F.col("t"), "letters")).collect()] == [6, 0, 0]
    with pytest.raises(X.TokenCounterUnavailable):
        X.tokens(F.col("t"), None)


def test_providers_are_held_to_their_contract(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    got = {(r.doc_id, r.status) for r in X.summarised(df, lambda t, k: [(0, 2)], 1).collect()}
    assert got == {(1, "ok"), (2, "error")}
    with pytest.raises(ValueError):
        X.summarised(df, lambda t, k: [], 0)
    claims = spark.createDataFrame([(1, "a", "ab"), (1, "z", "ab"), (1, None, "ab"), (2, None, "x")], "doc_id long, claim string, evidence string")
    check = lambda c, e: pd.Series([None if x is None else x in y for x, y in zip(c, e, strict=True)], dtype="object")
    assert sorted(map(tuple, X.checked(claims, check).collect())) == [(1, 0.5, 1), (2, 0.0, 1)]


def test_prefixes_are_taken_once(spark):
    gold = spark.createDataFrame([(1, 0, "same"), (1, 1, "same"), (1, 2, "same"), (1, 3, "none")], "doc_id long, gold long, prefix string")
    blocks = spark.createDataFrame([(1, 5, "same a"), (1, 7, "same b")], "doc_id long, pos long, text string")
    assert sorted(map(tuple, R.prefix_matches(gold, blocks, 4).collect())) == [(1, 0, 5), (1, 1, 7), (1, 2, -1), (1, 3, -1)]


def test_text_rank_against_a_dense_computation(spark):
    g = random.Random(2)
    words = [g.choice("abcdefgh") * 4 for _ in range(60)]
    got = {r.term: r.weight for r in K.text_rank(spark.createDataFrame([(1, words), (2, []), (3, ["once"])], "doc_id long, words array<string>")).where("doc_id = 1").collect()}
    names = list(dict.fromkeys(words))
    near = {(a, b): 0 for a in names for b in names}
    for i, a in enumerate(words):
        for b in words[i + 1 : i + 5]:
            near[a, b] += 1
            near[b, a] += 1
    rank = dict.fromkeys(names, 1 / len(names))
    for _ in range(10):
        for a in names:
            rank[a] = 0.15 + 0.85 * sum(near[a, b] / sum(near[b, c] for c in names) * rank[b] for b in names if near[a, b])
    low, high = min(rank.values()) / 10, max(rank.values())
    assert got == {a: pytest.approx((rank[a] - low) / (high - low), abs=1e-6) for a in names}


def test_new_words_of_han_text(spark):
    rows = spark.createDataFrame([(1, 0, "資料工程。資料科學"), (1, 1, "大資料"), (2, 0, "abc"), (2, 1, None)], "doc_id long, pos long, t string")
    got = K.new_words(rows.select("doc_id", "pos", F.inline(K.grams("t", 2, 3)))).collect()
    assert [(r.term, r.freq, r.support) for r in got] == [("資料", 3, 2)]


def test_closure_follows_parents_and_needs(spark):
    seeds = spark.createDataFrame([("c",)], "block string")
    parents = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", None), ("x", "y"), ("y", None)], "block string, parent string")
    needs = spark.createDataFrame([("b", "x"), ("x", "c")], "block string, needed string")
    assert sorted(map(tuple, C.required_closure(seeds, parents, needs).collect())) == [("a", 2), ("b", 1), ("c", 0), ("x", 2), ("y", 3)]


def test_windows_end_after_lines(spark):
    from evidex.plans.extension import sum03_windows

    for r in sum03_windows(spark, "/root/testdata/sf0.001").groupBy("doc_id").agg(F.sort_array(F.collect_list("end")).alias("e")).collect():
        cuts = [0, *r.e]
        assert all(0 < b - a <= 2000 for a, b in zip(cuts, cuts[1:], strict=False))
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    ends = {}
    for r in sum03_windows(spark, "/root/testdata/sf0.001").collect():
        ends.setdefault(r.doc_id, []).append(r.end)
    assert all(max(e) == len(docs[d]) for d, e in ends.items())
    for d, e in ends.items():
        a = 0
        for b in sorted(e)[:-1]:
            if b - a < 2000:
                assert docs[d][b - 1] == "\n"
            elif "\n" in docs[d][a + 1000 : b]:
                assert docs[d][b - 1] == "\n"
            a = b


def test_dictionary_matches_against_brute_force(spark):
    g = random.Random(12)
    entries = [("".join(g.choices("abc", k=g.randint(1, 4))), g.randint(-1, 1)) for _ in range(14)] + [("", 5), (None, 1), ("AB", 0)]
    texts = ["".join(g.choices("abcABx ", k=g.randint(0, 30))) for _ in range(60)]
    got = {}
    for r in X.dictionary_matches(spark.createDataFrame([*enumerate(texts), (99, None)], "id long, text string"), spark.createDataFrame(entries, "entry string, priority long")).collect():
        got.setdefault(r.id, []).append((r.start, r.end, r.entry))
    best = {}
    for e, p in entries:
        if e:
            best[e.lower()] = max(p, best.get(e.lower(), -9))
    for i, t in enumerate(texts):
        kept = []
        for p in sorted(set(best.values()), reverse=True):
            at = 0
            while at < len(t):
                fit = [e for e, q in best.items() if q == p and t[at : at + len(e)].lower() == e and all(b <= at or a >= at + len(e) for a, b, _ in kept)]
                if fit:
                    e = max(fit, key=len)
                    kept.append((at, at + len(e), e))
                    at += len(e)
                else:
                    at += 1
        assert sorted(got.get(i, [])) == sorted(kept), t
    odd = X.dictionary_matches(spark.createDataFrame([(1, "STRAßE Ä ä")], "id long, text string"), spark.createDataFrame([("Ä",), ("straße",)], "entry string")).collect()
    assert [(r.entry, r.start, r.end) for r in odd] == [("straße", 0, 6), ("Ä", 7, 8)]
    assert 99 not in got and X.dictionary_matches(spark.createDataFrame([(1, "abc")], "id long, text string"), spark.createDataFrame([], "entry string")).count() == 0


def test_rounding_is_that_of_the_binary_value(spark):
    values = [2.675, 0.125, 0.375, 1.005, -0.125, 2.5, 1e300, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(X.rounded(F.col("x"), 2)).collect()]
    assert got == [None if v is None else round(v, 2) for v in values]


def test_options_of_summaries(spark):
    from evidex.operators import summary

    for wrong in ({"top_k": 0}, {"similarity": "other"}, {"least": 1.5}, {"repeats": -0.1}, {"min_chars": 0}, {"window": 999}, {"text_form": "odd"}):
        with pytest.raises(summary.OptionsError):
            summary.Options(**wrong)
    texts = ["the bank raised its ratio", "the bank raised its ratio", "rain fell in the north"]
    told, signal = np.full(3, 0.25), np.zeros(3)
    lexical = summary.Options(top_k=3, similarity="lexical", least=None)
    assert abs(summary.cosine(texts)[0, 1] - 1) < 1e-12 and summary.cosine(texts)[0, 2] > 0
    assert summary.choose(texts, told, signal, 3, lexical) == [0, 2]
    assert summary.choose(texts, told, signal, 3, summary.Options(top_k=3, similarity="lexical", least=None, repeats=None)) == [0, 1, 2]
    assert summary.choose(texts, told, signal, 3, summary.Options(least=1.0)) == []
    blocks = spark.createDataFrame([(1, 0, "One two   three four. Tiny of it. Another line of words here.")], "doc_id long, pos int, body string")
    got = [r.sentence for r in summary.summaries(blocks, options=summary.Options(top_k=9, least=None, min_chars=15)).collect()]
    assert got == ["One two three four.", "Another line of words here."]
