import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidex.functions import text as X
from evidex.operators import graph, quality, retrieval, stages, summary


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def test_text_functions(spark):
    assert one(spark, "ﬁ Straße", X.search_form) == "fi strasse"
    assert one(spark, None, X.search_form) is None
    assert one(spark, "a <!-- page: 3 --> b  \n c \n", X.retrieval_text) == "a   b\n c"
    assert one(spark, "What is the ratio? 12 % of 3.5", X.numbers) == ["12%", "3.5"]
    assert one(spark, "how many and why", lambda t: X.matching(t, X.INTENTS)) == "numeric,cause"
    assert one(spark, "One. Two three four", lambda t: X.boundary(t, 8)) == 4
    assert one(spark, "One two", lambda t: X.boundary(t, 4)) == 4
    assert one(spark, "x 中文", X.script) == "Mixed"
    assert one(spark, "abab ABA", lambda t: X.hits(t, "aba")) == 2


def test_tree_distance():
    a = [["h", "k"], ["1", "2"]]
    assert quality.teds(a, a) == 1
    assert quality.teds(a, [["h", "k"]]) == 1 - 3 / 7
    assert quality.teds(a, [["h", "k"], ["1", "9"]]) == 1 - 1 / 7
    assert quality.teds(a, [["h", "k"], ["1", "9"]], texts=False) == 1
    assert quality.edit_distance("kitten", "sitting") == 3


def test_order_score(spark):
    df = spark.createDataFrame([([0, 1, 2, 3], [0, 1, 2, 3]), ([3, 1, 2, 0], [0, 1, 2, 3]), ([0, 1], [0, 1, 2, 3])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(quality.order_score(F.col("a"), F.col("b"))).collect()] == [1.0, 0.5, 0.5]


def test_heading_parents_are_the_stack(spark):
    r = random.Random(1)
    levels = [r.choice([0, 0, 1, 2, 3, 4, 5, 6]) for _ in range(300)]
    want, stack = [], []
    for i, k in enumerate(levels):
        if k:
            while stack and stack[-1][0] >= k:
                stack.pop()
        want.append(stack[-1][1] if stack else -1)
        if k:
            stack.append((k, i))
    df = spark.createDataFrame([(1, i, k) for i, k in enumerate(levels)], "doc_id long, pos long, level int")
    assert [x.parent_pos for x in stages.heading_parents(df).orderBy("pos").collect()] == want


def test_tables_as_markdown(spark):
    df = spark.createDataFrame([([["a", "b|c"], ["1"], [None, "x\ny"]],)], "r array<array<string>>")
    assert df.select(stages.markdown_table("r")).first()[0] == "| a | b\\|c |\n| --- | --- |\n| 1 |  |\n|  | x<br>y |"


def test_near_pairs_lose_none(spark):
    g = np.random.default_rng(5)
    marks = np.unique(g.integers(0, 2**32, 150))
    marks = np.unique(np.concatenate((marks, marks[:60] ^ (1 << g.integers(0, 32, 60)) ^ (1 << g.integers(0, 32, 60)))))
    df = spark.createDataFrame([(i, int(m)) for i, m in enumerate(marks)], "id long, simhash long")
    want = {(i, j) for i in range(len(marks)) for j in range(i + 1, len(marks)) if int(marks[i] ^ marks[j]).bit_count() <= 3}
    assert {tuple(r) for r in retrieval.near_pairs(df).collect()} == want


def test_first_fit_and_mmr(spark):
    rows = [(1, 10, 50, 0.9, False), (1, 11, 80, 0.8, False), (1, 12, 40, 0.1, True), (1, 13, 10, 0.2, False), (2, 1, 500, 1.0, False)]
    df = spark.createDataFrame(rows, "k long, id long, cost long, score double, mandatory boolean")
    got = {(r.k, r.id) for r in retrieval.first_fit(df, "k", 100, "k long, id long, cost long, score double, mandatory boolean").collect()}
    assert got == {(1, 12), (1, 10), (1, 13)}
    tight = retrieval.first_fit(df, "k", 30, "k long, id long, cost long, score double, mandatory boolean").collect()
    assert {(r.id, r.status) for r in tight} == {(12, "over_budget"), (13, "kept")}
    m = spark.createDataFrame([(1, 1, 1.0, 10, 0), (1, 2, 0.99, 10, 0), (1, 3, 0.9, 10, -1)], "k long, id long, score double, cost long, simhash long")
    placed = retrieval.mmr(m, "k", 20, "k long, id long, score double, cost long, simhash long, place long").orderBy("place").collect()
    assert [r.id for r in placed] == [1, 3]


def test_cycles_and_closure(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (6, 4)], "source long, target long")
    got = sorted(tuple(r) for r in graph.cycles(edges).collect())
    assert got == [(1, 1, 3), (2, 1, 3), (3, 1, 3), (5, 5, 1)]


def test_all_or_any(spark):
    b = spark.createDataFrame([(1, 0, "alpha beta"), (2, 0, "alpha"), (3, 0, "none")], "doc_id long, pos int, body string")
    modes = lambda units: {(r.doc_id, r.match_mode) for r in retrieval.all_or_any(retrieval.unit_hits(b, units), len(units)).collect()}
    assert modes(("alpha", "beta")) == {(1, "all_terms")}
    assert modes(("alpha", "zeta")) == {(1, "any_term"), (2, "any_term")}


def test_pages_tell_whether_more_follow(spark):
    df = spark.range(10)
    assert [(r.id, r.has_more) for r in retrieval.page(df, 4, 3, "id").collect()] == [(4, True), (5, True), (6, True)]
    assert [r.has_more for r in retrieval.page(df, 8, 3, "id").collect()] == [False, False]


def test_summaries():
    texts = ["the bank raised its capital ratio", "the bank raised its capital ratio again", "weather was fine in the north", "capital ratio of the bank matters"]
    alike = summary.likeness(texts)
    assert np.allclose(alike, alike.T) and (alike.diagonal() == 0).all() and alike.max() < 1
    assert abs(summary.page_rank(alike).sum() - 1) < 1e-6
    assert summary.choose(["a b c"], np.array([1.0]), np.array([0.0]), 3) == [0] and summary.choose(["a b c"], np.array([0.0]), np.array([0.0]), 0) == []


def brute_summary(texts, told, signal, k):
    """The choice sentence by sentence, from sums over terms."""
    terms = [summary.portable_terms(t) for t in texts]
    n, mean = len(texts), max(sum(map(len, terms)) / len(texts), 1e-9)
    df = {t: sum(t in x for x in terms) for x in terms for t in x}
    part = lambda t, x: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * x.count(t) * 2.2 / (x.count(t) + 1.2 * (0.25 + 0.75 * len(x) / mean))
    m = [[0.0] * n for _ in texts]
    for i in range(n):
        for j in range(n):
            if i != j:
                v = sum((part(t, terms[i]) + part(t, terms[j])) / 2 for t in set(terms[i]) & set(terms[j]))
                m[i][j] = v / (1 + v)
    rank = [1 / n] * n
    for _ in range(50):
        new = [0.15 / n + 0.85 * sum(rank[i] * (m[i][j] / sum(m[i]) if sum(m[i]) else 1 / n) for i in range(n)) for j in range(n)]
        done = sum(abs(a - b) for a, b in zip(new, rank, strict=True)) < 1e-4
        rank = new
        if done:
            break
    chosen, covered = [], [0.0] * n
    while len(chosen) < min(k, n):
        best = None
        for i in range(n):
            overlap = max((m[i][c] for c in chosen), default=0.0)
            if i in chosen or overlap >= 0.8:
                continue
            gain = sum(max(0.0, (1.0 if j == i else m[i][j]) - covered[j]) for j in range(n)) / n
            value = min(1.0, 0.5 * min(1.0, max(0.8 * rank[i] / max(max(rank), 1e-6), told[i])) + 0.25 * gain + 0.15 * (1 - overlap) + 0.1 * signal[i])
            if value >= 0.35 and (best is None or value > best[0] + 1e-12):
                best = (value, i)
        if best is None:
            break
        chosen.append(best[1])
        covered = [max(c, 1.0 if j == best[1] else m[best[1]][j]) for j, c in enumerate(covered)]
    return sorted(chosen)


def test_choice_of_sentences_against_brute_force():
    r = random.Random(5)
    for _ in range(60):
        texts = [" ".join(r.choice(("bank", "ratio", "rose", "fell", "資本", "資本比率", "north", "of", "x1")) for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 14))]
        told, signal = [r.choice((0.25, 0.75, 1.0)) for _ in texts], [r.choice((0.0, 0.1, 0.4)) for _ in texts]
        k = r.randint(1, 6)
        assert summary.choose(texts, np.array(told), np.array(signal), k) == brute_summary(texts, told, signal, k)


def test_candidates_are_bounded_by_worth_and_place(spark):
    rows = [(d, i + 1, "x" * (i * 7 % 130), (0.25, 0.75, 1.0)[i * 5 % 3], i % 4 / 10) for d, n in ((1, 300), (2, 40), (3, 1), (4, 41)) for i in range(n)]
    got = {}
    for r in summary.candidates(spark.createDataFrame(rows, "doc_id long, n long, sentence string, told double, signal double"), 40).collect():
        got.setdefault(r.doc_id, set()).add(r.n)
    for d, n in ((1, 300), (2, 40), (3, 1), (4, 41)):
        own = [x for x in rows if x[0] == d]
        best = sorted(own, key=lambda x: (-(0.6 * x[3] + 0.3 * x[4] + 0.1 * min(len(x[2]), 100) / 100), x[1]))
        want = {x[1] for x in own} if n <= 40 else {x[1] for x in best[:30]} | {1 + k * (n - 1) // 9 for k in range(10)}
        assert got[d] == want


def test_mmr_against_brute_force(spark):
    r = random.Random(9)
    rows = [(d, i, round(r.random(), 1), r.randint(0, 60), r.getrandbits(64) - (1 << 63) if r.random() < 0.6 else 7, r.random(), r.random()) for d in range(6) for i in range(r.randint(1, 15))]
    kinds = "doc_id long, id long, score double, cost long, simhash long, coverage double, intent double"
    got = {d: [] for d in range(6)}
    for x in sorted(retrieval.mmr(spark.createDataFrame(rows, kinds), "doc_id", 120, f"{kinds}, place long").collect(), key=lambda x: x.place):
        got[x.doc_id].append(x.id)
    for d in range(6):
        left, chosen, spent = [x for x in rows if x[0] == d], [], 0
        top = max(x[2] for x in left) or 1.0
        while True:
            fit = [x for x in left if spent + max(1, x[3]) <= 120]
            if not fit:
                break
            def utility(x):
                near = max((1 - ((x[4] ^ c[4]) & (1 << 64) - 1).bit_count() / 64 for c in chosen), default=0.0)
                return (0.75 * x[2] / top - 0.25 * near) * x[5] * max(0.25, x[6]) / (1 + max(1, x[3])) ** 0.15
            best = max(fit, key=lambda x: (round(utility(x), 12), x[2], -x[1]))
            chosen.append(best)
            left.remove(best)
            spent += max(1, best[3])
        assert got[d] == [x[1] for x in chosen]


def test_order_score_of_high_places(spark):
    """Places beyond those whose code points would be surrogates, or have five digits."""
    far = [0, 35327, 35328, 37375, 37376, 45567, 45568, 65535, 70000, 500000]
    swapped = [*far[:4], far[5], far[4], *far[6:]]
    df = spark.createDataFrame([(far, far), (swapped, far), (far[:5], far), (far[::-1], far), ([], [])], "f array<long>, g array<long>")
    from evidex.operators.quality import edit_distance, order_score

    want = [1 - edit_distance(f, g) / max(len(f), len(g), 1) for f, g in ((far, far), (swapped, far), (far[:5], far), (far[::-1], far), ([], []))]
    assert [r[0] for r in df.select(order_score(F.col("f"), F.col("g"))).collect()] == want


def test_feature_vectors_and_nearest(spark, monkeypatch):
    v = retrieval.feature_vector
    assert abs(v("capital ratio 12") @ v("capital ratio 12") - 1) < 1e-12 and not v("").any() and not v("!?").any()
    assert v("report 2024") @ v("other 2024") > v("report 2024") @ v("other 2025") and v("資本比率") @ v("資本") > 0.2
    g = np.random.default_rng(1)
    m = g.normal(0, 1, (300, 8))
    m[5] = m[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, v array<double>").repartition(3)
    for at_once in (4096, 7):
        monkeypatch.setattr(retrieval, "QUERIES_AT_ONCE", at_once)
        got = {(r.query_id, r.rank): (r.id, r.similarity) for r in retrieval.nearest(df, df.where("id % 20 = 3"), 4, 0.3).collect()}
        u = m / np.sqrt((m * m).sum(1, keepdims=True))
        want = {}
        for q in range(3, 300, 20):
            s = [(-round(float(u[q] @ u[i]), 6), i) for i in range(300) if i != q]
            want |= {(q, k + 1): (i, -x) for k, (x, i) in enumerate(sorted(s)[:4]) if -x >= 0.3}
        assert {k: x[0] for k, x in got.items()} == {k: x[0] for k, x in want.items()}


def test_cycles_against_reachability(spark):
    """Several components, tails, chains between components, a loop of one node, and a random graph."""
    r = random.Random(3)
    graphs = [
        [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6), (6, 6), (7, 1), (6, 8)], [(2, 1), (1, 2), (0, 1)], [(1, 1)], [(1, 2)], [],
        [(r.randrange(60), r.randrange(60)) for _ in range(70)], [(i, (i + 1) % 40) for i in range(40)],
    ]
    for edges in graphs:
        reach = {a: {b for x, b in edges if x == a} for a in {x for e in edges for x in e}}
        for _ in reach:
            reach = {a: own | {c for b in own for c in reach[b]} for a, own in reach.items()}
        want = set()
        for a, own in reach.items():
            if a in own:
                component = {b for b in own if a in reach[b]}
                want.add((a, min(component), len(component)))
        got = {tuple(x) for x in graph.cycles(spark.createDataFrame(edges, "source long, target long")).collect()}
        assert got == want


SKILL = "skill_id string, qualified_name string, name string, priority long, name_terms array<string>, description_terms array<string>, trigger_terms array<string>, enrichment_terms array<string>, negative_terms array<string>, ann double"


def skill(i, q, n, p=0, d=(), t=(), e=(), neg=(), ann=0.0):
    return (i, q, n, p, n.lower().split(), list(d), list(t), list(e), list(neg), ann)


def test_routing_gates(spark):
    from evidex.operators import catalogue

    rows = [
        skill("a", "team/pdf.tools", "pdf tools", 1, ["extract", "tables"], ["pdf"], neg=["scan"]), skill("b", "home/pdf.tools", "pdf tools", 2, ["merge", "pages"]), skill("c", "x/c++", "c++", 0, ["compile"]),
        skill("d", "y/twin", "twin", 5), skill("e", "z/twin", "twin", 5), skill("f", "h/han", "資料", 0), skill("g", "k/charts", "charts", 0, ["draw", "tables"], e=["plot"]), skill("h", "l/far", "far", 0, ann=0.9),
    ]
    df = spark.createDataFrame(rows, SKILL)

    def run(task, names=(), k=3):
        got = sorted(catalogue.routed(df, task, names, k).collect(), key=lambda r: r.place)
        return [r.skill_id for r in got], {r.status for r in got} | {r.code for r in got if r.code}

    assert run("anything", ("PDF tools", "x/C++")) == (["b", "c"], {"ok"})
    assert run("anything", ("pdf tools", "unknown")) == ([], set())
    assert run("anything", ("twin",)) == (["d", "e"], {"needs_narrowing", "SKILL_AMBIGUOUS"})
    assert run("use team/pdf.tools and x/c++ now") == (["a", "c"], {"ok"})
    inside = catalogue.routed(df, "xteam/pdf.tools1 or teamXpdf.tools then").collect()  # no mention of its own, but it occurs
    assert [(r.skill_id, r.route, r.score) for r in inside] == [("a", "lexical", 100.0)]
    assert [r.skill_id for r in catalogue.routed(df, "xteam/pdfXtools then").collect()] == ["h"]  # by likeness alone
    assert run("the pdf tools, and charts") == (["b", "g"], {"ok"})
    assert run("a twin of charts") == (["d", "e"], {"needs_narrowing", "SKILL_AMBIGUOUS"})
    assert run("把資料整理") == (["f"], {"ok"})
    assert run("the and for") == ([], set())
    assert run("extract tables of pdf")[0][0] == "a" and run("extract tables of scan")[0][:2] == ["g", "a"]  # 5.93 and 5.52 after the negative term
    assert run("draw plot somewhere")[0][0] == "g"
    got = {r.skill_id: r for r in catalogue.routed(df, "nothing one two three four five six", k=5).collect()}
    assert got["h"].route == "hnsw" and abs(got["h"].score - 1.8) < 1e-9
    assert catalogue.routed(df.limit(0), "tables").count() == 0


def test_scores_of_routing_by_hand(spark):
    from evidex.operators import catalogue

    rows = [skill("a", "q/a", "alpha beta", 0, ["gamma"], ["gamma"], ["delta"], ["omega"]), skill("b", "q/b", "beta", 0, ["gamma"]), skill("c", "q/c", "zeta", 0)]
    got = {r.skill_id: r for r in catalogue.routed(spark.createDataFrame(rows, SKILL).drop("ann"), "gamma delta omega", k=3).collect()}
    idf = lambda df: math.log(1 + 3.5 / (df + 0.5))
    want = {"a": 8 * idf(2) + 2 * idf(1) - 8, "b": 4 * idf(2)}
    top = max(want.values())
    assert {k: r.score for k, r in got.items()} == {k: round(v, 6) for k, v in want.items() if v > 0 and v >= 0.35 * top}


def test_tables_are_compared_as_grids(spark):
    from evidex.operators import quality as Q
    from evidex.sources import markup

    assert Q.spread([[("a", 2, 1), "b"], ["c", ("d", 1, 2), "e"], ["f", "g"]]) == [["a", "a", "b"], ["c", "d", "e"], ["f", "d", "g"]]
    html = "<p>x</p><table><tr><th colspan=2>h  1</th></tr><tr><td>a<td>b</tr></table><table><tr><td>other</td></tr></table>"
    assert markup.table_cells(html) == [[("h 1", 2, 1)], [("a", 1, 1), ("b", 1, 1)]] and markup.table_cells("no table") == []
    assert Q.teds(markup.table_cells(html), [["h 1", "h 1"], ["a", "b"]]) == 1.0
    df = spark.createDataFrame([(html, html), (html, html.replace("<td>b", "<td>c")), (None, html)], "a string, b string")
    assert [r[0] for r in df.select(Q.teds_html_column(F.col("a"), F.col("b"))).collect()] == [1.0, round(1 - 1 / 7, 6), None]


def test_tree_distance_against_all_mappings():
    """The recursion over forests, tried on every pair of small random trees."""
    import functools

    from evidex.operators import quality as Q

    r = random.Random(2)

    def tree(depth):
        return (r.choice(("td:ab", "td:ac", "tr", "x")), tuple(tree(depth - 1) for _ in range(r.randint(0, 3 if depth else 0))))

    def brute(a, b, texts):
        def change(x, y):
            if x == y:
                return 0.0
            if x.startswith("td:") and y.startswith("td:"):
                return 0.5 if texts else 0.0
            return 1.0

        @functools.cache
        def forest(x, y):
            if not x or not y:
                return float(sum(map(Q.size, x)) + sum(map(Q.size, y)))
            (p, c), (q, d) = x[0], y[0]
            return min(forest(c + x[1:], y) + 1, forest(x, d + y[1:]) + 1, forest(c, d) + forest(x[1:], y[1:]) + change(p, q))

        return forest((a,), (b,))

    for _ in range(300):
        a, b = tree(2), tree(2)
        for texts in (True, False):
            assert abs(Q.tree_distance(a, b, texts) - brute(a, b, texts)) < 1e-9
    wide = Q.table_tree([["c"] * 40] * 12)
    assert Q.tree_distance(wide, wide) == 0.0


def test_segments_against_all_paths(spark, monkeypatch):
    """The best of all ways to cut a text, by a lexicon that is sent and by one that is joined."""
    import itertools

    from evidex.operators import terms

    r = random.Random(6)
    entries = {"".join(r.choices("甲乙丙丁", k=r.randint(1, 3))): r.randint(1, 50) for _ in range(25)}
    total, rarest = sum(entries.values()), min(entries.values())
    weight = {e: math.log(n / total) for e, n in entries.items()}
    unknown = math.log(rarest / total) - terms.UNKNOWN
    texts = ["".join(r.choices("甲乙丙丁戊", k=r.randint(0, 8))) for _ in range(40)]
    lexicon = spark.createDataFrame(list(entries.items()), "entry string, n long")
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "id long, text string")
    for most in (terms.LEXICON, 3):
        monkeypatch.setattr(terms, "LEXICON", most)
        got = {x.id: x.words for x in terms.segmented(df, lexicon).collect()}
        assert got[99] == []
        for i, t in enumerate(texts):
            assert "".join(got[i]) == t
            value = lambda words: sum(weight.get(w, unknown if len(w) == 1 else -1e9) for w in words)
            ways = [[t[a:b] for a, b in itertools.pairwise([0, *cuts, len(t)])] for k in range(len(t)) for cuts in itertools.combinations(range(1, len(t)), k)] if t else [[]]
            assert abs(value(got[i]) - max(map(value, ways))) < 1e-9
    assert {x.id: x.words for x in terms.segmented(df, lexicon.limit(0)).collect()}[0] == list(texts[0])


def test_text_rank_against_plain_loops(spark):
    from evidex.operators import ranking

    r = random.Random(8)
    docs = [(d, [r.choice("abcdefghij") * 2 for _ in range(r.randint(0, 40))]) for d in range(12)]
    rows = [(d, w, [t[0] in "abc" and r.random() < 0.7 for t in w]) for d, w in docs]
    got = {}
    for x in ranking.text_rank(spark.createDataFrame(rows, "doc_id long, words array<string>, proper array<boolean>"), k=6).orderBy("rank").collect():
        got.setdefault(x.doc_id, []).append((x.term, x.weight))
    for d, w, p in rows:
        names = list(dict.fromkeys(w))
        near = {t: {} for t in names}
        for i in range(len(w)):
            for j in range(i + 1, min(i + 5, len(w))):
                near[w[i]][w[j]] = near[w[i]].get(w[j], 0) + 1
                near[w[j]][w[i]] = near[w[j]].get(w[i], 0) + 1
        rank = {t: 1 / len(names) for t in names}
        for _ in range(10):
            for t in names:
                rank[t] = 0.15 + 0.85 * sum(n / sum(near[u].values()) * rank[u] for u, n in near[t].items())
        if not names:
            assert d not in got
            continue
        low, high = min(rank.values()) / 10, max(rank.values())
        rank = {t: (v - low) / (high - low) for t, v in rank.items()}
        proper = {t for t, q in zip(w, p, strict=True) if q}
        top = max((math.log1p(w.count(t)) for t in proper), default=1)
        for t in proper:
            worth = 0.7 * math.log1p(w.count(t)) / top + 0.3 * (1 - w.index(t) / max(len(w) - 1, 1))
            rank[t] += 0.25 * (1 - rank[t]) * worth
        order = sorted(names, key=lambda t: (-round(rank[t], 9), t))
        wanted, held, late = min(6, len(order)), [], []
        for t in order:
            if len(held) == wanted:
                break
            (late if t in proper and sum(x in proper for x in held) >= math.ceil(wanted * 0.4) else held).append(t)
        held = set(held + late[: wanted - len(held)])
        assert [(t, pytest.approx(rank[t], abs=2e-6)) for t in order if t in held] == got[d]
