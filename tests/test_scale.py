"""Queries whose work grew faster than their input, against plain computations and by what their plans shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from evidex.operators import ranking as K
from evidex.sources.text import blocks


def shuffles_rows(df):
    """Whether what documents hold becomes rows that are aggregated or joined."""
    return any(x in df._jdf.queryExecution().optimizedPlan().toString() for x in ("Aggregate ", "Generate ", "Join "))


def odd_documents(spark, seed=1, words="abcdefgh", n=12):
    """Documents with repeated ids, null and empty texts, blank lines and marks; no order."""
    r = random.Random(seed)
    line = lambda: " ".join("".join(r.choices(words, k=r.randint(1, 5))) + r.choice(["", "", ".", ", 7", "-é"]) for _ in range(r.randint(0, 9)))
    rows = [(d, "\n".join([*(line() for _ in range(r.randint(0, 6))), r.choice(["", "  ", "Tail\r\nof it"])])) for d in range(n)]
    return spark.createDataFrame([*rows, (3, line()), (n, None), (n + 1, ""), (None, line())], "doc_id long, text string").repartition(3)


def test_new_words_of_whole_documents(spark):
    docs = odd_documents(spark, words="資料工程大")
    got = K.new_words_of(docs)
    rows = blocks(docs).select("doc_id", "pos", F.inline(K.grams("body", 2, 4)))
    want = K.new_words(rows).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 50
    assert shuffles_rows(want) and not shuffles_rows(got)
    latin = K.new_words_of(spark.createDataFrame([(1, "Abab ab")], "doc_id long, text string"), "ab", "一乙").orderBy("rank").collect()
    assert [(r.term, r.freq, r.support) for r in latin] == [("一乙", 3, 1)]
    with pytest.raises(ValueError):
        K.new_words_of(docs, longest=5)


def test_ranks_of_many_texts_at_once(spark):
    """Texts of one word, with and without repeats, are ranked beside longer ones as they are alone."""
    import numpy as np

    r = random.Random(4)
    texts = [[r.randint(0, 6) for _ in range(r.randint(1, 30))] for _ in range(20)] + [[0], [0, 0], [0] * 9]
    ids = [np.array([list(dict.fromkeys(t)).index(x) for x in t]) for t in texts]
    got = K._graph_ranks(ids, 5, 10, 0.85)
    for t, rank in zip(ids, got, strict=True):
        n = t.max() + 1
        near = np.zeros((n, n))
        for i in range(len(t)):
            for j in range(i + 1, min(i + 5, len(t))):
                near[t[i], t[j]] += 1
                near[t[j], t[i]] += 1
        want = np.full(n, 1 / n)
        for _ in range(10):
            for i in range(n):
                want[i] = 0.15 + 0.85 * (near[i] / np.maximum(near.sum(0), 1) * want).sum()
        assert np.allclose(rank, want, atol=1e-12)
    df = spark.createDataFrame([(1, "Bank of Rome. The bank\nRome a-b A No.Yes x"), (2, None)], "doc_id long, text string")
    one, none = K.words_and_names(df).orderBy("doc_id").collect()
    assert list(zip(one.words, one.proper, strict=True)) == [("bank", False), ("of", False), ("rome", True), ("the", False), ("bank", False), ("rome", False), ("a-b", False), ("no", True), ("yes", False)]
    assert none.words == []


def test_segments_by_a_table_are_those_of_a_dictionary(spark):
    """More entries than were sent at once, texts of all lengths, a long one among them; no cut of a text is joined."""
    import math

    from evidex.operators import terms as T

    r = random.Random(9)
    entries = {"".join(r.choices("甲乙丙丁戊己庚辛", k=r.randint(1, 9))): r.randint(1, 50) for _ in range(3000)}
    total, rarest, longest = sum(entries.values()), min(entries.values()), max(map(len, entries))
    weight = {e: math.log(n / total) for e, n in entries.items()}
    texts = ["".join(r.choices("甲乙丙丁戊己庚辛壬𝒳", k=k)) for k in [*range(60), *[25] * 40, 3000]]
    lexicon = spark.createDataFrame(list(entries.items()), "entry string, n long")
    got = T.segmented(spark.createDataFrame([*enumerate(texts)], "id long, text string"), lexicon)
    assert not shuffles_rows(got)
    assert {x.id: x.words for x in got.collect()} == {i: T.best_path(t, weight, longest, math.log(rarest / total) - T.UNKNOWN) for i, t in enumerate(texts)}
    assert T.LEXICON > 500_000


def test_neighbours_of_every_text(spark, monkeypatch):
    """Every text is a query, by blocks smaller than the table; copies, which are ties, and a repeated id among them."""
    import numpy as np

    from evidex.operators import retrieval as R
    from evidex.plans import retrieval as P

    r = random.Random(2)
    texts = [" ".join("".join(r.choices("abcde", k=r.randint(1, 6))) for _ in range(r.randint(0, 12))) for _ in range(120)]
    texts[40:60] = [texts[3]] * 20
    docs = spark.createDataFrame([*enumerate(texts), (7, texts[9]), (500, None)], "doc_id long, text string")
    monkeypatch.setattr(R, "QUERIES_AT_ONCE", 16)
    monkeypatch.setattr(R, "ROWS_AT_ONCE", 10)
    monkeypatch.setattr(R, "BLOCKS", 2)
    monkeypatch.setattr(P, "table", lambda *_: docs)
    got = sorted((x.query_id, x.rank, x.id, x.similarity) for x in P.rnk11_text_neighbours(spark, "").collect())
    ids, u = [*range(120), 7, 500], np.array([R.feature_vector(t) for t in [*texts, texts[9], ""]])
    s = np.round(u @ u.T, 6)
    want = []
    for q in sorted(set(ids)):
        pairs = sorted((-s[i, j], ids[j]) for i in range(122) if ids[i] == q for j in range(122) if ids[j] != q and s[i, j] >= R.NEAREST)
        want += [(q, n + 1, i, -x) for n, (x, i) in enumerate(pairs[:5])]
    assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want], atol=2e-6)
    assert len({x[0] for x in got}) > 100


def test_formats_keep_texts_that_begin_or_end_oddly(spark):
    from evidex.operators import writing as W

    texts = ["", None, " a", "a ", "\ta\t", "a\n", "\n", "a\r\n", "\r", "\ra", "\x00", "\x01\x1f", "   ", '"', '""a"', "a\\", 'a\\"b', "\ufeffa", "null", "#a", "a,b"]
    df = spark.createDataFrame([(i, t, None if i % 2 else i) for i, t in enumerate(texts)], "doc_id long, text string, n long")
    assert {(r.format, r.n, r.ok) for r in W.written(df).collect()} == {(f, len(texts), True) for f in ("json", "csv", "text", "parquet")}


def test_likeness_of_lines(spark, monkeypatch):
    """Against sums over shared terms, whole and in parts of few cells; no pair of lines is a row of a shuffle."""
    import collections
    import math
    import re

    docs = odd_documents(spark, seed=7, words="abc", n=60)
    lines = collections.defaultdict(collections.Counter)
    for d, t in docs.collect():
        for i, x in enumerate((t or "").split("\n")):
            if d is not None and (found := re.findall("[a-z][a-z0-9_+-]+", x.lower())):
                lines[d, i].update(found)
    want = {}
    for d in {d for d, _ in lines}:
        own = {i: c for (e, i), c in lines.items() if e == d}
        mean = sum(c.total() for c in own.values()) / len(own)
        df = collections.Counter(t for c in own.values() for t in c)
        p = lambda i, t: math.log(1 + (len(own) - df[t] + 0.5) / (df[t] + 0.5)) * own[i][t] * 2.2 / (own[i][t] + 1.2 * (0.25 + 0.75 * own[i].total() / mean))  # noqa: B023, E731
        want |= {(d, i, j): v / (1 + v) for i in own for j in own if i < j and (both := own[i].keys() & own[j].keys()) for v in [sum(p(i, t) + p(j, t) for t in both) / 2]}
    for cells in (K.CELLS, 8):
        monkeypatch.setattr(K, "CELLS", cells)
        got = K.term_likeness(docs)
        assert not shuffles_rows(got)
        assert {(r.doc_id, r.left, r.right): r.likeness for r in got.collect()} == {k: pytest.approx(v, abs=6e-6) for k, v in want.items()}
    assert len(want) > 20


def same(got, want):
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr) and want.count() > 15


def test_terms_of_whole_documents(spark):
    """Counted within documents as by rows of terms; repeated, null and empty documents among them. No term is a row of a shuffle."""
    from evidex.operators import terms as T

    docs = odd_documents(spark, words="abcde", n=25).withColumn("source", F.concat(F.lit("s"), F.length("text") % 3))
    stats = T.rolled_up(T.leaf_terms(blocks(docs)), "doc_id")
    same(T.keywords_of(docs, 5), T.keywords(stats, "doc_id", k=5))
    best = stats.withColumn("score", F.col("tf") * F.col("support") * F.col("support")).orderBy("doc_id", F.desc("score"), F.desc("support"), "term").collect()
    want = {}
    for r in best:
        want.setdefault(r.doc_id, []).append((r.term, r.support, r.score))
    got = {}
    for r in T.weighted_terms_of(docs, 5).orderBy("doc_id", "rank").collect():
        got.setdefault(r.doc_id, []).append((r.term, r.support, r.score))
    assert got == {d: x[:5] for d, x in want.items()}
    same(T.section_terms(docs, "source"), T.rolled_up(stats.join(docs.select("doc_id", "source"), "doc_id").drop("support"), "source"))
    assert not any(map(shuffles_rows, (T.keywords_of(docs), T.weighted_terms_of(docs))))


def test_phrases_and_retrieval_terms_of_whole_documents(spark):
    from evidex.operators import terms as T

    docs = odd_documents(spark, seed=3, words="abcd", n=25).where("doc_id <> 3")  # of a repeated id the order of words is open
    stats = T.rolled_up(T.leaf_terms(blocks(docs)), "doc_id")
    words = docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(f"({T.TERM})"), 1)).alias("i", "term"))
    ranked = T.keywords(stats, "doc_id").select("doc_id", "term", (13 - F.col("rank")).cast("double").alias("weight"))
    same(K.key_phrases_of(docs), K.key_phrases(words, ranked))
    docs = odd_documents(spark, seed=3, words="abcd", n=25)
    leaves = T.leaf_terms(blocks(docs))
    stats = T.rolled_up(leaves, "doc_id").withColumnRenamed("support", "df").join(T.follower_entropy(blocks(docs), "doc_id").drop("tf"), ["doc_id", "term"])
    same(K.retrieval_terms_of(docs, 6), K.retrieval_terms(stats, leaves.groupBy("doc_id").agg(F.countDistinct("pos").alias("n")), 6))
    assert not any(map(shuffles_rows, (K.key_phrases_of(docs), K.retrieval_terms_of(docs, 6))))


def test_distinct_lines_of_whole_documents(spark):
    from evidex.operators import terms as T

    docs = odd_documents(spark, seed=5, words="ab", n=40)
    b = blocks(docs).withColumn("n", F.length("body"))
    rows = b.groupBy("doc_id", "body", "n").agg(F.min("pos").alias("pos")).join(T.simhash(b, "doc_id", "pos"), ["doc_id", "pos"], "left")
    rows = rows.select("doc_id", F.col("pos").cast("long").alias("id"), F.col("n").cast("double").alias("score"), F.coalesce("simhash", F.lit(0)).alias("simhash"))
    same(K.distinct_lines(docs), K.not_seen_before(rows))
    assert not shuffles_rows(K.distinct_lines(docs))


def test_small_groups_take_no_frame_each(spark):
    """Reading order, first fit and prefixes of many small groups: rows of a key are read one after the other, not as a frame of pandas."""
    from evidex.operators import layout as L
    from evidex.operators import resolve as J
    from evidex.operators import retrieval as R

    pandas = lambda df: "FlatMapGroupsInPandas" in df._jdf.queryExecution().optimizedPlan().toString()
    box = "doc_id long, page long, id long, x0 double, y0 double, x1 double, y1 double, role string"
    rows = [(1, 0, 3, 20.0, 90.0, 280.0, 110.0, "text"), (1, 0, 1, 20.0, 10.0, 580.0, 30.0, "page_header"), (1, 0, 2, 320.0, 90.0, 580.0, 110.0, "text"), (1, 0, 0, None, None, None, None, None), (1, 1, 0, None, None, None, None, "text")]
    got = L.reading_order(spark.createDataFrame(rows, box))
    assert [(r.page, r.id, r.rule) for r in got.orderBy("page", "place").collect()] == [(0, 1, "spanner"), (0, 3, "column_flow"), (0, 2, "column_flow"), (0, 0, "fallback_row_major"), (1, 0, "fallback_row_major")]
    schema = "k long, id long, cost long, score double, mandatory boolean"
    fit = R.first_fit(spark.createDataFrame([(1, 5, 60, 0.5, False), (1, 4, 60, 0.5, False), (1, 6, 50, None, False), (2, 1, 101, 0.1, True), (None, 1, 1, 0.1, False)], schema), "k", 110, schema)
    assert sorted(map(tuple, fit.select("k", "id", "status").collect()), key=repr) == [(1, 4, "kept"), (1, 6, "kept"), (2, 1, "kept"), (None, 1, "kept")]
    gold = spark.createDataFrame([(1, 0, "same"), (1, 0, "other"), (1, 1, "same"), (1, 2, None), (2, 0, "same"), (1, 3, "so")], "doc_id long, gold long, prefix string")
    b = spark.createDataFrame([(1, 9, "same b"), (1, 7, "same a"), (1, 3, "other"), (1, 1, None), (1, 8, "so"), (1, 6, "some")], "doc_id long, pos long, text string")
    met = J.prefix_matches(gold, b, 4)
    assert sorted(map(tuple, met.collect())) == [(1, 0, 3), (1, 1, 7), (1, 2, -1), (1, 3, 8), (2, 0, -1)]
    assert not any(map(pandas, (got, fit, met))) and not shuffles_rows(met)


def test_python_workers_hold_bounded_batches(spark, tmp_path):
    """Batches of long rows, and what is made of them, are bounded however large the table is."""
    import pandas as pd

    from evidex.session import table
    from evidex.sources import markup as M
    from evidex.sources import office as O

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x "), 10_000).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    sizes = lambda df: df.mapInPandas(lambda it: (pd.DataFrame({"n": [len(b)]}) for b in it), "n long")
    most = sizes(table(spark, str(tmp_path), "documents").coalesce(1)).agg(F.max("n"), F.sum("n")).first()
    assert most[0] < 1000 and most[1] == 3000
    raw = O.make_xlsx(["w"] * 5000)
    files = spark.createDataFrame([(i, raw) for i in range(8)], "id long, content binary").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000000")
    try:
        cells = O.xlsx(files)
        assert cells.count() == 8 * 15_000
        pages = spark.createDataFrame([(i, "<p>a</p>" * 15_000) for i in range(4)], "id long, html string").coalesce(1)
        assert M.parsed(pages, "id", "html", "html").count() == 60_000
        assert O.OUT <= 20_000 and M.OUT <= 20_000
    finally:
        table(spark, str(tmp_path), "documents")
