"""Queries of term ranks, clause choice, routes and reading under budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ranking as K
from ..operators import terms as T
from ..session import table
from ..sources.text import blocks
from .search import BLOCKS_SQL
from .terms import LEAVES_SQL

TERMS = ("the", "tion", "estion")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(_docs(spark, sf_dir)).select("doc_id", F.col("pos").cast("long").alias("pos"), "body", F.length("body").alias("n"))


def agg04_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _blocks(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("leaves"), F.sum("n").alias("chars"))
    kind = F.element_at(F.array(*map(F.lit, ("paragraph", "page", "section", "document"))), (F.col("doc_id") % 4 + 1).cast("int"))
    support, freq = K.thresholds(kind, F.col("leaves"), F.col("chars"))
    return b.select("doc_id", support.alias("min_support"), freq.alias("min_freq"))


_LATIN, _HAN = "abcdefghijklmnopqrstuvwxyz", "一乙二十丁七卜八人入儿九几了乃刀力又三干于亏士土工才"


def agg06_new_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lines, their Latin letters written as Han characters."""
    return K.new_words_of(_docs(spark, sf_dir), _LATIN, _HAN).select("doc_id", F.col("rank").cast("long"), "term", "freq", "support", "left_entropy", "right_entropy", "score")


def nat24_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in Han characters without their spaces, cut into words by a lexicon of the words that occur five times or more."""
    han = F.translate(F.regexp_replace(F.lower("body"), "[^a-z ]", ""), _LATIN, _HAN)
    lines = _blocks(spark, sf_dir).select(F.concat_ws(":", "doc_id", "pos").alias("id"), han.alias("t"))
    lexicon = lines.select(F.explode(F.split("t", " ")).alias("entry")).where("entry <> ''").groupBy("entry").agg(F.count("*").alias("n")).where("n >= 5")
    found = T.segmented(lines.select("id", F.replace("t", F.lit(" "), F.lit("")).alias("text")), lexicon)
    return found.select("id", F.size("words").cast("long").alias("n_words"), F.md5(F.array_join("words", " ")).alias("words_md5"))


def agg07_search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = T.keywords_of(_docs(spark, sf_dir), 5).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("k"))
    every = F.array_distinct(F.concat(F.array(F.lower("source")), F.coalesce("k", F.array().cast("array<string>")), F.array("lang")))
    return _docs(spark, sf_dir).join(k, "doc_id", "left").select("doc_id", F.array_join(every, ",").alias("search_terms"))


def agg08_weighted_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.weighted_terms_of(_docs(spark, sf_dir)).select("doc_id", "rank", "term", "support", "score")


def agg09_text_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of two letters or more; a name is one with a capital that does not begin a sentence."""
    return K.text_rank(K.words_and_names(_docs(spark, sf_dir)))


def agg10_key_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.key_phrases_of(_docs(spark, sf_dir))


def agg12_retrieval_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.retrieval_terms_of(_docs(spark, sf_dir), K.TERMS_KEPT["document"])


def agg13_term_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many parts (for skills) each word occurs, in any field but the excluded one."""
    p = table(spark, sf_dir, "part")
    rows = p.select("p_partkey", F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(c).alias("t")) for k, c in (("name", "p_name"), ("type", "p_type"), ("negative", "p_brand"))])).alias("x"))
    terms = rows.where("x.field <> 'negative'").select("p_partkey", F.explode(F.split(F.lower("x.t"), " ")).alias("term"))
    return terms.groupBy("term").agg(F.countDistinct("p_partkey").alias("df"))


def agg18_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each document over its lines' digests in order."""
    b = _blocks(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.sha2("body", 256).alias("h")))).alias("x"))
    return b.select("doc_id", F.sha2(F.concat_ws("|", F.lit("v1"), F.array_join(F.transform("x", lambda r: r["h"]), ",")), 256).alias("digest"))


def agg22_budget_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading lines within budgets of 300, 600 and 1,200 characters: mean share of lines read, and likeness to the next larger budget's."""
    b = _blocks(spark, sf_dir)
    run = F.sum("n").over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    g = b.withColumn("run", run).groupBy("doc_id").agg(F.count("*").alias("all"), *[F.count_if(F.col("run") <= m).alias(f"b{m}") for m in (300, 600, 1200)])
    rows = g.select("all", F.explode(F.array(*[F.struct(F.lit(m).cast("long").alias("budget"), F.col(f"b{m}").alias("n"), F.col(f"b{min(1200, 2 * m)}").alias("next")) for m in (300, 600, 1200)])).alias("x")).select("all", "x.*")
    return rows.groupBy("budget").agg(F.round(F.avg(F.col("n") / F.col("all")), 6).alias("recall"), F.round(F.avg(F.when(F.col("next") > 0, F.col("n") / F.col("next")).otherwise(1.0)), 6).alias("likeness"))


def _clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.regexp_extract_all("body", F.lit(r"([^.!?,;]*[.!?,;]+|[^.!?,;]+)"), 1)
    return _blocks(spark, sf_dir).select("doc_id", "pos", F.posexplode(parts).alias("i", "clause")).select("doc_id", "pos", F.col("i").cast("long").alias("i"), "clause")


def fn24_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("clause")
    return _clauses(spark, sf_dir).groupBy("doc_id").agg(*[F.count_if(c.rlike(K.SIGNALS[k][1])).alias(f"n_{k}") for k in ("proper_noun", "quantity", "number", "acronym")], F.round(F.sum(K.discourse(c)), 4).alias("discourse"))


def sum10_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.kept_clauses(_clauses(spark, sf_dir)).groupBy("doc_id", "pos").agg(F.count("*").alias("n_kept"), F.min("i").alias("first"))


def sum07_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.term_likeness(_docs(spark, sf_dir))


def sum02_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct line of a document once, at its first place, with the span it takes in the joined text."""
    b = _blocks(spark, sf_dir).groupBy("doc_id", "body").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("body") + 2).over(w), F.lit(0))
    return b.select("doc_id", "pos", start.cast("long").alias("start"), (start + F.length("body")).cast("long").alias("end"))


def sum12_span_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses whose text is not what their span of the block holds: none, or an error row."""
    c = _clauses(spark, sf_dir)
    w = Window.partitionBy("doc_id", "pos").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = c.withColumn("start", F.coalesce(F.sum(F.length("clause")).over(w), F.lit(0))).join(_blocks(spark, sf_dir), ["doc_id", "pos"])
    ok = F.substring("body", F.col("start") + 1, F.length("clause")) == F.col("clause")
    return rows.groupBy(ok.alias("matches")).agg(F.count("*").alias("n"))


def agg26_summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters in, share that is kept and number of clauses of each document under the choice of clauses."""
    c = _clauses(spark, sf_dir)
    kept = K.kept_clauses(c).withColumn("kept", F.lit(True))
    n = F.length("clause")
    return c.join(kept, ["doc_id", "pos", "i"], "left").groupBy("doc_id").agg(F.sum(n).alias("input_chars"), F.round(F.sum(F.when(F.col("kept"), n).otherwise(0)) / F.sum(n), 6).alias("ratio"), F.count("kept").alias("selections"))


def ctx04_context_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("lang").alias("tags"), F.col("text").alias("body"))
    return K.context_search(d, TERMS)


def ctx07_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best of lexical hits and of what stands next to one (a hop further, at half of its score)."""
    hits = ctx04_context_search(spark, sf_dir)
    near = hits.select((F.col("id") + 1).alias("id"), F.round(F.col("score") / 2, 6).alias("score"), F.lit(1).cast("long").alias("hops")).join(_docs(spark, sf_dir).select(F.col("doc_id").alias("id")), "id", "left_semi")
    every = hits.select("id", "score", F.lit(0).cast("long").alias("hops")).union(near.select("id", "score", "hops"))
    best = every.groupBy("id").agg(F.min(F.struct("hops", (-F.col("score")).alias("s"))).alias("x")).select("id", "x.hops", (-F.col("x.s")).alias("score"))
    return best.orderBy("hops", F.desc("score"), "id").limit(3)


def ctx03_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of blocks with made-up parents and digests: unknown parent, wrong digest."""
    b = _blocks(spark, sf_dir).select("doc_id", "pos", F.when(F.col("n") % 13 == 0, "?").otherwise(F.md5("body")).alias("h"), F.md5("body").alias("now"), F.when(F.col("pos") > 0, F.col("pos") - 1).alias("parent"))
    ids = b.select("doc_id", F.col("pos").alias("parent"))
    missing = b.where("parent is not null").join(ids, ["doc_id", "parent"], "left_anti").select("doc_id", "pos", F.lit("PARENT_MISSING").alias("code"))
    return missing.union(b.where("h <> now").select("doc_id", "pos", F.lit("HASH_MISMATCH")))


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = T.section_terms(_docs(spark, sf_dir), "source")
    top = g.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("tf"), "term"))).where("r <= 40")
    cost = _docs(spark, sf_dir).groupBy("source").agg(F.sum("n_chars").alias("cost"))
    return top.groupBy("source").agg(F.array_join(F.sort_array(F.collect_list("term")), " ").alias("route")).join(cost, "source").select(F.col("source").alias("section"), "route", "cost")


def rnk08_routed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a term, only in the documents of the five sources whose route names most of the query."""
    best = K.routed(_routes(spark, sf_dir), TERMS)
    d = _docs(spark, sf_dir).join(best, F.col("source") == F.col("section"), "left_semi").select("doc_id", "source")
    return _blocks(spark, sf_dir).where(F.lower("body").contains("tion")).join(d, "doc_id").groupBy("source").agg(F.count("*").alias("n_hits"))


def rnk10_distinct_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lines of each document, longest first, without those whose terms are nearly those of one before."""
    return K.distinct_lines(_docs(spark, sf_dir))


def rnk16_batch_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.shared_budget(_blocks(spark, sf_dir).select("doc_id", F.col("pos").alias("place"), F.col("n").alias("chars")), 900, 250)


def rnk17_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best sentences of each of the five best lines, by weighted counts of the question's words."""
    count = lambda c, t: (F.length(c) - F.length(F.replace(c, F.lit(t), F.lit("")))) / len(t)
    low = F.lower("body")
    score = sum((3 * count(low, t) + count(F.substring(low, 1, 160), t) for t in TERMS), F.lit(0.0)) + 0.25
    best = _blocks(spark, sf_dir).withColumn("score", F.round(score, 4)).where("score > 1").orderBy(F.desc("score"), "doc_id", "pos").limit(5)
    s = best.select("doc_id", "pos", F.posexplode(F.regexp_extract_all("body", F.lit(r"([^.!?]+[.!?]?)"), 1)).alias("i", "s"))
    hits = s.withColumn("hits", sum((count(F.lower("s"), t) for t in TERMS), F.lit(0.0)).cast("long")).where("hits > 0")
    return hits.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "pos").orderBy(F.desc("hits"), "i"))).where("r <= 2").select("doc_id", "pos", F.col("i").cast("long"), "hits")


def rnk14_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as a profile shows them: without null fields; how many characters each profile takes."""
    d = _docs(spark, sf_dir).select("doc_id", "source", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang"), "n_chars")
    nav, evidence = F.to_json(F.struct("doc_id", "source")), F.to_json(F.struct("doc_id", "source", "lang", "n_chars"))
    return d.select("doc_id", F.length(nav).cast("long").alias("nav_chars"), evidence.alias("evidence"), (F.length(evidence) <= 60).alias("fits"))


def rnk07_granularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by the query's intent: sections for an overview, else lines; within a subtree (one language)."""
    d = _docs(spark, sf_dir).where("lang = 'en'").select("doc_id", "source")
    query = F.when(F.length("source") % 2 == 0, F.concat(F.lit("overview of "), "source")).otherwise("source")
    d = d.withColumn("level", F.when(query.rlike("overview|summary"), "section").otherwise("leaf"))
    sections = d.where("level = 'section'").select("level", F.col("source").alias("id")).distinct()
    leaves = _blocks(spark, sf_dir).join(d.where("level = 'leaf'"), "doc_id").select("level", F.concat_ws(":", "doc_id", "pos").alias("id"))
    return sections.union(leaves)


def tre05_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of 500 characters of each document's joined lines from a cursor on, and where to go on."""
    g = _blocks(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"]), "\n").alias("t"))
    part = F.substring("t", 101, 500)
    return g.select("doc_id", F.sha2(part, 256).alias("part_sha256"), F.when(F.length("t") > 600, 600).otherwise(-1).cast("long").alias("next_cursor"))


def tre04_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short and canonical ids of blocks, one made of the other."""
    canonical = F.concat(F.lit("db_"), F.col("doc_id").cast("string"), F.lit("_"), F.lpad(F.col("pos").cast("string"), 4, "0"))
    return _blocks(spark, sf_dir).select("doc_id", "pos", F.regexp_replace(canonical, "^db_[0-9]+_", "").alias("short_id"), canonical.alias("id"))


QUERIES = {
    f.__name__: f
    for f in (nat24_segments, agg04_thresholds, agg06_new_words, agg07_search_terms, agg08_weighted_terms, agg09_text_rank, agg10_key_phrases, agg12_retrieval_terms, agg13_term_skills, agg18_digests, agg22_budget_report, agg26_summary_stats, ctx03_integrity, ctx04_context_search, ctx07_evidence, fn24_signals, rnk07_granularity, rnk08_routed_search, rnk10_distinct_hits, rnk14_profiles, rnk16_batch_read, rnk17_answers, sum02_assembly, sum07_likeness, sum10_clauses, sum12_span_contract, tre04_ids, tre05_read)
}
_STATS = f"{LEAVES_SQL}, st AS (SELECT doc_id, term, sum(tf)::BIGINT AS tf, count(*) AS support FROM leaves GROUP BY ALL)"
_B = f"{BLOCKS_SQL}, b AS (SELECT doc_id, pos::BIGINT AS pos, body, length(body) AS n FROM blocks)"
_CLAUSES = f"""{_B}, c0 AS (SELECT doc_id, pos, regexp_extract_all(body, '[^.!?,;]*[.!?,;]+|[^.!?,;]+') AS x FROM b),
c AS (SELECT doc_id, pos, unnest(x) AS clause, unnest(range(len(x))) AS i FROM c0)"""
_DISCOURSE = f"CASE WHEN regexp_matches(lower(clause), '{'|'.join(K.FINDINGS)}') THEN 1e0 WHEN regexp_matches(lower(clause), '{'|'.join(K.CONCLUSIONS)}') THEN 0.75e0 ELSE 0.25e0 END"
_COUNT = lambda c, t: f"(length({c}) - length(replace({c}, '{t}', ''))) / {len(t)}e0"
_VALUE = " + ".join(f"CASE WHEN contains(ti, '{t}') OR contains(ta, '{t}') OR contains(bo, '{t}') THEN CASE WHEN contains(ti, '{t}') THEN 4e0 ELSE 0e0 END + CASE WHEN contains(ta, '{t}') THEN 2e0 ELSE 0e0 END + 1 + ln(1 + {_COUNT('bo', t)}) ELSE 0e0 END" for t in TERMS)
_MATCHED = " + ".join(f"(contains(ti, '{t}') OR contains(ta, '{t}') OR contains(bo, '{t}'))::INT" for t in TERMS)
_CONTEXT = f"""x AS (SELECT doc_id AS id, lower(source) AS ti, lower(lang) AS ta, lower(text) AS bo FROM documents),
h AS (SELECT id, ({_MATCHED})::BIGINT AS matched, round(({_VALUE}) * (0.5e0 + 0.5e0 * ({_MATCHED}) / 3), 6) AS score FROM x WHERE {_MATCHED} > 0)"""
ORACLE = {
    "agg04_thresholds": f"""WITH {_B}, g AS (SELECT doc_id, count(*) AS l, sum(n) AS c FROM b GROUP BY doc_id)
        SELECT doc_id, (CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN greatest(1, ceil(l * 0.05e0)) WHEN 2 THEN greatest(2, ceil(l * 0.03e0)) ELSE CASE WHEN c < 1000 THEN greatest(1, ceil(l * 0.01e0)) ELSE greatest(3, ceil(l * 0.01e0)) END END)::BIGINT AS min_support,
          (CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN greatest(2, ceil(c / 2000e0)) WHEN 2 THEN greatest(2, ceil(c / 3000e0)) ELSE CASE WHEN c < 1000 THEN 2 ELSE greatest(5, ceil(c / 5000e0)) END END)::BIGINT AS min_freq FROM g""",
    "agg06_new_words": f"""WITH {_B}, t AS (SELECT doc_id, pos, unnest(regexp_split_to_array(translate(lower(body), '{_LATIN}', '{_HAN}'), '[，。！？；：、,.!?;:\\n\\r\\t ]+')) AS s FROM b),
        r AS (SELECT doc_id, pos, regexp_replace(s, '[^一-鿿]', '', 'g') AS s FROM t),
        g AS (SELECT doc_id, pos, s, i, k FROM (SELECT *, unnest(range(1, length(s))) AS i FROM r), range(2, 5) z(k) WHERE i + k - 1 <= length(s)),
        o AS (SELECT doc_id, pos, substring(s, i, k) AS term, CASE WHEN i > 1 THEN s[i - 1] ELSE '<BOS>' END AS lf, CASE WHEN i + k <= length(s) THEN s[i + k] ELSE '<EOS>' END AS rt FROM g),
        f AS (SELECT doc_id, term, count(*) AS freq, count(DISTINCT pos) AS support FROM o GROUP BY ALL HAVING count(*) >= 2),
        l AS (SELECT doc_id, term, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS le FROM (SELECT doc_id, term, lf, count(*) AS n FROM o GROUP BY ALL) GROUP BY ALL),
        q AS (SELECT doc_id, term, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS re FROM (SELECT doc_id, term, rt, count(*) AS n FROM o GROUP BY ALL) GROUP BY ALL),
        e AS (SELECT *, CASE WHEN least(le, re) <= 1e-12 AND support > 1 THEN ln(support + 1) ELSE least(le, re) END AS free FROM f JOIN l USING (doc_id, term) JOIN q USING (doc_id, term)),
        v AS (SELECT doc_id, term, freq, support, round(abs(le), 4) AS left_entropy, round(abs(re), 4) AS right_entropy, round(freq * support * greatest(free, 0.1e0) * least(length(term), 6), 4) AS score FROM e)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank, * EXCLUDE (doc_id) FROM v QUALIFY rank <= 12""",
    "agg07_search_terms": f"""WITH {_STATS}, k AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY tf * support * least(length(term), 8) DESC, tf DESC, support DESC, term DESC) AS r FROM st QUALIFY r <= 5),
        a AS (SELECT doc_id, lower(source) AS t, 0 AS r FROM documents UNION ALL SELECT doc_id, term, r FROM k UNION ALL SELECT doc_id, lang, 9 FROM documents),
        f AS (SELECT doc_id, t, min(r) AS r FROM a GROUP BY ALL)
        SELECT doc_id, string_agg(t, ',' ORDER BY r) AS search_terms FROM f GROUP BY doc_id""",
    "agg08_weighted_terms": f"WITH {_STATS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY tf * support * support DESC, support DESC, term) AS rank, term, support, tf * support * support AS score FROM st QUALIFY rank <= 12",
    "agg10_key_phrases": f"""WITH {_STATS}, w0 AS (SELECT doc_id, regexp_extract_all(lower(text), '{T.TERM}') AS x FROM documents), w AS (SELECT doc_id, unnest(x) AS term, unnest(range(len(x))) AS i FROM w0),
        k AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY tf * support * least(length(term), 8) DESC, tf DESC, support DESC, term DESC) AS r FROM st QUALIFY r <= 12),
        h AS (SELECT doc_id, i, term, 13 - r AS weight, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM w JOIN k USING (doc_id, term)),
        p AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, run ORDER BY i) - 1) // 4 AS c FROM h),
        g AS (SELECT doc_id, string_agg(term, ' ' ORDER BY i) AS phrase, count(*) AS n, avg(weight) AS m FROM p GROUP BY doc_id, run, c HAVING count(*) > 1)
        SELECT doc_id, phrase, n, count(*) AS times, round(max(m) * (1 + 0.1e0 * (n - 1)) * (1 + 0.1e0 * ln(1 + count(*))), 6) AS weight FROM g GROUP BY doc_id, phrase, n""",
    "agg12_retrieval_terms": f"""WITH {_STATS}, n AS (SELECT doc_id, count(DISTINCT pos) AS n FROM leaves GROUP BY doc_id),
        w AS (SELECT doc_id, regexp_extract_all(lower(body), '{T.TERM}') AS w FROM blocks), f AS (SELECT doc_id, unnest(w) AS term, unnest(list_concat(w[2:], ['<EOS>'])) AS nxt FROM w WHERE len(w) > 0),
        m AS (SELECT doc_id, term, nxt, count(*) AS m FROM f GROUP BY ALL), e AS (SELECT doc_id, term, round(ln(sum(m)) - sum(m * ln(m)) / sum(m), 5) AS entropy FROM m GROUP BY doc_id, term),
        s AS (SELECT doc_id, term, round(tf * ln(1 + (n + 0.5e0) / (support + 0.5e0)) * (1 + least(length(term), 8) / 8e0) * (1 + least(1e0, entropy / 2e0)) * (1 + least(length(term), 8) / 8e0), 9) AS score FROM st JOIN n USING (doc_id) JOIN e USING (doc_id, term))
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank, term FROM s QUALIFY rank <= 16""",
    "agg13_term_skills": "SELECT term, count(DISTINCT p_partkey) AS df FROM (SELECT p_partkey, unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS term FROM part) GROUP BY term",
    "agg18_digests": f"WITH {_B} SELECT doc_id, sha256('v1|' || string_agg(sha256(body), ',' ORDER BY pos)) AS digest FROM b GROUP BY doc_id",
    "agg22_budget_report": f"""WITH {_B}, r AS (SELECT doc_id, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM b), g AS (SELECT doc_id, m, count(*) AS a, count(*) FILTER (WHERE run <= m) AS n, count(*) FILTER (WHERE run <= least(1200, 2 * m)) AS x FROM r, (SELECT unnest([300, 600, 1200]) AS m) GROUP BY ALL)
        SELECT m::BIGINT AS budget, round(avg(n / a), 6) AS recall, round(avg(CASE WHEN x > 0 THEN n / x ELSE 1 END), 6) AS likeness FROM g GROUP BY m""",
    "agg26_summary_stats": f"""WITH {_CLAUSES}, w AS (SELECT *, count(*) OVER p AS k, sum(length(clause)) OVER p AS chars FROM c WINDOW p AS (PARTITION BY doc_id, pos)),
        v AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY {{score}} DESC, i) AS place FROM w)
        SELECT doc_id, sum(length(clause))::BIGINT AS input_chars, round(coalesce(sum(length(clause)) FILTER (WHERE {{keep}}), 0) / sum(length(clause)), 6) AS ratio, count(*) FILTER (WHERE {{keep}}) AS selections FROM v GROUP BY doc_id""",
    "ctx03_integrity": f"""WITH {_B} SELECT x.doc_id, x.pos, 'PARENT_MISSING' AS code FROM b x WHERE pos > 0 AND NOT EXISTS (SELECT 1 FROM b y WHERE y.doc_id = x.doc_id AND y.pos = x.pos - 1) UNION ALL SELECT doc_id, pos, 'HASH_MISMATCH' FROM b WHERE n % 13 = 0""",
    "ctx04_context_search": f"WITH {_CONTEXT} SELECT * FROM h",
    "ctx07_evidence": f"""WITH {_CONTEXT}, a AS (SELECT id, score, 0::BIGINT AS hops FROM h UNION ALL SELECT h.id + 1, round(score / 2, 6), 1 FROM h JOIN documents ON doc_id = h.id + 1),
        m AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY id ORDER BY hops, score DESC) = 1) SELECT id, hops, score FROM m ORDER BY hops, score DESC, id LIMIT 3""",
    "fn24_signals": f"""WITH {_CLAUSES} SELECT d.doc_id, count(*) FILTER (WHERE regexp_matches(clause, '{K.SIGNALS["proper_noun"][1]}')) AS n_proper_noun, count(*) FILTER (WHERE regexp_matches(clause, '{K.SIGNALS["quantity"][1]}')) AS n_quantity,
        count(*) FILTER (WHERE regexp_matches(clause, '[0-9]')) AS n_number, count(*) FILTER (WHERE regexp_matches(clause, '{K.SIGNALS["acronym"][1]}')) AS n_acronym, round(sum({_DISCOURSE}), 4) AS discourse FROM c d GROUP BY d.doc_id""",
    "rnk10_distinct_hits": f"""WITH RECURSIVE {_B}, d AS (SELECT doc_id, body, n, min(pos) AS pos FROM b GROUP BY ALL),
        o AS (SELECT doc_id, pos, unnest(regexp_extract_all(lower(body), '{T.TERM}')) AS term FROM blocks), w AS (SELECT doc_id, pos, ('0x' || substring(md5(term), 1, 8))::BIGINT AS h, count(*) AS m FROM o GROUP BY ALL),
        u AS (SELECT doc_id, pos, z.z AS z, sum(CASE WHEN (h >> z.z) & 1 = 1 THEN m ELSE -m END) AS s FROM w CROSS JOIN range(32) z(z) GROUP BY ALL), k AS (SELECT doc_id, pos, sum(CASE WHEN s >= 0 THEN 1::BIGINT << z ELSE 0 END)::BIGINT AS h FROM u GROUP BY doc_id, pos),
        t AS (SELECT doc_id, d.pos, n, coalesce(h, 0) AS h, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, d.pos) AS r FROM d LEFT JOIN k USING (doc_id, pos)),
        f(doc_id, r, id, kept, hs) AS (SELECT doc_id, r, pos, true, [h] FROM t WHERE r = 1
          UNION ALL SELECT t.doc_id, t.r, t.pos, len(list_filter(f.hs, lambda q: bit_count(xor(q, t.h)) <= 3)) = 0, CASE WHEN len(list_filter(f.hs, lambda q: bit_count(xor(q, t.h)) <= 3)) = 0 THEN list_append(f.hs, t.h) ELSE f.hs END FROM f JOIN t ON t.doc_id = f.doc_id AND t.r = f.r + 1)
        SELECT doc_id, id FROM f WHERE kept""",
    "rnk16_batch_read": f"""WITH {_B}, w AS (SELECT doc_id, pos AS place, least(n, 250) AS want, coalesce(sum(least(n, 250)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
        SELECT doc_id, place, least(want, 900 - before)::BIGINT AS take FROM w WHERE least(want, 900 - before) > 0""",
    "rnk17_answers": f"""WITH {_B}, s AS (SELECT *, round({' + '.join(f"3 * {_COUNT('lower(body)', t)} + {_COUNT('substring(lower(body), 1, 160)', t)}" for t in TERMS)} + 0.25e0, 4) AS score FROM b),
        t AS (SELECT * FROM s WHERE score > 1 ORDER BY score DESC, doc_id, pos LIMIT 5), x AS (SELECT doc_id, pos, regexp_extract_all(body, '[^.!?]+[.!?]?') AS a FROM t), y AS (SELECT doc_id, pos, unnest(a) AS s, unnest(range(len(a))) AS i FROM x),
        h AS (SELECT doc_id, pos, i, ({' + '.join(_COUNT('lower(s)', t) for t in TERMS)})::BIGINT AS hits FROM y)
        SELECT doc_id, pos, i, hits FROM h WHERE hits > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY hits DESC, i) <= 2""",
    "rnk14_profiles": """WITH e AS (SELECT doc_id, '{"doc_id":' || doc_id || ',"source":"' || source || '"' AS a, CASE WHEN doc_id % 2 = 0 THEN ',"lang":"' || lang || '"' ELSE '' END || ',"n_chars":' || n_chars || '}' AS b FROM documents)
        SELECT doc_id, length(a) + 1 AS nav_chars, a || b AS evidence, length(a || b) <= 60 AS fits FROM e""",
    "rnk07_granularity": f"""WITH {_B} SELECT DISTINCT 'section' AS level, source AS id FROM documents WHERE lang = 'en' AND length(source) % 2 = 0
        UNION ALL SELECT 'leaf', doc_id || ':' || pos FROM b JOIN documents USING (doc_id) WHERE lang = 'en' AND length(source) % 2 = 1""",
    "rnk08_routed_search": f"""WITH {_STATS}, g AS (SELECT source, term, sum(tf) AS tf FROM st JOIN documents USING (doc_id) GROUP BY source, term QUALIFY row_number() OVER (PARTITION BY source ORDER BY sum(tf) DESC, term) <= 40),
        r AS (SELECT source, string_agg(term, ' ' ORDER BY term) AS route FROM g GROUP BY source), k AS (SELECT source, sum(n_chars) AS cost FROM documents GROUP BY source),
        m AS (SELECT source, {' + '.join(f"contains(route, '{t}')::INT" for t in TERMS)} AS matched, cost FROM r JOIN k USING (source)), top AS (SELECT source FROM m WHERE matched > 0 ORDER BY matched DESC, cost, source LIMIT 5)
        SELECT source, count(*) AS n_hits FROM blocks JOIN documents USING (doc_id) JOIN top USING (source) WHERE contains(lower(body), 'tion') GROUP BY source""",
    "sum02_assembly": f"""WITH {_B}, u AS (SELECT doc_id, body, min(pos) AS pos FROM b GROUP BY ALL), s AS (SELECT doc_id, pos, length(body) AS n, coalesce(sum(length(body) + 2) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM u)
        SELECT doc_id, pos, start, start + n AS "end" FROM s""",
    "sum07_likeness": f"""WITH {LEAVES_SQL}, d AS (SELECT doc_id, term, count(*) AS df FROM leaves GROUP BY ALL), t AS (SELECT doc_id, pos AS i, term, tf, df FROM leaves JOIN d USING (doc_id, term)),
        z AS (SELECT doc_id, i, sum(tf) AS len FROM t GROUP BY ALL), q AS (SELECT doc_id, count(*) AS n, avg(len) AS mean FROM z GROUP BY doc_id),
        p AS (SELECT doc_id, term, i, ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * len / mean)) AS p FROM t JOIN z USING (doc_id, i) JOIN q USING (doc_id)),
        v AS (SELECT x.doc_id, x.i AS "left", y.i AS "right", sum((x.p + y.p) / 2) AS v FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.term = y.term AND x.i < y.i GROUP BY ALL)
        SELECT doc_id, "left", "right", round(v / (1 + v), 5) AS likeness FROM v""",
    "sum12_span_contract": f"""WITH {_CLAUSES}, s AS (SELECT doc_id, pos, clause, coalesce(sum(length(clause)) OVER (PARTITION BY doc_id, pos ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM c)
        SELECT substring(body, start::BIGINT + 1, length(clause)) = clause AS matches, count(*) AS n FROM s JOIN b USING (doc_id, pos) GROUP BY 1""",
    "tre04_ids": f"WITH {_B} SELECT doc_id, pos, lpad(pos::VARCHAR, 4, '0') AS short_id, 'db_' || doc_id || '_' || lpad(pos::VARCHAR, 4, '0') AS id FROM b",
    "tre05_read": f"WITH {_B}, g AS (SELECT doc_id, string_agg(body, chr(10) ORDER BY pos) AS t FROM b GROUP BY doc_id) SELECT doc_id, sha256(substring(t, 101, 500)) AS part_sha256, CASE WHEN length(t) > 600 THEN 600 ELSE -1 END::BIGINT AS next_cursor FROM g",
}
_SIGNAL_SQL = "least(1e0, " + " + ".join(f"CASE WHEN regexp_matches(clause, '{p.replace(chr(39), chr(39) * 2)}') THEN {w}e0 ELSE 0e0 END" for w, p in K.SIGNALS.values()) + ")"
_SCORE = f"round(0.6e0 * {_DISCOURSE} + 0.25e0 * {_SIGNAL_SQL} + 0.15e0 * (1 - i / k), 6)"
_KEEP = f"NOT (k >= 3 AND chars > 240) OR place <= 2 OR regexp_matches(clause, '{K.NEGATION}')"
ORACLE["agg26_summary_stats"] = ORACLE["agg26_summary_stats"].replace("{score}", _SCORE).replace("{keep}", _KEEP)
ORACLE["sum10_clauses"] = f"""WITH {_CLAUSES}, w AS (SELECT *, count(*) OVER p AS k, sum(length(clause)) OVER p AS chars FROM c WINDOW p AS (PARTITION BY doc_id, pos)),
        v AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY {_SCORE} DESC, i) AS place FROM w) SELECT doc_id, pos, count(*) AS n_kept, min(i) AS first FROM v WHERE {_KEEP} GROUP BY doc_id, pos"""
COVERAGE = {
    "agg04_thresholds": ("AGG04",), "agg06_new_words": ("AGG06",), "nat24_segments": ("NAT24",), "agg07_search_terms": ("AGG07",), "agg08_weighted_terms": ("AGG08",), "agg09_text_rank": ("AGG09",), "agg10_key_phrases": ("AGG10",), "agg12_retrieval_terms": ("AGG12",), "agg13_term_skills": ("AGG13",),
    "agg18_digests": ("AGG18",), "agg22_budget_report": ("AGG22",), "agg26_summary_stats": ("AGG26",), "ctx03_integrity": ("CTX03",), "ctx04_context_search": ("CTX04",), "ctx07_evidence": ("CTX07",), "fn24_signals": ("FN24", "FN25"), "rnk07_granularity": ("RNK07",),
    "rnk08_routed_search": ("RNK08", "RNK09", "SRT03"), "rnk10_distinct_hits": ("RNK10",), "rnk14_profiles": ("RNK14", "RNK18", "FN26"), "rnk16_batch_read": ("RNK16",), "rnk17_answers": ("RNK17",), "sum02_assembly": ("SUM02",), "sum07_likeness": ("SUM05", "SUM07"), "sum10_clauses": ("SUM10",),
    "sum12_span_contract": ("SUM12",), "tre04_ids": ("TRE04",), "tre05_read": ("TRE05",),
}
