"""Queries of the skill catalogue, the registry and its health; parts stand for skills, lines for their blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import catalogue as C
from ..session import table
from ..sources.text import blocks
from .search import BLOCKS_SQL


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(_docs(spark, sf_dir)).select("doc_id", F.col("pos").cast("long").alias("pos"), "body", F.length("body").alias("n"))


QUERY = ("the", "keit", "tion", "promo")


def skl01_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    text = F.concat_ws(" ", "p_name", "p_brand", "p_type", F.lit("and 資料工程師 with"), F.lit("the"))
    return p.select("p_partkey", F.array_join(C.lexical_terms(text), ",").alias("terms"))


def skl03_block_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_distinct(F.split(F.lower("body"), " "))
    role = F.element_at(F.array(*map(F.lit, ("guardrail", "scope", "workflow", "example", "content"))), (F.col("n") % 5 + 1).cast("int"))
    b = _blocks(spark, sf_dir).select(F.concat_ws(":", "doc_id", "pos").alias("block"), role.alias("role"), words.alias("terms"), F.slice(words, 1, 3).alias("new_words"))
    return C.block_scores(b, list(QUERY))


def skl05_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hold a rare ending, their ancestors (the line of half the number), and the next line where one is needed."""
    b = _blocks(spark, sf_dir)
    name = lambda p: F.concat_ws(":", "doc_id", p)
    seeds = b.where(F.col("body").contains("estion")).select(name(F.col("pos")).alias("block"))
    parents = b.select(name(F.col("pos")).alias("block"), F.when(F.col("pos") > 0, name(F.expr("pos div 2"))).alias("parent"))
    needs = b.where("n % 9 = 0").select(name(F.col("pos")).alias("block"), name(F.col("pos") + 1).alias("needed"))
    return C.required_closure(seeds, parents, needs).select("block")


def skl07_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("skill"), F.col("p_partkey").alias("resource"), (F.col("p_size") % 11 == 0).alias("required"), (F.col("p_size") % 3 == 0).alias("referenced"), (F.col("p_size") % 4).cast("long").alias("relevance"))
    return C.resource_actions(p)


def skl08_paged_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 400 characters of each text; only where the digest is still the one that was asked for and the path is safe."""
    d = _docs(spark, sf_dir).withColumn("path", F.concat(F.when(F.col("doc_id") % 6 == 0, "../").otherwise("res/"), "source")).withColumn("asked", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.md5("text")))
    safe = ~F.col("path").rlike(r"(^|/)\.\.(/|$)|^/")
    ok = d.where(safe & (F.md5("text") == F.col("asked")))
    pages = ok.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.expr("greatest(n_chars - 1, 0) div 400"))).alias("page"))
    return pages.select("doc_id", F.col("page").cast("long"), F.md5(F.substring("text", (F.col("page") * 400 + 1).cast("int"), F.lit(400))).alias("part_md5"))


def skl09_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("name"), F.md5("p_name").alias("hash"), "p_size")
    old = p.where("p_size % 5 <> 0").select("name", F.when(F.col("p_size") % 3 == 0, "old").otherwise(F.col("hash")).alias("hash"), (F.col("p_size") % 4 + 1).alias("generation"))
    return C.merged_versions(old, p.where("p_size % 7 <> 0").select("name", "hash", (F.col("p_size") % 11 != 0).alias("valid")))


def skl10_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.element_at(F.array(*map(F.lit, ("Step 1", "Scope", "Worked example", "Safety", "Overview", ""))), (F.col("pos") % 6 + 1).cast("int"))
    return _blocks(spark, sf_dir).groupBy(C.role(title, F.col("body")).alias("role")).agg(F.count("*").alias("n"))


def qlt06_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("query"), F.col("p_partkey").alias("id"), "p_size", "p_retailprice")
    w = Window.partitionBy("query").orderBy(F.desc("p_size"), "id")
    return C.routing_report(p.withColumn("rank", F.row_number().over(w)).select("query", "id", "rank", (F.col("p_size") % 2 == 0).alias("wanted"), F.col("p_size").cast("double").alias("cost"), F.lit(100.0).alias("full_cost")))


def qlt04_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beginnings of every hundredth character count of lines are furniture; whether such lines are typed so."""
    head = F.substring("body", 1, 10)
    b = _blocks(spark, sf_dir).select(F.col("body").alias("text"), head.alias("h"), F.when(F.col("n") % 3 == 0, "page_header").otherwise("text").alias("role"), "n")
    excluded = b.where("n % 10 = 0").select(F.substring("text", 1, 14).alias("prefix"), "h").distinct().union(spark.sql("SELECT 'no such line at all' AS prefix, 'no such li' AS h"))
    return C.role_score(b, excluded)


def qlt04_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of expected texts that a document's text holds, white space and case aside."""
    flat = lambda c: F.lower(F.regexp_replace(c, r"\s", ""))
    want = F.array(F.substring("text", 1, 12), F.upper(F.substring("source", 1, 3)), F.lit("qqqq"))
    found = F.size(F.filter(want, lambda t: F.contains(flat(F.col("text")), flat(t))))
    return _docs(spark, sf_dir).select("doc_id", F.round(found / 3, 4).alias("recall"))


def reg02_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return C.deleted(_docs(spark, sf_dir), gone, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


def reg03_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", F.md5("text").alias("hash"))
    old = d.where("doc_id % 3 <> 0").withColumn("hash", F.when(F.col("doc_id") % 4 == 0, "old").otherwise(F.col("hash")))
    return C.upserted(old, d.where("doc_id % 5 <> 0"), "doc_id", "hash").groupBy("action").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def agg21_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 == 0, "superseded").otherwise("active").alias("status"))
    locks = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), (F.col("s_suppkey") * 100).alias("age"))
    return C.store_health(d.where("id % 6 <> 0"), d.where("id % 5 <> 0").select("id"), locks)


def snk05_block_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without their document's first word pairs (of eight characters or more), wherever they stand."""
    b = _blocks(spark, sf_dir)
    f = b.where("pos < 2").select("doc_id", F.array_join(F.slice(F.split("body", " "), 1, 2), " ").alias("text"))
    return C.without_furniture(b, f).select("doc_id", "pos", F.md5("body").alias("body_md5"))


def snk06_viewer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The viewer's hits: 5 for a title, 3 for a preview, 2 for a body, 1 for metadata, for each term."""
    d = _docs(spark, sf_dir)
    fields = ((5, F.lower("source")), (3, F.lower(F.substring("text", 1, 160))), (2, F.lower("text")), (1, F.lower(F.concat_ws(" ", "lang", "source"))))
    score = sum((F.when(c.contains(t), w).otherwise(0) for t in ("en", "keit", "tion") for w, c in fields), F.lit(0)).cast("long")
    return d.select("doc_id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(50)


def src17_mailbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of mails as a manifest: outcome by name and content; errors are rows and stop nothing."""
    m = _docs(spark, sf_dir).select(F.concat(F.lit("in/"), F.when(F.col("doc_id") % 3 == 0, "sub/").otherwise(""), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, ".txt").otherwise(".eml")).alias("path"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("Subject: "), "source", F.lit("\n\n"), "lang")).alias("raw"))
    status = F.when(~F.col("path").rlike(r"\.(eml|msg)$"), "skipped").when(~F.col("raw").contains("Subject:"), "error:EMPTY").otherwise("ok")
    return m.groupBy(status.alias("status"), F.col("path").contains("/sub/").alias("nested")).agg(F.count("*").alias("n"))


def src21_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill packages among files: folders with a SKILL.md at most four levels down, none hidden, of bounded size."""
    k = F.col("p_partkey")
    path = F.concat(F.element_at(F.array(*map(F.lit, ("skills/", "a/b/c/", "a/b/c/d/e/", ".hid/"))), (k % 4 + 1).cast("int")), F.lit("p"), (F.floor(k / 2)).cast("string"), F.lit("/"), F.when(k % 2 == 0, "SKILL.md").otherwise("notes.md"))
    f = table(spark, sf_dir, "part").select(path.alias("path"), (F.col("p_size") * 60_000).alias("bytes"))
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    rows = f.where(~F.col("path").rlike(r"(^|/)\.")).withColumn("folder", folder).where(F.size(F.split("folder", "/")) <= 5)
    g = rows.groupBy("folder").agg(F.max(F.col("path").endswith("/SKILL.md").cast("int")).alias("has"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest"))
    return g.where("has = 1").select("folder", F.when((F.col("largest") > 2 << 20) | (F.col("bytes") > 10 << 20), "too_large").otherwise("ok").alias("status"))


QUERIES = {
    f.__name__: f
    for f in (agg21_health, qlt04_recall, qlt04_roles, qlt06_routing, reg02_deleted, reg03_upsert, skl01_terms, skl03_block_scores, skl05_closure, skl07_resources, skl08_paged_read, skl09_sync, skl10_roles, snk05_block_json, snk06_viewer, src17_mailbox, src21_packages)
}
_B = f"{BLOCKS_SQL}, b AS (SELECT doc_id, pos::BIGINT AS pos, body, length(body) AS n FROM blocks)"
_Q = "[" + ", ".join(f"'{q}'" for q in QUERY) + "]"
ORACLE = {
    "skl01_terms": """WITH t AS (SELECT p_partkey, regexp_extract_all(lower(p_name || ' ' || p_brand || ' ' || p_type), '[a-z0-9][a-z0-9_+.-]+') AS a FROM part),
        u AS (SELECT p_partkey, unnest(a) AS t, generate_subscripts(a, 1) AS i FROM t UNION ALL SELECT p_partkey, t, i FROM part, (VALUES ('資料工程師', 101), ('資料', 102), ('料工', 103), ('工程', 104), ('程師', 105), ('資料工', 106), ('料工程', 107), ('工程師', 108), ('資料工程', 109), ('料工程師', 110)) v(t, i)),
        d AS (SELECT p_partkey, t, min(i) AS i FROM u GROUP BY ALL) SELECT p_partkey, string_agg(t, ',' ORDER BY i) AS terms FROM d GROUP BY p_partkey""",
    "skl03_block_scores": f"""WITH {_B}, w AS (SELECT doc_id || ':' || pos AS block, n, string_split(lower(body), ' ') AS w FROM b),
        o AS (SELECT block, n, (SELECT list(x ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(w) AS x, generate_subscripts(w, 1) AS i) GROUP BY x)) AS d FROM w)
        SELECT block, round(len(list_intersect(d, {_Q})) / 4e0 + 0.25e0 * len(list_intersect(d[1:3], {_Q})) + CASE n % 5 WHEN 0 THEN 0.4e0 WHEN 1 THEN 0.3e0 WHEN 2 THEN 0.25e0 WHEN 3 THEN -0.05e0 ELSE 0e0 END, 6) AS score FROM o WHERE len(list_intersect(d, {_Q})) > 0""",
    "skl05_closure": f"""WITH RECURSIVE {_B}, l AS (SELECT doc_id, pos AS a, pos // 2 AS z FROM b WHERE pos > 0 UNION ALL SELECT doc_id, pos, pos + 1 FROM b WHERE n % 9 = 0),
        r(doc_id, pos) AS (SELECT doc_id, pos FROM b WHERE contains(body, 'estion') UNION SELECT l.doc_id, l.z FROM r JOIN l ON r.doc_id = l.doc_id AND r.pos = l.a)
        SELECT doc_id || ':' || pos AS block FROM r""",
    "skl07_resources": """WITH r AS (SELECT p_brand AS skill, p_partkey AS resource, p_size % 11 = 0 AS required, p_size % 4 AS relevance FROM part WHERE p_size % 11 = 0 OR p_size % 3 = 0 OR p_size % 4 > 0)
        SELECT skill, resource, CASE WHEN required THEN 'read_required' ELSE 'offer' END AS action FROM r QUALIFY required OR row_number() OVER (PARTITION BY skill, required ORDER BY relevance DESC, resource) <= 3""",
    "skl08_paged_read": "WITH p AS (SELECT doc_id, text, unnest(range(0, greatest(n_chars - 1, 0) // 400 + 1)) AS page FROM documents WHERE doc_id % 6 <> 0 AND doc_id % 5 <> 0) SELECT doc_id, page, md5(substring(text, page * 400 + 1, 400)) AS part_md5 FROM p",
    "skl09_sync": """WITH p AS (SELECT p_partkey::VARCHAR AS name, p_size AS s FROM part), a AS (SELECT *, s % 5 <> 0 AS old, s % 7 <> 0 AS new, s % 4 + 1 AS g FROM p)
        SELECT name, CASE WHEN old THEN g ELSE 0 END::BIGINT AS generation, CASE WHEN new THEN 'quarantined' ELSE 'missing' END AS state FROM a WHERE (old AND NOT new) OR (new AND s % 11 = 0)
        UNION ALL SELECT name, CASE WHEN NOT old THEN 1 WHEN s % 3 = 0 THEN g + 1 ELSE g END, 'active' FROM a WHERE new AND s % 11 <> 0 UNION ALL SELECT name, g, 'superseded' FROM a WHERE new AND old AND s % 11 <> 0 AND s % 3 = 0""",
    "skl10_roles": f"""WITH {_B}, t AS (SELECT lower(CASE pos % 6 WHEN 0 THEN 'Step 1' WHEN 1 THEN 'Scope' WHEN 2 THEN 'Worked example' WHEN 3 THEN 'Safety' WHEN 4 THEN 'Overview' ELSE '' END || ' ' || substring(body, 1, 240)) AS t, pos % 6 = 0 AS step FROM b)
        SELECT CASE WHEN step THEN 'step' {' '.join(f"WHEN regexp_matches(t, '{w}') THEN '{r}'" for r, w in C.ROLE_WORDS.items())} ELSE 'content' END AS role, count(*) AS n FROM t GROUP BY 1""",
    "qlt06_routing": """WITH r AS (SELECT p_brand AS q, p_size AS s, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rank FROM part),
        g AS (SELECT q, max((s % 2 = 0 AND rank = 1)::INT) AS t, max((s % 2 = 0 AND rank <= 3)::INT) AS r, min(1 - s / 100e0) FILTER (WHERE rank = 1) AS d FROM r GROUP BY q)
        SELECT round(avg(t), 6) AS top1, round(avg(r), 6) AS recall3, round(median(d), 6) AS median_reduction FROM g""",
    "qlt04_roles": f"""WITH {_B}, e AS (SELECT DISTINCT substring(body, 1, 14) AS prefix FROM b WHERE n % 10 = 0 UNION ALL SELECT 'no such line at all'),
        p AS (SELECT prefix, count(body) AS m, count(*) FILTER (WHERE n % 3 = 0) AS c FROM e LEFT JOIN b ON substring(body, 1, 10) = substring(prefix, 1, 10) AND starts_with(body, prefix) GROUP BY prefix)
        SELECT sum(m)::BIGINT AS matched, sum(c)::BIGINT AS correct, count(*) FILTER (WHERE m = 0) AS unmatched, round(sum(c) / (sum(m) + count(*) FILTER (WHERE m = 0)), 4) AS score FROM p""",
    "qlt04_recall": r"WITH f AS (SELECT doc_id, lower(regexp_replace(text, '\s', '', 'g')) AS t, lower(regexp_replace(substring(text, 1, 12), '\s', '', 'g')) AS a, lower(substring(source, 1, 3)) AS s FROM documents) SELECT doc_id, round((contains(t, a)::INT + contains(t, s)::INT + contains(t, 'qqqq')::INT) / 3e0, 4) AS recall FROM f",
    "reg02_deleted": "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY source",
    "reg03_upsert": """WITH a AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'keep' WHEN doc_id % 3 = 0 THEN 'insert' WHEN doc_id % 4 = 0 THEN 'replace' ELSE 'skip' END AS action FROM documents WHERE NOT (doc_id % 3 = 0 AND doc_id % 5 = 0)) SELECT action, count(*) AS n, min(doc_id) AS first FROM a GROUP BY action""",
    "agg21_health": """SELECT CASE WHEN doc_id % 4 = 0 THEN 'superseded' ELSE 'active' END AS "check", count(*) AS n FROM documents WHERE doc_id % 6 <> 0 GROUP BY 1
        UNION ALL SELECT 'missing_folder', count(*) FROM documents WHERE doc_id % 6 <> 0 AND doc_id % 4 <> 0 AND doc_id % 5 = 0 UNION ALL SELECT 'orphan_folder', count(*) FROM documents WHERE doc_id % 6 = 0 AND doc_id % 5 <> 0 UNION ALL SELECT 'stale_lock', count(*) FROM supplier WHERE s_suppkey * 100 > 600""",
    "snk05_block_json": f"""WITH {_B}, f AS (SELECT DISTINCT doc_id, array_to_string(string_split(body, ' ')[1:2], ' ') AS t FROM b WHERE pos < 2), g AS (SELECT doc_id, list(t ORDER BY -length(t), t) AS f FROM f WHERE length(t) >= 8 GROUP BY doc_id),
        r AS (SELECT doc_id, pos, body, coalesce(f, []) AS f FROM b LEFT JOIN g USING (doc_id)), c AS (SELECT doc_id, pos, trim(regexp_replace(CASE len(f) WHEN 0 THEN body WHEN 1 THEN replace(body, f[1], ' ') ELSE replace(replace(body, f[1], ' '), f[2], ' ') END, '\\s+', ' ', 'g')) AS t FROM r)
        SELECT doc_id, pos, md5(t) AS body_md5 FROM c WHERE t <> ''""",
    "snk06_viewer": f"""WITH s AS (SELECT doc_id, ({' + '.join(f"5 * contains(lower(source), '{t}')::INT + 3 * contains(lower(substring(text, 1, 160)), '{t}')::INT + 2 * contains(lower(text), '{t}')::INT + contains(lower(lang || ' ' || source), '{t}')::INT" for t in ('en', 'keit', 'tion'))})::BIGINT AS score FROM documents)
        SELECT * FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50""",
    "src17_mailbox": "SELECT CASE WHEN doc_id % 7 = 0 THEN 'skipped' WHEN doc_id % 5 = 0 THEN 'error:EMPTY' ELSE 'ok' END AS status, doc_id % 3 = 0 AS nested, count(*) AS n FROM documents GROUP BY ALL",
    "src21_packages": """WITH f AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 'skills/' WHEN 1 THEN 'a/b/c/' END || 'p' || p_partkey // 2 AS folder, p_partkey % 2 = 0 AS is_skill, p_size * 60000 AS bytes FROM part WHERE p_partkey % 4 IN (0, 1))
        SELECT folder, CASE WHEN max(bytes) > 2097152 OR sum(bytes) > 10485760 THEN 'too_large' ELSE 'ok' END AS status FROM f GROUP BY folder HAVING bool_or(is_skill)""",
}
COVERAGE = {
    "agg21_health": ("AGG21",), "qlt04_recall": ("QLT04",), "qlt04_roles": ("QLT04",), "qlt06_routing": ("QLT06",), "reg02_deleted": ("REG02",), "reg03_upsert": ("REG03",), "skl01_terms": ("SKL01",), "skl03_block_scores": ("SKL03",), "skl05_closure": ("SKL05",),
    "skl07_resources": ("SKL07",), "skl08_paged_read": ("SKL08",), "skl09_sync": ("SKL09",), "skl10_roles": ("SKL10",), "snk05_block_json": ("SNK05",), "snk06_viewer": ("SNK06",), "src17_mailbox": ("SRC17",), "src21_packages": ("SRC21",),
}
