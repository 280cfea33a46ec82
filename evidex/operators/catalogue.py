"""The catalogue of skills and the registry of documents: terms, scores, closures, versions and health."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

# Words that never count as terms.
STOPWORDS = ("the", "and", "for", "with", "from", "this", "that", "use", "using", "when", "into", "skill")
# What a block's role adds to its score.
ROLE_BONUS = {"guardrail": 0.4, "scope": 0.3, "workflow": 0.25, "step": 0.2, "example": -0.05}
# Words in a title or beginning that tell a block's role, the first that holds.
ROLE_WORDS = {
    "guardrail": "decision boundary|guardrail|global rules|safety|do not|negative trigger",
    "scope": "scope|in scope|out of scope|when to use|purpose",
    "troubleshooting": "troubleshooting|failure|error handling|fallback",
    "test": "testing|tests|validation|eval",
    "example": "example|examples|worked example",
    "reference": "reference|references|resource|resources",
    "workflow": "workflow|instructions|process|procedure",
    "identity": "role|persona|about|overview",
}


def lexical_terms(text: Column) -> Column:
    """Distinct terms in order: Latin tokens; of Han runs the run (up to 12) and its pairs, triples and fours."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9][a-z0-9_+.-]+|[\x{3400}-\x{9fff}]+)"), 1)
    han = lambda t: t.rlike(r"^[\x{3400}-\x{9fff}]")
    cut = lambda t, k: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: i <= F.length(t) - k + 1), lambda i: F.substring(t, i, F.lit(k)))
    grams = lambda t: F.concat(F.when(F.length(t) <= 12, F.array(t)).otherwise(F.array().cast("array<string>")), cut(t, 2), cut(t, 3), cut(t, 4))
    every = F.flatten(F.transform(runs, lambda t: F.when(han(t), grams(t)).otherwise(F.array(t))))
    return F.filter(F.array_distinct(every), lambda t: ~t.isin(*STOPWORDS))


def role(title: Column, body: Column) -> Column:
    probe = F.lower(F.concat_ws(" ", title, F.substring(body, 1, 240)))
    out = F.when(F.trim(title).rlike(r"(?i)^step\s*[0-9]+"), "step")
    for name, words in ROLE_WORDS.items():
        out = out.when(probe.rlike(words), name)
    return out.otherwise("content")


# Weight of a term by field, what an exact name adds and a negative term takes; coverage below which likeness counts, least likeness, its
# factor; share of the best score that is kept; coverage and score below which, and lead within which, the task is too vague.
FIELDS = {"name": 5.0, "description": 4.0, "trigger": 4.0, "enrichment": 2.0}
EXACT, NEGATIVE, THIN, ALIKE, ALIKE_FACTOR, KEPT, VAGUE, LEAD = 100.0, 8.0, 0.2, 0.35, 2.0, 0.35, (0.15, 1.0), 0.08


def mentioned(name: Column, task: str) -> Column:
    """Whether a task names this: as a word of its own, or anywhere if it has Han characters."""
    low, text = F.lower(name), F.lit(task.lower())
    quoted = F.regexp_replace(low, r"([^a-z0-9\s\x{3400}-\x{9fff}])", r"\\$1")
    return F.when(low.rlike(r"[\x{3400}-\x{9fff}]"), F.contains(text, low)).otherwise(F.regexp_like(text, F.concat(F.lit("(?<![a-z0-9])"), quoted, F.lit("(?![a-z0-9])"))))


def _exactly(rows: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first k rows as exact routes: 100, 99 and so on."""
    place = F.row_number().over(Window.orderBy("o")).cast("long")  # k rows at most
    some = rows.select("skill_id", F.struct(*order).alias("o")).orderBy("o").limit(k)
    return some.select(place.alias("place"), "skill_id").select("place", "skill_id", (101.0 - F.col("place")).alias("score"), F.lit(1.0).alias("coverage"), F.lit("exact").alias("route"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("code"))


def _refused(rows: DataFrame, code: str, k: int) -> DataFrame:
    """Candidates that a task does not tell apart, or none."""
    place = F.row_number().over(Window.orderBy("skill_id")).cast("long")  # k rows at most
    some = rows.select("skill_id").orderBy("skill_id").limit(k)
    return some.select(place.alias("place"), "skill_id", F.lit(1.0).alias("score"), F.lit(1.0).alias("coverage"), F.lit("exact").alias("route"), F.lit("needs_narrowing").alias("status"), F.lit(code).alias("code"))


def _by_name(hits: DataFrame, k: int) -> DataFrame:
    """Of rows (n: order of the name, skill_id, priority) the one of the highest priority for each name; the first name with several refuses."""
    best = hits.withColumn("p", F.rank().over(Window.partitionBy("n").orderBy(F.desc("priority")))).where("p = 1").withColumn("same", F.count("*").over(Window.partitionBy("n")))
    doubt = best.where("same > 1")
    if doubt.isEmpty():
        return _exactly(best, k, "n")
    return _refused(doubt.join(F.broadcast(doubt.agg(F.min("n").alias("n"))), "n", "left_semi"), "SKILL_AMBIGUOUS", k)  # one row


def routed(skills: DataFrame, task: str, names: tuple[str, ...] = (), k: int = 3) -> DataFrame:
    """place, skill_id, score, coverage, route, status, code of the skills that a task calls for; no skill: no rows.

    ``skills``: skill_id, qualified_name, name, priority, and arrays of terms name_, description_, trigger_, enrichment_ and
    negative_terms; ``ann``, if there, is a likeness of the skill to the task. Gates in turn: ``names`` asked for (an unknown one
    gives no rows), qualified names that the task mentions, names that it mentions (the longest first), then terms
    weighted by field and rarity. A gate that is open for nobody passes on; each looks at k rows at most beyond a sum.
    """
    if names:
        wanted = skills.sparkSession.createDataFrame([(i, n.lower()) for i, n in enumerate(names)], "n long, wanted string")
        ids = skills.select("skill_id", "priority", F.explode(F.array_distinct(F.array(F.lower("skill_id"), F.lower("qualified_name"), F.lower("name")))).alias("wanted"))
        hits = ids.join(F.broadcast(wanted), "wanted").select("n", "skill_id", "priority").distinct()
        known = hits.select("n").distinct().count() == len(names)
        return _by_name(hits, k) if known else _refused(skills.limit(0), "SKILL_LOW_CONFIDENCE", k)
    said = skills.where(mentioned(F.col("qualified_name"), task))
    if not said.isEmpty():
        return _exactly(said, k, -F.col("priority"), "qualified_name", "skill_id")
    said = skills.where(mentioned(F.col("name"), task))
    if not said.isEmpty():
        return _by_name(said.select(F.struct(-F.length("name"), F.lower("name")).alias("n"), "skill_id", "priority"), k)
    query = [r for r in skills.sparkSession.range(1).select(F.explode(lexical_terms(F.lit(task)))).toPandas().iloc[:, 0]]
    if not query:
        return _refused(skills.limit(0), "SKILL_LOW_CONFIDENCE", k)
    q, low = F.array(*map(F.lit, query)), F.lit(task.lower())
    own = skills.withColumn("every", F.array_distinct(F.concat(*[f"{f}_terms" for f in FIELDS])))
    n = own.count()
    df = own.select(F.explode(F.array_intersect("every", q)).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    rarity = {r.t: math.log(1 + (n + 0.5) / (r.df + 0.5)) for r in df.collect()}  # a row a term of the task
    of = lambda t, f: F.when(F.array_contains(f"{f}_terms", t), FIELDS[f]).otherwise(0.0)
    lexical = sum((rarity[t] * sum(of(t, f) for f in FIELDS) for t in query if t in rarity), F.lit(0.0))
    exact = F.contains(low, F.lower("name")) | F.contains(low, F.lower("qualified_name"))
    told_off = F.size(F.array_intersect("negative_terms", q))
    rows = own.withColumn("exact", exact).withColumn("coverage", F.size(F.array_intersect("every", q)) / len(query)).withColumn("lexical", lexical)
    alike = (F.col("coverage") < THIN) & (F.col("ann") >= ALIKE) if "ann" in skills.columns else F.lit(False)
    more = F.col("ann") * ALIKE_FACTOR if "ann" in skills.columns else F.lit(0.0)
    score = F.col("lexical") + F.when(F.col("exact"), EXACT).otherwise(-NEGATIVE * told_off) + F.when(alike, more).otherwise(0.0)
    route = F.when(alike, F.when(F.col("lexical") > 0, "lexical+hnsw").otherwise("hnsw")).otherwise("lexical")
    best = rows.select("skill_id", "qualified_name", "priority", "exact", "coverage", F.round(score, 9).alias("score"), route.alias("route")).where("score > 0").orderBy(F.desc("score"), F.desc("priority"), "qualified_name", "skill_id").limit(max(k, 2))
    order = Window.orderBy(F.desc("score"), F.desc("priority"), "qualified_name", "skill_id")  # max(k, 2) rows at most
    best = best.withColumn("place", F.row_number().over(order).cast("long"))
    every = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top, second = F.first("score").over(every), F.nth_value("score", 2).over(every)
    vague = ~F.first("exact").over(every) & (((F.first("coverage").over(every) < VAGUE[0]) & (top < VAGUE[1])) | F.coalesce((top - second) / F.greatest(top, F.lit(1e-9)) < LEAD, F.lit(False)))
    best = best.withColumn("top", top).withColumn("vague", vague).where((F.col("score") >= KEPT * F.col("top")) & (F.col("place") <= k))
    return best.select("place", "skill_id", F.round("score", 6).alias("score"), F.round("coverage", 6).alias("coverage"), "route", F.when(F.col("vague"), "needs_narrowing").otherwise("ok").alias("status"), F.when(F.col("vague"), "SKILL_LOW_CONFIDENCE").alias("code"))


def block_scores(blocks: DataFrame, query: list[str]) -> DataFrame:
    """block, score of blocks (block, role, terms, new_words) that share a term with the query."""
    q = F.array(*map(F.lit, query))
    hit, new = F.size(F.array_intersect("terms", q)), F.size(F.array_intersect("new_words", q))
    bonus = F.lit(0.0)
    for name, value in ROLE_BONUS.items():
        bonus = F.when(F.col("role") == name, value).otherwise(bonus)
    return blocks.where(hit > 0).select("block", F.round(hit / len(query) + 0.25 * new + bonus, 6).alias("score"))


def required_closure(seeds: DataFrame, parents: DataFrame, needs: DataFrame) -> DataFrame:
    """block, round: seeds (block) with all their ancestors (block, parent) and what any of them needs (block, needed).

    Rounds of one join each until nothing is new; a block is kept at its first round.
    """
    links = stored(parents.where("parent is not null").select("block", F.col("parent").alias("to")).union(needs.select("block", "needed")).distinct())
    seen = front = stored(seeds.select("block").distinct().withColumn("round", F.lit(0).cast("long")))
    step = 0
    while front.limit(1).count():
        step += 1
        new = front.join(links, "block").select(F.col("to").alias("block")).distinct()
        front = stored(new.join(seen, "block", "left_anti").withColumn("round", F.lit(step).cast("long")))
        seen = seen.union(front)
    return seen


def merged_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """name, generation, state of a catalogue after a sync: new, kept, superseded and its successor, missing, quarantined.

    ``old``: name, hash, generation; ``new``: name, hash, valid.
    """
    both = old.join(new.withColumnRenamed("hash", "new_hash"), "name", "full_outer")
    g = F.coalesce("generation", F.lit(0))
    row = lambda state, gen: F.struct(F.lit(state).alias("state"), gen.cast("long").alias("generation"))
    states = (
        F.when(F.col("new_hash").isNull(), F.array(row("missing", g))).when(~F.col("valid"), F.array(row("quarantined", g)))
        .when(F.col("hash").isNull(), F.array(row("active", F.lit(1)))).when(F.col("hash") == F.col("new_hash"), F.array(row("active", g)))
        .otherwise(F.array(row("superseded", g), row("active", g + 1)))
    )
    return both.select("name", F.inline(states)).select("name", "generation", "state")


def deleted(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows without those whose key is listed: what a rewrite of the partitions keeps."""
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def upserted(index: DataFrame, rows: DataFrame, key: str, digest: str) -> DataFrame:
    """The index after an upsert, with ``action``: skip (same digest), replace, insert or keep (not among the rows)."""
    old = index.select(key, F.col(digest).alias("_old"))
    both = old.join(rows.select(key, F.col(digest).alias("_new")), key, "full_outer")
    action = F.when(F.col("_new").isNull(), "keep").when(F.col("_old").isNull(), "insert").when(F.col("_old") == F.col("_new"), "skip").otherwise("replace")
    return both.select(key, F.coalesce("_new", "_old").alias(digest), action.alias("action"))


def store_health(registry: DataFrame, folders: DataFrame, locks: DataFrame, stale_after: int = 600) -> DataFrame:
    """check, n: active and superseded documents, active ones without a folder, folders of no document, stale locks.

    ``registry``: id, status; ``folders``: id; ``locks``: name, age (seconds).
    """
    rows = [
        registry.select(F.col("status").alias("check")),
        registry.where("status = 'active'").join(folders, "id", "left_anti").select(F.lit("missing_folder").alias("check")),
        folders.join(registry, "id", "left_anti").select(F.lit("orphan_folder").alias("check")),
        locks.where(F.col("age") > stale_after).select(F.lit("stale_lock").alias("check")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.groupBy("check").agg(F.count("*").alias("n"))


def without_furniture(blocks: DataFrame, furniture: DataFrame) -> DataFrame:
    """doc_id, pos, body of blocks without a document's furniture texts (doc_id, text), which go from within other blocks too.

    Only texts of eight characters or more are taken out, the longest first; blocks left empty go.
    """
    own = furniture.where(F.length("text") >= 8).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct((-F.length("text")).alias("n"), "text"))).alias("f"))
    rows = blocks.join(own, "doc_id", "left")
    clean = F.aggregate(F.coalesce("f", F.array().cast("array<struct<n:int,text:string>>")), F.col("body"), lambda b, f: F.replace(b, f["text"], F.lit(" ")))
    return rows.select("doc_id", "pos", F.trim(F.regexp_replace(clean, r"\s+", " ")).alias("body")).where("body <> ''")


def role_score(blocks: DataFrame, excluded: DataFrame) -> DataFrame:
    """matched, correct, unmatched, score: blocks that begin with an excluded text should be furniture.

    ``blocks``: text, role, h (its first characters); ``excluded``: prefix, h. Prefixes meet texts by ``h``.
    """
    met = excluded.join(blocks.select("h", "text", "role"), "h", "left").withColumn("hit", F.coalesce(F.startswith("text", F.col("prefix")), F.lit(False)))
    per = met.groupBy("prefix").agg(F.count_if("hit").alias("m"), F.count_if(F.col("hit") & F.col("role").isin("page_header", "page_footer")).alias("c"))
    g = per.agg(F.sum("m").alias("matched"), F.sum("c").alias("correct"), F.count_if(F.col("m") == 0).alias("unmatched"))
    return g.withColumn("score", F.round(F.col("correct") / (F.col("matched") + F.col("unmatched")), 4))


def routing_report(ranked: DataFrame) -> DataFrame:
    """top1, recall3 and median_reduction of cases (query, id, rank, wanted, cost, full_cost)."""
    w = ranked.groupBy("query").agg(F.max((F.col("wanted") & (F.col("rank") == 1)).cast("int")).alias("t"), F.max((F.col("wanted") & (F.col("rank") <= 3)).cast("int")).alias("r"), F.min(F.when(F.col("rank") == 1, 1 - F.col("cost") / F.col("full_cost"))).alias("d"))
    return w.agg(F.round(F.avg("t"), 6).alias("top1"), F.round(F.avg("r"), 6).alias("recall3"), F.round(F.percentile("d", F.lit(0.5)), 6).alias("median_reduction"))


def resource_actions(resources: DataFrame, most: int = 3) -> DataFrame:
    """skill, resource, action: required ones are read, referenced or relevant ones offered, ``most`` a skill."""
    optional = ~F.col("required") & (F.col("referenced") | (F.col("relevance") > 0))
    w = Window.partitionBy("skill", optional).orderBy(F.desc("relevance"), "resource")
    rows = resources.where(F.col("required") | optional).withColumn("n", F.row_number().over(w))
    return rows.where(F.col("required") | (F.col("n") <= most)).select("skill", "resource", F.when(F.col("required"), "read_required").otherwise("offer").alias("action"))
