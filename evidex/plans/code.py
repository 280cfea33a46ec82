"""Queries of the code graph: a module of made-up source for each supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import resolve as R
from ..session import table
from ..sources import code as C

# A supplier's module: imports of every kind, a class with a base and a method, a function, a call that cannot be resolved.
LINES = (
    "import os", "from .core import base", "from ..shared.tools import *", "if TYPE_CHECKING:", "    import typing", "try:", "    import fast", "except ImportError:", "    fast = None",
    "@register", "class S{k}(base.Node):", "    def run(self):", "        import json", "        return helper_{n}(os.path.join('a', 'b'))", "def helper_{n}(x):", "    return eval(x)",
)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content, supplier; one in ten does not parse."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    text = F.lit("\n".join(LINES))
    for name in ("k", "n"):
        text = F.replace(text, F.lit("{%s}" % name), F.col(name).cast("string"))
    path = F.concat(F.lit("pkg/n"), F.col("n").cast("string"), F.lit("/s"), F.col("k").cast("string"), F.lit(".py"))
    return s.select("k", "n", path.alias("path"), F.when(F.col("k") % 10 == 0, "def (:").otherwise(text).alias("content"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.parsed(files(spark, sf_dir))


def cg01_code_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).groupBy("row", "kind").agg(F.count("*").alias("n"), F.countDistinct("path").alias("n_files"))


def cg02_import_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).where("kind = 'import'").groupBy("name", F.col("detail").alias("class")).agg(F.count("*").alias("n"))


def cg03_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sync has to parse again: files changed, new, gone or as they were, by digest."""
    f = files(spark, sf_dir).select("path", "k", F.md5("content").alias("h"))
    old = f.where("k % 7 <> 0").select("path", F.when(F.col("k") % 3 == 0, "old").otherwise(F.col("h")).alias("old_h"))
    both = f.where("k % 5 <> 0").select("path", "h").join(old, "path", "full_outer")
    state = F.when(F.col("h").isNull(), "deleted").when(F.col("old_h").isNull(), "added").when(F.col("h") == F.col("old_h"), "unchanged").otherwise("changed")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def cg04_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the calls, bases and decorators of all modules are resolved: by name and status."""
    f = files(spark, sf_dir)
    r = R.code_references(C.parsed(f), C.bindings(f))
    return r.groupBy("kind", F.regexp_replace("name", "[0-9]+$", "").alias("name"), "status").agg(F.count("*").alias("n"), F.countDistinct("target").alias("n_targets"))


def cg05_absolute_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _rows(spark, sf_dir).where("kind = 'import' and name like '.%'").select("path", "owner", F.split("name", ":")[0].alias("from"))
    return i.groupBy(C.absolute(F.col("owner"), F.lit(False), F.col("from")).alias("module")).agg(F.count("*").alias("n"))


def cg06_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.packages(_rows(spark, sf_dir).where("kind = 'module'").select("name"))


def cg11_impact_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each helper: callers by the name alone, public functions among them, and how many of the edges are certain."""
    r = _rows(spark, sf_dir)
    calls = r.where("kind = 'call' and name like 'helper_%'").select(F.col("name").alias("callee"), "owner", "path")
    own = r.where("kind = 'function'").select(F.element_at(F.split("name", r"\."), -1).alias("callee"), F.col("path").alias("def_path")).distinct()
    n = own.groupBy("callee").agg(F.count("*").alias("n_definitions"))
    return calls.join(n, "callee").groupBy("callee").agg(F.count("*").alias("n_callers"), F.count_if(~F.col("owner").rlike(r"\._")).alias("n_public"), F.count_if(F.col("n_definitions") == 1).alias("n_hard"))


def cg12_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of code that are read only if the file's and the block's digests are still those of the graph."""
    f = files(spark, sf_dir).where("k % 10 <> 0")
    seen = f.select("path", F.sha2(F.when(F.col("k") % 4 == 0, F.lit("other")).otherwise(F.col("content")), 256).alias("file_hash"), F.sha2(F.element_at(F.split("content", "\n"), 10), 256).alias("block_hash"))
    now = f.select("path", F.sha2("content", 256).alias("h"), F.element_at(F.split("content", "\n"), 10).alias("block"))
    ok = (F.col("h") == F.col("file_hash")) & (F.sha2("block", 256) == F.col("block_hash"))
    return now.join(seen, "path").select("path", F.when(ok, F.col("block")).alias("block"), F.when(ok, "ok").otherwise("STALE").alias("status"))


def cg14_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blind spots of all files, numbered within each."""
    spots = _rows(spark, sf_dir).where("row = 'blindspot'")
    return spots.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("line", "kind")).cast("long")).select("n", "path", "kind", "line")


def cg15_code_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query and read in one: who defines a helper, with the line of its definition."""
    defs = _rows(spark, sf_dir).where("kind = 'function'").select("path", "line", F.element_at(F.split("name", r"\."), -1).alias("name"))
    text = files(spark, sf_dir).select("path", F.posexplode(F.split("content", "\n")).alias("i", "text"))
    return defs.join(text, "path").where("i = line - 1").select("path", "name", "line", "text")


def ctx02_code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and functions as context blocks; the parent is the owner, calls of a unique name are relations."""
    r = _rows(spark, sf_dir)
    blocks = r.where("kind in ('class', 'function', 'method')").select(F.col("name").alias("block"), "owner", F.element_at(F.split("name", r"\."), -1).alias("short"))
    unique = blocks.groupBy("short").agg(F.count("*").alias("n"), F.min("block").alias("target")).where("n = 1")
    calls = r.where("kind = 'call'").select(F.col("owner").alias("block"), F.col("name").alias("short")).join(unique, "short").select("block", "target")
    return blocks.join(calls, "block", "left").groupBy("block", F.col("owner").alias("parent")).agg(F.count("target").alias("n_calls"))


def src19_scip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index documents of parts' symbols, with ranges of three or four numbers."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.concat(F.lit("b"), F.regexp_replace("p_brand", "[^0-9]", ""), F.lit(".py")).alias("path"))
    k = F.col("p_size").cast("int")
    rng = F.when(F.col("p_partkey") % 2 == 0, F.array(k, F.lit(4), F.lit(9))).otherwise(F.array(k, F.lit(4), k + 1, F.lit(2)))
    occ = p.groupBy("path").agg(F.collect_list(F.struct(F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("symbol"), rng.alias("range"))).alias("occurrences"))
    index = occ.select(F.to_json(F.struct(F.array(F.struct(F.col("path").alias("relative_path"), "occurrences")).alias("documents"))).alias("json"))
    return C.scip_symbols(index)


def src22_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.element_at(F.array(*map(F.lit, ("src/", "build/lib/", "a/.git/", "", "pkg/__pycache__/"))), (F.col("p_partkey") % 5 + 1).cast("int")), F.lit("f"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 3 == 0, ".txt").otherwise(".py"))
    return table(spark, sf_dir, "part").select(path.alias("path")).where(C.wanted(F.col("path")))


QUERIES = {f.__name__: f for f in (cg01_code_rows, cg02_import_classes, cg03_sync, cg04_resolution, cg05_absolute_imports, cg06_packages, cg11_impact_receipt, cg12_evidence, cg14_uncertainty, cg15_code_context, ctx02_code_blocks, src19_scip, src22_scanned)}
_F = "f AS (SELECT s_suppkey AS k, s_nationkey AS n, 'pkg/n' || s_nationkey || '/s' || s_suppkey || '.py' AS path, 'pkg.n' || s_nationkey || '.s' || s_suppkey AS module, s_suppkey % 10 <> 0 AS ok FROM supplier)"
_PER_FILE = "('node', 'class', 1), ('node', 'method', 1), ('node', 'function', 1), ('occurrence', 'import', 6), ('occurrence', 'decorator', 1), ('occurrence', 'base', 1), ('occurrence', 'call', 2), ('blindspot', 'STAR_IMPORT', 1), ('blindspot', 'DYNAMIC_CALL', 1)"
ORACLE = {
    "cg01_code_rows": f"""WITH {_F}, k(row, kind, each) AS (VALUES {_PER_FILE}), n AS (SELECT count(*) AS good FROM f WHERE ok)
        SELECT k.row, kind, each * good AS n, good AS n_files FROM k CROSS JOIN n UNION ALL SELECT 'node', 'module', count(*), count(*) FROM f UNION ALL SELECT 'blindspot', 'SYNTAX_ERROR', count(*), count(*) FROM f WHERE NOT ok HAVING count(*) > 0""",
    "cg02_import_classes": f"""WITH {_F}, k(name, class) AS (VALUES ('os', 'runtime'), ('.core:base', 'runtime'), ('..shared.tools:*', 'runtime'), ('typing', 'type_checking'), ('fast', 'optional'), ('json', 'local')) SELECT name, class, count(*) AS n FROM k CROSS JOIN f WHERE ok GROUP BY ALL""",
    "cg03_sync": f"""WITH {_F}, s AS (SELECT CASE WHEN k % 5 = 0 THEN 'deleted' WHEN k % 7 = 0 THEN 'added' WHEN k % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS state FROM f WHERE NOT (k % 5 = 0 AND k % 7 = 0)) SELECT state, count(*) AS n FROM s GROUP BY state""",
    "cg05_absolute_imports": f"WITH {_F} SELECT 'pkg.n' || n || '.core' AS module, count(*) AS n FROM f WHERE ok GROUP BY f.n UNION ALL SELECT 'pkg.shared.tools', count(*) FROM f WHERE ok",
    "cg06_packages": f"WITH {_F} SELECT DISTINCT 'pkg.n' || n AS package FROM f UNION ALL SELECT 'pkg'",
    "cg11_impact_receipt": f"WITH {_F} SELECT 'helper_' || n AS callee, count(*) AS n_callers, count(*) AS n_public, CASE WHEN count(*) = 1 THEN 1 ELSE 0 END AS n_hard FROM f WHERE ok GROUP BY n",
    "cg12_evidence": f"WITH {_F} SELECT path, CASE WHEN k % 4 <> 0 THEN '{LINES[9]}' END AS block, CASE WHEN k % 4 <> 0 THEN 'ok' ELSE 'STALE' END AS status FROM f WHERE ok",
    "cg14_uncertainty": f"""WITH {_F}, s AS (SELECT path, kind, line FROM f, (VALUES ('STAR_IMPORT', 3), ('DYNAMIC_CALL', 16)) t(kind, line) WHERE ok UNION ALL SELECT path, 'SYNTAX_ERROR', 1 FROM f WHERE NOT ok)
        SELECT row_number() OVER (PARTITION BY path ORDER BY line, kind) AS n, path, kind, line::BIGINT AS line FROM s""",
    "cg15_code_context": f"WITH {_F} SELECT path, 'helper_' || n AS name, 15::BIGINT AS line, 'def helper_' || n || '(x):' AS text FROM f WHERE ok",
    "ctx02_code_blocks": f"""WITH {_F}, u AS (SELECT n FROM f WHERE ok GROUP BY n HAVING count(*) = 1)
        SELECT module || '.S' || k AS block, module AS parent, 0::BIGINT AS n_calls FROM f WHERE ok UNION ALL SELECT module || '.helper_' || n, module, 0 FROM f WHERE ok
        UNION ALL SELECT module || '.S' || k || '.run', module || '.S' || k, CASE WHEN n IN (SELECT n FROM u) THEN 1 ELSE 0 END FROM f WHERE ok""",
    "src19_scip": "SELECT 'b' || regexp_replace(p_brand, '[^0-9]', '', 'g') || '.py' AS path, 's' || p_partkey AS symbol, p_size AS line, 4 AS first, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE p_size + 1 END AS last_line, CASE WHEN p_partkey % 2 = 0 THEN 9 ELSE 2 END AS last FROM part",
    "src22_scanned": "SELECT CASE p_partkey % 5 WHEN 0 THEN 'src/' ELSE '' END || 'f' || p_partkey || '.py' AS path FROM part WHERE p_size % 3 <> 0 AND p_partkey % 5 IN (0, 3)",
}
COVERAGE = {
    "cg01_code_rows": ("CG01", "UDF04"), "cg02_import_classes": ("CG02",), "cg03_sync": ("CG03",), "cg04_resolution": ("CG04", "JOI11"), "cg05_absolute_imports": ("CG05",), "cg06_packages": ("CG06",), "cg11_impact_receipt": ("CG11",), "cg12_evidence": ("CG12",), "cg14_uncertainty": ("CG14",), "cg15_code_context": ("CG15",),
    "ctx02_code_blocks": ("CTX02",), "src19_scip": ("SRC19",), "src22_scanned": ("SRC22",),
}
