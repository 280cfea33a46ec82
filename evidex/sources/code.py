"""Python sources as tables: nodes, occurrences and blind spots of each file."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, row string, kind string, name string, owner string, line long, detail string"
# Calls whose target cannot be known from the text.
DYNAMIC = {"eval", "exec", "getattr", "__import__", "importlib.import_module"}


def dotted(node: ast.AST | None) -> str:
    """a.b.c of names and attributes; empty for anything else."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if not isinstance(node, ast.Name):
        return ""
    return ".".join([node.id, *reversed(parts)])


def module_name(path: str) -> str:
    parts = path.removesuffix(".py").split("/")
    return ".".join(parts[:-1] if parts[-1] == "__init__" else parts)


class _Walk(ast.NodeVisitor):
    """Collects rows in one pass; ``where`` holds what kind of statement an import stands below."""

    def __init__(self, path: str):
        self.path, self.owner, self.where, self.rows = path, [module_name(path)], [], []

    def add(self, row: str, kind: str, name: str, node: ast.AST | None, detail: str = "") -> None:
        self.rows.append((self.path, row, kind, name, self.owner[-1], getattr(node, "lineno", 1), detail))

    def scope(self, kind: str, node: ast.AST) -> None:
        self.add("node", kind, f"{self.owner[-1]}.{node.name}", node)
        for d in node.decorator_list:
            self.add("occurrence", "decorator", dotted(d.func if isinstance(d, ast.Call) else d), d)
        for b in getattr(node, "bases", ()):
            self.add("occurrence", "base", dotted(b), b)
        self.owner.append(f"{self.owner[-1]}.{node.name}")
        self.where.append("class" if kind == "class" else "local")
        for child in node.body:
            self.visit(child)
        self.owner.pop()
        self.where.pop()

    def visit_ClassDef(self, node: ast.ClassDef) -> None:  # noqa: N802
        self.scope("class", node)

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:  # noqa: N802
        self.scope("method" if self.where[-1:] == ["class"] else "function", node)

    visit_AsyncFunctionDef = visit_FunctionDef

    def below(self, how: str, node: ast.AST) -> None:
        self.where.append(how)
        self.generic_visit(node)
        self.where.pop()

    def visit_If(self, node: ast.If) -> None:  # noqa: N802
        self.below("type_checking" if dotted(node.test) in ("TYPE_CHECKING", "typing.TYPE_CHECKING") else "conditional", node)

    def visit_Try(self, node: ast.Try) -> None:  # noqa: N802
        self.below("optional" if any(dotted(h.type).endswith("ImportError") for h in node.handlers) else "conditional", node)

    def imported(self, name: str, node: ast.AST) -> None:
        how = [w for w in self.where if w != "class"]
        self.add("occurrence", "import", name, node, how[-1] if how else "runtime")

    def visit_Import(self, node: ast.Import) -> None:  # noqa: N802
        for a in node.names:
            self.imported(a.name, node)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:  # noqa: N802
        base = "." * node.level + (node.module or "")
        for a in node.names:
            if a.name == "*":
                self.add("blindspot", "STAR_IMPORT", base, node)
            self.imported(f"{base}:{a.name}", node)

    def visit_Call(self, node: ast.Call) -> None:  # noqa: N802
        name = dotted(node.func)
        if name in DYNAMIC or not name:
            self.add("blindspot", "DYNAMIC_CALL", name, node)
        else:
            self.add("occurrence", "call", name, node)
        self.generic_visit(node)


def rows_of(path: str, content: str | None) -> list[tuple]:
    """Rows of one file; a file that does not parse is a module with a blind spot."""
    w = _Walk(path)
    w.add("node", "module", module_name(path), None)
    try:
        tree = ast.parse(content or "")
    except (SyntaxError, ValueError, RecursionError) as e:
        w.add("blindspot", "SYNTAX_ERROR", type(e).__name__, None)
        return w.rows
    w.visit(tree)
    return w.rows


def parsed(files: DataFrame) -> DataFrame:
    """path, row (node, occurrence, blindspot), kind, name, owner, line, detail of files (path, content)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for df in it:
            rows = [r for p, c in zip(df["path"], df["content"], strict=True) for r in rows_of(p, c)]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(run, SCHEMA)


BINDINGS = "path string, kind string, scope string, name string, target string"


class _Bindings(ast.NodeVisitor):
    """What names stand for: imports (alias), types of attributes, variables and parameters (type), bases of classes (base)."""

    def __init__(self, path: str):
        self.path, self.scope, self.classes, self.rows = path, [module_name(path)], [], []
        self.package = self.scope[0].split(".")[: None if path.endswith("__init__.py") else -1]

    def add(self, kind: str, scope: str, name: str, target: str) -> None:
        if target:
            self.rows.append((self.path, kind, scope, name, target))

    def visit_Import(self, node: ast.Import) -> None:  # noqa: N802
        for a in node.names:
            self.add("alias", self.scope[0], a.asname or a.name.split(".")[0], a.name if a.asname else a.name.split(".")[0])

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:  # noqa: N802
        above = self.package[: len(self.package) - node.level + 1] if node.level else []
        base = ".".join([*above, *([node.module] if node.module else [])])
        for a in node.names:
            if a.name != "*":
                self.add("alias", self.scope[0], a.asname or a.name, f"{base}.{a.name}" if base else a.name)

    def visit_ClassDef(self, node: ast.ClassDef) -> None:  # noqa: N802
        own = f"{self.scope[-1]}.{node.name}"
        for b in node.bases:
            self.add("base", own, "", dotted(b))
        self.scope.append(own)
        self.classes.append(own)
        self.generic_visit(node)
        self.scope.pop()
        self.classes.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:  # noqa: N802
        own = f"{self.scope[-1]}.{node.name}"
        for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs):
            self.add("type", own, a.arg, dotted(a.annotation))
        self.scope.append(own)
        self.generic_visit(node)
        self.scope.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def bind(self, target: ast.AST, kind: str) -> None:
        name = dotted(target)
        if name.startswith("self.") and name.count(".") == 1 and self.classes:
            self.add("type", self.classes[-1], name[5:], kind)
        elif name and "." not in name:
            self.add("type", self.scope[-1], name, kind)

    def visit_Assign(self, node: ast.Assign) -> None:  # noqa: N802
        value = node.value
        kind = dotted(value.func) if isinstance(value, ast.Call) else ""
        if isinstance(value, ast.Name):  # what a parameter or variable is known to be
            kind = next((t for _, k, scope, name, t in reversed(self.rows) if k == "type" and scope == self.scope[-1] and name == value.id), "")
        for t in node.targets:
            self.bind(t, kind)
        self.generic_visit(node)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:  # noqa: N802
        self.bind(node.target, dotted(node.annotation))
        self.generic_visit(node)


def bindings_of(path: str, content: str | None) -> list[tuple]:
    """Rows of one file; none of a file that does not parse."""
    w = _Bindings(path)
    try:
        w.visit(ast.parse(content or ""))
    except (SyntaxError, ValueError, RecursionError):
        return []
    return w.rows


def bindings(files: DataFrame) -> DataFrame:
    """path, kind (alias, type, base), scope, name, target (as it is written, imports as absolute names) of files (path, content)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in BINDINGS.split(", ")]
        for df in it:
            yield pd.DataFrame([r for p, c in zip(df["path"], df["content"], strict=True) for r in bindings_of(p, c)], columns=columns)

    return files.select("path", "content").mapInPandas(run, BINDINGS).distinct()


def wanted(path: Column, include: str = "*.py", exclude: tuple[str, ...] = ("*/.git/*", "*/build/*", "*/node_modules/*", "*/__pycache__/*")) -> Column:
    """Whether a path is scanned: by one glob, and by none of others. A star also matches slashes."""
    glob = lambda g: "^" + "".join({"*": ".*", "?": "."}.get(c, "\\" + c if not c.isalnum() and c != "/" else c) for c in g) + "$"
    out = path.rlike(glob(include))
    for g in exclude:
        out = out & ~F.concat(F.lit("/"), path).rlike(glob(g))
    return out


def absolute(current: Column, is_package: Column, name: Column) -> Column:
    """The module that a relative import (leading dots) means, seen from module ``current``."""
    level = F.length(F.regexp_extract(name, r"^(\.*)", 1))
    rest = F.regexp_replace(name, r"^\.+", "")
    parts = F.split(current, r"\.")
    up = level - F.when(is_package, 1).otherwise(0)
    kept = F.when(up >= F.size(parts), F.array().cast("array<string>")).otherwise(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - up, F.lit(0))))
    return F.when(level == 0, name).otherwise(F.array_join(F.concat(kept, F.when(rest == "", F.array().cast("array<string>")).otherwise(F.array(rest))), "."))


def packages(modules: DataFrame) -> DataFrame:
    """Every package above modules (name), once."""
    parts = F.split("name", r"\.")
    return modules.where(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))).alias("package")).distinct()


def scip_symbols(index: DataFrame) -> DataFrame:
    """path, symbol, line, first, last_line, last of the occurrences in decoded index documents (column ``json``).

    A range has three numbers (one line) or four.
    """
    schema = "documents array<struct<relative_path: string, occurrences: array<struct<symbol: string, range: array<int>>>>>"
    d = index.select(F.from_json("json", schema).alias("i")).select(F.explode("i.documents").alias("d"))
    o = d.select(F.col("d.relative_path").alias("path"), F.explode("d.occurrences").alias("o"))
    r = F.col("o.range")
    short = F.size(r) == 3
    return o.select("path", F.col("o.symbol").alias("symbol"), r[0].alias("line"), r[1].alias("first"), F.when(short, r[0]).otherwise(r[2]).alias("last_line"), F.when(short, r[2]).otherwise(F.get(r, F.lit(3))).alias("last"))
