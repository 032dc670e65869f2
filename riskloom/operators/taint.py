"""Flows of sensitive values into dangerous calls, within and across the Python files of a version.

One pass per file walks its statements in order and keeps which names hold values of a source; assignments pass them on,
encodings are noted on the way, and calls of a sink with such a value give a flow. A first pass collects the names that
modules export with such values; a join on (package version, module) brings them to the files that import them.

Defined results: files that do not parse give no flows and no exports; a name keeps the state of its last assignment;
null contents give nothing; empty tables give empty results.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.catalogs import PYTHON_CALLS, calls_of
from riskloom.operators.files import OWNER, classified, module_path

_DIMENSION = dict(calls_of(PYTHON_CALLS))
_SINKS = ("X", "T")
FLOWS = "file_id bigint, source string, source_line int, sink string, sink_line int, name string, transforms string"
EXPORTS = "file_id bigint, name string, source string, source_line int"


def _name(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else ""


class Slicer(ast.NodeVisitor):
    """State: name -> (source, line, transforms)."""

    def __init__(self, given: dict[str, tuple[str, int, tuple]] | None = None):
        self.alias: dict[str, str] = {}
        self.held = dict(given or {})
        self.module_level: dict[str, tuple] = {}
        self.depth = 0
        self.flows: list[tuple] = []

    def resolved(self, node: ast.AST) -> str:
        first, _, rest = _name(node).partition(".")
        return self.alias.get(first, first) + ("." + rest if rest else "")

    def value(self, node: ast.AST):
        """What a value carries: its source, or None."""
        if isinstance(node, ast.Name):
            return self.held.get(node.id)
        if isinstance(node, ast.Subscript) and self.resolved(node.value) == "os.environ":
            return "os.environ", node.lineno, ()
        if isinstance(node, ast.Call):
            name = self.resolved(node.func)
            kind = _DIMENSION.get(name)
            if kind == "I" or name == "open":
                return name, node.lineno, ()
            for part in [*node.args, *[k.value for k in node.keywords], *([node.func.value] if isinstance(node.func, ast.Attribute) else [])]:
                if found := self.value(part):
                    return (found[0], found[1], (*found[2], name)) if kind == "E" else found
            return None
        for child in ast.iter_child_nodes(node):
            if found := self.value(child):
                return found
        return None

    def visit_Import(self, node):
        self.alias.update({a.asname or a.name.split(".")[0]: a.name if a.asname else a.name.split(".")[0] for a in node.names})

    def visit_ImportFrom(self, node):
        if node.module and not node.level:
            self.alias.update({a.asname or a.name: f"{node.module}.{a.name}" for a in node.names})

    def _assign(self, targets, value):
        found = self.value(value)
        for target in targets:
            for leaf in ast.walk(target):
                if isinstance(leaf, ast.Name):
                    if found:
                        self.held[leaf.id] = found
                        if not self.depth:
                            self.module_level[leaf.id] = found
                    else:
                        self.held.pop(leaf.id, None)
                        if not self.depth:
                            self.module_level.pop(leaf.id, None)

    def visit_Assign(self, node):
        self.generic_visit(node)
        self._assign(node.targets, node.value)

    def visit_AnnAssign(self, node):
        self.generic_visit(node)
        if node.value:
            self._assign([node.target], node.value)

    def visit_With(self, node):
        for item in node.items:
            self.visit(item.context_expr)
            if item.optional_vars:
                self._assign([item.optional_vars], item.context_expr)
        for child in node.body:
            self.visit(child)

    def visit_FunctionDef(self, node):
        self.depth += 1
        self.generic_visit(node)
        self.depth -= 1

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Call(self, node):
        name = self.resolved(node.func)
        if _DIMENSION.get(name) in _SINKS:
            for part in [*node.args, *[k.value for k in node.keywords]]:
                if found := self.value(part):
                    held = part.id if isinstance(part, ast.Name) else ""
                    self.flows.append((found[0], found[1], name, node.lineno, held, ",".join(found[2])))
                    break
        self.generic_visit(node)


def _parsed(content: str | None) -> ast.AST | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(content or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _sliced(content: str | None, given: dict | None = None) -> Slicer:
    slicer = Slicer(given)
    if (tree := _parsed(content)) is not None:
        try:
            slicer.visit(tree)
        except RecursionError:
            pass
    return slicer


def _python(files: DataFrame) -> DataFrame:
    return files.where((F.lower(F.trim("language")) == "python") & F.col("content").isNotNull()).dropDuplicates(["file_id"])


def flows(files: DataFrame) -> DataFrame:
    """Flows within each Python file; schema FLOWS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *f) for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for f in _sliced(c).flows]
            columns = zip(*rows) if rows else [[]] * 7
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in FLOWS.split(", ")])

    return _python(files).select(F.col("file_id").cast("bigint"), "content").mapInArrow(run, FLOWS)


def exports(files: DataFrame) -> DataFrame:
    """Names that hold a sensitive value at the end of a module; schema EXPORTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, n, v[0], v[1]) for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for n, v in _sliced(c).module_level.items()]
            columns = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int32()))], names=["file_id", "name", "source", "source_line"])

    return _python(files).select(F.col("file_id").cast("bigint"), "content").mapInArrow(run, EXPORTS)


def cross_file_flows(files: DataFrame) -> DataFrame:
    """Flows of values that another module of the same version exports; schema FLOWS, the source names the module."""
    placed = classified(_python(files)).select(*OWNER, F.col("file_id").cast("bigint").alias("file_id"), module_path(F.col("inner_path")).alias("module"), "content")
    given = placed.select(*OWNER, "file_id", "module").join(exports(files), "file_id").select(*OWNER, F.element_at(F.split("module", r"\."), -1).alias("last"), "module", "name", "source", "source_line")
    pattern = r"(?m)^\s*from\s+\.*([\w.]*)\s+import\s+\(?([\w, ]+)"
    imports = placed.withColumn("m", F.explode(F.arrays_zip(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)).alias("mod"), F.regexp_extract_all("content", F.lit(pattern), F.lit(2)).alias("names"))))
    wanted = imports.select(*OWNER, "file_id", F.element_at(F.split("m.mod", r"\."), -1).alias("last"), F.explode(F.split(F.regexp_replace("m.names", r"\s+", ""), ",")).alias("name"))
    hits = wanted.join(given, [*OWNER, "last", "name"]).groupBy("file_id").agg(F.collect_set(F.struct("name", "module", "source", "source_line")).alias("given"))
    rows = hits.join(placed.select("file_id", "content"), "file_id").select("file_id", "content", "given")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, content, got in zip(*(batch.column(k).to_pylist() for k in range(3))):
                start = {g["name"]: (f"{g['module']}:{g['source']}", g["source_line"], ()) for g in got}
                out += [(key, *f) for f in _sliced(content, start).flows if ":" in f[0]]
            columns = zip(*out) if out else [[]] * 7
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in FLOWS.split(", ")])

    return rows.mapInArrow(run, FLOWS)
