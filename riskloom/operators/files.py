"""Source files as rows: classes, tiers, fingerprints, imports and scripts.

Defined results: null paths have class `other` and null names; null contents give no imports, scripts or lines and count
as empty in fingerprints; rows repeated as a whole count once in fingerprints; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.catalogs import NODE_BUILTINS
from riskloom.operators.versions import predecessors

OWNER = ("ecosystem", "package", "version")
#: File classes by extension, and directories that are left out.
CLASSES = {
    "source_py": "py pyw", "source_js": "js mjs cjs ts tsx jsx", "metadata": "json toml cfg",
    "binary": "so dll exe pyd dylib node bin whl wasm", "doc": "md rst txt",
}
EXCLUDED = ("test", "tests", "__tests__", "docs", "doc", "examples", "example", "node_modules", ".git", "__pycache__")


def classified(files: DataFrame) -> DataFrame:
    """Adds file_class, excluded and the path without its package folder."""
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.lit("other")
    for name, extensions in reversed(CLASSES.items()):
        kind = F.when(extension.isin(*extensions.split()), name).otherwise(kind)
    folders = F.split(F.regexp_replace("path", r"[^/]*$", ""), "/")
    return files.withColumns(
        {
            "file_class": kind,
            "excluded": F.coalesce(F.arrays_overlap(folders, F.array(*map(F.lit, EXCLUDED))), F.lit(False)),
            "inner_path": F.regexp_replace("path", r"^(?:package|[^/]+-\d[^/]*)/", ""),
        }
    )


#: Files that run by themselves on installation or import, by registry, and folders of commands.
FIRST_TIER = {"PyPI": (("setup.py", "__init__.py", "__main__.py"), 4), "npm": (("index.js", "index.mjs", "index.cjs", "postinstall.js", "preinstall.js"), 2)}
COMMAND_FOLDERS = ("bin", "scripts", "cli")
#: Languages by the end of a file's name.
LANGUAGES = {"python": ("py",), "javascript": ("js", "mjs", "cjs"), "json": ("json",), "toml": ("toml",), "cfg": ("cfg",)}


def tiered(files: DataFrame) -> DataFrame:
    """Adds tier (1: runs on installation or import, 2: commands, 3: other sources), the language that the name tells and
    whether the file is analysed (manifests other than package.json are not)."""
    parts = F.split(F.regexp_replace(F.coalesce("path", F.lit("")), r"\\\\", "/"), "/")
    name = F.element_at(parts, -1)
    names, depth = FIRST_TIER["PyPI"]
    first = (F.col("ecosystem") == "PyPI") & name.isin(*names) & (F.size(parts) <= depth)
    names, depth = FIRST_TIER["npm"]
    first = first | (F.col("ecosystem") != "PyPI") & name.isin(*names) & (F.size(parts) <= depth)
    tier = F.when(F.coalesce(first, F.lit(False)), 1).when(F.arrays_overlap(parts, F.array(*map(F.lit, COMMAND_FOLDERS))), 2).otherwise(3)
    language = F.lit("unknown")
    for kind, ends in reversed(LANGUAGES.items()):
        language = F.when(name.rlike(rf"\.(?:{'|'.join(ends)})$"), kind).otherwise(language)
    analysed = ~language.isin("json", "toml", "cfg") | (name == "package.json")
    return files.withColumns({"path_tier": tier, "name_language": language, "analysed": analysed})


#: Words of shell commands and their dimension.
SHELL_WORDS = {"curl": "T", "wget": "T", "nc": "T", "bash": "X", "sh ": "X", "python ": "X", "node ": "X", "eval": "X", "base64": "E"}


def script_calls(scripts: DataFrame) -> DataFrame:
    """The rows of lifecycle scripts (…, command) with a row per shell word that the command holds: name and dimension."""
    low = F.lower("command")
    found = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), F.struct(F.lit("shell:" + w.strip()).alias("name"), F.lit(d).alias("dimension"))) for w, d in SHELL_WORDS.items()]))
    return scripts.select("*", F.explode(found).alias("_c")).select(*scripts.columns, "_c.name", "_c.dimension")


def changed_files(files: DataFrame) -> DataFrame:
    """(ecosystem, package, version, before_1, path, status): files of a version against those of the version before, by
    path without the package folder: added, removed or changed."""
    inner = F.regexp_replace("path", r"^(?:package|[^/]+-\d[^/]*)/", "").alias("path")
    now = files.where("version IS NOT NULL AND path IS NOT NULL").select(*OWNER, inner, F.sha2(F.coalesce("content", F.lit("")), 256).alias("h"))
    now = now.groupBy(*OWNER, "path").agg(F.min("h").alias("h"))
    order = predecessors(files, (1,)).where("before_1 IS NOT NULL")
    left = order.join(now, list(OWNER))
    old = now.select("ecosystem", "package", F.col("version").alias("before_1"), "path", F.col("h").alias("old"))
    right = order.join(old, ["ecosystem", "package", "before_1"])
    j = left.join(right, [*OWNER, "before_1", "path"], "full")
    status = F.when(F.col("old").isNull(), "added").when(F.col("h").isNull(), "removed").when(F.col("h") != F.col("old"), "changed")
    return j.select(*OWNER, "before_1", "path", status.alias("status")).where("status IS NOT NULL")


def module_path(path: Column) -> Column:
    """Dotted module of a Python file's inner path."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.pyw?$", ""), r"(?:^|/)__init__$", ""), "/", ".")


def fingerprints(files: DataFrame) -> DataFrame:
    """(ecosystem, package, version, files, fingerprint): SHA-256 over each version's sorted (path, content hash).
    Contents are hashed before the shuffle, so a group carries 64 characters a file."""
    hashed = files.select(*OWNER, "path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("h")).distinct()
    lines = F.array_sort(F.collect_list(F.concat_ws(":", F.coalesce("path", F.lit("")), "h")))
    return hashed.groupBy(*OWNER).agg(
        F.count("*").alias("files"), F.substring(F.sha2(F.array_join(lines, "\n"), 256), 1, 32).alias("fingerprint")
    )


def javascript_imports(files: DataFrame) -> DataFrame:
    """(…, path, module): packages that JavaScript files import, without built-ins and relative paths, scopes kept."""
    patterns = [
        r"(?m)^\s*import\s+(?:[\w*{}\s,$]+\s+from\s+)?['\"]([^'\"]+)['\"]", r"\brequire\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
        r"\bimport\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", r"(?m)^\s*export\s+[\w*{}\s,$]+\s+from\s+['\"]([^'\"]+)['\"]",
    ]
    js = files.where((F.lower(F.trim("language")) == "javascript") & F.col("content").isNotNull())
    found = F.array_distinct(F.concat(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in patterns]))
    rows = js.select(*OWNER, "path", F.explode(found).alias("m")).where(~F.col("m").rlike(r"^[./]"))
    name = F.regexp_extract(F.regexp_replace("m", "^node:", ""), r"^(@[^/]+/[^/]+|[^@/][^/]*)", 1)
    return rows.select(*OWNER, "path", name.alias("module")).where((F.col("module") != "") & ~F.col("module").isin(*NODE_BUILTINS)).distinct()


#: Endings that a relative import is tried with, in order.
PROBES = ("", ".js", ".mjs", ".cjs", ".ts", "/index.js", "/index.mjs", "/index.cjs")


def resolved_imports(files: DataFrame) -> DataFrame:
    """(…, path, spec, target): relative imports of JavaScript files with the file of the same version that they name,
    the first of PROBES that exists. Each import becomes its few candidates, so this is an equality join on the path."""
    patterns = [
        r"(?m)^\s*import\s+(?:[\w*{}\s,$]+\s+from\s+)?['\"](\.[^'\"]*)['\"]", r"\brequire\s*\(\s*['\"](\.[^'\"]*)['\"]\s*\)",
        r"\bimport\s*\(\s*['\"](\.[^'\"]*)['\"]\s*\)", r"(?m)^\s*export\s+[\w*{}\s,$]+\s+from\s+['\"](\.[^'\"]*)['\"]",
    ]
    js = files.where((F.lower(F.trim("language")) == "javascript") & F.col("content").isNotNull())
    found = F.array_distinct(F.concat(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in patterns]))
    rows = js.select(*OWNER, "path", F.explode(found).alias("spec")).distinct()
    rows = rows.where(F.col("spec").rlike(r"^\.\.?(?:/|$)"))

    def step(done: Column, part: Column) -> Column:
        # null where the import leads out of the files
        up = F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    folder = F.when(F.col("path").contains("/"), F.split(F.regexp_replace("path", r"/[^/]*$", ""), "/")).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("parts", F.aggregate(F.split("spec", "/"), folder, step)).where("parts IS NOT NULL")
    stem = F.array_join("parts", "/")
    # an import that ends in a folder has its index files only
    ending = F.filter(F.array(*map(F.lit, PROBES)), lambda p: p.startswith("/") | ~F.col("spec").rlike(r"(?:^|/)\.{0,2}$"))
    tried = rows.select(*OWNER, "path", "spec", F.posexplode(F.transform(ending, lambda p: F.regexp_replace(F.concat(stem, p), "^/(?=index)", ""))).alias("place", "target"))
    there = files.select(*OWNER, F.col("path").alias("target")).distinct()
    hits = tried.join(there, [*OWNER, "target"])
    return hits.groupBy(*OWNER, "path", "spec").agg(F.min_by("target", "place").alias("target"))


def python_imports(files: DataFrame) -> DataFrame:
    """(…, path, module): top-level names of absolute imports outside the standard library, from the syntax tree; a
    file that does not parse gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ast
        import sys
        import warnings

        for batch in batches:
            out = []
            for eco, package, version, path, content in zip(*(batch.column(k).to_pylist() for k in range(5))):
                try:
                    with warnings.catch_warnings():
                        warnings.simplefilter("ignore")
                        tree = ast.parse(content)
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
                names = set()
                for node in ast.walk(tree):
                    if isinstance(node, ast.Import):
                        names |= {a.name.split(".")[0] for a in node.names}
                    elif isinstance(node, ast.ImportFrom) and not node.level and node.module:
                        names.add(node.module.split(".")[0])
                out += [(eco, package, version, path, n) for n in sorted(names - sys.stdlib_module_names)]
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=[*OWNER, "path", "module"])

    rows = files.where((F.lower(F.trim("language")) == "python") & F.col("content").isNotNull()).select(*OWNER, "path", "content")
    return rows.mapInArrow(run, "ecosystem string, package string, version string, path string, module string")


def lifecycle_scripts(files: DataFrame) -> DataFrame:
    """(…, path, hook, command) of package.json scripts that run on install."""
    rows = files.where((F.col("basename") == "package.json") & F.col("content").isNotNull())
    scripts = F.from_json("content", "scripts map<string,string>")["scripts"]
    e = rows.select(*OWNER, "path", F.explode(F.map_entries(scripts)).alias("s"))
    return e.where(F.col("s.key").isin("preinstall", "install", "postinstall", "prepare")).select(
        *OWNER, "path", F.col("s.key").alias("hook"), F.col("s.value").alias("command")
    ).distinct()


def lines(files: DataFrame, id_column: str = "file_id") -> DataFrame:
    """(id, line_no from 1, line) of every text; any of the three line ends separates."""
    return files.where(F.col("content").isNotNull()).select(
        id_column, F.posexplode(F.split("content", r"\r\n|\r|\n")).alias("at", "line")
    ).select(id_column, (F.col("at") + 1).alias("line_no"), "line")


def capped_prefix(files: DataFrame, most_bytes: int) -> DataFrame:
    """Files of each version, in order of path, as long as their sizes sum to at most `most_bytes`."""
    from pyspark.sql import Window

    order = Window.partitionBy(*OWNER).orderBy("path", "file_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return files.withColumn("running_bytes", F.sum(F.coalesce("size", F.lit(0)).cast("bigint")).over(order)).where(F.col("running_bytes") <= most_bytes)
