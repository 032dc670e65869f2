"""Dependencies: read from manifests, compared between versions, followed transitively.

Defined results: manifests that are null, empty or invalid give no rows; a dependency named in several blocks is kept
once per block; names of Python projects are folded; a cycle is followed once; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.versions import predecessors
from riskloom.runtime import cut

#: Blocks of package.json and the kind of dependency they name.
BLOCKS = {"dependencies": "direct", "devDependencies": "dev", "peerDependencies": "peer", "optionalDependencies": "optional"}
REQUIREMENT = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*([^;#]*)"
OWNER = ("ecosystem", "package", "version")


def npm_dependencies(files: DataFrame) -> DataFrame:
    """(ecosystem, package, version, name, spec, kind) of package.json files."""
    schema = ", ".join(f"{b} map<string,string>" for b in BLOCKS)
    manifests = files.where((F.col("basename") == "package.json") & F.col("content").isNotNull())
    parsed = manifests.select(*OWNER, F.from_json("content", schema).alias("m"))
    none = F.create_map().cast("map<string,string>")

    def block(name: str, kind: str):
        entries = F.map_entries(F.coalesce(F.col(f"m.{name}"), none))
        return F.transform(entries, lambda e: F.struct(e["key"].alias("name"), e["value"].alias("spec"), F.lit(kind).alias("kind")))

    kinds = [block(name, kind) for name, kind in BLOCKS.items()]
    return parsed.select(*OWNER, F.explode(F.concat(*kinds)).alias("d")).select(*OWNER, "d.name", "d.spec", "d.kind").distinct()


def requirement_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Adds name and spec to requirement lines; comments, options, markers and extras are dropped."""
    ok = lines.where(F.col(column).rlike(REQUIREMENT) & ~F.col(column).rlike(r"^\s*[-#]"))
    name = F.regexp_replace(F.lower(F.regexp_extract(column, REQUIREMENT, 1)), r"[-_.]+", "-")
    return ok.select("*", name.alias("name"), F.trim(F.regexp_extract(column, REQUIREMENT, 2)).alias("spec"))


def cfg_dependencies(files: DataFrame) -> DataFrame:
    """(…, name, spec, kind) of install_requires in setup.cfg files."""
    block = r"(?m)^install_requires[ \t]*=[ \t]*((?:[^\n]*\n?)(?:[ \t]+[^\n]*\n?)*)"
    text = F.regexp_replace("content", r"\r\n?", "\n")
    rows = files.where((F.col("basename") == "setup.cfg") & F.col("content").isNotNull())
    lines = rows.select(*OWNER, F.explode(F.split(F.regexp_extract(text, block, 1), "\n")).alias("line")).where(F.trim("line") != "")
    return requirement_lines(lines).select(*OWNER, "name", "spec", F.lit("direct").alias("kind")).distinct()


def expand_groups(groups: dict, most: int = 10) -> dict[str, list[str]]:
    """Dependency groups with their includes resolved, in order, each requirement once; cycles and unknown names end."""

    def walk(name: str, seen: tuple[str, ...]) -> list[str]:
        if name in seen or len(seen) >= most:
            return []
        out: list[str] = []
        for entry in groups.get(name) or []:
            if isinstance(entry, str):
                out.append(entry)
            elif isinstance(entry, dict) and isinstance(entry.get("include-group"), str):
                out.extend(walk(entry["include-group"], (*seen, name)))
        return list(dict.fromkeys(out))

    return {name: walk(name, ()) for name in groups}


def toml_dependencies(files: DataFrame) -> DataFrame:
    """(…, name, spec, kind) of pyproject.toml files: project, optional and group dependencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tomllib

        for batch in batches:
            out = []
            for eco, package, version, content in zip(*(batch.column(k).to_pylist() for k in range(4))):
                try:
                    data = tomllib.loads((content or "").replace("\r\n", "\n"))
                except (tomllib.TOMLDecodeError, RecursionError):
                    continue
                project = data.get("project") if isinstance(data.get("project"), dict) else {}
                found = [(x, "direct") for x in project.get("dependencies") or []]
                optional = project.get("optional-dependencies")
                found += [(x, "optional") for xs in (optional if isinstance(optional, dict) else {}).values() for x in xs]
                groups = data.get("dependency-groups")
                for xs in expand_groups(groups if isinstance(groups, dict) else {}).values():
                    found += [(x, "dev") for x in xs]
                out += [(eco, package, version, x, kind) for x, kind in found if isinstance(x, str)]
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=[*OWNER, "line", "kind"])

    rows = files.where((F.col("basename") == "pyproject.toml") & F.col("content").isNotNull()).select(*OWNER, "content")
    lines = rows.mapInArrow(run, "ecosystem string, package string, version string, line string, kind string")
    return requirement_lines(lines).select(*OWNER, "name", "spec", "kind").distinct()


def setup_requirements(content: str) -> list[str]:
    """The requirement strings that a setup.py hands to setup(install_requires=...): lists and tuples of strings, sums of
    such, and names bound to them at the top of the module. What is computed otherwise gives none."""
    import ast

    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    names: dict[str, list[str]] = {}

    def strings(node) -> list[str] | None:
        todo, out = [node], []
        while todo:
            n = todo.pop()
            if isinstance(n, ast.BinOp) and isinstance(n.op, ast.Add):
                todo += [n.right, n.left]
            elif isinstance(n, (ast.List, ast.Tuple)) and all(isinstance(e, ast.Constant) and isinstance(e.value, str) for e in n.elts):
                out += [e.value for e in n.elts]
            elif isinstance(n, ast.Name) and n.id in names:
                out += names[n.id]
            else:
                return None
        return out

    for node in tree.body:
        if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
            found = strings(node.value)
            if found is not None:
                names[node.targets[0].id] = found
    for node in ast.walk(tree):
        if isinstance(node, ast.Call) and "setup" in (getattr(node.func, "id", ""), getattr(node.func, "attr", "")):
            for keyword in node.keywords:
                if keyword.arg == "install_requires" and (found := strings(keyword.value)) is not None:
                    return found
    return []


def setup_dependencies(files: DataFrame) -> DataFrame:
    """(…, name, spec, kind) of setup.py files, read from their syntax tree without running them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners = zip(*(batch.column(k).to_pylist() for k in range(4)))
            out = [(*owner, line) for *owner, content in owners for line in setup_requirements(content)]
            columns = zip(*out) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["ecosystem", "package", "version", "line"])

    rows = files.where((F.col("basename") == "setup.py") & F.col("content").isNotNull()).select(*OWNER, "content")
    lines = rows.mapInArrow(run, "ecosystem string, package string, version string, line string")
    return requirement_lines(lines).select(*OWNER, "name", "spec", F.lit("direct").alias("kind")).distinct()


def all_dependencies(files: DataFrame) -> DataFrame:
    out = npm_dependencies(files)
    for more in (cfg_dependencies(files), toml_dependencies(files), setup_dependencies(files)):
        out = out.unionByName(more)
    return out.distinct()


def dependency_verdicts(dependencies: DataFrame, advisories: DataFrame, version: Column) -> DataFrame:
    """The dependencies with a verdict: MALICIOUS where an advisory names the pinned version or all versions, INDETERMINATE
    where one names others or the version is not pinned, else CLEAN."""
    known = advisories.select(F.col("ecosystem").alias("_e"), F.lower("package").alias("_n"), "version_glob").distinct()
    known = known.groupBy("_e", "_n").agg(F.max(F.col("version_glob").isNull() | (F.col("version_glob") == "*")).alias("_all"), F.collect_set("version_glob").alias("_globs"))
    j = dependencies.withColumn("_v", version).join(known, (F.col("ecosystem") == F.col("_e")) & (F.lower("name") == F.col("_n")), "left")
    named = F.exists("_globs", lambda g: F.array_contains(F.split(g, ","), F.col("_v")))
    verdict = F.when(F.col("_n").isNull(), "CLEAN").when(F.col("_all") | F.coalesce(named, F.lit(False)), "MALICIOUS").otherwise("INDETERMINATE")
    return j.select(*dependencies.columns, verdict.alias("verdict"))


def changed_dependencies(dependencies: DataFrame) -> DataFrame:
    """added, removed and version_changed direct dependencies of each version against the one before it."""
    direct = dependencies.where("kind = 'direct'").groupBy(*OWNER, "name").agg(F.min("spec").alias("spec"))
    pairs = predecessors(direct.select(*OWNER), (1,)).where("before_1 IS NOT NULL")
    now = pairs.join(direct, list(OWNER)).select("ecosystem", "package", "version", "before_1", "name", F.col("spec").alias("spec_now"))
    then = pairs.join(direct.withColumnRenamed("version", "before_1"), ["ecosystem", "package", "before_1"]).select(
        "ecosystem", "package", "version", "before_1", "name", F.col("spec").alias("spec_before")
    )
    both = now.join(then, ["ecosystem", "package", "version", "before_1", "name"], "full_outer")
    change = (
        F.when(F.col("spec_before").isNull(), "added").when(F.col("spec_now").isNull(), "removed").when(F.col("spec_now") != F.col("spec_before"), "version_changed")
    )
    return both.withColumn("change", change).where("change IS NOT NULL")


def reachable(edges: DataFrame, roots: DataFrame, most_depth: int = 5) -> DataFrame:
    """(root, node, depth): everything that edges (parent, child) lead to, at its smallest depth. One join per level;
    the frontier is written to the shared folder, and what was reached before is not followed again."""
    edges = edges.select("parent", "child").distinct()
    seen = cut(roots.select(F.col("root"), F.col("root").alias("node"), F.lit(0).alias("depth")).distinct())
    frontier = seen
    for depth in range(1, most_depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["parent"]).select("root", F.col("child").alias("node")).distinct()
        fresh = cut(step.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
        frontier = fresh
    return seen.where("depth > 0")
