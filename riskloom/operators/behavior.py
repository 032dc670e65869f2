"""Calls of source files as ordered rows, patterns over their sequence, rules over their sets, profiles and anomalies.

Defined results: files that do not parse give no calls; null contents give none; an event of unknown type has no letter;
ties in time are broken by id; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.catalogs import BEHAVIOR_RULES, JAVASCRIPT_CALLS, PYTHON_CALLS, SEQUENCES, calls_of

CALL_SCHEMA = "file_id bigint, at int, name string, line int, dimension string, snippet string"
#: Characters of a call's line that are kept with it.
SNIPPET = 200
#: Libraries and verbs whose combination counts as data transmission.
HTTP_LIBRARIES = ("requests", "httpx", "aiohttp", "urllib")
HTTP_VERBS = ("get", "post", "put", "patch", "delete", "request", "urlopen", "urlretrieve")


def python_calls(files: DataFrame) -> DataFrame:
    """Catalogued calls of Python files in order of the syntax tree, import aliases resolved; schema CALL_SCHEMA."""
    catalog = dict(calls_of(PYTHON_CALLS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ast
        import warnings

        def dotted(node) -> str | None:
            parts = []
            while isinstance(node, ast.Attribute):
                parts.append(node.attr)
                node = node.value
            if not isinstance(node, ast.Name):
                return None
            return ".".join([node.id, *reversed(parts)])

        def dimension(name: str) -> str | None:
            if name in catalog:
                return catalog[name]
            head, _, tail = name.rpartition(".")
            return "T" if head.split(".")[0] in HTTP_LIBRARIES and tail in HTTP_VERBS else None

        for batch in batches:
            out = []
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    with warnings.catch_warnings():
                        warnings.simplefilter("ignore")
                        tree = ast.parse(content)
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
                alias, found = {}, []

                def resolved(node) -> str | None:
                    first, _, rest = (dotted(node) or "").partition(".")
                    return alias.get(first, first) + ("." + rest if rest else "")  # noqa: B023

                stack = [tree]
                while stack:
                    node = stack.pop()
                    if isinstance(node, ast.Import):
                        alias.update({a.asname or a.name.split(".")[0]: a.name if a.asname else a.name.split(".")[0] for a in node.names})
                    elif isinstance(node, ast.ImportFrom) and node.module and not node.level:
                        alias.update({a.asname or a.name: f"{node.module}.{a.name}" for a in node.names})
                    elif isinstance(node, ast.Call) and (name := resolved(node.func)):
                        if d := dimension(name):
                            found.append((name, node.lineno, d))
                    elif isinstance(node, ast.Subscript) and resolved(node.value) == "os.environ":
                        found.append(("os.environ.__getitem__", node.lineno, "I"))
                    stack.extend(reversed(list(ast.iter_child_nodes(node))))
                lines = content.splitlines() if found else []
                out += [(key, k, *f, lines[f[1] - 1].strip()[:SNIPPET] if f[1] <= len(lines) else "") for k, f in enumerate(found)]
            columns = zip(*out) if out else [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], names=["file_id", "at", "name", "line", "dimension", "snippet"]
            )

    rows = files.where((F.lower(F.trim("language")) == "python") & F.col("content").isNotNull())
    return rows.select(F.col("file_id").cast("bigint"), "content").dropDuplicates(["file_id"]).mapInArrow(run, CALL_SCHEMA)


def javascript_calls(files: DataFrame) -> DataFrame:
    """(file_id, line_no, name, dimension): catalogued names per line of JavaScript files. One alternation finds them
    all; the name found is looked up in a literal map."""
    catalog = calls_of(JAVASCRIPT_CALLS)
    escaped = sorted((n.replace(".", r"\.") for n, _ in catalog), key=len, reverse=True)
    pattern = rf"(?:^|[^A-Za-z0-9_$.])({'|'.join(escaped)})\s*[(\[.]"
    names = F.create_map(*[F.lit(x) for pair in catalog for x in pair])
    js = files.where((F.lower(F.trim("language")) == "javascript") & F.col("content").isNotNull()).select("file_id", "content").dropDuplicates(["file_id"])
    lines = js.select("file_id", F.posexplode(F.split("content", r"\r\n|\r|\n")).alias("at", "line")).where(F.col("line").rlike(pattern))
    found = lines.select("file_id", (F.col("at") + 1).alias("line_no"), F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(pattern), F.lit(1)))).alias("name"))
    return found.withColumn("dimension", names[F.col("name")])


#: Letters per chunk of a trace, and how many more a chunk sees; no pattern takes more than 21 letters.
CHUNK, AHEAD = 4096, 24


def traces(events: DataFrame, key: str, order: list[str], letter: Column) -> DataFrame:
    """(key, chunk, trace): the letters of a key's events in order, in chunks that overlap by AHEAD letters, so that a key
    with any number of events is never gathered in one row."""
    rows = events.select(key, *order, letter.alias("_letter")).where(F.col("_letter").isNotNull())
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    placed = rows.select(key, at.alias("at"), "_letter")
    own = F.floor(F.col("at") / CHUNK).cast("int")
    seen = F.array_compact(F.array(own, F.when((F.col("at") % CHUNK < AHEAD) & (F.col("at") >= CHUNK), own - 1)))
    parts = placed.select(key, "at", "_letter", F.explode(seen).alias("chunk"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "_letter"))), lambda e: e["_letter"]), "")
    return parts.groupBy(key, "chunk").agg(text.alias("trace"))


def mined(chunks: DataFrame, key: str) -> DataFrame:
    """(key, pattern, severity, start, matched): the first place of each sequence pattern, once per key. The slots of a
    pattern take different letters, so greedy matching equals filling slot after slot."""
    tests = [
        F.when(
            F.col("trace").rlike(p),
            F.struct(
                F.lit(code).alias("pattern"), F.lit(level).alias("severity"),
                (F.regexp_instr("trace", F.lit(p)) - 1).alias("start"), F.regexp_extract("trace", p, 0).alias("matched"),
            ),
        )
        for code, level, p in SEQUENCES
    ]
    hits = chunks.select(key, "chunk", F.explode(F.array_compact(F.array(*tests))).alias("m")).where(F.col("m.start") < CHUNK)
    place = F.struct((F.col("chunk") * CHUNK + F.col("m.start")).alias("start"), F.col("m.matched").alias("matched"))
    first = hits.groupBy(key, "m.pattern", "m.severity").agg(F.min(place).alias("f"))
    return first.select(key, "pattern", "severity", "f.start", "f.matched")


def ruled(sets: DataFrame, key: str, letters_column: str) -> DataFrame:
    """(key, rule, severity): rules whose letters the key's set of letters contains."""
    tests = [
        F.when(
            F.size(F.array_except(F.array(*map(F.lit, need)), F.col(letters_column))) == 0,
            F.struct(F.lit(code).alias("rule"), F.lit(level).alias("severity")),
        )
        for code, need, level in BEHAVIOR_RULES
    ]
    return sets.select(key, F.explode(F.array_compact(F.array(*tests))).alias("r")).select(key, "r.*")


def profiles(observations: DataFrame, key: str, period: str, kind: str) -> DataFrame:
    """(key, most, kinds): the greatest number of events in a period and the sorted kinds seen."""
    per = observations.groupBy(key, period).agg(F.count("*").alias("n"), F.collect_set(kind).alias("k"))
    return per.groupBy(key).agg(F.max("n").alias("most"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("k")))).alias("kinds"))


def anomalies(observed: DataFrame, baseline: DataFrame, key: str, burst: int = 3, least: int = 5) -> DataFrame:
    """(key, n, most, burst, new_kinds, severity) of observed (key, n, kinds) against profiles: a burst is more than
    `burst` times the greatest number so far and at least `least`; a kind not seen before weighs more."""
    j = observed.join(baseline.select(key, "most", F.col("kinds").alias("known")), key)
    new = F.array_sort(F.array_except("kinds", "known"))
    is_burst = (F.col("n") > burst * F.col("most")) & (F.col("n") >= least)
    severity = F.when(F.size(new) > 0, "high").when(is_burst, "medium").otherwise("info")
    return j.select(key, "n", "most", is_burst.alias("burst"), F.array_join(new, ",").alias("new_kinds"), severity.alias("severity"))
