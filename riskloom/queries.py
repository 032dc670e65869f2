"""Queries of the core operators, by name; each takes (spark, sf_dir). The SQL beside a query gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.catalogs import BEHAVIOR_RULES, DECISIVE_PREFIXES, JAVASCRIPT_CALLS, LINE_PATTERNS, NODE_BUILTINS, SEQUENCES, SEVERITY, WEAK_CODES, calls_of
from riskloom.operators import (
    agents, alerts, behavior, capabilities, compliance, changes, deobfuscation, dependencies, drafts, evidence, files, indicators, integrity, lookups, message_dedup, metadata,
    nested_records, queue, reviews, tables, taint, vectors, versions,
)
from riskloom.plans import assessment, exports
from riskloom.runtime import table
from riskloom.sources import traces

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# nested records and repeated messages


def _nodes(spark: SparkSession, d: str, items: bool = False) -> DataFrame:
    return nested_records.labelled_nodes(table(spark, d, "runtime_observations"), items=items)


@query()
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nested_records.link_elements(_nodes(spark, d, items=True))


@query()
def p3_objects(spark: SparkSession, d: str) -> DataFrame:
    return nested_records.node_table(_nodes(spark, d), "object")


@query()
def p3_arrays(spark: SparkSession, d: str) -> DataFrame:
    return nested_records.node_table(_nodes(spark, d), "array")


@query()
def p3_strings(spark: SparkSession, d: str) -> DataFrame:
    return nested_records.node_table(_nodes(spark, d), "string")


@query()
def p3_numbers(spark: SparkSession, d: str) -> DataFrame:
    return nested_records.node_table(_nodes(spark, d), "number")


@query()
def p3_booleans(spark: SparkSession, d: str) -> DataFrame:
    return nested_records.node_table(_nodes(spark, d), "boolean")


@query()
def p3_nulls(spark: SparkSession, d: str) -> DataFrame:
    return nested_records.node_table(_nodes(spark, d), "null")


_MESSAGE = r"""ecosystem,
    CASE WHEN lower(trim(ecosystem)) = 'pypi'
         THEN lower(regexp_replace(trim(package, E' \t\r\n\x0b\x0c'), '[-_.]+', '-', 'g'))
         ELSE trim(package, E' \t\r\n\x0b\x0c') END,
    trim(version, E' \t\r\n\x0b\x0c'), source_event"""
_RANKED = f"SELECT *, row_number() OVER (PARTITION BY {_MESSAGE} ORDER BY enqueued_at NULLS LAST, id) AS rn FROM scan_queue"


@query(f"SELECT id FROM ({_RANKED}) WHERE rn > 1")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return message_dedup.repeated_messages(table(spark, d, "scan_queue")).select("id")


@query(f"SELECT * EXCLUDE (rn) FROM ({_RANKED}) WHERE rn = 1")
def p4_kept(spark: SparkSession, d: str) -> DataFrame:
    return message_dedup.kept_messages(table(spark, d, "scan_queue"))


# names


def _packages(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "scan_queue")
    return q.select("ecosystem", message_dedup.canonical_package(q["ecosystem"], q["package"]).alias("package")).distinct()


_PACKAGES = r"""SELECT DISTINCT ecosystem, CASE WHEN lower(trim(ecosystem)) = 'pypi'
    THEN lower(regexp_replace(trim(package, E' \t\r\n\x0b\x0c'), '[-_.]+', '-', 'g')) ELSE trim(package, E' \t\r\n\x0b\x0c') END AS package FROM scan_queue"""


@query(f"""
WITH p AS ({_PACKAGES}),
a AS (SELECT *, row_number() OVER (PARTITION BY ecosystem, lower(package) ORDER BY modified DESC NULLS LAST, advisory_id) AS rn FROM known_malicious)
SELECT p.ecosystem, p.package, a.advisory_id, a.attack_type, a.source, a.version_glob, a.modified
FROM p JOIN a ON a.rn = 1 AND p.ecosystem = a.ecosystem AND lower(p.package) = lower(a.package)""")
def advisory_newest(spark: SparkSession, d: str) -> DataFrame:
    return lookups.latest_advisory(_packages(spark, d), table(spark, d, "known_malicious"))


@query(f"""
WITH r AS (SELECT DISTINCT q.ecosystem, p.package, q.version FROM (
    SELECT ecosystem, {_PACKAGES.split("ecosystem, ", 1)[1].rsplit(" FROM", 1)[0]}, trim(version, E' \\t\\r\\n\\x0b\\x0c') AS version FROM scan_queue) q
    JOIN (SELECT 1) ON true JOIN LATERAL (SELECT q.package) p(package) ON true),
a AS (SELECT DISTINCT ecosystem, lower(package) AS n, advisory_id, attack_type, version_glob FROM known_malicious)
SELECT r.ecosystem, r.package, r.version, a.advisory_id, a.attack_type,
    CASE WHEN a.version_glob IS NULL OR a.version_glob = '*' OR a.version_glob = r.version THEN 'exact' ELSE 'historical_name_match' END AS match_kind
FROM r JOIN a ON r.ecosystem = a.ecosystem AND lower(r.package) = a.n""")
def advisory_versions(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "scan_queue")
    releases = q.select(
        "ecosystem", message_dedup.canonical_package(q["ecosystem"], q["package"]).alias("package"),
        F.trim("version", F.lit(message_dedup.BLANKS)).alias("version"),
    ).distinct()
    return lookups.match_versions(releases, table(spark, d, "known_malicious"))


@query(f"""
WITH p AS ({_PACKAGES}), b AS (SELECT ecosystem, lower(package) AS n, min(rank) AS rank FROM known_popular GROUP BY ALL)
SELECT p.ecosystem, p.package, b.rank, coalesce(b.rank <= 5000, false) AS is_popular, coalesce(b.rank <= 1000, false) AS is_top
FROM p LEFT JOIN b ON p.ecosystem = b.ecosystem AND lower(p.package) = b.n""")
def popular_lookup(spark: SparkSession, d: str) -> DataFrame:
    return lookups.popularity(_packages(spark, d), table(spark, d, "known_popular"))


_SIMILAR = f"""
p AS (SELECT DISTINCT ecosystem, lower(package) AS package FROM known_malicious WHERE length(package) >= 3),
t AS (SELECT DISTINCT ecosystem, lower(package) AS candidate FROM known_popular WHERE length(package) >= 3),
s AS (SELECT p.ecosystem, p.package, t.candidate, levenshtein(p.package, t.candidate) AS distance FROM p JOIN t
      ON p.ecosystem = t.ecosystem AND abs(length(p.package) - length(t.candidate)) <= 2),
x AS (SELECT *, round(1 - distance / greatest(length(package), length(candidate)), 3) AS similarity FROM s WHERE distance BETWEEN 1 AND 2)"""


def _similar(spark: SparkSession, d: str) -> DataFrame:
    return lookups.similar_names(table(spark, d, "known_malicious"), table(spark, d, "known_popular"))


@query(f"""WITH {_SIMILAR}, r AS (SELECT *, row_number() OVER (PARTITION BY ecosystem, package ORDER BY similarity DESC, candidate) AS place FROM x)
SELECT ecosystem, package, candidate, distance, similarity, place FROM r WHERE place <= 5""")
def typosquat_topk(spark: SparkSession, d: str) -> DataFrame:
    return lookups.top_similar(_similar(spark, d))


@query(f"""WITH {_SIMILAR}, r AS (SELECT *, row_number() OVER (PARTITION BY ecosystem, package ORDER BY distance, candidate) AS place FROM x)
SELECT ecosystem, package, candidate, distance FROM r WHERE place = 1""")
def closest_name(spark: SparkSession, d: str) -> DataFrame:
    return lookups.closest_name(_similar(spark, d))


# keyed tables


def _feed_halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = table(spark, d, "known_malicious").select("advisory_id", "ecosystem", "package", "attack_type", "published", "modified").distinct()
    return a.where("published < '2025-01-01'"), a.where("published >= '2024-10-01'")


_HALVES = """
a AS (SELECT DISTINCT advisory_id, ecosystem, package, attack_type, published, modified FROM known_malicious),
o AS (SELECT *, 0 AS n FROM a WHERE published < '2025-01-01'), w AS (SELECT *, 1 AS n FROM a WHERE published >= '2024-10-01')"""


@query(f"""WITH {_HALVES}, u AS (SELECT * FROM o UNION ALL SELECT * FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY advisory_id, ecosystem, package ORDER BY n DESC, modified DESC NULLS LAST, attack_type NULLS LAST, published) AS rn FROM u)
SELECT advisory_id, ecosystem, package, attack_type, published, modified FROM r WHERE rn = 1""")
def feed_upsert(spark: SparkSession, d: str) -> DataFrame:
    old, new = _feed_halves(spark, d)
    return tables.latest_wins(old, new, ["advisory_id", "ecosystem", "package"], F.col("modified"))


@query(f"""WITH {_HALVES}
SELECT DISTINCT w.ecosystem, w.package, TIMESTAMP '2025-07-01 00:00:00' AS invalidated_at, 'new advisory: ' || w.advisory_id AS reason
FROM w WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.advisory_id = w.advisory_id AND o.ecosystem = w.ecosystem AND o.package = w.package)""")
def feed_invalidations(spark: SparkSession, d: str) -> DataFrame:
    old, new = _feed_halves(spark, d)
    return tables.invalidations(old, new, ["advisory_id", "ecosystem", "package"], F.lit("2025-07-01 00:00:00").cast("timestamp_ntz"))


@query("""WITH l AS (SELECT l_orderkey AS o_orderkey, max(l_shipdate) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o.o_orderkey, o.o_custkey, o.o_orderdate FROM orders o LEFT JOIN l USING (o_orderkey) WHERE m IS NULL OR m <= o.o_orderdate""")
def cache_valid(spark: SparkSession, d: str) -> DataFrame:
    cache = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    log = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    return tables.still_valid(cache, log, ["o_orderkey"], "o_orderdate", "l_shipdate")


@query("""SELECT substr(sha256(string_agg(line, '|' ORDER BY line)), 1, 16) AS digest FROM (
    SELECT coalesce(source, '') || '=' || coalesce(max(modified), '') AS line FROM known_malicious GROUP BY source)""")
def feed_digest(spark: SparkSession, d: str) -> DataFrame:
    """Digest of the feeds' versions, one line a feed."""
    return tables.digest(table(spark, d, "known_malicious").groupBy("source").agg(F.max("modified").alias("version")), ["source", "version"])


@query("""SELECT substr(sha256(count(*) || ':' || coalesce(sum(CAST(('0x' || substr(sha256(line), 1, 15)) AS BIGINT)::HUGEINT), 0)), 1, 16) AS digest FROM (
    SELECT concat_ws('=', coalesce(ecosystem, ''), coalesce(package, ''), coalesce(CAST(rank AS VARCHAR), '')) AS line FROM known_popular)""")
def table_digest(spark: SparkSession, d: str) -> DataFrame:
    return tables.table_digest(table(spark, d, "known_popular"), ["ecosystem", "package", "rank"])


@query("\nUNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in ("known_malicious", "known_popular", "runtime_observations", "scan_queue")))
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    names = ("known_malicious", "known_popular", "runtime_observations", "scan_queue")
    return tables.row_counts({t: table(spark, d, t) for t in names})


@query("""SELECT ecosystem, count(*) FILTER (locked_at IS NULL AND completed_at IS NULL) AS pending,
    count(*) FILTER (locked_at IS NOT NULL AND completed_at IS NULL) AS locked, count(*) FILTER (starts_with(result, 'OK')) AS ok,
    count(*) FILTER (starts_with(result, 'ERR')) AS failed, count(*) AS total FROM scan_queue GROUP BY 1""")
def queue_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scan_queue").groupBy("ecosystem").agg(
        F.count_if(F.col("locked_at").isNull() & F.col("completed_at").isNull()).alias("pending"),
        F.count_if(F.col("locked_at").isNotNull() & F.col("completed_at").isNull()).alias("locked"),
        F.count_if(F.col("result").startswith("OK")).alias("ok"),
        F.count_if(F.col("result").startswith("ERR")).alias("failed"),
        F.count("*").alias("total"),
    )


@query("SELECT id, ecosystem, priority, enqueued_at FROM scan_queue WHERE completed_at IS NULL AND locked_at IS NULL ORDER BY priority, enqueued_at, id LIMIT 50")
def queue_head(spark: SparkSession, d: str) -> DataFrame:
    pending = table(spark, d, "scan_queue").where("completed_at IS NULL AND locked_at IS NULL")
    return pending.orderBy("priority", "enqueued_at", "id").limit(50).select("id", "ecosystem", "priority", "enqueued_at")


# versions and dependencies

_KEY = "list_transform(string_split(version, '.'), lambda p: coalesce(try_cast(CASE WHEN regexp_full_match(p, '[0-9]+') THEN p END AS INTEGER), 9999))"


@query(f"""WITH r AS (SELECT DISTINCT ecosystem, package, version FROM source_files WHERE version IS NOT NULL)
SELECT ecosystem, package, version, lag(version, 1) OVER w AS before_1, lag(version, 3) OVER w AS before_3, lag(version, 5) OVER w AS before_5
FROM r WINDOW w AS (PARTITION BY ecosystem, package ORDER BY {_KEY}, version)""")
def version_predecessors(spark: SparkSession, d: str) -> DataFrame:
    return versions.predecessors(table(spark, d, "source_files"))


@query()
def range_best(spark: SparkSession, d: str) -> DataFrame:
    """Greatest released version within every range that manifests name for released packages."""
    found = dependencies.npm_dependencies(table(spark, d, "source_files"))
    specs = found.select("ecosystem", F.col("name").alias("package"), "spec")
    return versions.max_satisfying(specs, table(spark, d, "source_files"))


@query("""WITH v AS (SELECT DISTINCT 'npm' AS ecosystem, 'p' || (l_suppkey % 20) AS package,
    (l_orderkey % 5) || '.' || (l_partkey % 10) || '.' || l_linenumber AS version FROM lineitem),
k AS (SELECT *, string_split(version, '.')[1]::INT AS a, string_split(version, '.')[2]::INT AS b, string_split(version, '.')[3]::INT AS c FROM v),
s(spec) AS (VALUES ('^1.2.0'), ('~2.3.1'), ('>=3.0.0'), ('<2.0.0'), ('*'), ('^9.0.0'), ('1.2.3 || ^4.1.0'), ('3.x')),
f AS (SELECT package, ecosystem, spec, version, a, b, c, CASE spec
    WHEN '^1.2.0' THEN a = 1 AND (a, b, c) >= (1, 2, 0) WHEN '~2.3.1' THEN a = 2 AND b = 3 AND c >= 1 WHEN '>=3.0.0' THEN (a, b, c) >= (3, 0, 0)
    WHEN '<2.0.0' THEN (a, b, c) < (2, 0, 0) WHEN '*' THEN true WHEN '^9.0.0' THEN a = 9 AND (a, b, c) >= (9, 0, 0)
    WHEN '3.x' THEN a = 3 ELSE (a, b, c) = (1, 2, 3) OR a = 4 AND (a, b, c) >= (4, 1, 0) END AS ok FROM k, s)
SELECT ecosystem, package, spec, arg_max(version, (a, b, c)) FILTER (ok) AS best FROM f GROUP BY ALL""")
def semver_max(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    releases = li.select(
        F.lit("npm").alias("ecosystem"), F.concat(F.lit("p"), (F.col("l_suppkey") % 20).cast("string")).alias("package"),
        F.concat_ws(".", (F.col("l_orderkey") % 5).cast("string"), (F.col("l_partkey") % 10).cast("string"), F.col("l_linenumber").cast("string")).alias("version"),
    ).distinct()
    ranges = ["^1.2.0", "~2.3.1", ">=3.0.0", "<2.0.0", "*", "^9.0.0", "1.2.3 || ^4.1.0", "3.x"]
    specs = releases.select("ecosystem", "package").distinct().select("*", F.explode(F.array(*map(F.lit, ranges))).alias("spec"))
    return versions.max_satisfying(specs, releases)


_BLOCKS = "\nUNION ALL ".join(
    f"SELECT ecosystem, package, version, '{kind}' AS kind, unnest(json_keys(j, '$.{block}')) AS name, json_extract(j, '$.{block}') AS b FROM j"
    for block, kind in dependencies.BLOCKS.items()
)
_NPM = f"""j AS (SELECT ecosystem, package, version, CAST(content AS JSON) AS j FROM source_files WHERE basename = 'package.json' AND json_valid(content)),
e AS ({_BLOCKS}),
dep AS (SELECT DISTINCT ecosystem, package, version, name, json_extract_string(b, '$."' || name || '"') AS spec, kind FROM e)"""


@query(f"WITH {_NPM} SELECT * FROM dep")
def dependencies_npm(spark: SparkSession, d: str) -> DataFrame:
    return dependencies.npm_dependencies(table(spark, d, "source_files"))


@query()
def dependencies_all(spark: SparkSession, d: str) -> DataFrame:
    return dependencies.all_dependencies(table(spark, d, "source_files"))


@query(f"""WITH {_NPM}, direct AS (SELECT ecosystem, package, version, name, min(spec) AS spec FROM dep WHERE kind = 'direct' GROUP BY ALL),
r AS (SELECT DISTINCT ecosystem, package, version FROM direct),
p AS (SELECT *, lag(version) OVER (PARTITION BY ecosystem, package ORDER BY {_KEY}, version) AS before_1 FROM r),
n AS (SELECT p.*, d.name, d.spec AS spec_now FROM p JOIN direct d USING (ecosystem, package, version) WHERE before_1 IS NOT NULL),
t AS (SELECT p.*, d.name, d.spec AS spec_before FROM p JOIN direct d ON p.ecosystem = d.ecosystem AND p.package = d.package AND p.before_1 = d.version),
c AS (SELECT *, CASE WHEN spec_before IS NULL THEN 'added' WHEN spec_now IS NULL THEN 'removed' WHEN spec_now <> spec_before THEN 'version_changed' END AS change
      FROM n FULL JOIN t USING (ecosystem, package, version, before_1, name))
SELECT ecosystem, package, version, before_1, name, spec_now, spec_before, change FROM c WHERE change IS NOT NULL""")
def dependency_changes(spark: SparkSession, d: str) -> DataFrame:
    return dependencies.changed_dependencies(dependencies.npm_dependencies(table(spark, d, "source_files")))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS parent, (p_partkey * 7 + k) % (SELECT count(*) FROM part) AS child FROM part, range(1, 4) t(k)),
w AS (SELECT p_partkey AS root, p_partkey AS node, 0 AS depth FROM part WHERE p_partkey % 100 = 0
      UNION SELECT w.root, e.child, w.depth + 1 FROM w JOIN e ON w.node = e.parent WHERE w.depth < 4)
SELECT root, node, min(depth) AS depth FROM w GROUP BY 1, 2 HAVING min(depth) > 0""")
def dependency_reach(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    n = part.count()
    edges = part.select(F.col("p_partkey").alias("parent"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"))
    edges = edges.select("parent", ((F.col("parent") * 7 + F.col("k")) % n).alias("child"))
    roots = part.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("root"))
    return dependencies.reachable(edges, roots, 4)


# files

_CLASS = " ".join(
    f"WHEN x IN ({quoted(exts.split())}) THEN '{name}'" for name, exts in files.CLASSES.items()
)


@query(f"""SELECT file_id, ecosystem, package, version, path, CASE {_CLASS} ELSE 'other' END AS file_class,
    coalesce(list_has_any(string_split(regexp_replace(path, '[^/]*$', ''), '/'), [{quoted(files.EXCLUDED)}]), false) AS excluded,
    regexp_replace(path, '^(?:package|[^/]+-[0-9][^/]*)/', '') AS inner_path
FROM (SELECT *, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS x FROM source_files)""")
def file_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = files.classified(table(spark, d, "source_files"))
    return rows.select("file_id", "ecosystem", "package", "version", "path", "file_class", "excluded", "inner_path")


@query("""WITH h AS (SELECT DISTINCT ecosystem, package, version, path, sha256(coalesce(content, '')) AS h FROM source_files)
SELECT ecosystem, package, version, count(*) AS files, substr(sha256(string_agg(coalesce(path, '') || ':' || h, E'\\n' ORDER BY coalesce(path, '') || ':' || h)), 1, 32) AS fingerprint
FROM h GROUP BY ALL""")
def package_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return files.fingerprints(table(spark, d, "source_files"))


_IMPORTS = [
    r"(?m)^\s*import\s+(?:[\w*{}\s,$]+\s+from\s+)?['\"]([^'\"]+)['\"]", r"\brequire\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
    r"\bimport\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", r"(?m)^\s*export\s+[\w*{}\s,$]+\s+from\s+['\"]([^'\"]+)['\"]",
]


@query(f"""WITH f AS (SELECT * FROM source_files WHERE lower(trim(language)) = 'javascript' AND content IS NOT NULL),
m AS (SELECT ecosystem, package, version, path, unnest(list_concat({", ".join(f"regexp_extract_all(content, {literal(p)}, 1)" for p in _IMPORTS)})) AS m FROM f),
x AS (SELECT DISTINCT ecosystem, package, version, path, regexp_extract(regexp_replace(m, '^node:', ''), '^(@[^/]+/[^/]+|[^@/][^/]*)', 1) AS module
      FROM m WHERE NOT regexp_matches(m, '^[./]'))
SELECT * FROM x WHERE module <> '' AND module NOT IN ({quoted(NODE_BUILTINS)})""")
def imports_javascript(spark: SparkSession, d: str) -> DataFrame:
    return files.javascript_imports(table(spark, d, "source_files"))




@query(f"""WITH f AS (SELECT DISTINCT ecosystem, package, version, path, content FROM source_files WHERE lower(trim(language)) = 'javascript' AND content IS NOT NULL),
m AS (SELECT DISTINCT ecosystem, package, version, path, unnest(list_concat({", ".join(f"regexp_extract_all(content, {literal(p)}, 1)" for p in _IMPORTS)})) AS spec FROM f),
b AS (SELECT *, regexp_replace(path, '[^/]*$', '') AS folder FROM m),
j AS (SELECT *, CASE WHEN starts_with(spec, './') THEN folder || substr(spec, 3) WHEN starts_with(spec, '../') THEN regexp_replace(folder, '[^/]*/$', '') || substr(spec, 4) END AS stem FROM b),
c AS (SELECT j.*, k.place, stem || k.tail AS target FROM j, (VALUES {", ".join(f"({k}, '{t}')" for k, t in enumerate(files.PROBES))}) k(place, tail)),
r AS (SELECT c.*, row_number() OVER (PARTITION BY c.ecosystem, c.package, c.version, c.path, c.spec ORDER BY place) AS rn FROM c
      JOIN (SELECT DISTINCT ecosystem, package, version, path AS target FROM source_files) t USING (ecosystem, package, version, target))
SELECT ecosystem, package, version, path, spec, target FROM r WHERE rn = 1""")
def imports_resolved(spark: SparkSession, d: str) -> DataFrame:
    return files.resolved_imports(table(spark, d, "source_files"))


@query()
def imports_python(spark: SparkSession, d: str) -> DataFrame:
    return files.python_imports(table(spark, d, "source_files"))


@query("""WITH j AS (SELECT ecosystem, package, version, path, CAST(content AS JSON) AS j FROM source_files WHERE basename = 'package.json' AND json_valid(content)),
e AS (SELECT *, unnest(json_keys(j, '$.scripts')) AS hook FROM j)
SELECT DISTINCT ecosystem, package, version, path, hook, json_extract_string(j, '$.scripts."' || hook || '"') AS command FROM e
WHERE hook IN ('preinstall', 'install', 'postinstall', 'prepare')""")
def scripts_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    return files.lifecycle_scripts(table(spark, d, "source_files"))


@query("""WITH c AS (SELECT file_id, ecosystem, package, version, path, size, sum(coalesce(size, 0)) OVER
    (PARTITION BY ecosystem, package, version ORDER BY path, file_id ROWS UNBOUNDED PRECEDING) AS running_bytes FROM (SELECT DISTINCT * FROM source_files))
SELECT file_id, CAST(running_bytes AS BIGINT) AS running_bytes FROM c WHERE running_bytes <= 20000""")
def files_capped(spark: SparkSession, d: str) -> DataFrame:
    return files.capped_prefix(table(spark, d, "source_files").distinct(), 20000).select("file_id", "running_bytes")


# indicators

_LINES = """l AS (SELECT DISTINCT id, line_no, line FROM (SELECT id, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM
    (SELECT id, string_split(replace(replace(raw_event, E'\\r\\n', E'\\n'), E'\\r', E'\\n'), E'\\n') AS ls FROM runtime_observations WHERE raw_event IS NOT NULL)))"""
_HITS = "\nUNION ALL ".join(
    f"SELECT id, {k} AS rule, '{code}' AS code, CAST({c} AS DOUBLE) AS confidence, min(line_no) AS line_no FROM l WHERE regexp_matches(line, {literal(p)}) GROUP BY id"
    for k, (code, c, p) in enumerate(LINE_PATTERNS)
)
_SEVERITY = "CASE " + " ".join(f"WHEN code IN ({quoted([c for c, s in SEVERITY.items() if s == level])}) THEN '{level}'" for level in ("HIGH", "MEDIUM", "LOW")) + " END"
_BEST = f"""{_LINES}, h AS ({_HITS}),
b AS (SELECT id, code, max(confidence) AS confidence, arg_min(line_no, (-confidence, line_no)) AS line_no, {_SEVERITY} AS severity FROM h GROUP BY id, code)"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return indicators.line_hits(table(spark, d, "runtime_observations"), "id", "raw_event")


@query(f"WITH {_LINES}, h AS ({_HITS}) SELECT id, code, confidence, line_no FROM h")
def indicator_lines(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d)


@query(f"WITH {_BEST} SELECT * FROM b")
def indicator_best(spark: SparkSession, d: str) -> DataFrame:
    return indicators.best_hits(_hits(spark, d), "id")


_DECISIVE = " OR ".join(f"starts_with(code, '{p}')" for p in DECISIVE_PREFIXES)
_ESCALATED = f"""{_BEST}, w AS (SELECT *, code IN ({quoted(WEAK_CODES)}) AND NOT bool_or({_DECISIVE}) OVER (PARTITION BY id) AS weak FROM b),
e AS (SELECT id, code, line_no, CASE WHEN weak THEN 'LOW' ELSE severity END AS severity,
    CASE WHEN weak THEN 'benign' WHEN severity = 'HIGH' AND confidence >= 0.8 THEN 'malicious'
         WHEN severity IN ('HIGH', 'MEDIUM') AND confidence >= 0.5 THEN 'suspicious' ELSE 'benign' END AS verdict,
    CASE WHEN weak THEN least(confidence, 0.4) ELSE confidence END AS confidence FROM w)"""


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return indicators.escalated(indicators.best_hits(_hits(spark, d), "id"), "id")


@query(f"WITH {_ESCALATED} SELECT * FROM e")
def indicator_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d)


@query(f"""WITH {_ESCALATED}, g AS (SELECT id, count(*) AS evidence_count, round(avg(confidence), 6) AS avg_confidence, bool_or(severity = 'HIGH') AS hi,
    bool_or(verdict = 'malicious') AS mal, bool_or(confidence >= 0.85 AND verdict <> 'benign' AND severity <> 'LOW') AS close,
    bool_or(confidence >= 0.7 AND verdict <> 'benign') AS near, count(*) FILTER (verdict IN ('suspicious', 'malicious') AND confidence >= 0.5) AS doubts FROM e GROUP BY 1)
SELECT d.id, coalesce(evidence_count, 0) AS evidence_count, avg_confidence, CASE WHEN evidence_count IS NULL THEN 'CLEAN'
    WHEN hi AND mal AND avg_confidence >= 0.85 THEN 'MALICIOUS' WHEN close AND doubts >= 1 THEN 'HIGH_RISK' WHEN near OR doubts >= 2 THEN 'SUSPICIOUS' ELSE 'CLEAN' END AS verdict
FROM (SELECT DISTINCT id FROM runtime_observations) d LEFT JOIN g USING (id)""")
def verdict_per_observation(spark: SparkSession, d: str) -> DataFrame:
    e = _evidence(spark, d).withColumn("similarity", F.col("confidence")).withColumnRenamed("verdict", "review")
    return evidence.verdicts(table(spark, d, "runtime_observations"), e, "id")


@query()
def indicator_texts(spark: SparkSession, d: str) -> DataFrame:
    return indicators.text_hits(table(spark, d, "source_files").dropDuplicates(["file_id"]), "file_id", "content")


@query(f"""WITH {_BEST}, s AS (SELECT DISTINCT id, source FROM runtime_observations), c AS (SELECT source, code, count(*) AS n FROM b JOIN s USING (id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, code) AS place FROM c)
SELECT source, code, n, place FROM r WHERE place <= 10""")
def code_topk(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "runtime_observations").select("id", "source").distinct()
    return evidence.top_codes(indicators.best_hits(_hits(spark, d), "id").join(kinds, "id"), "source", "code")


@query(r"""WITH s AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '["'']([A-Za-z0-9+/=_.-]{16,})["'']', 1)) AS value FROM documents),
c AS (SELECT value, unnest(string_split(value, '')) AS ch FROM (SELECT DISTINCT value FROM s)),
n AS (SELECT value, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY ALL),
e AS (SELECT value, round(-sum(n / length(value) * log2(n / length(value))), 6) AS entropy FROM n GROUP BY value)
SELECT doc_id, value, length(value) AS chars, entropy FROM s JOIN e USING (value)""")
def entropy_strings(spark: SparkSession, d: str) -> DataFrame:
    return indicators.suspicious_strings(table(spark, d, "documents"), "doc_id", "text")


@query()
def decoded_strings(spark: SparkSession, d: str) -> DataFrame:
    found = indicators.suspicious_strings(table(spark, d, "source_files"), "file_id", "content")
    return indicators.decoded_strings(found).where("encoding IS NOT NULL")


# behaviour


@query()
def calls_python(spark: SparkSession, d: str) -> DataFrame:
    return behavior.python_calls(table(spark, d, "source_files"))


_JS_NAMES = "|".join(sorted((n.replace(".", r"\.") for n, _ in calls_of(JAVASCRIPT_CALLS)), key=len, reverse=True))
_JS_CALL = rf"(?:^|[^A-Za-z0-9_$.])({_JS_NAMES})\s*[(\[.]"


@query(f"""WITH f AS (SELECT DISTINCT file_id, string_split(replace(replace(content, E'\\r\\n', E'\\n'), E'\\r', E'\\n'), E'\\n') AS ls FROM source_files
    WHERE lower(trim(language)) = 'javascript' AND content IS NOT NULL),
l AS (SELECT file_id, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM f),
c AS (SELECT DISTINCT file_id, line_no, unnest(regexp_extract_all(line, {literal(_JS_CALL)}, 1)) AS name FROM l),
k(name, dimension) AS (VALUES {", ".join(f"('{n}', '{x}')" for n, x in calls_of(JAVASCRIPT_CALLS))})
SELECT file_id, line_no, name, dimension FROM c JOIN k USING (name)""")
def calls_javascript(spark: SparkSession, d: str) -> DataFrame:
    return behavior.javascript_calls(table(spark, d, "source_files"))


def _letter():
    t = F.col("event_type")
    return F.when(t == "view", "I").when(t == "click", "E").when(t == "purchase", "X").when(t == "signup", "T")


_TRACE = """t AS (SELECT user_id, string_agg(x, '' ORDER BY ts, event_id) AS trace FROM (SELECT *,
    CASE event_type WHEN 'view' THEN 'I' WHEN 'click' THEN 'E' WHEN 'purchase' THEN 'X' WHEN 'signup' THEN 'T' END AS x FROM events) WHERE x IS NOT NULL GROUP BY 1)"""


def _traces(spark: SparkSession, d: str) -> DataFrame:
    return behavior.traces(table(spark, d, "events"), "user_id", ["ts", "event_id"], _letter())


@query(
    f"WITH {_TRACE} "
    + "\nUNION ALL ".join(
        f"SELECT user_id, '{code}' AS pattern, '{level}' AS severity, length(regexp_extract(trace, '^(.*?)(?:{p})', 1)) AS start, regexp_extract(trace, '{p}') AS matched FROM t WHERE regexp_matches(trace, '{p}')"
        for code, level, p in SEQUENCES
    )
)
def sequence_mining(spark: SparkSession, d: str) -> DataFrame:
    return behavior.mined(_traces(spark, d), "user_id")


_KIND_SET = "list_distinct(list(CASE event_type WHEN 'view' THEN 'I' WHEN 'click' THEN 'E' WHEN 'purchase' THEN 'X' WHEN 'signup' THEN 'T' END)) AS k"


def _rule_sql(key: str) -> str:
    return "\nUNION ALL ".join(f"SELECT {key}, '{code}' AS rule, '{level}' AS severity FROM s WHERE list_has_all(k, [{quoted(need)}])" for code, need, level in BEHAVIOR_RULES)


@query(f"WITH s AS (SELECT user_id, {_KIND_SET} FROM events GROUP BY 1)\n" + _rule_sql("user_id"))
def behavior_rules(spark: SparkSession, d: str) -> DataFrame:
    sets = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set(_letter())).alias("letters"))
    return behavior.ruled(sets, "user_id", "letters")


@query(f"WITH s AS (SELECT user_id || ' ' || CAST(ts AS DATE) AS user_day, {_KIND_SET} FROM events GROUP BY 1)\n" + _rule_sql("user_day"))
def behavior_rules_daily(spark: SparkSession, d: str) -> DataFrame:
    """The rules over each day of a user by itself."""
    day = F.concat_ws(" ", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("user_day")
    sets = table(spark, d, "events").groupBy(day).agg(F.array_sort(F.collect_set(_letter())).alias("letters"))
    return behavior.ruled(sets, "user_day", "letters")


_PROFILE = """o AS (SELECT *, CAST(date_trunc('day', ts) AS DATE) AS day FROM events),
p AS (SELECT user_id, max(n) AS most, list_sort(list_distinct(flatten(list(k)))) AS kinds FROM
    (SELECT user_id, day, count(*) AS n, list(DISTINCT event_type) AS k FROM o WHERE day < DATE '2024-01-15' GROUP BY ALL) GROUP BY 1)"""


def _baseline(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return o, behavior.profiles(o.where("day < '2024-01-15'"), "user_id", "day", "event_type")


@query(f"WITH {_PROFILE} SELECT user_id, most, array_to_string(kinds, ',') AS kinds FROM p")
def baseline_profiles(spark: SparkSession, d: str) -> DataFrame:
    return _baseline(spark, d)[1].withColumn("kinds", F.array_join("kinds", ","))


@query(f"""WITH {_PROFILE}, w AS (SELECT user_id, count(*) AS n, list(DISTINCT event_type) AS kinds FROM o WHERE day >= DATE '2024-01-15' GROUP BY 1),
j AS (SELECT w.user_id, n, most, list_sort(list_filter(w.kinds, lambda k: NOT list_contains(p.kinds, k))) AS new FROM w JOIN p USING (user_id))
SELECT user_id, n, most, n > 3 * most AND n >= 5 AS burst, array_to_string(new, ',') AS new_kinds,
    CASE WHEN len(new) > 0 THEN 'high' WHEN n > 3 * most AND n >= 5 THEN 'medium' ELSE 'info' END AS severity FROM j""")
def baseline_anomalies(spark: SparkSession, d: str) -> DataFrame:
    o, profile = _baseline(spark, d)
    seen = o.where("day >= '2024-01-15'").groupBy("user_id").agg(F.count("*").alias("n"), F.collect_set("event_type").alias("kinds"))
    return behavior.anomalies(seen, profile, "user_id")


# alerts

_ALERT = r"""a AS (SELECT DISTINCT ON (id) id, source, host, package,
    CASE WHEN regexp_full_match(trim(received_at), '\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|\+00:?00)?')
         THEN CAST(replace(substr(trim(received_at), 1, 19), 'T', ' ') AS TIMESTAMP) END AS received_at,
    CASE WHEN starts_with(raw_event, '"') THEN CASE WHEN json_valid(raw_event) THEN json_extract_string(raw_event, '$') END ELSE raw_event END AS payload
    FROM runtime_observations)"""
_TRUSTED = " OR ".join(f"value = '{t}' OR ends_with(value, '.{t}')" for t in alerts.TRUSTED_DOMAINS)
_IOC = f"""{_ALERT}, r AS (
    SELECT id, 'ip' AS type, unnest(regexp_extract_all(lower(payload), {literal(alerts.IPV4)})) AS value FROM a
    UNION ALL SELECT id, 'domain', unnest(regexp_extract_all(lower(payload), {literal(alerts.DOMAIN)})) FROM a
    UNION ALL SELECT id, 'sha256', unnest(regexp_extract_all(lower(payload), {literal(alerts.SHA256)})) FROM a
    UNION ALL SELECT id, 'path', unnest(regexp_extract_all(lower(payload), {literal(alerts.PATH)})) FROM a),
i AS (SELECT DISTINCT id, type, value, CAST(CASE type WHEN 'ip' THEN 0.7 WHEN 'domain' THEN 0.75 WHEN 'path' THEN 0.65 ELSE 0.85 END AS DOUBLE) AS confidence FROM r
    WHERE CASE type WHEN 'ip' THEN NOT regexp_matches(value, {literal(alerts.INTERNAL_IP)}) WHEN 'domain' THEN NOT ({_TRUSTED}) AND NOT regexp_matches(value, '^[0-9.]+$')
        WHEN 'path' THEN regexp_matches(value, {literal(alerts.SENSITIVE_PATH)}) ELSE true END)"""


@query(f"WITH {_ALERT} SELECT id, source, host, received_at, payload FROM a")
def alerts_normalised(spark: SparkSession, d: str) -> DataFrame:
    return alerts.normalised(table(spark, d, "runtime_observations"))


def _iocs(spark: SparkSession, d: str) -> DataFrame:
    return alerts.indicators(alerts.normalised(table(spark, d, "runtime_observations")))


@query(f"WITH {_IOC} SELECT * FROM i")
def alert_indicators(spark: SparkSession, d: str) -> DataFrame:
    return _iocs(spark, d)


_ACCUMULATED = f"""{_IOC}, g AS (SELECT type, value, count(DISTINCT id) AS observations, count(DISTINCT package) AS packages, min(received_at) AS first_seen,
    max(received_at) AS last_seen, max(confidence) AS c FROM i JOIN a USING (id) GROUP BY 1, 2),
s AS (SELECT * EXCLUDE (c), round(greatest(c, 0.5, CASE WHEN observations >= 5 THEN 0.85 WHEN observations >= 3 THEN 0.75 ELSE 0 END,
    CASE WHEN packages >= 3 THEN 0.95 WHEN packages >= 2 THEN 0.9 ELSE 0 END), 4) AS confidence FROM g),
z AS (SELECT *, confidence >= 0.9 OR packages >= 2 AS promoted FROM s)"""


def _accumulated(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "runtime_observations")
    who = o.select("id", "package", alerts.received(F.col("received_at")).alias("received_at")).dropDuplicates(["id"])
    return alerts.accumulated(_iocs(spark, d), who)


@query(f"WITH {_ACCUMULATED} SELECT * FROM z")
def indicators_accumulated(spark: SparkSession, d: str) -> DataFrame:
    return _accumulated(spark, d)


@query(f"""WITH {_ACCUMULATED} SELECT * FROM z WHERE last_seen >= TIMESTAMP '2025-04-01 00:00:00' AND confidence >= 0.5
ORDER BY confidence DESC, observations DESC, type, value LIMIT 100""")
def indicators_since(spark: SparkSession, d: str) -> DataFrame:
    return alerts.since(_accumulated(spark, d), F.lit("2025-04-01 00:00:00").cast("timestamp_ntz"))


# votes and metrics


@query("""WITH v AS (SELECT o_orderkey, unnest([CASE WHEN o_orderkey % 3 = 0 THEN 'malicious' WHEN o_orderkey % 5 = 0 THEN 'suspicious' ELSE 'benign' END,
    CASE WHEN o_totalprice > 200000 THEN 'malicious' WHEN o_totalprice > 100000 THEN 'suspicious' ELSE 'benign' END,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'malicious' WHEN '2-HIGH' THEN 'suspicious' ELSE 'benign' END]) AS vote FROM orders),
g AS (SELECT o_orderkey, count(*) FILTER (vote = 'malicious') AS malicious, count(*) FILTER (vote = 'suspicious') AS suspicious, count(*) FILTER (vote = 'benign') AS benign FROM v GROUP BY 1)
SELECT *, CASE WHEN malicious >= 2 OR malicious >= 1 AND suspicious >= 1 THEN 'malicious' WHEN malicious + suspicious >= 2 OR malicious >= 1 THEN 'suspicious' ELSE 'benign' END AS verdict,
    round(greatest(malicious, suspicious, benign) / (malicious + suspicious + benign), 3) AS agreement FROM g""")
def consensus_votes(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    key, price, level = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderpriority")
    votes = o.select(
        "o_orderkey",
        F.explode(
            F.array(
                F.when(key % 3 == 0, "malicious").when(key % 5 == 0, "suspicious").otherwise("benign"),
                F.when(price > 200000, "malicious").when(price > 100000, "suspicious").otherwise("benign"),
                F.when(level == "1-URGENT", "malicious").when(level == "2-HIGH", "suspicious").otherwise("benign"),
            )
        ).alias("vote"),
    )
    return evidence.consensus(votes, "o_orderkey")


_LOW = "(tp / (tp + fn) + 1.96 * 1.96 / (2 * (tp + fn))) / (1 + 1.96 * 1.96 / (tp + fn))"
_HALF = "1.96 * sqrt((tp / (tp + fn) * (1 - tp / (tp + fn)) + 1.96 * 1.96 / (4 * (tp + fn))) / (tp + fn)) / (1 + 1.96 * 1.96 / (tp + fn))"


@query(f"""WITH r AS (SELECT l_shipdate IS NOT NULL AND l_quantity > 25 AS p, l_returnflag = 'R' AS e, l_linestatus FROM lineitem),
g AS (SELECT l_linestatus, count(*) FILTER (p AND e) AS tp, count(*) FILTER (p AND NOT e) AS fp, count(*) FILTER (NOT p AND e) AS fn, count(*) FILTER (NOT p AND NOT e) AS tn
      FROM r GROUP BY ROLLUP (l_linestatus))
SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE round(tp / (tp + fn), 6) END AS recall,
    CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE round(2 * tp / (2 * tp + fp + fn), 6) END AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
    CASE WHEN tp + fn = 0 THEN 0 ELSE round(greatest(0, {_LOW} - {_HALF}), 6) END AS recall_low, CASE WHEN tp + fn = 0 THEN 0 ELSE round(least(1, {_LOW} + {_HALF}), 6) END AS recall_high FROM g""")
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    results = li.select("l_linestatus", (F.col("l_shipdate").isNotNull() & (F.col("l_quantity") > 25)).alias("predicted"), (F.col("l_returnflag") == "R").alias("expected"))
    return evidence.confusion(results, "l_linestatus")


@query("""WITH r AS (SELECT ecosystem, id, row_number() OVER (PARTITION BY ecosystem ORDER BY md5(CAST(id AS VARCHAR)), id) AS place FROM scan_queue)
SELECT * FROM r WHERE place <= CASE ecosystem WHEN 'PyPI' THEN 30 WHEN 'npm' THEN 40 ELSE 0 END""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return evidence.stratified(table(spark, d, "scan_queue").select("ecosystem", "id"), "ecosystem", "id", {"PyPI": 30, "npm": 40})


@query("""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id AS neighbour_id, round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 4) AS similarity FROM q, embeddings e WHERE q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neighbour_id) AS place FROM s)
SELECT * FROM r WHERE place <= 3""")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return vectors.nearest(e, e.where("vec_id % 100 = 0"), 3)


# integrity


@query()
def merkle_roots(spark: SparkSession, d: str) -> DataFrame:
    return integrity.merkle_roots(table(spark, d, "source_files"), ["ecosystem", "package", "version"], "path", "content")


@query()
def rows_signed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "known_malicious").select("advisory_id", "ecosystem", "package", "attack_type")
    return integrity.signed(rows, ["advisory_id", "ecosystem", "package", "attack_type"], b"row key")


# layers, flows, exports


@query()
def decoded_layers(spark: SparkSession, d: str) -> DataFrame:
    return deobfuscation.decoded_layers(table(spark, d, "source_files").dropDuplicates(["file_id"]), "file_id", "content")


@query()
def taint_flows(spark: SparkSession, d: str) -> DataFrame:
    return taint.flows(table(spark, d, "source_files"))


@query()
def taint_cross_file(spark: SparkSession, d: str) -> DataFrame:
    return taint.cross_file_flows(table(spark, d, "source_files"))


def _advisory_verdicts(spark: SparkSession, d: str) -> DataFrame:
    a = advisory_versions(spark, d).groupBy("ecosystem", "package", "version").agg(F.max(F.col("match_kind") == "exact").alias("exact"))
    return a.select("ecosystem", "package", "version", F.when(F.col("exact"), "MALICIOUS").otherwise("SUSPICIOUS").alias("verdict"))


_VERDICTS = f"""v AS (SELECT ecosystem, package, version, CASE WHEN bool_or(match_kind = 'exact') THEN 'MALICIOUS' ELSE 'SUSPICIOUS' END AS verdict
    FROM ({_SQL["advisory_versions"]}) GROUP BY ALL)"""


@query(f"""WITH {_VERDICTS} SELECT ecosystem, package, version,
    substr(regexp_replace(regexp_replace(lower(ecosystem || '-' || package || '-' || version), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 64) AS rule_name,
    CASE verdict WHEN 'MALICIOUS' THEN 'deny' ELSE 'warn' END AS action,
    'package.name == "' || package || '" && package.version == "' || version || '"' AS expression FROM v""")
def export_policies(spark: SparkSession, d: str) -> DataFrame:
    return exports.policies(_advisory_verdicts(spark, d))


@query()
def export_stix(spark: SparkSession, d: str) -> DataFrame:
    return exports.stix_bundles(_advisory_verdicts(spark, d))


@query()
def export_falco(spark: SparkSession, d: str) -> DataFrame:
    return exports.falco_rules(_iocs(spark, d), "id")


@query()
def export_osv(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "runtime_observations").select("id", "ecosystem", "package", "version").dropDuplicates(["id"])
    return exports.osv_advisories(_iocs(spark, d).join(o.where("package IS NOT NULL AND ecosystem IS NOT NULL"), "id"))


@query()
def export_vex(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "runtime_observations").select("id", "ecosystem", "package", "version").dropDuplicates(["id"])
    e = indicator_evidence(spark, d).join(o.where("package IS NOT NULL"), "id")
    return exports.vex_documents(e.withColumnRenamed("verdict", "review"))


# reports and registers


@query(f"""WITH a AS (SELECT DISTINCT ON (id) id, CASE WHEN json_valid(raw_event) THEN CASE WHEN starts_with(raw_event, '"') THEN json_extract_string(raw_event, '$') ELSE raw_event END END AS p FROM runtime_observations)
SELECT id, unnest(list_sort(list_distinct(regexp_extract_all(p, '"Path": ?"(/(?:home|root|etc)/[^"]+)"', 1)))) AS path FROM a""")
def analysis_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths below home, root and etc in dynamic-analysis documents, whatever wraps them."""
    p = alerts.normalised(table(spark, d, "runtime_observations"))
    raw = table(spark, d, "runtime_observations").select("id", "raw_event").dropDuplicates(["id"]).where(F.expr("try_parse_json(raw_event)").isNotNull())
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("payload", F.lit(r'"Path": ?"(/(?:home|root|etc)/[^"]+)"'), F.lit(1))))
    return p.join(raw.select("id"), "id", "left_semi").select("id", F.explode(found).alias("path"))


@query()
def analysis_observed(spark: SparkSession, d: str) -> DataFrame:
    p = alerts.normalised(table(spark, d, "runtime_observations")).where("source = 'manual'")
    o = traces.observed(p, "id", "payload")
    return o.select("id", *[F.array_join(c, "|").alias(c) for c in o.columns if c != "id"])


# star schema


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 2) AS avg_price, count(*) AS rows_
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_shipdate <= '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_extendedprice"), 2).alias("avg_price"), F.count("*").alias("rows_")
    )


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1""")
def regional_revenue(spark: SparkSession, d: str) -> DataFrame:
    li, o, c, n, r = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"])
    j = j.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r.where("r_name = 'ASIA'"), n["n_regionkey"] == r["r_regionkey"])
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 0).alias("revenue"))


# changes, states, the whole assessment

_CALLS = f"""calls AS (SELECT DISTINCT f.ecosystem, f.package, f.version, c.name, c.dimension FROM ({_SQL["calls_javascript"]}) c
    JOIN (SELECT DISTINCT file_id, ecosystem, package, version FROM source_files) f USING (file_id)),
vs AS (SELECT DISTINCT ecosystem, package, version FROM calls),
pv AS (SELECT *, lag(version) OVER (PARTITION BY ecosystem, package ORDER BY {_KEY}, version) AS before_1 FROM vs),
nc AS (SELECT p.ecosystem, p.package, p.version, p.before_1, c.name, c.dimension FROM pv p JOIN calls c USING (ecosystem, package, version) WHERE before_1 IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM calls b WHERE b.ecosystem = p.ecosystem AND b.package = p.package AND b.version = p.before_1 AND b.name = c.name))"""


def _new_calls(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files")
    owners = f.select("file_id", "ecosystem", "package", "version").dropDuplicates(["file_id"])
    return changes.new_calls(behavior.javascript_calls(f).join(owners, "file_id"))


@query(f"WITH {_CALLS} SELECT * FROM nc")
def calls_new(spark: SparkSession, d: str) -> DataFrame:
    return _new_calls(spark, d)


@query(f"""WITH {_CALLS}, g AS (SELECT ecosystem, package, version, string_agg(DISTINCT dimension, '' ORDER BY dimension) AS dimensions FROM nc GROUP BY ALL)
SELECT *, CASE WHEN contains(dimensions, 'T') AND (contains(dimensions, 'E') OR contains(dimensions, 'I') OR contains(dimensions, 'X'))
    OR contains(dimensions, 'X') AND contains(dimensions, 'E') THEN 'HIGH' WHEN contains(dimensions, 'X') OR contains(dimensions, 'T') THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM g""")
def change_severity(spark: SparkSession, d: str) -> DataFrame:
    return changes.change_severity(_new_calls(spark, d))


@query("""WITH l AS (SELECT id, enqueued_at AS at_, 'pending' AS state FROM scan_queue UNION ALL SELECT id, locked_at, 'running' FROM scan_queue UNION ALL SELECT id, completed_at, 'done' FROM scan_queue)
SELECT id, arg_max(state, (at_, state)) AS state, max(at_) AS since FROM l WHERE at_ IS NOT NULL GROUP BY id""")
def queue_states(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "scan_queue")
    log = None
    for column, state in (("enqueued_at", "pending"), ("locked_at", "running"), ("completed_at", "done")):
        one = q.select("id", F.col(column).alias("at_"), F.lit(state).alias("state"))
        log = one if log is None else log.unionByName(one)
    return changes.current_state(log, "id", "at_", "state")


@query(f"""WITH {_ALERT}, r AS (SELECT id, package, received_at, row_number() OVER (PARTITION BY package ORDER BY received_at DESC NULLS LAST, id DESC) AS place FROM a WHERE package IS NOT NULL)
SELECT * FROM r WHERE place <= 3""")
def observations_newest(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "runtime_observations").where("package IS NOT NULL").dropDuplicates(["id"])
    rows = o.select("id", "package", alerts.received(F.col("received_at")).alias("received_at"))
    return changes.newest(rows, ["package"], F.col("received_at"), "id", 3)


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS was FROM lineitem), n AS (SELECT l_orderkey, l_linenumber, l_linestatus = 'O' AS is_ FROM lineitem)
SELECT CASE WHEN was = is_ THEN 'same' WHEN is_ THEN 'improved' ELSE 'degraded' END AS outcome, count(*) AS n FROM o JOIN n USING (l_orderkey, l_linenumber) GROUP BY 1""")
def results_compared(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    old = li.select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("v"))
    new = li.select("l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("v"))
    return changes.compared(old, new, ["l_orderkey", "l_linenumber"], F.col("v") == 1, "v")


@query(f"""WITH p AS ({_SQL["popular_lookup"]}), m AS (SELECT DISTINCT ecosystem, lower(package) AS n FROM known_malicious)
SELECT p.ecosystem, p.package, greatest(0, CASE WHEN rank <= 10 THEN 10 WHEN rank <= 100 THEN 30 WHEN rank <= 1000 THEN 60 WHEN rank <= 5000 THEN 90 ELSE 200 END
    - CASE WHEN m.n IS NOT NULL THEN 50 ELSE 0 END) AS priority FROM p LEFT JOIN m ON p.ecosystem = m.ecosystem AND lower(p.package) = m.n""")
def priority_scores(spark: SparkSession, d: str) -> DataFrame:
    ranked = popular_lookup(spark, d).withColumn("_n", F.lower("package"))
    known = table(spark, d, "known_malicious").select("ecosystem", F.lower("package").alias("_n"), F.lit(True).alias("known")).distinct()
    j = ranked.join(known, ["ecosystem", "_n"], "left")
    return j.select("ecosystem", "package", changes.priority(F.col("rank"), F.coalesce("known", F.lit(False))).alias("priority"))


@query("""WITH l AS (SELECT l_orderkey AS o_orderkey, max(l_shipdate) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'engine version' WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 'expired' WHEN m > o_orderdate THEN 'invalidated' END AS reason
FROM orders LEFT JOIN l USING (o_orderkey)""")
def cache_reasons(spark: SparkSession, d: str) -> DataFrame:
    cache = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    log = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    checks = [("engine version", F.col("o_orderstatus") == "F"), ("expired", F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz"))]
    return changes.validity(cache, log, ["o_orderkey"], "o_orderdate", "l_shipdate", checks).select("o_orderkey", "reason")


@query()
def package_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return assessment.assessed(*(table(spark, d, t) for t in ("scan_queue", "source_files", "known_malicious", "known_popular")))


# capabilities and metadata


def _capability_sql(language: str, patterns: dict[str, str]) -> str:
    patterns = patterns | {"credential-paths": capabilities.CREDENTIAL_PATHS}
    return "\nUNION ALL ".join(
        f"SELECT file_id, ecosystem, package, version, '{name}' AS capability FROM f WHERE l = '{language}' AND regexp_matches(content, {literal(p)})" for name, p in patterns.items()
    )


_CAPABLE = f"""f AS (SELECT DISTINCT ON (file_id) *, lower(trim(language)) AS l FROM source_files WHERE content IS NOT NULL),
cap AS ({_capability_sql("python", capabilities.PYTHON)}
UNION ALL {_capability_sql("javascript", capabilities.JAVASCRIPT)})"""


@query(f"WITH {_CAPABLE} SELECT * FROM cap")
def capabilities_of_files(spark: SparkSession, d: str) -> DataFrame:
    return capabilities.file_capabilities(table(spark, d, "source_files"))


@query(f"""WITH {_CAPABLE}, k(capability, classes) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in capabilities.CLASSES.items())}),
x AS (SELECT ecosystem, package, version, string_agg(DISTINCT capability, ',' ORDER BY capability) AS capabilities, string_agg(DISTINCT classes, '') AS all_ FROM cap JOIN k USING (capability) GROUP BY ALL),
y AS (SELECT * EXCLUDE (all_), CASE WHEN contains(all_, 'A') THEN 'A' ELSE '' END || CASE WHEN contains(all_, 'B') THEN 'B' ELSE '' END || CASE WHEN contains(all_, 'C') THEN 'C' ELSE '' END AS classes FROM x)
SELECT *, classes = 'ABC' AS trifecta FROM y""")
def capabilities_exposure(spark: SparkSession, d: str) -> DataFrame:
    return capabilities.exposure(capabilities.file_capabilities(table(spark, d, "source_files")))


_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(t, '{'|'.join(words.split())}') THEN '{name}'" for name, words in metadata.CATEGORIES.items()) + " END"


@query(f"SELECT advisory_id, package, {_CATEGORY} AS category FROM (SELECT DISTINCT advisory_id, package, lower(concat_ws(' ', package, summary)) AS t FROM known_malicious)")
def package_categories(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "known_malicious").select("advisory_id", "package", "summary").distinct()
    return a.select("advisory_id", "package", metadata.category(F.concat_ws(" ", "package", "summary")).alias("category"))


@query(f"SELECT * FROM ({_SQL['scripts_lifecycle']}) WHERE regexp_matches(command, {literal(metadata.DANGEROUS_SCRIPT)})")
def scripts_dangerous(spark: SparkSession, d: str) -> DataFrame:
    return metadata.dangerous_scripts(files.lifecycle_scripts(table(spark, d, "source_files")))


@query(r"""WITH s AS (SELECT DISTINCT advisory_id, summary, list_filter(regexp_split_to_array(trim(summary), '\s+'), lambda w: w <> '') AS w FROM known_malicious WHERE summary IS NOT NULL)
SELECT advisory_id, length(summary) AS chars, len(w) AS words, CASE WHEN len(w) > 0 THEN round(list_sum(list_transform(w, lambda x: length(x))) / len(w), 4) END AS mean_word FROM s""")
def description_shapes(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "known_malicious").where("summary IS NOT NULL").select("advisory_id", "summary").distinct()
    return metadata.description_shape(a, "summary").select("advisory_id", "chars", "words", "mean_word")


@query("""WITH v AS (SELECT l_partkey % 100 AS k, l_returnflag AS vote, 'N' AS truth FROM lineitem), c AS (SELECT k, vote, count(*) AS n, max(truth) AS t FROM v GROUP BY ALL)
SELECT k, CAST(sum(n) AS BIGINT) AS trials, count(*) AS distinct_votes, arg_min(vote, (-n, vote)) AS mode_vote, round(max(n) / sum(n), 4) AS agreement, arg_min(vote, (-n, vote)) = max(t) AS correct FROM c GROUP BY k""")
def vote_agreement(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select((F.col("l_partkey") % 100).alias("k"), F.col("l_returnflag").alias("vote"), F.lit("N").alias("truth"))
    return metadata.agreement(li, "k", "vote", "truth")


# files and scripts


_FIRST = " OR ".join(
    f"ecosystem {'=' if name == 'PyPI' else '<>'} 'PyPI' AND p[-1] IN ({quoted(names)}) AND len(p) <= {depth}" for name, (names, depth) in files.FIRST_TIER.items()
)
_NAMED = " ".join(f"WHEN regexp_matches(p[-1], '\\.(?:{'|'.join(ends)})$') THEN '{name}'" for name, ends in files.LANGUAGES.items())


@query(f"""WITH f AS (SELECT DISTINCT file_id, ecosystem, string_split(replace(coalesce(path, ''), chr(92), '/'), '/') AS p FROM source_files),
n AS (SELECT *, CASE {_NAMED} ELSE 'unknown' END AS name_language FROM f)
SELECT file_id, CASE WHEN coalesce({_FIRST}, false) THEN 1 WHEN list_has_any(p, [{quoted(files.COMMAND_FOLDERS)}]) THEN 2 ELSE 3 END AS path_tier, name_language,
    name_language NOT IN ('json', 'toml', 'cfg') OR p[-1] = 'package.json' AS analysed FROM n""")
def file_tiers(spark: SparkSession, d: str) -> DataFrame:
    return files.tiered(table(spark, d, "source_files")).select("file_id", "path_tier", "name_language", "analysed").distinct()


_SHELL = "\nUNION ALL ".join(f"SELECT *, 'shell:{w.strip()}' AS name, '{x}' AS dimension FROM s WHERE contains(lower(command), '{w}')" for w, x in files.SHELL_WORDS.items())


@query(f"WITH s AS ({_SQL['scripts_lifecycle']})\n{_SHELL}")
def script_calls(spark: SparkSession, d: str) -> DataFrame:
    return files.script_calls(files.lifecycle_scripts(table(spark, d, "source_files")))


@query(f"""WITH r AS (SELECT DISTINCT ecosystem, package, version FROM source_files WHERE version IS NOT NULL),
o AS (SELECT * FROM (SELECT *, lag(version) OVER (PARTITION BY ecosystem, package ORDER BY {_KEY}, version) AS before_1 FROM r) WHERE before_1 IS NOT NULL),
n AS (SELECT ecosystem, package, version, regexp_replace(path, '^(?:package|[^/]+-[0-9][^/]*)/', '') AS path, min(sha256(coalesce(content, ''))) AS h FROM source_files
    WHERE version IS NOT NULL AND path IS NOT NULL GROUP BY ALL),
a AS (SELECT o.*, n.path, n.h FROM o JOIN n USING (ecosystem, package, version)),
b AS (SELECT o.*, n.path, n.h AS old FROM o JOIN n ON o.ecosystem = n.ecosystem AND o.package = n.package AND o.before_1 = n.version)
SELECT ecosystem, package, version, before_1, path, CASE WHEN old IS NULL THEN 'added' WHEN h IS NULL THEN 'removed' ELSE 'changed' END AS status
FROM a FULL JOIN b USING (ecosystem, package, version, before_1, path) WHERE old IS DISTINCT FROM h""")
def files_changed(spark: SparkSession, d: str) -> DataFrame:
    return files.changed_files(table(spark, d, "source_files"))


# Python versions


@query("""WITH v AS (SELECT DISTINCT 'PyPI' AS ecosystem, 'p' || (l_suppkey % 20) AS package, l_orderkey % 3 AS a, l_partkey % 5 AS b,
    CASE l_linenumber % 5 WHEN 0 THEN 'rc1' WHEN 1 THEN '' WHEN 2 THEN '.post1' WHEN 3 THEN '.0' ELSE '.dev2' END AS tail FROM lineitem),
k AS (SELECT *, a || '.' || b || tail AS version, tail = '.post1' AS post FROM v),
s(spec) AS (VALUES ('>=1.2,<2'), ('~=1.2'), ('==1.3.*'), ('!=2.4,!=2.4.post1'), ('>1.3'), ('<=1.3'), ('1.2'), ('==9.*'), ('>=x')),
f AS (SELECT *, tail NOT IN ('rc1', '.dev2') AND CASE spec WHEN '>=1.2,<2' THEN a = 1 AND b >= 2 WHEN '~=1.2' THEN a = 1 AND b >= 2 WHEN '==1.3.*' THEN a = 1 AND b = 3
    WHEN '!=2.4,!=2.4.post1' THEN NOT (a = 2 AND b = 4) WHEN '>1.3' THEN (a, b) > (1, 3) WHEN '<=1.3' THEN (a, b) < (1, 3) OR a = 1 AND b = 3 AND NOT post
    WHEN '1.2' THEN a = 1 AND b = 2 AND NOT post ELSE false END AS ok FROM k, s)
SELECT ecosystem, package, spec, arg_max(version, (a, b, post, version)) FILTER (ok) AS best FROM f GROUP BY ALL""")
def pep440_max(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    n = F.col("l_linenumber") % 5
    tail = F.when(n == 0, "rc1").when(n == 1, "").when(n == 2, ".post1").when(n == 3, ".0").otherwise(".dev2")
    releases = li.select(
        F.lit("PyPI").alias("ecosystem"), F.concat(F.lit("p"), (F.col("l_suppkey") % 20).cast("string")).alias("package"),
        F.concat((F.col("l_orderkey") % 3).cast("string"), F.lit("."), (F.col("l_partkey") % 5).cast("string"), tail).alias("version"),
    ).distinct()
    sets = [">=1.2,<2", "~=1.2", "==1.3.*", "!=2.4,!=2.4.post1", ">1.3", "<=1.3", "1.2", "==9.*", ">=x"]
    specs = releases.select("ecosystem", "package").distinct().select("*", F.explode(F.array(*map(F.lit, sets))).alias("spec"))
    return versions.max_satisfying_python(specs, releases)


_PINNED = f"""WITH {_NPM} SELECT *, nullif(regexp_extract(spec, '^\\s*(?:==|=)?\\s*([0-9][^,;\\s]*)\\s*$', 1), '') AS pinned FROM dep"""


@query(_PINNED)
def dependencies_pinned(spark: SparkSession, d: str) -> DataFrame:
    return dependencies.npm_dependencies(table(spark, d, "source_files")).withColumn("pinned", versions.pinned(F.col("spec")))


_JUDGED = f"""p AS ({_PINNED}),
k AS (SELECT ecosystem, lower(package) AS n, bool_or(version_glob IS NULL OR version_glob = '*') AS all_, list(version_glob) AS globs FROM known_malicious GROUP BY 1, 2),
v AS (SELECT p.* EXCLUDE (pinned), CASE WHEN k.n IS NULL THEN 'CLEAN' WHEN all_ OR coalesce(len(list_filter(globs, lambda g: list_contains(string_split(g, ','), pinned))) > 0, false) THEN 'MALICIOUS'
    ELSE 'INDETERMINATE' END AS verdict FROM p LEFT JOIN k ON p.ecosystem = k.ecosystem AND lower(p.name) = k.n)"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    found = dependencies.npm_dependencies(table(spark, d, "source_files"))
    return dependencies.dependency_verdicts(found, table(spark, d, "known_malicious"), versions.pinned(F.col("spec")))


@query(f"WITH {_JUDGED} SELECT * FROM v")
def dependency_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d)


@query(f"WITH {_JUDGED} SELECT kind, verdict, count(*) AS n FROM v GROUP BY ALL")
def dependency_summary(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).groupBy("kind", "verdict").agg(F.count("*").alias("n"))


# work queue


_NOW = "TIMESTAMP '2025-07-01 00:00:00'"


def _now():
    return F.lit("2025-07-01 00:00:00").cast("timestamp_ntz")


@query("""SELECT id, priority, enqueued_at FROM scan_queue WHERE completed_at IS NULL AND (locked_at IS NULL OR locked_by = 'worker-1')
ORDER BY CASE WHEN locked_by = 'worker-1' AND locked_at IS NOT NULL THEN 0 ELSE 1 END, priority NULLS LAST, enqueued_at, id LIMIT 20""")
def queue_claimable(spark: SparkSession, d: str) -> DataFrame:
    return queue.claimable(table(spark, d, "scan_queue"), "worker-1", 20).select("id", "priority", "enqueued_at")


@query(f"""WITH s AS (SELECT *, coalesce(locked_at IS NOT NULL AND completed_at IS NULL AND locked_at < {_NOW} - INTERVAL 30 MINUTE, false) AS stuck FROM scan_queue)
SELECT id, CASE WHEN NOT stuck THEN locked_at END AS locked_at, CASE WHEN NOT stuck THEN locked_by END AS locked_by, CASE WHEN stuck THEN 'RESET:stuck-worker' ELSE result END AS result FROM s""")
def queue_freed(spark: SparkSession, d: str) -> DataFrame:
    return queue.freed(table(spark, d, "scan_queue"), _now()).select("id", "locked_at", "locked_by", "result")


@query("SELECT id, completed_at FROM scan_queue WHERE completed_at IS NULL OR completed_at >= TIMESTAMP '2025-07-01 00:00:00' - INTERVAL 90 DAY")
def queue_purged(spark: SparkSession, d: str) -> DataFrame:
    return queue.purged(table(spark, d, "scan_queue"), _now(), 90).select("id", "completed_at")


@query(f"""WITH o AS (SELECT *, CASE id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'retry' WHEN 2 THEN 'error' END AS outcome, repeat('x', CAST(id % 300 AS INTEGER)) AS e FROM scan_queue)
SELECT id, CASE WHEN outcome IN ('ok', 'error') THEN {_NOW} ELSE completed_at END AS completed_at, CASE WHEN outcome = 'retry' THEN NULL ELSE locked_by END AS locked_by,
    CASE outcome WHEN 'ok' THEN 'OK' WHEN 'retry' THEN 'RETRY:' || substr(e, 1, 200) WHEN 'error' THEN 'ERR:' || substr(e, 1, 200) ELSE result END AS result FROM o""")
def queue_settled(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "scan_queue")
    n = F.col("id") % 4
    outcome = F.when(n == 0, "ok").when(n == 1, "retry").when(n == 2, "error")
    outcomes = q.select("id", outcome.alias("outcome"), F.repeat(F.lit("x"), (F.col("id") % 300).cast("int")).alias("error")).where("outcome IS NOT NULL")
    return queue.settled(q, outcomes, _now()).select("id", "completed_at", "locked_by", "result")


@query("""WITH m AS (SELECT max(batch_id) AS b FROM scan_queue), o AS (SELECT DISTINCT ecosystem, package, version, enqueued_at FROM scan_queue, m WHERE batch_id < b)
SELECT q.id, q.package, q.version FROM scan_queue q, m WHERE q.batch_id = b AND NOT EXISTS (SELECT 1 FROM o WHERE o.ecosystem IS NOT DISTINCT FROM q.ecosystem
    AND o.package IS NOT DISTINCT FROM q.package AND o.version IS NOT DISTINCT FROM q.version AND o.enqueued_at IS NOT DISTINCT FROM q.enqueued_at)""")
def queue_new(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the last batch that no earlier batch has: insert-ignore on the queue's unique key."""
    q = table(spark, d, "scan_queue")
    last = q.agg(F.max("batch_id")).scalar()
    new, old = q.where(F.col("batch_id") == last), q.where(F.col("batch_id") < last)
    return tables.unseen(new, old, ["ecosystem", "package", "version", "enqueued_at"]).select("id", "package", "version")


@query("""SELECT 'verdict_before' AS part, verdict_before AS value, count(*) AS n FROM runtime_observations GROUP BY 2
UNION ALL SELECT 'source', source, count(*) FROM runtime_observations GROUP BY 2 UNION ALL SELECT 'all', NULL, count(*) FROM runtime_observations""")
def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    return tables.counts_by(table(spark, d, "runtime_observations"), ["verdict_before", "source"])


# reviews and summaries


_DIMENSIONS = f"""c AS ({_SQL["calls_javascript"]}), s AS (SELECT file_id, string_agg(DISTINCT dimension, '' ORDER BY dimension) AS dimensions FROM c GROUP BY 1),
h AS (SELECT DISTINCT ON (file_id) file_id, path FROM source_files),
r AS (SELECT s.*, coalesce(regexp_matches(lower(path), 'setup\\.py|postinstall|preinstall'), false) AS hook FROM s JOIN h USING (file_id))"""


@query(f"""WITH {_DIMENSIONS} SELECT file_id, dimensions, CASE WHEN contains(dimensions, 'I') AND contains(dimensions, 'E') AND contains(dimensions, 'T') THEN CASE WHEN hook THEN 'malicious' ELSE 'suspicious' END
    WHEN contains(dimensions, 'T') AND contains(dimensions, 'X') AND hook THEN 'suspicious' ELSE 'benign' END AS review FROM r""")
def file_reviews(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files")
    return reviews.file_reviews(behavior.javascript_calls(f), f)


_PHRASE = "CASE dimension " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in reviews.PHRASES.items()) + " END"


@query(f"""WITH c AS ({_SQL["calls_javascript"]}), o AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_no, name) AS at_ FROM c),
k AS (SELECT file_id, {_PHRASE} AS phrase, min(at_) AS at_ FROM o GROUP BY ALL), p AS (SELECT file_id, string_agg(phrase, ', ' ORDER BY at_) AS kinds FROM k GROUP BY 1),
n AS (SELECT file_id, string_agg(name, ' -> ' ORDER BY at_) AS chain FROM o GROUP BY 1)
SELECT file_id, 'performs: ' || kinds || '. Call chain: ' || chain AS sentence FROM p JOIN n USING (file_id)""")
def call_sentences(spark: SparkSession, d: str) -> DataFrame:
    return reviews.sentences(behavior.javascript_calls(table(spark, d, "source_files")), ["line_no"])


@query("""SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, l_discount * 10 + CASE l_returnflag WHEN 'R' THEN 0.10 WHEN 'A' THEN 0.05 ELSE -0.05 END)), 6) AS confidence FROM lineitem""")
def match_confidences(spark: SparkSession, d: str) -> DataFrame:
    review = F.when(F.col("l_returnflag") == "R", "malicious").when(F.col("l_returnflag") == "A", "suspicious").otherwise("benign")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", reviews.match_confidence(F.col("l_discount") * 10, review).alias("confidence"))


@query(f"""WITH {_BEST} SELECT id, string_agg(DISTINCT code, ',' ORDER BY code) AS codes, string_agg(DISTINCT split_part(code, '-', 1), ',' ORDER BY split_part(code, '-', 1)) AS families,
    count(*) FILTER (severity = 'HIGH') AS high FROM b GROUP BY 1""")
def hit_summary(spark: SparkSession, d: str) -> DataFrame:
    return indicators.hit_summary(indicators.best_hits(_hits(spark, d), "id"), "id")


@query(f"""WITH {_ESCALATED}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY confidence DESC NULLS LAST, code) AS place FROM e) SELECT * FROM r WHERE place <= 3""")
def evidence_top(spark: SparkSession, d: str) -> DataFrame:
    return reviews.top_evidence(_evidence(spark, d), "id")


@query(f"""WITH {_BEST}, p AS (SELECT id, count(*) FILTER (severity = 'HIGH') AS high FROM b GROUP BY 1), s AS (SELECT DISTINCT id, source FROM runtime_observations)
SELECT source, count(*) AS texts, count(*) FILTER (high > 0) AS texts_with_high, max(high) AS most_high, round(count(*) FILTER (high > 0) / count(*), 6) AS spread FROM p JOIN s USING (id) GROUP BY 1""")
def hit_concentration(spark: SparkSession, d: str) -> DataFrame:
    owners = table(spark, d, "runtime_observations").select("id", "source").distinct()
    return reviews.concentration(indicators.best_hits(_hits(spark, d), "id"), "id", owners, "source")


_LEVEL = "CASE verdict " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in reviews.LEVELS.items()) + " ELSE 'unknown' END"


@query(f"WITH v AS ({_SQL['verdict_per_observation']}) SELECT *, {_LEVEL} AS level FROM v WHERE verdict IN ({quoted(reviews.EMITTED)})")
def verdicts_emitted(spark: SparkSession, d: str) -> DataFrame:
    return reviews.emitted(verdict_per_observation(spark, d))


_CATEGORY_RULES = metadata.CATEGORY_RULES
_CATEGORY_OF = "CASE " + " ".join(f"WHEN regexp_matches(lower(package), '{p}') THEN '{name}'" for name, (p, _, _) in _CATEGORY_RULES.items()) + " END"
_BANNED = " OR ".join(f"category = '{name}' AND name IN ({quoted(names)})" for name, (_, _, names) in _CATEGORY_RULES.items())
_BEYOND = " OR ".join(f"category = '{name}' AND dimension IN ({quoted([x for x in 'TXE' if x not in allowed])})" for name, (_, allowed, _) in _CATEGORY_RULES.items())


@query(f"""WITH c AS ({_SQL["calls_javascript"]}), o AS (SELECT DISTINCT ON (file_id) file_id, {_CATEGORY_OF} AS category FROM source_files),
j AS (SELECT c.*, category, {_BANNED} AS banned, {_BEYOND} AS beyond FROM c JOIN o USING (file_id) WHERE category IS NOT NULL)
SELECT file_id, category, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (banned), '') AS names,
    coalesce(string_agg(DISTINCT dimension, '' ORDER BY dimension) FILTER (beyond), '') AS dimensions FROM j GROUP BY 1, 2 HAVING bool_or(banned OR beyond)""")
def category_anomalies(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files")
    return reviews.anomalies_of_category(behavior.javascript_calls(f), f, _CATEGORY_RULES, "package")


@query()
def indicator_sequences(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files")
    return indicators.sequence_hits(behavior.python_calls(f), f)


_WORD = "CASE " + " ".join(f"WHEN contains(lower(text), {literal(w.lower())}) THEN {literal(w)}" for w in indicators.SUSPICIOUS_WORDS) + " END"


@query(f"SELECT doc_id, {_WORD} AS word FROM documents")
def suspicious_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", indicators.suspicious_word(F.col("text")).alias("word"))


# feeds and look-ups


@query(f"""WITH {_IOC}, n AS (SELECT DISTINCT lower(unnest(network_indicators)) AS value, advisory_id, source AS feed FROM known_malicious)
SELECT DISTINCT i.id, i.type, i.value, n.advisory_id, n.feed FROM i JOIN n USING (value)""")
def indicators_looked_up(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "known_malicious").select(F.explode("network_indicators").alias("v"), "advisory_id", F.col("source").alias("feed"))
    listed = listed.select(F.lower("v").alias("value"), "advisory_id", "feed").distinct()
    return _iocs(spark, d).join(listed, "value").select("id", "type", "value", "advisory_id", "feed").distinct()


@query("""SELECT source, count(*) AS records, count(DISTINCT advisory_id) AS advisories, max(modified) AS version, substr(sha256(coalesce(max(modified), '')), 1, 12) AS digest FROM known_malicious GROUP BY 1""")
def feed_status(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "known_malicious").groupBy("source").agg(F.count("*").alias("records"), F.countDistinct("advisory_id").alias("advisories"), F.max("modified").alias("version"))
    return g.withColumn("digest", F.substring(F.sha2(F.coalesce("version", F.lit("")), 256), 1, 12))


@query("""WITH r AS (SELECT ecosystem, lower(package) AS package, advisory_id, source, row_number() OVER (PARTITION BY ecosystem, lower(package)
    ORDER BY CASE WHEN lower(source) LIKE '%osv%' THEN 0 ELSE 1 END, source NULLS LAST, advisory_id) AS rn FROM known_malicious) SELECT ecosystem, package, advisory_id, source FROM r WHERE rn = 1""")
def feeds_merged(spark: SparkSession, d: str) -> DataFrame:
    """One advisory per package over all feeds: those of one family first, then by name."""
    a = table(spark, d, "known_malicious").select("ecosystem", F.lower("package").alias("package"), "advisory_id", "source")
    place = F.when(F.contains(F.lower("source"), F.lit("osv")), 0).otherwise(1)
    return tables.first_by(a, ["ecosystem", "package"], [place, F.asc_nulls_last("source"), F.col("advisory_id")])


@query(f"WITH {_BEST}, {_IOC} SELECT id FROM b WHERE severity = 'HIGH' INTERSECT SELECT id FROM i")
def high_and_indicated(spark: SparkSession, d: str) -> DataFrame:
    high = indicators.best_hits(_hits(spark, d), "id").where("severity = 'HIGH'").select("id")
    return high.intersect(_iocs(spark, d).select("id"))


_MODE = "CASE o_orderkey % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'strict' ELSE 'paranoid' END"


@query(f"""WITH p AS (SELECT o_orderkey, {_MODE} AS m, CASE o_custkey % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'strict' ELSE 'paranoid' END AS c,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS h, CASE WHEN o_custkey % 7 > 0 THEN 'F' END AS g FROM orders),
r AS (SELECT *, CASE c WHEN 'fast' THEN 0 WHEN 'strict' THEN 1 ELSE 2 END AS rc, CASE m WHEN 'fast' THEN 0 WHEN 'strict' THEN 1 ELSE 2 END AS rm FROM p),
x AS (SELECT o_orderkey, CASE WHEN rc < rm THEN 'weaker mode' WHEN m = 'fast' THEN CASE WHEN coalesce(h = g, false) THEN 'match' ELSE 'headers differ' END
    WHEN h IS NULL OR g IS NULL THEN 'no archive hash' WHEN h <> g THEN 'archive differs' ELSE 'match' END AS reason FROM r)
SELECT o_orderkey, reason, reason = 'match' AS "match" FROM x""")
def integrity_matches(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")

    def mode(column: str):
        n = F.col(column) % 3
        return F.when(n == 0, "fast").when(n == 1, "strict").otherwise("paranoid")

    def side(m, h):
        return F.struct(m.alias("mode"), h.alias("etag"), F.lit(1).alias("content_length"), h.alias("archive_sha256"), h.alias("merkle_root"))

    h, g = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), F.when(F.col("o_custkey") % 7 > 0, F.lit("F"))
    pairs = o.select("o_orderkey", side(mode("o_custkey"), h).alias("cached"), side(mode("o_orderkey"), g).alias("fresh"))
    return integrity.fingerprint_matches(pairs).select("o_orderkey", "reason", "match")


# agents and practice


def _agent_signals(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files")
    summaries = table(spark, d, "known_malicious").groupBy("ecosystem", "package").agg(F.max("summary").alias("description"))
    packages = f.select("ecosystem", "package", "version").distinct().join(summaries, ["ecosystem", "package"], "left")
    return agents.signals(packages, f.dropDuplicates(["file_id"]), dependencies.npm_dependencies(f))


def _flags_sql() -> str:
    loop = f"regexp_matches(t, {literal(agents.MODEL_CALL)}) AND regexp_matches(t, {literal(agents.DISPATCH)}) AND regexp_matches(t, {literal(agents.LOOP)})"
    steps = " + ".join(f"CAST(regexp_matches(t, {literal(p)}) AS INTEGER)" for p in agents.STEPS)
    parts = [f"bool_or(regexp_matches(t, {literal(p)})) AS {n}" for n, (_, p) in agents.SIGNS.items()]
    return ", ".join([*parts, f"bool_or({steps} >= 2) AS steps", f"bool_or({loop}) AS loop_", f"bool_or(regexp_matches(t, {literal(agents.APPROVAL)})) AS approval"])


_WEIGHED = " + ".join(
    f"CASE WHEN {flag} THEN {w} ELSE 0 END"
    for w, flag in [
        (3, f"CASE WHEN ecosystem = 'PyPI' THEN regexp_matches(lower(package), {literal(agents.NAME['PyPI'])}) ELSE regexp_matches(lower(package), {literal(agents.NAME['npm'])}) END"),
        (3, "(" + " OR ".join(f"contains(lower(coalesce(description, '')), '{w}')" for w in agents.DESCRIPTION) + ")"),
        (3, "steps"), (3, "loop_"), (2, "client"), (2, "framework"), (1, "store"), *[(w, n) for n, (w, _) in agents.SIGNS.items()],
    ]
)


@query(f"""WITH {_NPM}, f AS (SELECT DISTINCT ON (file_id) *, coalesce(content, '') AS t FROM source_files),
p AS (SELECT DISTINCT ecosystem, package, version FROM f), s AS (SELECT ecosystem, package, max(summary) AS description FROM known_malicious GROUP BY 1, 2),
b AS (SELECT ecosystem, package, version, {_flags_sql()} FROM f GROUP BY ALL),
n AS (SELECT ecosystem, package, version, bool_or(lower(name) IN ({quoted(agents.MODEL_CLIENTS)})) AS client, bool_or(lower(name) IN ({quoted(agents.FRAMEWORKS)})) AS framework,
    bool_or(lower(name) IN ({quoted(agents.STORES)})) AS store FROM dep GROUP BY ALL),
w AS (SELECT p.*, {_WEIGHED.replace("ecosystem =", "p.ecosystem =").replace("lower(package)", "lower(p.package)")} AS score, coalesce(approval, false) AS has_approval
    FROM p LEFT JOIN s ON p.ecosystem = s.ecosystem AND p.package = s.package LEFT JOIN b ON p.ecosystem = b.ecosystem AND p.package = b.package AND p.version IS NOT DISTINCT FROM b.version
    LEFT JOIN n ON p.ecosystem = n.ecosystem AND p.package = n.package AND p.version = n.version)
SELECT ecosystem, package, version, score, score >= {agents.THRESHOLD} AS is_agent, has_approval FROM w""")
def agent_signals(spark: SparkSession, d: str) -> DataFrame:
    return _agent_signals(spark, d)


@query()
def agent_verdicts(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files").dropDuplicates(["file_id"])
    capable = capabilities.file_capabilities(f)
    nothing = capable.select("ecosystem", "package", "version", "capability").limit(0)
    return agents.classified(_agent_signals(spark, d), agents.rule_hits(f), capable, capabilities.exposure(capable), nothing)


_CHECKS = f"""v AS (SELECT DISTINCT ecosystem, package, version FROM source_files), s AS (SELECT ecosystem, package, version, bool_or(regexp_matches(lower(path), {literal(compliance.POLICY)})) AS policy,
    bool_or(regexp_matches(lower(path), {literal(compliance.PARTS)})) AS parts, bool_or(regexp_matches(lower(path), {literal(compliance.HISTORY)})) AS history FROM source_files GROUP BY ALL),
k AS (SELECT DISTINCT ecosystem, lower(package) AS n FROM known_popular),
j AS (SELECT v.*, coalesce(policy, false) AS policy, coalesce(parts, false) AS parts, coalesce(history, false) AS history, k.n IS NOT NULL AS found FROM v
    LEFT JOIN s ON v.ecosystem = s.ecosystem AND v.package = s.package AND v.version IS NOT DISTINCT FROM s.version LEFT JOIN k ON v.ecosystem = k.ecosystem AND lower(v.package) = k.n),
c AS (SELECT ecosystem, package, version, unnest([{{'check': 'PO.4.1', 'status': CASE WHEN policy THEN 'PASS' ELSE 'UNKNOWN' END}}, {{'check': 'PS.1.1', 'status': 'UNKNOWN'}},
    {{'check': 'PS.2.1', 'status': CASE WHEN history THEN 'PASS' ELSE 'UNKNOWN' END}}, {{'check': 'PS.3.1', 'status': CASE WHEN parts THEN 'PASS' ELSE 'FAIL' END}}, {{'check': 'PW.4.1', 'status': 'UNKNOWN'}},
    {{'check': 'PW.4.4', 'status': CASE WHEN found THEN 'PASS' ELSE 'FAIL' END}}, {{'check': 'PW.4.5', 'status': 'UNKNOWN'}}, {{'check': 'PW.7.1', 'status': 'UNKNOWN'}}, {{'check': 'PW.8.1', 'status': 'UNKNOWN'}},
    {{'check': 'RV.1.1', 'status': 'UNKNOWN'}}, {{'check': 'RV.2.1', 'status': CASE WHEN policy THEN 'PASS' ELSE 'UNKNOWN' END}}], recursive := true) FROM j)"""


def _checks(spark: SparkSession, d: str) -> DataFrame:
    """The checks of all versions, known to the registry if popular, without scores."""
    f = table(spark, d, "source_files")
    known = table(spark, d, "known_popular").select("ecosystem", F.lower("package").alias("_n"), F.lit(True).alias("registry_found")).distinct()
    v = f.select("ecosystem", "package", "version").distinct().withColumn("_n", F.lower("package")).join(known, ["ecosystem", "_n"], "left").drop("_n")
    v = v.withColumns({"has_integrity": F.lit(None).cast("boolean"), "scores": F.lit(None).cast("map<string,double>")})
    return compliance.checks(v, compliance.path_signs(f))


@query(f"""WITH {_CHECKS} SELECT ecosystem, package, version, "check", status FROM c""")
def practice_checks(spark: SparkSession, d: str) -> DataFrame:
    return _checks(spark, d)


@query(f"""WITH {_CHECKS} SELECT ecosystem, package, version, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed, count(*) FILTER (status = 'UNKNOWN') AS unknown,
    round(count(*) FILTER (status = 'PASS') / count(*), 3) AS ratio FROM c GROUP BY ALL""")
def practice_summary(spark: SparkSession, d: str) -> DataFrame:
    return compliance.summary(_checks(spark, d))


# patterns of alerts and rule drafts


_PATTERNS = f"""{_IOC}, t AS (SELECT DISTINCT id, type FROM i WHERE type IN ('path', 'ip', 'domain') UNION SELECT id, 'exec' FROM a WHERE contains(payload, 'cmdline')),
m AS (SELECT *, CASE type WHEN 'path' THEN 'INFORMATION_READING' WHEN 'exec' THEN 'PAYLOAD_EXECUTION' ELSE 'DATA_TRANSMISSION' END AS d, CASE type WHEN 'path' THEN 'EXF-001' WHEN 'exec' THEN 'EXM-008' ELSE 'NET-001' END AS c FROM t),
p AS (SELECT id, string_agg(DISTINCT d, ',' ORDER BY d) AS dimensions, string_agg(DISTINCT c, ',' ORDER BY c) AS codes,
    concat_ws(' + ', CASE WHEN bool_or(type = 'path') THEN 'credential read' END, CASE WHEN bool_or(type IN ('ip', 'domain')) THEN 'external network' END, CASE WHEN bool_or(type = 'exec') THEN 'process exec' END) AS summary,
    count(DISTINCT d) >= 2 AND NOT bool_or(type = 'path') AS is_novel FROM m GROUP BY 1)"""


def _patterns(spark: SparkSession, d: str) -> DataFrame:
    a = alerts.normalised(table(spark, d, "runtime_observations"))
    return drafts.patterns(drafts.signs(alerts.indicators(a), a.where(F.contains("payload", F.lit("cmdline"))).select("id")))


@query(f"WITH {_PATTERNS} SELECT * FROM p")
def alert_patterns(spark: SparkSession, d: str) -> DataFrame:
    return _patterns(spark, d)


_DRAFTS = f"""{_PATTERNS}, dr AS (SELECT 'RT-' || substr(md5(dimensions || '|' || codes), 1, 8) AS rule, CASE WHEN contains(dimensions, ',') THEN 'HIGH' ELSE 'MEDIUM' END AS severity, summary, dimensions,
    count(*) AS observations, 'draft' AS status FROM p GROUP BY dimensions, codes, summary)"""


@query(f"WITH {_DRAFTS} SELECT * FROM dr")
def rule_drafts(spark: SparkSession, d: str) -> DataFrame:
    return drafts.rule_drafts(_patterns(spark, d))


@query(f"WITH {_DRAFTS} SELECT * EXCLUDE (status), CASE WHEN severity = 'HIGH' THEN 'approved' ELSE status END AS status, CASE WHEN severity = 'HIGH' THEN 'reviewer' END AS approved_by FROM dr")
def rules_approved(spark: SparkSession, d: str) -> DataFrame:
    made = drafts.rule_drafts(_patterns(spark, d))
    return drafts.approved(made, made.where("severity = 'HIGH'").select("rule", F.lit("reviewer").alias("by")))


@query(f"WITH {_DRAFTS} SELECT severity, status, count(*) AS rules, CAST(sum(observations) AS BIGINT) AS observations FROM dr GROUP BY ALL")
def rule_stats(spark: SparkSession, d: str) -> DataFrame:
    return drafts.rule_drafts(_patterns(spark, d)).groupBy("severity", "status").agg(F.count("*").alias("rules"), F.sum("observations").alias("observations"))


# stage results kept between runs


@query("""WITH c AS (SELECT DISTINCT ecosystem, package, version, source_event AS stage, CAST(batch_id % 3 AS VARCHAR) AS stage_version FROM scan_queue WHERE completed_at IS NOT NULL),
r AS (SELECT DISTINCT ecosystem, package, version, source_event AS stage, '1' AS stage_version FROM scan_queue)
SELECT r.ecosystem, r.package, r.version, r.stage, EXISTS (SELECT 1 FROM c WHERE c.ecosystem IS NOT DISTINCT FROM r.ecosystem AND c.package IS NOT DISTINCT FROM r.package AND c.version IS NOT DISTINCT FROM r.version
    AND c.stage IS NOT DISTINCT FROM r.stage AND c.stage_version = r.stage_version) AS hit FROM r""")
def stage_hits(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "scan_queue")
    owner = ["ecosystem", "package", "version", F.col("source_event").alias("stage")]
    kept = q.where("completed_at IS NOT NULL").select(*owner, (F.col("batch_id") % 3).cast("string").alias("stage_version"))
    asked = q.select(*owner, F.lit("1").alias("stage_version")).distinct()
    return tables.found_in(asked, kept, ["ecosystem", "package", "version", "stage", "stage_version"], "hit").drop("stage_version")


@query("SELECT source_event AS stage, count(*) AS n FROM scan_queue WHERE completed_at IS NOT NULL GROUP BY 1")
def stage_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scan_queue").where("completed_at IS NOT NULL").groupBy(F.col("source_event").alias("stage")).agg(F.count("*").alias("n"))


@query("SELECT severity, count(*) AS codes FROM (VALUES " + ", ".join(f"('{c}', '{s}')" for c, s in SEVERITY.items()) + ") t(code, severity) GROUP BY 1")
def catalog_counts(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(SEVERITY.items()), "code string, severity string").groupBy("severity").agg(F.count("*").alias("codes"))


@query()
def export_tetragon(spark: SparkSession, d: str) -> DataFrame:
    return exports.tetragon_policies(_iocs(spark, d), "id")
