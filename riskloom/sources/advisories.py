"""Advisory and feed files as tables.

Defined results: fields that are missing are null or empty arrays; an entry without a package name gives no row; repeated
entries stay repeated until a keyed merge; empty inputs give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.catalogs import MALICIOUS_PHRASES

OSV = """id string, aliases array<string>, summary string, details string, published string, modified string,
    references array<struct<type: string, url: string>>,
    affected array<struct<package: struct<name: string, ecosystem: string>, versions: array<string>,
        ranges: array<struct<type: string, events: array<map<string, string>>>>>>"""
#: What a text about code may name.
CODE_WORDS = [
    (r"\bbase64\.b64decode\b", "base64.b64decode"),
    (r"\bexec\s*\(", "exec("),
    (r"\beval\s*\(", "eval("),
    (r"\bsubprocess\.(?:Popen|run|call)\b", "subprocess.Popen|run|call"),
    (r"\bos\.system\b", "os.system"),
    (r"\bchild_process\.(?:exec|spawn)\b", "child_process.exec|spawn"),
    (r"\brequests\.(?:get|post)\b", "requests.get|post"),
    (r"\burllib\.request\b", "urllib.request"),
    (r"\bprocess\.env\b", "process.env"),
    (r"\bos\.environ\b", "os.environ"),
    (r"\batob\s*\(", "atob("),
    (r"\bcurl\b", "curl"),
    (r"\bwget\b", "wget"),
    (r"\bpowershell\b", "powershell"),
]
NETWORK = r"https?://[^\s\"'>)]+|[a-zA-Z0-9.-]+\.(?:com|net|org|io|xyz|info|top|tk|ml|ga|cf|gq|onion)(?:/[^\s\"'>)]*)?|\b(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?"


def attack_type(record_id: Column, aliases: Column, text: Column) -> Column:
    """malicious_package by id or alias, else by phrases, the more specific kinds first; else other."""
    mal = F.upper(record_id).startswith("MAL-") | F.exists(F.coalesce(aliases, F.array()), lambda a: F.upper(a).startswith("MAL-"))
    low = F.lower(text)
    spoken = F.exists(F.array(*map(F.lit, MALICIOUS_PHRASES)), lambda p: F.contains(low, p))
    return (
        F.when(mal, "malicious_package")
        .when(spoken & low.rlike("typosquat|typo-squat|typo squat"), "typosquatting")
        .when(spoken & F.contains(low, F.lit("dependency confusion")), "dependency_confusion")
        .when(spoken & F.contains(low, F.lit("slopsquat")), "slopsquatting")
        .when(spoken, "malicious_package")
        .otherwise("other")
    )


def code_indicators(text: Column) -> Column:
    """The names of CODE_WORDS whose patterns a text matches, sorted."""
    return F.array_sort(F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), F.lit(w)) for p, w in CODE_WORDS])))


def network_indicators(text: Column, most: int = 10) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(NETWORK), F.lit(0))), 1, most)


def parse_advisories(texts: DataFrame, column: str = "value", source: str = "OSV", keep_other: bool = False) -> DataFrame:
    """One row per advisory and package from texts that each hold one advisory in the OSV format."""
    r = texts.select(F.from_json(column, OSV).alias("r")).select("r.*").where("id IS NOT NULL")
    text = F.concat_ws(" ", F.coalesce("summary", F.lit("")), F.coalesce("details", F.lit("")))
    rows = r.select("*", attack_type(F.col("id"), F.col("aliases"), text).alias("attack_type"), text.alias("_text"), F.explode("affected").alias("a"))
    bounds = F.flatten(
        F.transform(F.coalesce("a.ranges", F.array()), lambda x: F.flatten(F.transform(F.coalesce(x["events"], F.array()), lambda e: F.map_values(e))))
    )
    versions = F.array_sort(F.array_distinct(F.filter(F.concat(F.coalesce("a.versions", F.array()), bounds), lambda v: v != "0")))
    out = rows.where("a.package.name IS NOT NULL").select(
        F.col("id").alias("advisory_id"), F.col("a.package.ecosystem").alias("ecosystem"), F.col("a.package.name").alias("package"),
        F.when(F.size(versions) == 0, "*").otherwise(F.array_join(versions, ",")).alias("version_glob"), versions.alias("versions"), "attack_type",
        F.lit(source).alias("source"), F.substring(F.coalesce("summary", "details"), 1, 300).alias("summary"), code_indicators(F.col("_text")).alias("code_indicators"),
        network_indicators(F.col("_text")).alias("network_indicators"), F.slice(F.transform(F.coalesce("references", F.array()), lambda x: x["url"]), 1, 10).alias("references_"),
        "published", "modified",
    )
    return out if keep_other else out.where("attack_type <> 'other'")


def read_advisories(spark: SparkSession, path: str, **options) -> DataFrame:
    """Advisories of a folder of JSON files, one advisory a file."""
    return parse_advisories(spark.read.text(path, wholetext=True), **options)


def parse_rank_list(texts: DataFrame, ecosystem: str, source: str, most: int = 5000) -> DataFrame:
    """(ecosystem, package, rank, downloads, source) of a JSON text {"rows": [{"project", "download_count"}]}: the rank
    is the place in the list."""
    rows = texts.select(F.from_json("value", "rows array<struct<project: string, download_count: bigint>>").alias("r"))
    e = rows.select(F.posexplode("r.rows").alias("at", "x")).where(F.col("at") < most)
    return e.select(
        F.lit(ecosystem).alias("ecosystem"), F.lower("x.project").alias("package"), (F.col("at") + 1).alias("rank"),
        F.col("x.download_count").alias("downloads_30d"), F.lit(source).alias("source"),
    )


def parse_rank_map(texts: DataFrame, ecosystem: str, source: str, most: int = 5000) -> DataFrame:
    """The same of a JSON map from name to score: the greatest score has rank 1, ties by name."""
    e = texts.select(F.explode(F.from_json("value", "map<string, double>")).alias("package", "score"))
    ranked = e.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "package"))).where(F.col("rank") <= most)
    return ranked.select(F.lit(ecosystem).alias("ecosystem"), F.lower("package").alias("package"), "rank", F.lit(source).alias("source"))


def parse_url_feed(lines: DataFrame, source: str = "urlhaus") -> DataFrame:
    """(indicator, kind, threat, source) of CSV lines with at least seven fields: each URL and its host, once."""
    fields = "id string, dateadded string, url string, url_status string, last_online string, threat string, tags string, link string, reporter string"
    rows = lines.where(~F.col("value").startswith("#") & (F.size(F.split("value", ",")) >= 7)).select(F.from_csv("value", fields).alias("c")).select("c.*")
    both = rows.select(
        "threat", F.explode(F.array(
            F.struct(F.col("url").alias("indicator"), F.lit("url").alias("kind")), F.struct(F.lower(F.expr("try_parse_url(url, 'HOST')")).alias("indicator"), F.lit("domain").alias("kind"))
        )).alias("i"),
    )
    found = both.select("i.indicator", "i.kind", "threat").where("indicator IS NOT NULL")
    return found.groupBy("indicator", "kind").agg(F.min("threat").alias("threat")).withColumn("source", F.lit(source))


def parse_address_feed(texts: DataFrame, source: str = "feodo") -> DataFrame:
    """(indicator, kind, threat, source) of a JSON array of {"ip_address", "port", "malware"}."""
    e = texts.select(F.explode(F.from_json("value", "array<struct<ip_address: string, port: int, malware: string>>")).alias("x"))
    threat = F.concat_ws(":", F.coalesce("x.malware", F.lit("?")), F.coalesce(F.col("x.port").cast("string"), F.lit("?")))
    return e.where("x.ip_address IS NOT NULL").select(F.col("x.ip_address").alias("indicator"), F.lit("ip").alias("kind"), threat.alias("threat"), F.lit(source).alias("source")).distinct()


def parse_techniques(texts: DataFrame, tactics: tuple[str, ...]) -> DataFrame:
    """(technique_id, name, severity, tactics) of a STIX bundle's attack patterns that are neither revoked nor
    deprecated and serve one of the tactics; severity by the strongest keyword."""
    schema = """objects array<struct<type: string, name: string, description: string, revoked: boolean, x_mitre_deprecated: boolean,
        kill_chain_phases: array<struct<phase_name: string>>, external_references: array<struct<source_name: string, external_id: string>>>>"""
    o = texts.select(F.explode(F.from_json("value", schema)["objects"]).alias("o")).select("o.*")
    phases = F.array_sort(F.array_intersect(F.transform(F.coalesce("kill_chain_phases", F.array()), lambda p: p["phase_name"]), F.array(*map(F.lit, tactics))))
    ref = F.filter("external_references", lambda r: r["source_name"] == "mitre-attack")
    text = F.lower(F.concat_ws(" ", "name", "description"))
    severity = F.when(text.rlike("credential|exfiltrat|ransom|backdoor|remote code"), "HIGH").when(text.rlike("execut|persist|inject|obfuscat"), "MEDIUM").otherwise("LOW")
    rows = o.where((F.col("type") == "attack-pattern") & ~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("x_mitre_deprecated", F.lit(False)))
    return rows.select(F.get(ref, F.lit(0))["external_id"].alias("technique_id"), "name", severity.alias("severity"), F.array_join(phases, ",").alias("tactics")).where(
        (F.col("tactics") != "") & F.col("technique_id").isNotNull()
    )


def parse_registry(texts: DataFrame, ecosystem: str) -> DataFrame:
    """(ecosystem, package, version, archive_url, latest) of registry documents; of a PyPI release the sdist, else a
    wheel, else the first file."""
    if ecosystem == "PyPI":
        schema = "info struct<name: string, version: string>, releases map<string, array<struct<packagetype: string, url: string>>>"
        d = texts.select(F.from_json("value", schema).alias("d")).select("d.info.*", F.explode("d.releases").alias("release", "files"))
        first = lambda kind: F.get(F.filter("files", lambda f: f["packagetype"] == kind), F.lit(0))["url"]
        url = F.coalesce(first("sdist"), first("bdist_wheel"), F.get("files", F.lit(0))["url"])
        return d.select(F.lit(ecosystem).alias("ecosystem"), F.col("name").alias("package"), F.col("release").alias("version"), url.alias("archive_url"), F.col("version").alias("latest"))
    schema = "name string, `dist-tags` map<string, string>, versions map<string, struct<dist: struct<tarball: string>>>"
    d = texts.select(F.from_json("value", schema).alias("d"))
    e = d.select(F.col("d.name").alias("package"), F.col("d.dist-tags")["latest"].alias("latest"), F.explode("d.versions").alias("version", "v"))
    return e.select(F.lit(ecosystem).alias("ecosystem"), "package", "version", F.col("v.dist.tarball").alias("archive_url"), "latest")


def parse_changes(rows: DataFrame) -> DataFrame:
    """(package, version, serial) of changelog rows (package, version, action, serial): creations and new files, each
    version at its first serial."""
    keep = F.col("action").isin("create", "new release") | F.col("action").startswith("add ")
    return rows.where(keep & F.col("version").isNotNull()).groupBy("package", "version").agg(F.min("serial").alias("serial"))


def parse_titles(rows: DataFrame, column: str = "title") -> DataFrame:
    """package and version of feed titles `name version`."""
    pattern = r"^(.*) (\S+)$"
    return rows.where(F.col(column).rlike(pattern)).select("*", F.regexp_extract(column, pattern, 1).alias("package"), F.regexp_extract(column, pattern, 2).alias("version"))


def labelled(spark: SparkSession, path: str, ecosystem: str = "PyPI") -> DataFrame:
    """(package, ecosystem, label, note) of a benchmark CSV; aliases of columns and labels are folded, benign by default."""
    raw = spark.read.csv(path, header=True)
    col = lambda *names: F.coalesce(*[F.col(n) for n in names if n in raw.columns], F.lit(None).cast("string"))
    label = F.lower(F.trim(col("label", "expected")))
    return raw.select(
        col("package", "name").alias("package"), F.coalesce(col("ecosystem"), F.lit(ecosystem)).alias("ecosystem"),
        F.when(label.isin("positive", "malicious", "1", "true"), "malicious").otherwise("benign").alias("label"), col("note").alias("note"),
    )
