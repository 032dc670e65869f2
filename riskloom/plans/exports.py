"""Documents for other tools from verdicts, evidence and indicators, as text columns.

Defined results: keys of JSON objects stand in a fixed order; ids are name-based, so equal input gives equal documents;
null fields are left out; a subject without indicators gives a document without rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Action of a package-manager policy by verdict, and VEX state by verdict of a review.
POLICY = {"MALICIOUS": "deny", "HIGH_RISK": "deny", "SUSPICIOUS": "warn"}
STATE = {"malicious": "exploitable", "suspicious": "in_triage", "benign": "not_affected"}


def uuid5(namespace: bytes, name: Column) -> Column:
    """Name-based UUID of version 5 with built-in functions."""
    h = F.sha1(F.concat(F.lit(namespace), F.to_binary(name, F.lit("utf-8"))))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12),
    )


def slug(text: Column, most: int = 64) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, most)


def mapped(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def emitted(verdicts: DataFrame) -> DataFrame:
    return verdicts.where(F.col("verdict").isin("MALICIOUS", "HIGH_RISK", "SUSPICIOUS"))


def stix_bundles(verdicts: DataFrame, namespace: bytes = b"\x6b\xa7\xb8\x10\x9d\xad\x11\xd1\x80\xb4\x00\xc0\x4f\xd4\x30\xc8") -> DataFrame:
    """(ecosystem, package, version, bundle) of emitted verdicts; an indicator per version, malware only from HIGH_RISK."""
    name = F.concat_ws(":", "ecosystem", "package", "version")
    ident = lambda kind: F.concat(F.lit(kind + "--"), uuid5(namespace, F.concat(F.lit(kind + ":"), name)))
    pattern = F.concat(F.lit("[software:name = '"), "package", F.lit("' AND software:version = '"), "version", F.lit("']"))
    indicator = F.struct(
        F.lit("indicator").alias("type"), F.lit("2.1").alias("spec_version"), ident("indicator").alias("id"), F.array(F.lower("verdict")).alias("labels"),
        pattern.alias("pattern"), F.lit("stix").alias("pattern_type"),
    )
    malware = F.struct(
        F.lit("malware").alias("type"), F.lit("2.1").alias("spec_version"), ident("malware").alias("id"), F.array(F.lower("verdict")).alias("labels"),
        F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("string").alias("pattern_type"),
    )
    objects = F.when(F.col("verdict").isin("MALICIOUS", "HIGH_RISK"), F.array(indicator, malware)).otherwise(F.array(indicator))
    bundle = F.to_json(F.struct(F.lit("bundle").alias("type"), ident("bundle").alias("id"), objects.alias("objects")))
    return emitted(verdicts).select("ecosystem", "package", "version", bundle.alias("bundle"))


def vex_documents(evidence: DataFrame) -> DataFrame:
    """(ecosystem, package, version, vex): CycloneDX vulnerabilities of each version from (code, review, confidence)."""
    item = F.struct(
        F.col("code").alias("id"), F.struct(mapped(STATE, F.col("review")).alias("state")).alias("analysis"),
        F.array(F.struct(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")) * 10, 1).alias("score"))).alias("ratings"),
    )
    g = evidence.groupBy("ecosystem", "package", "version").agg(F.array_sort(F.collect_set(item)).alias("vulnerabilities"))
    doc = F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.lit(1).alias("version"), F.col("vulnerabilities")))
    return g.select("ecosystem", "package", "version", doc.alias("vex"))


def policies(verdicts: DataFrame) -> DataFrame:
    """(ecosystem, package, version, rule_name, action, expression) of verdicts that call for one."""
    expression = F.concat(F.lit('package.name == "'), "package", F.lit('" && package.version == "'), "version", F.lit('"'))
    rows = verdicts.withColumn("action", mapped(POLICY, F.col("verdict"))).where("action IS NOT NULL")
    return rows.select("ecosystem", "package", "version", slug(F.concat_ws("-", "ecosystem", "package", "version")).alias("rule_name"), "action", expression.alias("expression"))


def falco_rules(indicators: DataFrame, key: str) -> DataFrame:
    """(key, rules): one YAML text per key from its domains and paths (key, type, value), sorted."""
    g = indicators.where(F.col("type").isin("domain", "path")).groupBy(key).agg(
        F.array_sort(F.collect_set(F.when(F.col("type") == "domain", F.col("value")))).alias("domains"),
        F.array_sort(F.collect_set(F.when(F.col("type") == "path", F.col("value")))).alias("paths"),
    )
    listed = lambda c: F.array_join(F.transform(c, lambda v: F.concat(F.lit('"'), v, F.lit('"'))), ", ")
    network = F.when(F.size("domains") > 0, F.concat(F.lit("- rule: contact "), F.col(key).cast("string"), F.lit("\n  condition: evt.type = connect and fd.sip.name in ("), listed("domains"), F.lit(")\n")))
    access = F.when(F.size("paths") > 0, F.concat(F.lit("- rule: access "), F.col(key).cast("string"), F.lit("\n  condition: open_read and fd.name in ("), listed("paths"), F.lit(")\n")))
    return g.select(key, F.concat_ws("", network, access).alias("rules"))


def osv_advisories(found: DataFrame, namespace: str = "LOCAL") -> DataFrame:
    """(ecosystem, package, advisory): an OSV text per package from (ecosystem, package, version, type, value) rows."""
    g = found.groupBy("ecosystem", "package").agg(
        F.array_sort(F.collect_set("version")).alias("versions"), F.array_sort(F.collect_set(F.concat_ws(":", "type", "value"))).alias("values")
    )
    doc = F.struct(
        F.concat(F.lit(namespace + "-"), F.substring(F.sha2(F.concat_ws("/", "ecosystem", "package"), 256), 1, 16)).alias("id"),
        F.concat(F.lit("Indicators seen with "), "package").alias("summary"), F.array_join(F.slice("values", 1, 10), ", ").alias("details"),
        F.array(F.struct(F.struct(F.col("package").alias("name"), "ecosystem").alias("package"), F.col("versions"))).alias("affected"),
    )
    return g.select("ecosystem", "package", F.to_json(doc).alias("advisory"))


def tetragon_policies(indicators: DataFrame, key: str) -> DataFrame:
    """(key, policy): one tracing policy (YAML) per subject of indicators (key, type, value): files it opens and addresses it
    connects to, in order; subjects without either have none."""
    quoted_ = F.concat(F.lit('            - "'), F.regexp_replace("value", r'(["\\\\])', r"\\\\$1"), F.lit('"'))
    rows = indicators.where(F.col("type").isin("path", "ip")).select(key, "type", quoted_.alias("line")).distinct()
    lists = [F.array_sort(F.collect_set(F.when(F.col("type") == t, F.col("line")))).alias(t) for t in ("path", "ip")]
    g = rows.groupBy(key).agg(*lists)

    def section(lines: Column, call: str, operator: str) -> Column:
        head = f"  - call: {call}\\n    selectors:\\n      - matchArgs:\\n        - index: {0 if operator == 'DAddr' else 1}\\n          operator: {operator}\\n          values:\\n".replace("\\n", "\n")
        return F.when(F.size(lines) > 0, F.concat(F.lit(head), F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))

    head = F.concat(F.lit("apiVersion: cilium.io/v1alpha1\nkind: TracingPolicy\nmetadata:\n  name: subject-"), F.col(key).cast("string"), F.lit("\nspec:\n  kprobes:\n"))
    text = F.concat(head, section(F.col("path"), "security_file_open", "Equal"), section(F.col("ip"), "tcp_connect", "DAddr"))
    return g.select(key, text.alias("policy"))
