"""All evidence about package versions in one plan, and the verdict it leads to.

Each stage is an independent projection into the same evidence columns; the plan is their union and one aggregation. A
version with an exact advisory is decided by it: its other evidence is not gathered, as an anti join in front of the
file stages keeps its files from being scanned.

Defined results: versions without evidence are CLEAN; releases known only from the queue or only from files both count;
empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import behavior, capabilities, dependencies, evidence, files as file_rows, indicators, lookups, message_dedup, metadata, versions as ranges
from riskloom.runtime import cut

OWNER = ("ecosystem", "package", "version")
EVIDENCE = ("ecosystem", "package", "version", "stage", "code", "severity", "review", "confidence", "similarity")


def releases(queue: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct versions of both tables, names and versions as their registries compare them."""

    def side(df: DataFrame) -> DataFrame:
        return df.select(
            "ecosystem", message_dedup.canonical_package(df["ecosystem"], df["package"]).alias("package"),
            F.trim(df["version"], F.lit(message_dedup.BLANKS)).alias("version"),
        )

    return side(queue).unionByName(side(files)).distinct()


def from_advisories(versions: DataFrame, advisories: DataFrame) -> DataFrame:
    exact = lookups.match_versions(versions, advisories).where("match_kind = 'exact'")
    return exact.select(
        *OWNER, F.lit("advisory").alias("stage"), F.col("advisory_id").alias("code"), F.lit("HIGH").alias("severity"), F.lit("malicious").alias("review"),
        F.lit(0.99).alias("confidence"), F.lit(1.0).alias("similarity"),
    )


def from_names(versions: DataFrame, popular: DataFrame, most: int = 3) -> DataFrame:
    """Names close to a popular one, unless they are popular themselves."""
    unknown = lookups.popularity(versions.select("ecosystem", "package").distinct(), popular).where("NOT is_popular")
    top = lookups.top_similar(lookups.similar_names(unknown, popular), most)
    j = versions.withColumn("_name", F.lower("package")).join(top.withColumnRenamed("package", "_name"), ["ecosystem", "_name"])
    return j.select(
        *OWNER, F.lit("name").alias("stage"), F.concat(F.lit("close to "), "candidate").alias("code"), F.when(F.col("similarity") >= 0.85, "MEDIUM").otherwise("LOW").alias("severity"),
        F.lit("suspicious").alias("review"), F.least(F.lit(0.9), "similarity").alias("confidence"), "similarity",
    )


def from_indicators(files: DataFrame, owners: DataFrame) -> DataFrame:
    found = indicators.escalated(indicators.best_hits(indicators.line_hits(files, "file_id", "content"), "file_id"), "file_id")
    return found.join(owners, "file_id").select(
        *OWNER, F.lit("indicator").alias("stage"), "code", "severity", F.col("verdict").alias("review"), "confidence", F.col("confidence").alias("similarity")
    )


def from_behavior(files: DataFrame, owners: DataFrame, python: DataFrame) -> DataFrame:
    """Rules over the dimensions of each file's calls, in both languages."""
    js = behavior.javascript_calls(files).select("file_id", "dimension")
    py = python.select("file_id", "dimension")
    sets = js.unionByName(py).groupBy("file_id").agg(F.array_sort(F.collect_set("dimension")).alias("letters"))
    hits = behavior.ruled(sets, "file_id", "letters")
    review = F.when(F.col("severity") == "HIGH", "suspicious").otherwise("benign")
    return hits.join(owners, "file_id").select(
        *OWNER, F.lit("behavior").alias("stage"), F.col("rule").alias("code"), "severity", review.alias("review"), F.lit(0.6).alias("confidence"), F.lit(0.6).alias("similarity")
    )


def from_sequences(files: DataFrame, owners: DataFrame, python: DataFrame) -> DataFrame:
    """Indicators over the order of Python calls."""
    hits = indicators.sequence_hits(python, files).withColumn("severity", indicators.severity_of(F.col("code")))
    found = indicators.escalated(hits, "file_id")
    return found.join(owners, "file_id").select(
        *OWNER, F.lit("sequence").alias("stage"), "code", "severity", F.col("verdict").alias("review"), "confidence", F.col("confidence").alias("similarity")
    )


def from_scripts(files: DataFrame) -> DataFrame:
    """Lifecycle scripts that fetch or run code."""
    bad = metadata.dangerous_scripts(file_rows.lifecycle_scripts(files))
    return bad.select(
        *OWNER, F.lit("script").alias("stage"), F.col("hook").alias("code"), F.lit("HIGH").alias("severity"), F.lit("suspicious").alias("review"),
        F.lit(0.8).alias("confidence"), F.lit(0.8).alias("similarity"),
    )


def from_dependencies(files: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies that advisories name: with the version they pin or all versions, or with others."""
    found = dependencies.dependency_verdicts(dependencies.all_dependencies(files), advisories, ranges.pinned(F.col("spec"))).where("verdict <> 'CLEAN'")
    exact = F.col("verdict") == "MALICIOUS"
    return found.select(
        *OWNER, F.lit("dependency").alias("stage"), F.col("name").alias("code"), F.when(exact, "HIGH").otherwise("LOW").alias("severity"),
        F.when(exact, "malicious").otherwise("suspicious").alias("review"), F.when(exact, 0.9).otherwise(0.4).alias("confidence"), F.when(exact, 0.9).otherwise(0.4).alias("similarity"),
    )


def from_capabilities(files: DataFrame) -> DataFrame:
    """Versions that can read untrusted input, reach private data and act outside, all at once."""
    exposed = capabilities.exposure(capabilities.file_capabilities(files)).where("trifecta")
    return exposed.select(
        *OWNER, F.lit("capability").alias("stage"), F.lit("trifecta").alias("code"), F.lit("LOW").alias("severity"), F.lit("benign").alias("review"),
        F.lit(0.3).alias("confidence"), F.lit(0.3).alias("similarity"),
    )


def gathered(queue: DataFrame, files: DataFrame, advisories: DataFrame, popular: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(versions, evidence)."""
    versions = releases(queue, files)
    decided = cut(from_advisories(versions, advisories))
    owned = files.select(
        "file_id", "language", "content", "path", "basename", "ecosystem", message_dedup.canonical_package(files["ecosystem"], files["package"]).alias("package"), "version"
    ).dropDuplicates(["file_id"])
    open_ = owned.join(decided.select(*OWNER).distinct(), list(OWNER), "left_anti")
    owners = open_.select("file_id", *OWNER)
    python = cut(behavior.python_calls(open_))  # parsed once for both stages that go by calls
    parts = [
        decided, from_names(versions, popular), from_indicators(open_, owners), from_behavior(open_, owners, python), from_sequences(open_, owners, python),
        from_scripts(open_), from_dependencies(open_, advisories), from_capabilities(open_),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return versions, out.select(*EVIDENCE)


#: Stages that a verdict needs.
REQUIRED = ("registry", "source")


def with_failures(verdicts: DataFrame, stages: DataFrame) -> DataFrame:
    """Verdicts (owner, verdict) after the outcomes of stages (owner, stage, success, error): a version whose registry entry
    was not found is CANNOT_ANALYZE, one with another failed REQUIRED stage ERROR, whatever its evidence says."""
    failed = stages.where(~F.col("success") & F.col("stage").isin(*REQUIRED)).groupBy(*OWNER).agg(
        F.max((F.col("stage") == "registry") & F.coalesce(F.contains(F.lower("error"), F.lit("not found")), F.lit(False))).alias("_missing")
    )
    j = verdicts.join(failed, list(OWNER), "left")
    verdict = F.when(F.col("_missing"), "CANNOT_ANALYZE").when(F.col("_missing").isNotNull(), "ERROR").otherwise(F.col("verdict"))
    return j.withColumn("verdict", verdict).select(*verdicts.columns)


def assessed(queue: DataFrame, files: DataFrame, advisories: DataFrame, popular: DataFrame) -> DataFrame:
    """(ecosystem, package, version, evidence_count, avg_confidence, verdict) of every version."""
    versions, found = gathered(queue, files, advisories, popular)
    key = F.to_json(F.struct(*OWNER), {"ignoreNullFields": "false"}).alias("subject")
    judged = evidence.verdicts(versions.select(key), found.select(key, "severity", "review", "confidence", "similarity"), "subject")
    parsed = F.from_json("subject", "ecosystem string, package string, version string")
    return judged.select(parsed.alias("s"), "evidence_count", "avg_confidence", "verdict").select("s.*", "evidence_count", "avg_confidence", "verdict")
