"""Checks of a version's development practice: each PASS, FAIL or UNKNOWN, with counts and the share that passes.

Defined results: a score below 0 or a missing score is UNKNOWN; versions without files or metadata have what these would
show as missing; null flags count as unknown; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OWNER = ("ecosystem", "package", "version")

# Least scores that pass.
LEAST = {"Security-Policy": 7.0, "Signed-Releases": 5.0, "Maintained": 5.0, "Code-Review": 5.0, "SAST": 5.0, "Fuzzing": 5.0, "Vulnerabilities": 7.0}
# Paths that show a policy, a list of parts and a history of changes.
POLICY = r"security\.(?:md|rst)$"
PARTS = r"sbom|cyclonedx|spdx"
HISTORY = r"changelog|history\.md|history\.rst|release_notes|release-notes|(?:^|/)changes(?:\.[^/]*)?$"


def path_signs(files: DataFrame) -> DataFrame:
    """(…, has_policy, has_parts, has_history) per version, from the paths of its files."""
    low = F.lower(F.coalesce("path", F.lit("")))
    return files.groupBy(*OWNER).agg(F.max(low.rlike(POLICY)).alias("has_policy"), F.max(low.rlike(PARTS)).alias("has_parts"), F.max(low.rlike(HISTORY)).alias("has_history"))


def _scored(scores: Column, name: str) -> Column:
    score = scores[name]
    return F.when(score.isNull() | (score < 0), "UNKNOWN").when(score >= LEAST[name], "PASS").otherwise("FAIL")


def checks(versions: DataFrame, signs: DataFrame) -> DataFrame:
    """(…, check, status): eleven rows per version of versions (…, registry_found, has_integrity, scores map<string,double>)."""
    j = versions.join(signs, list(OWNER), "left")
    scores = F.coalesce("scores", F.create_map().cast("map<string,double>"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    policy, scored = flag("has_policy"), _scored(scores, "Security-Policy")
    static, fuzzed = _scored(scores, "SAST"), _scored(scores, "Fuzzing")
    statuses = {
        "PO.4.1": F.when(policy, "PASS").otherwise(scored),
        "PS.1.1": _scored(scores, "Signed-Releases"),
        "PS.2.1": F.when(flag("has_history"), "PASS").otherwise("UNKNOWN"),
        "PS.3.1": F.when(flag("has_parts"), "PASS").otherwise("FAIL"),
        "PW.4.1": _scored(scores, "Maintained"),
        "PW.4.4": F.when(flag("registry_found"), "PASS").otherwise("FAIL"),
        "PW.4.5": F.when(flag("has_integrity"), "PASS").otherwise("UNKNOWN"),
        "PW.7.1": _scored(scores, "Code-Review"),
        "PW.8.1": F.when((static == "PASS") | (fuzzed == "PASS"), "PASS").when((static == "FAIL") & (fuzzed == "FAIL"), "FAIL").otherwise("UNKNOWN"),
        "RV.1.1": _scored(scores, "Vulnerabilities"),
        "RV.2.1": F.when(policy | (scored == "PASS"), "PASS").otherwise("UNKNOWN"),
    }
    rows = F.array(*[F.struct(F.lit(name).alias("check"), status.alias("status")) for name, status in statuses.items()])
    return j.select(*OWNER, F.explode(rows).alias("c")).select(*OWNER, "c.check", "c.status")


def summary(checked: DataFrame) -> DataFrame:
    """(…, passed, failed, unknown, ratio) per version."""
    counts = [F.count_if(F.col("status") == s).alias(n) for s, n in (("PASS", "passed"), ("FAIL", "failed"), ("UNKNOWN", "unknown"))]
    return checked.groupBy(*OWNER).agg(*counts, F.round(F.count_if(F.col("status") == "PASS") / F.count("*"), 3).alias("ratio"))
