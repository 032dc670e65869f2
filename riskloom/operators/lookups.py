"""Exact and approximate joins of package names with advisory and popularity tables.

Approximate names use deletion neighbourhoods: two names within edit distance d share a string that arises from each by
at most d deletions, so the join is an equality join on (ecosystem, shortened name) followed by the exact distance. No
pair is compared that shares none, and none within the distance is missed.

Defined results: names are compared in lower case; null names and ecosystems match nothing; repeated rows of a feed count
once; ties are broken by name; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_advisory(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """Each package name with its newest advisory (greatest `modified`, nulls last, then smallest id)."""
    newest = advisories.groupBy("ecosystem", F.lower("package").alias("_name")).agg(
        F.min_by(
            F.struct("advisory_id", "attack_type", "source", "version_glob", "modified"),
            F.struct(F.col("modified").isNull(), F.expr("transform(split(coalesce(modified, ''), ''), c -> -ascii(c))"), F.col("advisory_id")),
        ).alias("_newest")
    )
    p = packages.withColumn("_name", F.lower("package"))
    return p.join(newest, ["ecosystem", "_name"]).select(*packages.columns, "_newest.*")


def match_versions(releases: DataFrame, advisories: DataFrame) -> DataFrame:
    """Releases with every advisory of their name: `exact` if the advisory is for all versions (`*`, null) or this one,
    else `historical_name_match`."""
    a = advisories.select(
        F.col("ecosystem").alias("_eco"), F.lower("package").alias("_name"), "advisory_id", "attack_type", "version_glob"
    ).distinct()
    joined = releases.join(a, (releases["ecosystem"] == a["_eco"]) & (F.lower(releases["package"]) == a["_name"]))
    exact = F.col("version_glob").isNull() | (F.col("version_glob") == "*") | (F.col("version_glob") == F.col("version"))
    return joined.select(
        *[releases[c] for c in releases.columns], "advisory_id", "attack_type",
        F.when(exact, "exact").otherwise("historical_name_match").alias("match_kind"),
    )


def popularity(packages: DataFrame, popular: DataFrame) -> DataFrame:
    """Packages with the best rank of their name and whether it is popular (5000) or top (1000); null if unranked."""
    best = popular.groupBy("ecosystem", F.lower("package").alias("_name")).agg(F.min("rank").alias("rank"))
    p = packages.withColumn("_name", F.lower("package"))
    j = p.join(best, ["ecosystem", "_name"], "left")
    return j.select(
        *packages.columns, "rank",
        F.coalesce(F.col("rank") <= 5000, F.lit(False)).alias("is_popular"), F.coalesce(F.col("rank") <= 1000, F.lit(False)).alias("is_top"),
    )


def deletions(name: Column, most: int) -> Column:
    """All strings that `name` becomes by at most `most` deletions, itself included."""
    found = F.array(name)
    for _ in range(most):
        found = F.array_distinct(
            F.concat(
                found,
                F.flatten(
                    F.transform(
                        found,
                        lambda s: F.transform(
                            F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))),
                            lambda i: F.concat(F.substring(s, 1, i - 1), F.substring(s, i + 1, F.length(s))),
                        ),
                    )
                ),
            )
        )
    return found


def similar_names(probes: DataFrame, targets: DataFrame, most: int = 2, least_length: int = 3) -> DataFrame:
    """(ecosystem, package, candidate, distance, similarity) of names 1..most edits apart."""
    p = probes.select("ecosystem", F.lower("package").alias("package")).where(F.length("package") >= least_length).distinct()
    t = targets.select("ecosystem", F.lower("package").alias("candidate")).where(F.length("candidate") >= least_length).distinct()
    left = p.select("ecosystem", "package", F.explode(deletions(F.col("package"), most)).alias("_short"))
    right = t.select("ecosystem", "candidate", F.explode(deletions(F.col("candidate"), most)).alias("_short"))
    pairs = left.join(right, ["ecosystem", "_short"]).where("package <> candidate").select("ecosystem", "package", "candidate").distinct()
    distance = F.levenshtein("package", "candidate", most)
    scored = pairs.withColumn("distance", distance).where(F.col("distance").between(1, most))
    similarity = F.round(1 - F.col("distance") / F.greatest(F.length("package"), F.length("candidate")), 3)
    return scored.withColumn("similarity", similarity)


def top_similar(similar: DataFrame, k: int = 5) -> DataFrame:
    order = Window.partitionBy("ecosystem", "package").orderBy(F.desc("similarity"), "candidate")
    return similar.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def closest_name(similar: DataFrame) -> DataFrame:
    """The nearest candidate of each name, alphabetically first of equals."""
    best = similar.groupBy("ecosystem", "package").agg(F.min(F.struct("distance", "candidate")).alias("_best"))
    return best.select("ecosystem", "package", "_best.candidate", "_best.distance")
