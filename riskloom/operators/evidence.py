"""Evidence rows, their verdict per subject, votes, and metrics of verdicts against labels.

Defined results: a subject without evidence is CLEAN; null confidences do not count in averages; an empty label table
gives no metrics rows but the total; ratios with an empty denominator are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POSITIVE = ("MALICIOUS", "HIGH_RISK", "SUSPICIOUS")


def verdicts(subjects: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """(key, evidence_count, avg_confidence, verdict) from evidence (key, severity, review, confidence, similarity)."""
    doubtful = F.col("review").isin("suspicious", "malicious")
    e = evidence.groupBy(key).agg(
        F.count("*").alias("evidence_count"),
        F.round(F.avg("confidence"), 6).alias("avg_confidence"),
        F.max(F.col("severity") == "HIGH").alias("any_high"),
        F.max(F.col("review") == "malicious").alias("any_malicious"),
        F.max((F.col("similarity") >= 0.85) & (F.col("review") != "benign") & (F.col("severity") != "LOW")).alias("close"),
        F.max((F.col("similarity") >= 0.70) & (F.col("review") != "benign")).alias("near"),
        F.count_if(doubtful & (F.col("confidence") >= 0.5)).alias("doubts"),
    )
    j = subjects.select(key).distinct().join(e, key, "left")
    no = F.lit(False)
    verdict = (
        F.when(F.col("evidence_count").isNull(), "CLEAN")
        .when(F.coalesce("any_high", no) & F.coalesce("any_malicious", no) & (F.col("avg_confidence") >= 0.85), "MALICIOUS")
        .when(F.coalesce("close", no) & (F.col("doubts") >= 1), "HIGH_RISK")
        .when(F.coalesce("near", no) | (F.col("doubts") >= 2), "SUSPICIOUS")
        .otherwise("CLEAN")
    )
    return j.select(key, F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"), "avg_confidence", verdict.alias("verdict"))


def consensus(votes: DataFrame, key: str) -> DataFrame:
    """(key, malicious, suspicious, benign, verdict, agreement) of votes (key, vote)."""
    g = votes.groupBy(key).agg(*[F.count_if(F.col("vote") == v).alias(v) for v in ("malicious", "suspicious", "benign")])
    m, s, b = F.col("malicious"), F.col("suspicious"), F.col("benign")
    verdict = F.when((m >= 2) | (m >= 1) & (s >= 1), "malicious").when((m + s >= 2) | (m >= 1), "suspicious").otherwise("benign")
    return g.select("*", verdict.alias("verdict"), F.round(F.greatest(m, s, b) / (m + s + b), 3).alias("agreement"))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of the Wilson interval; 0 and 0 where n is 0."""
    p, zz = successes / n, z * z
    centre = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt((p * (1 - p) + zz / (4 * n)) / n) / (1 + zz / n)
    low = F.when(n == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), centre - half), 6))
    return low, F.when(n == 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), centre + half), 6))


def confusion(results: DataFrame, by: str) -> DataFrame:
    """Counts, precision, recall, F1, accuracy and the interval of recall per group and in total (null group), from
    results (by, predicted boolean, expected boolean)."""
    p, e = F.col("predicted"), F.col("expected")
    g = results.rollup(by).agg(
        F.count_if(p & e).alias("tp"), F.count_if(p & ~e).alias("fp"), F.count_if(~p & e).alias("fn"), F.count_if(~p & ~e).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(F.round(a / b, 6))
    low, high = wilson(tp, tp + fn)
    return g.select(
        by, "tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        low.alias("recall_low"), high.alias("recall_high"),
    )


def top_codes(hits: DataFrame, group: str, code: str, k: int = 10) -> DataFrame:
    """The k most frequent codes of each group, ties by code."""
    counts = hits.groupBy(group, code).agg(F.count("*").alias("n"))
    order = Window.partitionBy(group).orderBy(F.desc("n"), code)
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def stratified(rows: DataFrame, stratum: str, key: str, sizes: dict[str, int]) -> DataFrame:
    """A sample of fixed size per stratum, in an order fixed by a hash of the key."""
    order = Window.partitionBy(stratum).orderBy(F.md5(F.col(key).cast("string")), key)
    most = F.lit(0)
    for name, n in sizes.items():
        most = F.when(F.col(stratum) == name, n).otherwise(most)
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
