"""What runtime alerts show as patterns, and rule drafts made of them that a person approves.

Defined results: an observation without signs has an empty pattern and no draft; an indicator value counts once per
observation; a draft that is no longer a draft is not approved again; null values are left out; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What each type of indicator stands for: dimension, code and the words of a summary.
MEANING = {
    "path": ("INFORMATION_READING", "EXF-001", "credential read"),
    "ip": ("DATA_TRANSMISSION", "NET-001", "external network"),
    "domain": ("DATA_TRANSMISSION", "NET-001", "external network"),
    "exec": ("PAYLOAD_EXECUTION", "EXM-008", "process exec"),
}
SUMMARY = ("credential read", "external network", "process exec")


def signs(indicators: DataFrame, executions: DataFrame) -> DataFrame:
    """(id, type): the types of indicators (id, type, value) of an observation, and `exec` for those that ran something."""
    return indicators.select("id", "type").unionByName(executions.select("id", F.lit("exec").alias("type"))).where(F.col("type").isin(*MEANING)).distinct()


def patterns(found: DataFrame) -> DataFrame:
    """(id, dimensions, codes, summary, is_novel) of signs (id, type). A pattern is novel if it joins two dimensions or more
    without reading credentials, which fixed rules see already."""

    def told(k: int) -> Column:
        out = F.lit(None).cast("string")
        for kind, meaning in MEANING.items():
            out = F.when(F.col("type") == kind, meaning[k]).otherwise(out)
        return out

    g = found.groupBy("id").agg(
        F.array_sort(F.collect_set(told(0))).alias("d"), F.array_sort(F.collect_set(told(1))).alias("c"), F.collect_set(told(2)).alias("s")
    )
    words = F.filter(F.array(*map(F.lit, SUMMARY)), lambda w: F.array_contains("s", w))
    novel = (F.size("d") >= 2) & ~F.array_contains("s", F.lit("credential read"))
    return g.select("id", F.array_join("d", ",").alias("dimensions"), F.array_join("c", ",").alias("codes"), F.array_join(words, " + ").alias("summary"), novel.alias("is_novel"))


def rule_drafts(found: DataFrame) -> DataFrame:
    """(rule, severity, summary, dimensions, observations, status): a draft per kind of pattern, HIGH with two dimensions or
    more, with the number of observations that it rests on."""
    g = found.where("dimensions <> ''").groupBy("dimensions", "codes", "summary").agg(F.count("*").alias("observations"))
    severity = F.when(F.size(F.split("dimensions", ",")) >= 2, "HIGH").otherwise("MEDIUM")
    name = F.concat(F.lit("RT-"), F.substring(F.md5(F.concat_ws("|", "dimensions", "codes")), 1, 8))
    return g.select(name.alias("rule"), severity.alias("severity"), "summary", "dimensions", "observations", F.lit("draft").alias("status"))


def approved(rules: DataFrame, approvals: DataFrame) -> DataFrame:
    """The rules with those of approvals (rule, by) approved, as far as they are drafts; adds approved_by."""
    one = approvals.groupBy(F.col("rule").alias("_rule")).agg(F.min("by").alias("_by"))
    j = rules.join(one, rules["rule"] == F.col("_rule"), "left")
    now = F.col("_by").isNotNull() & (F.col("status") == "draft")
    out = j.withColumn("approved_by", F.when(now, F.col("_by"))).withColumn("status", F.when(now, "approved").otherwise(F.col("status")))
    return out.select(*rules.columns, "approved_by")
