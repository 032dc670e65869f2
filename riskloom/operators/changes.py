"""What changed between versions, between result sets and over a log of states.

Defined results: a first version has no predecessor and gives no changes; null names are no calls; ties in a log are
settled by the state's name; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.versions import predecessors

OWNER = ("ecosystem", "package", "version")


def new_calls(calls: DataFrame) -> DataFrame:
    """(…, before_1, name, dimension) of calls (ecosystem, package, version, name, dimension) that the version before
    lacks."""
    have = calls.select(*OWNER, "name", "dimension").where("name IS NOT NULL").distinct()
    pairs = predecessors(have.select(*OWNER), (1,)).where("before_1 IS NOT NULL")
    now = pairs.join(have, list(OWNER))
    then = have.select("ecosystem", "package", F.col("version").alias("before_1"), "name")
    return now.join(then, ["ecosystem", "package", "before_1", "name"], "left_anti").select(*OWNER, "before_1", "name", "dimension")


def change_severity(new: DataFrame) -> DataFrame:
    """(…, dimensions, severity): HIGH where the new calls combine transmission or execution with another dimension or
    reading with transmission, MEDIUM for execution or transmission alone, else LOW."""
    g = new.groupBy(*OWNER).agg(F.array_join(F.array_sort(F.collect_set("dimension")), "").alias("dimensions"))
    d = F.col("dimensions")
    has = lambda *letters: sum((F.contains(d, F.lit(x)).cast("int") for x in letters), F.lit(0)) == len(letters)
    high = has("T", "E") | has("X", "E") | has("X", "T") | has("I", "T")
    return g.withColumn("severity", F.when(high, "HIGH").when(has("X") | has("T"), "MEDIUM").otherwise("LOW"))


def compared(old: DataFrame, new: DataFrame, key: list[str], good: Column, value: str) -> DataFrame:
    """(outcome, n): how a result changed for the keys both sets have. good: whether a value (column `value`) is right."""
    o = old.select(*key, F.col(value).alias("value_")).withColumnRenamed("value_", value).withColumn("was", good).drop(value)
    n = new.select(*key, value).withColumn("is", good).drop(value)
    outcome = F.when(F.col("was") == F.col("is"), "same").when(F.col("is"), "improved").otherwise("degraded")
    return o.join(n, key).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def current_state(log: DataFrame, key: str, at: str, state: str) -> DataFrame:
    """(key, state, since) after the last entry of each key."""
    last = log.where(F.col(at).isNotNull()).groupBy(key).agg(F.max(F.struct(at, state)).alias("l"))
    return last.select(key, F.col(f"l.{state}").alias("state"), F.col(f"l.{at}").alias("since"))


def newest(rows: DataFrame, by: list[str], at: Column, tie: str, k: int) -> DataFrame:
    """The k newest rows of each group."""
    order = Window.partitionBy(*by).orderBy(at.desc_nulls_last(), F.desc(tie))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def validity(cache: DataFrame, log: DataFrame, key: list[str], made: str, invalidated: str, checks: list[tuple[str, Column]]) -> DataFrame:
    """`cache` with the first reason why a row no longer holds, null if it does: the checks in order, then the log."""
    latest = log.groupBy(*key).agg(F.max(invalidated).alias("_last"))
    reason = F.when(F.col("_last") > F.col(made), "invalidated")
    for name, failed in reversed(checks):
        reason = F.when(failed, name).otherwise(reason)
    return cache.join(latest, key, "left").withColumn("reason", reason).drop("_last")


def priority(rank: Column, has_advisory: Column) -> Column:
    """Place in the queue by popularity, sooner with an advisory; 0 at least."""
    base = F.when(rank <= 10, 10).when(rank <= 100, 30).when(rank <= 1000, 60).when(rank <= 5000, 90).otherwise(200)
    return F.greatest(F.lit(0), base - F.when(has_advisory, 50).otherwise(0))
