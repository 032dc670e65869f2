"""Keyed tables without in-place updates: latest-wins merges, guarded deletes, derived invalidations, digests.

Defined results: null keys equal each other; of rows that repeat a key in the same input the greatest `order` wins and a
further tie is settled by the whole row; empty inputs leave the other side as it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_wins(old: DataFrame, new: DataFrame, key: Sequence[str], order: Column, keep_old: Sequence[str] = ()) -> DataFrame:
    """`old` with the rows of `new` inserted or replaced by key; columns in keep_old keep their first known value."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*key, "_new")]
    ranked = both.withColumn("_order", order)
    window = Window.partitionBy(*key)
    newest = Window.partitionBy(*key).orderBy(F.desc("_new"), F.desc_nulls_last("_order"), *[F.asc_nulls_last(c) for c in sorted(rest) if not _nested(both, c)])
    for c in keep_old:
        ranked = ranked.withColumn(c, F.coalesce(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_new"))).over(window), F.col(c)))
    return ranked.withColumn("_place", F.row_number().over(newest)).where("_place = 1").drop("_place", "_order", "_new")


def _nested(df: DataFrame, column: str) -> bool:
    return not df.schema[column].dataType.simpleString().startswith(("string", "int", "bigint", "double", "boolean", "timestamp", "date"))


def unseen(incoming: DataFrame, known: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of `incoming` whose key is not in `known`: skip-unchanged probes and insert-ignore."""
    k = known.select(*[F.col(c).alias(f"_{c}") for c in key]).distinct()
    condition = None
    for c in key:
        one = incoming[c].eqNullSafe(k[f"_{c}"])
        condition = one if condition is None else condition & one
    return incoming.join(k, condition, "left_anti")


def found_in(asked: DataFrame, known: DataFrame, key: Sequence[str], flag: str) -> DataFrame:
    """The rows of `asked` with a flag that tells whether `known` has their key; null keys equal each other."""
    k = known.select(*[F.col(c).alias(f"_{c}") for c in key]).distinct().withColumn("_found", F.lit(True))
    condition = None
    for c in key:
        one = asked[c].eqNullSafe(k[f"_{c}"])
        condition = one if condition is None else condition & one
    return asked.join(k, condition, "left").select(*asked.columns, F.coalesce("_found", F.lit(False)).alias(flag))


def appended(log: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """A log with the rows whose key it has not yet, so that appending them twice changes nothing."""
    return log.unionByName(unseen(rows, log, key).dropDuplicates(list(key)))


def stage_version(parts: Sequence[Column]) -> Column:
    """The version of a stage's result: a digest of all that it depends on (rules, code, feeds)."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def delete_matching(df: DataFrame, **values: object) -> DataFrame:
    """`df` without the rows that match all given columns; at least one is needed."""
    if not values:
        raise ValueError("at least one column is needed")
    condition = F.lit(True)
    for column, value in values.items():
        condition = condition & F.col(column).eqNullSafe(F.lit(value))
    return df.where(~condition)


def invalidations(old: DataFrame, new: DataFrame, key: Sequence[str], now: Column) -> DataFrame:
    """(ecosystem, package, invalidated_at, reason) for advisories that `new` adds to `old`."""
    added = unseen(new, old, key).select("ecosystem", "package", "advisory_id").distinct()
    return added.select("ecosystem", "package", now.alias("invalidated_at"), F.concat(F.lit("new advisory: "), "advisory_id").alias("reason"))


def still_valid(cache: DataFrame, log: DataFrame, key: Sequence[str], made: str, invalidated: str) -> DataFrame:
    """Cache rows that no later invalidation of their key concerns."""
    latest = log.groupBy(*key).agg(F.max(invalidated).alias("_last"))
    return cache.join(latest, list(key), "left").where(F.col("_last").isNull() | (F.col("_last") <= F.col(made))).drop("_last").select(*cache.columns)


def digest(df: DataFrame, parts: Sequence[str], length: int = 16) -> DataFrame:
    """One row: the start of the SHA-256 of the sorted `a=b` lines of a small table."""
    line = F.concat_ws("=", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    lines = F.array_sort(F.collect_list(line))
    return df.agg(F.substring(F.sha2(F.array_join(lines, "|"), 256), 1, length).alias("digest"))


def table_digest(df: DataFrame, parts: Sequence[str], length: int = 16) -> DataFrame:
    """One row that stands for a table of any size, whatever its order: lines are hashed one by one and summed, so tasks hand
    on two numbers each; repeated lines count."""
    line = F.concat_ws("=", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    number = F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("decimal(20,0)")
    total = F.concat_ws(":", F.count("*").cast("string"), F.coalesce(F.sum(number), F.lit(0)).cast("string"))
    return df.agg(F.substring(F.sha2(total, 256), 1, length).alias("digest"))


def counts_by(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(part, value, n): rows per value of each column by itself, and of the whole table, in one pass."""
    tagged = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).cast("string").alias("value")) for c in columns], F.struct(F.lit("all").alias("part"), F.lit(None).cast("string").alias("value")))).alias("p"))
    return tagged.groupBy("p.part", "p.value").agg(F.count("*").alias("n"))


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out
