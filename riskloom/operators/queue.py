"""A work queue as states of rows: claiming, outcomes, recovery of stuck work, purging.

A queue is a table (id, priority, enqueued_at, locked_at, locked_by, completed_at, result, ...); each step gives the table
after it, to be written as the next version, so a repeated step gives the same result.

Defined results: ties in claiming are settled by id; null priorities come last; outcomes of unknown ids and a second
outcome of an id are ignored (the greatest by name counts); an empty queue stays empty; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of an error that are kept with its row.
ERROR_CHARS = 200


def claimable(queue: DataFrame, worker: str, most: int) -> DataFrame:
    """The next `most` rows for a worker: what it has claimed and not finished comes first, then the best pending ones."""
    open_ = queue.where(F.col("completed_at").isNull())
    own = F.col("locked_by").eqNullSafe(F.lit(worker)) & F.col("locked_at").isNotNull()
    ranked = open_.where(own | F.col("locked_at").isNull()).withColumn("_own", F.when(own, 0).otherwise(1))
    return ranked.orderBy("_own", F.asc_nulls_last("priority"), "enqueued_at", "id").limit(most).drop("_own")


def claimed(queue: DataFrame, worker: str, most: int, now: Column) -> DataFrame:
    """The queue after the worker has claimed its next rows. The ids claimed are at most `most`."""
    ids = claimable(queue, worker, most).select(F.col("id").alias("_id"), F.lit(True).alias("_taken"))
    j = queue.join(F.broadcast(ids), queue["id"] == F.col("_id"), "left")
    taken = F.coalesce("_taken", F.lit(False)) & F.col("locked_at").isNull()
    out = j.withColumn("locked_by", F.when(taken, F.lit(worker)).otherwise(F.col("locked_by")))
    return out.withColumn("locked_at", F.when(taken, now).otherwise(F.col("locked_at"))).select(*queue.columns)


def settled(queue: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """The queue after outcomes (id, outcome, error): `ok` completes, `retry` frees the row for another worker, `error` gives
    it up for good."""
    one = outcomes.groupBy(F.col("id").alias("_id")).agg(F.max(F.struct("outcome", "error")).alias("_o"))
    j = queue.join(one, queue["id"] == F.col("_id"), "left")
    kind, error = F.col("_o.outcome"), F.substring(F.coalesce("_o.error", F.lit("")), 1, ERROR_CHARS)
    done = kind.isin("ok", "error")
    result = F.when(kind == "ok", "OK").when(kind == "retry", F.concat(F.lit("RETRY:"), error)).when(kind == "error", F.concat(F.lit("ERR:"), error))
    columns = {
        "completed_at": F.when(done, now).otherwise(F.col("completed_at")),
        "locked_at": F.when(kind == "retry", F.lit(None)).otherwise(F.col("locked_at")),
        "locked_by": F.when(kind == "retry", F.lit(None)).otherwise(F.col("locked_by")),
        "result": F.coalesce(result, "result"),
    }
    return j.withColumns(columns).select(*queue.columns)


def freed(queue: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """The queue after locks older than `minutes` have been taken from workers that did not finish."""
    stuck = F.col("locked_at").isNotNull() & F.col("completed_at").isNull() & (F.col("locked_at") < now - F.expr(f"INTERVAL {int(minutes)} MINUTES"))
    stuck = F.coalesce(stuck, F.lit(False))
    none = F.lit(None)
    return queue.withColumns({
        "result": F.when(stuck, F.lit("RESET:stuck-worker")).otherwise(F.col("result")),
        "locked_by": F.when(stuck, none).otherwise(F.col("locked_by")), "locked_at": F.when(stuck, none).otherwise(F.col("locked_at")),
    }).select(*queue.columns)


def purged(queue: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """The queue without rows completed more than `days` ago."""
    old = F.col("completed_at") < now - F.expr(f"INTERVAL {int(days)} DAYS")
    return queue.where(~F.coalesce(old, F.lit(False)))


def work(queue: DataFrame, worker: str, most: int, now: Column, assess) -> tuple[DataFrame, DataFrame]:
    """(queue afterwards, results) of one round of a worker: assess(jobs) gives (id, outcome, error, ...) of its jobs."""
    results = assess(claimable(queue, worker, most))
    return settled(claimed(queue, worker, most, now), results.select("id", "outcome", "error"), now), results
