"""Nearest neighbours by cosine similarity of unit vectors.

Exact search in blocks, in one plan: queries and corpus are gathered into blocks of about BLOCK and ROWS vectors, every
block of queries meets every block of the corpus, a task multiplies their matrices and keeps the k best per query, so a
query shuffles k rows per corpus block. Queries run against all rows. Nothing passes through the driver but two counts.

Defined results: null vectors match nothing and are no queries; a vector does not match itself; ties are broken by id;
similarities are rounded before they are ranked; fewer than k rows give what there is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, ROWS = 1024, 8192


def _blocks(df: DataFrame, id_column: str, column: str, size: int, count: int, prefix: str) -> DataFrame:
    """Vectors in blocks by a hash of the id: (block, ids, vectors), a block of about `size` of the `count` vectors."""
    n = max(1, -(-count // size))
    rows = df.select(F.pmod(F.xxhash64(id_column), F.lit(n)).cast("int").alias(f"{prefix}_block"), F.struct(F.col(id_column).cast("bigint").alias("id"), F.col(column).cast("array<double>").alias("v")).alias("e"))
    return rows.groupBy(f"{prefix}_block").agg(F.collect_list("e").alias("e")).select(f"{prefix}_block", F.col("e.id").alias(f"{prefix}_ids"), F.flatten("e.v").alias(f"{prefix}_vectors"))


def nearest(corpus: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", column: str = "embedding", digits: int = 4) -> DataFrame:
    """(query_id, neighbour_id, similarity, place)."""
    rows, asked = corpus.where(F.col(column).isNotNull()), queries.where(F.col(column).isNotNull())
    n, m = rows.count(), asked.count()
    left = _blocks(rows, id_column, column, ROWS, n, "row")
    right = _blocks(asked, id_column, column, BLOCK, m, "query")
    numbers = F.sequence(F.lit(0), F.lit(max(1, -(-m // BLOCK)) - 1))
    pairs = left.withColumn("query_block", F.explode(numbers)).join(right, "query_block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x, ids_q, q in zip(*(batch.column(c) for c in range(4))):
                ids, ids_q = (np.asarray(c.values, np.int64) for c in (ids, ids_q))
                x, q = (np.asarray(c.values, np.float64).reshape(len(i), -1) for c, i in ((x, ids), (q, ids_q)))
                scores = np.round(q @ x.T, digits)
                scores[ids_q[:, None] == ids[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
                best = np.take_along_axis(scores, order, axis=1)
                keep = np.isfinite(best)
                columns = (np.repeat(ids_q, keep.sum(axis=1)), ids[order][keep], best[keep])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "neighbour_id", "similarity"])

    found = pairs.select("row_ids", "row_vectors", "query_ids", "query_vectors").mapInArrow(run, "query_id bigint, neighbour_id bigint, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbour_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
