"""Exactly-once view of an at-least-once queue.

Pass 1 reads the identifying columns only and shuffles, per row, a 16-byte identifier, the delivery order and the row's
position (file hash, row number in the file). A group's minimum is combined map-side, so a message that makes up a third
of the queue costs one row per map task. The winners' positions become one bitmap per 32,768 rows of a file.
Pass 2 reads the wide rows in place, without a shuffle: a row whose bit is not set in its file's vector is a repeat.

Defined results: null key parts equal each other and nothing else; a null enqueued_at sorts after every time; ties are
broken by id, then by position, so rows that repeat an id also leave one copy; an empty queue gives an empty result;
extra columns are carried along whatever they are called, as the operator's own columns live in one struct whose name
is chosen to be free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.runtime import BROADCAST_BYTES, cut

#: Rows covered by one bitmap; the fixed capacity of Spark's bitmap aggregate (4,096 bytes).
BUCKET = 32768
BITMAP_BYTES = 4096
BLANKS = " \t\r\n\x0b\x0c"


def canonical_package(ecosystem: Column, package: Column) -> Column:
    """Package name as its registry compares it: PyPI folds case and runs of `-_.`, the others are exact."""
    name = F.trim(package, F.lit(BLANKS))
    folded = F.lower(F.regexp_replace(name, r"[-_.]+", "-"))
    return F.when(F.lower(F.trim(ecosystem)) == "pypi", folded).otherwise(name)


def message_parts(df: DataFrame) -> list[Column]:
    return [
        df["ecosystem"],
        canonical_package(df["ecosystem"], df["package"]),
        F.trim(df["version"], F.lit(BLANKS)),
        df["source_event"],
    ]


def identifier(parts: list[Column]) -> Column:
    """16 bytes that stand for the parts; the length prefixes keep the encoding injective."""
    one = [F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.unhex(F.md5(F.concat(*one)))


def _free_name(df: DataFrame, stem: str) -> str:
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def winner_vectors(df: DataFrame, parts: list[Column], order: list[Column]) -> DataFrame:
    """(file bigint, bucket bigint, bits binary): positions of each message's first delivery."""
    meta = df.metadataColumn("_metadata")
    narrow = df.select(
        identifier(parts).alias("message"),
        F.struct(
            *[c.alias(f"by{k}{part}") for k, o in enumerate(order) for part, c in (("a", o.isNull()), ("b", o))],
            F.xxhash64(meta["file_path"]).alias("file"),
            meta["row_index"].alias("row"),
        ).alias("place"),
    )
    first = narrow.groupBy("message").agg(F.min("place").alias("place"))
    return (
        first.select("place.file", "place.row")
        .groupBy("file", F.floor(F.col("row") / BUCKET).alias("bucket"))
        .agg(F.bitmap_construct_agg((F.col("row") % BUCKET)).alias("bits"))
    )


def split_deliveries(df: DataFrame, parts: list[Column], order: list[Column], kept: bool) -> DataFrame:
    """Rows of the Parquet-backed `df` that are the first delivery of their message (kept) or repeats (not kept)."""
    vectors = cut(winner_vectors(df, parts, order))
    size = vectors.count() * BITMAP_BYTES
    meta = df.metadataColumn("_metadata")
    own = _free_name(df, "_place")
    placed = df.withColumn(
        own,
        F.struct(
            F.xxhash64(meta["file_path"]).alias("file"),
            F.floor(meta["row_index"] / BUCKET).alias("bucket"),
            (meta["row_index"] % BUCKET).cast("int").alias("bit"),
        ),
    )
    keys = _free_name(df, "_vector")
    vectors = vectors.select(F.struct("file", "bucket", "bits").alias(keys))
    if size <= BROADCAST_BYTES:
        vectors = F.broadcast(vectors)
    joined = placed.join(
        vectors,
        (placed[own]["file"] == vectors[keys]["file"]) & (placed[own]["bucket"] == vectors[keys]["bucket"]),
        "left",
    )
    bits, bit = joined[keys]["bits"], joined[own]["bit"]
    byte = F.conv(F.hex(F.substring(bits, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    is_first = F.coalesce(F.getbit(byte, bit % 8) == 1, F.lit(False))
    return joined.where(is_first if kept else ~is_first).select(*[placed[f"`{c}`"] for c in df.columns])


def kept_messages(queue: DataFrame) -> DataFrame:
    """The queue with one row per message, all columns."""
    return split_deliveries(queue, message_parts(queue), [queue["enqueued_at"], queue["id"]], kept=True)


def repeated_messages(queue: DataFrame) -> DataFrame:
    """The queue's rows that repeat a message kept elsewhere, all columns."""
    return split_deliveries(queue, message_parts(queue), [queue["enqueued_at"], queue["id"]], kept=False)
