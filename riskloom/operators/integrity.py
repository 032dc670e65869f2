"""Hashes that tie results to their inputs: keyed row digests and Merkle roots.

Defined results: the root of no leaves is the empty string, of one leaf the leaf; an odd node moves up unchanged; null
values are written as JSON nulls before a row is signed.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC-SHA-256 of a string, with built-in functions."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    digest = F.unhex(F.sha2(F.concat(F.lit(inner), F.to_binary(message, F.lit("utf-8"))), 256))
    return F.sha2(F.concat(F.lit(outer), digest), 256)


def signed(df: DataFrame, columns: Sequence[str], key: bytes, name: str = "row_hmac") -> DataFrame:
    """`df` with a digest over the JSON of its columns in order of their names."""
    message = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return df.withColumn(name, hmac_sha256(key, message))


def merkle_root(leaves: Sequence[str]) -> str:
    import hashlib

    level = list(leaves)
    while len(level) > 1:
        level = [
            hashlib.sha256((level[i] + level[i + 1]).encode()).hexdigest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)
        ]
    return level[0] if level else ""


def merkle_roots(files: DataFrame, key: Sequence[str], path: str, content: str) -> DataFrame:
    """(key, leaves, root): the Merkle root over each group's file hashes in order of path. Contents are hashed before
    the shuffle; a group carries one hash per file."""
    hashed = files.select(*key, F.coalesce(path, F.lit("")).alias("path"), F.sha2(F.coalesce(content, F.lit("")), 256).alias("h")).distinct()
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("path", "h"))), lambda x: x["h"])
    grouped = hashed.groupBy(*key).agg(ordered.alias("hashes"))

    @F.pandas_udf("string")
    def root(hashes: pd.Series) -> pd.Series:
        return hashes.map(lambda h: merkle_root(list(h)))

    return grouped.select(*key, F.size("hashes").alias("leaves"), root("hashes").alias("root"))


#: Modes of integrity from weak to strong.
MODES = ("fast", "strict", "paranoid")


def fingerprint_matches(pairs: DataFrame, cached: str = "cached", fresh: str = "fresh") -> DataFrame:
    """Adds match (boolean) and reason to pairs of fingerprints, structs (mode, etag, content_length, archive_sha256,
    merkle_root). A cached fingerprint of a weaker mode than the fresh one does not count; a stronger one is compared as far
    as the fresh mode goes. Missing values never match."""
    c, f = F.col(cached), F.col(fresh)

    def rank(mode: Column) -> Column:
        return F.coalesce(F.array_position(F.array(*map(F.lit, MODES)), mode).cast("int"), F.lit(1))

    def same(name: str) -> Column:
        return F.coalesce(c[name] == f[name], F.lit(False))

    reason = (
        F.when(rank(c["mode"]) < rank(f["mode"]), "weaker mode")
        .when(f["mode"] == "fast", F.when(same("etag") & (c["etag"] != "") & c["content_length"].eqNullSafe(f["content_length"]), "match").otherwise("headers differ"))
        .when(c["archive_sha256"].isNull() | f["archive_sha256"].isNull(), "no archive hash")
        .when(~same("archive_sha256"), "archive differs")
        .when((f["mode"] == "paranoid") & (c["merkle_root"].isNull() | f["merkle_root"].isNull()), "no root")
        .when((f["mode"] == "paranoid") & ~same("merkle_root"), "root differs")
        .otherwise("match")
    )
    return pairs.withColumn("reason", reason).withColumn("match", F.col("reason") == "match")


def verified(rows: DataFrame, columns: Sequence[str], key: bytes, signature: str = "row_hmac") -> DataFrame:
    """Adds intact: whether a row's digest is the one that `signed` gives its columns; a null digest is not."""
    again = signed(rows.withColumnRenamed(signature, "_given"), columns, key, signature)
    return again.withColumn("intact", F.coalesce(F.col(signature) == F.col("_given"), F.lit(False))).drop(signature).withColumnRenamed("_given", signature)
