"""Deterministic reviews and summaries of what was found in a file or a package.

Defined results: files without calls are benign and have an empty sentence; null similarities count as 0; null paths are
no install hooks; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.catalogs import INSTALL_HOOKS

#: What a verdict is called towards users, and the positive verdicts that are passed on.
LEVELS = {"MALICIOUS": "danger", "HIGH_RISK": "danger", "SUSPICIOUS": "warning", "AGENTIC": "notice", "CLEAN": "safe", "CANNOT_ANALYZE": "unknown", "ERROR": "unknown"}
EMITTED = ("MALICIOUS", "HIGH_RISK", "SUSPICIOUS")
#: What each dimension is called in a sentence.
PHRASES = {"I": "reading system information", "E": "encoding or decoding data", "X": "executing a payload", "T": "transmitting data"}


def _has(letters: Column, wanted: str) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), letters)) == 0


def is_install_hook(path: Column) -> Column:
    low, out = F.lower(F.coalesce(path, F.lit(""))), F.lit(False)
    for word in INSTALL_HOOKS:
        out = out | F.contains(low, F.lit(word))
    return out


def file_reviews(calls: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, dimensions, review): information read, encoded and sent is suspicious, and malicious in an install hook; a
    payload fetched and run in an install hook is suspicious."""
    sets = calls.groupBy("file_id").agg(F.array_sort(F.collect_set("dimension")).alias("d"))
    j = files.select("file_id", "path").dropDuplicates(["file_id"]).join(sets, "file_id")
    hook, theft, remote = is_install_hook(F.col("path")), _has(F.col("d"), "IET"), _has(F.col("d"), "TX")
    review = F.when(theft & hook, "malicious").when(theft | remote & hook, "suspicious").otherwise("benign")
    return j.select("file_id", F.array_join("d", "").alias("dimensions"), review.alias("review"))


def sentences(calls: DataFrame, order: list[str]) -> DataFrame:
    """(file_id, sentence): the dimensions of a file's calls as they first occur, and the chain of its calls."""
    listed = F.array_sort(F.collect_list(F.struct(*order, "name", "dimension")))
    g = calls.groupBy("file_id").agg(listed.alias("c"))
    phrases = F.create_map(*[F.lit(x) for pair in PHRASES.items() for x in pair])
    kinds = F.transform(F.array_distinct(F.col("c.dimension")), lambda d: phrases[d])
    text = F.concat(F.lit("performs: "), F.array_join(kinds, ", "), F.lit(". Call chain: "), F.array_join("c.name", " -> "))
    return g.select("file_id", text.alias("sentence"))


def match_confidence(similarity: Column, review: Column) -> Column:
    """A match's similarity, raised or lowered by its review, between 0 and 1."""
    base = F.coalesce(similarity, F.lit(0.0))
    moved = F.when(review == "malicious", base + 0.10).when(review == "suspicious", base + 0.05).otherwise(base - 0.05)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved)), 6)


def level_of(verdict: Column) -> Column:
    out = F.lit("unknown")
    for name, level in LEVELS.items():
        out = F.when(verdict == name, level).otherwise(out)
    return out


def emitted(verdicts: DataFrame) -> DataFrame:
    """The verdicts that are passed on to others, with their level."""
    return verdicts.where(F.col("verdict").isin(*EMITTED)).withColumn("level", level_of(F.col("verdict")))


def top_evidence(evidence: DataFrame, key: str, k: int = 3) -> DataFrame:
    """The k most confident evidence rows of each subject, ties by code, numbered from 1."""
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last("confidence"), "code")
    return evidence.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def concentration(best: DataFrame, id_column: str, owners: DataFrame, owner: str) -> DataFrame:
    """(owner, texts, texts_with_high, most_high, spread) from the best hits of each text: how the HIGH hits of an owner are
    spread over its texts."""
    per = best.groupBy(id_column).agg(F.count_if(F.col("severity") == "HIGH").alias("high"), F.count("*").alias("n"))
    j = per.join(owners.select(id_column, owner), id_column)
    g = j.groupBy(owner).agg(F.count("*").alias("texts"), F.count_if(F.col("high") > 0).alias("texts_with_high"), F.max("high").alias("most_high"))
    return g.select("*", F.round(F.col("texts_with_high") / F.col("texts"), 6).alias("spread"))


def anomalies_of_category(calls: DataFrame, owners: DataFrame, rules: dict[str, tuple[str, str, tuple[str, ...]]], text: str) -> DataFrame:
    """(file_id, category, names, dimensions) of files whose calls are out of place in their package's category: calls that
    the category rules out, and dimensions beyond those it allows. rules: category -> (pattern, allowed letters, names);
    the first category whose pattern matches the owner's `text` counts."""
    low, category = F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(None).cast("string")
    for name, (pattern, _, _) in reversed(rules.items()):
        category = F.when(low.rlike(pattern), name).otherwise(category)
    placed = owners.select("file_id", category.alias("category")).where("category IS NOT NULL").dropDuplicates(["file_id"])
    banned = beyond = F.lit(False)
    for name, (_, allowed, names) in rules.items():
        own = F.col("category") == name
        banned = banned | own & F.col("name").isin(*names)
        others = [c for c in "TXE" if c not in allowed]
        beyond = beyond | own & F.col("dimension").isin(*others)
    j = calls.select("file_id", "name", "dimension").join(placed, "file_id")
    g = j.groupBy("file_id", "category").agg(
        F.array_sort(F.collect_set(F.when(banned, F.col("name")))).alias("n"), F.array_sort(F.collect_set(F.when(beyond, F.col("dimension")))).alias("d")
    )
    return g.where((F.size("n") > 0) | (F.size("d") > 0)).select("file_id", "category", F.array_join("n", ",").alias("names"), F.array_join("d", "").alias("dimensions"))
