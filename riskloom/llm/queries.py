"""Queries of the text operators, by name; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import byte_bpe, credentials, leakage, near_duplicates, provenance, splitting, syntax
from riskloom.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.invalid_files(table(spark, sf_dir, "source_files")).select("file_id")


def p1_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.invalid_files(table(spark, sf_dir, "source_files"))


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.acceptance(table(spark, sf_dir, "source_files"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.non_handwritten(table(spark, sf_dir, "source_files")).select("file_id")


def p2_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.non_handwritten(table(spark, sf_dir, "source_files"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.all_pairs(table(spark, sf_dir, "source_files")).select("file_a", "file_b")


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_groups(table(spark, sf_dir, "source_files"))


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "source_files"), table(spark, sf_dir, "runtime_observations")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.find_credentials(*_records(spark, sf_dir)).select("origin", "record_id", "secret")


def p6_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.find_credentials(*_records(spark, sf_dir))


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.redacted(*_records(spark, sf_dir))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.token_ids(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = splitting.oversized_pieces(table(spark, sf_dir, "documents"))
    return pieces.where("piece = 1").select("doc_id").distinct()


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_texts(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_errors, p1_rates, p2_found, p2_causes, p5_found, p5_groups, p6_found, p6_scored, p6_redacted, p7_ids, p8_found, p8_spans, p9_found, p9_pieces)}


_SHARED_RUNS = r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
e AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
eg AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e))
SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (gram)"""
_ALIKE = """WITH f AS (SELECT DISTINCT ON (file_id) file_id, regexp_extract_all(content, '[A-Za-z0-9_]+') AS w FROM source_files WHERE content IS NOT NULL),
g AS (SELECT DISTINCT file_id, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT file_id, w, unnest(range(1, len(w) - 3)) AS i FROM f)),
n AS (SELECT file_id, count(*) AS n FROM g GROUP BY 1 HAVING count(*) >= 30),
p AS (SELECT a.file_id AS file_a, b.file_id AS file_b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.file_id < b.file_id GROUP BY 1, 2)
SELECT file_a, file_b FROM p JOIN n x ON x.file_id = file_a JOIN n y ON y.file_id = file_b WHERE 10 * c >= 6 * (x.n + y.n - c)"""


def oracle_sql() -> dict[str, str]:
    return {"p5_found": _ALIKE, "p8_found": _SHARED_RUNS}
