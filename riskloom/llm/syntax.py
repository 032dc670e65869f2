"""Source files that do not parse, with all errors, their first cause and the acceptance per package and language.

Each file goes through the recursive-descent grammar of its language (riskloom.llm.grammar) on the executors, one pass,
no shuffle; only the rates aggregate, by (ecosystem, package, language), combined map-side. Rows that repeat a file_id
are told apart only in the small result, so contents are never shuffled.

The grammars alone decide. Validity is that of the grammar: rules on names, such as equal parameters of a function, are not
looked at.

Defined results: language is compared without regard to case and blanks; other languages, null languages and null
contents are never cases; an empty python, javascript, toml or cfg file is valid, an empty json file is not; contents of
any length and depth are parsed whole (Python's own limit of 200 open brackets is an error of the file); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("python", "javascript", "json", "toml", "cfg")
#: Errors that a batch of results is closed at; a file stays whole.
BATCH_ERRORS = 50_000
ERROR_SCHEMA = "file_id bigint, errors array<struct<line: int, message: string>>, error_count int"


def grammars() -> dict[str, Callable[[str], list[tuple[int, str]]]]:
    from riskloom.llm.grammar import data, javascript, python

    return {
        "python": python.check,
        "javascript": javascript.check,
        "json": data.json_errors,
        "toml": data.toml_errors,
        "cfg": data.ini_errors,
    }


def language_key(df: DataFrame):
    return F.lower(F.trim(df["language"], F.lit(" \t\r\n")))


def syntax_errors(files: DataFrame, id_column: str = "file_id") -> DataFrame:
    """(file_id, errors, error_count) of each row whose content is invalid in its language; all errors are listed, and
    error_count counts them. The first is the first cause."""
    judged = files.select(
        files[id_column].cast("bigint"), language_key(files).alias("language"), files["content"]
    ).where(F.col("language").isin(*LANGUAGES) & F.col("content").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        check = grammars()
        kinds = [
            pa.int64(),
            pa.list_(pa.struct([("line", pa.int32()), ("message", pa.string())])),
            pa.int32(),
        ]

        def written(out: list[tuple]) -> pa.RecordBatch:
            parts = zip(*out) if out else [[]] * 3
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(parts, kinds)], names=["file_id", "errors", "error_count"]
            )

        for batch in batches:
            out, held = [], 0
            for start in range(0, batch.num_rows, 256):
                rows = zip(*(c.slice(start, 256).to_pylist() for c in (batch.column(k) for k in range(3))))
                for key, language, content in rows:
                    errors = check[language](content)
                    if errors:
                        out.append((key, [{"line": a, "message": b} for a, b in errors], len(errors)))
                        held += len(errors)
                        if held >= BATCH_ERRORS:
                            yield written(out)
                            out, held = [], 0
            yield written(out)

    return judged.mapInArrow(run, ERROR_SCHEMA)


def invalid_files(files: DataFrame) -> DataFrame:
    """(file_id, first_line, first_message, error_count, errors), one row per invalid file."""
    found = syntax_errors(files).dropDuplicates(["file_id"])
    return found.select(
        "file_id",
        F.col("errors")[0]["line"].alias("first_line"),
        F.col("errors")[0]["message"].alias("first_message"),
        "error_count",
        "errors",
    )


def acceptance(files: DataFrame, by: tuple[str, ...] = ("ecosystem", "package")) -> DataFrame:
    """Files, invalid files and acceptance rate per package and language. Rows that repeat a file_id count once."""
    bad = syntax_errors(files).select(F.col("file_id").alias("_bad")).distinct()
    rows = (
        files.where(files["content"].isNotNull())
        .select(*by, language_key(files).alias("language"), files["file_id"].cast("bigint").alias("file_id"))
        .where(F.col("language").isin(*LANGUAGES))
        .dropDuplicates(["file_id"])
    )
    joined = rows.join(bad, F.col("file_id") == F.col("_bad"), "left")
    return joined.groupBy(*by, "language").agg(
        F.count("*").alias("files"),
        F.count("_bad").alias("invalid"),
        F.round(1 - F.count("_bad") / F.count("*"), 6).alias("accepted"),
    )
