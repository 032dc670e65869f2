"""Files that nobody wrote by hand: generated, minified, vendored, or data saved as code.

Two operators judge a file. layout_verdicts goes by layout alone: longest and mean line, share of white space, of letters
and digits, of identifiers, density of numeric literals, and characters in long encoded runs, with limits per language; it
tells minified scripts and data. marked goes by what layout cannot show: paths, lock files, opening comments and bundler
frames; it tells generated and vendored files, which are laid out as hand-written ones are. Both are built-in functions in
one scan, without a shuffle.

Defined results: a null content is judged by its path alone and has null statistics; an empty content is hand-written
unless its path says otherwise; whole contents are measured, however long; repeated rows of a file_id count once in
non_handwritten; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Limits of one language; a share is of all characters."""

    minified_mean_line: int | None  # mean length of the lines that are not blank; None: never minified
    minified_longest_line: int
    minified_blank_share: float  # at most
    minified_alnum_share: float  # at least, and
    minified_identifier_share: float  # at least, so that bytes saved as code are not taken for it
    data_identifier_share: float  # at most, outside strings; below 0: only encoded runs count
    data_number_density: float  # numeric literals among numeric literals and identifiers
    data_encoded_share: float
    data_least_bytes: int  # of the content or, where that cannot be read, by size


LIMITS = {
    "python": Limits(200, 300, 0.06, 0.55, 0.30, 0.12, 0.60, 0.40, 100),
    "javascript": Limits(110, 250, 0.10, 0.55, 0.30, 0.12, 0.60, 0.40, 100),
    # settings and manifests are hand-written, also on one line; what is left are blobs saved under such a name
    "json": Limits(None, 0, 0, 0, 0, -1.0, 1.0, 0.80, 100),
    "toml": Limits(None, 0, 0, 0, 0, -1.0, 1.0, 0.80, 100),
    "cfg": Limits(None, 0, 0, 0, 0, -1.0, 1.0, 0.80, 100),
}
PROGRAMS = ("python", "javascript")

#: Directories kept for other projects' code.
VENDOR_DIRS = (
    "vendor", "vendors", "_vendor", "vendored", "_vendored", "third_party", "third-party", "thirdparty", "3rdparty",
    "node_modules", "bower_components", "jspm_packages", "site-packages", "external", "externals", "extern", "_bundled",
    "deps", "_deps",
)
#: Files that package managers write.
LOCK_FILES = (
    "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "pipfile.lock",
    "composer.lock", "cargo.lock", "gemfile.lock", "go.sum", "uv.lock", "pdm.lock", "bun.lock",
)
#: What an opening comment of tool output says, in the languages of the data.
GENERATED_MARK = (
    r"(?i)@generated\b|\bauto-?\s?generated\b|\bgenerated (?:automatically|by|from|with)\b|\bautomatically generated\b"
    r"|\bdo not (?:edit|modify|change)\b|\bproduced automatically\b|\bregenerate with\b|\boutput of \S+ compiler\b"
    r"|\bcompiled (?:by|from|with)\b|maschinell (?:erzeugt|generiert)|automatisch (?:erzeugt|generiert)|자동 ?생성|自動生成|自动生成"
    r"|generado autom[aá]ticamente|g[eé]n[eé]r[eé] automatiquement"
)
NOT_GENERATED = r"(?i)\b(?:not|never|isn't|nicht) (?:auto-?)?(?:generated|maschinell|automatisch)"
FOREIGN_MARK = (
    r"(?i)\bcopied (?:unchanged |verbatim )?from\b|\b(?:vendored|imported|taken|adapted|borrowed) (?:\w+ )?from the \S+ (?:project|library|package)"
    r"|\(c\) \S+ contributors|\breleased under the \S+ licen[cs]e|\bvendored (?:copy|from)\b"
)
#: Name and version that open a banner.
BANNER = r"^[#/*!\s\"']*(@?[A-Za-z][\w./@-]*) v?\d+(?:\.\d+)+"
BUNDLER_FRAME = (
    r"__webpack_require__|^\s*/\*{6}/|\bwebpackBootstrap\b|\bwebpackChunk|\bparcelRequire\b|\bSystem\.register\(\["
    r"|Object\.defineProperty\(exports, ?[\"']__esModule[\"']|//[#@] sourceMappingURL="
)
#: The comment that opens a file, behind a first line for the shell or the encoding and 'use strict'.
OPENING = (
    r"(?s)^\uFEFF?\s*(?:#![^\n]*\n\s*)?(?:#[^\n]{0,40}coding[^\n]*\n\s*)?(?:['\"]use strict['\"];?\s*)?"
    r"((?:(?://|#)[^\n]*+(?:\n[ \t]*+(?=//|#))?+)++|/\*.*?\*/|[rRuU]?\"\"\".*?\"\"\"|[rRuU]?'''.*?''')"
)
# The groups' quantifiers are possessive, which the JVM runs as loops: long texts cannot exhaust its stack.
STRING = r"\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
IDENTIFIER = r"[A-Za-z_$][A-Za-z0-9_$]*"
NUMBER = r"(?<![A-Za-z0-9_.])[0-9][0-9_.]*(?:[eE][+-]?[0-9]+)?|0[xX][0-9a-fA-F]+"
ENCODED = r"[A-Za-z0-9+/=]{60,}+|(?:\\x[0-9a-fA-F]{2}){8,}+|(?:\\u[0-9a-fA-F]{4}){8,}+"


def _kept(text: Column, pattern: str) -> Column:
    """Characters that matches of the pattern cover."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def layout_statistics(files: DataFrame, id_column: str = "file_id") -> DataFrame:
    """(file_id, language, path, size, package, content and the layout columns), one row per row of `files`. Identifiers and
    numbers are only looked for in programs."""
    content = files["content"]
    base = files.select(
        files[id_column].cast("bigint").alias("file_id"),
        F.lower(F.trim(files["language"], F.lit(" \t\r\n"))).alias("language"),
        files["path"],
        files["package"],
        files["size"],
        content,
        F.length(content).alias("chars"),
        F.filter(F.transform(F.split(content, r"\r\n|\r|\n"), lambda x: F.length(F.trim(x))), lambda n: n > 0).alias("_lines"),
        F.when(F.lower(F.trim(files["language"], F.lit(" \t\r\n"))).isin(*PROGRAMS), F.regexp_replace(content, STRING, '""')).alias("_code"),
    )
    chars = F.greatest(F.col("chars"), F.lit(1))
    code = F.col("language").isin(*PROGRAMS)
    identifiers, numbers = F.regexp_count("_code", F.lit(IDENTIFIER)), F.regexp_count("_code", F.lit(NUMBER))
    lines = F.aggregate("_lines", F.lit(0), lambda a, b: a + b)
    measured = base.select(
        "file_id", "language", "path", "package", "size", "content", "chars",
        F.coalesce(F.array_max("_lines"), F.when(F.col("chars") == 0, 0)).alias("longest_line"),
        F.round(lines / F.greatest(F.size("_lines"), F.lit(1)), 2).alias("mean_line"),
        F.round(_kept(F.col("content"), r"\s+") / chars, 4).alias("blank_share"),
        F.round(_kept(F.col("content"), r"[\p{L}\p{N}]+") / chars, 4).alias("alnum_share"),
        F.when(code, F.round(_kept(F.col("_code"), IDENTIFIER) / chars, 4)).alias("identifier_share"),
        F.round(numbers / F.greatest(numbers + identifiers, F.lit(1)), 4).alias("number_density"),
        F.round(_kept(F.col("content"), ENCODED) / chars, 4).alias("encoded_share"),
    )
    return measured


def _per_language(judge) -> Column:
    """`judge(limits)` of the row's language; false for other languages."""
    out = None
    for language, limits in LIMITS.items():
        out = F.when(F.col("language") == language, judge(limits)) if out is None else out.when(
            F.col("language") == language, judge(limits)
        )
    return F.coalesce(out.otherwise(F.lit(False)), F.lit(False))


def _name_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[-_.]+", "-")


def layout_verdicts(measured: DataFrame) -> DataFrame:
    """The layout statistics with two flags that they decide: minified, data."""

    def minified(m: Limits) -> Column:
        if m.minified_mean_line is None:
            return F.lit(False)
        return (
            (F.col("mean_line") >= m.minified_mean_line) & (F.col("longest_line") >= m.minified_longest_line)
            & (F.col("blank_share") <= m.minified_blank_share) & (F.col("identifier_share") >= m.minified_identifier_share)
            & (F.col("alnum_share") >= m.minified_alnum_share)
        )

    def data(m: Limits) -> Column:
        encoded = F.col("encoded_share") >= m.data_encoded_share
        large = F.coalesce(F.octet_length("content"), F.col("size")) >= m.data_least_bytes
        if m.data_identifier_share < 0:
            return large & encoded
        few = F.col("identifier_share") <= m.data_identifier_share
        numbers = (F.col("number_density") >= m.data_number_density) | (F.col("identifier_share") <= m.data_identifier_share / 2)
        return large & (encoded | few & numbers)

    return measured.select("*", _per_language(minified).alias("minified"), _per_language(data).alias("data"))


def marked(measured: DataFrame) -> DataFrame:
    """Rows with path, content, language and package, with two flags that marks decide: generated, vendored."""
    folders = F.split(F.lower(F.regexp_replace("path", r"[^/]*$", "")), "/")
    name = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    opening = F.regexp_extract(F.col("content"), OPENING, 1)
    code = F.col("language").isin(*PROGRAMS)
    no = F.lit(False)
    banner = F.regexp_extract(opening, BANNER, 1)
    own = _name_key(banner) == _name_key(F.col("package"))
    generated = (
        name.isin(*LOCK_FILES)
        | ((F.col("language") == "json") & F.coalesce(F.col("content").rlike(r'"lockfileVersion"\s*:\s*\d'), no))
        | (code & opening.rlike(GENERATED_MARK) & ~opening.rlike(NOT_GENERATED))
        | (code & F.col("content").rlike(BUNDLER_FRAME))
    )
    kept = F.arrays_overlap(folders, F.array(*map(F.lit, VENDOR_DIRS)))
    vendored = F.coalesce(kept | (code & opening.rlike(FOREIGN_MARK) & ~F.coalesce(own, no)), kept, no)
    return measured.select("*", F.coalesce(generated, no).alias("generated"), vendored.alias("vendored"))


def verdicts(files: DataFrame, id_column: str = "file_id") -> DataFrame:
    """The layout statistics with four flags: minified and data by layout, generated and vendored by marks."""
    return marked(layout_verdicts(layout_statistics(files, id_column)))


def non_handwritten(files: DataFrame) -> DataFrame:
    """(file_id, generated, minified, vendored, data, layout columns) of the files not written by hand, once each."""
    return (
        verdicts(files)
        .where("generated OR minified OR vendored OR data")
        .drop("content", "path", "package")
        .dropDuplicates(["file_id"])
    )


def handwritten(files: DataFrame) -> DataFrame:
    """The rows of `files` that remain."""
    v = verdicts(files).where("NOT (generated OR minified OR vendored OR data)")
    return v.select("file_id", "language", "path", "package", "size", "content")
