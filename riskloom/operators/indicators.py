"""Regular-expression indicators over lines and whole texts, and their escalation within a file.

The alternation of all patterns gates texts and lines first; only what passes is tested pattern by pattern, with
patterns that are literals in the plan (compiled once, no join with a pattern table).

Defined results: null texts have no hits; of equal hits the greatest confidence and then the first line is kept; empty
tables give empty results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.catalogs import (
    DECISIVE_PREFIXES, DECODERS, DYNAMIC_CODE, DYNAMIC_IMPORTS, FILE_PATTERNS, INSTALL_HOOKS, LINE_PATTERNS, SEVERITY, SHELL_CALLS, SYSTEM_CALLS, WEAK_CODES,
)


def severity_of(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for level in ("LOW", "MEDIUM", "HIGH"):
        out = F.when(code.isin(*[c for c, s in SEVERITY.items() if s == level]), level).otherwise(out)
    return out


def line_hits(texts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, code, confidence, line_no): the first matching line of each pattern."""
    any_pattern = "|".join(f"(?:{p})" for _, _, p in LINE_PATTERNS)
    gated = texts.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where(F.col("text").rlike(any_pattern))
    rows = gated.select("id", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("at", "line")).where(F.col("line").rlike(any_pattern))
    tests = [
        F.when(F.col("line").rlike(p), F.struct(F.lit(k).alias("rule"), F.lit(code).alias("code"), F.lit(c).alias("confidence")))
        for k, (code, c, p) in enumerate(LINE_PATTERNS)
    ]
    hits = rows.select("id", "at", F.explode(F.array_compact(F.array(*tests))).alias("h"))
    first = hits.groupBy("id", "h.rule", "h.code", "h.confidence").agg((F.min("at") + 1).alias("line_no"))
    return first.select(F.col("id").alias(id_column), "code", "confidence", "line_no")


def text_hits(texts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, code, confidence, line_no): patterns over the whole text, with the line where the match begins."""
    text = F.col(text_column)
    tests = [
        F.when(
            text.rlike(p),
            F.struct(
                F.lit(code).alias("code"), F.lit(c).alias("confidence"),
                (F.regexp_count(F.substring(text, F.lit(1), F.regexp_instr(text, F.lit(p)) - 1), F.lit("\n")) + 1).alias("line_no"),
            ),
        )
        for code, c, p in FILE_PATTERNS
    ]
    hits = texts.where(text.isNotNull()).select(id_column, F.explode(F.array_compact(F.array(*tests))).alias("h"))
    return hits.select(id_column, "h.code", "h.confidence", "h.line_no").distinct()


def sequence_hits(calls: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, code, confidence, line_no): indicators that a file's calls (file_id, at, name, line, dimension, snippet) show,
    each at the first call that it rests on; one aggregation per file for all of them."""
    name, letter, line = F.col("name"), F.col("dimension"), F.col("snippet")
    path = F.lower(F.coalesce("path", F.lit("")))
    hook = F.lit(False)
    for word in INSTALL_HOOKS:
        hook = hook | F.contains(path, F.lit(word))
    sends = letter == "T"
    rules = [
        ("EXS-001", 0.7, F.lit(True), F.endswith(F.col("path"), F.lit("__init__.py"))), ("EXS-002", 0.85, F.lit(True), hook),
        ("EXM-001", 0.85, name.isin(*DYNAMIC_CODE), None), ("EXM-005", 0.7, name.isin(*DYNAMIC_IMPORTS), None),
        ("EXM-006", 0.85, F.contains(line, F.lit("pip")) & F.contains(line, F.lit("install")), None), ("EXM-008", 0.75, name.isin(*SHELL_CALLS), None),
        ("EXF-001", 0.85, sends, F.col("reads")), ("SYS-005", 0.6, name.isin(*SYSTEM_CALLS), None),
        ("NET-009", 0.8, F.contains(line, F.lit("verify=False")) | F.contains(line, F.lit("_create_unverified_context")), None),
        ("NET-010", 0.6, sends & F.contains(line, F.lit("http://")), None), ("DEF-003", 0.7, name.isin(*DECODERS), None),
    ]
    firsts = [F.min(F.when(test, F.struct("at", "line"))).alias(f"_{k}") for k, (_, _, test, _) in enumerate(rules)]
    per_file = calls.groupBy("file_id").agg(F.max(letter == "I").alias("reads"), *firsts)
    owned = per_file.join(files.select(F.col("file_id").cast("bigint").alias("file_id"), "path").dropDuplicates(["file_id"]), "file_id")
    hits = [
        F.when(F.col(f"_{k}").isNotNull() & (F.lit(True) if also is None else F.coalesce(also, F.lit(False))), F.struct(F.lit(code).alias("code"), F.lit(c).alias("confidence"), F.col(f"_{k}.line").alias("line_no")))
        for k, (code, c, _, also) in enumerate(rules)
    ]
    return owned.select("file_id", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("file_id", "h.code", "h.confidence", "h.line_no")


def hit_summary(best: DataFrame, id_column: str) -> DataFrame:
    """(id, codes, families, high): the sorted codes of a text, the sorted beginnings of its codes and its HIGH hits."""
    families = F.array_sort(F.array_distinct(F.transform("c", lambda x: F.substring_index(x, "-", 1))))
    g = best.groupBy(id_column).agg(F.array_sort(F.collect_set("code")).alias("c"), F.count_if(F.col("severity") == "HIGH").alias("high"))
    return g.select(id_column, F.array_join("c", ",").alias("codes"), F.array_join(families, ",").alias("families"), "high")


#: Words that make a decoded string suspicious, in the order they are tried.
SUSPICIOUS_WORDS = (
    "exec(", "eval(", "subprocess", "os.system", "popen", "spawn", "child_process", "Function(", "__import__", "importlib", "http://", "https://",
    "requests.", "urllib.", "fetch(", "axios.", "net.Socket", "socket.socket", "os.environ", "process.env", "open(", "fs.readFile", "/etc/passwd",
    "/.ssh/", "/.aws/", "appdata", " -c ", "bash ", "/bin/sh", "cmd.exe", "powershell", " curl ", " wget ", "certutil", "base64", "atob", "b64decode",
)


def suspicious_word(text: Column) -> Column:
    """The first of SUSPICIOUS_WORDS, in their order, that a text holds whatever its case."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(w.lower())), F.lit(w)) for w in SUSPICIOUS_WORDS])


def best_hits(hits: DataFrame, id_column: str) -> DataFrame:
    """One hit per text and code: the most confident, then the first; with its severity."""
    best = hits.groupBy(id_column, "code").agg(F.max(F.struct("confidence", (-F.col("line_no")).alias("n"))).alias("b"))
    return best.select(id_column, "code", "b.confidence", (-F.col("b.n")).alias("line_no"), severity_of(F.col("code")).alias("severity"))


def escalated(best: DataFrame, id_column: str) -> DataFrame:
    """Evidence of hits: a weak code alone stays LOW and benign; with a decisive code in the same text it counts fully."""
    decisive = F.lit(False)
    for prefix in DECISIVE_PREFIXES:
        decisive = decisive | F.col("code").startswith(prefix)
    per_text = best.groupBy(id_column).agg(F.max(decisive).alias("has_decisive"))
    j = best.join(per_text, id_column)
    weak = F.col("code").isin(*WEAK_CODES) & ~F.col("has_decisive")
    verdict = (
        F.when(weak, "benign")
        .when((F.col("severity") == "HIGH") & (F.col("confidence") >= 0.8), "malicious")
        .when(F.col("severity").isin("HIGH", "MEDIUM") & (F.col("confidence") >= 0.5), "suspicious")
        .otherwise("benign")
    )
    return j.select(
        id_column, "code", "line_no", F.when(weak, "LOW").otherwise(F.col("severity")).alias("severity"), verdict.alias("verdict"),
        F.when(weak, F.least(F.col("confidence"), F.lit(0.4))).otherwise(F.col("confidence")).alias("confidence"),
    )


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of a string's characters."""
    chars = F.split(text, "")
    n = F.size(chars)
    return F.aggregate(
        F.array_distinct(chars),
        F.lit(0.0),
        lambda acc, c: acc - (F.size(F.filter(chars, lambda x: x == c)) / n) * F.log2(F.size(F.filter(chars, lambda x: x == c)) / n),
    )


def suspicious_strings(texts: DataFrame, id_column: str, text_column: str, least: int = 16) -> DataFrame:
    """(id, value, chars, entropy): distinct quoted strings of at least `least` characters without blanks."""
    found = F.regexp_extract_all(F.col(text_column), F.lit(rf"[\"']([A-Za-z0-9+/=_.-]{{{least},}})[\"']"), F.lit(1))
    rows = texts.where(F.col(text_column).isNotNull()).select(id_column, F.explode(F.array_distinct(found)).alias("value")).distinct()
    return rows.select(id_column, "value", F.length("value").alias("chars"), F.round(entropy(F.col("value")), 6).alias("entropy"))


def decoded_strings(strings: DataFrame, column: str = "value") -> DataFrame:
    """Adds encoding and decoded text of strings that are base64 (16 characters or more) or hex (20 or more) of text."""
    v = F.col(column)
    hexed = F.when(v.rlike(r"^(?:[0-9a-fA-F]{2}){10,}$"), F.try_to_binary(v, F.lit("hex")))
    based = F.when(v.rlike(r"^[A-Za-z0-9+/]{16,}={0,2}$") & (F.length(v) % 4 == 0), F.try_to_binary(v, F.lit("base64")))

    def text(b: Column) -> Column:
        t = F.try_validate_utf8(b.cast("string"))
        printable = F.regexp_count(t, F.lit(r"[\x20-\x7e\t\r\n]"))
        return F.when(printable > 0.8 * F.length(t), t)

    both = strings.withColumn("_hex", text(hexed)).withColumn("_b64", text(based))
    kind = F.when(F.col("_hex").isNotNull(), "hex").when(F.col("_b64").isNotNull(), "base64")
    return both.withColumn("encoding", kind).withColumn("decoded", F.coalesce("_hex", "_b64")).drop("_hex", "_b64")
