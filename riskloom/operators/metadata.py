"""Facts drawn from names, descriptions, addresses and scripts of packages, as built-in expressions.

Defined results: nulls give null; the first matching category in the order given wins; unknown checks give no signal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Categories by keyword, in order.
CATEGORIES = {
    "parser": "json yaml csv xml toml parser parse", "formatter": "format color log chalk ansi style", "date_utility": "date time moment dayjs luxon timezone",
    "math_utility": "math stat random number calc",
}
# Commands in install scripts that are a strong signal.
DANGEROUS_SCRIPT = (
    r"(?i)nc\s+-[le]|netcat|curl\s+[^\"]*\|\s*(?:bash|sh|node|python)|wget\s+[^\"]*\|\s*(?:bash|sh|node|python)|powershell\s+-(?:e|enc|encodedcommand)"
    r"|(?:bash|sh|node|python)\s+-c\s+|\beval\b|\bexec\b|\bbase64\b|\bxxd\b"
)
# Scores below which a repository check is a signal.
THRESHOLDS = {
    "Maintained": 3.0, "Code-Review": 5.0, "Branch-Protection": 3.0, "Token-Permissions": 5.0, "Vulnerabilities": 7.0, "Pinned-Dependencies": 3.0,
    "Dangerous-Workflow": 7.0,
}


#: Categories with the words of their names, the dimensions they allow and the calls they rule out.
CATEGORY_RULES = {
    "parser": (
        "json|yaml|csv|xml|toml|parser|parse", "I",
        ("requests.post", "requests.get", "subprocess.run", "subprocess.Popen", "os.system", "child_process.exec", "child_process.spawn", "http.request", "https.request", "fetch", "eval", "exec"),
    ),
    "formatter": (
        "format|color|log|chalk|ansi|style", "",
        ("requests.post", "requests.get", "subprocess.run", "subprocess.Popen", "http.request", "fetch", "eval", "exec", "os.environ.get", "process.env"),
    ),
    "date_utility": ("date|time|moment|dayjs|luxon|timezone", "", ("requests.post", "subprocess.run", "http.request", "fetch", "eval", "exec", "os.environ.get")),
    "math_utility": ("math|stat|random|number|calc", "", ("requests.post", "subprocess.run", "os.environ.get", "http.request", "fetch", "eval", "exec")),
}


def category(text: Column) -> Column:
    """The first category one of whose keywords occurs in a text."""
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for name, words in reversed(CATEGORIES.items()):
        out = F.when(low.rlike("|".join(words.split())), name).otherwise(out)
    return out


def repository(url: Column) -> Column:
    """owner/name of a repository address in its usual forms, else null."""
    clean = F.trim(url)
    pattern = r"(?i)^(?:(?:git\+)?https?://github\.com/|git@github\.com:)([A-Za-z0-9_.\-]+)/([A-Za-z0-9_.\-]+?)(?:\.git)?/?(?:#.*)?$"
    return F.when(clean.rlike(pattern), F.concat_ws("/", F.regexp_extract(clean, pattern, 1), F.regexp_extract(clean, pattern, 2)))


def dangerous_scripts(scripts: DataFrame) -> DataFrame:
    """Lifecycle scripts (command) that run a dangerous command."""
    return scripts.where(F.col("command").rlike(DANGEROUS_SCRIPT))


def weak_checks(checks: DataFrame) -> DataFrame:
    """Repository checks (name, score) that score below their threshold; negative scores mean unknown."""
    threshold = F.create_map(*[F.lit(x) for pair in THRESHOLDS.items() for x in pair])[F.col("name")]
    return checks.withColumn("threshold", threshold).where((F.col("score") >= 0) & (F.col("score") < F.col("threshold")))


def cvss_severity(score: Column) -> Column:
    return F.when(score >= 9, "CRITICAL").when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").when(score.isNotNull(), "LOW").otherwise("UNKNOWN")


def description_shape(descriptions: DataFrame, column: str) -> DataFrame:
    """Adds chars, words and mean_word of a description."""
    words = F.filter(F.split(F.trim(column), r"\s+"), lambda w: w != "")
    total = F.aggregate(F.transform(words, lambda w: F.length(w)), F.lit(0), lambda a, b: a + b)
    return descriptions.withColumns({
        "chars": F.length(column), "words": F.size(words), "mean_word": F.when(F.size(words) > 0, F.round(total / F.size(words), 4)),
    })


def agreement(votes: DataFrame, key: str, vote: str, truth: str) -> DataFrame:
    """(key, trials, distinct_votes, mode_vote, agreement, correct): how steady repeated votes are. Ties by name."""
    counts = votes.groupBy(key, vote).agg(F.count("*").alias("n"), F.max(truth).alias("t"))
    g = counts.groupBy(key).agg(
        F.sum("n").alias("trials"), F.count("*").alias("distinct_votes"), F.min(F.struct((-F.col("n")).alias("n"), F.col(vote).alias("v"))).alias("m"), F.max("t").alias("t")
    )
    return g.select(key, "trials", "distinct_votes", F.col("m.v").alias("mode_vote"), F.round(-F.col("m.n") / F.col("trials"), 4).alias("agreement"), (F.col("m.v") == F.col("t")).alias("correct"))


def provenance_level(raw: Column, ecosystem: Column) -> Column:
    """Provenance level of registry metadata (JSON text): npm has a level for each of attestations and signatures of the
    latest version; for PyPI any attestation counts as level 2. Null and invalid metadata are of level 0."""
    latest = F.get_json_object(raw, "$.dist-tags.latest")
    dist = F.from_json(F.get_json_object(raw, "$.versions"), "map<string,struct<dist:struct<attestations:map<string,string>,signatures:array<string>>>>")[latest]["dist"]
    proved = F.coalesce(F.size(dist["attestations"]) > 0, F.lit(False))
    signed = F.coalesce(F.size(dist["signatures"]) > 0, F.lit(False))
    urls = F.from_json(F.get_json_object(raw, "$.urls"), "array<map<string,string>>")
    attested = F.coalesce(F.exists(urls, lambda u: F.coalesce(u["provenance"], u["attestations"]).isNotNull()), F.lit(False))
    npm = proved.cast("int") + signed.cast("int")
    return F.when(F.lower(ecosystem) == "pypi", F.when(attested, 2).otherwise(0)).otherwise(npm)
