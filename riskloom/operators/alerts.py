"""Runtime alerts of four sources in one shape, indicators drawn from them, and their accumulation.

Defined results: invalid JSON, nulls and unknown sources give rows without activity; text times are read in any of the
forms that occur, else null; rows that repeat an id count once; internal addresses and trusted domains are no indicators;
empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.catalogs import INTERNAL_IP, SENSITIVE_PATH, TRUSTED_DOMAINS

IPV4 = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
DOMAIN = r"\b[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)*\.(?:com|net|org|io|test|example|invalid|dev|info)\b"
SHA256 = r"\b[a-f0-9]{64}\b"
PATH = r"/(?:etc|home|root|proc|tmp|opt)/[A-Za-z0-9._/-]+"
#: Confidence of each kind of indicator.
CONFIDENCE = {"ip": 0.7, "domain": 0.75, "path": 0.65, "sha256": 0.85}


def received(text: Column) -> Column:
    """Timestamp of the ISO forms: blank or T, with or without zone (read as UTC) and fraction."""
    clean = F.regexp_replace(F.trim(text), r"^(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d:\d\d)(\.\d+)?(?:Z|\+00:?00)?$", "$1 $2")
    return F.when(clean.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$"), clean.try_cast("timestamp_ntz"))


def normalised(observations: DataFrame) -> DataFrame:
    """(id, source, host, received_at, payload): one row per observation, wrappers removed from the payload."""
    raw = F.col("raw_event")
    text = F.when(raw.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"]).otherwise(raw)
    return (
        observations.select("id", "source", "host", received(F.col("received_at")).alias("received_at"), text.alias("payload"))
        .dropDuplicates(["id"])
    )


def indicators(alerts: DataFrame) -> DataFrame:
    """(id, type, value, confidence): distinct addresses, domains, sensitive paths and hashes of each payload."""
    text = F.lower("payload")
    kinds = [("ip", IPV4), ("domain", DOMAIN), ("sha256", SHA256), ("path", PATH)]

    def matches(kind: str, pattern: str) -> Column:
        values = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))

    found = [matches(kind, pattern) for kind, pattern in kinds]
    rows = alerts.where("payload IS NOT NULL").select("id", F.explode(F.concat(*found)).alias("i")).select("id", "i.type", "i.value")
    trusted = F.col("value").isin(*TRUSTED_DOMAINS)
    for d in TRUSTED_DOMAINS:
        trusted = trusted | F.col("value").endswith("." + d)
    keep = (
        F.when(F.col("type") == "ip", ~F.col("value").rlike(INTERNAL_IP))
        .when(F.col("type") == "domain", ~trusted & ~F.col("value").rlike(r"^[0-9.]+$"))
        .when(F.col("type") == "path", F.col("value").rlike(SENSITIVE_PATH))
        .otherwise(F.lit(True))
    )
    confidence = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    return rows.where(keep).withColumn("confidence", confidence[F.col("type")]).distinct()


def accumulated(found: DataFrame, packages: DataFrame) -> DataFrame:
    """(type, value, observations, packages, first_seen, last_seen, confidence, promoted): each indicator over all
    observations. Confidence rises with observations (3: .75, 5: .85) and packages (2: .9, 3: .95) and never falls; it is
    promoted from .9 on or with two packages. packages: (id, package, received_at)."""
    rows = found.join(packages, "id", "left")
    g = rows.groupBy("type", "value").agg(
        F.count_distinct("id").alias("observations"), F.count_distinct("package").alias("packages"),
        F.min("received_at").alias("first_seen"), F.max("received_at").alias("last_seen"), F.max("confidence").alias("c"),
    )
    o, p = F.col("observations"), F.col("packages")
    bumped = F.greatest(
        F.col("c"), F.lit(0.5), F.when(o >= 5, 0.85).when(o >= 3, 0.75).otherwise(0.0), F.when(p >= 3, 0.95).when(p >= 2, 0.9).otherwise(0.0)
    )
    out = g.withColumn("confidence", F.round(bumped, 4)).drop("c")
    return out.withColumn("promoted", (F.col("confidence") >= 0.9) | (F.col("packages") >= 2))


def since(iocs: DataFrame, mark: Column, least_confidence: float = 0.5, most: int = 100) -> DataFrame:
    """The most confident indicators last seen at or after a mark: the filter comes before the limit."""
    rows = iocs.where((F.col("last_seen") >= mark) & (F.col("confidence") >= least_confidence))
    return rows.orderBy(F.desc("confidence"), F.desc("observations"), "type", "value").limit(most)
