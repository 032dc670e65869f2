"""Behaviour reports as rows: dynamic-analysis documents and system-call logs.

Defined results: missing phases and fields count as empty; lines of other calls are passed over; repeated activity
counts once per document; null documents give null arrays' rows with empty arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.catalogs import SENSITIVE_PATH

ANALYSIS = """Analysis map<string, struct<Files: array<struct<Path: string, Read: boolean, Write: boolean>>,
    Sockets: array<struct<Address: string, Port: int, Hostnames: array<string>>>, Commands: array<struct<Command: array<string>>>,
    DNS: array<struct<Queries: array<struct<Hostname: string>>>>>>"""


def observed(texts: DataFrame, key: str, column: str) -> DataFrame:
    """(key, written, sensitive_read, sockets, commands, hosts) merged over all phases of each document."""
    a = texts.select(key, F.map_values(F.from_json(column, ANALYSIS)["Analysis"]).alias("p"))

    def merged(field: str, value, keep=None):
        items = F.flatten(F.transform(F.coalesce("p", F.array()), lambda x: F.coalesce(x[field], F.array())))
        if keep is not None:
            items = F.filter(items, keep)
        return F.array_sort(F.array_distinct(F.array_compact(F.transform(items, value))))

    hosts = F.array_sort(F.array_distinct(F.flatten(merged("DNS", lambda d: F.transform(F.coalesce(d["Queries"], F.array()), lambda q: q["Hostname"])))))
    return a.select(
        key,
        merged("Files", lambda f: f["Path"], lambda f: f["Write"]).alias("written"),
        merged("Files", lambda f: f["Path"], lambda f: f["Read"] & f["Path"].rlike(SENSITIVE_PATH)).alias("sensitive_read"),
        merged("Sockets", lambda s: F.concat_ws(":", s["Address"], s["Port"].cast("string"))).alias("sockets"),
        merged("Commands", lambda c: F.substring(F.array_join(c["Command"], " "), 1, 200)).alias("commands"),
        hosts.alias("hosts"),
    )


def system_calls(texts: DataFrame, key: str, column: str) -> DataFrame:
    """(key, connects, executed, sensitive_opened) of strace logs."""
    pick = lambda pattern: F.array_sort(F.array_distinct(F.regexp_extract_all(column, F.lit(pattern), F.lit(1))))
    opened = F.filter(pick(r'(?m)open(?:at)?\([^"\n]*"([^"\n]+)"'), lambda p: p.rlike(SENSITIVE_PATH))
    return texts.select(
        key, pick(r'(?m)connect\([^\n]*inet_addr\("([^"\n]+)"\)').alias("connects"), pick(r'(?m)execve\("([^"\n]+)"').alias("executed"), opened.alias("sensitive_opened")
    )
