"""Indicators accumulated over a stream of alerts, with state per indicator.

State is partitioned by indicator and bounded by what is kept per key: a count, the times, and the distinct packages up
to the number that raises the confidence no further. Repeated observations within a batch count once; the source must
not repeat ids across batches (see first_seen).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "type string, value string, observations bigint, packages int, confidence double, promoted boolean"
STATE = "observations bigint, packages array<string>, confidence double"
#: From three packages on the confidence rises no further.
PACKAGES = 3


def confidence(first: float, observations: int, packages: int) -> float:
    best = max(first, 0.5)
    best = max(best, 0.85 if observations >= 5 else 0.75 if observations >= 3 else 0.0)
    return round(max(best, 0.95 if packages >= 3 else 0.9 if packages >= 2 else 0.0), 4)


def accumulate(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, packages, best = state.get if state.exists else (0, [], 0.0)
    packages = set(packages)
    for rows in batches:
        n += rows["id"].nunique()
        packages |= set(rows["package"].dropna())
        best = max(best, float(rows["confidence"].max()))
    packages = set(sorted(packages)[:PACKAGES])
    best = confidence(best, n, len(packages))
    state.update((n, sorted(packages), best))
    yield pd.DataFrame([(*key, n, len(packages), best, best >= 0.9 or len(packages) >= 2)], columns=[c.split()[0] for c in OUT.split(", ")])


def accumulated(stream: DataFrame) -> DataFrame:
    """(type, value, observations, packages, confidence, promoted) of a stream (id, type, value, confidence, package)."""
    return stream.groupBy("type", "value").applyInPandasWithState(accumulate, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
