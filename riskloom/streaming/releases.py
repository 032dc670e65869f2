"""Release changes as a stream: a source that reads a growing feed by serial number, and operators over it.

The source's offset is the last serial, kept by the stream's checkpoint, so a restart reads exactly what was not yet
committed. Feeds are reached through a landing folder of JSON lines {"serial", "package", "version", "action"}; what
fetches them over the network stays outside the engine.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

from pyspark.errors import PySparkNotImplementedError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "serial bigint, package string, version string, action string"


class ChangeFile(InputPartition):
    def __init__(self, path: str, after: int, upto: int):
        self.path, self.after, self.upto = path, after, upto


class ChangeReader(DataSourceStreamReader):
    """All there is per batch: offsets are serials, the driver looks for the greatest one, and the rows are read on the
    executors, a file of the folder per task."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"serial": 0}

    def latestOffset(self) -> dict:
        return {"serial": max((serial for path in _files(self.folder) for serial, _ in _changes(path, 0, None)), default=0)}

    def partitions(self, start: dict, end: dict) -> list[ChangeFile]:
        return [ChangeFile(str(p), start["serial"], end["serial"]) for p in _files(self.folder)]

    def read(self, part: ChangeFile) -> Iterator[tuple]:
        for serial, r in _changes(Path(part.path), part.after, part.upto):
            yield serial, r.get("package"), r.get("version"), r.get("action")


class CappedReader(SimpleDataSourceStreamReader):
    """At most `most` rows per batch, through the driver, as only this kind of reader is told where a batch begins. A batch
    ends between two serials, so that rows that share one are never torn apart; where these alone are more than `most`, it
    has them all."""

    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder, most

    def initialOffset(self) -> dict:
        return {"serial": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        counts = Counter(serial for path in _files(self.folder) for serial, _ in _changes(path, start["serial"], None))
        end, taken = start["serial"], 0
        for serial in sorted(counts):
            if taken and taken + counts[serial] > self.most:
                break
            end, taken = serial, taken + counts[serial]
        return self.readBetweenOffsets(start, {"serial": end}), {"serial": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        rows = (r for path in _files(self.folder) for r in _changes(path, start["serial"], end["serial"]))
        return iter([(serial, r.get("package"), r.get("version"), r.get("action")) for serial, r in sorted(rows, key=lambda r: r[0])])


def _files(folder: str) -> list[Path]:
    return sorted(Path(folder).glob("*.jsonl"))


def _changes(path: Path, after: int, upto: int | None) -> Iterator[tuple[int, dict]]:
    with path.open() as lines:
        for line in lines:
            try:
                r = json.loads(line)
            except ValueError:
                continue
            if isinstance(r, dict) and isinstance(r.get("serial"), int) and r["serial"] > after and (upto is None or r["serial"] <= upto):
                yield r["serial"], r


class ChangeSource(DataSource):
    """Format `release_changes`; options path and, to cap a batch, max_events."""

    @classmethod
    def name(cls) -> str:
        return "release_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ChangeReader:
        if "max_events" in self.options:
            raise PySparkNotImplementedError(errorClass="NOT_IMPLEMENTED", messageParameters={"feature": "streamReader"})
        return ChangeReader(self.options["path"])

    def simpleStreamReader(self, schema) -> CappedReader:
        return CappedReader(self.options["path"], int(self.options["max_events"]))


def changes(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    spark.dataSource.register(ChangeSource)
    reader = spark.readStream.format("release_changes").option("path", path)
    return (reader if most is None else reader.option("max_events", most)).load()


def release_events(stream: DataFrame) -> DataFrame:
    """Creations and new files with a version."""
    keep = F.col("action").isin("create", "new release") | F.col("action").startswith("add ")
    return stream.where(keep & F.col("version").isNotNull() & F.col("package").isNotNull())


def first_seen(stream: DataFrame, time: str, key: list[str], within: str) -> DataFrame:
    """Suppresses repeats of a key that arrive within the given time: the state is dropped behind the watermark."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(key)


def fresh(stream: DataFrame, sent: str, received: str, seconds: int = 300) -> DataFrame:
    """Requests whose sending time is close to their arrival."""
    return stream.where(F.abs(F.unix_timestamp(received) - F.unix_timestamp(sent)) <= seconds)


def run_available(stream: DataFrame, checkpoint: str, into) -> None:
    """Processes what is there, batch by batch, and stops. into(batch, batch_id) must bear a repeated batch."""
    while True:
        query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(into).start()
        query.awaitTermination()
        # a capped source gives one batch per run
        if not sum(p.numInputRows for p in query.recentProgress):
            return
