"""Session helpers shared by all operators: table access, shared checkpoints, size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in bytes, that an operator here may mark for broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a temporary one only for a local session that sets
    none, as in tests."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="riskloom-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """`df` written once to the shared checkpoint folder: cheap to read again, and safe when executors are lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, size_in_bytes: int) -> DataFrame:
    """`df` marked for broadcast if its measured size stays under BROADCAST_BYTES, else left to the planner."""
    return F.broadcast(df) if size_in_bytes <= BROADCAST_BYTES else df


def env_path(name: str, default: str) -> str:
    """A path parameter taken from the environment."""
    return os.environ.get(name, default)
