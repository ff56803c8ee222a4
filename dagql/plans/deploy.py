"""Code and shared values for the executors."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark import Broadcast
from pyspark.sql import SparkSession


def deploy(spark: SparkSession, files: Sequence[str]) -> list[str]:
    """Ships Python files and archives to all executors; all or, if one can't be read, none. Gives their names."""
    missing = [f for f in files if "://" not in f and not Path(f).is_file()]
    if missing:
        raise FileNotFoundError(", ".join(missing))
    for f in files:
        spark.sparkContext.addPyFile(f)
    return [f.rsplit("/", 1)[-1] for f in files]


def shared(spark: SparkSession, value) -> Broadcast:
    """A value of bounded size that every task of the job sees; call ``value`` on what this gives."""
    return spark.sparkContext.broadcast(value)
