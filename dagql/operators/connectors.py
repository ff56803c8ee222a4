"""How rows move from the partitions of one operator to those of the next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from dagql.operators.relational import sent


def one_to_one(df: DataFrame) -> DataFrame:
    """Stays where it is; Spark runs both ends as one stage."""
    return df


def hashed(df: DataFrame, keys: Sequence[str], n: int | None = None) -> DataFrame:
    return df.repartition(n, *keys) if n else df.repartition(*keys)


def hashed_merged(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int | None = None) -> DataFrame:
    """By hash, each receiver's rows sorted."""
    return hashed(df, keys, n).sortWithinPartitions(*order)


def ranged(df: DataFrame, keys: Sequence[str], n: int | None = None) -> DataFrame:
    """By ranges of the keys: partition i holds smaller keys than partition i + 1, each sorted."""
    return (df.repartitionByRange(n, *keys) if n else df.repartitionByRange(*keys)).sortWithinPartitions(*keys)


def replicated(df: DataFrame) -> DataFrame:
    """To every receiver, if known to be small enough; else left to the join that follows."""
    return sent(df)


def spread(df: DataFrame, n: int) -> DataFrame:
    """Round robin."""
    return df.repartition(n)


def gathered(df: DataFrame) -> DataFrame:
    """All to one receiver: for small results."""
    return df.coalesce(1)


CONNECTORS = {f.__name__: f for f in (one_to_one, hashed, hashed_merged, ranged, replicated, spread, gathered)}
