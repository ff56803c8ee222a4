"""Extension: the same declarations over unbounded input. State is bounded by the watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, time: str, size: str, keys: Sequence[str] = (), slide: str | None = None, late: str | None = None, **aggregates: Column) -> DataFrame:
    """Aggregates by windows of time; slide makes them overlap; late rows are taken up to the watermark."""
    d = df.withWatermark(time, late) if late else df
    d = d.groupBy(F.window(time, size, slide) if slide else F.window(time, size), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return d.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *aggregates)


def sessions(df: DataFrame, time: str, gap: str, keys: Sequence[str], late: str | None = None, **aggregates: Column) -> DataFrame:
    """Aggregates by runs of rows of a key that are less than gap apart."""
    d = df.withWatermark(time, late) if late else df
    d = d.groupBy(F.session_window(time, gap), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return d.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, *aggregates)


def distinct_within(df: DataFrame, time: str, keys: Sequence[str], late: str) -> DataFrame:
    """The first row of each key within the watermark's delay."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
