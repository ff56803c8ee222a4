"""Counters beside a running plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession


class Counter:
    """Adds up over all tasks. ``update`` gives the new value (on the driver); ``set`` the one before."""

    def __init__(self, spark: SparkSession, name: str):
        self.name, self._value = name, spark.sparkContext.accumulator(0)

    def add(self, n: int) -> None:
        """From tasks."""
        self._value.add(n)

    def get(self) -> int:
        return self._value.value

    def update(self, delta: int) -> int:
        self._value.add(delta)
        return self.get()

    def set(self, value: int) -> int:
        old = self.get()
        self._value.add(value - old)
        return old


class MeanCounter:
    """The whole-number mean of the values set so far; ``set`` gives the mean before."""

    def __init__(self):
        self._sum = self._n = 0

    def get(self) -> int:
        """Whole division towards zero, exact at any size."""
        return (abs(self._sum) // self._n) * (1 if self._sum >= 0 else -1) if self._n else 0

    def set(self, value: int) -> int:
        old = self.get()
        self._sum += value
        self._n += 1
        return old


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """df, and metrics of its rows that are there once an action has run over it."""
    o = Observation(name)
    return df.observe(o, *[c.alias(k) for k, c in metrics.items()]), o
