"""Sources of the user's own: a reader for each split that is pulled record by record until it gives None."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class RecordReader:
    """``open`` takes the split; ``read`` gives a tuple, or None at the end; ``close`` follows in any case."""

    def open(self, split) -> None: ...

    def read(self) -> tuple | None:
        return None

    def close(self) -> None: ...


def read_with(spark: SparkSession, make: Callable[[], RecordReader], schema: str, splits: Sequence) -> DataFrame:
    """One partition for each split, read on the executors by a reader of its own."""

    class Split(InputPartition):
        def __init__(self, value):
            self.value = value

    class Reader(DataSourceReader):
        def partitions(self):
            return [Split(s) for s in splits]

        def read(self, partition):
            r = make()
            r.open(partition.value)
            try:
                while (row := r.read()) is not None:
                    yield tuple(row)
            finally:
                r.close()

    class Source(DataSource):
        @classmethod
        def name(cls):
            return "record_reader"

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Source)
    return spark.read.format("record_reader").load()
