"""Sinks: delimited lines, printed tuples, per-partition writers, ordered result reading, null sink."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _chosen(df: DataFrame, columns: Sequence[int] | None) -> list[str]:
    """Names by position; positions may repeat; None: all."""
    return df.columns if columns is None else [df.columns[i] for i in columns]


def delimited_line(df: DataFrame, columns: Sequence[int] | None = None, sep: str = ",") -> DataFrame:
    """One ``line`` of each row: the chosen fields with a separator between, nothing quoted; null prints as nothing."""
    parts: list[Column] = []
    for i, c in enumerate(_chosen(df, columns)):
        parts += ([F.lit(sep)] if i else []) + [F.coalesce(F.col(c).cast("string"), F.lit(""))]
    return df.select(F.concat(*parts).alias("line"))


def write_delimited(df: DataFrame, path: str, columns: Sequence[int] | None = None, sep: str = ",", mode: str = "errorifexists") -> None:
    delimited_line(df, columns, sep).write.mode(mode).text(path)


def print_tuples(df: DataFrame, columns: Sequence[int] | None = None) -> DataFrame:
    """One ``line`` of each row: fields with ``"; "`` between, strings in double quotes, numbers bare."""
    names, kinds = _chosen(df, columns), df.schema
    shown = [F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"')) if isinstance(kinds[c].dataType, T.StringType) else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]
    return df.select(F.concat_ws("; ", *shown).alias("line"))


def print_with(df: DataFrame, printers: Sequence[Callable[[Column], Column]], sep: str = "; ") -> DataFrame:
    """One ``line`` of each row: each field through its own printer, nulls as nothing."""
    return df.select(F.concat_ws(sep, *[F.coalesce(p(F.col(c)), F.lit("")) for p, c in zip(printers, df.columns, strict=True)]).alias("line"))


class TupleWriter:
    """Base of user sinks. ``close`` follows only a successful ``open``; ``fail`` comes before it if a write raised."""

    def open(self, partition: int) -> None: ...

    def write(self, row) -> None: ...

    def fail(self) -> None: ...

    def close(self) -> None: ...


def write_with(df: DataFrame, make: Callable[[], TupleWriter]) -> None:
    """Runs one writer of the user's for each partition, on the executors."""

    def run(rows: Iterator) -> None:
        from pyspark import TaskContext

        w = make()
        w.open(TaskContext.get().partitionId())
        try:
            for r in rows:
                w.write(r)
        except BaseException:
            w.fail()
            raise
        finally:
            w.close()

    df.foreachPartition(run)


def serialize(df: DataFrame, name: str = "value", serializer: Callable[[list[Column]], Column] | None = None) -> DataFrame:
    """Each row as one text: JSON, or what the serializer makes of its columns."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    return df.select((serializer(columns) if serializer else F.to_json(F.struct(*columns))).alias(name))


class ResultReader:
    """Reads a result partition by partition, in order, without holding more than one; ``read`` gives None at the end."""

    def __init__(self, df: DataFrame, prefetch: bool = False):
        self._rows = df.toLocalIterator(prefetchPartitions=prefetch)

    def __iter__(self):
        return self._rows

    def read(self, n: int = 1024) -> list | None:
        out = [r for _, r in zip(range(n), self._rows, strict=False)]
        return out or None


def discard(df: DataFrame) -> None:
    """Runs the plan and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()
