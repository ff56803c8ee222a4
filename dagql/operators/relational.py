"""Joins, groups, sorts, set operations and nested data, as functions from DataFrames to DataFrames.

They only declare, but for ``numbered`` and ``replicate``, which write a table; the physical strategy is Catalyst's, unless
a hint is asked for by name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dagql.tables import cut

#: A side is sent to every executor only if Spark knows it to be smaller than this.
MOST_SENT = 64 << 20
#: A hash table is asked for only over a side known to be smaller than this: even if one key holds all of it, it fits a task.
MOST_HASHED = 256 << 20


def known_bytes(df: DataFrame) -> int:
    """Size of df as Catalyst estimates it before running."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def sent(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """df marked to be broadcast if its size is known to be small; else as it is, for a shuffled join."""
    return F.broadcast(df) if known_bytes(df) <= most else df


# Joins. Null keys match nothing unless null_safe.


def _on(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], null_safe: bool = False) -> Column:
    out = F.lit(True)
    for i, (a, b) in enumerate(keys):
        c = left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b]
        out = c if i == 0 else out & c
    return out


def hash_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Equi-join by a hash table over the right side's partitions, if that side is known not to be too large for it (a hash
    table can't spill); else by whatever Catalyst chooses. ``left`` pads missing right rows with nulls."""
    hashed = right.hint("shuffle_hash") if known_bytes(right) <= MOST_HASHED else right
    return left.join(hashed, _on(left, right, keys, null_safe), how)


def equi_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Equi-join by whatever Catalyst chooses; also semi and anti."""
    return left.join(right, _on(left, right, keys, null_safe), how)


def replicate_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], how: str = "inner") -> DataFrame:
    """The right side goes to all partitions of the left, as long as it is known to be small."""
    return left.join(sent(right), _on(left, right, keys), how)


def theta_join(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    """Nested loops over any condition; the right side is the one to keep small."""
    return left.join(sent(right), condition, how)


def interval_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Rows of points within [low, high) of ranges, by an equi-join of bins of ``width``; a range stands in each of its bins."""
    p = points.withColumn("__bin", F.floor(F.col(point) / width))
    r = ranges.where(F.col(low) < F.col(high)).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    d = p.join(r, "__bin").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high)))
    return d.drop("__bin")


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, value: Sequence[str]) -> DataFrame:
    """Each left row with the values of the latest right row of its key at or before its time (nulls if none); of right
    rows of equal time, the one of the greatest values."""
    kept = [c for c in left.columns if c not in (*by, at)]
    a = left.select(*by, at, F.lit(1).alias("__side"), F.struct(*kept).alias("__row"), F.lit(None).cast(right.select(F.struct(*value)).schema[0].dataType).alias("__value"))
    b = right.select(*by, at, F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.struct(*value).alias("__value"))
    w = W.partitionBy(*by).orderBy(at, "__side", "__value").rowsBetween(W.unboundedPreceding, W.currentRow)
    d = a.union(b).withColumn("__value", F.last("__value", ignorenulls=True).over(w)).where("__side = 1")
    return d.select(*by, at, "__row.*", *[F.col(f"__value.{v}").alias(v) for v in value])


# Groups.


def group(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Hash aggregation, partial before the shuffle and final after; spills by itself. No keys: one row."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def group_clustered(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """The same over input that is already dealt and sorted by the keys: no further shuffle."""
    return group(df.repartition(*keys).sortWithinPartitions(*keys), keys, **aggregates)


def group_bag(df: DataFrame, keys: Sequence[str], fields: Sequence[str], name: str = "bag") -> DataFrame:
    """The rows of each key as an array of structs, sorted (a bag has no order)."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def integer_mean(c: str | Column) -> Column:
    """Mean of whole numbers in whole division; 0 for none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.when(F.count(c) > 0, F.call_function("div", F.sum(c), F.count(c))), F.lit(0)).cast("long")


def exact_sum(c: str | Column, scale: int = 2) -> Column:
    """Sum of doubles as decimals of a fixed scale, so the order of addition doesn't show."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast(f"decimal(18,{scale})")).cast("double")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], **aggregates: Column) -> DataFrame:
    """Aggregates over the rows so far within keys. The order must be total for one result."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumns({n: c.over(w) for n, c in aggregates.items()})


def word_count(df: DataFrame, text: str = "text") -> DataFrame:
    """Counts of the words between single spaces."""
    return df.select(F.explode(F.split(text, " ")).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


# Sorts.


def sort(df: DataFrame, *order: str | Column) -> DataFrame:
    """Total order: range exchange, then a sort that spills. Ties are in any order."""
    return df.orderBy(*order)


def micro_sort(df: DataFrame, *order: str | Column) -> DataFrame:
    """Order within each partition only."""
    return df.sortWithinPartitions(*order)


def top_k(df: DataFrame, k: int, *order: str | Column) -> DataFrame:
    """The first k rows: each partition keeps k."""
    return df.orderBy(*order).limit(k)


def top_k_by(df: DataFrame, k: int, keys: Sequence[str], *order: str | Column) -> DataFrame:
    """The first k rows of each key; rows beyond go before the shuffle."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).where(F.col("__n") <= k).drop("__n")


def numbered(df: DataFrame, *order: str, name: str = "rn") -> DataFrame:
    """Positions from 1 in the total order. The sorted ranges are written as a table, each row with its number within its
    range; what is gathered is the size of each range. So there is one sort, and no task holds more than a range."""
    d = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    d = cut(d).withColumn("__part", F.shiftright("__id", 33).cast("int"))
    sizes = {r[0]: r[1] for r in d.groupBy("__part").count().collect()}
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("__part")) if before else F.lit(0)
    return d.withColumn(name, (offset + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")).drop("__part", "__id")


# Several inputs and outputs.


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Aggregates by each of the sets of keys in one pass; keys that a set lacks are null."""
    return df.groupingSets([[F.col(k) for k in x] for x in sets], *[F.col(k) for k in keys]).agg(*[c.alias(n) for n, c in aggregates.items()])


def union_distinct(*inputs: DataFrame) -> DataFrame:
    """Each row of any input once."""
    return union_all(*inputs).dropDuplicates()


def union_all(*inputs: DataFrame) -> DataFrame:
    """All rows of all inputs, by position, duplicates kept."""
    out = inputs[0]
    for d in inputs[1:]:
        out = out.union(d)
    return out


def split(df: DataFrame, **conditions: Column) -> dict[str, DataFrame]:
    """One output for each condition, and ``rest`` for rows that none holds for; a row goes to the first that does."""
    left = F.lit(True)
    out = {}
    for name, c in conditions.items():
        c = F.coalesce(c, F.lit(False))
        out[name] = df.where(left & c)
        left = left & ~c
    return out | {"rest": df.where(left)}


def replicate(df: DataFrame, n: int) -> tuple[DataFrame, ...]:
    """The same rows to n consumers, computed once: they read a table."""
    return (cut(df),) * n


def unnest(df: DataFrame, array: str | Column, name: str, outer: bool = False, position: str | None = None) -> DataFrame:
    """A row for each element; outer keeps rows of empty and null arrays."""
    if position:
        return df.select("*", (F.posexplode_outer if outer else F.posexplode)(array).alias(position, name))
    return df.withColumn(name, (F.explode_outer if outer else F.explode)(array))


def exists(df: DataFrame, inner: DataFrame, keys: Sequence[tuple[str, str]], negated: bool = False) -> DataFrame:
    """Rows that have (or lack) a match."""
    return equi_join(df, inner, keys, "left_anti" if negated else "left_semi")


# User operators.


def per_partition(df: DataFrame, make: Callable, schema: str) -> DataFrame:
    """make(partition number) gives a function from an iterator of pandas frames to one of them; it runs once a partition."""

    def run(frames):
        from pyspark import TaskContext

        yield from make(TaskContext.get().partitionId())(frames)

    return df.mapInPandas(run, schema)


def map_combine_reduce(df: DataFrame, mapper: Callable[[DataFrame], DataFrame], keys: Sequence[str], **reduce: Column) -> DataFrame:
    """A mapper, then aggregates that combine before the shuffle."""
    return group(mapper(df), keys, **reduce)


def script_pipe(df: DataFrame, command: str, sep: str = "\t") -> DataFrame:
    """Rows as delimited lines through an external command, one process a partition; its lines come back as ``line``."""
    from dagql.sources.sinks import delimited_line

    import shlex
    import subprocess
    import threading

    words = shlex.split(command)

    def run(batches):
        import pyarrow as pa

        p = subprocess.Popen(words, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, encoding="utf-8")

        def feed():
            with p.stdin:
                for b in batches:
                    for line in b.column("line").to_pylist():
                        p.stdin.write(line + "\n")

        t = threading.Thread(target=feed)
        t.start()
        held = []
        for line in p.stdout:
            held.append(line.rstrip("\n"))
            if len(held) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["line"])
                held = []
        t.join()
        if p.wait():
            raise RuntimeError(f"{command} ended with {p.returncode}")
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["line"])

    return delimited_line(df, sep=sep).mapInArrow(run, "line string")
