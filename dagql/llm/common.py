"""Shared pieces of the training-data operators: reading, cutting lineage, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dagql.tables import cut, forget, release, shared_folder

__all__ = ["cut", "forget", "release", "shared_folder"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark (the folder may be on any store that Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts go to Python workers in batches of at most so many rows from here on (a setting of the session; a smaller one
    stays): a batch is held several times over, by the JVM and the worker, and texts are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, all else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Rows that one task numbers, about; and parts that there are at least.
ROWS_NUMBERED, LEAST_PARTS = 100_000, 64


def number_in_order(df: DataFrame, place: str, order: list[str], out: str, keys: list[str] = ()) -> DataFrame:
    """df, read from a table, with gapless numbers from 0 within keys by the order columns, without one task holding a whole key.

    place: a double from 0 to 1 that rises with the order and is evenly spread. It is cut into as many parts as the
    rows need; a number is the rank within the part plus the sizes of the parts before it, of which one row for each
    key and part is gathered. Equal rows get different numbers, in any order."""
    parts = max(LEAST_PARTS, -(-df.count() // ROWS_NUMBERED))
    d = df.withColumn("__part", F.least(F.floor(F.col(place) * parts), F.lit(parts - 1)).cast("int"))
    sizes = d.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    sizes = cut(sizes.select(*[F.col(k).alias(f"__s{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), F.coalesce(before, F.lit(0)).alias("__before")))
    d = d.withColumn("__rank", F.row_number().over(W.partitionBy(*keys, "__part").orderBy(*order)))
    on = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"__s{i}"))
    return d.join(sizes, on).withColumn(out, (F.col("__rank") - 1 + F.col("__before")).cast("long")).select(*df.columns, out)
