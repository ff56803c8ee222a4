"""Searches that indexes serve elsewhere: sorted files with statistics, space-filling order, token tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dagql.operators.relational import sent


def sorted_load(df: DataFrame, path: str, keys: Sequence[str], n: int | None = None, bloom: Sequence[str] = ()) -> None:
    """Bulk load: files that hold disjoint key ranges, sorted, so that bounds on keys skip files and row groups; with Bloom
    filters on the columns named, for point searches on them."""
    d = df.repartitionByRange(n, *keys) if n else df.repartitionByRange(*keys)
    w = d.sortWithinPartitions(*keys).write
    for c in bloom:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    w.parquet(path)


def _prefix(keys: Sequence[str], bound: Sequence, low: bool) -> Column:
    """keys >= bound (or <=), compared as tuples over the bound's length: a shorter bound is equal to all it begins."""
    out = F.lit(True)
    for k, v in reversed(list(zip(keys, bound, strict=False))):
        beyond = F.col(k) > v if low else F.col(k) < v
        out = beyond | ((F.col(k) == v) & out)
    return out


def range_search(df: DataFrame, keys: Sequence[str], low: Sequence = (), high: Sequence = ()) -> DataFrame:
    """Rows with low <= keys <= high, either bound a prefix of the keys; equal bounds are a point search. The first key's
    bounds stand alone too, for the scan to use."""
    cond = _prefix(keys, low, True) & _prefix(keys, high, False)
    if low:
        cond = (F.col(keys[0]) >= low[0]) & cond
    if high:
        cond = (F.col(keys[0]) <= high[0]) & cond
    return df.where(cond)


def box_search(df: DataFrame, mins: Sequence[str], maxes: Sequence[str], low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """All rows, repeated ones too, whose box meets the given box; borders count."""
    cond = F.lit(True)
    for a, b, x, y in zip(mins, maxes, low, high, strict=True):
        cond = cond & (F.col(a) <= y) & (F.col(b) >= x)
    return df.where(cond)


def box_join(left: DataFrame, right: DataFrame, a: Sequence[str], b: Sequence[str], cell: float) -> DataFrame:
    """Pairs of boxes (xmin, ymin, xmax, ymax) that meet: by the grid cells both touch, each pair once, in the cell of
    the lower corner of their intersection. A box stands in each cell it touches."""

    def cells(d: DataFrame, c: Sequence[str]) -> DataFrame:
        d = d.withColumn("__cx", F.explode(F.sequence(F.floor(F.col(c[0]) / cell), F.floor(F.col(c[2]) / cell))))
        return d.withColumn("__cy", F.explode(F.sequence(F.floor(F.col(c[1]) / cell), F.floor(F.col(c[3]) / cell))))

    d = cells(left, a).join(cells(right, b), ["__cx", "__cy"])
    meets = (F.col(a[0]) <= F.col(b[2])) & (F.col(a[2]) >= F.col(b[0])) & (F.col(a[1]) <= F.col(b[3])) & (F.col(a[3]) >= F.col(b[1]))
    own = (F.floor(F.greatest(a[0], b[0]) / cell) == F.col("__cx")) & (F.floor(F.greatest(a[1], b[1]) / cell) == F.col("__cy"))
    return d.where(meets & own).drop("__cx", "__cy")


def z_order(columns: Sequence[str], lows: Sequence[float], highs: Sequence[float], bits: int = 16) -> Column:
    """Position on the space-filling curve that interleaves the bits of the columns scaled to [low, high]."""
    scaled = [F.least(F.greatest(F.floor((F.col(c) - lo) / (hi - lo) * (1 << bits)), F.lit(0)), F.lit((1 << bits) - 1)).cast("long") for c, lo, hi in zip(columns, lows, highs, strict=True)]
    out = F.lit(0).cast("long")
    for bit in range(bits):
        for i, c in enumerate(scaled):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c, bit).bitwiseAND(F.lit(1)), bit * len(scaled) + i))
    return out


def spatial_load(df: DataFrame, path: str, columns: Sequence[str], lows: Sequence[float], highs: Sequence[float]) -> None:
    """Files along the curve, so that near rows share files and their statistics are narrow."""
    sorted_load(df.withColumn("z", z_order(columns, lows, highs)), path, ["z"])


def insert_new(df: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df and those rows whose keys it lacks; of rows with equal keys, one."""
    return df.union(rows.dropDuplicates(list(keys)).join(df.select(*keys), list(keys), "left_anti").select(*df.columns))


def delete(df: DataFrame, keys_to_go: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(keys_to_go.select(*keys), list(keys), "left_anti")


def upsert(df: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return delete(df, rows, keys).union(rows.select(*df.columns))


class Components:
    """A table of sorted components under one folder: each append is a component of its own, later ones win by key, and
    merging rewrites them as one. A null in ``deleted`` or no such column: the row stands."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, path, list(keys)

    def append(self, df: DataFrame, number: int) -> None:
        """number: larger than those before."""
        sorted_load(df, f"{self.path}/component={number}", self.keys)

    def read(self) -> DataFrame:
        """The latest row of each key, the deleted ones left out."""
        d = self.spark.read.option("mergeSchema", "true").parquet(self.path)
        columns = [c for c in d.columns if c not in (*self.keys, "component")]
        d = d.groupBy(*self.keys).agg(F.max_by(F.struct(*columns), "component").alias("row")).select(*self.keys, "row.*")
        return d.where(~F.coalesce(F.col("deleted"), F.lit(False))).drop("deleted") if "deleted" in columns else d

    def merge(self, path: str) -> Components:
        """All components as one, in a folder of its own; readers of the old one aren't disturbed."""
        new = Components(self.spark, path, self.keys)
        new.append(self.read(), 0)
        return new


def word_tokens(text: Column) -> Column:
    """Distinct lower-cased runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != ""))


def gram_tokens(text: Column, n: int = 3) -> Column:
    """Distinct substrings of n characters of the lower-cased text."""
    low = F.lower(text)
    return F.when(F.char_length(low) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(low) - n + 1), lambda i: F.substr(low, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def token_table(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """The inverted index: token and key, dealt by token."""
    return df.select(F.explode(tokens).alias("token"), F.col(key).alias("key"))


def keyed_search(df: DataFrame, key: str, tokens: Column, wanted: Sequence[str]) -> DataFrame:
    """The same without a stored index: keys of the rows that hold all of the wanted tokens, tested where the rows are read."""
    return df.where(F.forall(F.array(*[F.lit(w) for w in wanted]), lambda w: F.array_contains(tokens, w))).select(F.col(key).alias("key"))


def probe(keys: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Index nested loop: the rows of a loaded index for each of a few keys; the keys, if known to be few, go to the index."""
    return index.join(sent(keys.select(key)), key)


def search_all(index: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Keys that hold all of the wanted tokens."""
    wanted = sorted(set(wanted))
    return index.where(F.col("token").isin(wanted)).groupBy("key").agg(F.count_distinct("token").alias("n")).where(F.col("n") == len(wanted)).select("key")


def jaccard_join(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs (left_key, right_key, jaccard) of token sets at or above ``least``. Both sides: key, tokens (distinct).

    Prefix filter: of each set only the rarest tokens, so many that similar sets must share one, make candidate pairs;
    those are verified on the full sets.
    """
    both = left.select("tokens").union(right.select("tokens"))
    often = both.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("often"))

    def prefix(d: DataFrame, name: str) -> DataFrame:
        t = d.select("key", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).join(often, "token")
        t = t.groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("t"))
        head = F.slice("t", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int"))
        return t.select(F.col("key").alias(name), F.explode(head["token"]).alias("token"))

    pairs = prefix(left, "left_key").join(prefix(right, "right_key"), "token").select("left_key", "right_key").distinct()
    d = pairs.join(left.select(F.col("key").alias("left_key"), F.col("tokens").alias("a")), "left_key").join(right.select(F.col("key").alias("right_key"), F.col("tokens").alias("b")), "right_key")
    j = F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))
    return d.select("left_key", "right_key", j.alias("jaccard")).where(F.col("jaccard") >= least)
