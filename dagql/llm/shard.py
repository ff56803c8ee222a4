"""Sharding by longest-processing-time scheduling.

Groups that must stay together (here: equal texts) are sorted by size, largest first, and each goes to the shard
that is least loaded then, through a heap. Groups of one size are interchangeable, so the driver schedules size
classes: it gathers one row (size, number of groups) for each size, plays the heap over them, and sends back how
many groups of each size each shard gets; a group's rank within its class then names its shard. The result is that
of the plain schedule over all groups (but for the order named below), and no group is collected.

For groups of less than ``EXACT`` bytes in all (1 MB) a class is one size, so there are at most so many. Larger ones, mostly
texts with many copies, are classed by their leading 20 bits, at every input size: there are at most half a million
classes for each doubling beyond, and among groups that differ by less than 1 in half a million the order by size
isn't kept. Groups of a class are numbered by their hash.

Defined results: a null text has no bytes (size 1, checksum 0) and all null texts are one group, apart from the empty text's;
repeated rows stay together and each gets its own slot; of equal loads the smaller shard is taken; texts of any length
are read whole; an empty table gives an empty result; input columns other than id and text don't matter, and those kept
come back as they are, whatever their names. A hot group is never split: the law that groups stay together comes first.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dagql.llm.common import cut, number_in_order, table


def schedule(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """classes: (size, number of groups), any order. Gives (size, groups for each shard) as a heap would deal them."""
    heap = [(0, i) for i in range(shards)]
    out = []
    for size, n in sorted(classes, reverse=True):
        got = [0] * shards
        if n > 4 * shards and size > 0:  # the n smallest of load + k * size: all up to a level, then a few by the heap
            loads = dict((i, load) for load, i in heap)
            low, high = min(loads.values()) - 1, max(loads.values()) + size * n
            while low < high:  # the highest level with at most n
                mid = (low + high + 1) // 2
                if sum((mid - v) // size + 1 for v in loads.values() if v <= mid) <= n:
                    low = mid
                else:
                    high = mid - 1
            got = [max(0, (low - loads[i]) // size + 1) for i in range(shards)]
            heap = [(loads[i] + got[i] * size, i) for i in range(shards)]
            heapq.heapify(heap)
        for _ in range(n - sum(got)):
            load, i = heap[0]
            heapq.heapreplace(heap, (load + size, i))
            got[i] += 1
        out.append((size, got))
    return out


EXACT = 1 << 20


def size_class(size: Column, exact: int = EXACT) -> Column:
    """The size, with no more leading bits than the exact ones have."""
    bits = F.greatest(F.floor(F.log2(size.cast("double"))) - (exact.bit_length() - 2), F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", size, bits), bits)


def _spread(hex_digits: Column) -> Column:
    """A share from 0 to 1 that rises with hexadecimal digits."""
    return F.conv(F.substring(hex_digits, 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def lpt_shards(df: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep, size, text_crc32, shard and slot of each row; slot numbers a shard's rows from 0."""
    spark, keep = df.sparkSession, [doc_id] if keep is None else list(keep)
    raw = F.encode(F.col(text), "UTF-8")
    kept = [F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)]
    id_key = F.md5(F.concat_ws(":", F.col(doc_id).cast("string")).cast("binary"))
    rows = df.select(
        *kept, _spread(id_key).alias("__place"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("__bytes"),
        F.coalesce(F.crc32(raw), F.lit(0)).alias("__crc"), F.coalesce(F.sha2(raw, 256), F.lit("")).alias("__hex"),
    )
    rows = cut(rows.withColumns({"__bytes": F.col("__bytes") + 1, "__group": F.unhex("__hex")}).drop("__hex"))  # texts are read once
    groups = rows.groupBy("__group").agg(F.sum("__bytes").alias("__total"))
    groups = cut(groups.select("__group", size_class(F.col("__total")).alias("__class"), F.coalesce(_spread(F.hex("__group")), F.lit(0.0)).alias("__at")))
    classes = [(r[0], r[1]) for r in groups.groupBy("__class").count().collect()]
    dealt = [(size, [sum(got[: i + 1]) for i in range(shards)]) for size, got in schedule(classes, shards)]
    plan = spark.createDataFrame(dealt, "__class long, __upto array<long>")
    ranked = number_in_order(groups, "__at", ["__group"], "__rank", ["__class"])
    placed = ranked.join(plan, "__class").select("__group", F.size(F.filter("__upto", lambda x: x <= F.col("__rank"))).alias("__shard"))
    out = cut(rows.join(cut(placed), "__group").drop("__group"))
    out = number_in_order(out, "__place", ["__place", "__crc", "__bytes"], "__slot", ["__shard"])
    return out.select(
        *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], F.col("__bytes").alias("size"), F.col("__crc").alias("text_crc32"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot")
    )


def op6_shard(spark, sf_dir: str) -> DataFrame:
    """All documents over 16 shards of near equal bytes."""
    d = lpt_shards(table(spark, sf_dir, "documents"), 16)
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
