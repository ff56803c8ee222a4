"""Approximate nearest neighbours by inner product, with a forest of hash prefixes.

The rows are dealt over shards of at most about ``SHARD`` vectors. A shard keeps ``TREES`` sorted arrays of long hash
strings (signs of ``BITS`` random projections). A query descends in every tree to its longest matching prefix, whose length
varies with how densely the vectors lie there; then all trees ascend together, one bit at a time, until the ranges under
the prefix hold ``BUDGET`` entries in all. What lies in the ranges is scored exactly, in double precision. In clusters the
trees find the same entries, so that few are scored; among random directions they differ. Queries come in blocks, each block to each shard; the best of the
shards are merged.

Inner products are turned into angles first: vectors get one more component, so that all are as long as the longest
(Neyshabur and Srebro, 2015); a query's is 0. Where lengths differ much, that component turns all vectors away from the
query, so a shard is cut into bands of lengths within a factor of ``SPREAD``, and each band that holds more than
``BUDGET`` vectors has a forest and the budget of its own. All vectors of the smaller bands are scored.

Equal vectors are one entry with its smallest ids, as many as a result may need, so that a vector that a third of the
rows share costs no more than another, and every result is as if each row had been searched.

Defined results: vectors that are null, empty or zero, that hold null or non-finite components, or whose length isn't
the most frequent one (ties: the longer) take no part, nor do rows of a null id; input columns other than id and vector don't
matter, whatever their names; rows of one id and vector count once, and a
query's own rows are all those of its id; ties go to the smaller id; with fewer candidates than k, all are given; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dagql.llm.common import cut, table

SHARD, QUERIES, TREES, BITS, BUDGET, SEED = 8192, 8192, 128, 64, 3000, 11
SPREAD = 1.02


class Forest:
    """vectors: one row each, all of one length."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        self.vectors = vectors.astype(np.float64)
        squares = (self.vectors**2).sum(1)
        lift = np.sqrt(np.maximum(squares.max(initial=0.0) - squares, 0.0))[:, None]
        self.bits, self.trees = bits, trees
        self.planes = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, trees * bits)).astype(np.float32)
        strings = self._strings(np.hstack([self.vectors, lift]))
        self.order = np.argsort(strings, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.take_along_axis(strings.T, self.order, 1)

    def _strings(self, lifted: np.ndarray) -> np.ndarray:
        """A number of ``bits`` bits, the first the highest, for each row and tree."""
        out = np.empty((len(lifted), self.trees), np.uint64)
        for a in range(0, len(lifted), 256):
            signs = (lifted[a : a + 256].astype(np.float32) @ self.planes > 0).reshape(-1, self.trees, self.bits)
            signs = np.concatenate([np.zeros((*signs.shape[:2], 64 - self.bits), bool), signs], 2)
            out[a : a + 256] = np.packbits(signs, axis=2).view(">u8")[:, :, 0]
        return out

    def candidates(self, queries: np.ndarray, budget: int) -> Iterator[np.ndarray]:
        """Entry numbers for each query."""
        strings = self._strings(np.hstack([queries, np.zeros((len(queries), 1))]))
        n, shape = len(self.vectors), (len(queries), self.trees)
        first, last = np.zeros(shape, np.int32), np.full(shape, n, np.int32)
        lo, hi = np.empty(shape, np.int32), np.empty(shape, np.int32)
        # the longest prefix with enough entries, where the trees' common ascent ends: entries only grow on the way up
        least, most = np.zeros(len(queries), np.int64), np.full(len(queries), self.bits + 1)
        while (most - least > 1).any():
            kept = (least + most) // 2
            below = (np.uint64(1) << (self.bits - kept).astype(np.uint64)) - np.uint64(1)
            for t in range(self.trees):
                prefix = strings[:, t] & ~below
                lo[:, t] = np.searchsorted(self.sorted[t], prefix)
                hi[:, t] = np.searchsorted(self.sorted[t], prefix | below, "right")
            enough = ((hi - lo).sum(1) >= budget) & (kept > least)
            first[enough], last[enough] = lo[enough], hi[enough]
            least, most = np.where(enough, kept, least), np.where(enough, most, np.maximum(kept, least + 1))
        for q in range(len(queries)):  # without enough under any prefix, all
            mark = np.zeros(n, bool)
            for t in range(self.trees):
                mark[self.order[t, first[q, t] : last[q, t]]] = True
            yield np.flatnonzero(mark)

    def nearest(self, queries: np.ndarray, ids: np.ndarray, k: int, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Entry numbers and inner products of the k best candidates of each query; ties by ids."""
        queries = queries.astype(np.float64)
        for a in range(0, len(queries), 256):
            block = queries[a : a + 256]
            for q, at in zip(block, self.candidates(block, budget), strict=True):
                yield best_of(at, np.einsum("ij,j->i", self.vectors[at], q), ids, k)


def best_of(at: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of the entries ``at``; ties by ids."""
    if len(at) > 4 * k:
        near = score >= np.partition(score, len(at) - k)[len(at) - k]
        at, score = at[near], score[near]
    best = np.lexsort((ids[at], -score))[:k]
    return at[best], score[best]


def exactly(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed from the first component to the last, so that they don't depend on how rows are batched."""
    return np.cumsum(vectors.astype(np.float64) * query, axis=1)[:, -1]


def bands(vectors: np.ndarray, spread: float = SPREAD) -> Iterator[np.ndarray]:
    """Entry numbers of each band of lengths, the longest vectors first; within one, lengths differ by at most the factor."""
    most = np.abs(vectors).max(1)
    depth = -(np.log(most) + np.log(((vectors / most[:, None]) ** 2).sum(1)) / 2)  # so that no square is 0 or infinite
    order = np.argsort(depth, kind="stable")
    depth = depth[order]
    a = 0
    while a < len(order):
        e = int(np.searchsorted(depth, depth[a] + np.log(spread), "right"))
        yield order[a:e]
        a = e


class Bands:
    """Nonzero vectors of any lengths: forests over the bands of more than ``budget`` vectors, the rest scored whole."""

    def __init__(self, vectors: np.ndarray, budget: int = BUDGET):
        self.budget = budget
        vectors = vectors.astype(np.float64)
        parts = list(bands(vectors))
        self.forests = [(p, Forest(vectors[p])) for p in (np.sort(p) for p in parts if len(p) > budget)]
        self.whole = np.sort(np.concatenate([np.empty(0, np.int64), *(p for p in parts if len(p) <= budget)]))
        self.rest = vectors[self.whole]

    def nearest(self, queries: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As those of a forest, over all bands."""
        found = [f.nearest(queries, ids[p], k, self.budget) for p, f in self.forests]
        for q in queries.astype(np.float64):
            each = [best_of(self.whole, np.einsum("ij,j->i", self.rest, q), ids, k)]
            for (p, _), f in zip(self.forests, found, strict=True):
                at, score = next(f)
                each.append((p[at], score))
            yield best_of(*(np.concatenate(x) for x in zip(*each, strict=True)), ids, k)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys in batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in keys])
        ends = [*(np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(0)) + 1), b.num_rows]
        a = 0
        for e in ends:
            if held and last != tuple(cols[:, a]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, e - a))
            last = tuple(cols[:, a])
            a = e
    if held:
        yield pa.Table.from_batches(held)


def _search(k: int, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ["shard", "block"]):
            asks = t.column("asks").to_numpy()
            gid, least = t.column("gid").to_numpy(), t.column("least").to_numpy()
            flat = t.column("v").combine_chunks()
            x = np.asarray(flat.flatten(), dtype=np.float64).reshape(len(asks), -1)
            if not asks.any() or asks.all():
                continue
            own, q = np.flatnonzero(~asks), np.flatnonzero(asks)
            entries, ids = gid[own], least[own]
            mine = x[own]
            found = [(at, exactly(mine[at], v)) for (at, _), v in zip(Bands(mine, budget).nearest(x[q], ids, k), x[q], strict=True)]
            at, score = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            asked = np.repeat(gid[q], [len(f[0]) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(entries[at]), pa.array(score)], names=["asked", "gid", "score"])

    return run


def search(df: DataFrame, asks: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", budget: int = BUDGET) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found of each row that asks."""
    v = F.col("v")
    d = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"), asks.alias("asks")).where("id IS NOT NULL AND v IS NOT NULL")
    d = d.where(F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)).withColumn("v", v.cast("array<float>") if dict(df.dtypes)[vector] == "array<float>" else v.cast("array<double>"))
    sizes = d.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    d = d.where(F.size("v") == (sizes[0]["n"] if sizes else 0))
    # equal vectors are one entry; its k + 1 smallest ids are all that a result can hold, the query's own included
    ranked = d.select("id", "v").dropDuplicates().withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    entries = cut(ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("gid", F.monotonically_increasing_id()))
    queries = d.where("asks").select("id", "v").dropDuplicates().join(entries.select("v", "gid"), "v").select(F.col("id").alias("query_id"), F.col("gid").alias("asked"))
    queries = cut(queries)
    asked = queries.select(F.col("asked").alias("gid")).distinct()
    shards = max(1, -(-entries.count() // SHARD))
    blocks = max(1, -(-asked.count() // QUERIES))

    def part(n: int, seed: int) -> Column:
        return F.pmod(F.xxhash64("gid", F.lit(seed)), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    e = entries.select("gid", F.col("ids")[0].alias("least"), "v")
    rows = e.select(part(shards, 1).alias("shard"), every(blocks).alias("block"), F.lit(False).alias("asks"), "gid", "least", "v")
    rows = rows.union(e.join(asked, "gid", "left_semi").select(every(shards).alias("shard"), part(blocks, 2).alias("block"), F.lit(True).alias("asks"), "gid", "least", "v"))
    rows = rows.repartition("shard", "block").sortWithinPartitions("shard", "block")
    found = rows.mapInArrow(_search(k + 1, budget), "asked long, gid long, score double").join(e.select("gid", "least"), "gid")
    best = found.withColumn("n", F.row_number().over(W.partitionBy("asked").orderBy(F.desc("score"), "least"))).where(F.col("n") <= k + 1).drop("n", "least")
    best = best.join(entries.select("gid", F.explode("ids").alias("vec_id")), "gid")
    best = best.withColumn("n", F.row_number().over(W.partitionBy("asked").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1).select("asked", "score", "vec_id")
    out = queries.join(best, "asked").where("vec_id <> query_id")
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def op2_ann(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


#: All pairs of queries and rows: what the search gives where a shard's vectors are no more than the budget.
SQL = """
WITH v AS (SELECT DISTINCT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.embedding) + 1), lambda i: CAST(q.embedding[i] AS DOUBLE) * CAST(c.embedding[i] AS DOUBLE)), lambda x, y: x + y) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 20
"""
