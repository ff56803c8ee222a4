"""Removal of repeated strings by bucket-pointer refinement.

Every string of ``length`` items (bytes, or words) that starts at two places or more, in any documents, is found, and each
item that one covers is marked or removed. Only the buckets of suffixes that agree in their first ``length`` items are
asked for, so refinement ends at that depth:

1. Initial q-gram buckets. Each string of ``length`` items points to one q-gram in it, the smallest by a fixed order, so
   equal strings point to equal q-grams at equal offsets. Some 0.6 % of all byte positions are such anchors. An anchor alone
   in its bucket settles all strings that point to it: none repeats. An anchor's span is all that these strings cover; of
   equal spans, which settle each other, one stands for all in what follows.
2. Refinement. Within the bucket of an anchor, all positions of its spans start in the buckets of their own q-grams.
   Positions are sorted by the identifiers of their bucket and of the bucket at the offset that their depth has reached,
   which doubles the depth; the new identifiers are used at the later offsets of the next pass, until ``length`` is
   reached. Positions alone in their bucket are settled and sorted no more.
3. Anchor buckets of many spans are not held in one task: their positions are refined by the same doubling with
   identifiers that agree in all tasks (64-bit mixes of the two), and the last ones are counted by key.

q-grams and spans are named by 64-bit numbers. All counts over the corpus are sums by key with partial aggregates. What
texts need is sent to them if it is small; else the texts travel, packed, once for the spans and once for the result.

Defined results: null and empty texts have no items and lose none; texts shorter than ``length`` lose none; a repeated row
is elsewhere, so both lose all that is long enough; texts of any length are read whole; ties of equal q-grams go to the
first in the string, which is the same in equal strings; input columns other than id and text don't matter, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dagql.llm.ann import sorted_groups
from dagql.llm.common import cut, forget, release, table, text_batches
from dagql.llm.words import WordHasher, mix, shards

#: Buckets of at most so many spans are refined within a task; the windows of larger ones are counted by key.
SPANS_AT_ONCE = 2048
#: Side tables of at most so many entries are sent to each executor (under 64 MB); more are joined by a shuffle.
ENTRIES_SENT = 1_500_000
_P, _STEP = np.uint64(0xD1342543DE82EF95), np.uint64(0x9E3779B97F4A7C15)


class Hashes:
    """Numbers of all strings of a row of items, which are 64-bit numbers themselves."""

    powers = np.ones(1, np.uint64)
    inverse = np.ones(1, np.uint64)

    def __init__(self, items: np.ndarray):
        n = len(items)
        if len(Hashes.powers) < n:
            Hashes.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _P)]), dtype=np.uint64)
            Hashes.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(int(_P), -1, 1 << 64)))]), dtype=np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(items * Hashes.powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * Hashes.inverse[start])

    def each(self, size: int) -> np.ndarray:
        """Of the string of that size at every position where one fits."""
        n = max(0, len(self.sums) - size)
        return mix((self.sums[size:] - self.sums[:n]) * Hashes.inverse[:n])


class Bytes:
    """Texts as rows of bytes. length: of the strings asked for; q: of the first buckets."""

    def __init__(self, length: int = 400, q: int = 64):
        self.length, self.q = length, min(q, length)
        self.number = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)

    def items(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the items of all texts, and how many each has."""
        return self.number[np.frombuffer(b"".join(texts), np.uint8)], np.array([len(t) for t in texts], np.int64)

    def parts(self, text: bytes, runs: list[tuple[int, int]]) -> list[bytes]:
        """What of the text holds its items from each first to before each end."""
        return [text[a:e] for a, e in runs]


class Words:
    """Texts as rows of words between ASCII white space, A-Z as a-z."""

    def __init__(self, length: int = 50, q: int = 8):
        self.length, self.q = length, min(q, length)
        self.hasher = WordHasher([9, 10, 11, 12, 13, 32])

    def items(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        starts, h = self.hasher(np.frombuffer(b" ".join(texts) + b" ", np.uint8))
        upto = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
        return h, np.diff(upto, prepend=0)

    def parts(self, text: bytes, runs: list[tuple[int, int]]) -> list[bytes]:
        starts = np.append(self.hasher(np.frombuffer(text, np.uint8))[0], len(text))
        return [text[starts[a] : starts[e]] for a, e in runs]


def anchors(texts: list[bytes], unit: Bytes | Words) -> tuple[np.ndarray, ...]:
    """Text number, first and last start of the strings (within the text), number of the q-gram, and of the span, of
    each anchor."""
    length, q = unit.length, unit.q
    items, sizes = unit.items(texts)
    if not len(items) or sizes.max() < length:
        return tuple(np.empty(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    h = Hashes(items)
    grams = h.each(q)
    at = np.uint64((1 << max(24, len(items).bit_length())) - 1)
    width = length - q + 1
    best = (grams & ~at) | np.arange(len(grams), dtype=np.uint64)
    step = 1
    while step * 2 <= width:
        best = np.minimum(best[: len(best) - step], best[step:])
        step *= 2
    if width > step:
        best = np.minimum(best[: len(best) - (width - step)], best[width - step :])
    fits = np.zeros(len(items) + 1, np.int64)  # where a string of one text starts
    long = sizes >= length
    fits[begin[:-1][long]] += 1
    fits[begin[1:][long] - length + 1] -= 1
    starts = np.flatnonzero(np.cumsum(fits[:-1]))
    anchor = (best[starts] & at).astype(np.int64)
    text = np.searchsorted(begin, starts, "right") - 1
    new = np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(text) != 0)])
    first = starts[new]
    last = starts[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])]
    a, text = anchor[new], text[new]
    span = mix(h.of(first, last + length) + (a - first).astype(np.uint64) * _STEP + (last - a + length).astype(np.uint64))
    return text, first - begin[text], last - begin[text], grams[a], span


def deeper(depth: int, length: int) -> Iterator[tuple[int, int]]:
    """Offset and new depth of each pass of refinement."""
    while depth < length:
        offset = min(depth, length - depth)
        depth += offset
        yield offset, depth


def refine(spans: list[bytes], unit: Bytes | Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Span number, offset within the span, and whether it starts elsewhere too, of every string of ``length`` items of the
    spans, by bucket-pointer refinement."""
    items, sizes = unit.items(spans)
    ends = np.repeat(np.cumsum(sizes), sizes)
    room = ends - np.arange(len(items))
    grams = Hashes(items).each(unit.q)
    at = np.flatnonzero(room >= unit.q)
    bucket = np.zeros(len(items), np.int64)
    pending = np.zeros(len(items), bool)
    names, bucket[at], count = np.unique(grams[at], return_inverse=True, return_counts=True)
    pending[at] = count[bucket[at]] > 1
    used = len(names)
    for offset, depth in deeper(unit.q, unit.length):
        at = np.flatnonzero(pending & (room >= depth))
        _, new, count = np.unique(bucket[at] * used + bucket[at + offset], return_inverse=True, return_counts=True)
        bucket[at] = used + new  # a sole member keeps its identifier: no other bucket has it
        pending[at] = count[new] > 1
        used += len(count)
    start = np.flatnonzero(room >= unit.length)
    span = np.repeat(np.arange(len(spans)), sizes)[start]
    return span, start - (np.cumsum(sizes) - sizes)[span], pending[start]


def identifiers(spans: list[bytes], unit: Bytes | Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Span number, offset within the span and identifier of every string of ``length`` items of the spans; identifiers are made
    from those of half the depth and agree in all tasks."""
    items, sizes = unit.items(spans)
    name = Hashes(items).each(unit.q)
    for offset, depth in deeper(unit.q, unit.length):
        name = mix(name[: len(name) - offset] * _P + mix(name[offset:]) + np.uint64(depth))
    counts = sizes - unit.length + 1
    start = np.repeat(np.cumsum(sizes) - sizes, counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(np.arange(len(spans)), counts), offset, name[start + offset]


def _anchors(unit: Bytes | Words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = (b.column(k).to_numpy() for k in ("a", "c"))
            for first, texts in shards(b.column("t"), 500_000):
                text, start, end, gram, span = anchors(texts, unit)
                row = first + text
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[row], c[row], start * unit.length + (end - start), gram.view(np.int64), span.view(np.int64))], names=["a", "c", "at", "gram", "span"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts t as zstandard frames, for a shuffle."""
    coder = zstandard.ZstdCompressor(level=1)
    for b in batches:
        raw = [None if t is None else coder.compress(t) for t in b.column("t").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()) if k == "t" else b.column(k) for k in b.schema.names], names=b.schema.names)


def _meet(texts: DataFrame, side: DataFrame, entries: int, how: str) -> tuple[DataFrame, Callable]:
    """texts (a, c, t binary, ...) with what side has of their keys, and how to read t: as it is where the side is small and
    is sent to the texts; else both are shuffled, the texts packed."""
    if entries <= ENTRIES_SENT:
        return texts.join(F.broadcast(side), ["a", "c"], how), lambda t: t or b""
    return texts.mapInArrow(_pack, texts.schema).join(side, ["a", "c"], how), lambda t: zstandard.ZstdDecompressor().decompress(t) if t else b""


def _spans(unit: Bytes | Words, read: Callable):
    """The spans asked for: rows (a, c, t, asked); asked holds (at, gram, single)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for a, c, t, asked in zip(*(b.column(k).to_pylist() for k in ("a", "c", "t", "asked")), strict=True):
                at = [divmod(x["at"], unit.length) for x in asked]
                parts = unit.parts(read(t), [(first, first + more + unit.length) for first, more in at])
                rows += [(x["gram"], a, c, first, x["single"], raw) for x, (first, _), raw in zip(asked, at, parts, strict=True)]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["gram", "a", "c", "first", "single", "raw"])

    return run


def _refine(unit: Bytes | Words):
    """Rows (gram, a, c, first, single, raw) sorted by gram: the intervals of items under repeated strings of single spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ["gram"]):
            a, c, first, single = (t.column(k).to_numpy(zero_copy_only=False) for k in ("a", "c", "first", "single"))
            span, offset, again = refine(t.column("raw").to_pylist(), unit)
            hit = np.flatnonzero(again & single[span])
            if not len(hit):
                continue
            s, o = span[hit], offset[hit]
            new = np.flatnonzero((np.diff(s, prepend=-1) != 0) | (np.diff(o, prepend=-1) != 1))
            end = np.append(new[1:], len(hit)) - 1
            s = s[new]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[s], c[s], first[s] + o[new], first[s] + o[end] + unit.length)], names=["a", "c", "from", "to"])

    return run


def _identifiers(unit: Bytes | Words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in (b.slice(at, 2048) for at in range(0, b.num_rows, 2048)):
                span, offset, h = identifiers(p.column("raw").to_pylist(), unit)
                a, c, first, gram, single = (p.column(k).to_numpy(zero_copy_only=False)[span] for k in ("a", "c", "first", "gram", "single"))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram, h.view(np.int64), a, c, first + offset, single)], names=["gram", "h", "a", "c", "start", "single"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins overlapping and touching intervals of each row's array x."""
    for b in batches:
        for p in (b.slice(at, 512) for at in range(0, b.num_rows, 512)):
            out = []
            for x in p.column("x").to_pylist():
                merged: list[list[int]] = []
                for i in sorted((v["from"], v["to"]) for v in x):
                    if merged and i[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], i[1])
                    else:
                        merged.append(list(i))
                out.append([v for i in merged for v in i])
            yield pa.RecordBatch.from_arrays([p.column("a"), p.column("c"), pa.array(out, pa.list_(pa.int64()))], names=["a", "c", "cover"])


def _entries(df: DataFrame, array: str) -> int:
    return df.agg(F.coalesce(F.sum(F.size(array) + 2), F.lit(0))).first()[0]


def find_repeats(docs: DataFrame, unit: Bytes | Words, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(a, c, cover): the flat list of borders (from, to) of the runs of items that repeated strings cover, for the texts that have
    any. a and c are the text's ``keys``; rows of equal id and text share them and their cover."""
    text_batches(docs.sparkSession)
    length = unit.length
    d = docs.select(*keys(doc_id, text), F.col(text).alias("s")).where(F.octet_length("s") >= length)
    t = d.select("a", "c", F.encode("s", "UTF-8").alias("t"))
    found = cut(d.withColumnRenamed("s", "t").mapInArrow(_anchors(unit), "a long, c int, at long, gram long, span long"))
    who = F.xxhash64("a", "c", "at")
    spans = found.groupBy("gram", "span").agg(F.count(F.lit(1)).alias("n"), F.min(who).alias("who"))
    grams = spans.groupBy("gram").agg(F.count(F.lit(1)).alias("spans"), F.sum("n").alias("all")).where(F.col("all") > 1).drop("all")
    shared = cut(spans.join(grams, "gram"))
    placed = found.join(shared, ["gram", "span"])
    placed = cut(placed.select("a", "c", "at", "gram", "spans", (F.col("n") == 1).alias("single"), (F.col("who") == who).alias("stands")))
    forget(found, shared)
    release(docs.sparkSession)
    first, last = F.floor(F.col("at") / length), F.floor(F.col("at") / length) + F.col("at") % length
    cover = placed.where("NOT single").select("a", "c", first.alias("from"), (last + length).alias("to"))

    def asked(large: bool) -> DataFrame:
        """The anchors of buckets of several spans by text; of equal spans, one stands for all."""
        d = placed.where((F.col("spans") > SPANS_AT_ONCE) if large else F.col("spans").between(2, SPANS_AT_ONCE)).where("single OR stands")
        return cut(d.groupBy("a", "c").agg(F.collect_list(F.struct("at", "gram", "single")).alias("asked")))

    def raw(side: DataFrame) -> DataFrame:
        d, read = _meet(t, side, _entries(side, "asked"), "inner")
        return d.mapInArrow(_spans(unit, read), "gram long, a long, c int, first long, single boolean, raw binary")

    side = asked(False)
    few = raw(side).repartition("gram").sortWithinPartitions("gram")
    few = cut(few.mapInArrow(_refine(unit), "a long, c int, from long, to long"))
    cover = cover.union(few)
    forget(side)
    side = asked(True)
    if not side.isEmpty():
        many = cut(raw(side).mapInArrow(_identifiers(unit), "gram long, h long, a long, c int, start long, single boolean"))
        twice = cut(many.groupBy("gram", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
        cover = cover.union(many.where("single").join(twice, ["gram", "h"]).select("a", "c", F.col("start").alias("from"), (F.col("start") + length).alias("to")))
    cover = cover.groupBy("a", "c").agg(F.collect_list(F.struct("from", "to")).alias("x"))
    out = cut(cover.mapInArrow(_merge, "a long, c int, cover array<long>"))
    forget(placed, few, side)
    release(docs.sparkSession)
    return out


def keys(doc_id: str, text: str) -> list[Column]:
    return [F.xxhash64(doc_id, text).alias("a"), F.hash(text, doc_id).alias("c")]


def remove_repeats(docs: DataFrame, length: int = 400, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, passage_words: int | None = None) -> DataFrame:
    """keep, kept (the remaining bytes), n_bytes, n_removed, n_spans and cover of each row. With ``passage_words`` also passages:
    the borders of the runs of words that repeated strings of so many words cover, which are marked, not removed."""
    keep = [doc_id] if keep is None else list(keep)
    cover = find_repeats(docs, Bytes(length), text, doc_id)
    d = docs.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keep)], *keys(doc_id, text), F.encode(text, "UTF-8").alias("t"))
    d, read = _meet(d, cover, _entries(cover, "cover"), "left")
    if not passage_words:
        d = d.drop("a", "c")
    kept = d.drop("t", "cover").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in (b.slice(at, 512) for at in range(0, b.num_rows, 512)):
                rest, size, removed = [], [], []
                for t, x in zip(p.column("t").to_pylist(), p.column("cover").to_pylist(), strict=True):
                    raw = read(t)
                    ends = [0, *(x or ()), len(raw)]
                    rest.append(b"".join(raw[i:j] for i, j in zip(ends[::2], ends[1::2], strict=True)))
                    size.append(len(raw))
                    removed.append(x or [])
                yield pa.RecordBatch.from_arrays(
                    [*(p.column(f.name) for f in kept), pa.array(rest, pa.binary()), pa.array(size, pa.int64()), pa.array(removed, pa.list_(pa.int64()))], names=[*kept.names, "kept", "n_bytes", "cover"]
                )

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "kept binary, n_bytes long, cover array<long>"])
    out = d.mapInArrow(run, schema)
    more = []
    if passage_words:
        passages = find_repeats(docs, Words(passage_words), text, doc_id).withColumnRenamed("cover", "__passages")
        small = _entries(passages, "__passages") <= ENTRIES_SENT
        out = out.join(F.broadcast(passages) if small else passages, ["a", "c"], "left")
        more = [F.coalesce("__passages", F.array().cast("array<long>")).alias("passages")]
    return out.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keep)], "kept", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), (F.size("cover") / 2).cast("long").alias("n_spans"), "cover", *more)


def op7_substrings(spark, sf_dir: str) -> DataFrame:
    """What stays of every document once all repeated strings of 400 bytes are removed, and how many of its words lie in
    passages of 50 words or more that repeat (``n_passage_words``, in ``n_passages`` runs)."""
    d = remove_repeats(table(spark, sf_dir, "documents"), 400, passage_words=50)
    borders = F.col("passages")
    words = F.aggregate(F.transform(borders, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda s, x: s + x)
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), words.alias("n_passage_words"), (F.size(borders) / 2).cast("long").alias("n_passages"))


SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, s, md5(array_slice(t, s + 1, s + 400)) AS m FROM (SELECT doc_id, t, unnest(range(0, octet_length(t) - 399)) AS s FROM d WHERE octet_length(t) >= 400)),
h AS (SELECT doc_id, s FROM k WHERE m IN (SELECT m FROM k GROUP BY m HAVING count(*) > 1)),
n AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 400 THEN 0 ELSE 1 END AS new FROM h),
r AS (SELECT doc_id, min(s) AS a, max(s) + 400 AS e FROM (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM n) GROUP BY doc_id, run),
x AS (SELECT doc_id, list(a ORDER BY a) || [NULL] AS a, [0] || list(e ORDER BY a) AS e, sum(e - a) AS n, count(*) AS c FROM r GROUP BY doc_id),
pk AS (SELECT doc_id, s, array_to_string(w[s + 1 : s + 50], ' ') AS m FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS s FROM d WHERE len(w) >= 50)),
ph AS (SELECT doc_id, s FROM pk WHERE m IN (SELECT m FROM pk GROUP BY m HAVING count(*) > 1)),
pn AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS new FROM ph),
pr AS (SELECT doc_id, max(s) + 50 - min(s) AS n FROM (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM pn) GROUP BY doc_id, run),
p AS (SELECT doc_id, sum(n) AS n, count(*) AS c FROM pr GROUP BY doc_id)
SELECT d.doc_id, octet_length(t) AS n_bytes, CAST(coalesce(x.n, 0) AS BIGINT) AS n_removed, coalesce(x.c, 0) AS n_spans,
  CASE WHEN x.n IS NULL THEN sha256(t) ELSE sha256(unhex(array_to_string(list_transform(range(1, len(a) + 1), lambda i: hex(array_slice(t, e[i] + 1, coalesce(a[i], octet_length(t))))), ''))) END AS kept_sha256,
  CAST(coalesce(p.n, 0) AS BIGINT) AS n_passage_words, coalesce(p.c, 0) AS n_passages
FROM d LEFT JOIN x ON x.doc_id = d.doc_id LEFT JOIN p ON p.doc_id = d.doc_id
"""
