"""Benchmark decontamination: suffix arrays over shards of the training text, searched for every test suffix.

Each task takes its documents in shards of a bounded number of bytes. A shard's words become numbers of the test
vocabulary (0: in no test item); its suffixes, cut to ``window`` words and to words that the tests know, are sorted, and
every test suffix is looked up by binary search. The range it selects holds all its verbatim occurrences of ``window``
words or more. Of these, those that the suffix before doesn't cover already are extended, word by word, to the longest
match. A match has its item, the places in item and document, and its length; of one item and document, matches differ in
their diagonal, so a match is reported once. Nothing is shuffled; a document is judged in the task that reads it.

The tests are the side of bounded size: they come in blocks of at most ``block_words`` words, each block one pass over
the documents that adds its matches to those of the passes before it. After ``CHAIN`` passes the documents are written
with what was found, and the blocks before are let go, so any number of items is handled with the memory of so many blocks.

Words are those of ``WORD`` after A-Z to a-z. A window is ``window`` consecutive words of an item; an item of fewer,
but not none, is one window. Document words inside any occurrence of a window are hit: they are those of the matches.

Defined results: null and empty texts have no words and are never hit; items without words never occur; repeated rows
are judged alike, each giving its row; item ids that repeat count once, with the matches of each row; texts and items of any
length are read whole; ties don't arise, for all matches are given (by item, then place); input columns may have any
names, those kept come back as they are; with an empty test table nothing is hit; an empty table gives an empty
result. With ``unnamed`` (as in the query and the pipeline) items of a null id hit words as any other and are in no list of
ids; without it they take no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagql.llm.common import cut, forget, table, text_batches
from dagql.llm.words import WordHasher, shards

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(WORD)
_LOWER = {c: c + 32 for c in range(65, 91)}

_HASHER = WordHasher([b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)])


class TestSuffixes:
    """The windows of some test items, as numbers of their own vocabulary."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, list[str]]], window: int):
        self.window = window
        self.names = [name for name, _ in items]
        hashes = [_HASHER(np.frombuffer(" ".join(words).encode("utf-8", "surrogatepass"), np.uint8))[1] for _, words in items]
        self.vocabulary = np.unique(np.concatenate([*hashes, np.empty(0, np.uint64)]))
        self.ids = [np.searchsorted(self.vocabulary, h) + 1 for h in hashes]
        keys: dict[tuple, list] = {}
        for i, ids in enumerate(self.ids):
            n = min(window, len(ids))
            for s in range(len(ids) - n + 1 if n else 0):
                keys.setdefault(tuple(ids[s : s + n]), []).append((i, s))
        self.keys = sorted(keys.items())
        self.least = min((len(k) for k, _ in self.keys), default=0)
        low, high = np.zeros((len(self.keys), window), ">u4"), np.full((len(self.keys), window), 0xFFFFFFFF, ">u4")
        for row, (k, _) in enumerate(self.keys):
            low[row, : len(k)] = high[row, : len(k)] = k
        self.low, self.high = _as_keys(low), _as_keys(high)

    def search(self, ids: np.ndarray, room: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Key number and start words of its occurrences; room: how many words follow that the tests know, own included."""
        at = np.flatnonzero(room >= self.least) if self.least else np.empty(0, np.int64)
        if not len(at):
            return
        suffixes = np.zeros((len(at), self.window), ">u4")
        for k in range(self.window):
            longer = room[at] > k
            suffixes[longer, k] = ids[at[longer] + k]
        suffixes = _as_keys(suffixes)
        order = np.argsort(suffixes, kind="stable")
        array = suffixes[order]
        first, last = np.searchsorted(array, self.low, "left"), np.searchsorted(array, self.high, "right")
        for k in np.flatnonzero(last > first):
            yield int(k), at[order[first[k] : last[k]]]


def _as_keys(m: np.ndarray) -> np.ndarray:
    """Rows of numbers as byte strings that sort as the rows do."""
    return np.ascontiguousarray(m).view(f"S{m.shape[1] * 4}").ravel() if len(m) else np.empty(0, f"S{m.shape[1] * 4}")


def _search_shard(texts: list[bytes], tests: TestSuffixes) -> list[tuple[int, np.ndarray, list[tuple[int, int, int, int]]]]:
    """For each text: number of words, numbers of the hit words, longest matches (item, its word, the text's word, length)."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts, h = _HASHER(raw)
    cuts = np.concatenate([[0], np.searchsorted(starts, ends)])
    if not len(h) or not tests.keys:
        return [(int(b - a), np.empty(0, np.int64), []) for a, b in zip(cuts, cuts[1:], strict=False)]
    ids = np.minimum(np.searchsorted(tests.vocabulary, h), len(tests.vocabulary) - 1)
    ids = np.where(tests.vocabulary[ids] == h, ids + 1, 0)
    stop = np.full(len(ids) + 1, len(ids))  # where a run of words known to the tests, of one document, ends
    stop[:-1][ids == 0] = np.flatnonzero(ids == 0)
    nxt = np.minimum.accumulate(stop[::-1])[::-1][:-1]
    doc = np.searchsorted(cuts, np.arange(len(ids)), "right") - 1
    room = np.minimum(nxt, cuts[doc + 1]) - np.arange(len(ids))
    edge, found = np.zeros(len(ids) + 1, np.int64), [[] for _ in texts]
    for k, places in tests.search(ids, room):
        words, suffixes = tests.keys[k]
        for item, first in suffixes:
            own, at = tests.ids[item], places
            if first:  # not where the suffix before has the match
                at = at[(at == cuts[doc[at]]) | (ids[at - 1] != own[first - 1])]
            size = np.full(len(at), len(words))
            more = np.arange(len(at))
            while len(more):
                more = more[(size[more] < len(own) - first) & (size[more] < room[at[more]])]
                more = more[ids[at[more] + size[more]] == own[first + size[more]]]
                size[more] += 1
            np.add.at(edge, at, 1)
            np.add.at(edge, at + size, -1)
            for p, n in zip(at.tolist(), size.tolist(), strict=True):
                found[doc[p]].append((item, first, int(p - cuts[doc[p]]), n))
    hit = np.cumsum(edge[:-1]) > 0
    return [(int(b - a), np.flatnonzero(hit[a:b]), found[i]) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


#: Passes over the documents in one job, each with a block of test items.
CHAIN = 8
MATCHES = "array<struct<item:string,item_start:int,start:int,length:int>>"


def find_benchmark(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, block_words: int = 500_000, shard_bytes: int = 2_000_000, unnamed: bool = False) -> DataFrame:
    """keep, n_words, n_hit, items (sorted array of item ids as strings), contaminated and matches (the longest ones: item id,
    first word in the item and in the document, from 0, and number of words) of each document."""
    text_batches(docs.sparkSession)
    keep = list(docs.columns if keep is None else keep)
    d = docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], F.col(text).alias("__text"), F.lit(0).cast("long").alias("__n"), F.lit(None).cast("binary").alias("__hit"), F.array().cast(MATCHES).alias("__matches"))
    schema = d.schema

    def step(tests: TestSuffixes):
        def judge(before: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
            n, hits, matches = [], [], []
            for (words, hit, found), old, known in zip(_search_shard(texts, tests), before.column("__hit").to_pylist(), before.column("__matches").to_pylist(), strict=True):
                if old is not None and len(old):
                    hit = np.union1d(hit, np.frombuffer(old, "<i8"))
                n.append(words)
                hits.append(hit.astype("<i8").tobytes() if len(hit) else None)
                matches.append([*(known or ()), *({"item": tests.names[i], "item_start": s, "start": p, "length": k} for i, s, p, k in found)])
            new = {"__n": pa.array(n, pa.int64()), "__hit": pa.array(hits, pa.binary()), "__matches": pa.array(matches, before.schema.field("__matches").type)}
            return pa.RecordBatch.from_arrays([new.get(c, before.column(c)) for c in before.schema.names], names=before.schema.names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, texts in shards(batch.column("__text"), shard_bytes):
                    yield judge(batch.slice(first, len(texts)), texts)

        return run

    searched = items.select(F.col(item_id).cast("string"), F.col(item_text)).where(F.col(item_id).isNotNull() | F.lit(unnamed))
    passes, held = 0, None
    for block in _blocks(searched.toLocalIterator(), block_words):
        if passes and passes % CHAIN == 0:
            before, held = held, cut(d)
            d = held
            if before:
                forget(before)
        d = d.mapInArrow(step(TestSuffixes(block, window)), schema)
        passes += 1
    n_hit = F.coalesce(F.octet_length("__hit"), F.lit(0)).cast("long") / 8
    return d.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], F.col("__n").alias("n_words"), n_hit.cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.filter(F.transform("__matches", lambda m: m["item"]), lambda x: x.isNotNull()))).alias("items"), (n_hit > 0).alias("contaminated"), F.array_sort("__matches").alias("matches"))


def _blocks(rows: Iterator, block_words: int) -> Iterator[list[tuple[str | None, list[str]]]]:
    """Runs of (item id, words) of about so many words; at least one, which may be empty."""
    block: list[tuple[str | None, list[str]]] = []
    size, given = 0, False
    for name, t in rows:
        words = _WORD.findall((t or "").translate(_LOWER))
        if words:
            block.append((name, words))
            size += len(words)
        if size >= block_words:
            yield block
            block, size, given = [], 0, True
    if block or not given:
        yield block


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """What of the benchmark each document holds, by windows of 10 words; n_matches and longest tell of the longest matches."""
    d = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10, keep=["doc_id"], unnamed=True)
    return d.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated", F.size("matches").cast("long").alias("n_matches"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["length"])), F.lit(0)).cast("long").alias("longest"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, row_number() OVER () AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, item, least(len(w), 10) AS l, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s, w FROM b WHERE len(w) > 0),
bk AS (SELECT item_id, item, s AS item_s, l, array_to_string(w[s : s + l - 1], ' ') AS k FROM bw),
ls AS (SELECT DISTINCT l FROM bk),
dp AS (SELECT doc_id, l, w, unnest(range(1, len(w) - l + 2)) AS s FROM d, ls WHERE len(w) >= l),
dk AS (SELECT doc_id, l, s, array_to_string(w[s : s + l - 1], ' ') AS k FROM dp),
hits AS (SELECT doc_id, s, dk.l, item_id, item, item_s FROM dk JOIN bk ON dk.k = bk.k AND dk.l = bk.l),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + l)) AS p FROM hits) GROUP BY doc_id),
runs AS (SELECT doc_id, item, s, l, s - item_s AS diagonal, s - row_number() OVER (PARTITION BY doc_id, item, s - item_s ORDER BY s) AS run FROM hits),
longs AS (SELECT doc_id, count(*) AS n, max(words) AS longest FROM (SELECT doc_id, count(*) + min(l) - 1 AS words FROM runs GROUP BY doc_id, item, diagonal, run) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated,
  CAST(coalesce(longs.n, 0) AS BIGINT) AS n_matches, CAST(coalesce(longs.longest, 0) AS BIGINT) AS longest
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN longs ON longs.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""
