"""The registered queries that SQL can't express, against brute force on a table of odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dagql.llm import entries
from tests.llm.test_operators import edited, heap_by_hand, near_by_hand, repeats_by_hand, words, words_of


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with nulls, empty and very long texts, copies, near copies, passages, repeated rows and more columns."""
    r = random.Random(11)
    passage, short = words(r, 80, 10**6), words(r, 53, 900)
    base = [words(r, r.randrange(60, 200), 10**5) for _ in range(30)]
    texts = [None, "", " \n", "one", "日本語 " * 200, words(r, 9000, 10**5), "x" * 500, "x" * 399, *base, *base[:5], base[0], base[0]]
    texts += [edited(r, t, k) for t in base[:6] for k in (1, 2, 8, 30)]
    texts += [f"{words(r, 30)} {passage} {words(r, 20)}" for _ in range(6)] + [f"{words(r, 30, 10**6)} {short} {words(r, 30, 10**6)}" for _ in range(4)]
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["a", "a", "b", None]), len(t or ""), 7, "k") for i, t in enumerate(texts)]
    rows += rows[10:12] + rows[:1]
    out = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard int, key string").write.parquet(f"{out}/documents.parquet")
    v = np.random.default_rng(5).standard_normal((300, 16)).astype(np.float32)
    vectors = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(300 + i, v[0].tolist(), 1) for i in range(40)] + [(400, None, 1), (420, [0.0] * 16, 1), (440, [float("nan")] * 16, 1), (None, v[3].tolist(), 1), (20, v[20].tolist(), 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{out}/embeddings.parquet")
    return str(out), [(x[0], x[1]) for x in rows], {i: np.array(x, np.float64) for i, x, _ in vectors if i is not None and i not in (400, 420, 440)}


def test_near_duplicates(spark, folder):
    got = entries.queries()["op5_near_dup"](spark, folder[0]).collect()
    want = near_by_hand(list(dict(folder[1]).items()), 4, 80)
    assert sorted(tuple(x) for x in got) == sorted((i, *want[i], want[i][1] == i) for i, _ in folder[1])
    assert len({x.component_id for x in got}) < len(got) - 20


def test_shards(spark, folder):
    got = entries.queries()["op6_shard"](spark, folder[0]).collect()
    texts, load, sizes, shards = dict(folder[1]), [0] * 16, {}, {}
    for i, t in folder[1]:
        sizes[t] = sizes.get(t, 0) + len((t or "").encode()) + 1
    assert sorted(x.doc_id for x in got) == sorted(i for i, _ in folder[1])
    for x in got:
        raw = (texts[x.doc_id] or "").encode()
        assert (x.size, x.text_crc32, x.law, x.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        shards.setdefault(texts[x.doc_id], set()).add(x.shard)
        load[x.shard] += x.size
    assert all(len(s) == 1 for s in shards.values()) and sorted(load) == sorted(heap_by_hand(sizes.values(), 16))
    assert sorted((x.shard, x.slot) for x in got) == [(s, k) for s in range(16) for k in range(sum(x.shard == s for x in got))]


def test_substrings(spark, folder):
    got = entries.queries()["op7_substrings"](spark, folder[0]).orderBy("doc_id").collect()
    rows = sorted(folder[1], key=lambda x: x[0])
    assert [(x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got] == repeats_by_hand([t for _, t in rows], 400)
    seen = {}
    for _, t in rows:
        for k in range(len(w := words_of(t)) - 49):
            seen[tuple(w[k : k + 50])] = seen.get(tuple(w[k : k + 50]), 0) + 1
    want = [len({p for k in range(len(w) - 49) if seen[tuple(w[k : k + 50])] > 1 for p in range(k, k + 50)}) for w in (words_of(t) for _, t in rows)]
    assert [x.n_passage_words for x in got] == want
    assert sum(x.n_removed == 0 and x.n_passage_words > 0 for x in got) >= 4  # passages of over 50 words and under 400 bytes


def test_nearest(spark, folder):
    got = entries.queries()["op2_ann"](spark, folder[0]).collect()
    vectors = folder[2]
    for q in (i for i in vectors if i % 20 == 0):
        want = sorted(((-float(v @ vectors[q]), i) for i, v in vectors.items() if i != q))
        mine = sorted((x.rank, x.vec_id, x.score) for x in got if x.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 21)) and np.allclose([m[2] for m in mine], [-w[0] for w in want[:20]], rtol=0, atol=1e-6)
    assert len(got) == 20 * sum(i % 20 == 0 for i in vectors)


@pytest.mark.parametrize("name", [n for n in entries.queries() if n not in ("op2_ann", "op1_url_filter", "op3_quality", "op9_decontaminate")])
def test_an_empty_table(spark, tmp_path, name):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert entries.queries()[name](spark, str(tmp_path)).count() == 0


def test_other_empty_tables(spark, tmp_path):
    for t, schema in (("documents", "doc_id long, text string, lang string, source string"), ("embeddings", "vec_id long, embedding array<float>"), ("pages", "page_id long, url string"), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{t}.parquet")
    for name in ("op1_url_filter", "op2_ann", "op3_quality", "op9_decontaminate"):
        assert entries.queries()[name](spark, str(tmp_path)).where(F.lit(True)).count() == 0
