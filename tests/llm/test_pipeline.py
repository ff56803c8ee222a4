"""Each stage of the pipeline on planted rows: what must go, and what must stay."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import edited, words

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n):
    return " ".join(("The" if not k % 12 else "") + "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randrange(2, 9))) + ("." if k % 12 == 11 else "") for k in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def test_stages_are_named_in_their_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "benchmark", "mix", "shards"]


def test_quality_rejects_junk_alone(spark, tmp_path):
    r = random.Random(1)
    junk = lambda: " ".join(r.choice(["$$$", "!!!", "BUY", "NOW", "###", "CLICK", "|"]) for _ in range(60))
    rows = [(i, prose(r, 60) if i % 2 else junk(), "s") for i in range(400)]
    docs = table(spark, rows)
    spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = STAGES["quality"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == list(range(1, 400, 2))


def test_one_document_of_each_group_stays(spark):
    r = random.Random(2)
    base = [prose(r, 150) for _ in range(20)]
    rows = [(i, t, "s") for i, t in enumerate(base)] + [(100 + i, t, "s") for i, t in enumerate(base[:5])]
    rows += [(200 + i, edited(r, t, 2), "s") for i, t in enumerate(base[:8])] + [(300, base[0], "x"), (400, None, "s"), (401, "", "s"), (500, edited(r, base[9], 60), "s")]
    kept = STAGES["near_duplicates"](spark, table(spark, rows), "")
    assert sorted(x.doc_id for x in kept.collect()) == [*range(20), 400, 401, 500]


def test_what_holds_benchmark_passages_goes(spark, tmp_path):
    r = random.Random(3)
    items = [prose(r, n) for n in (40, 12, 6)]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    some = lambda t, a, b: " ".join(t.split()[a:b])
    rows = [(1, prose(r, 30) + " " + some(items[0], 5, 15) + " " + prose(r, 30), "s"), (2, prose(r, 30) + " " + some(items[0], 5, 14) + " zzz", "s"), (3, items[1].upper(), "s"), (4, "x " + items[2] + " y", "s"), (5, prose(r, 300), "s"), (6, None, "s"), (7, some(items[2], 0, 5), "s")]
    kept = STAGES["benchmark"](spark, table(spark, rows), str(tmp_path))
    assert sorted(x.doc_id for x in kept.collect()) == [2, 5, 6, 7]


def test_the_mix_keeps_all_and_repeats_small_sources(spark):
    r = random.Random(4)
    rows = [(i, prose(r, 20), "large") for i in range(300)] + [(1000 + i, prose(r, 20), "small") for i in range(19)] + [(2000, None, "small")]
    got = STAGES["mix"](spark, table(spark, rows), "").collect()
    counts = {}
    for x in got:
        counts[x.doc_id] = counts.get(x.doc_id, 0) + 1
    assert set(counts) == {i for i, *_ in rows} and max(counts.values()) == 2
    assert all(counts[i] == 1 for i in range(300)) and sum(n for i, n in counts.items() if i >= 1000) >= 35
    sources = [x.source for x in got]
    assert "small" in sources[: len(sources) // 4] and "small" in sources[-len(sources) // 4 :]  # spread over the mix


def test_shards_are_even_and_hold_every_row(spark):
    r = random.Random(5)
    rows = [(i, prose(r, r.randrange(1, 60)), "s") for i in range(300)] + [(400, "same", "s"), (401, "same", "t"), (402, None, "s")]
    got = STAGES["shards"](spark, table(spark, rows), "").collect()
    assert sorted(x.doc_id for x in got) == sorted(i for i, *_ in rows)
    assert len({x.shard for x in got if x.doc_id in (400, 401)}) == 1
    load = [sum(x.size for x in got if x.shard == s) for s in range(16)]
    assert max(load) - min(load) <= 30


@pytest.mark.parametrize("name", ["near_duplicates", "mix"])
def test_an_empty_table_stays_one(spark, name):
    d = table(spark, [(1, "x", "s")]).where(F.lit(False))
    got = STAGES[name](spark, d, "")
    assert got.columns == d.columns and got.count() == 0
