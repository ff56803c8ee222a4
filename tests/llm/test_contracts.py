"""The registered queries: against their SQL, or by what holds of any right result."""

import shutil

import pytest
from pyspark.sql import functions as F

from dagql.llm import entries
from tests.oracle import assert_same

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(entries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert_same(entries.queries()[name](spark, FOLDER), entries.oracle_sql()[name], FOLDER)


def held_out(by, rest):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(by)) == rest


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    got = entries.queries()["op3_quality"](spark, folder)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    d = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").withColumn("want", held_out(4, 2)).toPandas()
    assert (d.held_out == d.want).all() and d.score.between(0, 1).all() and ((d.score >= 0.7) == (d.predicted == 1)).all()
    d = d[d.held_out]
    assert (d.predicted == d.quality).mean() > 0.97


def test_language_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    d = entries.queries()["op10_lang_id"](spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id").withColumn("want", held_out(3, 1)).toPandas()
    assert len(d) == 1000 and (d.held_out == d.want).all() and d.score.between(0, 1).all()
    d = d[d.held_out]
    assert (d.lang_pred == d.lang).mean() > 0.97


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, FOLDER)
        assert after.schema == docs.schema, name
        after = spark.createDataFrame(after.collect(), docs.schema)
        if name in ("quality", "near_duplicates", "benchmark"):
            assert 0 < after.count() < before.count(), name
            assert after.exceptAll(before).isEmpty()
        if name == "mix":
            assert after.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
        before = after
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.count() == before.count() and got.columns == ["doc_id", "source", "size", "text_crc32", "shard", "slot"]


def test_benchmark_items_without_an_id_count(spark, tmp_path):
    import corpus_pipeline

    item = " ".join(f"i{k}" for k in range(12))
    named = " ".join(f"j{k}" for k in range(12))
    docs = [(1, f"so {item} ends"), (2, f"{named} and {item}"), (3, "nothing of it"), (4, " ".join(item.split()[:9])), (5, "lone word"), (6, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, item), (7, named), (None, "lone word")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in entries.queries()["op9_decontaminate"](spark, str(tmp_path)).collect()}
    assert got == {1: (12, 0, True), 2: (24, 1, True), 3: (0, 0, False), 4: (0, 0, False), 5: (2, 0, True), 6: (0, 0, False)}
    kept = corpus_pipeline.benchmark_stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 6]
    for name in ("documents", "benchmark"):  # DuckDB reads files, not folders
        spark.read.parquet(f"{tmp_path}/{name}.parquet").toPandas().astype({"item_id": "Int64"} if name == "benchmark" else {}).to_parquet(f"{tmp_path}/one_{name}.parquet")
        shutil.rmtree(tmp_path / f"{name}.parquet")
        (tmp_path / f"one_{name}.parquet").rename(tmp_path / f"{name}.parquet")
    assert_same(entries.queries()["op9_decontaminate"](spark, str(tmp_path)), entries.oracle_sql()["op9_decontaminate"], str(tmp_path))


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
