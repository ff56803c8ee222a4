"""Five stages over documents: quality, near-duplicates, benchmark, mix, shards.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the next
one's docs (``run`` does it in the shared folder of ``spark.checkpoint.dir``). All but the last return the columns of
documents, and take effect:

1. ``quality``: documents scored below ``LEAST_QUALITY`` go. The classifier learns from all labels.
2. ``near_duplicates``: of each component of near-duplicates (5 words, similarity 0.8) the document of the smallest
   id stays; of rows with one id, one. Texts without words and rows of a null id stay.
3. ``benchmark``: documents that hold any 10 consecutive words of a benchmark item (or a whole shorter one) go.
4. ``mix``: sources get the weights of a temperature; every document stays, and those of sources that fall short come
   as repeated rows, at most ``MOST_REPEATS`` times. Rows are written in the order of the mix.
5. ``shards``: doc_id, source, size, text_crc32, shard and slot; equal texts share a shard of 16, shards are of near
   equal bytes.

An empty table passes as one through all stages. SQL can't express the classifier, so there is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagql.llm import decontaminate, mix, near_dup, quality, shard
from dagql.llm.common import cut

LEAST_QUALITY, ENTROPY, MOST_REPEATS, SHARDS = 0.5, 0.9, 2.0, 16


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(quality.with_labels(docs, labels))
    return quality.score(docs, model, out="__score").where(F.col("__score") >= LEAST_QUALITY).drop("__score")


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs, 5, 80)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10, unnamed=True)
    return found.where(~F.col("contaminated")).select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = mix.realise(mix.mix_sources(docs, ENTROPY, MOST_REPEATS))
    return copies.orderBy("place", "mix.src", "row_key").select(*docs.columns)


def shards_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard.lpt_shards(docs, SHARDS, keep=["doc_id", "source"])


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicates_stage), ("benchmark", benchmark_stage), ("mix", mix_stage), ("shards", shards_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
