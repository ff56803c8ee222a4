"""Input columns of any names come back as they are, from every operator that keeps columns."""

import pytest
from pyspark.sql import functions as F

from dagql.llm import decontaminate, lang_id, mix, near_dup, quality, secrets, shard, substrings, url_filter
from tests.llm.test_operators import CLASHING

NAMES = list(dict.fromkeys([*CLASHING, "__k0", "__id", "__key", "__part", "__rank", "x", "k", "values", "at_once"]))


@pytest.fixture(scope="module")
def rows(spark):
    texts = ["the house of night " * 30, "das haus der nacht " * 30, None, "", "the house of night " * 30, "password=abcdefgh12"]
    d = spark.createDataFrame([(i, t, "ab"[i % 2], f"http://a.com/{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string, link string")
    return d.withColumns({c: F.concat(F.lit(f"{c}:"), "doc_id") for c in NAMES})


def kept(found, d):
    """Whether the columns of found that d has hold d's values."""
    names = ["doc_id", *[c for c in NAMES if c in d.columns]]
    return found.select(*names).exceptAll(d.select(*names)).isEmpty() and d.select(*names).exceptAll(found.select(*names)).isEmpty()


@pytest.mark.parametrize(
    ("out", "run"),
    [
        (["host", "path", "rule", "verdict", "tier"], lambda d, k: url_filter.filter_urls(d, url_filter.DOMAIN_RULES, "link", k)),
        (["spans"], lambda d, k: secrets.find_secrets(d, keep=k)),
        (["size", "text_crc32", "shard", "slot"], lambda d, k: shard.lpt_shards(d, 4, keep=k)),
        (["kept", "n_bytes", "n_removed", "n_spans", "cover", "passages"], lambda d, k: substrings.remove_repeats(d, 40, keep=k, passage_words=12)),
        ([], lambda d, k: mix.mix_sources(d, keep=k)),
        (["copy", "place", "row_key", "mix"], lambda d, k: mix.realise(mix.mix_sources(d, keep=k)).where("copy = 0")),
        (["n_words", "n_hit", "items", "contaminated", "matches"], lambda d, k: decontaminate.find_benchmark(d, d.select(F.col("doc_id").alias("item_id"), "text"), 5, keep=k)),
        (["lang_pred", "score", "margin", "rejected"], lambda d, k: lang_id.classify(d, [("en", b"the house of night"), ("de", b"das haus der nacht")], keep=k)),
        (["score"], lambda d, k: quality.score(d, quality.fit(d.select("text", (F.col("doc_id") % 2).cast("int").alias("label"))), keep=k)),
    ],
)
def test_kept_columns_hold_their_values(rows, out, run):
    names = [c for c in NAMES if c not in out]
    found = run(rows, ["doc_id", *names])
    assert kept(found.select("doc_id", *names), rows.drop(*[c for c in NAMES if c in out]))


def test_near_duplicates_keep_whole_rows(rows):
    found = near_dup.keep_one(rows)
    assert found.columns == rows.columns
    assert kept(found, rows.where("doc_id <> 4"))
