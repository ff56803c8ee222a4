"""Language ID by compression: each language has a zstandard raw-content dictionary; the text is encoded with each
of them and the smallest encoding names the language.

The dictionaries are fitted on a bounded sample: of each language the ``docs_per_language`` labelled rows with the
smallest hash, whole, as far as they fit into ``dict_bytes``; texts of more than an eighth of that aren't in the
sample, so that it holds many, unless a language has no others (then the first by hash is, up to ``dict_bytes``). Texts
to be judged are always encoded whole. Each language keeps its own text up to that bound, however little the others have; a shorter one is repeated up to the length of the longest, for zstandard chooses its
search by the dictionary's length, and none is favoured then. Case is folded in both, for capitals find no match in a
dictionary of small letters.

``margin`` is the saving of the best against the second best language as a share of the second best; below
``reject_below`` the answer is marked as rejected. ``score`` is 1 - exp(-margin * sharpness), from 0 to 1.

Defined results: a null text or one without a letter is ``und`` with score 0; ties go to the language with more
training text, then to the first by name; without training rows all texts are ``und``; repeated rows are judged
alike, each giving its row; input columns may have any names, those kept come back as they are; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dagql.llm.common import table, text_batches

LETTER = regex.compile(r"\p{L}")


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", docs_per_language: int = 200, dict_bytes: int = 32_768) -> list[tuple[str, bytes]]:
    """(language, dictionary content), most rows first. Only these bounded samples come to the driver."""
    d = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("l"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    counts = {r["l"]: (r["n"], r["texts"]) for r in d.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("texts")).collect()}
    if not counts:
        return []
    # rows whose hash is so small that several times the sample are expected; copies of one text count once
    share = F.create_map(*[F.lit(x) for k, (_, texts) in counts.items() for x in (k, min(1.0, 5 * docs_per_language / max(1, texts)))])
    d = d.where(F.pmod("h", F.lit(1 << 31)) < F.element_at(share, F.col("l")) * (1 << 31))
    d = d.groupBy("l", "h").agg(F.min("t").alias("t")).withColumn("bytes", F.octet_length("t") + 1)
    order = W.partitionBy("l").orderBy(F.col("bytes") > dict_bytes // 8, F.pmod("h", F.lit(1 << 31)), "h")
    sized = d.select("l", "t", "bytes", F.row_number().over(order).alias("n"), F.sum("bytes").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("upto"))
    picked = sized.where((F.col("n") <= docs_per_language) & (F.col("upto") <= dict_bytes + 1) & (F.col("bytes") <= dict_bytes // 8) | (F.col("n") == 1))
    texts: dict[str, list] = {}
    for r in picked.select("l", "n", F.when(F.col("bytes") > dict_bytes, F.substring("t", 1, dict_bytes)).otherwise(F.col("t")).alias("t")).collect():
        texts.setdefault(r["l"], []).append((r["n"], r["t"]))
    joined = {k: b"\n".join(t.lower().encode("utf-8", "surrogatepass") for _, t in sorted(v)) for k, v in texts.items()}
    n = min(dict_bytes, max(map(len, joined.values()), default=0))
    return [(k, (joined[k] * -(-n // len(joined[k])))[-n:]) for k in sorted(joined, key=lambda k: (-counts[k][0], k))]


def classify(df: DataFrame, model: list[tuple[str, bytes]], text: str = "text", keep: list[str] | None = None, level: int = 6, sharpness: float = 20.0, reject_below: float = 0.01) -> DataFrame:
    """keep, lang_pred, score, margin and rejected of each row."""
    text_batches(df.sparkSession)
    keep = list(keep or [])
    d = df.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], F.col(text).alias("__text"))
    kept = d.drop("__text").schema
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in kept], "lang_pred string, score double, margin double, rejected boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = []
        for name, content in model:
            content = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            coders.append((name, zstandard.ZstdCompressor(level=level, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False)))
        for b in batches:
            out: list[tuple] = []
            for t in b.column("__text"):
                t = t.as_py()
                if not coders or t is None or not LETTER.search(t):
                    out.append(("und", 0.0, 0.0, True))
                    continue
                raw = t.lower().encode("utf-8", "surrogatepass")
                sizes = sorted((len(c.compress(raw)), i) for i, (_, c) in enumerate(coders))
                margin = 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0
                out.append((model[sizes[0][1]][0], 1 - math.exp(-sharpness * margin), margin, margin < reject_below))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(f.name) for f in kept], *(pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.float64(), pa.float64(), pa.bool_()), strict=True))],
                names=[*kept.names, "lang_pred", "score", "margin", "rejected"],
            )

    out = d.mapInArrow(run, schema)
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "margin", "rejected")


def op10_lang_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows that aren't held out."""
    held = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(3)) == 1
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(held, F.lit(False)))
    model = fit(docs.where(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return classify(docs, model, keep=["doc_id", "held_out"])
