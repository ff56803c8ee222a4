"""Mixing sources to target weights.

Temperature mixing: each source's share of the tokens is raised to an exponent and the results are normalised to
weights. The exponent (1: shares as they are, 0: all sources alike) is bisected: the largest that brings the weights'
entropy to ``entropy`` times the greatest possible, but not so small that a source would be repeated more than
``max_repeats`` times. So the bound on repeats moves weight to the other sources by the exponent; it cuts a budget only
where the budget is more than ``max_repeats`` times all tokens, when every source is taken that often.

The weights are realised as budgeted block permutations: a source's budget is its weight times the whole budget. Its
rows are dealt over blocks of about ``BLOCK_ROWS``; an epoch is a permutation of the blocks (an affine map of their numbers,
so that each row knows its block's rank) and of the rows within each, by keys of that epoch. Whole epochs take every row; the last, partial one takes blocks in its order, then rows of the
block where the budget ends, as long as they fit. Without ``budget`` it is the least that takes every row at least once.
``realise`` gives every copy its place from 0 to 1 in the mix: the source's epochs lie one after another, their blocks side by
side, rows at the even spread of their keys. So each stretch of the mix holds the sources near their weights, and no
order is gathered.

The choice is a test of each row against its source's cut, so texts aren't moved; what is gathered for it is a row of
numbers for each source, for each of ``BINS`` ranges of block ranks of a source, for the blocks of one such range, and for
the rows of one block of each source. The driver gets counts of sources by size class, a table of bounded size.

Tokens of a row are its words (runs between white space) and one for its end. Defined results: null and empty texts
have one token; a null source is a source of its own; equal rows (id and text) are chosen alike, together within the
budget, and ties of place go to the smaller key, then id; texts of any length are counted whole; input columns come back
as they are, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dagql.llm.common import cut, forget, number_in_order, table
from dagql.llm.shard import size_class

BLOCK_ROWS, BINS = 1024, 1024
#: Primes beyond any number of blocks, each the factor of a permutation.
FACTORS = [2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497]
#: Sources of at most so many are sent to each executor (under 64 MB); more are joined by a shuffle.
SOURCES_SENT = 200_000


def exponent(classes: list[tuple[int, float]], entropy: float, max_repeats: float, budget: float | None) -> float:
    """classes: (number of sources, their mean tokens)."""
    n = sum(c for c, _ in classes)
    least, most = min(t for _, t in classes), max(t for _, t in classes)

    def relative_entropy(a: float) -> float:
        z = sum(c * t**a for c, t in classes)
        h = -sum(c * t**a / z * math.log(t**a / z) for c, t in classes)
        return h / math.log(n) if n > 1 else 1.0

    def repeats(a: float) -> float:
        return (most / least) ** (1 - a) if budget is None else budget * least ** (a - 1) / sum(c * t**a for c, t in classes)

    def bisect(low_ok) -> float:
        """The border between exponents for which low_ok holds and the larger ones."""
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if low_ok(mid) else (low, mid)
        return high

    flat = 1.0 if relative_entropy(1.0) >= entropy else bisect(lambda a: relative_entropy(a) >= entropy)
    bound = 0.0 if repeats(0.0) <= max_repeats else bisect(lambda a: repeats(a) > max_repeats)
    return max(flat, bound)


def _tokens(text: Column) -> Column:
    return (F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")) + 1).cast("long")


def _key(*parts: Column) -> Column:
    """A number below 2^52, evenly spread: the first digits of the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("long")


def _source(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def mix_sources(docs: DataFrame, entropy: float = 0.98, max_repeats: float = 4.0, budget: int | None = None, seed: int = 0, source: str = "source", text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """keep (all columns of docs, if not given) of each row, and a last column ``__mix``, a struct: src, key, tokens, weight, copies
    (how often the row is taken), block, blocks, epochs (whole ones of its source), span (with the part of the last) and reach (how far
    the last goes into its permutation, as a share)."""
    keep = list(docs.columns if keep is None else keep)
    words = F.concat_ws(":", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    d = docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], _source(source).alias("src"), _tokens(F.col(text)).alias("tokens"), _key(words).alias("key"))
    light = cut(d.select("src", "tokens", "key"))
    sources = cut(light.groupBy("src").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")))
    classes = [(r[0], r[1]) for r in sources.groupBy(size_class(F.col("t")).alias("c")).agg(F.count(F.lit(1)), F.avg("t")).drop("c").collect()]
    if not classes:
        classes = [(1, 1.0)]
    a = exponent(classes, entropy, max_repeats, budget)
    z, most = sum(c * t**a for c, t in classes), max(t for _, t in classes)
    whole = float(budget) if budget is not None else most ** (1 - a) * z
    weight = F.pow(F.col("t").cast("double"), F.lit(a)) / z
    quota = F.greatest(F.least(weight * whole, max_repeats * F.col("t")), F.col("t").cast("double") if budget is None else F.lit(0.0))
    plan = sources.select("src", weight.alias("weight"), "t", F.ceil(F.col("n") / BLOCK_ROWS).alias("blocks"), quota.alias("quota"), F.floor(quota / F.col("t")).alias("epochs"))
    rest = F.greatest(F.floor(F.col("quota") - F.col("epochs") * F.col("t")), F.lit(0))
    plan = cut(plan.withColumn("rest", rest).withColumn("span", F.col("epochs") + F.col("rest") / F.col("t")).drop("quota", "t"))

    def placed(rows: DataFrame) -> DataFrame:
        """Block of the rows, its rank in the partial epoch, and the row's key in that epoch."""
        rows = rows.withColumn("block", F.pmod("key", "blocks"))
        return rows.withColumn("block_rank", _block_rank(seed, "epochs")).withColumn("row_key", _key(F.lit(seed), F.col("epochs"), F.col("key")))

    # the block and row where each source's partial epoch ends, from ranges of block keys down
    rows = placed(light.join(plan, "src"))
    blocks = rows.groupBy("src", "block_rank", "block", "blocks", "rest").agg(F.sum("tokens").alias("t"))
    blocks = cut(blocks.withColumn("bin", F.floor(F.col("block_rank") * BINS / F.col("blocks"))).drop("blocks"))

    def end(d: DataFrame, keys: list[str]) -> DataFrame:
        """The first, by the keys, whose sum with those before is over the rest; and the rest without those before."""
        upto = F.sum("t").over(W.partitionBy("src").orderBy(*keys))
        d = d.withColumn("upto", upto).where("upto > rest").withColumn("first", F.row_number().over(W.partitionBy("src").orderBy(*keys))).where("first = 1")
        return d.select("src", *keys, (F.col("rest") - (F.col("upto") - F.col("t"))).alias("rest"))

    ends = end(blocks.groupBy("src", "bin", "rest").agg(F.sum("t").alias("t")), ["bin"])
    ends = cut(end(blocks.drop("rest").join(ends, ["src", "bin"]), ["block_rank"]).select("src", F.col("block_rank").alias("end_block"), F.col("rest").alias("room")))
    last = rows.select("src", F.col("block_rank").alias("end_block"), "tokens", "row_key").join(ends, ["src", "end_block"]).withColumn("upto", F.sum("tokens").over(W.partitionBy("src").orderBy("row_key")))
    last = last.where("upto <= room").groupBy("src").agg(F.max("row_key").alias("end_row"))
    rule = plan.join(ends.drop("room"), "src", "left").join(last, "src", "left")
    rule = cut(rule.withColumn("reach", (F.col("end_block") + F.coalesce((F.col("end_row") + 1) / F.lit(2.0**52), F.lit(0.0))) / F.col("blocks")))
    forget(light, blocks, ends)
    if rule.limit(SOURCES_SENT + 1).count() <= SOURCES_SENT:
        rule = F.broadcast(rule)
    out = placed(d.join(rule, "src"))
    taken = (F.col("block_rank") < F.col("end_block")) | ((F.col("block_rank") == F.col("end_block")) & (F.col("row_key") <= F.coalesce("end_row", F.lit(-1))))
    mix = F.struct("src", "key", "tokens", "weight", (F.col("epochs") + F.coalesce(taken, F.lit(False)).cast("long")).alias("copies"), "block", "blocks", "epochs", "span", "reach")
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], mix.alias("__mix"))


def _block_rank(seed: int, epoch: str) -> Column:
    """Place of a block in the epoch's permutation: block times a factor, which shares no divisor with their number, and a shift."""
    e = _key(F.lit(seed), F.col(epoch), F.md5(F.col("src").cast("binary")))
    factor = F.element_at(F.array(*[F.lit(p).cast("long") for p in FACTORS]), (F.pmod(e, F.lit(len(FACTORS))) + 1).cast("int"))
    return F.pmod(factor * F.col("block") + F.pmod(F.shiftright(e, 8), F.col("blocks")), F.col("blocks"))


def realise(mixed: DataFrame, seed: int = 0) -> DataFrame:
    """A row for each copy of the rows of ``mix_sources``: their columns, then copy (the epoch), place (from 0 to 1 in the mix)
    and row_key. Ordered by place, src and row_key, the copies are the mix."""
    columns = mixed.columns[:-1]
    d = mixed.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(columns)], F.col("__mix").alias("mix")).where("mix.copies > 0")
    d = d.select("*", F.explode(F.sequence(F.lit(0), F.col("mix.copies") - 1)).alias("copy"), "mix.src", "mix.block", "mix.blocks", "mix.key", "mix.epochs", "mix.span", "mix.reach")
    d = d.withColumn("row_key", _key(F.lit(seed), F.col("copy"), F.col("key")))
    u = (_block_rank(seed, "copy") + F.col("row_key") / F.lit(2.0**52)) / F.col("blocks")
    u = F.when(F.col("copy") < F.col("epochs"), u).otherwise(u / F.nullif("reach", F.lit(0.0)) * (F.col("span") - F.col("epochs")))
    place = (F.col("copy") + u) / F.col("span")
    return d.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(columns)], "mix", "copy", place.alias("place"), "row_key")


def op8_mix(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents within a budget of as many tokens as there are: a row for each copy taken, with its position."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    total = docs.agg(F.coalesce(F.sum(_tokens(F.col("text"))), F.lit(0))).first()[0]
    d = realise(mix_sources(docs, budget=total, keep=["doc_id", "source"]))
    d = d.select("doc_id", "source", "mix.tokens", F.round("mix.weight", 9).alias("weight"), "copy", "mix.block", "place", "row_key", "mix.src")
    d = number_in_order(cut(d), "place", ["place", "src", "row_key", "doc_id"], "position")
    return d.select("doc_id", "source", "tokens", "weight", "copy", "block", "position")


_SHARE = "list_sum(list_transform(l, lambda y: y ** m))"
_ENTROPY = f"coalesce(-list_sum(list_transform(l, lambda x: x ** m / {_SHARE} * ln(x ** m / {_SHARE}))) / nullif(ln(len(l)), 0), 1)"
_REPEATS = f"total * list_min(l) ** (m - 1) / {_SHARE}"
_SQL_RANK = f"(([{', '.join(map(str, FACTORS))}])[CAST(e % {len(FACTORS)} + 1 AS INT)] * block + (e >> 8) % blocks) % blocks"


def _sql_key(epoch: str, what: str) -> str:
    return f"CAST('0x' || left(md5('0:' || {epoch} || ':' || {what}), 13) AS BIGINT)"


SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('=' || source, '') AS src, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[ 	

]+'), lambda w: w <> '')) + 1 AS BIGINT) AS tokens,
  CAST('0x' || left(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 13) AS BIGINT) AS key FROM documents),
s AS (SELECT src, CAST(sum(tokens) AS DOUBLE) AS t, count(*) AS n FROM d GROUP BY src),
g AS (SELECT list(t ORDER BY src) AS l, sum(t) AS total FROM s),
e AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high, CAST(0.5 AS DOUBLE) AS m, l, total FROM g
  UNION ALL SELECT i + 1, nl, nh, (nl + nh) / 2, l, total FROM (SELECT i, l, total, CASE WHEN {_ENTROPY} >= 0.98 THEN m ELSE low END AS nl, CASE WHEN {_ENTROPY} >= 0.98 THEN high ELSE m END AS nh FROM e WHERE i < 60)),
r AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high, CAST(0.5 AS DOUBLE) AS m, l, total FROM g
  UNION ALL SELECT i + 1, nl, nh, (nl + nh) / 2, l, total FROM (SELECT i, l, total, CASE WHEN {_REPEATS} > 4 THEN m ELSE low END AS nl, CASE WHEN {_REPEATS} > 4 THEN high ELSE m END AS nh FROM r WHERE i < 60)),
a AS (SELECT greatest((SELECT CASE WHEN {_ENTROPY.replace(" m", " 1.0")} >= 0.98 THEN 1.0 ELSE (SELECT high FROM e WHERE i = 60) END FROM g), (SELECT CASE WHEN {_REPEATS.replace("(m - 1)", "(-1.0)").replace(" m", " 0.0")} <= 4 THEN 0.0 ELSE (SELECT high FROM r WHERE i = 60) END FROM g)) AS m),
w AS (SELECT src, t, CAST(ceil(n / 1024) AS BIGINT) AS blocks, t ** m / {_SHARE} AS weight, least(t ** m / {_SHARE} * total, 4 * t) AS quota FROM s, g, a),
p AS (SELECT *, CAST(floor(quota / t) AS BIGINT) AS epochs, greatest(floor(quota - floor(quota / t) * t), 0) AS rest FROM w),
f AS (SELECT doc_id, source, src, tokens, key, weight, epochs, rest, epochs + rest / t AS span, blocks, key % blocks AS block FROM d JOIN p USING (src)),
h AS (SELECT *, {_sql_key("epochs", "md5(src)")} AS e, {_sql_key("epochs", "key")} AS row_key FROM f),
k AS (SELECT *, {_SQL_RANK} AS block_rank FROM h),
b AS (SELECT src, block_rank, blocks, rest, sum(tokens) AS own, sum(sum(tokens)) OVER (PARTITION BY src ORDER BY block_rank) - sum(tokens) AS before FROM k GROUP BY src, block_rank, blocks, rest),
c AS (SELECT k.*, sum(tokens) OVER (PARTITION BY k.src, k.block ORDER BY row_key) + before <= k.rest AS taken FROM k JOIN b ON b.src = k.src AND b.block_rank = k.block_rank),
z AS (SELECT src, min(block_rank) AS end_block, min(blocks) AS blocks FROM b WHERE before + own > rest GROUP BY src),
v AS (SELECT z.src, (end_block + coalesce((max(row_key) FILTER (taken) + 1) / (2.0 ** 52), 0.0)) / min(z.blocks) AS reach FROM z LEFT JOIN c ON c.src = z.src AND c.block_rank = z.end_block GROUP BY z.src, end_block),
x AS (SELECT * EXCLUDE (e, row_key), unnest(range(0, epochs + CAST(taken AS BIGINT))) AS copy FROM c),
i AS (SELECT x.*, reach, {_sql_key("copy", "md5(x.src)")} AS e, {_sql_key("copy", "key")} AS rk FROM x JOIN v ON v.src = x.src),
u AS (SELECT *, ({_SQL_RANK} + rk / (2.0 ** 52)) / blocks AS u FROM i),
y AS (SELECT *, (copy + CASE WHEN copy < epochs THEN u ELSE u / nullif(reach, 0) * (span - epochs) END) / span AS place FROM u)
SELECT doc_id, source, tokens, round(weight, 9) AS weight, copy, block, row_number() OVER (ORDER BY place, src, rk, doc_id) - 1 AS position FROM y
"""
