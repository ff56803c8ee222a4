"""Near-duplicates by SetSketch registers.

A document is the set of its distinct word shingles. Registers are truncated minima on an exponential scale: each
shingle starts a Poisson process whose points fall on random registers, a register keeps its smallest point x, as
the number floor(1 - log_BASE(x)). They are mergeable (maximum) and locality-sensitive. Bands of register values meet
in buckets; for pairs from a bucket the similarity is estimated jointly, by maximum likelihood from the numbers of
larger, smaller and equal registers and the exact set sizes; pairs that may reach the threshold are verified on full
sets. Two sets at similarity 0.8 share no band with probability below 1e-6.

Work follows the links, not the pairs of a group. Documents of equal sets are one class. First each class is verified
against the smallest class of the bucket it shares most bands with, so a large group is joined by a star; then against a
few of the likeliest classes of other components. In the end the classes outside their bucket's largest component ask all
others of the bucket, in blocks of bounded size; the likely pairs are compared there by 32-bit hashes of their shingles
before the rest is verified. So no link between components is passed over, and no pair within a component is made. What
the last step compares is the product of those outside the largest component and the bucket; only where a bucket
holds many texts that are alike but below the threshold is that more than a multiple of its size.

Defined results: null and empty texts, and those without a word, have the empty set, are linked with nothing and stay;
texts of fewer words than a shingle are one shingle; rows of a null id take no part and stay, with a null component;
repeated rows are copies of each other; a text of any length is read whole; of equal choices (the smallest class, the
likeliest) the result doesn't depend, since components are the same whichever link joins them; input columns other than
id and text don't matter, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dagql.llm.ann import sorted_groups
from dagql.llm.common import cut, forget, release, table, text_batches
from dagql.llm.components import components
from dagql.llm.words import WordHasher, mix, shards

REGISTERS, BASE, BAND, BANDS = 256, 1.2, 6, 42
#: x = 1 gets this number, so that numbers of sets of 1 to 1e17 shingles fit a byte.
ZERO = 30
_GAMMA = np.uint64(0x9E3779B97F4A7C15)
#: Estimates have a standard error of about 0.025 at 0.8; pairs this far below the threshold are not verified.
SLACK = 0.12
#: Likely pairs of each class, and bands looked at, before all.
LIKELIEST, SOME_BANDS = 3, 6
#: Members of a bucket, and shingles of theirs, that one task compares with each other at a time.
BLOCK, BLOCK_SHINGLES = 4096, 4_000_000
#: Ids of at most so many rows are sent to each executor (under 64 MB); more are joined by a shuffle.
IDS_SENT = 1_000_000


def _hasher() -> WordHasher:
    return WordHasher([9, 10, 11, 12, 13, 32])


def shingle_sets(texts: list[bytes], words: int, hasher: WordHasher) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    starts, h = hasher(raw)
    cuts = np.concatenate([[0], np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))])
    odd = mix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    n = max(0, len(h) - words + 1)
    s = np.zeros(n, np.uint64)
    for j in range(words):
        s += mix(h[j : j + n] * odd[j])
    s = mix(s)
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b - a >= words:
            out.append(np.unique(s[a : b - words + 1]))
        elif b > a:
            out.append(mix(np.array([sum(int(mix(h[a + j : a + j + 1] * odd[j])[0]) for j in range(b - a)) + (int(b - a) << 56) & 0xFFFFFFFFFFFFFFFF], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of register numbers for each set; those of the empty set are 0."""
    out = np.full(len(sets) * REGISTERS, np.inf)
    todo, reach = [i for i, s in enumerate(sets) if len(s)], math.log(REGISTERS) + 3
    while todo:
        h = np.concatenate([sets[i] for i in todo])
        row = np.repeat(np.array(todo), [len(sets[i]) for i in todo])
        stop = reach / np.repeat([float(len(sets[i])) for i in todo], [len(sets[i]) for i in todo])
        x, state = np.zeros(len(h)), h.copy()
        while len(h):
            state = state + _GAMMA
            r = mix(state)
            x = x - np.log(((r >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / REGISTERS
            on = np.flatnonzero(x <= stop)
            h, row, stop, x, state = h[on], row[on], stop[on], x[on], state[on]
            np.minimum.at(out, row * REGISTERS + (r[on] & np.uint64(REGISTERS - 1)).astype(np.int64), x)
        grid = out.reshape(len(sets), REGISTERS)
        todo = [i for i in todo if np.isinf(grid[i]).any()]  # a process that stopped too early is run anew, further
        reach *= 2
    with np.errstate(divide="ignore"):
        k = np.floor(1 + ZERO - np.log(out) / math.log(BASE))
    return np.where(np.isinf(out), 0, np.clip(k, 1, 255)).astype(np.uint8).reshape(len(sets), REGISTERS)


def reaches(least: float, larger: np.ndarray, smaller: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether the most likely Jaccard similarity of sets of na and nb elements, of which so many registers are larger and
    smaller, is at least ``least``. The likelihood has one peak, so its slope at ``least`` tells on which side that lies."""
    u, v = na / (na + nb), nb / (na + nb)
    c, log_base = (BASE - 1) / BASE, math.log(BASE)
    x, y = np.maximum(u - v * least, 0), np.maximum(v - u * least, 0)
    a, b = np.maximum(-np.log1p(-x * c) / log_base, 1e-12), np.maximum(-np.log1p(-y * c) / log_base, 1e-12)
    da, db = v * c / ((1 - x * c) * log_base), u * c / ((1 - y * c) * log_base)  # by how much a and b fall
    slope = (REGISTERS - larger - smaller) * (da + db) / np.maximum(1 - a - b, 1e-12) - larger * da / a - smaller * db / b
    return (slope >= 0) & (np.minimum(na, nb) >= least * np.maximum(na, nb))


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher()
        for b in batches:
            for first, texts in shards(b.column("t")):
                sets = shingle_sets(texts, words, hasher)
                keys = [int(mix(s).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                regs = registers(sets)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(first, len(texts)), b.column("key").slice(first, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), pa.array([r.tobytes() for r in regs], pa.binary())],
                    names=["id", "key", "n", "set", "regs"],
                )

    return run


def _full_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher()
        for b in batches:
            for first, texts in shards(b.column("t")):
                sets = [s.view(np.int64) for s in shingle_sets(texts, words, hasher)]
                yield pa.RecordBatch.from_arrays([b.column("id").slice(first, len(texts)), pa.array(sets, pa.list_(pa.int64()))], names=["id", "s"])

    return run


def _likely(least: float):
    """Keeps the pairs (u, v, na, nb, ra, rb) whose estimate is at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            na, nb = (b.column(c).to_numpy().astype(float) for c in ("na", "nb"))
            ok = reaches(least, (ra > rb).sum(1), (ra < rb).sum(1), na, nb)
            yield b.select(["u", "v"]).filter(pa.array(ok))

    return run


def _short_sets(words: int):
    """Sets of 32-bit parts of the shingle hashes: no smaller in common than the full ones, but for pairs of shingles of one
    document whose parts agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher()
        for b in batches:
            for first, texts in shards(b.column("t")):
                sets = [np.unique(s.astype(np.uint32)).tobytes() for s in shingle_sets(texts, words, hasher)]
                yield pa.RecordBatch.from_arrays([b.column("id").slice(first, len(texts)), pa.array(sets, pa.binary())], names=["id", "short"])

    return run


def _block_pairs(least: float, percent: int, top: int):
    """Rows (bucket, i, j, asks, aim, band, id, component, n, regs[, short]), sorted by bucket, i, j. Gives pairs of one that
    asks and an aim whose components differ. With ``top``: for each that asks the likely aims with most equal registers.
    Else all that are likely and whose short sets have enough in common, in the first band that both share."""

    def pairs(t: pa.Table) -> tuple[list, list]:
        band = t.column("band")[0].as_py()
        asks, aim = (t.column(c).to_numpy() for c in ("asks", "aim"))
        ids, comp, n = (t.column(c).to_numpy() for c in ("id", "component", "n"))
        n = n.astype(float)
        regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint8).reshape(-1, REGISTERS)
        short = None if top else [np.frombuffer(x, np.uint32) for x in t.column("short").to_pylist()]
        lost = None if top else n - [len(s) for s in short]  # what two rows share loses no more than either row as a whole
        b = np.flatnonzero(aim > 0)
        us, vs = [], []
        for a in np.flatnonzero(asks):
            # aim 1: one that doesn't ask itself, so all ask for it; 2: of two that ask, the smaller does
            at = b[(comp[b] != comp[a]) & (ids[b] != ids[a]) & (True if top else (aim[b] == 1) | (ids[b] > ids[a]))]
            if not len(at):
                continue
            more, less = (regs[a] > regs[at]).sum(1), (regs[a] < regs[at]).sum(1)
            ok = reaches(least, more, less, np.full(len(at), n[a]), n[at])
            at, apart = at[ok], (more + less)[ok]
            if top and len(at) > top:
                at = at[np.argpartition(apart, top)[:top]]
            if not top and len(at):
                same = (regs[a, : BAND * BANDS] == regs[at, : BAND * BANDS]).reshape(len(at), BANDS, BAND).all(2)
                at = at[same.argmax(1) == band]
                both = np.array([len(np.intersect1d(short[a], short[x], assume_unique=True)) + min(lost[a], lost[x]) for x in at])
                at = at[100 * both >= percent * (n[a] + n[at] - both)] if len(at) else at
            us += np.minimum(ids[a], ids[at]).tolist()
            vs += np.maximum(ids[a], ids[at]).tolist()
        return us, vs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ["bucket", "i", "j"]):
            u, v = pairs(t)
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _texts_of(ids: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """id and t of the classes of ids, which are distinct; from repeated rows, repeatedly. classes: id, key; texts: key, t."""
    ids = ids.join(classes.select("id", "key"), "id")
    if ids.limit(IDS_SENT + 1).count() <= IDS_SENT:
        ids = F.broadcast(ids)
    return texts.join(ids, "key").select("id", "t")


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (u, v) of classes whose full sets reach the threshold."""
    ids = cut(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct())
    sets = _texts_of(ids, classes, texts).mapInArrow(_full_sets(words), "id long, s array<long>").dropDuplicates(["id"])
    d = pairs.join(sets.select(F.col("id").alias("u"), F.col("s").alias("su")), "u").join(sets.select(F.col("id").alias("v"), F.col("s").alias("sv")), "v")
    both = F.size(F.array_intersect("su", "sv"))
    d = d.select("u", "v", both.alias("both"), (F.size("su") + F.size("sv") - both).alias("all"))
    return cut(d.where(100 * F.col("both") >= percent * F.col("all")).select("u", "v"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept (whether the row's id is its component's) of each row; text_key, a hash of id
    and text, and group_key, a number of the component that holds apart components whose smallest ids are equal."""
    text_batches(docs.sparkSession)
    least = percent / 100 - SLACK
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(doc_id, text).alias("key"), F.col(text).alias("t"))
    rows = cut(texts.mapInArrow(_sketch(words), "id long, key long, n long, set long, regs binary"))
    texts = texts.select("key", "t")
    number = F.xxhash64("set", "n")  # of a class; ids may repeat with other texts
    classes = rows.where("n > 0 AND id IS NOT NULL").groupBy("set", "n").agg(F.min("id").alias("least"), F.min("key").alias("key"), F.min("regs").alias("regs"))
    classes = cut(classes.select(number.alias("id"), "n", "least", "key", "regs"))
    info = classes.select("id", "n", "regs")
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.substring("regs", k * BAND + 1, F.lit(BAND))))
    bands = classes.select("id", "n", band.alias("band", "b")).select("id", "n", "band", F.xxhash64("band", "b").alias("bucket"))
    # tables of the buckets, so that joins on a hot one can be split, or few are sent
    shared = cut(bands.groupBy("bucket").agg(F.min("id").alias("u"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size"))
    members = cut(bands.join(shared, "bucket").select("bucket", "band", "u", F.col("id").alias("v")))

    # each class with the smallest of the bucket it shares most bands with
    most = members.where("u <> v").groupBy("v").agg(F.mode("u", True).alias("u"))
    a, b = info.select(F.col("id").alias("u"), F.col("n").alias("na"), F.col("regs").alias("ra")), info.select(F.col("id").alias("v"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    star = most.join(b, "v").join(a, "u").select("u", "v", "na", "nb", "ra", "rb")
    tested = [cut(star.mapInArrow(_likely(least), "u long, v long"))]
    links = [_verified(tested[0], classes, texts, words, percent)]
    labels = components(links[0])

    # then pairs of different components: for each class a few of the likeliest; then all that are likely
    for top in (LIKELIEST, 0):
        m = members.where(F.col("band") < SOME_BANDS) if top else members
        m = m.select("bucket", "band", F.col("v").alias("id")).join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        parts = m.join(info.select("id", "n"), "id").groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("bulk"))
        size, bulk, largest = F.sum("size"), F.sum("bulk"), F.max(F.struct("size", "bulk", "component"))
        blocks = lambda size, bulk: F.ceil(F.greatest(size / BLOCK, bulk / BLOCK_SHINGLES)).cast("int")
        parts = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), largest["component"].alias("largest"), blocks(size, bulk).alias("blocks"), blocks(size - largest["size"], bulk - largest["bulk"]).alias("asking"))
        parts = cut(parts.where("parts > 1").drop("parts"))
        held = m = cut(m.join(parts, "bucket").withColumn("asks", F.col("component") != F.col("largest")))
        payload = info
        if not top:
            short = _texts_of(cut(m.select("id").distinct()), classes, texts).mapInArrow(_short_sets(words), "id long, short binary").dropDuplicates(["id"])
            payload = info.join(short, "id")
        m = m.join(payload, "id").withColumn("aim", F.when(F.col("asks"), 2).otherwise(1)).drop("largest")

        def block(of: str) -> Column:
            return F.pmod(F.xxhash64("id"), F.col(of)).cast("int")

        def every(of: str) -> Column:
            return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

        if top:
            m = m.withColumn("i", block("blocks")).withColumn("j", F.col("i"))
        else:  # one block of all holds those that ask and are aims, if there are few
            whole = (F.col("blocks") == 1) & (F.col("asking") == 1)
            asking = m.where(F.col("asks") & ~whole).withColumn("aim", F.lit(0)).withColumn("i", block("asking")).withColumn("j", every("blocks"))
            aims = m.withColumn("asks", F.col("asks") & whole).withColumn("j", block("blocks")).withColumn("i", every("asking"))
            m = asking.unionByName(aims)
        m = m.drop("blocks", "asking").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        found = m.mapInArrow(_block_pairs(least, percent, top), "u long, v long").distinct()
        for before in tested:
            found = found.join(before.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), ["u", "v"], "left_anti")
        tested.append(cut(found))
        forget(held, parts)
        if tested[-1].isEmpty():
            continue
        new = _verified(tested[-1], classes, texts, words, percent)
        if new.isEmpty():
            continue
        links.append(new)
        release(docs.sparkSession)
        labels = components(reduce(DataFrame.unionByName, links))
    forget(shared, members, *tested, *links)

    of = classes.select("id", "least").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    first = cut(of.groupBy("component").agg(F.min("least").alias("first")))  # as a table, so that joins on a hot component can be split
    of = of.join(first, "component").select(F.col("id").alias("class"), "component", "first")
    out = rows.select("id", "key", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), number).alias("class")).join(of, "class", "left")
    out = out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("first", "id").alias("component_id"), F.col("key").alias("text_key"), F.col("component").alias("group_key"))
    return out.withColumn("kept", F.coalesce(F.col(doc_id) == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates: of each component one row, of its smallest id and, within that, text hash.
    Rows without words and those of a null id all stay."""
    d = cut(near_duplicates(docs, words, percent, doc_id, text).where((F.col("n_shingles") > 0) & F.col(doc_id).isNotNull()))
    key = F.struct(F.col(doc_id).alias("id"), F.col("text_key").alias("key"))
    stay = cut(d.groupBy("group_key").agg(F.min(key).alias("stay")))
    rows = d.join(stay, "group_key").groupBy(F.col(doc_id).alias("__id"), F.col("text_key").alias("__key")).agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("stay") == key).alias("stays"))
    rows = cut(rows.where("NOT stays OR rows > 1"))  # what goes, and what stays once of repeated rows
    if rows.limit(IDS_SENT + 1).count() <= IDS_SENT:
        rows = F.broadcast(rows)
    keyed = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(docs.columns)], F.col(doc_id).cast("long").alias("__id"), F.xxhash64(doc_id, text).alias("__key"))
    rest = keyed.join(rows, ["__id", "__key"], "left_anti")
    repeated = keyed.join(rows.where("stays"), ["__id", "__key"], "left_semi").dropDuplicates(["__id", "__key"])
    return rest.union(repeated.select(*rest.columns)).select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op5_near_dup(spark, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document, on 4-word shingles at 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), 4, 80).drop("text_key", "group_key")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
c AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT l.v, c.c FROM c JOIN l ON l.u = c.id),
m AS (SELECT id, min(c) AS component_id FROM c GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
