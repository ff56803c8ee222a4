"""Quality classifier: Naive Bayes support vectors.

Indicators of n-grams (1 to 3) over the shapes of words (see ``shape``; one of more than ``SHAPE_LENGTH`` signs counts as
successive pieces of that length; a word that repeats the one before it is marked) are scaled by the log-count ratios of the two classes, and a linear model with hinge loss is fitted to them by
dual coordinate descent. A logistic curve, fitted on rows that the descent didn't see, turns margins into scores from
0 to 1.

The counts cover all labelled rows; the descent and the curve are fitted on at most ``sample_rows`` distinct texts, of each
class those with the smallest hash: half of them of each, or more where the other has fewer. A text counts once however
many copies it has, and its hash says whether the descent or the curve sees it; the curve weights the classes back to
their shares of distinct texts. n-grams are hashed to ``1 << bits`` numbers, so the model's size is fixed.

Defined results: null and empty texts have no n-gram and get the score of the bias alone; a text of any length is read to
its end; input columns may have any names, those kept come back as they are; of texts of equal hash and class one counts; of several labels of one
document the highest counts; null labels don't count; without labelled rows of both classes each score is the rate of
class 1 (0.5 without any row); repeated rows are scored alike, each giving its row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dagql.llm.common import cut, forget, release, table, text_batches

SHAPE_LENGTH = 8
CACHED_WORDS, CACHED_LENGTH = 50_000, 64
#: Texts whose n-grams are held at a time.
TEXTS_AT_ONCE = 256


def shape(word: str) -> str:
    """Runs of lower case, upper case, other letters and digits as a, A, x and 0; other signs, and repeats of one, as they are."""
    out = []
    for c in word:
        s = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else "x" if c.isalpha() else c
        if s not in "aA0x" or not out or out[-1] != s:
            out.append(s)
    return "".join(out)


class Shapes(dict):
    """The pieces of each word's shape, one at least; words of more than ``CACHED_LENGTH`` characters aren't held."""

    def __missing__(self, word: str) -> list[str]:
        s = shape(word)
        pieces = [s[i : i + SHAPE_LENGTH] for i in range(0, len(s), SHAPE_LENGTH)]
        if len(word) <= CACHED_LENGTH:
            if len(self) > CACHED_WORDS:
                self.clear()
            self[word] = pieces
        return pieces


def ngrams(text: str | None, shapes: Shapes, mask: int) -> list[int]:
    """Hashed n-grams of the whole text, each once, ascending."""
    words = (text or "").split()
    s, before = [], None
    for w in words:
        s += shapes[w]
        if w == before:
            s[-1] += "="
        before = w
    found = {*s, *map("\t".join, set(zip(s, s[1:], strict=False))), *map("\t".join, set(zip(s, s[1:], s[2:], strict=False)))}
    return sorted({zlib.crc32(g.encode("utf-8", "surrogatepass")) & mask for g in found})


def ratios(g: np.ndarray, y: np.ndarray, n: np.ndarray, rows: tuple[int, int], bits: int, smooth: float = 1.0) -> np.ndarray:
    """Log-count ratio of each n-gram number: share among class 1 over share among class 0. n: rows of class y with g."""
    p = np.full((2, 1 << bits), smooth)
    p[y, g] += n
    return np.log(p[1] / (rows[1] + 2 * smooth)) - np.log(p[0] / (rows[0] + 2 * smooth))


def dual_descent(x: list[np.ndarray], y: np.ndarray, r: np.ndarray, c: np.ndarray, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2/2 + sum c_i * hinge, by coordinate descent on its dual. x: indicators, scaled by r
    and by the root of their number."""
    w, bias, a = np.zeros(len(r)), 0.0, np.zeros(len(x))
    root = [math.sqrt(max(1, len(i))) for i in x]
    q = np.array([r[i] @ r[i] / s**2 + 1.0 for i, s in zip(x, root, strict=True)])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(x)):
            scale = r[x[i]] / root[i]
            g = y[i] * (w[x[i]] @ scale + bias) - 1
            new = min(max(a[i] - g / q[i], 0.0), c[i])
            if d := new - a[i]:
                w[x[i]] += d * y[i] * scale
                bias += d * y[i]
                a[i] = new
                moved = max(moved, abs(d))
        if moved < 1e-3:
            break
    return w, bias


def logistic_curve(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """slope and shift of 1 / (1 + exp(-(slope * margin + shift))), by Newton steps with a weak pull to slope 1."""
    n1, n0 = weight[label == 1].sum(), weight[label == 0].sum()
    t = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    ab = np.array([1.0, 0.0])
    m = np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ ab, -30, 30)))
        g = m.T @ (weight * (p - t)) + 1e-2 * (ab - np.array([1.0, 0.0]))
        h = (m * (weight * p * (1 - p))[:, None]).T @ m + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        ab -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(ab[0]), float(ab[1])


class Model:
    """value: weight of each n-gram number, its ratio included."""

    def __init__(self, bits: int, value: np.ndarray, bias: float, slope: float, shift: float):
        self.bits, self.value, self.bias, self.slope, self.shift = bits, value.astype(np.float32), bias, slope, shift

    def score(self, grams: list[int]) -> float:
        m = self.bias + (float(self.value[grams].sum()) / math.sqrt(len(grams)) if grams else 0.0)
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, self.slope * m + self.shift))))


def sample_of(rows: DataFrame, texts: dict[int, int], sample_rows: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """y, h and g of at most sample_rows distinct texts, by h. texts: how many of each class there are."""
    some = F.lit(False)
    for y, n in texts.items():
        take = min(n, max(1, sample_rows // 2, sample_rows - texts[1 - y]))
        mine = F.col("y") == y
        if take < n:
            # the last of so many hashes, the smallest first
            last = rows.where(mine).select("h").distinct().orderBy("h").limit(take).toArrow().column("h").to_numpy().max()
            mine &= F.col("h") <= int(last)
        some |= mine
    found = rows.where(some).dropDuplicates(["y", "h"]).toArrow().combine_chunks()
    y, h, g = (found.column(c).combine_chunks() for c in ("y", "h", "g"))
    y, h, flat, ends = y.to_numpy(), h.to_numpy(), g.flatten().to_numpy(), g.offsets.to_numpy()
    ends = ends - ends[0] if len(ends) else np.zeros(1, np.int32)
    order = np.lexsort((y, h))
    return y[order], h[order], [flat[ends[i] : ends[i + 1]] for i in order]


def fit(labelled: DataFrame, text: str = "text", label: str = "label", bits: int = 18, sample_rows: int = 20_000, cost: float = 1.0) -> Model:
    """A model from rows with a text and a label of 0 or 1."""
    text_batches(labelled.sparkSession)
    mask = (1 << bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for b in batches:
            for p in (b.slice(at, TEXTS_AT_ONCE) for at in range(0, b.num_rows, TEXTS_AT_ONCE)):
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), pa.array([ngrams(t.as_py(), shapes, mask) for t in p.column(2)], pa.list_(pa.int32()))], names=["y", "h", "g"])

    rows = labelled.where(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("y"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    rows = cut(rows.mapInArrow(run, "y int, h long, g array<int>"))
    sizes = rows.groupBy("y", "h").count().groupBy("y").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("texts")).collect()
    n = {r["y"]: r["n"] for r in sizes}
    if len(n) < 2:
        rate = (n.get(1, 0) + 1) / (sum(n.values()) + 2)
        return Model(bits, np.zeros(1 << bits), 0.0, 1.0, math.log(rate / (1 - rate)))
    counts = rows.select("y", F.explode("g").alias("g")).groupBy("g", "y").count().toArrow()  # at most 2 << bits rows
    r = ratios(*(counts.column(c).to_numpy() for c in ("g", "y", "count")), (n[0], n[1]), bits)
    texts = {r["y"]: r["texts"] for r in sizes}
    y, h, x = sample_of(rows, texts, sample_rows)
    fits = h % 4 != 3
    if len(set(y[fits])) < 2 or len(set(y[~fits])) < 2:
        fits[:] = True
    sign = np.where(y == 1, 1.0, -1.0)
    each = cost * np.where(y == 1, 0.5 * len(y) / max(1, (y == 1).sum()), 0.5 * len(y) / max(1, (y == 0).sum()))
    at = np.flatnonzero(fits)
    w, bias = dual_descent([x[i] for i in at], sign[at], r, each[at])
    value = w * r
    rest = np.flatnonzero(~fits) if not fits.all() else at
    margin = np.array([bias + (value[x[i]].sum() / math.sqrt(len(x[i])) if len(x[i]) else 0.0) for i in rest])
    share = np.array([texts[k] / (y == k).sum() for k in (0, 1)])  # texts that one of the sample stands for
    forget(rows)
    release(labelled.sparkSession)
    return Model(bits, value, bias, *logistic_curve(margin, y[rest], (share / share.min())[y[rest]]))


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """keep and the score of each row's whole text."""
    text_batches(df.sparkSession)
    keep = list(df.columns if keep is None else keep)
    d = df.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], F.col(text).alias("__text"))
    d = d.withColumn("__score", F.lit(0.0))
    mask = (1 << model.bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for b in batches:
            s = pa.array([model.score(ngrams(t.as_py(), shapes, mask)) for t in b.column("__text")], pa.float64())
            yield pa.RecordBatch.from_arrays([s if c == "__score" else b.column(c) for c in kept], names=kept)

    kept = [c for c in d.columns if c != "__text"]
    scored = d.mapInArrow(run, d.drop("__text").schema)
    return scored.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], F.col("__score").alias(out))


#: Labels of at most so many rows are sent to each executor (under 64 MB); more are joined by a shuffle.
LABELS_SENT = 2_000_000


def with_labels(docs: DataFrame, labels: DataFrame, column: str = "quality", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Text and label of the documents that have one."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.max(column).alias("label"))
    if known.limit(LABELS_SENT + 1).count() <= LABELS_SENT:
        known = F.broadcast(known)
    return docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(known, "__id").select("text", "label")


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo by; null for a null id."""
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(by))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from the labels of rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)))
    model = fit(with_labels(docs.where(~F.col("held_out")), table(spark, sf_dir, "labels")))
    d = score(docs, model, keep=["doc_id", "held_out"])
    return d.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
