"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Each text becomes a vector of statistics. Random Fourier features cos(w . x + b) approximate a Gaussian kernel over the
standardised statistics; ridge regression on them is fitted from normal equations that each partition sums for itself, and
the driver adds the few partial sums up. Isotonic regression on rows that the fit didn't see turns the scores into
probabilities of label 1. Every document is then scored in one pass over the texts.

Labels are learned from about max_rows labelled rows where there are more: those whose ids have a hash below the share that
max_rows is of them all; that bounds the calibration rows on the driver. The partial sums have a fixed size. Rows for which held_out() is true are never learned from. Scores
depend on the text alone.

Defined results: null and empty texts are scored like any other (all their statistics are 0). Without labels, or with one
label only, every score is that label's share (0.5 without any). Of several labels of one id each counts. Repeated rows
get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tessera.llm._common import Scratch, fresh, small_batches
from tessera.llm._words import PIECE, word_hashes

THRESHOLD = 0.3
MAX_ROWS = 100_000
FEATURES = 384
GAMMA = 0.04
RIDGE = 1e-3
#: Partitions that the learning rows are dealt to: one partial sum of FEATURES squared numbers each.
FIT_PARTITIONS = 16
_CLASS = np.zeros(256, np.int64)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("a") : ord("z") + 1] = 3
_CLASS[ord("0") : ord("9") + 1] = 4
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5
_CLASS[ord("!")] = 6
_CLASS[ord("|")] = 7
_CLASS[[ord(c) for c in "#*$%&<>@^~_=+/\\[]{}"]] = 8
_CLASS[0x80:0xC0] = 9
_CLASS[0xC0:] = 10
N_STATS = 22


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: a fifth, by a checksum of the id's text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def statistics(text: str | None) -> np.ndarray:
    """Statistics of a whole text, all of them shares, means or logarithms."""
    out = np.zeros(N_STATS)
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return out
    counts = np.zeros(11)
    for i in range(0, len(data), PIECE):
        counts += np.bincount(_CLASS[np.frombuffer(data, np.uint8)[i : i + PIECE]], minlength=11)
    hashes = word_hashes(data)
    n, solid = len(hashes), max(1.0, counts.sum() - counts[1])
    out[0] = np.log1p(n) / 3
    out[1:10] = np.sqrt(counts[2:11] / solid)
    out[10] = np.log1p(solid / max(1, n))
    lines = data.split(b"\n")
    out[11] = np.log1p(n / len(lines))
    out[12] = 1 - len(set(lines)) / len(lines)
    if n:
        kinds, times = np.unique(hashes, return_counts=True)
        out[13] = len(kinds) / n
        out[14] = times.max() / n
        out[15] = np.count_nonzero(hashes[1:] == hashes[:-1]) / n
        share = times / n
        out[16] = -(share * np.log(share)).sum() / max(1.0, np.log(n))
    if n > 2:
        pairs = hashes[1:] * np.uint64(3) + hashes[:-1]
        out[17] = len(np.unique(pairs)) / (n - 1)
    out[18] = np.sqrt(data.count(b". ") / max(1, n))
    out[19] = np.sqrt(sum(1 for x in lines if x.endswith((b".", b"?", b"!"))) / len(lines))
    upper = sum(1 for x in lines if len(x) > 3 and x == x.upper())
    out[20] = np.sqrt(upper / len(lines))
    out[21] = np.sqrt(data.count(b"!!") / max(1, n))
    return out


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, probability), both rising. Equal scores are pooled first.

    A pooled block is one knot at its mean score, and two more beyond the ends lead half way to 0 and 1; between knots the
    probability is interpolated. So different scores get different probabilities, and documents can be ranked by them.
    """
    order = np.argsort(score, kind="stable")
    at, first = np.unique(score[order], return_index=True)
    weight = np.diff(np.append(first, len(order))).astype(float)
    total = np.add.reduceat(label[order].astype(float), first)
    stack: list[list[float]] = []  # label sum, weight, weighted sum of scores
    for x, s, w in zip(at.tolist(), total.tolist(), weight.tolist(), strict=True):
        stack.append([s, w, x * w])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
            top = stack.pop()
            stack[-1] = [a + b for a, b in zip(stack[-1], top, strict=True)]
    xs = np.array([b[2] / b[1] for b in stack])
    ps = np.maximum.accumulate(np.array([(b[0] + 0.5) / (b[1] + 1.0) for b in stack]))
    reach = max(1.0, float(at[-1] - at[0]))
    return np.concatenate(([at[0] - reach], xs, [at[-1] + reach])), np.concatenate(([ps[0] / 2], ps, [(1 + ps[-1]) / 2]))


class Model:
    """Standardisation, random features, ridge weights and calibration knots: small arrays that travel with the tasks."""

    def __init__(self, mean, scale, w, b, beta=None, knots=None, constant=None) -> None:
        self.mean, self.scale, self.w, self.b, self.beta, self.knots, self.constant = mean, scale, w, b, beta, knots, constant

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.sqrt(2.0 / self.w.shape[1]) * np.cos(((x - self.mean) / self.scale) @ self.w + self.b)
        return np.hstack([z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return np.clip(np.interp(self.raw(x), *self.knots), 0.0, 1.0)


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (_id, x): the statistics of each text."""
    small_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["_id", "x"])

    return picked.mapInArrow(measure, StructType([picked.schema["_id"], StructField("x", ArrayType(DoubleType()))]))


def fit(stats: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", max_rows: int = MAX_ROWS, features: int = FEATURES, gamma: float = GAMMA, ridge: float = RIDGE, seed: int = 7) -> Model:
    """Learns from measured() rows of labelled documents that are not held out; a quarter of them only calibrates."""
    scratch = Scratch(stats.sparkSession)
    rng = np.random.Generator(np.random.PCG64(seed))
    w, b = rng.normal(0, np.sqrt(2 * gamma), (N_STATS, features)), rng.uniform(0, 2 * np.pi, features)
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).where(F.col("_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("_id")))
    count = known.count()
    mark = F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1 << 20))
    if count > max_rows:
        known = known.where(mark < int((1 << 20) * max_rows / count))
    known = known.withColumn("use", F.pmod(F.xxhash64("_id", F.lit(seed + 1)), F.lit(4)))
    rows = scratch.write(stats.join(known, "_id").select("x", "y", "use").repartition(FIT_PARTITIONS))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, N_STATS))
        for batch in batches:
            x, y = np.array(batch.column(0).to_pylist()).reshape(-1, N_STATS), np.array(batch.column(1))
            total += [x.sum(0), (x * x).sum(0), np.r_[len(y), y.sum(), np.zeros(N_STATS - 2)]]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["s"])

    sums = sum((np.frombuffer(r.s).reshape(3, N_STATS) for r in rows.where("use > 0").mapInArrow(moments, "s binary").collect()), np.zeros((3, N_STATS)))
    n, ones = sums[2, 0], sums[2, 1]
    if not 0 < ones < n:
        return Model(None, None, None, None, constant=0.5 if not n else float(ones > 0))
    mean = sums[0] / n
    model = Model(mean, np.sqrt(np.maximum(sums[1] / n - mean**2, 1e-6)), w, b)
    even = {0: n / (2 * (n - ones)), 1: n / (2 * ones)}  # both labels weigh alike in the fit; calibration restores the shares

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((features + 1, features + 2))
        for batch in batches:
            z, y = model.features(np.array(batch.column(0).to_pylist()).reshape(-1, N_STATS)), np.array(batch.column(1))
            weight = np.where(y == 1, even[1], even[0])[:, None]
            total += (z * weight).T @ np.hstack([z, y[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["s"])

    total = np.zeros((features + 1, features + 2))
    for r in rows.where("use > 0").mapInArrow(normal, "s binary").toLocalIterator():  # FIT_PARTITIONS partial sums, one at a time
        total += np.frombuffer(r.s).reshape(total.shape)
    model.beta = np.linalg.solve(total[:, :-1] + ridge * n * np.eye(features + 1) / features, total[:, -1])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(np.array(batch.column(0).to_pylist()).reshape(-1, N_STATS))
            yield pa.RecordBatch.from_arrays([pa.array(raw), batch.column(1)], names=["r", "y"])

    held = rows.where("use = 0").mapInArrow(judged, "r double, y int").toPandas()  # a quarter of max_rows at most
    if len(held):
        model.knots = isotonic(held["r"].to_numpy(), held["y"].to_numpy())
    else:
        model.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    scratch.drop(rows)
    return model


def _judge(model: Model, x: pa.Array) -> pa.Array:
    return pa.array(model.score(np.array(x.to_pylist()).reshape(-1, N_STATS)))


def score(docs: DataFrame, model: Model, *, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """The columns of docs with the score of each text, in one pass over the texts."""
    small_batches(docs.sparkSession)
    names = docs.columns
    if out_col in names:
        raise ValueError(f"docs already has a column {out_col}")
    place = names.index(text_col)
    schema = StructType([*docs.schema.fields, StructField(out_col, DoubleType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(place).to_pylist()]).reshape(-1, N_STATS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], names=[*names, out_col])

    return docs.mapInArrow(judge, schema)


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """Rows (id, held_out, score, predicted), one for each document. Texts are read once; their statistics are written."""
    stats = Scratch(docs.sparkSession).write(measured(docs, id_col=id_col, text_col=text_col))
    model = fit(stats, labels, id_col=id_col, **options)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _judge(model, batch.column(1))], names=["_id", "score"])

    scored = stats.mapInArrow(judge, StructType([stats.schema["_id"], StructField("score", DoubleType())]))
    return scored.select(F.col("_id").alias(id_col), F.coalesce(held_out(F.col("_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents that the classifier doesn't reject, with the columns of docs."""
    scratch = Scratch(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull()).select(id_col).distinct()
    stats = scratch.write(measured(docs, id_col=id_col, text_col=text_col).join(known.withColumnRenamed(id_col, "_id"), "_id", "left_semi"))
    model = fit(stats, labels, id_col=id_col, **options)
    scratch.drop(stats)
    name = fresh(docs, "_score")
    return score(docs, model, text_col=text_col, out_col=name).where(F.col(name) >= threshold).drop(name)
