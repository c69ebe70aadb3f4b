"""Quality classifier: Naive Bayes support vectors.

Features are indicators of word 1- and 2-grams (A-Z lower-cased) and of byte
3-grams, hashed to 2**18.  Each is scaled by the log ratio of its smoothed
class shares; documents are scaled to unit length; a linear hinge-loss model
is fitted by dual coordinate descent, and its margins are mapped to
probabilities by a logistic fit.

The model is fitted on at most ``bound`` labelled documents (those of the
least hash of doc_id, so the choice does not depend on order or partitions).
Scoring is one pass over all documents, without a shuffle.

Rows: null and empty texts have no features and get the model's constant;
labels of null quality or doc_id are ignored; of several labels of one doc_id
the least holds; with no labels, or one class, every score is the smoothed
share of label 1 (0.5 without labels).  Repeated rows are scored one by one.
Only doc_id and text are read; labels, lang, source and doc_id are no inputs.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitwise.llm.tables import settle, small_batches
from pitwise.llm.tokens import Words, chunks

BITS = 18
SLICE = 512  # rows of an Arrow batch that are held as Python strings at once
SIZE = 1 << BITS
BOUND = 8192


def features(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The distinct feature numbers of each text."""
    mark = np.zeros(SIZE, np.int64)
    for lo, hi in chunks(texts):
        w = Words(texts[lo:hi], "space", True)
        shift = np.uint64(64 - BITS)
        i = np.arange(len(w.start))
        one = (w.runs(i, i + 1) >> shift).astype(np.int64)
        j = i[i + 2 <= w.stop]
        two = (w.runs(j, j + 2) >> shift).astype(np.int64)
        two_first = np.searchsorted(j, w.first)
        b = w.buf.astype(np.uint32)
        tri = ((b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(2654435761) >> np.uint32(32 - BITS)).astype(np.int64) if len(b) > 2 else b[:0].astype(np.int64)
        for d in range(hi - lo):
            start, stop = w.at[d], w.at[d + 1] - 1
            f = np.concatenate((one[w.first[d]:w.first[d + 1]], two[two_first[d]:two_first[d + 1]], tri[start:max(start, stop - 2)]))
            order = np.arange(len(f))
            mark[f] = order
            yield f[mark[f] == order]


@dataclass
class Model:
    weight: np.ndarray   # of scaled features
    ratio: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, texts: list[str | None]) -> np.ndarray:
        product, square = self.weight * self.ratio, self.ratio ** 2
        out = []
        for f in features(texts):
            norm = float(np.sqrt(square[f].sum()))
            out.append(self.bias + (float(product[f].sum()) / norm if norm else 0.0))
        return np.array(out)

    def narrow(self) -> Model:
        """This model in single precision, as rows are scored."""
        return Model(self.weight.astype(np.float32), self.ratio.astype(np.float32), self.bias, self.slope, self.offset)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.offset, -500, 500)))


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, with targets drawn in by the class sizes."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, theta = np.stack((margin, np.ones_like(margin)), 1), np.array([1.0, 0.0])
    loss = lambda t: float(np.sum(np.logaddexp(0, x @ t) - target * (x @ t)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ theta)))
        grad = x.T @ (p - target)
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), grad)
        step = 1.0
        while step > 1e-6 and loss(theta - step * move) > loss(theta):
            step /= 2
        theta = theta - step * move
        if np.abs(step * move).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def fit(indices: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 7) -> Model:
    """Dual coordinate descent for the hinge loss with class-balanced costs."""
    y = np.where(labels > 0, 1.0, -1.0)
    pos, neg = int((y > 0).sum()), int((y < 0).sum())
    zero = np.zeros(SIZE)
    if not pos or not neg:
        share = (pos + 1) / (pos + neg + 2)
        return Model(zero, zero, 0.0, 0.0, float(np.log(share / (1 - share))))
    counts = np.ones((2, SIZE))
    for f, t in zip(indices, y, strict=True):
        counts[int(t > 0)][f] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    norms = [float(np.sqrt((ratio[f] ** 2).sum())) or 1.0 for f in indices]
    # scaled features are made anew at each step: the driver holds the feature numbers alone
    scaled = lambda i: ratio[indices[i]] / norms[i]
    q = np.array([float(v @ v) + 1.0 for v in map(scaled, range(len(y)))])
    upper = np.where(y > 0, cost * len(y) / (2 * pos), cost * len(y) / (2 * neg))
    weight, bias, alpha, rng = np.zeros(SIZE), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(y)):
            f, v = indices[i], scaled(i)
            g = y[i] * (float(weight[f] @ v) + bias) - 1.0
            new = min(max(alpha[i] - g / q[i], 0.0), upper[i])
            if (step := new - alpha[i]):
                alpha[i] = new
                weight[f] += step * y[i] * v
                bias += step * y[i]
                most = max(most, abs(step))
        if most < 1e-3:
            break
    margin = np.array([float(weight[f] @ scaled(i)) + bias for i, f in enumerate(indices)])
    return Model(weight, ratio, bias, *_logistic(margin, y))


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def train(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> Model:
    """Fit on at most ``bound`` labelled documents outside the held-out fold."""
    usable = labels.select("doc_id", "quality").filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    schema = T.StructType([T.StructField("quality", T.IntegerType()), T.StructField("f", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # gaps between sorted feature numbers, packed: a quarter of the bytes on their way
            lists = [zlib.compress(np.diff(np.sort(f).astype(np.int32), prepend=np.int32(0)).tobytes(), 1) for f in features(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(lists, pa.binary())], ["quality", "f"])

    # at most bound rows of 12 bytes are broadcast, and as many feature lists come back: of the rows of a repeated doc_id, the least text
    known = chosen.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("quality"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))
    texts = texts.groupBy("label_id", "quality").agg(F.min("text").alias("text"))
    with small_batches(docs.sparkSession):
        got = texts.select("quality", "text").mapInArrow(run, schema).toArrow()
    # in a fixed order whatever that of the partitions
    y = got.column("quality").to_numpy()
    indices = [np.cumsum(np.frombuffer(zlib.decompress(f.as_buffer()), np.int32), dtype=np.int32) for f in got.column("f")]
    digests = [hashlib.blake2b(f, digest_size=16).digest() for f in indices]
    order = sorted(range(len(y)), key=lambda i: (y[i], digests[i]))
    return fit([indices[i] for i in order], y[order])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    small = model.narrow()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = small.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()),
        T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rows.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all their columns, that the model does not reject (score
    below 0.5, by the same arithmetic as ``score``); null and empty texts get the
    model's constant, repeated rows are judged one by one."""
    small = model.narrow()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                yield part.filter(pa.array(small.scores(part.column("text").to_pylist()) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
