"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network in numpy.

A token is a run of letters, digits and characters beyond ASCII, or a run of other printable ASCII. Each token has a
sparse random index vector, drawn from its hash; a word's vector is the sum of the index vectors of its neighbours over
the training sample (random indexing), kept in a table of fixed size. A document is the mean of its words' vectors next
to the mean of the index vectors of its tokens' shapes (case, length, kind of symbols), and four figures: its length, the
bytes of a token, and the shares of tokens that repeat the one before or the one before that.
A network with one hidden layer turns that into a logit, whose temperature is set on a part of the sample that it
didn't train on, so that scores are probabilities.

Training reads a bounded sample: about ROWS labelled rows that aren't held out, picked by a hash of their ids, and of
those, in the order of the table, as many as SAMPLE_BYTES of text allow (10 KB a row, three times the usual). lang, source and doc_id are never inputs of a score.

Defined cases: empty and null texts have vectors of zeros and are scored like others; without a labelled row every
score is 0.5, with labels of one kind only all rows get nearly that label; of several labels of a document the largest
counts; rows without a label are scored, never learned from; repeated rows each give their row; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import adam, bounded, bytes_of, held_out, mix, read, released, runs, share_of, small_batches, span_hashes, texts

#: Rows and bytes of text of the training sample.
ROWS, SAMPLE_BYTES = 5000, 48 << 20
#: Rows of the table of word vectors, their width, and the width of the shapes' vectors.
WORDS, WIDTH, SHAPES = 1 << 14, 32, 48
HIDDEN = 24
THRESHOLD = 0.3
STEP = 1 << 20

_WORD = np.array([i >= 128 or chr(i).isalnum() for i in range(256)])
_SPACE = np.array([i < 128 and not chr(i).isprintable() or i == 32 for i in range(256)])
_UPPER, _LOWER, _DIGIT = (np.array([i < 128 and f(chr(i)) for i in range(256)]) for f in (str.isupper, str.islower, str.isdigit))


def index_vectors(h: np.ndarray, width: int) -> np.ndarray:
    """A sparse vector of -1, 0 and 1 for each hash: four of its places are set."""
    out = np.zeros((len(h), width), np.float32)
    rows = np.arange(len(h))
    for k in range(4):
        g = mix(h + np.uint64(k + 1))
        np.add.at(out, (rows, (g % np.uint64(width)).astype(np.int64)), np.where(g >> np.uint64(63), 1, -1).astype(np.float32))
    return out


#: Every shape that shapes() can name, by number.
SHAPE_COUNT = 256
_SHAPE_VECTORS = index_vectors(np.arange(SHAPE_COUNT, dtype=np.uint64) << np.uint64(8), SHAPES)


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash, the shape and the row of each token of some rows' bytes."""
    kind = np.where(_WORD[data], 1, np.where(_SPACE[data], 0, 2)).astype(np.int8)
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[at] = True  # no token spans two rows
    cuts = np.flatnonzero(edge)
    keep = kind[cuts[:-1]] > 0 if len(cuts) > 1 else np.zeros(0, bool)
    start, end = cuts[:-1][keep], cuts[1:][keep]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = lambda flag: (c := np.concatenate([[0], np.cumsum(flag[data], dtype=np.int64)]))[end] - c[start]
    size = end - start
    word = kind[start] == 1
    upper, lower, digit = total(_UPPER), total(_LOWER), total(_DIGIT)
    case = np.where(upper == 0, 0, np.where((upper == 1) & (lower > 0), 1, np.where(lower == 0, 2, 3)))
    wordy = case * 24 + np.minimum(size, 11) * 2 + (digit > 0)
    symbol = 96 + (data[start].astype(np.int64) % 32) * 4 + np.minimum(size, 4) - 1
    return span_hashes(data, start, end), np.where(word, wordy, symbol), np.searchsorted(at, start, "right") - 1


def learned(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Word vectors by random indexing: the index vectors of the two words before and after, summed and normalised."""
    table = np.zeros((WORDS, WIDTH), np.float32)
    for a, b in runs(at, STEP):
        h, _, row = tokens(data[at[a] : at[b]], at[a : b + 1] - at[a])
        vec, place = index_vectors(h, WIDTH), (h % np.uint64(WORDS)).astype(np.int64)
        for k in (1, 2):
            near = row[k:] == row[:-k]
            np.add.at(table, place[k:][near], vec[:-k][near])
            np.add.at(table, place[:-k][near], vec[k:][near])
    return table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1)


def pooled(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A row of features for each row of bytes."""
    n = len(at) - 1
    out = np.zeros((n, WIDTH + SHAPES + 4), np.float64)
    for a, b in runs(at, STEP):
        for lo in range(int(at[a]), max(int(at[b]), int(at[a]) + 1), STEP):  # a very long row by parts
            hi = min(int(at[b]), lo + STEP)
            h, shape, row = tokens(data[lo:hi], np.clip(at[a : b + 1], lo, hi) - lo)
            if not len(h):
                continue
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            rows = a + row[first]
            out[rows, :WIDTH] += np.add.reduceat(table[(h % np.uint64(WORDS)).astype(np.int64)], first, axis=0)
            out[rows, WIDTH:-4] += np.add.reduceat(_SHAPE_VECTORS[shape], first, axis=0)
            out[rows, -2] += np.diff(np.append(first, len(h)))
            for k in (1, 2):
                again = np.zeros(len(h))
                again[k:] = (h[k:] == h[:-k]) & (row[k:] == row[:-k])
                out[rows, -2 - k] += np.add.reduceat(again, first)
    count = out[:, -2].copy()
    out[:, :-2] /= np.maximum(count, 1)[:, None]
    out[:, -2] = np.log1p(count) / 10
    out[:, -1] = np.diff(at) / np.maximum(count, 1) / 10
    return out


@dataclass
class Model:
    table: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) * self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(logit(z, self.layers) / self.temperature, -30, 30)))


def logit(z: np.ndarray, layers: list[np.ndarray]) -> np.ndarray:
    w1, b1, w2, b2 = layers
    return np.tanh(z @ w1 + b1) @ w2 + b2[0]


def train(x: np.ndarray, y: np.ndarray, table: np.ndarray, steps: int = 600, l2: float = 1e-3) -> Model:
    """The network on four fifths of the rows, its temperature on the rest."""
    mean, scale = x.mean(0), 1 / (x.std(0) + 1e-3)
    z = np.clip((x - mean) * scale, -8, 8)
    rng = np.random.default_rng(5)
    test = np.arange(len(y)) % 5 == 0 if len(y) >= 25 else np.zeros(len(y), bool)
    zt, yt = z[~test], y[~test]
    layers = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(1)]

    def grad():
        w1, b1, w2, b2 = layers
        h = np.tanh(zt @ w1 + b1)
        g = (1 / (1 + np.exp(-np.clip(h @ w2 + b2[0], -30, 30))) - yt) / len(yt)
        back = g[:, None] * w2 * (1 - h * h)
        return [zt.T @ back + l2 * w1, back.sum(0), h.T @ g + l2 * w2, np.array([g.sum()])]

    adam(grad, layers, steps, 0.01)
    t = 1.0
    if test.any():
        raw, sign = logit(z[test], layers), np.where(y[test] > 0.5, 1, -1)
        t = min(np.geomspace(0.25, 4, 41), key=lambda v: np.logaddexp(0, -sign * raw / v).mean())
    return Model(table, mean, scale, layers, float(t))


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, most: int = SAMPLE_BYTES) -> Model | None:
    spark = docs.sparkSession
    known = labels.select(labels["doc_id"].cast("long").alias("_id"), labels["quality"].cast("int").alias("_y")).filter(F.col("_y").isNotNull() & ~held_out(F.col("_id")))
    n = known.count()
    if not n:
        return None
    # at most twice the rows asked for: few enough to be sent to every executor
    ids = known.filter(share_of(F.col("_id")) < min(1.0, rows / n)).limit(2 * rows).groupBy("_id").agg(F.max("_y").alias("_y"))
    sample = texts(docs).join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_y")
    got, held = [], 0
    for r in sample.toLocalIterator():
        got.append((r[0], r[1].encode("utf-8", "surrogatepass"), r[2]))
        held += len(got[-1][1])
        if held > most:
            break
    if not got:
        return None
    got.sort()
    raw = [x[1] for x in got]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    table = learned(data, at)
    model = train(pooled(data, at, table), np.array([float(x[2] > 0) for x in got]), table)
    del got, raw, data, at
    released()  # the driver's share of memory is small, and what comes after needs it
    return model


def scored(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The score and the decision for each document."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            data, at = bytes_of(b.column("text"))
            s = held.value.score(pooled(data, at, held.value.table)) if held.value else np.full(len(at) - 1, 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return texts(docs).mapInArrow(bounded(run), "doc_id long, score double, predicted int")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return scored(docs, fit(docs, read(spark, sf_dir, "labels"))).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def kept(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)
    at_text = docs.columns.index("text")

    def run(batches):
        for b in batches:
            column = b.column(at_text)
            data, at = bytes_of(column.fill_null("") if column.null_count else column)
            s = held.value.score(pooled(data, at, held.value.table)) if held.value else np.full(len(at) - 1, 0.5)
            yield b.filter(pa.array(s >= threshold))

    return docs.mapInArrow(bounded(run), docs.schema)
