"""Toxicity: a linear classifier over character n-grams, whose features are scaled by naive Bayes log-count ratios.

A text is folded to bytes: letters in lower case, bytes beyond ASCII as they are, any run of others as one space, a space
at both ends. Its n-grams of 3 to 6 bytes fall into 2**BITS buckets by hash. A bucket's feature is the square root of its
share of the text's n-grams, times the log of the ratio of its smoothed shares among toxic and other texts. Logistic
regression over the FEATURES buckets that tell the classes apart best gives a margin; margins of a fifth of the sample, which
the weights haven't seen, set slope and offset, so that scores are probabilities at the labels' own share of toxic texts.

Training reads a bounded sample: of the labelled rows that aren't held out, the TOXIC and OTHERS ones of least hash of their
ids. Sums for the ratios are whole numbers, so they don't depend on the order of tasks; what comes to the driver is a row
for each chosen bucket and at most FEATURES figures for each sampled row. lang, source and doc_id are never inputs of a score.

Defined cases: empty and null texts have no n-grams and get the score of the offset alone; without a labelled text every
score is 0, with labelled texts of one kind only every score is that label; of several labels of a document the largest counts, of
several texts of an id the least; rows without a label are scored, never learned from; repeated rows each give their row; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import adam, bounded, bytes_of, held_out, read, small_batches, stored, texts
from .language import LETTER_BYTES

#: Labelled rows of the training sample, toxic and other.
TOXIC, OTHERS = 2000, 3000
BITS, FEATURES = 18, 1 << 13
SHORTEST, LONGEST = 3, 6
THRESHOLD = 0.5
#: Bytes whose n-grams are looked up at a time, and the scale of the sums.
STEP, SCALE = 1 << 19, float(1 << 24)


def grams(raw: np.ndarray):
    """The buckets of one text's n-grams, a part at a time."""
    b = LETTER_BYTES[raw]
    b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])] if len(b) else b
    b = np.concatenate([[] if len(b) and b[0] == 32 else [32], b, [] if len(b) and b[-1] == 32 else [32]]).astype(np.uint32)
    for a in range(0, len(b), STEP):
        x = b[a : a + STEP + LONGEST - 1]
        h = np.uint32(0)
        for n in range(1, LONGEST + 1):
            if len(x) < n:
                break
            h = x[n - 1 :] + (h[: len(x) - n + 1] if n > 1 else np.uint32(0)) * np.uint32(0x01000193) + np.uint32(n)
            if n >= SHORTEST:
                yield ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))[:STEP]


def shares(raw: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
    """The square root of each place's share of a text's n-grams; place: each bucket's, `size` for those left out."""
    counts, total = np.zeros(size + 1), 0
    for g in grams(raw):
        counts += np.bincount(place[g], minlength=size + 1)
        total += len(g)
    return np.sqrt(counts[:size] / max(total, 1))


def present(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that a text has, and the square roots of their shares."""
    if len(raw) > STEP:
        x = shares(raw, np.arange(1 << BITS), 1 << BITS)
        return np.flatnonzero(x), x[x > 0]
    some, n = np.unique(np.concatenate([np.zeros(0, np.uint32), *grams(raw)]), return_counts=True)
    return some.astype(np.int64), np.sqrt(n / max(1, n.sum()))


@dataclass
class Model:
    place: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float

    def score(self, raw: np.ndarray) -> float:
        margin = float(shares(raw, self.place, len(self.weights)) @ self.weights) if len(self.weights) else 0.0
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40))))


def sample(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, others: int = OTHERS) -> tuple[DataFrame, np.ndarray]:
    """The rows to learn from (y, text), stored, and how many labelled rows of each class there are."""
    known = labels.select(labels["doc_id"].cast("long").alias("_id"), labels["toxic"].cast("int").alias("_y"))
    known = known.filter(F.col("_y").isNotNull() & F.col("_id").isNotNull() & ~held_out(F.col("_id"))).groupBy("_id").agg((F.max("_y") > 0).cast("int").alias("_y"))
    counts = np.zeros(2, np.int64)
    for y, n in known.groupBy("_y").count().collect():
        counts[y] = n
    least = lambda y, n: known.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n)
    ids = least(1, toxic).unionByName(least(0, others))  # bounded: so they can be sent to every executor
    found = texts(docs).join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    return stored(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_y").alias("y")), "toxicity-sample"), counts


def ratios(rows: DataFrame, n: dict[int, int], features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that tell the classes apart best, and the naive Bayes log-count ratio of each; n: rows of each class."""
    size = 1 << BITS

    def run(batches):
        sums = np.zeros((6, size), np.int64)  # x, x*x and share, of others and of toxic texts
        for b in batches:
            data, at = bytes_of(b.column("text"))
            for i, y in enumerate(b.column("y").to_pylist()):
                some, x = present(data[at[i] : at[i + 1]])
                for k, v in enumerate((x, x**2, x**2 * SCALE)):
                    sums[2 * k + y, some] += np.rint(v * SCALE).astype(np.int64)
        some = np.flatnonzero(sums.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(s[some]) for s in sums)], names=names)

    names = ["bucket", "x0", "x1", "xx0", "xx1", "share0", "share1"]
    sums = rows.select("y", "text").mapInArrow(bounded(run), ", ".join(f"{c} long" for c in names)).groupBy("bucket").agg(*(F.sum(c).alias(c) for c in names[1:]))
    mean = lambda c, y: F.col(f"{c}{y}") / float(n[y] * SCALE)
    noise = lambda y: (mean("xx", y) - mean("x", y) * mean("x", y)) / float(n[y])
    apart = F.abs(mean("x", 1) - mean("x", 0)) / F.sqrt(noise(0) + noise(1) + 1e-9)
    got = sums.select("bucket", (mean("share", 1) / SCALE).alias("p"), (mean("share", 0) / SCALE).alias("q"), apart.alias("apart")).orderBy(F.desc("apart"), "bucket").limit(features).collect()
    p, q = np.array([r["p"] for r in got]), np.array([r["q"] for r in got])
    smooth = 0.2 / size
    return np.array([r["bucket"] for r in got], np.int64), np.log((p + smooth) / (q + smooth))


def train(y: np.ndarray, row: np.ndarray, column: np.ndarray, value: np.ndarray, size: int, weight: np.ndarray, steps: int = 150, l2: float = 1e-4) -> np.ndarray:
    """Weights of logistic regression over sparse features, in row order; weight: of each row."""
    w, b = np.zeros(size), np.zeros(1)
    order = np.argsort(column, kind="stable")  # by column too, so that both sums run along memory
    by_row, by_column = row[order], value[order]
    half = np.float32
    first, some = np.unique(column[order], return_index=True)[::-1]
    starts, rows = np.unique(row, return_index=True)[::-1]

    def grad():
        z = np.full(len(y), b[0])
        z[rows] += np.add.reduceat(value * w.astype(half)[column], starts)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        out = l2 * w
        out[some] += np.add.reduceat(by_column * g.astype(half)[by_row], first)
        return [out, np.array([g.sum()])]

    if len(row):
        adam(grad, [w, b], steps, 0.05)
    return np.append(w, b)


def line(z: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and offset that make margins into log odds."""
    s, centre = max(float(z.std()), 1e-6), float(z.mean())
    a, b = np.ones(1), np.full(1, np.log(prior / (1 - prior)))
    x = (z - centre) / s

    def grad():
        g = (1 / (1 + np.exp(-np.clip(a[0] * x + b[0], -30, 30))) - y) * weight
        return [np.array([(g * x).sum() + 1e-4 * a[0]]), np.array([g.sum()])]

    adam(grad, [a, b], 600, 0.05)
    return float(a[0] / s), float(b[0] - a[0] * centre / s)


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, others: int = OTHERS, features: int = FEATURES) -> Model | None:
    small_batches(docs.sparkSession)
    rows, counts = sample(docs, labels, toxic, others)
    n = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    if not n:
        return None
    buckets, ratio = ratios(rows, n, features) if len(n) == 2 else (np.zeros(0, np.int64), np.zeros(0))
    size = len(buckets)
    place = np.full(1 << BITS, size, np.int32)
    if len(n) < 2:
        return Model(place, np.zeros(0), 0.0, 40.0 if 1 in n else -40.0)
    place[buckets] = np.arange(size)

    def run(batches):
        for b in batches:
            data, at = bytes_of(b.column("text"))
            found = [shares(data[at[i] : at[i + 1]], place, size) for i in range(len(at) - 1)]
            some = [np.flatnonzero(x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("y"), *(pa.array(v, pa.binary()) for v in ([k.astype(np.int32).tobytes() for k in some], [x[k].astype(np.float32).tobytes() for x, k in zip(found, some, strict=True)]))],
                names=["doc_id", "y", "k", "x"],
            )

    # numbers of half the usual width: this is all that the driver holds
    got = sorted(rows.select("doc_id", "y", "text").mapInArrow(bounded(run), "doc_id long, y int, k binary, x binary").collect(), key=lambda r: r["doc_id"])
    y = np.array([r["y"] for r in got], float)
    columns, values = [np.frombuffer(r["k"], np.int32) for r in got], [np.frombuffer(r["x"], np.float32) for r in got]
    del got
    row, column = np.repeat(np.arange(len(y), dtype=np.int32), [len(k) for k in columns]), np.concatenate(columns)
    value = np.concatenate(values) * ratio.astype(np.float32)[column]
    del columns, values
    scale = max(float(np.sqrt(value @ value / len(y))), 1e-9)
    value /= np.float32(scale)
    test = np.arange(len(y)) % 5 == 0 if min(y.sum(), (1 - y).sum()) >= 25 else np.zeros(len(y), bool)
    learn = ~test
    number, use = np.cumsum(learn) - 1, learn[row]
    share = np.bincount(y[learn].astype(int), minlength=2)
    w = train(y[learn], number[row[use]], column[use], value[use], size, 0.5 / np.maximum(share, 1)[y[learn].astype(int)])
    margin = np.bincount(row, value * w.astype(np.float32)[column], len(y)) + w[-1]
    check = test if test.any() else learn
    seen = np.bincount(y[check].astype(int), minlength=2)
    prior = counts / counts.sum()
    slope, offset = line(margin[check], y[check], (prior / np.maximum(seen, 1))[y[check].astype(int)], float(prior[1]))
    return Model(place, w[:-1] * ratio / scale, slope, slope * float(w[-1]) + offset)


def scored(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The score and the decision for each document."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        m: Model | None = held.value
        for b in batches:
            data, at = bytes_of(b.column("text"))
            s = np.array([m.score(data[at[i] : at[i + 1]]) if m else 0.0 for i in range(len(at) - 1)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return texts(docs).mapInArrow(bounded(run), "doc_id long, score double, predicted int")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return scored(docs, fit(docs, read(spark, sf_dir, "labels"))).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
