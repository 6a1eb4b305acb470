"""Language identification by error-correcting output codes over byte n-grams.

Each language has a codeword; for each bit a linear classifier over hashed n-grams of 1 to 4 bytes (letters in lower
case, other ASCII as one space) predicts whether the text's language has it. Decoding takes the codeword with the least
loss, each bit weighted by how well its classifier does on the sample; a small lead over the next one is flagged.

Training reads a bounded sample of labelled rows (ROWS in all, spread evenly over the languages); what comes to the
driver is one vector of fixed size for each sampled row.

Defined cases: a null text, or one without a letter, is `und` with score 0; where no language can be learned every
text is `und`; one language only is predicted with score 1; rows without lang are predicted but never learned from;
repeated rows each give their row; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import adam, bounded, bytes_of, held_out, read, share_of, small_batches, texts

DIMS = 4096
#: Rows of the training sample over all languages, the least of one language, and the most bits of a codeword.
ROWS, LEAST, BITS = 2400, 30, 31
#: Bytes whose n-grams are looked up at a time.
STEP = 1 << 19
UNKNOWN = "und"

LETTER_BYTES = np.array([i if i >= 128 or chr(i).isalpha() and chr(i).islower() else i + 32 if i < 128 and chr(i).isalpha() else 32 for i in range(256)], np.uint8)


def grams(raw: np.ndarray):
    """The hashed n-grams of one text's bytes, a part at a time."""
    b = LETTER_BYTES[raw]
    b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])] if len(b) else b
    b = np.concatenate([[32], b, [32]]).astype(np.uint32)
    for a in range(0, len(b) - 1, STEP):
        x = b[a : a + STEP + 3]
        h = np.uint32(0)
        for n in range(1, 5):
            if len(x) < n:
                break
            h = x[n - 1 :][: STEP] + (h[: len(x) - n + 1] if n > 1 else np.uint32(0)) * np.uint32(0x01000193) + np.uint32(n)
            yield ((h * np.uint32(0x9E3779B1)) >> np.uint32(20))[:STEP]


def features(raw: np.ndarray) -> np.ndarray:
    x = sum((np.bincount(g, minlength=DIMS) for g in grams(raw)), np.zeros(DIMS))
    return (x / max(1.0, x.sum())).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """A row of -1 and 1 for each of n languages: every split of up to five, else random splits that tell all apart."""
    if n <= 5:
        split = [[1 if k >> i & 1 else -1 for i in range(n)] for k in range(1, 2 ** (n - 1))]
        return np.array(split, np.float32).T.reshape(n, -1)
    rng, best = np.random.default_rng(n), None
    for _ in range(200):
        c = np.stack([rng.permutation(np.where(np.arange(n) % 2, 1, -1)) for _ in range(max(BITS, int(4 * np.log2(n))))], 1)
        apart = min((c[i] != c[i + 1 :]).sum(1).min() for i in range(n - 1))
        if best is None or apart > best[0]:
            best = apart, c
    return best[1].astype(np.float32)


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row of margins the language's number, its score and whether the next one is close."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.codes[None]) @ self.trust
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        top = np.sort(p, 1)
        return p.argmax(1), top[:, -1], top[:, -1] - top[:, -2] < 0.2


def train(x: np.ndarray, langs: list[str], l2: float = 1e-4, steps: int = 250) -> Model:
    names = sorted(set(langs))
    y = np.array([names.index(v) for v in langs])
    codes = codewords(len(names))
    scale = 1 / (x.std(0) + 1e-4)
    mean = x.mean(0)
    z = (x - mean) * scale
    target = codes[y]
    # each language weighs the same, however many rows it has
    weight = (len(y) / len(names) / np.bincount(y, minlength=len(names))[y] / len(y)).astype(np.float32)[:, None]
    w, b = np.zeros((x.shape[1], codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)

    def grad():
        g = -target / (1 + np.exp(np.clip(target * (z @ w + b), -30, 30))) * weight
        return [z.T @ g + l2 * w, g.sum(0)]

    adam(grad, [w, b], steps, 0.005)
    right = (np.sign(z @ w + b) == target).mean(0)
    return Model(names, codes, w * scale[:, None], b - (mean * scale) @ w, np.maximum(right - 0.5, 0.01) * 2)


def fit(docs: DataFrame, rows: int = ROWS) -> Model | None:
    """A model from a bounded sample of the rows that aren't held out."""
    small_batches(docs.sparkSession)
    known = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    known = known.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    each = max(LEAST, rows // len(counts))
    rates = F.create_map(*(F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1.0, 1.15 * each / n))))

    def run(batches):
        for b in batches:
            data, at = bytes_of(b.column("text"))
            x = [features(data[at[i] : at[i + 1]]).tobytes() for i in range(len(at) - 1)]
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(x, pa.binary())], names=["lang", "x"])

    kept = known.filter(share_of(F.col("doc_id")) < rates[F.col("lang")]).select("lang", "text")
    got = kept.mapInArrow(bounded(run), "lang string, x binary").limit(2 * max(rows, each * len(counts))).collect()
    if not got:
        return None
    return train(np.stack([np.frombuffer(r[1], np.float32) for r in got]), [r[0] for r in got])


def has_letter(raw: np.ndarray) -> bool:
    """Whether UTF-8 bytes hold a letter of any script."""
    low = raw | 32
    if ((low >= 97) & (low <= 122) & (raw < 128)).any():
        return True
    return bool((raw >= 128).any()) and any(map(str.isalpha, raw.tobytes().decode("utf-8", "ignore")))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """For each document its language, the score and whether the choice is ambiguous."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        m: Model | None = held.value
        for b in batches:
            data, at = bytes_of(b.column("text"))
            n = len(at) - 1
            known = np.array([m is not None and has_letter(data[at[i] : at[i + 1]]) for i in range(n)], bool)
            lang, score, close = np.full(n, UNKNOWN, object), np.zeros(n), np.ones(n, bool)
            if known.any():
                bits = m.codes.shape[1]
                margins = np.zeros((n, bits))
                for i in np.flatnonzero(known):
                    total, count = np.zeros(bits), 0
                    for g in grams(data[at[i] : at[i + 1]]):
                        if len(g) < DIMS:
                            total += m.weights[g].sum(0, dtype=np.float64)
                        else:
                            total += np.bincount(g, minlength=DIMS) @ m.weights
                        count += len(g)
                    margins[i] = total / max(count, 1) + m.bias
                if bits:
                    k, s, c = m.decode(margins)
                else:
                    k, s, c = np.zeros(n, int), np.ones(n), np.zeros(n, bool)
                lang[known], score[known], close[known] = np.array(m.langs, object)[k[known]], s[known], c[known]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(close)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return texts(docs).mapInArrow(bounded(run), "doc_id long, lang_pred string, score double, ambiguous boolean")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
