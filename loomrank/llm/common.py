"""What the corpus operators share: input reading, text as bytes, hashing and shared tables."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.sources.tables import dropped, stored  # noqa: F401

#: Rows and bytes of a batch that goes to Python: whole texts are held, so few of them.
BATCH_ROWS, BATCH_BYTES = 400, 32 << 20
#: Slots of ids: at most so many are sent to every executor.
SLOTS = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the rows and the bytes of a batch handed to Python: a batch ends at the first row that reaches either."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """The id and text of each row, whatever other columns there are; a null text is empty."""
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), *(docs[c] for c in more)
    )


def narrowed(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key may be among the wanted ones: slots of keys, of a bounded number, tell most others before they
    are shuffled. A join by the key tells the rest."""
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS)).alias("slot")
    return rows.select("*", slot).join(F.broadcast(wanted.select(slot).distinct()), "slot", "left_semi").drop("slot")


def blocks(data: np.ndarray, ends: np.ndarray, most: int = 1 << 20):
    """Ranges of a text of about `most` bytes that end where `ends` is true, so that no word is cut."""
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + most)
        while b < n:
            stop = np.flatnonzero(ends[data[a:b]])
            if len(stop):
                b = a + int(stop[-1]) + 1
                break
            b = min(n, b + most)
        yield a, b
        a = b


def bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column, end to end, and where each row begins (one more than rows)."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


BASE = np.uint64(0x9E3779B97F4A7C15)
#: BASE is odd, so it has an inverse modulo 2**64.
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def power(which: str, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), BASE if which == "up" else INVERSE, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            _powers[which] = have = np.multiply.accumulate(out)
    return have[:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; equal bytes have equal hashes wherever they stand."""
    total = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix(np.arange(1, 257, dtype=np.uint64))[data] * power("up", len(data)), out=total[1:])
        h = (total[end] - total[start]) * power("down", len(data) + 1)[start]
        return mix(h ^ (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


FOLDS = 5


def released() -> None:
    """Gives memory that isn't used back to the system: workers live on between tasks, and what they keep adds up."""
    import pyarrow as pa

    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library isn't GNU's
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def bounded(run):
    """A function for mapInArrow whose worker gives its memory back when a partition is done."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            released()

    return whole


def held_out(doc_id):
    """Whether a row is kept from training: crc32 of its id as text leaves no rest by five; a null id isn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def share_of(doc_id, seed: int = 17):
    """A number from 0 to 1 that depends on the id alone, for samples of a known rate."""
    return F.pmod(F.xxhash64(F.coalesce(doc_id, F.lit(-1)), F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)


def runs(at: np.ndarray, most: int):
    """Row ranges of at most `most` bytes, or of one row."""
    a = 0
    while a < len(at) - 1:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1)
        yield a, min(b, len(at) - 1)
        a = b


def adam(loss_grad, params: list[np.ndarray], steps: int, rate: float) -> None:
    """Moves the parameters down the gradient, in place."""
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        for p, g, a, b in zip(params, loss_grad(), m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
