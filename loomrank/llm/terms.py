"""Terms of texts by bytes: maximal runs of kept bytes, A-Z in lower case, found with numpy and held by Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import blocks, runs

#: Bytes of text that are split at a time.
STEP = 4 << 20


def kept_bytes(also: str = "") -> np.ndarray:
    """For each byte what it is in a term: letters in lower case, bytes beyond ASCII and `also` as they are, others 0."""
    return np.array([i if i >= 128 or chr(i) in also else ord(chr(i).lower()) if chr(i).isalpha() else 0 for i in range(256)], np.uint8)


LETTERS = kept_bytes()
ALNUM = kept_bytes("0123456789")


def split(data: np.ndarray, at: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, pa.StringArray]:
    """The row and the text of each term of some rows' bytes, in order; no term spans two rows."""
    if not len(data):
        return np.zeros(0, np.int64), pa.array([], pa.string())
    low = kept[data]
    inside = low > 0
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = edge[-1] = True
    before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(low[inside]))
    return np.searchsorted(at, start, "right") - 1, terms


def merged(rows: np.ndarray, terms: pa.Array, counts: np.ndarray | None = None) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Each row and term once, by row, with the sum of its counts (1 each without them)."""
    codes = terms.dictionary_encode()
    m = max(1, len(codes.dictionary))
    key = rows * m + codes.indices.to_numpy(zero_copy_only=False)
    if counts is None:
        key, n = np.unique(key, return_counts=True)
    else:
        key, inverse = np.unique(key, return_inverse=True)
        n = np.zeros(len(key), np.int64)
        np.add.at(n, inverse, counts)
    return key // m, codes.dictionary.take(pa.array(key % m)), n.astype(np.int64)


def counted(data: np.ndarray, at: np.ndarray, kept: np.ndarray, step: int = STEP) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Row, term and occurrences of every term of each row; a row longer than `step` bytes goes by parts."""
    parts, again = [], False
    for a, b in runs(at, step):
        long = at[b] - at[a] > step
        again |= bool(long)
        ranges = [(at[a] + x, at[a] + y) for x, y in blocks(data[at[a] : at[b]], kept == 0, step)] if long else [(at[a], at[b])]
        for x, y in ranges:
            rows, terms = split(data[x:y], at[a:b] - at[a] if not long else np.zeros(1, np.int64), kept)
            rows, terms, n = merged(rows + a, terms)
            parts.append((rows, terms, n))
    if not parts:
        return np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64)
    rows, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
    terms = pa.concat_arrays([p[1].cast(pa.large_string()) for p in parts])
    return merged(rows, terms, n) if again else (rows, terms, n)


def gathered(batches, column: str, most: int):
    """Arrow batches put together until their texts take `most` bytes; a batch is never split."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.column(column).nbytes
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
