"""Suffix-array deduplication: bytes covered by a 200-byte string that starts at two places or more.

Column-wise construction over many strings: each round takes one symbol of every string, from the last column to the
first, and updates the order of all suffixes that begin at that column (a stable counting sort of the order so far) and
their common prefixes with their neighbours. Neighbours whose common prefix is 200 or more begin a repeated string.
Columns come one by one from a temporary file that is written and read in sequence; only the order and the prefixes
are in memory.

So that the strings have bounded length and the work can be spread, they are not whole documents but the surroundings
of anchors. An anchor is a 48-byte string whose hash is the least in some window of 200 bytes (all that tie). Equal
windows have their anchors at equal offsets, so a window that repeats is found among the surroundings of one anchor, in
the same column; anchors whose hash occurs once are left out. The 352 bytes around an anchor hold all windows that have
it. The surroundings of an anchor go to one task, in bounded chunks of whole anchors.

Anchors that occur more than HOT times are not brought together: their windows are hashed (64 bits), counted with
partial sums and joined, which spreads any number of them. Texts that are copies of each other are found by a 128-bit
hash and are covered throughout; one of each takes part for the sake of others.

Defined cases: a null text is empty; texts of fewer than 200 bytes keep everything; repeated rows are copies of each
other, whatever their ids; rows of one id with different texts are judged apart; null ids are allowed; other columns
are ignored; an empty table gives no rows. In cleaned texts a character that is cut is dropped whole.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, bytes_of, dropped, mix, narrowed, power, read, small_batches, stored
from .near_dedup import LEAST_ID, keyed, whole_rows

LENGTH, ANCHOR = 200, 48
REACH = LENGTH - ANCHOR
#: Occurrences of an anchor that one task takes; strings of one construction.
HOT, CHUNK = 30_000, 32_768


_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def _prefix(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTES[data] * power("up", len(data)), out=total[1:])
    return total


def rolling(total: np.ndarray, size: int) -> np.ndarray:
    """The hash of each string of `size` bytes, from the prefix sums."""
    with np.errstate(over="ignore"):
        return mix((total[size:] - total[:-size]) * power("down", len(total) - size))


def sliding(x: np.ndarray, size: int, best) -> np.ndarray:
    """The least (or greatest) of each `size` neighbours, by doubling."""
    n = len(x) - size + 1
    reach = 1
    while reach * 2 <= size:
        x = best(x[:-reach], x[reach:])
        reach *= 2
    return best(x[:n], x[size - reach :][:n])


def anchors(data: np.ndarray, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Places of a text's anchors and their hashes. A long text is read in blocks with all that their anchors depend on."""
    n, places, hashes = len(data), [], []
    for a in range(0, max(1, n), step):
        lo = max(0, a - REACH)
        at, h = _anchors(_prefix(data[lo : min(n, a + step + LENGTH)]))
        own = (at + lo >= a) & (at + lo < a + step)
        places.append(at[own] + lo)
        hashes.append(h[own])
    return np.concatenate(places), np.concatenate(hashes)


def _anchors(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(total) <= LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = rolling(total, ANCHOR)
    least = sliding(h, REACH + 1, np.minimum)
    # a place is an anchor if some window that holds it has its hash as the least: that is the greatest of their leasts
    pad = np.zeros(REACH, np.uint64)
    most = sliding(np.concatenate([pad, least, pad]), REACH + 1, np.maximum)
    at = np.flatnonzero(h == most)
    return at, h[at]


def repeated_columns(rows: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each string the first and the last column at which a 200-byte string begins that another one has in the same
    column; -1 where none does. rows: strings of equal width, of which begin and end tell the columns with bytes."""
    n, width = rows.shape
    first, last = np.full(n, -1), np.full(n, -1)
    with tempfile.TemporaryFile() as columns:
        for c in range(width - 1, -1, -1):
            columns.write(np.ascontiguousarray(rows[:, c]).tobytes())
        columns.seek(0)
        # before the first round all suffixes are empty; common[k]: the prefix that the k-th shares with the one before it
        order, common = np.arange(n), np.zeros(n, np.int16)
        for c in range(width - 1, -1, -1):
            symbol = np.frombuffer(columns.read(2 * n), np.uint16)[order]
            by = np.argsort(symbol, kind="stable")
            symbol = symbol[by]
            same = np.flatnonzero(symbol[1:] == symbol[:-1]) + 1
            new = np.zeros(n, np.int16)
            new[same] = _least(common, by[same - 1] + 1, by[same]) + 1
            order, common = order[by], new
            if c <= REACH:
                long = common >= LENGTH
                hit = order[np.flatnonzero(long | np.concatenate([long[1:], [False]]))]
                hit = hit[(begin[hit] <= c) & (c + LENGTH <= end[hit])]
                first[hit] = c
                last[hit] = np.maximum(last[hit], c)
    return first, last


def _least(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of x[lo..hi], both included, for each pair."""
    out = np.empty(len(lo), x.dtype)
    size = hi - lo + 1
    level, table = 0, x
    while len(lo):
        now = (size >> level) == 1
        if now.any():
            out[now] = np.minimum(table[lo[now]], table[hi[now] - (1 << level) + 1])
        level += 1
        if not (size >> level).any():
            break
        half = 1 << (level - 1)
        table = np.minimum(table[:-half], table[half:])
    return out


def _anchored(docs: DataFrame) -> DataFrame:
    """The distinct anchors of each document, and whether one occurs in it once or more often (1 or 2)."""

    def run(batches):
        for b in batches:
            data, at = bytes_of(b.column("text"))
            ids = b.column("doc_id").to_numpy()
            hashes, counts, n = [], [], []
            for k in range(len(at) - 1):
                h, c = np.unique(anchors(data[at[k] : at[k + 1]])[1], return_counts=True)
                hashes.append(h)
                counts.append(np.minimum(c, 2))
                n.append(len(h))
            if hashes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, n)), pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(counts).astype(np.int32))], names=["doc_id", "h", "c"]
                )

    return docs.select("doc_id", "text").mapInArrow(bounded(run), "doc_id long, h long, c int")


def _packed(docs: DataFrame) -> DataFrame:
    import zstandard

    def run(batches):
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            packed = [z.compress(t.encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(packed, pa.binary())], names=["doc_id", "key", "z"])

    return docs.mapInArrow(bounded(run), "doc_id long, key binary, z binary")


def _marked(batches):
    """Texts with the places of those of their anchors that are wanted."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        for i, key, z, wanted in zip(*(b.column(c).to_pylist() for c in ("doc_id", "key", "z", "wanted")), strict=True):
            data = np.frombuffer(unpack.decompress(z), np.uint8)
            at, h = anchors(data)
            keep = np.isin(h, np.array(wanted, np.int64).view(np.uint64))
            yield i, key, data, at[keep], h[keep]


SPANS = "doc_id long, key binary, a long, b long"


def _surroundings(batches):
    """The bytes around each wanted anchor, where they can hold a repeated string. Of those that a text has more than once
    one goes on, for the sake of other texts; what they cover in this text is known at once and goes on as spans."""
    names = ["h", "doc_id", "key", "p", "around", "a", "b"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    rows = []
    for i, key, data, at, hashes in _marked(batches):
        n, raw = len(data), data.tobytes()
        places: dict[tuple, list[int]] = {}
        for p, h in zip(at.tolist(), hashes.view(np.int64).tolist(), strict=True):
            lo, hi = max(0, p - REACH), min(n, p + LENGTH)
            if hi - lo >= LENGTH:
                places.setdefault((h, raw[lo:hi], p - lo), []).append(p)
        again = []
        for (h, around, before), ps in places.items():
            rows.append((h, i, key, ps[0], around, None, None))
            if len(ps) > 1:
                again += [{"a": p - before, "b": p - before + len(around)} for p in ps]
        # dealt out by their own places: the anchors of such texts are few and frequent
        spread = int.from_bytes(key[:7], "little")
        rows += [(spread + a, i, key, a, None, a, b) for a, b in joined(again)]
        if len(rows) >= 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _spans(rows: list[tuple]):
    """The spans of some strings that are repeated, with what names their text."""
    width = REACH + LENGTH
    matrix = np.full((len(rows), width), 256, np.uint16)
    begin = np.array([REACH - min(r[3], REACH) for r in rows])
    end = begin + np.array([len(r[4]) for r in rows])
    for k, r in enumerate(rows):
        matrix[k, begin[k] : end[k]] = np.frombuffer(r[4], np.uint8)
    first, last = repeated_columns(matrix, begin, end)
    for k in np.flatnonzero(first >= 0):
        _, i, key, p, _ = rows[k]
        a, b = p - REACH + int(first[k]), p - REACH + int(last[k]) + LENGTH
        yield i, key, a, b


def _constructed(batches):
    """Runs the construction over the strings of a task, which come sorted by anchor, in chunks of whole anchors."""

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64(), pa.binary(), pa.int64(), pa.int64()], strict=True)], names=["doc_id", "key", "a", "b"])

    held: list[tuple] = []
    for b in batches:
        known = []
        for h, i, key, p, around, lo, hi in zip(*(b.column(c).to_pylist() for c in ("h", "doc_id", "key", "p", "around", "a", "b")), strict=True):
            if around is None:
                known.append((i, key, lo, hi))
                continue
            if len(held) >= CHUNK and held[-1][0] != h:
                known += _spans(held)
                held = []
            held.append((h, i, key, p, around))
        if known:
            yield table(known)
    if held and (rows := list(_spans(held))):
        yield table(rows)


def _windows(batches):
    """The hashes of the 200-byte strings that hold a wanted anchor."""
    step = 1 << 18  # bytes of a text whose windows go on at once
    for i, key, data, at, _ in _marked(batches):
        starts = np.zeros(len(data) - LENGTH + 2, np.int64)
        np.add.at(starts, np.maximum(at - REACH, 0), 1)
        np.add.at(starts, np.minimum(at, len(data) - LENGTH) + 1, -1)
        every = np.flatnonzero(np.cumsum(starts[:-1]) > 0)
        for s in np.split(every, np.searchsorted(every, np.arange(step, len(data), step))):
            if not len(s):
                continue
            h = rolling(_prefix(data[s[0] : s[-1] + LENGTH]), LENGTH)[s - s[0]]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(s), i)), pa.array([key] * len(s), pa.binary()), pa.array(s)], names=["w", "doc_id", "key", "s"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Spans (doc_id, key, a, b) of bytes that repeated strings cover; they may overlap. key: the hash of the text; a null
    id is LEAST_ID."""
    small_batches(docs.sparkSession)
    source = keyed(docs)
    rows = stored(source.select("doc_id", "key", F.octet_length("text").cast("long").alias("n")), "rows")
    copies = rows.groupBy("key").agg(F.count("*").alias("n_copies"), F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    copies = stored(copies.filter(F.col("n") >= LENGTH), "copies")
    whole = rows.join(copies.filter("n_copies > 1").select("key"), "key").select("doc_id", "key", F.lit(0).cast("long").alias("a"), F.col("n").alias("b")).distinct()

    found = stored(_anchored(source), "anchors")
    often = stored(found.groupBy("h").agg(F.sum("c").alias("times")).filter("times > 1"), "often")
    flagged = found.join(often, "h").groupBy("doc_id", (F.col("times") > HOT).alias("hot")).agg(F.collect_list("h").alias("wanted"))
    reps = copies.select(F.col("rep").alias("doc_id")).distinct()
    flagged = stored(flagged.join(reps, "doc_id", "left_semi"), "flagged")
    dropped(found)

    def marked(hot: bool) -> DataFrame:
        wanted = flagged.filter(F.col("hot") == hot).select("doc_id", "wanted")
        return _packed(narrowed(source, wanted, "doc_id")).join(wanted, "doc_id").select("doc_id", "key", "z", "wanted")

    around = marked(False).mapInArrow(bounded(_surroundings), "h long, doc_id long, key binary, p long, around binary, a long, b long")
    spans = stored(around.repartition("h").sortWithinPartitions("h").mapInArrow(bounded(_constructed), SPANS), "spans").union(whole)
    if not flagged.filter("hot").isEmpty():
        windows = stored(marked(True).mapInArrow(bounded(_windows), "w long, doc_id long, key binary, s long"), "windows")
        twice = stored(windows.groupBy("w").agg(F.count("*").alias("n")).filter("n > 1").select("w"), "twice")
        hot = windows.join(twice, "w").select("doc_id", "key", F.col("s").alias("a"), (F.col("s") + LENGTH).alias("b"))
        spans = spans.union(stored(hot, "hot"))
    return spans


def joined(spans) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def deduplicated(docs: DataFrame) -> DataFrame:
    """For each row its size, what is removed and a digest of what stays."""
    import zstandard

    by = repeated_spans(docs).groupBy("doc_id", "key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for i, z, spans in zip(*(b.column(c).to_pylist() for c in ("doc_id", "z", "spans")), strict=True):
                raw, cut = unpack.decompress(z), joined(spans)
                out.append((None if i == LEAST_ID else i, len(raw), sum(y - x for x, y in cut), len(cut), hashlib.sha256(kept_bytes(raw, cut)).hexdigest()))
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.string()], strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    whole = _packed(keyed(docs)).join(by, ["doc_id", "key"], "left").select("doc_id", "z", "spans")
    return whole.mapInArrow(bounded(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(read(spark, sf_dir, "documents"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated bytes removed from their texts; n_chars, where there is one, follows the text."""
    by = repeated_spans(docs).groupBy("doc_id", "key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    by = by.withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    own = "spans"
    while own in docs.columns:
        own = f"_{own}"
    whole = whole_rows(docs).join(by, ["_id", "_key"], "left").select(*(F.col("row")[c].alias(c) for c in docs.columns), F.col("spans").alias(own))
    at, names = docs.columns.index("text"), docs.columns

    def run(batches):
        for b in batches:
            new = []
            for t, spans in zip(b.column(at).to_pylist(), b.column(own).to_pylist(), strict=True):
                new.append(kept_bytes(t.encode("utf-8", "surrogatepass"), joined(spans)).decode("utf-8", "ignore") if spans and t is not None else t)
            columns = [pa.array(new, pa.string()) if k == at else b.column(k) for k in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = whole.mapInArrow(bounded(run), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
