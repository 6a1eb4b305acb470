"""Document fingerprints by a homomorphic multiset hash of paragraphs.

A paragraph is a line. Each one hashes to a wide vector: LANES numbers of 32 bits from SHAKE-128 of its bytes, and
SKETCH numbers of 32 bits in which each of its three-word shingles adds 1 or -1 at a place its hash names. A document's
state is the sum of its paragraphs' vectors, modulo 2**32, so the order of paragraphs doesn't matter, and a paragraph is
inserted or deleted by adding or subtracting its vector. The printed fingerprint is the first part itself in hexadecimal
(2,048 bits), so `updated` inserts and deletes in a printed one. Equality rests on it; the second part, a sum over the same
paragraphs that isn't printed, estimates likeness, twice the shared shingles over all of both, as lanes alone tell only
equal from unequal.

To pair each document with the next in descending order of ids, documents are dealt out by ranges of ids whose bounds
are ids of the table (PER_RANGE rows each, at most RANGES). A range's largest id is its bound, so that document is also
sent to the range above it, where the smallest id needs it: one shuffle of the (compressed) texts and no global order.

Defined cases: a null text is empty (one empty paragraph); two empty texts are alike (1.0); the last document's next is
the first, so a single document follows itself; rows of equal ids follow each other in an order that
depends on their texts alone; null ids come last, in one range; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, bounded, read, small_batches, span_hashes, texts

LANES, SKETCH, SHINGLE = 64, 1024, 3
#: Rows of a range, and ranges at most: beyond that they hold more rows, which are sorted and read as a stream.
PER_RANGE, RANGES = 1000, 100_000
LEAST_ID = -(1 << 63)


@dataclass
class State:
    """The sum of a multiset of paragraphs."""

    lanes: np.ndarray
    sketch: np.ndarray

    @classmethod
    def empty(cls) -> State:
        return cls(np.zeros(LANES, np.uint32), np.zeros(SKETCH, np.uint32))

    @classmethod
    def of(cls, raw: bytes) -> State:
        """The state of a text's lines, in any order."""
        lines = raw.split(b"\n")
        lanes = np.zeros(LANES, np.uint32)
        for k in range(0, len(lines), 256):
            digests = b"".join([hashlib.shake_128(x).digest(4 * LANES) for x in lines[k : k + 256]])
            lanes += np.frombuffer(digests, "<u4").reshape(-1, LANES).sum(0, dtype=np.uint32)
        return cls(lanes, sketch(raw))

    def __add__(self, other: State) -> State:
        return State(self.lanes + other.lanes, self.sketch + other.sketch)

    def __sub__(self, other: State) -> State:
        return State(self.lanes - other.lanes, self.sketch - other.sketch)

    def printed(self) -> str:
        return self.lanes.astype("<u4").tobytes().hex()

    def likeness(self, other: State) -> float:
        """Twice the shared shingles over those of both, as the sketches tell; 1 for equal states."""
        if np.array_equal(self.lanes, other.lanes) and np.array_equal(self.sketch, other.sketch):
            return 1.0
        a, b = (s.sketch.view(np.int32).astype(np.float64) for s in (self, other))
        both = a @ a + b @ b
        return float(min(1.0, max(0.0, 2 * (a @ b) / both))) if both else 0.0


def updated(fingerprint: str, inserted: tuple[bytes, ...] = (), deleted: tuple[bytes, ...] = ()) -> str:
    """A printed fingerprint after paragraphs came and went."""
    lanes = np.frombuffer(bytes.fromhex(fingerprint), "<u4").astype(np.uint32)
    for x in inserted:
        lanes = lanes + State.of(x).lanes
    for x in deleted:
        lanes = lanes - State.of(x).lanes
    return lanes.astype("<u4").tobytes().hex()


def sketch(raw: bytes) -> np.ndarray:
    """Counts of signed shingles: three words of a line, or all of a shorter line's. A long text is read in blocks of lines."""
    data, ends = np.frombuffer(raw, np.uint8), np.arange(256) == 10
    parts = [_sketch(data[a:b]) for a, b in blocks(data, ends)]
    return np.sum(parts, axis=0, dtype=np.uint32) if parts else np.zeros(SKETCH, np.uint32)


def _sketch(data: np.ndarray) -> np.ndarray:
    word = np.concatenate([[False], data > 32, [False]])
    start, end = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
    if not len(start):
        return np.zeros(SKETCH, np.uint32)
    line = np.searchsorted(np.flatnonzero(data == 10), start)
    last = np.minimum(np.arange(len(start)) + SHINGLE - 1, np.searchsorted(line, line, "right") - 1)
    first_of_line = np.concatenate([[True], line[1:] != line[:-1]])
    keep = (last - np.arange(len(start)) == SHINGLE - 1) | first_of_line
    h = span_hashes(data, start[keep], end[last[keep]])
    return np.bincount((h % np.uint64(SKETCH)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0), SKETCH).astype(np.int64).astype(np.uint32)


def edited(text: str, follower: str) -> tuple[str, int]:
    """The text with its last third replaced by as much of the next one's start, and where the change begins."""
    n = len(text) // 3
    return text[: len(text) - n] + follower[:n], len(text) - n


def changed(state: State, text: str, new: str, at: int) -> State:
    """The state of the new text, from that of the old: paragraphs from the change on go, the new ones come."""
    line = text.rfind("\n", 0, at) + 1
    old_tail, new_tail = (x[line:].encode("utf-8", "surrogatepass") for x in (text, new))
    return state if old_tail == new_tail else state - State.of(old_tail) + State.of(new_tail)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """For each document the fingerprints of its text and its edited text, and the likenesses."""
    import zstandard

    spark = docs.sparkSession
    small_batches(spark)
    source = texts(docs)
    key = F.coalesce("doc_id", F.lit(LEAST_ID))
    n = source.select("doc_id").count()
    ranges = max(1, min(RANGES, n // PER_RANGE))
    shares = [k / ranges for k in range(1, ranges)] + [1.0]
    bounds = source.select(F.percentile_approx(key, shares, 10 * ranges + 10_000)).first()[0] if n else [0]
    bounds = np.unique(np.array(bounds, np.int64))

    def dealt(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            ids = b.column("doc_id").fill_null(LEAST_ID).to_numpy()
            at = np.minimum(np.searchsorted(bounds, ids), len(bounds) - 1)
            z = [pack.compress(t.encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()]
            head = np.flatnonzero(ids == bounds[at])
            part = np.concatenate([at, (at[head] + 1) % len(bounds)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part.astype(np.int32)),
                    pa.array(np.concatenate([np.zeros(len(at), bool), np.ones(len(head), bool)])),
                    pa.array(np.concatenate([ids, ids[head]])),
                    pa.array(z + [z[k] for k in head], pa.binary()),
                ],
                names=["part", "after", "id", "z"],
            )

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        had = None  # the row before: range, id, text, state
        for b in batches:
            rows = []
            for part, after, i, z in zip(*(b.column(c).to_pylist() for c in ("part", "after", "id", "z")), strict=True):
                if after and (had is None or had[0] != part):
                    continue  # another row of the same id has served
                raw = unpack.decompress(z)
                text, state = raw.decode("utf-8", "surrogatepass"), State.of(raw)
                if had and had[0] == part:
                    _, own, old, s = had
                    new, cut = edited(old, text)
                    e = changed(s, old, new, cut)
                    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((None if own == LEAST_ID else own, len(old), sha, s.printed(), e.printed(), s.likeness(e), s.likeness(state)))
                had = None if after else (part, i, text, state)
            columns = zip(*rows, strict=True) if rows else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split(" ")[0] for x in SCHEMA.split(", ")])

    out = source.mapInArrow(bounded(dealt), "part int, after boolean, id long, z binary").repartition("part")
    return out.sortWithinPartitions("part", "after", F.desc("id"), "z").mapInArrow(bounded(run), SCHEMA)


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))
