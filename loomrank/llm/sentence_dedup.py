"""Substring deduplication by sliding sentence spans.

A sentence ends after ., ! or ? before white space, or at the end of a line. A span is a run of consecutive sentences:
from each sentence on, the run of SENTENCES whatever its words and the shortest of that many or more that has LEAST_WORDS
words (other sentences may hold the same words), and each sentence of LONG words by itself. Where a longer run of the
same sentences is repeated so are the runs of SENTENCES in it, and those cover it. Spans are hashed (64 bits of BLAKE2b over their words in lower case) and counted over all documents; of each
repeated span the first occurrence (least id, then place) stays, and sentences that any other occurrence covers go.

Counting uses partial sums. Occurrences then meet their span's first one in a join of two stored tables, which Spark
splits where a span is very frequent, so no span's occurrences are brought together.

Defined cases: a null text is empty and stays empty; a text of one short sentence has no span; a copy of another text
loses every sentence that some span covers; repeated rows of one id and text count as one, and each gets that one's
result; null ids come first; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, read, small_batches, stored
from .near_dedup import LEAST_ID, keyed
from .repeats import _packed

SENTENCES, LEAST_WORDS, LONG = 2, 16, 32
_BREAK = re.compile(r"(?<=[.!?])\s+|\n\s*")


def sentences(text: str) -> list[str]:
    """The sentences of a text with the white space after them; together they are the text."""
    out, at = [], 0
    for m in _BREAK.finditer(text):
        if m.end() > at:
            out.append(text[at : m.end()])
            at = m.end()
    return out + [text[at:]] * (at < len(text))


def spans(parts: list[str]) -> list[tuple[int, int, int]]:
    """Hash, first sentence and number of sentences of each span."""
    words = [p.lower().split() for p in parts]
    out, end, held = [], 0, 0
    for i, own in enumerate(words):
        if len(own) >= LONG:
            out.append((own, i, 1))
        if not own:
            continue
        if end <= i:
            end, held = i, 0
        while end < len(words) and (end - i < SENTENCES or held < LEAST_WORDS):
            held += len(words[end])
            end += 1
        if end - i >= SENTENCES and held >= LEAST_WORDS:
            out.append(([w for s in words[i:end] for w in s], i, end - i))
        held -= len(own)
    at = [i for i, own in enumerate(words) if own]  # white space alone is no sentence
    for first, last in zip(at, at[SENTENCES - 1 :]):
        out.append(([w for s in words[first : last + 1] for w in s], first, last - first + 1))
    out = [(w, i, n) for (i, n), w in {(i, n): w for w, i, n in out}.items()]
    return [(struct.unpack("<q", hashlib.blake2b(" ".join(w).encode("utf-8", "surrogatepass"), digest_size=8).digest())[0], i, n) for w, i, n in out]


def _hashed(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            ids, tags, h, i, n = [], [], [], [], []
            for d, tag, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "tag", "text")), strict=True):
                for x, first, size in spans(sentences(t)):
                    ids.append(d)
                    tags.append(tag)
                    h.append(x)
                    i.append(first)
                    n.append(size)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tags, pa.int32()), pa.array(h, pa.int64()), pa.array(i, pa.int32()), pa.array(n, pa.int32())], names=["doc_id", "tag", "h", "i", "n"])

    # the id and 32 bits of the text's hash name a text: ids alone may repeat
    return docs.select("doc_id", F.hash("key").alias("tag"), "text").mapInArrow(bounded(run), "doc_id long, tag int, h long, i int, n int")


def covered(docs: DataFrame) -> DataFrame:
    """For each text (doc_id, tag) the spans (i, n) of sentences that go."""
    small_batches(docs.sparkSession)
    found = stored(_hashed(keyed(docs)), "sentence-spans")
    place = F.struct("doc_id", "tag", "i")
    often = found.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    often = stored(often.filter("first <> last").select("h", "first"), "repeated-spans")
    later = found.join(often, "h").filter(place != F.col("first"))
    return later.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("i", "n")).alias("gone"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """For each row its sentences, how many went, and the text that stays."""
    import zstandard

    gone = stored(covered(docs), "gone")

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for i, z, cut in zip(*(b.column(c).to_pylist() for c in ("doc_id", "z", "gone")), strict=True):
                parts = sentences(unpack.decompress(z).decode("utf-8", "surrogatepass"))
                out = {k for s in cut or () for k in range(s["i"], s["i"] + s["n"])}
                kept = "".join(p for k, p in enumerate(parts) if k not in out)
                rows.append((None if i == LEAST_ID else i, len(parts), len(out), sum(map(len, parts)) - len(kept), kept))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.string()], strict=True)], names=["doc_id", "n_sentences", "n_removed", "n_chars_removed", "text"])

    both = _packed(keyed(docs)).withColumn("tag", F.hash("key")).join(gone, ["doc_id", "tag"], "left").select("doc_id", "z", "gone")
    return both.mapInArrow(bounded(run), "doc_id long, n_sentences long, n_removed long, n_chars_removed long, text string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(read(spark, sf_dir, "documents"))
