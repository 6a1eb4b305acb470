"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, one pass over each text.

Words are runs of ASCII digits and letters (A-Z lower-cased) and of any character beyond ASCII. A window is 13
consecutive words of an item; an item of fewer words is one window. Windows, each between two spaces, are the
automaton's keys, so one scan of a document's words joined by single spaces finds every occurrence; its offset leads
back to word numbers and to character offsets of the original text.

Defined cases: null or wordless texts have no words, no hits and are clean; null or wordless items are never found;
items that share a window are all found by it; repeated item ids count once; repeated documents each give their row;
columns beside doc_id, text, item_id are ignored. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, read, small_batches, texts

WINDOW = 13
#: Bytes of benchmark text that one automaton may hold; a larger benchmark is scanned for in several rounds.
AUTOMATON_BYTES = 16 << 20

#: Each byte of a word as itself (A-Z in lower case), any other byte as a space.
WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in (ord(chr(i).lower()) if i < 128 else i for i in range(256)))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def windows_of(words: list[bytes], window: int = WINDOW) -> set[bytes]:
    return {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))} if words else set()


def _slices(benchmark: DataFrame, window: int, limit: int) -> Iterator[dict[str, tuple[str, ...]]]:
    """Windows and the items that have them; as many items at a time as the limit allows."""
    found: dict[str, set[str]] = {}
    held = 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        for w in windows_of(words_of(text), window):
            # an item without id hits words all the same
            found.setdefault(f" {w.decode('latin-1')} ", set()).update([item] if item is not None else [])
            held += len(w)
        if held > limit:
            yield {k: tuple(sorted(v)) for k, v in found.items()}
            found, held = {}, 0
    if found:
        yield {k: tuple(sorted(v)) for k, v in found.items()}


def scan(text: str, automaton) -> tuple[int, np.ndarray, set[str]]:
    """The number of words, the [first, last] words of each occurrence, and the items found."""
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    ends, lengths, items = [], [], set()
    for end, (n, names) in automaton.iter(joined.decode("latin-1")):
        ends.append(end)
        lengths.append(n)
        items.update(names)
    if not ends:
        return len(words), np.zeros((0, 2), np.int64), items
    last = np.searchsorted(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), ends) - 1
    return len(words), np.stack([last - np.array(lengths) + 1, last], 1), items


def merged(spans: list) -> list[tuple[int, int]]:
    """Overlapping and touching spans of words as one, in order."""
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def offsets(text: str, spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Spans of words as character offsets of the original text."""
    raw = text.encode("utf-8", "surrogatepass")
    word = np.frombuffer(b" " + raw.translate(WORD_BYTES) + b" ", np.uint8) != 32
    start, end = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [{"start": int(chars[start[a]]), "end": int(chars[end[b]])} for a, b in spans]


SCHEMA = "doc_id long, text string, n_words long, spans array<struct<start:long,end:long>>, words array<struct<first:long,last:long>>, items array<string>"


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = AUTOMATON_BYTES, carry: str | None = None) -> DataFrame:
    """For each document its number of words, the merged spans that occurrences cover (character offsets and word
    numbers) and the items found. A benchmark of more than `limit` bytes takes several automata of bounded size, which
    scan each row one after the other and add to what it has; no row is shuffled. carry: a column that stays."""
    spark = docs.sparkSession
    small_batches(spark)
    more = [carry] * bool(carry)
    schema = SCHEMA + "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in more)

    def scanned(rows: DataFrame, found: dict[str, tuple[str, ...]]) -> DataFrame:
        held = spark.sparkContext.broadcast(found)

        def run(batches):
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for key, items in held.value.items():
                automaton.add_word(key, (key.count(" ") - 1, items))
            if held.value:
                automaton.make_automaton()
            pair = lambda a, c: pa.list_(pa.struct([(a, pa.int64()), (c, pa.int64())]))
            for b in batches:
                counts, spans, words, items = [], [], [], []
                for t, had, names in zip(*(b.column(c).to_pylist() for c in ("text", "words", "items")), strict=True):
                    n, at, hit = scan(t, automaton) if held.value else (len(words_of(t)), np.zeros((0, 2), np.int64), set())
                    at = merged([(x["first"], x["last"]) for x in had] + at.tolist())
                    counts.append(n)
                    spans.append(offsets(t, at) if at else [])
                    words.append([{"first": x, "last": y} for x, y in at])
                    items.append(sorted(hit.union(names)))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("text"), pa.array(counts, pa.int64()), pa.array(spans, pair("start", "end")), pa.array(words, pair("first", "last")), pa.array(items, pa.list_(pa.string())), *(b.column(c) for c in more)],
                    names=["doc_id", "text", "n_words", "spans", "words", "items", *more],
                )

        return rows.select("doc_id", "text", "words", "items", *more).mapInArrow(bounded(run), schema)

    out = texts(docs, *more).withColumns({"words": F.expr("cast(array() as array<struct<first:long,last:long>>)"), "items": F.expr("cast(array() as array<string>)")})
    n = 0
    for n, found in enumerate(_slices(benchmark, window, limit), 1):  # noqa: B007
        out = scanned(out, found)
    if not n:
        out = scanned(out, {})
    return out.drop("text")


def n_hit():
    return F.aggregate("words", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)


def contaminated():
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(occurrences(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), docs["doc_id"], docs["text"])
    found = occurrences(whole, benchmark, carry="row")
    return found.filter(~contaminated()).select(*(F.col("row")[c].alias(c) for c in docs.columns))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, p, p + least(13, len(w)) - 1), ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN iw ON dw.s = iw.s AND dw.n = iw.n),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(xs, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
