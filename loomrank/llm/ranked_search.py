"""Ranked lexical search: documents in shards, each an inverted index in compressed rows with integer impacts.

A term is a run of ASCII letters (A-Z lower-cased), digits and characters beyond ASCII. The index is a table of shards, each
of about SHARD_BYTES of text: its sorted document ids, its terms, where each term's postings begin, and for each posting the
document's place and the impact (1000000000*tf) div (1000*tf + 8*m), which needs only the corpus' N and L, counted before.
No posting is shuffled. A term's weight depends on the query's terms alone: a pass over the shards' term lists sums how many
documents hold each, so the index takes new shards without being written anew where N and L are kept.

Queries go in blocks of BLOCK bytes of text. In a shard each query adds, one term after the other, weight times impact to a
dense accumulator; its best k are picked by partition, with all ties at the border ordered by document id. Each task
merges its shards, and two windows merge the tasks.

Defined cases: null texts have no terms; documents without a term are never found; each row of the queries is a query of
its own, also where its id repeats or is null; one without known terms has no rows; repeated documents each take a rank;
a document without id is found, and stands behind others of its score; other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded, bytes_of, read, small_batches, stored, texts
from .terms import ALNUM, counted, gathered, split

#: Bytes of text of a shard, and of the queries that are looked up together.
SHARD_BYTES, BLOCK = 8 << 20, 4 << 20
K = 10
#: Parts of a query's candidates that are ranked apart before the last ranking.
PARTS = 64
#: Stands for a document without id: sorts behind all others.
NO_ID = np.iinfo(np.int64).max

SHARDS = "n_docs long, n_postings long, ids binary, term_bytes binary, term_ends binary, first binary, docs binary, impacts binary"


@dataclass
class Index:
    shards: DataFrame
    n: int
    total: int


def lengths_factor(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """100 - 75 + ((75*n*N) div L) for each document."""
    if not total or 75 * int(n.max(initial=0)) * docs < 1 << 63:
        return 25 + (75 * n.astype(np.int64) * docs) // max(total, 1)
    return 25 + np.array([75 * int(x) * docs // total for x in n], np.int64)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def corpus(docs: DataFrame) -> tuple[int, int]:
    """How many documents have a term, and how many terms all have."""

    def run(batches):
        n = total = 0
        for b in batches:
            data, at = bytes_of(b.column("text"))
            each = np.bincount(split(data, at[:-1], ALNUM)[0], minlength=1)
            n += int((each > 0).sum())
            total += int(each.sum())
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]})

    got = texts(docs).select("text").mapInArrow(bounded(run), "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return got[0] or 0, got[1] or 0


def build(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> Index:
    """The index of all documents, stored in the shared folder."""
    small_batches(docs.sparkSession)
    n_docs, total = corpus(docs)

    def run(batches):
        for b in gathered(batches, "text", shard_bytes):
            data, at = bytes_of(b.column("text"))
            ids = b.column("doc_id").fill_null(int(NO_ID)).to_numpy()
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            rows, terms, tf = counted(data, at, ALNUM)
            m = lengths_factor(np.bincount(rows, tf, len(ids)).astype(np.int64), n_docs, total)
            codes = terms.dictionary_encode()
            code, where = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64), place[rows]
            by = np.lexsort((where, code))
            impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[rows])
            names = codes.dictionary
            raw, ends = (bytes_of(names.cast(pa.large_string()))) if len(names) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
            first = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(names)))])
            parts = [ids[order].astype(np.int64), raw, ends, first.astype(np.int64), where[by].astype(np.int32), impact[by].astype(np.int32)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(ids)], pa.int64()), pa.array([len(by)], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)],
                names=["n_docs", "n_postings", "ids", "term_bytes", "term_ends", "first", "docs", "impacts"],
            )

    # a row is a whole shard: small row groups keep a reader from holding many
    shards = stored(texts(docs).mapInArrow(bounded(run), SHARDS), "search-index", **{"parquet.block.size": 2 * shard_bytes})
    return Index(shards, n_docs, total)


def _terms(shard: dict) -> pa.Array:
    ends = np.frombuffer(shard["term_ends"], np.int64)
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(shard["term_ends"]), pa.py_buffer(shard["term_bytes"]))


def _shards(batches) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {c: b.column(c)[i].as_py() for c in b.schema.names}


def _found(shard: dict, wanted: pa.Array) -> np.ndarray:
    """For each wanted term its number in the shard, or -1."""
    return pc.fill_null(pc.index_in(wanted, value_set=_terms(shard)), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def frequencies(index: Index, wanted: list[str]) -> np.ndarray:
    """In how many documents each of the wanted terms stands."""

    def run(batches):
        terms, total = pa.array(wanted, pa.large_string()), np.zeros(len(wanted), np.int64)
        for s in _shards(batches):
            k, first = _found(s, terms), np.frombuffer(s["first"], np.int64)
            total += np.where(k >= 0, first[k + 1] - first[k], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["k", "df"])

    out = np.zeros(len(wanted), np.int64)
    rows = index.shards.select("term_bytes", "term_ends", "first").mapInArrow(bounded(run), "k long, df long")
    for k, df in rows.groupBy("k").agg(F.sum("df")).collect():  # as many rows as the block has terms
        out[k] = df
    return out


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest positive scores, all ties at the border by place; in no order."""
    some = np.flatnonzero(scores)
    if len(some) <= k:
        return some
    got = scores[some]
    border = got[np.argpartition(got, len(got) - k)[len(got) - k]]
    over = some[got > border]
    return np.concatenate([over, some[got == border][: k - len(over)]])


def _blocks(queries: DataFrame, key: str, limit: int) -> Iterator[list[tuple[object, Counter]]]:
    block, held = [], 0
    for item, text in queries.select(queries[key], queries["text"].cast("string").alias("text")).toLocalIterator():
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        block.append((item, Counter(split(raw, np.zeros(1, np.int64), ALNUM)[1].to_pylist())))
        held += len(raw) + 100
        if held > limit:
            yield block
            block, held = [], 0
    if block:
        yield block


def _ranked(index: Index, block: list[tuple[object, Counter]], k: int) -> DataFrame:
    """The best documents of each query of a block within each task: query number, doc_id, score."""
    wanted = sorted({t for _, terms in block for t in terms})
    weights = [weight(index.n, int(df)) if df else 0 for df in frequencies(index, wanted)]
    number = {t: i for i, t in enumerate(wanted)}
    asked = [[(number[t], c * weights[number[t]]) for t, c in terms.items() if weights[number[t]]] for _, terms in block]
    held = index.shards.sparkSession.sparkContext.broadcast((wanted, asked))

    def run(batches):
        names, queries = held.value
        terms = pa.array(names, pa.large_string())
        top: list[list[tuple[int, int]]] = [[] for _ in queries]
        for s in _shards(batches):
            number, first, ids = _found(s, terms), np.frombuffer(s["first"], np.int64), np.frombuffer(s["ids"], np.int64)
            docs, impacts = np.frombuffer(s["docs"], np.int32), np.frombuffer(s["impacts"], np.int32).astype(np.int64)
            scores = np.zeros(len(ids), np.int64)
            for q, wants in enumerate(queries):
                known = [(number[t], w) for t, w in wants if number[t] >= 0]
                if not known:
                    continue
                scores[:] = 0
                for t, w in known:
                    a, z = first[t], first[t + 1]
                    scores[docs[a:z]] += w * impacts[a:z]
                got = best(scores, k)
                top[q] = heapq.nsmallest(k, top[q] + list(zip((-scores[got]).tolist(), ids[got].tolist(), strict=True)))
        rows = [(q, i, -s) for q, found in enumerate(top) for s, i in found]
        q, i, s = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array([None if x == NO_ID else x for x in i], pa.int64()), pa.array(s, pa.int64())], names=["q", "doc_id", "score"])

    columns = ["ids", "term_bytes", "term_ends", "first", "docs", "impacts"]
    return index.shards.select(*columns).mapInArrow(bounded(run), "q long, doc_id long, score long")


def search(index: Index, queries: DataFrame, k: int = K, key: str = "item_id", block_bytes: int = BLOCK) -> DataFrame:
    """For each query its k best documents: the key, rank, doc_id, score."""
    spark = queries.sparkSession
    kind = queries.schema[key].dataType
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    out = None
    for block in _blocks(queries, key, block_bytes):
        found = _ranked(index, block, k)
        # the best of each part first: no task gets what all tasks found for a query
        found = found.withColumn("r", F.row_number().over(W.partitionBy("q", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).orderBy(*order))).filter(F.col("r") <= k)
        found = found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(*order))).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(block)], f"q long, {key} {kind.simpleString()}")
        found = found.join(F.broadcast(names), "q").select(key, "rank", "doc_id", "score")  # a block's keys: bounded
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"{key} {kind.simpleString()}, rank int, doc_id long, score long")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("coalesce(text, '')")} AS w FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, {_TERMS.format("coalesce(text, '')")} AS w FROM benchmark),
c AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
asked AS (SELECT q, t, count(*) AS times FROM (SELECT q, unnest(w) AS t FROM i) GROUP BY ALL),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
wt AS (SELECT t, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, c GROUP BY t, n),
m AS (SELECT r, doc_id, 25 + ((75 * len(w)::BIGINT * n) // l) AS m FROM d, c WHERE len(w) > 0),
s AS (SELECT q, doc_id, r, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM asked JOIN p USING (t) JOIN wt USING (t) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k JOIN i USING (q) WHERE rank <= {K}
"""
