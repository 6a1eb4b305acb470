"""Source divergence audit: how far the words of each source of a language are from those of the other sources.

A term is a run of ASCII letters (A-Z lower-cased) and characters beyond ASCII; a language keeps those that at least
MIN_DOCS of its documents have. Each source, and the language as a whole, gives each kept term a smoothed share in parts of
a billion, p = 1 + (1000000000*(count+2)) div (N+2*V); two shares p, q differ by ((p-q)*(p-q)) div (p+q).

DuckDB counts terms of a few MB of texts at a time, before any shuffle; Spark sums those counts by language, source and
term. Then shards, by a hash of language and term, hold all of a term's sources: there DuckDB keeps the terms of enough
documents and, when Spark has summed N and V, adds up the differences of each pair of sources and picks each source's best
terms; Spark merges sums and ranks. A shard's sums are sparse: a term that only one of two sources has differs by what
hangs on its count alone, and one that neither has by a constant, so those come from a histogram of counts (Spark) and only
terms of both sources meet. All arithmetic is in integers of 64 bits, or 128 where a product needs them.

Defined cases: null text, language and source are empty strings; a language without a kept term gives its pairs the
value 0; a source without a kept term still has shares and pairs; repeated rows are documents of their own; ids and other
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import blocks, bounded, bytes_of, read, runs, small_batches, stored
from .terms import LETTERS, STEP, gathered, split

MIN_DOCS, TOP = 10, 10
#: Bytes of text that are counted at a time, and rows of a shard.
GATHER, SHARD_ROWS = 16 << 20, 500_000
#: Memory of a worker's database, which holds one shard and never spills to a local disk.
CONFIG = {"threads": 1, "memory_limit": "800MB", "temp_directory": ""}

_GROUP_TERMS = "SELECT row, term, sum(n)::BIGINT AS n FROM parts GROUP BY ALL"


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def counts(docs: DataFrame) -> DataFrame:
    """For each language, source and term its occurrences and its documents."""
    small_batches(docs.sparkSession)

    def run(batches):
        import duckdb

        con = duckdb.connect(config=CONFIG)
        for groups in gathered(batches, "text", GATHER):
            data, at = bytes_of(groups.column("text"))
            con.execute("CREATE OR REPLACE TABLE parts (row BIGINT, term VARCHAR, n BIGINT)")
            for a, b in _ranges(data, at):
                rows, terms = split(data[a:b], at.clip(a, b)[:-1] - a, LETTERS)
                words = pa.table({"row": rows, "term": terms})  # noqa: F841
                con.execute("INSERT INTO parts SELECT row, term, count(*) FROM words GROUP BY ALL")
            group = pa.table({"row": range(groups.num_rows), "lang": groups.column("lang"), "source": groups.column("source")})  # noqa: F841
            yield from con.sql(f"SELECT lang, source, term, sum(n)::BIGINT AS c, count(*) AS docs FROM ({_GROUP_TERMS}) JOIN \"group\" USING (row) GROUP BY ALL").to_arrow_table().to_batches(1 << 16)
        con.close()

    found = _texts(docs).mapInArrow(bounded(run), "lang string, source string, term string, c long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs"))


def _ranges(data, at):
    """Ranges of whole rows of about STEP bytes; a longer row goes by parts that end between terms."""
    for a, b in runs(at, STEP):
        if at[b] - at[a] > STEP:
            yield from ((at[a] + x, at[a] + y) for x, y in blocks(data[at[a] : at[b]], LETTERS == 0, STEP))
        else:
            yield at[a], at[b]


def _by_shard(rows: DataFrame, sql: str, schema: str, shards: int) -> DataFrame:
    """Runs SQL over each shard, which has all rows of its languages' terms, as the table `rows`."""

    def run(batches):
        import duckdb

        held = [b for b in batches if b.num_rows]
        if held:
            con = duckdb.connect(config=CONFIG)
            con.register("rows_in", pa.Table.from_batches(held))
            con.execute("CREATE TABLE rows AS SELECT * FROM rows_in")
            con.unregister("rows_in")
            held.clear()
            yield from con.sql(sql).to_arrow_table().to_batches(1 << 16)
            con.close()

    return rows.repartition(shards, "lang", "term").mapInArrow(bounded(run), schema)


def kept_terms(found: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The counts of terms that enough of a language's documents have; `first` is true once for each term of a language."""
    sql = f"""SELECT lang, source, term, c, row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AS first
    FROM (SELECT *, sum(docs) OVER (PARTITION BY lang, term) AS df FROM rows) WHERE df >= {min_docs}"""
    return _by_shard(found, sql, "lang string, source string, term string, c long, first boolean", _shards(found))


def _shards(rows: DataFrame) -> int:
    spark = rows.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // SHARD_ROWS + 1)


def totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """For each language and source: its kept occurrences n and terms `some`, the language's kept terms v and occurrences n_lang."""
    sums = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"), F.count("*").alias("some"), F.count_if("first").alias("first"))
    lang = sums.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.sum("first").alias("v"))
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("n", "some", "v", "n_lang")}
    groups = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    return groups.join(sums.drop("first"), ["lang", "source"], "left").join(lang, "lang", "left").withColumns(zero)


#: The share of a count in a group of n kept occurrences where the language keeps v terms, and the difference of two shares.
SHARE = "(1 + cast((cast(1000000000 as decimal(20, 0)) * ({c} + 2)) div nullif({n} + 2 * {v}, 0) as bigint))"
DIFFERENCE = "((({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q})))"

_P = "(1 + (1000000000::HUGEINT * ({c} + 2)) // ({n} + 2 * v))::BIGINT"
_F = "((({p}) - ({q})) * (({p}) - ({q})) // (({p}) + ({q})))"


def _shard_sql() -> str:
    f = lambda p, q: _F.format(p=p, q=q)
    return f"""
    WITH t AS (SELECT *, dense_rank() OVER (ORDER BY lang, term) AS k, sum(c) OVER (PARTITION BY lang, term) AS c_lang FROM rows),
    s AS (SELECT *, {_P.format(c="c", n="n")} AS p, {_P.format(c="0", n="n")} AS p0, {_P.format(c="c_lang", n="n_lang")} AS q FROM t),
    best AS (SELECT lang, source, term, {f("p", "q")} AS value FROM s WHERE c > 0 AND p > q
             QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {TOP})
    SELECT 'term' AS part, lang, source, term AS item, value FROM best
    UNION ALL
    SELECT 'pair', a.lang, a.source, b.source, sum({f("a.p", "b.p")} - {f("a.p", "b.p0")} - {f("a.p0", "b.p")} + {f("a.p0", "b.p0")})::BIGINT
    FROM s a JOIN s b USING (k) WHERE a.source < b.source GROUP BY a.lang, a.source, b.source"""


def pair_values(groups: DataFrame, kept: DataFrame, both: DataFrame) -> DataFrame:
    """The summed differences of any two sources of a language: lang, source, item, value; each pair both ways.
    both: what a term that both have adds to what it would as a term of one of them and of the other."""
    sides = lambda x: groups.select("lang", "v", *(F.col(c).alias(f"{c}_{x}") for c in ("source", "n", "some")))
    share = lambda c, x: SHARE.format(c=c, n=f"n_{x}", v="v")
    f = lambda p, q: F.expr(DIFFERENCE.format(p=p, q=q))
    # what the terms of a add against sources that lack them: by their counts alone
    hist = kept.groupBy("lang", F.col("source").alias("source_a"), "c").agg(F.count("*").alias("times"))
    own = hist.join(sides("a"), ["lang", "source_a"]).withColumn("p", F.expr(share("c", "a"))).select("lang", "source_a", "times", "p")
    other = sides("b").withColumn("p0", F.expr(share("0", "b"))).select("lang", "source_b", "p0")
    lone = own.join(other, "lang").filter("source_a <> source_b").groupBy("lang", "source_a", "source_b").agg(F.sum(F.col("times") * f("p", "p0")).alias("lone"))
    # as a pair of the lesser name and the greater
    less = lone.select("lang", F.least("source_a", "source_b").alias("source_a"), F.greatest("source_a", "source_b").alias("source_b"), F.col("lone").alias("x"))
    parts = less.unionByName(both.select("lang", F.col("source").alias("source_a"), F.col("item").alias("source_b"), F.col("value").alias("x")))
    sums = parts.groupBy("lang", "source_a", "source_b").agg(F.sum("x").alias("x"))
    pairs = sides("a").join(sides("b").drop("v"), "lang").filter("source_a < source_b")
    pairs = pairs.join(sums, ["lang", "source_a", "source_b"], "left")
    neither = F.coalesce((F.col("v") - F.col("some_a") - F.col("some_b")) * f(share("0", "a"), share("0", "b")), F.lit(0))
    pairs = pairs.withColumn("value", (neither + F.coalesce("x", F.lit(0))).cast("long"))
    one = pairs.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), "value")
    return one.unionByName(pairs.select("lang", F.col("source_b").alias("source"), F.col("source_a").alias("item"), "value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    found = stored(counts(docs), "term-counts")
    kept = stored(kept_terms(found, min_docs), "kept-terms")
    groups = stored(totals(docs, kept), "source-totals")
    rows = kept.drop("first").join(groups.drop("some"), ["lang", "source"])
    sums = stored(_by_shard(rows, _shard_sql(), "part string, lang string, source string, item string, value long", _shards(kept)), "shard-sums")
    order = [F.desc("value"), F.asc("item")]
    ranked = lambda x: x.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(*order)))
    pairs = ranked(pair_values(groups, kept, sums.filter("part = 'pair'"))).withColumn("part", F.lit("pair"))
    terms = ranked(sums.filter("part = 'term'")).filter(F.col("rank") <= TOP)
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c_lang FROM o GROUP BY ALL HAVING count(DISTINCT r) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(c_lang) AS n_lang FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM o JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
s AS (SELECT lang, source, term, coalesce(c, 0) AS c, (1 + (1000000000::HUGEINT * (coalesce(c, 0) + 2)) // (n + 2 * v))::BIGINT AS p,
      (1 + (1000000000::HUGEINT * (c_lang + 2)) // (n_lang + 2 * v))::BIGINT AS q
      FROM n JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
         FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM s WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM x QUALIFY part = 'pair' OR rank <= {TOP}
"""
