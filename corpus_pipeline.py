"""From raw documents to packed training sequences: five of the corpus operators, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Each
result is written as Parquet and read again as the next stage's docs. run() does that over the documents of sf_dir.

Null texts are empty texts, repeated rows are copies (one stays), an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomrank.llm import decontaminate, near_dedup, packing, quality, repeats
from loomrank.llm.common import read, stored

#: Not expressible in SQL: a trained classifier, sketches and a tokenizer. The tests compare with a brute-force version.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier doesn't reject."""
    return quality.kept(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dedup.one_of_each(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the bytes that repeated strings cover."""
    return repeats.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no large part of a benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, laid out in sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicates", drop_near_copies),
    ("repeated strings", drop_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
