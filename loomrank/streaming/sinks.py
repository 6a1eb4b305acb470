"""Sinks of small stores that a stream keeps up to date: the event log, the cache of analyses, the order of a page's jobs.

A store is a folder of versions. Batch n of a stream reads the newest whole version before n, folds its rows in and writes
version n; then versions before the one that it has read go. A batch that is run again, after a failure at any point, reads
the same version and writes the same rows, so nothing counts twice. Stores are bounded by what they keep (a log's newest
events, a cache's newest entries, a page's jobs), so rewriting one takes no longer as its stream goes on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from loomrank.operators.stores import CACHE_MOST, EVENTS_MOST, cache_put


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that were written whole."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    whole = [p.getName() for p in names if p.getName().startswith("version=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in whole)


def _drop(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def store(spark: SparkSession, path: str, schema, before: int | None = None) -> DataFrame:
    """The newest whole version of a store, of those before a batch if one is given; empty where there is none."""
    known = [v for v in _versions(spark, path) if before is None or v < before]
    return spark.read.schema(schema).parquet(f"{path}/version={known[-1]}") if known else spark.createDataFrame([], schema)


def fold_batch(batch: DataFrame, n: int, path: str, fold: Callable[[DataFrame, DataFrame], DataFrame], schema) -> DataFrame:
    """Writes version n: the version before it with the batch folded in. The version that was read stays, for a second run."""
    spark = batch.sparkSession
    fold(store(spark, path, schema, before=n), batch).write.mode("overwrite").parquet(f"{path}/version={n}")
    for v in [v for v in _versions(spark, path) if v < n][:-1]:
        _drop(spark, f"{path}/version={v}")
    return store(spark, path, schema, before=n + 1)


def kept(rows: DataFrame, path: str, fold: Callable[[DataFrame, DataFrame], DataFrame]) -> DataStreamWriter:
    """Keeps a store of the stream's columns."""
    schema = rows.schema
    return rows.writeStream.outputMode("append").foreachBatch(lambda batch, n: fold_batch(batch, n, path, fold, schema) and None)


def event_log(events: DataFrame, path: str, most: int = EVENTS_MOST) -> DataStreamWriter:
    """The newest events of a stream (at, type, ...)."""
    return kept(events, path, lambda old, new: old.unionByName(new).orderBy(F.desc("at"), "type").limit(most))


def analyses(entries: DataFrame, path: str, most: int = CACHE_MOST) -> DataStreamWriter:
    """The cache of analyses: the newest entry of each URL (url, ts, version, ...), of those the newest ones."""
    return kept(entries, path, lambda old, new: cache_put(old, new, most))


ORDER = "page string, job_key string, rank int"


def order_changes(batch: DataFrame, n: int, ranked: Callable[[DataFrame], DataFrame], path: str) -> None:
    """Writes to changes/batch=n the jobs of the batch's pages whose rank is another than before, and those that are gone
    (rank null). ranked gives page, job_key, rank. Pages that the batch doesn't show stay as they are."""
    spark = batch.sparkSession
    old, new = store(spark, f"{path}/order", ORDER, before=n), ranked(batch).select("page", "job_key", F.col("rank").cast("int").alias("rank"))
    shown = old.join(new.select("page").distinct(), "page", "left_semi")
    both = shown.withColumnRenamed("rank", "was").join(new, ["page", "job_key"], "full_outer")
    both.filter(~F.col("rank").eqNullSafe(F.col("was"))).select("page", "job_key", "rank").write.mode("overwrite").parquet(f"{path}/changes/batch={n}")
    fold_batch(new, n, f"{path}/order", lambda had, now: had.join(now.select("page").distinct(), "page", "left_anti").unionByName(now), ORDER)


def order(jobs: DataFrame, ranked: Callable[[DataFrame], DataFrame], path: str) -> DataStreamWriter:
    """The ranked order of each page as a stream shows it: only ranks that change are written."""
    return jobs.writeStream.outputMode("append").foreachBatch(lambda batch, n: order_changes(batch, n, ranked, path))
