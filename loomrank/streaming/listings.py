"""Structured Streaming over listed jobs, applications and events. Event times and watermarks are Spark's own."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupStateTimeout

from loomrank.operators.tracker import job_key, posting_url


def debounced(events: DataFrame, key: str, time: str = "ts", quiet: str = "320 milliseconds", late: str = "1 minute") -> DataFrame:
    """One row for each burst of events of a key: those with less than the quiet time between them."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, quiet).alias("burst"), key).agg(F.count("*").alias("n_events")).select(key, F.col("burst.start").alias("began"), F.col("burst.end").alias("ended"), "n_events")


def changes(rows: DataFrame, key: str, value: str, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The rows at which a key's value is another one than before: of a, a, b, a the first, third and fourth. The last
    value of each key is kept as state; within a batch rows count in the order of time. A null is no value: of a, null, a
    only the first row stays."""
    rows = rows.filter(F.col(value).isNotNull())
    if not rows.isStreaming:
        before = F.lag(value).over(W.partitionBy(key).orderBy(time))
        return rows.withColumn("_new", ~F.col(value).eqNullSafe(before)).filter("_new").drop("_new")

    def run(_, batches, state):
        last = state.get if state.exists else (None,)
        rows_ = pd.concat(list(batches)).sort_values(time, kind="stable")
        now = rows_[value].astype(object)
        before = pd.Series([last[0], *now.iloc[:-1]], index=now.index, dtype=object)
        if len(now):
            state.update((now.iloc[-1],))
        yield rows_[(now != before).to_numpy()]

    kind = rows.schema[value].dataType.simpleString()
    return rows.withWatermark(time, late).groupBy(key).applyInPandasWithState(run, rows.schema, f"last {kind}", "append", GroupStateTimeout.NoTimeout)


def limited(attempts: DataFrame, key: str, time: str = "ts", every: str = "1300 milliseconds", late: str = "1 minute") -> DataFrame:
    """The attempts (key, time) of a key that don't come within `every` of the last one let through."""
    apart = pd.Timedelta(every)
    rows = attempts.select(key, time)

    def passed(times: list, last):
        for t in times:
            ok = last is None or t - last >= apart
            last = t if ok else last
            yield ok, last

    if not attempts.isStreaming:

        def walk(batches):  # sorted by key and time, so one time is all that is held
            had, last = None, None
            for b in batches:
                keep = []
                for k, t in zip(b[key], b[time], strict=True):
                    ok, last = next(passed([t], last if had is not None and k == had[0] else None))
                    had = (k,)
                    keep.append(ok)
                yield b[keep]

        return rows.repartition(key).sortWithinPartitions(key, time).mapInPandas(walk, rows.schema)

    def run(_, batches, state):
        held = pd.concat(list(batches)).sort_values(time, kind="stable")
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        got = list(passed(list(held[time]), last))
        if got:
            state.update((got[-1][1].value // 1000,))
        yield held[[ok for ok, _ in got]]

    return rows.withWatermark(time, late).groupBy(key).applyInPandasWithState(run, rows.schema, "last long", "append", GroupStateTimeout.NoTimeout)


def signatures(jobs: DataFrame, page: str, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """A page's listing as one value for each time it was seen: it changes where any job does."""
    row = F.xxhash64(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("url", "job_key", "title", "company", "location"))))
    return jobs.withWatermark(time, late).groupBy(page, time).agg(F.sum(row.cast("decimal(38,0)")).cast("string").alias("signature"))


def recomputed(jobs: DataFrame, ranked: Callable[[DataFrame], DataFrame], path: str, seconds: float = 0.45) -> DataStreamWriter:
    """Ranks each micro-batch of jobs anew and replaces the result at path. Batches write to folders of their own, so a
    batch that is run again after a failure gives the same result."""

    def write(batch: DataFrame, n: int) -> None:
        ranked(batch).withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return jobs.writeStream.outputMode("append").trigger(processingTime=f"{seconds} seconds").foreachBatch(write)


def submissions(pages: DataFrame, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Applications that confirmation pages report, one for each job within the watermark."""
    from loomrank.operators.eligibility import submitted

    seen = pages.filter(submitted("text")).select(job_key(F.lit(""), "url", "url").alias("job_key"), posting_url("url").alias("posting_url"), F.lit("applied").alias("status"), F.col(time))
    return seen.withWatermark(time, late).dropDuplicatesWithinWatermark(["job_key"])


def activity(events: DataFrame, by: str = "event_type", time: str = "ts", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events in windows of time."""
    return events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("began"), by, "n", "total")
