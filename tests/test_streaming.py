"""Sinks that bear a second run of a batch, and readings of postings that a timer ends."""

import datetime as dt

from pyspark.sql import functions as F

from loomrank.streaming import sinks
from loomrank.streaming.refresh import refreshed

T0 = dt.datetime(2024, 1, 1)
BODY = "Job summary: required skills are many. " * 8


def at(ms):
    return T0 + dt.timedelta(milliseconds=ms)


def test_log_bears_failures(spark, tmp_path):
    """A batch that failed after any of its steps and runs again counts once."""
    path, schema = str(tmp_path / "log"), "at long, type string"
    fold = lambda old, new: old.unionByName(new).orderBy(F.desc("at"), "type").limit(3)
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)
    sinks.fold_batch(frame((1, "a"), (2, "b")), 0, path, fold, schema)
    for _ in range(3):
        got = sinks.fold_batch(frame((3, "c"), (4, "d")), 1, path, fold, schema)
        assert sorted(r["at"] for r in got.collect()) == [2, 3, 4]
    # a version that was cut off has no mark of success and isn't read
    (tmp_path / "log/version=2").mkdir()
    (tmp_path / "log/version=2/part-0.parquet").write_bytes(b"cut")
    assert sinks.store(spark, path, schema).count() == 3
    sinks.fold_batch(frame((5, None)), 2, path, fold, schema)
    sinks.fold_batch(frame(), 3, path, fold, schema)
    assert sorted(r["at"] for r in sinks.store(spark, path, schema).collect()) == [3, 4, 5]
    assert sinks._versions(spark, path) == [2, 3]  # the one that was read stays
    assert sinks.store(spark, str(tmp_path / "none"), schema).count() == 0


def test_log_of_a_stream(spark, tmp_path):
    rows = [(i, f"t{i}") for i in range(30)]
    for part in range(3):
        spark.createDataFrame(rows[part * 10 : part * 10 + 10], "at long, type string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("at long, type string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sinks.event_log(s, str(tmp_path / "log"), 7).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert sorted(r["at"] for r in sinks.store(spark, str(tmp_path / "log"), "at long, type string").collect()) == list(range(23, 30))


def test_only_changed_ranks_are_written(spark, tmp_path):
    path = str(tmp_path / "order")
    ranked = lambda b: b.select("page", "job_key", F.col("score").alias("rank"))
    frame = lambda *rows: spark.createDataFrame(list(rows), "page string, job_key string, score int")
    wrote = lambda n: sorted(((r["page"], r["job_key"], r["rank"]) for r in spark.read.parquet(f"{path}/changes/batch={n}").collect()), key=str)
    batches = [frame(("p", "a", 1), ("p", "b", 2), ("q", "z", 1)), frame(("p", "b", 1), ("p", "c", 2), ("p", "a", 3)), frame(("p", "b", 1), ("p", "a", 2)), frame()]
    want = [[("p", "a", 1), ("p", "b", 2), ("q", "z", 1)], [("p", "a", 3), ("p", "b", 1), ("p", "c", 2)], [("p", "a", 2), ("p", "c", None)], []]
    for n, b in enumerate(batches):
        for _ in range(2):  # replayed
            sinks.order_changes(b, n, ranked, path)
            assert wrote(n) == want[n]
    now = sinks.store(spark, f"{path}/order", sinks.ORDER).collect()
    assert sorted((r["page"], r["job_key"], r["rank"]) for r in now) == [("p", "a", 2), ("p", "b", 1), ("q", "z", 1)]


READINGS = [
    # a: loads slowly; the second reading has enough
    ("a", 0, 100, BODY + "a1", 2, True), ("a", 0, 300, BODY + "a2", 5, True), ("a", 0, 400, BODY + "a3", 9, True),
    # opened again with the same posting: nothing; then with another
    ("a", 60_000, 60_100, BODY + "a2", 5, True), ("a", 60_000, 60_300, BODY + "a9", 9, True), ("a", 120_000, 120_100, "new " + BODY, 4, True),
    # b: never enough; the reading after the wait counts, c: none comes, so the last one does, d: not the job's
    ("b", 0, 100, BODY + "b1", 1, True), ("b", 0, 2_300, BODY + "b2", 2, True), ("c", 0, 100, BODY + "c1", 1, True), ("c", 0, 500, BODY + "c2", 3, True),
    ("d", 0, 100, BODY + "d1", 9, False), ("d", 0, 2_500, BODY + "d2", 9, False), ("e", 0, 100, "too short", 9, True), ("f", 0, 100, BODY + "f", None, None), ("g", None, 100, BODY, 5, True),
    # h: the next opening ends the first
    ("h", 0, 100, BODY + "h1", 1, True), ("h", 1_000, 1_100, BODY + "h2", 6, True),
]
TAKEN = [("a", 0, BODY + "a2"), ("a", 120_000, "new " + BODY.strip()), ("b", 0, BODY + "b2"), ("c", 0, BODY + "c2"), ("h", 0, BODY + "h1"), ("h", 1_000, BODY + "h2")]


def test_postings_as_they_load(spark, tmp_path):
    schema = "job_key string, opened timestamp, ts timestamp, text string, n_skills int, same boolean"
    frame = lambda rows: spark.createDataFrame([(k, None if o is None else at(o), at(t), x, n, s) for k, o, t, x, n, s in rows], schema)
    base = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    plain = lambda got: sorted((r["job_key"], r["opened"] - base, r["text"]) for r in got)
    assert plain(refreshed(frame(READINGS)).collect()) == TAKEN
    assert refreshed(frame([])).count() == 0
    # as a stream: readings in the order of their times, a file a batch; the last file only moves the watermark on
    for rows in ([r for r in READINGS if r[2] < 1_000], [r for r in READINGS if 1_000 <= r[2] < 50_000], [r for r in READINGS if 50_000 <= r[2] < 100_000], [r for r in READINGS if r[2] >= 100_000], [("z", 10**6, 10**6, BODY, 0, False)], [("z", 2 * 10**6, 2 * 10**6, BODY, 0, False)]):
        frame(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = refreshed(s).writeStream.format("memory").queryName("taken").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert plain(spark.table("taken").collect()) == TAKEN
