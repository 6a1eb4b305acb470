"""Registered queries: that the entry point holds with and without the corpus operators, and streams run."""

import datetime as dt
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_corpus_operators(tmp_path):
    subprocess.run(["cp", "-r", f"{ROOT}/loomrank", f"{ROOT}/__spark_entry__.py", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "loomrank/llm")], check=True)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and set(o) <= set(q) and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_ranked_pipeline(spark):
    from loomrank.operators import ranking
    from loomrank.operators.scoring import Profile

    me = Profile(skills=("python", "sql"), faculty="Engineering", target_role="developer", term_length="either")
    jobs = spark.createDataFrame(
        [(0, "Developer", "A", "T", "Python and SQL are required. Docker is an asset."), (1, "Sales", "B", "T", "PhD students only, PhD required."), (2, "Clerk", "C", "T", None)],
        "row_index int, title string, company string, location string, snippet string",
    )
    a = ranking.analyze(jobs, me).cache()
    rows = {r["row_index"]: r for r in a.collect()}
    assert rows[0]["required_skills"] == ["python", "sql"] and rows[0]["skill_match"] > rows[2]["skill_match"]
    assert rows[1]["hard"] and rows[1]["recommendation"]["label"] == "Do not apply"
    assert [r["row_index"] for r in ranking.ranked(ranking.eligible(a, me)).collect()][0] == 0
    assert ranking.overlay(a).filter("row_index = 0").first()["overlay"]["signals"]["stack_chips"] == ["python", "sql", "docker"]


def test_stream_of_listings(spark, tmp_path):
    from loomrank.streaming.listings import changes, limited

    rows = [("p", v, dt.datetime(2024, 1, 1, 0, k)) for k, v in enumerate(["a", "a", "b", None, "b", "a"])] + [("n", None, dt.datetime(2024, 1, 1))] + [("q", "b", dt.datetime(2024, 1, 1))]
    spark.createDataFrame(rows, "page string, signature string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("page string, signature string, ts timestamp").parquet(str(tmp_path / "in"))
    q = changes(s, "page", "signature").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    want = [("p", "a"), ("p", "a"), ("p", "b"), ("q", "b")]
    assert sorted((r[0], r[1]) for r in spark.table("seen").collect()) == want
    batch = spark.read.parquet(str(tmp_path / "in"))
    assert sorted((r[0], r[1]) for r in changes(batch, "page", "signature").collect()) == want
    at = lambda ms: dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)
    tries = spark.createDataFrame([("k", at(x)) for x in (1299, 1300, 0, 2599, 2600, 5000)] + [("m", at(1))], "key string, ts timestamp").coalesce(1)
    kept = [("k", at(x)) for x in (0, 1300, 2600, 5000)] + [("m", at(1))]
    assert sorted(tuple(r) for r in limited(tries, "key").collect()) == kept
    tries.write.parquet(str(tmp_path / "tries"))
    q = limited(spark.readStream.schema(tries.schema).parquet(str(tmp_path / "tries")), "key").writeStream.format("memory").queryName("let").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert sorted(tuple(r) for r in spark.table("let").collect()) == kept
