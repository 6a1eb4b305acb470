"""What resumes cost: their whole text is lower-cased once, and runs of letters are never tried shorter."""

from pyspark.sql import functions as F

from loomrank.operators import resume
from loomrank.operators.resume import ARTIFACTS, LAYOUT


def test_text_is_lowered_once(spark):
    df = spark.createDataFrame([("TECHNICALSKILLS Python, SQL",), (None,)], "text string")
    got = df.select(resume.resume_skills("text").alias("s"))
    plan = got._jdf.queryExecution().analyzed().toString()
    assert plan.count("lower(trim(regexp_replace(") == 1
    assert got.collect()[1]["s"] == []


def test_repairs_as_with_shorter_runs(spark):
    """Possessive runs give what plain ones give."""
    odd = ["auto-\nmation dockers and\nmore", "Developm ent abcd e f Integrat  ed", "a-b - cd e-f-g - h1 x - y", "ab - cd-ef - gh", "Some t University of t College", "Jan 2020 t Present", "abcdé ing abcd_ ing", "ab\tcd", "ab -\ncd", "x-y-zz - ab-c"]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    for pattern, new in LAYOUT + ARTIFACTS:
        plain = pattern.replace("}+", "}").replace("++", "+").replace("*+", "*")
        rows = df.select(F.regexp_replace("t", pattern, new).alias("a"), F.regexp_replace("t", plain, new).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in rows), pattern
