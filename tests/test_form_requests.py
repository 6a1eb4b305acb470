"""Requests of forms: what handlers name, the state that forms keep, and which requests come first."""

from urllib.parse import parse_qsl

from loomrank.operators import form_requests as f

FIELDS = "page int, form int, position int, name string, type string, value string, checked boolean"


def test_row_actions(spark):
    many = " ".join(f"A4J.AJAX.Submit('f','src_{i:02}');" for i in range(30))
    rows = [
        ("a", 0, "PrimeFaces.ab({s:'tbl:row1',f:'main'})"), ("a", 1, "__doPostBack('grid$1','') var form = \"second\"; document.getElementById('third')"), ("a", 2, "PrimeFaces.ab({s:'tbl:row1',f:'main'})"),
        ("a", 3, "12:34:56 null:value x:y"), ("b", 0, many), ("c", 0, None), ("c", 1, ""), (None, 0, "s='lost:one'"),
    ]
    got = {r["job_key"]: r for r in f.row_actions(spark.createDataFrame(rows, "job_key string, seq int, text string")).collect()}
    assert set(got) == {"a", "b"}  # nothing is named elsewhere
    assert got["a"]["source_ids"] == ["tbl:row1"] and got["a"]["event_targets"] == ["tbl:row1", "grid$1"] and got["a"]["form_hints"] == ["main", "second", "third"]
    assert got["b"]["source_ids"] == [f"src_{i:02}" for i in range(20)] and got["b"]["event_targets"] == []


def test_forms(spark):
    fields = [
        (1, 0, 0, "__VIEWSTATE", "hidden", "old"), (1, 0, 1, "jobId", "text", ""), (1, 0, 2, "__VIEWSTATE", "Hidden", "a b"), (1, 0, 3, "csrfCode", "text", None), (1, 0, 4, "upload", "file", "x"),
        (1, 0, 5, "pick", "radio", "no"), (1, 0, 6, "activeTab", "radio", "yes"), (1, 0, 7, " ", "hidden", "x"), (1, 0, 8, None, "hidden", "x"), (1, 0, 9, "page", "hidden", "2"),
    ]
    frame = spark.createDataFrame([(*r, r[3] == "activeTab") for r in fields], FIELDS)
    pairs = lambda rows: [tuple(x) for x in rows]
    assert pairs(f.form_state(frame).first()["hidden"]) == [("__VIEWSTATE", "a b"), ("csrfCode", ""), ("page", "2")]
    assert pairs(f.form_payload(frame).first()["payload"]) == [("__VIEWSTATE", "a b"), ("activeTab", "yes")]
    jobs = spark.createDataFrame([(1, "a", "77&8"), (1, "b", None), (1, None, "5"), (2, "c", "9"), (3, "d", "9")], "page int, job_key string, job_id string")
    forms = spark.createDataFrame([(1, 0, None, "https://x.example/jobs.htm?job=old&b=%20"), (1, 1, "h", "https://x.example/help/jobs.htm"), (2, 0, "", "https://x.example/about")], "page int, form int, form_id string, action string")
    actions = spark.createDataFrame([("a", 0, "__doPostBack('grid$1','')")], "job_key string, seq int, text string")
    got = f.form_requests(jobs, actions, forms, frame).orderBy("position").collect()
    assert {r["job_key"] for r in got} == {"a"} and [r["position"] for r in got] == list(range(len(got))) and len(got) == 21
    assert (got[0]["method"], parse_qsl(got[0]["body"], keep_blank_values=True)) == ("POST", [("__VIEWSTATE", "a b"), ("csrfCode", ""), ("page", "2"), ("__EVENTTARGET", "grid$1"), ("__EVENTARGUMENT", "")])
    assert parse_qsl(got[1]["body"]) == [("__VIEWSTATE", "a b"), ("activeTab", "77&8")] and got[2]["method"] == "GET"
    assert got[2]["url"] == "https://x.example/jobs.htm?job=old&b=+&__VIEWSTATE=a+b&activeTab=77%268"
    asked = [dict(parse_qsl(r["url"].split("?")[1])) for r in got if r["method"] == "GET"]
    assert all("77&8" in q.values() for q in asked) and all(q["job"] == "old" for q in asked if "jobId" in q)
    assert f.form_requests(jobs, actions, forms, frame, most=3).count() == 3 and f.form_requests(jobs.limit(0), actions, forms, frame).count() == 0


def test_long_bodies_are_left_out(spark):
    fields = spark.createDataFrame([(1, 0, 0, "token", "hidden", "x" * 20_000, None)], FIELDS)
    jobs, forms = spark.createDataFrame([(1, "a", "7")], "page int, job_key string, job_id string"), spark.createDataFrame([(1, 0, "m", "https://x.example/jobs.htm")], "page int, form int, form_id string, action string")
    got = f.form_requests(jobs, spark.createDataFrame([("a", 0, "s='tbl:row1'")], "job_key string, seq int, text string"), forms, fields).collect()
    assert {r["method"] for r in got} == {"GET"} and all("token" not in r["url"] for r in got)


def test_bodies_are_not_shuffled(spark):
    jobs = spark.range(0, 2000, 1, 4).selectExpr("id % 50 AS page", "id AS job_key", "CAST(id AS STRING) AS job_id")
    actions = jobs.selectExpr("job_key", "0 AS seq", "concat('s=\"row:', job_id, '\"') AS text")
    forms = spark.range(50).selectExpr("id AS page", "0 AS form", "'main' AS form_id", "'https://x.example/jobs.htm' AS action")
    fields = spark.range(50).selectExpr("id AS page", "0 AS form", "0 AS position", "'token' AS name", "'hidden' AS type", "repeat(sha2(cast(id as string), 256), 8) AS value", "false AS checked")
    written = lambda: sum(e.totalShuffleWrite() for e in _items(spark.sparkContext._jsc.sc().statusStore().executorList(True)))
    before, frame = written(), f.form_requests(jobs, actions, forms, fields)
    assert frame.count() > 20_000
    assert written() - before < 600 * 2000


def _items(seq):
    return [seq.apply(i) for i in range(seq.length())]
