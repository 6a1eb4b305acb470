"""The posting behind a listed job: which source settles it, and what scripts give."""

from loomrank.functions.lexicon import read_skills
from loomrank.operators import details

SKILLS = read_skills("python | language | 1.0 | python, py\nsql | language | 1.0 | mysql\ndocker | tool | 1.0 | docker")
JOBS = "job_key string, job_id string, title string, company string"
ASKED = "job_key string, position int, method string, url string, body string, confidence string"
VIEW = "https://x.example/posting/view.htm?id="


def posting(title, number="", more=""):
    return f"Job Posting Information. {number} {title}. Python is required and mysql is required for this work. Docker is required as well. " + "We build tools for many people every day. " * 6 + more


def settled(spark, requests=(), cache=(), responses=(), contexts=(), pages=(), jobs=(("a", "123456", "Data Wrangler", "Acme"),)):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    got = details.details(
        frame(jobs, JOBS), frame(requests, ASKED), frame(cache, "url string, text string"), frame(responses, "method string, url string, body string, text string"),
        frame(contexts, "job_key string, text string"), frame(pages, "job_key string, text string"), SKILLS,
    )
    return got


def test_sources_in_order(spark):
    mine, other = posting("Data Wrangler", "123456"), posting("Data Wrangler", "654321")
    jobs = [(k, "123456", "Data Wrangler", "Acme") for k in "abcdefg"] + [("a", "123456", "Data Wrangler", "Acme"), (None, "1", "x", None), ("h", None, None, None)]
    requests = [
        ("a", 0, "get", VIEW + "1", None, None), ("a", 1, None, VIEW + "2", "", ""),  # an answer to the first comes before a cached second
        ("b", 0, "GET", VIEW + "3", "", ""), ("b", 1, "GET", VIEW + "2", "", ""),  # the first is another job's
        ("c", 0, "POST", "https://x.example/form", "id=9", "HIGH"), ("d", 0, "POST", "https://x.example/form", "id=9", "low"),
        ("e", 0, "GET", "", "", ""), (None, 0, "GET", VIEW + "1", "", ""),
    ]
    cache = [(VIEW + "2", mine), (VIEW + "3", other), (None, mine), (VIEW + "1", None)]
    responses = [("GET", VIEW + "1", "", mine), ("GET", VIEW + "3", None, other), ("POST", "https://x.example/form", "id=9", other), ("GET", VIEW + "2", "", posting("Data Wrangler", "123456", "newer"))]
    got = settled(spark, requests, cache, responses, [("e", mine), ("f", other), ("a", mine)], [("f", mine), ("g", "too short"), ("e", mine)], jobs)
    rows = {r["job_key"]: r for r in got.collect()}
    assert got.count() == 9  # each key once, also the null one
    assert {k: (r["found"], r["position"]) for k, r in rows.items()} == {
        "a": ("response", 0), "b": ("cache", 1), "c": ("response", 0), "d": (None, None), "e": ("context", None), "f": ("page", None), "g": (None, None), "h": (None, None), None: (None, None),
    }
    assert rows["a"]["required_skills"] == ["python", "sql", "docker"] and rows["b"]["full_text"].startswith("Job Posting Information. 123456")
    asked = spark.createDataFrame(requests, ASKED)
    assert [tuple(r) for r in details.cache_rows(got, asked).collect()] == [(VIEW + "1", rows["a"]["full_text"])]


def test_settled_jobs_ask_no_more(spark, monkeypatch):
    """Texts that no open job asks for are never parsed."""
    seen = []
    whole = details.parse

    def watched(df, **more):
        seen.append(df.count())
        return whole(df, **more)

    monkeypatch.setattr(details, "parse", watched)
    mine = posting("Data Wrangler", "123456")
    requests = [("a", 0, "GET", VIEW + "1", "", ""), ("a", 1, "GET", VIEW + "2", "", "")]
    got = settled(spark, requests, [(VIEW + str(i), mine) for i in (1, 8, 9)], [("GET", VIEW + "2", "", mine)] * 3, [("a", mine), ("z", mine)], [("a", mine)])
    assert [r["found"] for r in got.collect()] == ["cache"] and seen == [1, 0, 0, 0]


def test_scripts(spark):
    words = "Job summary: required work for Data Wrangler people. " * 6
    jobs = [(1, "a", "123456", "Data Wrangler"), (1, "b", "", "Data Wrangler"), (1, "c", "J-77", "Clerk"), (1, "d", "nodigits", "Clerk"), (2, "e", "123456", "Data Wrangler"), (1, None, "123456", "x"), (None, "f", "123456", "x")]
    scripts = [
        (1, 0, f"x=9123456; {words}"), (1, 1, f"x=9123456; {words}"), (1, 2, f"postingId {words}"), (1, 3, f"J-77 nodigits {words}"), (1, 4, "123456 short"), (1, 5, None),
        (1, 6, "-" * 7000 + "123456" + words), (1, 7, "postingid 123456 " + "nothing here " * 40), (1, 8, "jobs.htm 123456 data wrangler " + "zz " * 80),
        *[(1, 10 + i, "filler " * 50) for i in range(22)], (1, 90, f"123456 {words}"), (None, 1, f"123456 {words}"),
    ]
    got = details.harvested(spark.createDataFrame(jobs, "page int, job_key string, job_id string, title string"), spark.createDataFrame(scripts, "page int, script int, text string"))
    rows = {r["job_key"]: (r["n_chunks"], r["text"]) for r in got.collect()}
    tail = scripts[8][2]
    assert rows == {"a": (2, f"{scripts[0][2]}\n{tail}"), "b": (2, f"{scripts[2][2][:2400]}\n{tail[:2400]}"), "c": (1, scripts[3][2]), "d": (1, scripts[3][2])}
    none = details.harvested(spark.createDataFrame([], "page int, job_key string, job_id string, title string"), spark.createDataFrame([], "page int, script int, text string"))
    assert none.count() == 0


def test_addresses(spark):
    from loomrank.sources.pages import posting_like

    urls = ["https://a.example/posting/1", "https://a.example/x?JobId=3", "https://a.example/myAccount/co-op/a/jobs.htm?my_post_id=3", "https://a.example/help/posting/1", "https://a.example/list?page=2", "not an address", "", None]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", details.posting_like("u").alias("ok")).collect()
    assert [r["ok"] for r in got] == [bool(u) and posting_like(u) for u in urls]


def test_lookup_does_not_sort_pairs(spark):
    from loomrank.operators import eligibility

    jobs = spark.createDataFrame([(1, 3, "7", "Low", "No 7"), (1, 2, "", "Low risk", "No 8"), (1, 5, "8", "x", "y")], "page long, row_index long, job_id string, title string, row_text string")
    hints = spark.createDataFrame([(1, 10, "7", ""), (1, 11, "8", "low"), (1, 12, "", "low"), (1, 13, "9", "z"), (2, 14, "7", "")], "page long, hint long, hint_id string, hint_title string")
    got = eligibility.found_jobs(jobs, hints)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 10, 3, 0), (1, 11, 5, 0), (1, 12, 2, 2), (1, 13, None, None), (2, 14, None, None)]
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_texts_of_others_are_not_parsed(spark, monkeypatch):
    """Only texts that their words and numbers don't rule out are parsed, none after one that is certain; scripts are read for jobs left."""
    seen, asked = [], []
    whole = details.parse

    def watched(df, **more):
        seen.append(sorted(r[0][:40] for r in df.select("normal" if "normal" in df.columns else "text").collect()))
        return whole(df, **more)

    monkeypatch.setattr(details, "parse", watched)
    mine, other, long = posting("Data Wrangler", "123456"), posting("Data Wrangler", "654321"), posting("Data Wrangler", "123456", "More of it. " * 120)
    requests = [("a", i, "GET", VIEW + str(i), "", "") for i in range(4)] + [("b", 0, "GET", VIEW + "0", "", ""), ("c", 0, "GET", VIEW + "9", "", "")]
    cache = [(VIEW + "0", other), (VIEW + "1", "  " + long), (VIEW + "2", mine), (VIEW + "3", long), (VIEW + "9", posting("Clerk"))]
    jobs = [("a", "123456", "Data Wrangler", "Acme"), ("b", "77777", "Data Wrangler", "Acme"), ("c", "", "Clerk", "Acme")]

    def contexts(left):
        asked.extend(r[0] for r in left.collect())
        return spark.createDataFrame([("b", other), ("c", posting("Clerk", more="Acme"))], "job_key string, text string")

    none = lambda schema: spark.createDataFrame([], schema)
    got = details.details(
        spark.createDataFrame(jobs, JOBS), spark.createDataFrame(requests, ASKED), spark.createDataFrame(cache, "url string, text string"),
        none("method string, url string, body string, text string"), contexts, none("job_key string, text string"), SKILLS,
    )
    assert seen == [[long[:40]], [], [" ".join(posting("Clerk").split())[:40]], []] and sorted(asked) == ["b", "c"]
    assert {r["job_key"]: (r["found"], r["position"], r["full_text"], r["required_skills"]) for r in got.collect()} == {
        "a": ("cache", 1, long.strip(), ["python", "sql", "docker"]), "b": (None, None, None, None), "c": ("context", None, " ".join(posting("Clerk", more="Acme").split()), ["python", "sql", "docker"]),
    }


def test_rule_before_parsing(spark):
    """What is told before parsing agrees with the whole rule, also on odd numbers, spaces, ids and companies."""
    from itertools import product

    from pyspark.sql import functions as F

    from loomrank.functions import text
    from loomrank.operators import eligibility

    says = "Required: work for Data Wrangler people at Acme. " * 5
    texts = [f"{x} {says}{y}" for x in ("", "123456", "1234567890", "x123456", "K123456", "﻿123456　", "12 3456", "ab cd 99999", "nodigits") for y in ("", "z " * 700)] + [None, "", "123456", says.replace("Acme", "us"), says.replace("Data Wrangler", "any"), "a" * 900 + " required"]
    jobs = [(i, t, c) for i in ("123456", " 123456 ", "12 3456", "ab cd", "NoDigits", "K123456", "", None) for t in ("Data Wrangler", "Wrangler of many odd large things", "x", None) for c in ("Acme Inc", "Inc", None)]
    df = spark.createDataFrame([(i, t, *j) for i, (t, j) in enumerate(product(texts, jobs))], "k int, text string, job_id string, title string, company string")
    df = df.crossJoin(spark.createDataFrame([(n, s) for n in (0, 3, 6, 8) for s in (False, True)], "n int, sure boolean"))
    none = F.lit(None).cast("string")
    c = F.struct(none.alias("work_term_duration_value"), F.lit(None).cast("boolean").alias("cover_letter_required"), F.lit(None).cast("boolean").alias("transcript_required"), none.alias("term_restriction"), F.array().cast("array<string>").alias("required_degree_fields"))
    # the rule as it was put before, with the text normalised by its own pattern
    t = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), f"{text.SPACE}+", " "))
    low, i = F.lower(t), F.lower(F.trim(F.coalesce("job_id", F.lit(""))))
    telling = lambda x, stop: (lambda ws: (ws, F.filter(ws, lambda w: ~w.isin(stop))))(F.filter(F.split(text.title_key(x), " "), lambda w: F.length(w) >= 4))
    words, own = telling("title", eligibility.TITLE_WORDS)
    keys, firm = F.when(F.size(own) > 0, own).otherwise(words), telling("company", eligibility.COMPANY_WORDS)[1]
    hits = F.size(F.filter(keys, lambda w: F.contains(low, w)))
    full = (F.length(low) >= 220) & low.rlike(eligibility.POSTING_TEXT) & ((F.col("n") >= 3) | (F.length(t) >= 1400))
    full = full & F.when(F.size(keys) == 0, F.length(t) >= 900).otherwise(hits >= F.when(F.size(keys) >= 4, 2).otherwise(1))
    numbers = F.slice(F.regexp_extract_all(low, F.lit(r"(?<![A-Za-z0-9_])\d{5,8}(?![A-Za-z0-9_])"), 0), 1, 24)
    stranger = (F.size(firm) > 0) & ~F.exists(firm, lambda w: F.contains(low, w)) & (i == "") & (F.col("n") < 8)
    same = full & (((i != "") & F.contains(low, i)) | ~(((i != "") & (F.size(numbers) > 0) & ~F.array_contains(numbers, i)) | stranger))
    df = df.select("*", same.alias("same"), full.alias("full"), eligibility.same_posting("text", "job_id", "title", "company", F.col("n"), c).alias("now"), eligibility.looks_like_full_posting("text", "title", F.col("n"), c).alias("now_full"),
                   *(eligibility.likely_posting("text", "job_id", "title", "company", F.col("sure"), m).alias(f"v{m}") for m in (6, 8)), c.alias("c"))
    rule = lambda v: F.col(v).isNotNull() & eligibility.likely_settled(F.col(f"{v}.brief"), F.col(f"{v}.strange"), F.col("n"), F.col("c"))
    want = F.col("same") | (F.col("sure") & F.col("full"))
    wrong = df.filter((F.col("same") != F.col("now")) | (F.col("full") != F.col("now_full")) | (rule("v8") != want) | ((F.col("n") <= 6) & (rule("v6") != want)) | (F.col("v8.normal") != t))
    assert df.filter("same").count() > 500 and df.filter("not same and full").count() > 500 and wrong.count() == 0
