"""Cases worked out by hand: each expected value follows from the definition of its score."""

from pyspark.sql import functions as F

from loomrank.functions import text
from loomrank.functions.lexicon import SKILLS
from loomrank.operators import dictionary, eligibility, posting, ratings, resume, scoring, search, stores, tracker

TEXTS = "array<string>"


def value(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


def arr(*xs):
    return F.array(*map(F.lit, xs)).cast(TEXTS)


def dist(**shares):
    return F.array(*(F.struct(F.lit(k.replace("_", " ")).alias("label"), F.lit(float(v)).alias("percent")) for k, v in shares.items()))


def test_scores(spark):
    v = scoring.viability(F.lit(70), F.lit(60), F.lit(85), 0)
    assert value(spark, v["score"]) == 63
    assert value(spark, scoring.term_compatibility(F.lit(2), dist(WT1=40, WT2=25, WT3=10))) == 88
    assert value(spark, scoring.faculty_alignment(F.lit("Arts"), dist(Engineering=55, Arts=10))) == 52
    assert value(spark, scoring.faculty_alignment(F.lit("Engineering"), dist(Engineering=55, Math=30))) == 100
    assert value(spark, scoring.similarity_percent(F.lit(0.5)), scoring.similarity_percent(F.lit(0.0)), scoring.similarity_percent(F.lit(-0.5))) == (59, 18, 9)
    assert value(spark, scoring.blended(F.lit(80), F.lit(40), F.lit(2), F.lit(0), F.lit(0))) == 75


def test_roles(spark):
    role = F.lit("software developer")
    assert value(spark, scoring.role_match(F.lit("Junior Software Developer"), F.lit(""), role)) == 95
    assert value(spark, scoring.role_match(F.lit("Developer, Software Tools"), F.lit(""), role)) == 78
    assert value(spark, scoring.role_match(F.lit("Marketing Assistant"), F.lit("a software developer helps"), role)) == 30
    assert value(spark, scoring.role_match(F.lit("x"), F.lit("y"), F.lit(""))) == 50


def test_recommendation(spark):
    r = scoring.recommend(F.lit(66))
    assert value(spark, r["label"], r["reasons"]) == ("Apply if you have exceptional projects", [])
    r = scoring.recommend(F.lit(30), {"low_skill_match": F.lit(True)})
    assert value(spark, r["label"], F.size(r["reasons"])) == ("Consider alternative divisions", 2)


def test_skill_match(spark):
    own = arr("python", "sql", "docker")
    assert value(spark, scoring.skill_match(own, arr("python", "sql", "kubernetes"), arr("docker"), F.lit(""))) == 70
    assert value(spark, scoring.skill_match(arr("postgresql"), arr("sql"), arr(), F.lit(""))) == 100
    assert value(spark, scoring.skill_match(arr("sql"), arr("postgresql"), arr(), F.lit(""))) == 0
    assert value(spark, scoring.skill_match(arr("python"), arr(), arr(), F.lit("uses python"))) == 100


def test_lines(spark):
    java = dictionary.canonical(arr("java"))
    assert value(spark, scoring.line_coverage(arr("Python or Java required"), java, True)) == 100
    assert value(spark, scoring.line_coverage(arr("Python and Java"), java, True)) == 50


def test_skills_in_texts(spark):
    t = F.lit("Experience with C++ and .NET")
    assert value(spark, dictionary.skills_in_sentences(F.array(t)), dictionary.skills_in(t)) == ([], ["c"])
    assert value(spark, resume.resume_skills(F.lit("Kubernetes admin"))) == [".net", "kubernetes"]
    assert value(spark, resume.resume_skills(F.lit("Kubernetes admin"), compat=False)) == ["kubernetes"]
    assert len(SKILLS) == 106 and dictionary.lookup()["c/c++"] == "c" and dictionary.lookup()["llm api"] == "openai api" and dictionary.lookup()["swift"] == "swift"


def test_text(spark):
    assert [value(spark, text.stem(F.lit(w))) for w in ("testing", "boxes", "api", "amazingly")] == ["test", "box", "api", "amazing"]
    assert value(spark, text.sentences(F.lit("A b. C d!\nE"))) == ["A b.", "C d!", "E"]
    assert value(spark, text.hash32(F.lit("")), text.hash32(F.lit("a"))) == (2166136261, 3826002220)
    assert value(spark, text.ngrams(arr("a", "b"), 1, 3)) == ["a", "b", "a b"]
    assert value(spark, text.normalize(F.lit(None).cast("string")), text.tokenize(F.lit("a b"))) == ("", ["a", "b"])
    assert value(spark, text.comma_list(F.lit(" a, ,b ")), text.first_number(F.lit("1,234.5 x")), text.first_percent(F.lit("up 7.5 %"))) == (["a", "b"], 1234.5, 7.5)


def test_eligibility(spark):
    of = lambda s: posting.eligibility(text.sentences(F.lit(s)))
    assert value(spark, of("Must be in work term 3 or above.")["min_work_term"]) == 3
    assert value(spark, of("Only term 4 and term 5 students eligible.")["allowed_work_terms"]) == [4, 5]
    assert value(spark, of("Minimum 5 years of experience required.")["min_academic_year"]) == 5


def test_constraints(spark):
    rows = [(1, "Open to 4-month or 8-month students. Must be in work term 3 or above. Upper-year students eligible only. Python is required. Docker is an asset."), (2, None), (3, "")]
    df = posting.parse(spark.createDataFrame(rows, "row_index long, text string"))
    got = {r["row_index"]: r for r in df.collect()}
    assert (got[1]["required_skills"], got[1]["preferred_skills"]) == (["python"], ["docker"])
    assert got[2]["full_text"] == got[3]["full_text"] == "" and got[2]["required_skills"] == []
    keep = df.filter("row_index = 1").select(*(eligibility.term_eligibility(F.col("constraints"), p)["eligible"].alias(p) for p in ("4", "8", "either"))).first()
    assert tuple(keep) == (False, False, True)
    person = scoring.academic(F.lit(""), F.lit("Engineering"))
    why = df.filter("row_index = 1").select(eligibility.hard_reasons(F.col("constraints"), 1, person)).first()[0]
    assert len(why) == 2 and "work term" in why[0]


def test_degree_alignment(spark):
    a = scoring.degree_alignment(arr("business"), arr("engineering"), arr("engineering"))
    assert value(spark, a["score"], a["required_mismatch"]) == (27, True)


def test_hiring(spark):
    rows = spark.createDataFrame([(1, k, f"T{k}", h) for k, h in enumerate([12, 9, 15, 6])] + [(2, k, "Fall", h) for k, h in enumerate([12, 9, 15, 6, 3, 4])], "page_id long, seq int, term string, hires int")
    got = {r["page_id"]: r for r in ratings.hiring(rows, ["page_id"]).collect()}
    assert got[1]["selectivity"] == -5 and got[2]["trend"] == "Upward hiring trend"
    entries = spark.createDataFrame([(1, "Eng", 40.0, 0), (1, "eng", 55.0, 1), (1, "Math", 120.0, 2)], "page_id long, label string, percent double, pos int")
    d = ratings.distribution(entries, ["page_id"]).first()["dist"]
    assert [(x["label"], x["percent"]) for x in d] == [("Math", 100.0), ("eng", 55.0)]
    h = ratings.hires_row(arr("Fall 2023", "14"))
    assert value(spark, h["hires"], ratings.hires_row(arr("Fall 2023", "14"), strict=True)["hires"]) == (2023, 14)
    assert value(spark, ratings.label_percent(F.lit("Math: 30%"))["percent"], ratings.label_percent(F.lit("12.5% Arts"))["label"]) == (30.0, "Arts")


def test_stores(spark):
    skills = resume.effective_skills(arr("java", "sql"), arr("SQL"), arr("sql"))
    assert value(spark, skills) == ["java", "sql"]
    now = 10**12
    cache = spark.createDataFrame([("a", 3, now, 1), ("b", 4, now - 8 * 86400000, 2), ("c", 4, now, 3)], "url string, version int, ts long, data int")
    assert [r["url"] for r in stores.cached(cache, now).collect()] == ["c"]
    new = stores.cache_put(cache, spark.createDataFrame([("c", 4, now + 1, 9)], cache.schema), most=2)
    assert [(r["url"], r["data"]) for r in new.collect()] == [("c", 9), ("a", 1)]
    s = stores.settings(spark.createDataFrame([('{"preferences":{"workTerm":9,"preferredTermLength":"5"},"featureFlags":{"autofill":true}}',), (None,)], "settings string")).collect()
    assert (s[0]["preferences"]["work_term"], s[0]["preferences"]["term_length"], s[0]["feature_flags"]["autofill"], s[1]["preferences"]["work_term"]) == (6, "4", True, 1)


def test_tracker(spark):
    assert value(spark, tracker.job_key(F.lit(""), F.lit("https://h/x?a=1&sessionId=1#f"), F.lit(""))) == "url:https://h/x?a=1"
    assert value(spark, *(tracker.status_of(F.lit(t)) for t in ("Offer – interview scheduled", "Not selected", "Viewed"))) == ("interview", "rejected", None)
    assert value(spark, tracker.field_intent(F.lit("Company name"))) == "name"


def test_search():
    q = search.expand('"data engineer" python')
    assert "data engineer" in q.phrases and "python" in q.tokens and "etl" in q.tokens


def test_resume_repairs(spark):
    from loomrank.operators import resume

    assert value(spark, resume.sanitize_pdf(F.lit("M a t t h e w wrote a to z in Fide x and 20 24"))) == "Matthew wrote a to z in Fidex and 20 24"
    assert value(spark, resume.sanitize_pdf(F.lit("xa b c de f"))) == "xa b c de f"
    from loomrank.functions import text

    units = "é😀".encode("utf-16-be")
    h = 2166136261
    for k in range(0, len(units), 2):
        h = ((h ^ int.from_bytes(units[k : k + 2], "big")) * 16777619) & 0xFFFFFFFF
    assert value(spark, text.hash32(F.lit("é😀"))) == h


def test_job_lookup(spark):
    jobs = spark.createDataFrame([("p", 0, "11", "Data Clerk", "11 Data Clerk"), ("p", 1, None, "Developer", "row 222 (new)"), ("p", 2, "3", None, None), ("q", 0, "11", "Developer II", "x")], "page string, row_index int, job_id string, title string, row_text string")
    hints = spark.createDataFrame(
        [("p", 1, " 11 ", "Developer"), ("p", 2, "222", ""), ("p", 3, "22", "CLERK"), ("p", 4, "", "Senior Developer"), ("q", 5, "2", "Baker"), ("r", 6, "11", "x"), ("q", 7, None, None), ("q", 8, "a.b(", "developer")],
        "page string, hint int, hint_id string, hint_title string",
    )
    got = {r["hint"]: (r["row_index"], r["way"]) for r in eligibility.found_jobs(jobs, hints).collect()}
    assert got == {1: (0, 0), 2: (1, 1), 3: (0, 2), 4: (1, 3), 5: (None, None), 6: (None, None), 7: (None, None), 8: (0, 2)}
    assert eligibility.found_jobs(jobs.limit(0), hints).filter("way is not null").count() == 0


def test_manual_skills(spark):
    weights = F.create_map(F.lit("sql"), F.lit(2.0), F.lit("go"), F.lit(1.0))
    assert value(spark, resume.still_excluded(arr("SQL", "java"), arr("sql", "python"))) == ["SQL"]
    assert value(spark, resume.hidden(arr(" SQL ", ""), F.lit("Java")), resume.hidden(arr("sql"), F.lit("SQL")), resume.restored(arr("SQL", "java"), F.lit("sql"))) == (["sql", "java"], ["sql"], ["java"])
    put = resume.manual_added(weights, arr("Python", "x"), F.lit(" Python "))
    assert value(spark, put["weights"], put["excluded"], put["added"]) == ({"sql": 2.0, "go": 1.0, "python": 1.0}, ["x"], True)
    none = resume.manual_added(weights, arr("X"), F.lit(" "))
    assert value(spark, none["weights"], none["excluded"], none["added"]) == ({"sql": 2.0, "go": 1.0}, ["X"], False)
    first = resume.manual_added(F.lit(None).cast("map<string,double>"), F.lit(None).cast(TEXTS), F.lit("sql"))
    assert value(spark, first["weights"], resume.manual_removed(weights, F.lit("go "))) == ({"sql": 1.0}, {"sql": 2.0})


def test_profiles_and_settings(spark):
    kind = "id string, name string, active boolean, resume_text string, resume_skills map<string,double>, manual_skills map<string,double>, excluded array<string>"
    profiles = spark.createDataFrame([("default", "Default", None, " ", {}, None, None), ("p-1", "One", True, "old", {"sql": 1.0}, {"go": 1.0}, ["x"])], kind)
    settings = spark.createDataFrame([(7, "new", {"java": 1.0}, None, ["y"])], "own int, resume_text string, resume_skills map<string,double>, manual_skills map<string,double>, excluded array<string>")
    by = lambda df: {r["id"]: r for r in df.collect()}
    made = by(stores.create_profile(profiles, "n" * 90, 5))
    assert set(made) == {"default", "p-1", "p-5"} and made["p-5"]["name"] == "n" * 80 and made["p-5"]["resume_skills"] == {} and not made["p-5"]["active"]
    assert by(stores.create_profile(profiles, None, 1))["p-1"]["name"] == "Untitled"
    saved = by(stores.resume_saved(profiles, settings))
    assert (saved["p-1"]["resume_text"], saved["p-1"]["excluded"], saved["default"]["resume_text"]) == ("new", ["y"], " ")
    seeded = by(stores.default_seeded(profiles, settings))
    assert (seeded["default"]["resume_text"], seeded["default"]["manual_skills"], seeded["p-1"]["resume_text"]) == ("new", {}, "old")
    assert by(stores.default_seeded(profiles, settings.limit(0)))["default"]["resume_text"] == " "
    loaded = stores.settings_of_profile(settings, profiles).first()
    assert (loaded["own"], loaded["resume_text"], loaded["manual_skills"], loaded["excluded"]) == (7, "old", {"go": 1.0}, ["x"])
    assert stores.settings_of_profile(settings, profiles.limit(0)).first()["resume_text"] == "new"


def test_card(spark):
    from loomrank.operators import ranking

    rows = [
        ("Clerk", "A", None, ["sql", "go", "c", "d", "e"], ["java", "sql"], ["x" * 121, "short"], list("abcdef"), 10, (["Missing much of what is asked"],)),
        ("", "A", "T", [], None, None, None, 90, None),
        ("Chef", "", "T", ["go"], ["java"], [], [], 45, (["Add a project featuring go, and more", "second"],)),
    ]
    kind = "title string, company string, location string, required_skills array<string>, preferred_skills array<string>, summary_bullets array<string>, flags array<string>, target_role_match int, recommendation struct<reasons:array<string>>"
    df = ranking.card(spark.createDataFrame(rows, kind).withColumns({"skill_match": F.lit(1), "overall_match": F.lit(2)}), ["sql", "java"])
    a, b, c = (r["card"] for r in df.coalesce(1).collect())
    assert (a["title"], a["place"], a["strong"], a["missing"], a["requirements"], a["flags"]) == ("Clerk", "A", ["sql", "java"], ["go", "c", "d", "e"], ["x" * 117 + "…", "short"], list("abcde"))
    assert a["suggestions"] == ["Focus on gaining experience in go and c — the most requested gaps.", 'Tailor your resume title/objective to align with "Clerk".', "Missing much of what is asked"]
    assert (b["title"], b["place"], b["strong"], b["suggestions"]) == ("Untitled", "A • T", [], [])
    assert (c["place"], c["strong"], c["suggestions"]) == ("T", ["java"], ["Add a project featuring go to strengthen your match."])  # the reason's first 20 characters are said already
    assert ranking.card(df.drop("card").limit(0), []).count() == 0


def test_sections(spark):
    m = lambda *x: eligibility.section_matches(*map(F.lit, x))
    cases = [
        m("posting 123456 of x", "123456", "", ""), m("posting 654321 data platform acme", "123456", "Data Platform", "Acme Inc"), m("data platform at acme", "123456", "Data Platform", "Acme Inc"),
        m("data platform at other", "", "Data Platform", "Acme Inc"), m("software developer", "", "Software Developer", ""), m("anything", "", "", ""), m(None, "1", "a", "b"),
    ]
    assert value(spark, *cases) == (True, False, True, False, True, False, False)
    body = " Required: " + "much to do " * 30
    sections = spark.createDataFrame(
        [("p", 0, "short data platform", True), ("p", 1, "data platform" + body, True), ("p", 2, "platform" + body * 3, True), ("p", 3, "data platform" + body * 9, False), ("p", 4, "data platform" + body, True)],
        "page string, section int, text string, visible boolean",
    )
    jobs = spark.createDataFrame([("p", 0, None, "Data Platform", None), ("p", 1, "", "Chef", ""), ("q", 2, "1", "Data Platform", "")], "page string, row_index int, job_id string, title string, company string")
    got = {r["row_index"]: r["section"] for r in eligibility.found_sections(jobs, sections).collect()}
    assert got == {0: 1, 1: None, 2: None}


def test_field_patterns_as_plain_words(spark):
    import re

    from loomrank.functions.lexicon import FIELD_PATTERNS
    from loomrank.operators import dictionary

    texts = ["prose pr", "public relation", "communication", "Mathematic maths cs", "CSS and css", "arts", "party", "science", "conscience", "operation", "bba.mba", "econ", "statistic", "health-y", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", dictionary.posting_fields("t").alias("f"))
    for t, f in rows.collect():
        assert f == [k for k, p in FIELD_PATTERNS.items() if re.search(p, (t or "").lower(), re.ASCII)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE humanities" not in plan and "mechatronics|" not in plan


def test_quality_is_worked_out_once(spark):
    from loomrank.operators.resume import is_resume

    df = spark.createDataFrame([("Work at a university. " * 10,), ("12 34 56",), ("",), (None,)], "t string").select(is_resume("t").alias("r"))
    assert [r["r"] for r in df.collect()] == [True, False, False, False]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_title_key_in_one_pass(spark):
    from loomrank.functions.text import compact, title_key

    df = spark.createDataFrame([("  A--b   c!\n(é) D9 ",), ("é",), ("a b",), (None,)], "t string").select(title_key("t").alias("k"), compact("t").alias("c"))
    assert [tuple(r) for r in df.collect()] == [("a b c d9", "abcd9"), ("", ""), ("a b", "ab"), ("", "")]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 2
