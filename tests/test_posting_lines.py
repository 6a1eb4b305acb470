"""What long texts cost: parsing looks at few sentences, and each text is normalised and lower-cased once."""

import re

from pyspark.sql import functions as F

from loomrank.functions import text
from loomrank.operators import eligibility, posting

SENTENCE = "Nothing at all is said in here by anyone. "


def test_cues_hold_telling_words():
    """A sentence that a cue matches is never put aside."""
    said = {
        posting.SOFT_CUE: ["preferred", "preferable", "asset", "nice to have", "bonus", "plus", "would be an asset", "considered an asset"],
        posting.HARD_CUE: "required,must,mandatory,minimum qualification,proficiency,strong proficiency,experience with,familiarity with,knowledge of,understanding of,ability to,hands-on,hands on,competency,competencies,expertise in".split(","),
        posting.DEGREE: posting.DEGREE_WORDS,
    }
    for pattern, words in said.items():
        own = {posting.SOFT_CUE: posting.SOFT_WORDS, posting.HARD_CUE: posting.HARD_WORDS, posting.DEGREE: posting.DEGREE_WORDS}[pattern]
        for w in words:
            assert re.search(pattern, w) and any(x in w for x in own) and any(x in w for x in posting.TELLING)


def test_only_telling_sentences_are_kept(spark):
    body = SENTENCE * 50 + "ΟΔΟΣ. Python IS  Required here! İt is a PLUS\tto know mysql.  Upper-year students in term 3 only? " + SENTENCE * 50
    df = spark.createDataFrame([(body,), (None,), ("",)], "text string")
    rows = posting.parse(df).select("required_sentences", "preferred_sentences", "required_skills", "constraints.min_academic_year", "constraints.allowed_work_terms", "summary_bullets").collect()
    assert rows[0]["required_sentences"] == ["Python IS Required here!"] and rows[0]["preferred_sentences"] == ["İt is a PLUS to know mysql."]
    assert rows[0]["min_academic_year"] == 3 and rows[0]["allowed_work_terms"] == [3] and rows[0]["summary_bullets"] == ["Python IS Required here!", "Upper-year students in term 3 only?"]
    assert [tuple(r)[:3] for r in rows[1:]] == [([], [], [])] * 2
    plan = posting.parse(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "_lines" in plan  # the dictionary and the cues read these, not all sentences


def test_normalize_as_before(spark):
    odd = ["a  b", " \t a b  \n", "﻿﻿x", "", None, "a b c", "x 　y", "a   b", "é  ñ", " ", "a\x0bb", "😀  😀"]
    got = spark.createDataFrame([(x,) for x in odd], "t string").select(text.normalize("t").alias("n"), F.trim(F.regexp_replace(F.coalesce("t", F.lit("")), f"{text.SPACE}+", " ")).alias("w")).collect()
    assert all(r["n"] == r["w"] for r in got)


def test_pairs_read_a_text_once():
    c = F.col("constraints")
    rule = eligibility.same_posting("full_text", "job_id", "title", "company", F.lit(3), c)
    assert rule._jc.toString().count("full_text") == 1


def test_small_dictionaries_are_written_out(spark, monkeypatch):
    """Patterns as literals are compiled once; they find what those of a table find."""
    from loomrank.functions.lexicon import read_skills
    from loomrank.operators import dictionary

    skills = read_skills("c++ | language | 1.0 | c++, cpp\npython | language | 1.0 | python, py\nto the | process | 1.0 | to the, in the\nalone | tool | 1.0 | ")
    texts = [(t,) for t in ("c++11 and c++", "c++ and", "Python, PY2 py", "happy to theme in the", "alone", "x python\nto the", "", None)]
    df = spark.createDataFrame(texts, "t string")
    rows = lambda: [[tuple(r) for r in df.select(dictionary.skills_in("t", skills, own)).collect()] for own in (True, False)]
    written = rows()
    assert "from_json" not in dictionary.skills_in("t", skills)._jc.toString()
    monkeypatch.setattr(dictionary, "FEW_ALIASES", 0)
    assert "from_json" in dictionary.skills_in("t", skills)._jc.toString() and rows() == written and any(r[0] for r in written[1])
