"""Registered queries over the driver's tables, each with its SQL twin for another engine.

The tables hold no postings, so those are made from them: a document's text with lines of a posting that its id picks.
Dictionaries are of words that do occur. Texts are whole and tables are whole everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomrank.functions import text
from loomrank.functions.lexicon import read_skills
from loomrank.operators import details, dictionary, eligibility, form_requests, posting, ranking, ratings, scoring, search, stores, tracker
from loomrank.operators.scoring import Profile
from loomrank.sources.tables import stored

# A dictionary of words that the documents have.
WORDS = read_skills("""
article | language | 1.1 | the, of
pronoun | language | 1.0 | that
preposition | tool | 0.9 | with
phrase | process | 0.7 | to the, in the, and the
french | domain | 0.8 | que, des
german | soft-skill | 0.5 | nicht
""")
OWNED = ("article", "french")

# Lines that make a document a posting; its id picks one of each list.
LINES = [
    [
        "This is a 4-month work term.",
        "An 8-month commitment is preferred.",
        "8 month term required for this role.",
        "Open to 4 month or 8 month students.",
        "Two work terms required.",
        "Work term duration: 4-month work term",
        "No length is given.",
    ],
    [
        "Must be in work term 3 or above.",
        "Only term 4 and term 5 students eligible.",
        "Minimum 5 years of experience required.",
        "Upper-year students only.",
        "Anyone may apply.",
    ],
    [
        "Cover letter is required and transcript required.",
        "Cover letter recommended, minimum GPA 3.5 expected.",
        "Graduate students only.",
        "Must be currently enrolled in a Master's program.",
        "For students in term 2.",
        "Completed first year of study.",
    ],
    [
        "Must be enrolled in an engineering degree.",
        "Business or commerce students preferred.",
        "A degree in computer science is an asset.",
        "Experience with the tools that we use is required.",
        "Knowledge of nicht is a bonus.",
        "Marketing majors and arts majors welcome.",
        "Nothing more is asked.",
        "Required: the, que or that.",
    ],
]
TITLES = ["Software Developer", "Marketing Assistant", "Data Analyst Intern", "Developer, Software Tools", "Clerk"]
ME = Profile(skills=OWNED, resume_text="engineering student", work_term=3, faculty="Engineering", target_role="software developer, data analyst", industries=("thth", "erre"), term_length="4")


#: Milliseconds since 1970 of a time without zone, whatever the session's zone.
MILLIS = "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _picked(lists: list[list[str]], key: str):
    return [F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.col(key), F.lit(len(xs))) + 1).cast("int")) for xs in lists]


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs made from documents: row_index, title, company, location, snippet, text."""
    d = _read(spark, sf_dir, "documents")
    lines = F.concat_ws(" ", *_picked(LINES, "doc_id"))
    body = F.concat_ws(" ", F.coalesce("text", F.lit("")), lines)
    return d.select(F.col("doc_id").alias("row_index"), _picked([TITLES], "doc_id")[0].alias("title"), F.col("source").alias("company"), F.col("lang").alias("location"), lines.alias("snippet"), body.alias("text"))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_pick(xs: list[str], key: str = "doc_id") -> str:
    return f"[{', '.join(map(_q, xs))}][CAST({key} % {len(xs)} AS INTEGER) + 1]"


SQL_LINES = " || ' ' || ".join(_sql_pick(xs) for xs in LINES)
SQL_BODY = "coalesce(text, '') || ' ' || " + SQL_LINES
SQL_NORMAL = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


# --- text ---------------------------------------------------------------------------------------------------------


def text_primitives(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents").select("doc_id", "text")
    d = d.withColumns({"n": text.normalize("text"), "tokens": text.tokenize("text")})
    return d.select(
        "doc_id", F.length("n").cast("bigint").alias("n_normal"), F.size("tokens").cast("bigint").alias("n_tokens"), F.size(text.sentences("text")).cast("bigint").alias("n_sentences"),
        F.length(text.compact("text")).cast("bigint").alias("n_compact"), text.title_key("text").alias("title_key"),
        text.stem(F.lower(F.get("tokens", F.lit(0)))).alias("first_stem"), text.n_ngrams("tokens", 1, 3).cast("bigint").alias("n_grams"), F.coalesce(text.last_ngram("tokens", 1, 3), F.lit("")).alias("last_gram"),
        F.size(F.array_distinct(text.search_words("text"))).cast("bigint").alias("n_words"),
    )


TEXT_PRIMITIVES = rf"""
WITH d AS (SELECT doc_id, text, {SQL_NORMAL.format("text")} AS n FROM documents),
t AS (SELECT *, list_filter(string_split_regex(lower(n), '[^a-z0-9#+.\-/]+'), lambda x: x <> '') AS tokens FROM d),
s AS (SELECT *, list_transform(tokens, lambda w: trim(regexp_replace(w, '[^a-z0-9#+.\-/ ]', '', 'g'))) AS clean FROM t),
k AS (SELECT *, list_transform(clean, lambda w: CASE WHEN len(w) <= 3 THEN w ELSE regexp_replace(w, '(ing|edly|ed|ly|es|s)$', '') END) AS stems FROM s)
SELECT doc_id, len(n) AS n_normal, len(tokens) AS n_tokens,
       len(list_filter(string_split(regexp_replace(n, '([.!?]) +', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) AS n_sentences,
       len(regexp_replace(lower(text), '[^a-z0-9#+]', '', 'g')) AS n_compact,
       trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')) AS title_key,
       CASE WHEN len(tokens) = 0 THEN NULL WHEN len(tokens[1]) <= 3 THEN tokens[1] ELSE regexp_replace(tokens[1], '(ing|edly|ed|ly|es|s)$', '') END AS first_stem,
       CAST(len(tokens) + greatest(len(tokens) - 1, 0) + greatest(len(tokens) - 2, 0) AS BIGINT) AS n_grams,
       CASE WHEN len(tokens) >= 3 THEN tokens[-3] || ' ' || tokens[-2] || ' ' || tokens[-1] ELSE array_to_string(tokens, ' ') END AS last_gram,
       len(list_distinct(list_filter(stems, lambda w: len(w) >= 2))) AS n_words
FROM k
"""


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select("p_partkey", text.hash32("p_name").alias("hash32"), text.fingerprint("p_name").alias("fingerprint"), text.word_to_number(F.col("p_size").cast("string")).alias("size"))


HASHES = r"""
WITH h AS (SELECT p_partkey, p_size, list_reduce(list_prepend(CAST(2166136261 AS UBIGINT), list_transform(range(1, len(p_name) + 1), lambda i: CAST(ascii(p_name[i]) AS UBIGINT))),
           lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS v FROM part)
SELECT p_partkey, CAST(v AS BIGINT) AS hash32, lower(to_hex(CAST(v AS BIGINT))) AS fingerprint, CAST(p_size AS INTEGER) AS size FROM h
"""


# --- dictionary ---------------------------------------------------------------------------------------------------


def alias_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(dictionary.mention_weights("text", WORDS)).alias("m")).select("doc_id", F.col("m.key").alias("skill"), F.col("m.hits").cast("bigint").alias("hits"), F.col("m.weight").alias("weight"))


def _aliases(own_key: bool = True) -> str:
    rows = []
    for k, s in enumerate(WORDS):
        factor = dictionary.CATEGORY_FACTORS.get(s.category, 1.0)
        for a in dict.fromkeys(((s.key, *s.aliases) if own_key else s.aliases)):
            rows.append(f"({k}, {_q(s.key)}, {_q(a)}, {s.weight}::DOUBLE, {factor}::DOUBLE)")
    return f"a(ord, skill, alias, weight, factor) AS (VALUES {', '.join(rows)})"


SQL_HITS = rf"h AS (SELECT doc_id, ord, skill, CAST(sum(len(regexp_extract_all(lower(text), '\b' || alias || '\b'))) AS BIGINT) AS hits, any_value(weight) AS weight, any_value(factor) AS factor FROM documents, a GROUP BY doc_id, ord, skill HAVING hits > 0)"
ALIAS_HITS = f"""
WITH {_aliases()}, {SQL_HITS}
SELECT doc_id, skill, hits, floor((0.75 + least(2.4::DOUBLE, hits * 0.42::DOUBLE)) * weight * factor * 1000 + 0.5::DOUBLE) / 1000 AS weight FROM h
"""


def sentence_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents").withColumn("s", text.sentences("text"))
    return d.select("doc_id", F.array_join(dictionary.skills_in_sentences("s", WORDS), ",").alias("skills"))


SENTENCE_SKILLS = rf"""
WITH {_aliases(False)}, h AS (SELECT DISTINCT doc_id, ord, skill FROM documents, a WHERE regexp_matches(lower({SQL_NORMAL.format("text")}), '\b' || alias || '\b'))
SELECT doc_id, coalesce(string_agg(skill, ',' ORDER BY ord), '') AS skills FROM documents LEFT JOIN h USING (doc_id) GROUP BY doc_id
"""


def skill_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: documents scored by the skills that their texts name, with viability, advice and rank."""
    own = F.array(*map(F.lit, OWNED))
    none = F.array().cast("array<string>")
    d = _read(spark, sf_dir, "documents").select("doc_id", "text")
    # weights as a column of their own are worked out once for a row
    d = d.withColumn("weights", scoring.posting_weights(none, none, "text", WORDS))
    d = d.withColumn("skill_match", scoring.skill_match(own, none, none, "text", skills=WORDS, weights=F.col("weights")))
    d = d.withColumn("v", scoring.viability("skill_match", F.lit(60), F.lit(50)))
    rec = scoring.recommend(F.col("v.score"), {"high_skill_match": F.col("skill_match") >= 70, "low_skill_match": F.col("skill_match") < 45})
    return d.select("doc_id", "skill_match", F.col("v.score").alias("viability"), rec.alias("r")).select("doc_id", "skill_match", "viability", F.col("r.label").alias("label"), F.array_join("r.reasons", " ").alias("reasons"))


_LABEL = "CASE " + " ".join(f"WHEN {{0}} >= {n} THEN {_q(x)}" for n, x in scoring.LABELS) + f" ELSE {_q(scoring.LAST_LABEL)} END"
_MATCH = f"""w AS (SELECT doc_id, skill, least(2.2::DOUBLE, floor((0.75 + least(2.4::DOUBLE, hits * 0.42::DOUBLE)) * weight * factor * 1000 + 0.5::DOUBLE) / 1000) AS w FROM h),
m AS (SELECT doc_id, CAST(greatest(0, least(100, floor(sum(CASE WHEN skill IN ({", ".join(map(_q, OWNED))}) THEN w ELSE 0 END) / sum(w) * 100 + 0.5))) AS INTEGER) AS skill_match FROM w GROUP BY doc_id),
o AS (SELECT doc_id, coalesce(skill_match, 8 * ({" + ".join(f"CAST(contains(lower(text), {_q(s)}) AS INTEGER)" for s in OWNED)})) AS skill_match FROM documents LEFT JOIN m USING (doc_id)),
v AS (SELECT doc_id, skill_match, CAST(floor(skill_match * 0.5::DOUBLE + 60 * 0.25::DOUBLE + 50 * 0.15::DOUBLE + 0.5) AS INTEGER) AS viability FROM o)"""
SKILL_MATCH = f"""
WITH {_aliases()}, {SQL_HITS}, {_MATCH}
SELECT doc_id, skill_match, viability, {_LABEL.format("viability")} AS label,
       array_to_string(list_slice(list_filter([CASE WHEN skill_match >= 70 THEN {_q(scoring.REASONS["high_skill_match"])} END, CASE WHEN skill_match < 45 THEN {_q(scoring.REASONS["low_skill_match"])} END,
         CASE WHEN viability >= 70 THEN {_q(scoring.FAVORABLE)} END, CASE WHEN viability < 50 THEN {_q(scoring.RISKY)} END], lambda x: x IS NOT NULL), 1, 2), ' ') AS reasons
FROM v
"""


def profile_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings(spark, sf_dir)
    return p.select("row_index", F.array_join(dictionary.profile_fields("text"), ",").alias("profile_fields"), F.array_join(dictionary.posting_fields("text"), ",").alias("posting_fields"), dictionary.faculty("title").alias("faculty"))


def _cases(table: dict[str, str], test: str, what: str = "f") -> str:
    return f"array_to_string(list_filter([{', '.join(f'CASE WHEN {test.format(v)} THEN {_q(k)} END' for k, v in table.items())}], lambda {what}: {what} IS NOT NULL), ',')"


PROFILE_FIELDS = f"""
WITH p AS (SELECT doc_id AS row_index, lower({SQL_BODY}) AS s, {_sql_pick(TITLES)} AS title FROM documents)
SELECT row_index, {_cases({k: " OR ".join(f"contains(s, {_q(a)})" for a in v) for k, v in dictionary.FIELD_ALIASES.items()}, "{}")} AS profile_fields,
       {_cases(dictionary.FIELD_PATTERNS, "regexp_matches(s, '{}')")} AS posting_fields,
       CASE {" ".join(f"WHEN regexp_matches(lower(title), '{p}') THEN '{n}'" for n, p in dictionary.FACULTIES.items())} ELSE 'Engineering' END AS faculty
FROM p
"""


# --- postings -----------------------------------------------------------------------------------------------------

_S = r"\s*[- ]?month(?:s)?"
_SIDE = {
    "four": dict(m=rf"(?:^|[^0-9])4{_S}\b|four{_S}\b|(?:^|[^0-9])1\s*work\s*terms?\b|one\s*work\s*terms?\b", e="(?:4|four)", p="", r="", a=""),
    "eight": dict(m=rf"(?:^|[^0-9])8{_S}\b|eight{_S}\b|(?:^|[^0-9])2\s*work\s*terms?\b|two\s*work\s*terms?\b", e="(?:8|eight)", p=r"|two\s*work\s*terms?\s*preferred", r=r"|two\s*work\s*terms?\s*(?:required|mandatory)", a=r"|open\s+to\s+two\s*work\s*terms?"),
}


def _flags(side: str) -> str:
    x = _SIDE[side]
    e = x["e"] + _S
    forms = {
        "mention": x["m"],
        "preferred": rf"{e}\s*(?:preferred|preferable|ideally)|prefer(?:red)?\s*(?:an?\s*)?{e}{x['p']}",
        "required": rf"{e}\s*(?:required|mandatory|only)|must\s*(?:be|do)?\s*(?:an?\s*)?{e}|requires?\s*(?:an?\s*)?{e}{x['r']}",
        "accepted": rf"{e}\s*(?:accepted|considered|possible|available|option|okay|ok)|open\s+to\s+{e}{x['a']}",
    }
    return ", ".join(f"regexp_matches(s, {_q(p)}) AS {side}_{k}" for k, p in forms.items())


_BOTH = rf"(?:4|four){_S}\s*(?:or|/|and|&)\s*(?:8|eight){_S}|(?:8|eight){_S}\s*(?:or|/|and|&)\s*(?:4|four){_S}"


def term_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings(spark, sf_dir).withColumn("t", posting.term_signals(F.lower(text.normalize("text"))))
    t = F.col("t")
    four, eight = (eligibility.term_eligibility(F.struct(t["four_month_mention"].alias("four_month_mention"), *(t[n].alias(n) for n in ("eight_month_mention", "four_month_preferred", "eight_month_preferred", "four_month_required", "eight_month_required", "accepts_four", "accepts_eight")), F.lit(None).cast("int").alias("work_term_length")), x)["eligible"] for x in ("4", "8"))
    return p.select("row_index", *(t[n].alias(n) for n in ("four_month_mention", "eight_month_mention", "four_month_preferred", "eight_month_preferred", "four_month_required", "eight_month_required", "accepts_four", "accepts_eight")), four.alias("suits_four"), eight.alias("suits_eight"))


TERM_SIGNALS = f"""
WITH p AS (SELECT doc_id AS row_index, lower({SQL_NORMAL.format(SQL_BODY)}) AS s FROM documents),
f AS (SELECT row_index, {_flags("four")}, {_flags("eight")}, regexp_matches(s, {_q(_BOTH)}) AS both_ FROM p),
g AS (SELECT *, CASE WHEN both_ OR four_accepted OR (four_required AND NOT eight_accepted) THEN true WHEN eight_required AND NOT four_accepted THEN false WHEN four_mention OR four_preferred THEN true END AS accepts_four,
             CASE WHEN both_ OR eight_accepted THEN true WHEN four_required AND NOT eight_accepted THEN false WHEN eight_required OR eight_mention OR eight_preferred THEN true END AS accepts_eight FROM f)
SELECT row_index, four_mention AS four_month_mention, eight_mention AS eight_month_mention, four_preferred AS four_month_preferred, eight_preferred AS eight_month_preferred,
       four_required AS four_month_required, eight_required AS eight_month_required, accepts_four, accepts_eight,
       NOT (eight_mention OR eight_preferred OR eight_required OR coalesce(accepts_eight, false)) AS suits_four,
       NOT (four_mention OR four_preferred OR four_required OR coalesce(accepts_four, false)) AND (eight_mention OR eight_preferred OR eight_required OR coalesce(accepts_eight, false)) AS suits_eight
FROM g
"""


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posting.parse(postings(spark, sf_dir), skills=WORDS)
    c = F.col("constraints")
    many = lambda x: F.array_join(x.cast("array<string>"), "|")
    return p.select(
        "row_index", many(F.col("required_skills")).alias("required_skills"), many(F.col("preferred_skills")).alias("preferred_skills"), F.col("meta.required").alias("n_required"),
        F.col("meta.preferred").alias("n_preferred"), F.size("summary_bullets").alias("n_bullets"), c["cover_letter_required"].alias("cover_required"), c["cover_letter_recommended"].alias("cover_recommended"),
        c["transcript_required"].alias("transcript"), c["gpa_requirement"].alias("gpa"), c["first_year_completion"].alias("first_year"), c["masters_required"].alias("masters"), c["graduate_only"].alias("graduate"),
        c["term_restriction"].alias("restriction"), many(c["required_degree_fields"]).alias("required_fields"), many(c["preferred_degree_fields"]).alias("preferred_fields"),
    )


def _sentence_any(words: list[str]) -> str:
    return " OR ".join(f"contains(lower(x), {_q(w)})" for w in words)


_SQL_SOFT = posting.SOFT_CUE
_ALIAS_ANY = " OR ".join(rf"regexp_matches(lower(x), '\b{a}\b')" for s in WORDS for a in s.aliases)
_SKILLS_OF = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(rf"regexp_matches(lower(array_to_string({{0}}, chr(10))), '\b{a}\b')" for a in s.aliases) + f" THEN {_q(s.key)} END" for s in WORDS) + "], lambda z: z IS NOT NULL)"


def _in_order(xs: str) -> str:
    """The distinct values of a list, the first of each in its place."""
    return f"list_filter({xs}, lambda x, i: list_position({xs}, x) = i)"


_DEGREE = f"list_filter(sents, lambda x: regexp_matches(lower(x), {_q(posting.DEGREE)}))"
_MUST = f"(regexp_matches(lower(x), {_q(posting.DEGREE_REQUIRED)}) OR regexp_matches(lower(x), {_q(posting.DEGREE_FOCUS)})) AND NOT regexp_matches(lower(x), {_q(posting.DEGREE_PREFERRED)})"


def _fields_of(must: bool) -> str:
    test = f"({_MUST})" if must else f"NOT ({_MUST})"
    each = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(x), {_q(p)}) THEN {_q(k)} END" for k, p in dictionary.FIELD_PATTERNS.items()) + "], lambda z: z IS NOT NULL)"
    return f"flatten(list_transform(list_filter(deg, lambda x: {test}), lambda x: {each}))"


_PARSE = f"""q AS (SELECT row_index, s, lower(s) AS low, string_split(regexp_replace(s, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)) AS sents FROM p),
r AS (SELECT *, list_filter(sents, lambda x: {_sentence_any(posting.REQUIRED_WORDS)} OR (regexp_matches(lower(x), {_q(posting.HARD_CUE)}) AND ({_ALIAS_ANY}))) AS req,
             list_filter(sents, lambda x: {_sentence_any(posting.PREFERRED_WORDS)} OR (regexp_matches(lower(x), {_q(_SQL_SOFT)}) AND ({_ALIAS_ANY}))) AS pre,
             list_filter(sents, lambda x: {_sentence_any(posting.SUMMARY_WORDS)}) AS sums, {_DEGREE} AS deg FROM q),
t AS (SELECT *, list_filter(pre, lambda x: NOT list_contains(req, x)) AS pref FROM r),
u AS (SELECT *, {_SKILLS_OF.format("req")} AS rs, {_SKILLS_OF.format("pref")} AS ps, {_fields_of(True)} AS rf, {_fields_of(False)} AS pf FROM t)"""
_PARSED_ROWS = f"""SELECT row_index, array_to_string(rs, '|') AS required_skills, array_to_string(list_filter(ps, lambda z: NOT list_contains(rs, z)), '|') AS preferred_skills,
       CAST(len(list_distinct(req)) AS INTEGER) AS n_required, CAST(len(list_distinct(pref)) AS INTEGER) AS n_preferred, CAST(least(8, len(list_distinct(sums))) AS INTEGER) AS n_bullets,
       regexp_matches(low, {_q(posting.COVER_REQUIRED)}) AS cover_required, regexp_matches(low, {_q(posting.COVER_RECOMMENDED)}) AS cover_recommended, regexp_matches(low, {_q(posting.TRANSCRIPT)}) AS transcript,
       nullif(trim(regexp_extract(s, {_q("(?i)" + posting.GPA)})), '') AS gpa, regexp_matches(low, {_q(posting.FIRST_YEAR)}) AS first_year, regexp_matches(low, {_q(posting.MASTERS)}) AS masters,
       regexp_matches(low, {_q(posting.GRADUATE)}) AS graduate, nullif(trim(regexp_extract(s, {_q("(?i)" + posting.TERM_RESTRICTION)})), '') AS restriction,
       array_to_string({_in_order("rf")}, '|') AS required_fields, array_to_string(list_filter({_in_order("pf")}, lambda z: NOT list_contains(rf, z)), '|') AS preferred_fields
FROM u"""
PARSED = f"WITH p AS (SELECT doc_id AS row_index, {SQL_NORMAL.format(SQL_BODY)} AS s FROM documents), {_PARSE} {_PARSED_ROWS}"



def hard_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings(spark, sf_dir).withColumn("e", posting.eligibility(text.sentences("text")))
    e = F.col("e")
    return p.select("row_index", e["min_work_term"].alias("min_work_term"), F.array_join(e["allowed_work_terms"].cast("array<string>"), ",").alias("allowed"), e["min_academic_year"].alias("min_year"), F.size(e["eligibility_lines"]).alias("n_lines"))


_NUM = " ".join(f"WHEN '{w}' THEN {n}" for w, n in text.NUMBERS.items())


def _sql_numbers(pattern: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(low, {_q(pattern)}, 1), lambda w: CASE w {_NUM} ELSE TRY_CAST(regexp_replace(w, '(st|nd|rd|th)$', '') AS INTEGER) END), lambda n: n IS NOT NULL)"


HARD_ELIGIBILITY = f"""
WITH p AS (SELECT doc_id, {SQL_NORMAL.format(SQL_BODY)} AS s FROM documents),
q AS (SELECT doc_id, unnest(string_split(regexp_replace(s, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1))) AS line FROM p),
r AS (SELECT doc_id, line, lower(line) AS low FROM q),
t AS (SELECT *, regexp_matches(low, {_q(posting.HARD_ELIGIBILITY)}) AS hard, regexp_matches(low, {_q(posting.SOFT_ELIGIBILITY)}) AS soft, regexp_matches(low, {_q(posting.RANGE_ELIGIBILITY)}) AS least_,
             {_sql_numbers(posting.WORK_TERM)} AS terms, {_sql_numbers(posting.YEAR)} AS years, regexp_matches(low, '\\bupper[- ]?year\\b') AS upper_ FROM r),
u AS (SELECT *, len(terms) > 0 AND least_ AS is_min, len(terms) > 0 AND NOT least_ AND regexp_matches(low, '\\bonly\\b|\\beligible\\b') AS is_only,
             greatest(list_max(years), CASE WHEN upper_ THEN 3 END) AS year FROM t WHERE NOT (soft AND NOT hard) AND (hard OR least_)),
g AS (SELECT doc_id, max(CASE WHEN is_min THEN list_min(terms) END) AS min_work_term, max(year) AS min_year, flatten(list(CASE WHEN is_only THEN terms ELSE [] END)) AS allowed,
             count(DISTINCT line) FILTER (is_min OR is_only OR year IS NOT NULL) AS n FROM u GROUP BY doc_id)
SELECT d.doc_id AS row_index, min_work_term, coalesce(array_to_string(list_sort(list_distinct(allowed)), ','), '') AS allowed, min_year, CAST(least(6, coalesce(n, 0)) AS INTEGER) AS n_lines
FROM documents d LEFT JOIN g USING (doc_id)
"""


def role_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = postings(spark, sf_dir)
    body = F.concat_ws(" ", "title", "text")
    return p.select(
        "row_index", scoring.role_match("title", body, F.lit(ME.target_role)).alias("role_match"), scoring.role_preference("title", F.lit("software developer")).alias("role_boost"),
        scoring.industry_preference("text", F.array(*map(F.lit, ME.industries))).alias("industry_boost"), ranking.fit_class(F.pmod(F.col("row_index"), F.lit(101))).alias("fit"),
    )


def _role(role: str) -> str:
    words = [w for w in role.replace(",", " ").split() if len(w) >= 3]
    n = len(words)
    t, b = (" + ".join(f"CAST(contains({c}, {_q(w)}) AS INTEGER)" for w in words) for c in ("t", "b"))
    tech = any(x in role for x in ("software", "developer", "data"))
    minus = f" - CASE WHEN regexp_matches(t, {_q(scoring.BUSINESS_TITLE)}) THEN 38 ELSE 0 END" if tech else ""
    return f"(CASE WHEN contains(t, {_q(role)}) THEN 95 WHEN {t} = {n} THEN 78 WHEN contains(b, {_q(role)}) THEN 68 ELSE floor(greatest({t}, {b}) / CAST({n} AS DOUBLE) * 62 + 0.5) END{minus})"


ROLE_SCORES = f"""
WITH p AS (SELECT doc_id AS row_index, lower({_sql_pick(TITLES)}) AS t, lower({_sql_pick(TITLES)} || ' ' || {SQL_BODY}) AS b, lower({SQL_BODY}) AS x FROM documents)
SELECT row_index, CAST(greatest(0, least(100, greatest({_role("software developer")}, {_role("data analyst")}))) AS INTEGER) AS role_match, CASE WHEN contains(t, 'software developer') THEN 12 ELSE 0 END AS role_boost,
       least(16, 4 * ({" + ".join(f"CAST(contains(x, {_q(i)}) AS INTEGER)" for i in ME.industries)})) AS industry_boost,
       CASE WHEN row_index % 101 >= 72 THEN 'good' WHEN row_index % 101 >= 42 THEN 'warn' ELSE 'bad' END AS fit
FROM p
"""


#: What is kept of an analysis: what is read of a text, not the text.
ANALYSED = ["row_index", "title", "company", "location", "required_skills", "preferred_skills", "summary_bullets", "constraints", "base_skill_match", "keyword_skill_match", "skill_match", "target_role_match", "viability", "overall_match", "ranking_score", "recommendation", "hard", "hard_reasons", "flags"]


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All postings analysed from their whole texts and stored: ranking and filtering read a narrow table."""
    return stored(ranking.analyze(postings(spark, sf_dir), ME, "text", WORDS).select(*ANALYSED), "analysis")


def ranked_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main query: all postings analysed, those that suit the person ranked."""
    a = ranking.eligible(analysis(spark, sf_dir), ME)
    return a.select("row_index", "skill_match", "base_skill_match", "keyword_skill_match", "target_role_match", F.col("viability.score").alias("viability"), "overall_match", F.round("ranking_score", 6).alias("ranking_score"), F.col("recommendation.label").alias("label"), F.size("flags").alias("n_flags"))


# --- queries over scores: a table of made-up entries with the columns that analyses have ---------------------------


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    keys = F.array(*(F.lit(s.key) for s in WORDS))
    return d.select(
        i.alias("row_index"), F.coalesce("text", F.lit("")).alias("full_text"), _picked([TITLES], "doc_id")[0].alias("title"), F.col("source").alias("company"),
        F.pmod(i * 37, F.lit(101)).cast("int").alias("overall_match"), F.pmod(i * 13, F.lit(101)).cast("int").alias("skill_match"), F.pmod(i * 7, F.lit(101)).cast("int").alias("target_role_match"),
        (F.pmod(i * 53, F.lit(1009)) / 10.0).alias("ranking_score"), F.struct(F.pmod(i * 11, F.lit(101)).cast("int").alias("score")).alias("viability"), (F.pmod(i, F.lit(17)) == 0).alias("hard"),
        F.slice(keys, (F.pmod(i, F.lit(4)) + 1).cast("int"), (F.pmod(i, F.lit(3)) + 1).cast("int")).alias("required_skills"), F.array().cast("array<string>").alias("preferred_skills"),
        F.array(F.concat(F.lit("flag "), F.pmod(i, F.lit(11)).cast("string")), F.concat(F.lit("flag "), F.pmod(i, F.lit(5)).cast("string"))).alias("flags"),
    )


_KEYS = "[" + ", ".join(_q(s.key) for s in WORDS) + "]"
ENTRIES = f"""e AS (SELECT doc_id AS row_index, coalesce(text, '') AS full_text, {_sql_pick(TITLES)} AS title, source AS company, CAST(doc_id * 37 % 101 AS INTEGER) AS overall_match, CAST(doc_id * 13 % 101 AS INTEGER) AS skill_match,
  CAST(doc_id * 7 % 101 AS INTEGER) AS target_role_match, (doc_id * 53 % 1009) / 10.0 AS ranking_score, CAST(doc_id * 11 % 101 AS INTEGER) AS viability, doc_id % 17 = 0 AS hard,
  list_slice({_KEYS}, doc_id % 4 + 1, doc_id % 4 + doc_id % 3 + 1) AS required_skills, ['flag ' || doc_id % 11, 'flag ' || doc_id % 5] AS flags FROM documents)"""


def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_of_tiers(entries(spark, sf_dir)).select("tier", "place", "row_index", "overall_match", "ranking_score")


TIERS = f"""
WITH {ENTRIES}, t AS (SELECT *, CASE WHEN overall_match >= 68 THEN 'Apply Now' WHEN overall_match >= 42 THEN 'Worth Applying' ELSE 'Low Priority' END AS tier FROM e WHERE NOT hard),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY tier ORDER BY ranking_score DESC, row_index) AS INTEGER) AS place FROM t)
SELECT tier, place, row_index, overall_match, ranking_score FROM r WHERE place <= CASE tier WHEN 'Low Priority' THEN 5 ELSE 10 END
"""


def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.overview(entries(spark, sf_dir))


OVERVIEW = f"""
WITH {ENTRIES} SELECT count(*) FILTER (overall_match >= 72) AS strong, count(*) FILTER (overall_match BETWEEN 45 AND 71) AS decent, count(*) FILTER (overall_match < 45) AS weak,
 count(*) FILTER (NOT hard AND overall_match >= 68) AS strong_fit, count(*) FILTER (NOT hard AND overall_match < 68) AS other, count(*) FILTER (hard) AS blocked FROM e
"""


def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.key_insights(entries(spark, sf_dir), OWNED)


INSIGHTS = f"""
WITH {ENTRIES}, x AS (SELECT row_index, unnest(required_skills) AS skill, generate_subscripts(required_skills, 1) AS pos FROM e),
c AS (SELECT skill, count(*) AS n, min(row_index * 100 + pos) AS first, skill IN ({", ".join(map(_q, OWNED))}) AS owned FROM x GROUP BY skill),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY owned ORDER BY n DESC, first) AS INTEGER) AS place FROM c)
SELECT owned, place, skill, n FROM r WHERE place <= 5
"""


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.flag_counts(entries(spark, sf_dir))


FLAGS = f"WITH {ENTRIES} SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM e) GROUP BY flag ORDER BY n DESC, flag LIMIT 8"


def reconsidered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.reconsider(entries(spark, sf_dir)).select("row_index", "overall_match", "target_role_match", "ranking_score")


RECONSIDERED = f"WITH {ENTRIES} SELECT row_index, overall_match, target_role_match, ranking_score FROM e WHERE overall_match >= 30 AND overall_match < 50 AND target_role_match >= 50 ORDER BY ranking_score DESC, row_index LIMIT 3"


def top_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(entries(spark, sf_dir), 5).select("row_index", "ranking_score")


TOP_MATCHES = f"WITH {ENTRIES} SELECT row_index, ranking_score FROM e ORDER BY ranking_score DESC, row_index LIMIT 5"


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ranking.skill_gap(entries(spark, sf_dir), OWNED).withColumn("hard_reasons", F.array().cast("array<string>"))
    e = ranking.insight(e, OWNED)
    return e.select("row_index", F.array_join("matched", ",").alias("matched"), F.array_join("missing", ",").alias("missing"), "matched_share", F.col("insight.text").alias("insight"), F.col("insight.tone").alias("tone"))


_OWN = "[" + ", ".join(map(_q, OWNED)) + "]"
GAPS = f"""
WITH {ENTRIES}, g AS (SELECT *, list_filter(required_skills, lambda x: list_contains({_OWN}, x)) AS hit, list_filter(required_skills, lambda x: NOT list_contains({_OWN}, x)) AS miss FROM e),
h AS (SELECT *, array_to_string(list_slice(miss, 1, 3), ', ') AS three FROM g)
SELECT row_index, array_to_string(hit, ',') AS matched, array_to_string(miss, ',') AS missing, len(hit) || '/' || len(required_skills) AS matched_share,
 CASE WHEN hard THEN 'Hard eligibility block' WHEN overall_match >= 72 AND len(miss) = 0 THEN 'Strong match — apply now' WHEN overall_match >= 72 THEN 'Good fit, missing: ' || three
      WHEN len(miss) BETWEEN 1 AND 3 THEN 'Missing: ' || array_to_string(miss, ', ') WHEN len(miss) > 3 THEN 'Missing ' || len(miss) || ' skills: ' || three || '...'
      WHEN len(hit) > 0 THEN 'Strong in: ' || array_to_string(list_slice(hit, 1, 3), ', ') WHEN overall_match >= 50 THEN 'Decent match — worth exploring' ELSE 'Weak match — consider as a reach' END AS insight,
 CASE WHEN hard THEN 'danger' WHEN overall_match >= 72 THEN 'good' WHEN len(miss) > 0 THEN 'warn' WHEN len(hit) > 0 THEN 'good' WHEN overall_match >= 50 THEN '' ELSE 'danger' END AS tone
FROM h
"""

QUERY = 'marketing "software developer" threa'


def smart_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.scored(entries(spark, sf_dir), QUERY, WORDS).select("row_index", "smart_score", "hits", "title_hits", "required_hits")


def _search_sql() -> str:
    q = search.expand(QUERY, WORDS)
    words = [w for w in map(search.word, q.tokens) if w]
    ph = [f"struct_pack(raw := CASE WHEN contains(t, {_q(p)}) THEN 30 WHEN contains(c, {_q(p)}) THEN 14 ELSE 0 END, hits := CASE WHEN contains(t, {_q(p)}) THEN 2 WHEN contains(c, {_q(p)}) THEN 1 ELSE 0 END, th := CAST(contains(t, {_q(p)}) AS INTEGER), rh := 0)" for p in q.phrases]
    tk = []
    for w in words:
        title, req, full = f"CAST(contains(t, {_q(w)}) OR list_contains(tw, {_q(w)}) AS INTEGER)", f"CAST(list_contains(rw, {_q(w)}) AS INTEGER)", f"(contains(c, {_q(w)}) OR list_contains(cw, {_q(w)}))"
        only = f"CAST({title} + {req} = 0 AND {full} AS INTEGER)"
        tk.append(f"struct_pack(raw := 11 * {title} + 9 * {req} + 5 * {only}, hits := {title} + {req} + {only}, th := {title}, rh := {req})")
    stems = r"list_filter(list_transform(list_filter(string_split_regex({0}, '[^a-z0-9#+.\-/]+'), lambda x: x <> ''), lambda w: CASE WHEN len(w) <= 3 THEN w ELSE regexp_replace(w, '(ing|edly|ed|ly|es|s)$', '') END), lambda w: len(w) >= 2)"
    return f"""
WITH {ENTRIES}, i AS (SELECT *, lower(title) AS t, lower(title || ' ' || company || '   ' || array_to_string(required_skills, ' ') || '  ' || left(full_text, 5000)) AS c, array_to_string(required_skills, ' ') AS r FROM e),
j AS (SELECT *, {stems.format("t")} AS tw, {stems.format("c")} AS cw, {stems.format("r")} AS rw FROM i),
k AS (SELECT row_index, ranking_score, skill_match, viability, [{", ".join([*ph, *tk])}] AS got FROM j),
m AS (SELECT row_index, ranking_score, skill_match * 0.42 + viability * 0.28 + ranking_score * 0.18 AS base, list_sum(list_transform(got, lambda g: g.raw)) AS raw, list_sum(list_transform(got, lambda g: g.hits)) AS hits,
             list_sum(list_transform(got, lambda g: g.th)) AS title_hits, list_sum(list_transform(got, lambda g: g.rh)) AS required_hits FROM k),
n AS (SELECT *, base + raw - CASE WHEN hits = 0 THEN 90 ELSE 0 END AS total FROM m)
SELECT row_index, CAST(floor((total - min(total) OVER ()) / (max(total) OVER () - min(total) OVER ()) * 100 + 0.5) AS INTEGER) AS smart_score, CAST(hits AS INTEGER) AS hits, CAST(title_hits AS INTEGER) AS title_hits, CAST(required_hits AS INTEGER) AS required_hits FROM n
"""


# --- vectors, hiring history --------------------------------------------------------------------------------------


def vector_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector and the first one of its label."""
    e = _read(spark, sf_dir, "embeddings")
    # stored, so that its size is known when the join is planned: a small one is broadcast and labels aren't shuffled
    first = stored(e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("center")), "centers")
    return e.join(first, "label").select("vec_id", F.round(scoring.cosine("embedding", "center"), 5).alias("cosine"), scoring.similarity_percent(F.round(scoring.cosine("embedding", "center"), 5)).alias("percent"))


VECTOR_SIMILARITY = """
WITH f AS (SELECT label, arg_min(embedding, vec_id) AS center FROM embeddings GROUP BY label),
c AS (SELECT vec_id, round(greatest(-1, least(1, list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(center[i] AS DOUBLE))))), 5) AS cosine FROM embeddings JOIN f USING (label))
SELECT vec_id, cosine, CAST(CASE WHEN cosine <= 0 THEN floor((cosine + 1) * 18 + 0.5) ELSE floor(18 + cosine * 82 + 0.5) END AS INTEGER) AS percent FROM c
"""


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of types among each user's events, as percents."""
    e = _read(spark, sf_dir, "events")
    n = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    total = n.groupBy("user_id").agg(F.sum("n").alias("t"))
    kinds = F.create_map(*(F.lit(x) for k, v in enumerate(_TYPES, 1) for x in (v, k)))
    label = F.concat(F.lit("Term "), F.coalesce(kinds[F.col("event_type")], F.lit(9)).cast("string"), F.lit(" "), F.col("event_type"))
    return n.join(total, "user_id").select("user_id", label.alias("label"), (F.col("n") * 100.0 / F.col("t")).alias("percent"), F.coalesce(kinds[F.col("event_type")], F.lit(9)).alias("pos"))


_TYPES = ["click", "view", "purchase", "signup", "error"]


def share_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    dist = ratings.distribution(_shares(spark, sf_dir), ["user_id"])
    term = F.pmod(F.col("user_id"), F.lit(6)).cast("int") + 1
    scores = dist.select("user_id", "dist", scoring.term_compatibility(term, "dist").alias("term_score"), scoring.faculty_alignment(F.lit("view"), "dist").alias("faculty_score"))
    return scores.select("user_id", "term_score", "faculty_score", F.size("dist").cast("bigint").alias("n_labels"), F.round(ratings.faculty_share(F.lit("view"), "dist"), 6).alias("share"), ratings.describe_term("term_score").alias("term_says"), ratings.describe_faculty("faculty_score").alias("faculty_says"))


_KIND = "CASE event_type " + " ".join(f"WHEN '{t}' THEN {k}" for k, t in enumerate(_TYPES, 1)) + " ELSE 9 END"
SHARE_SCORES = f"""
WITH n AS (SELECT user_id, event_type, {_KIND} AS k, count(*) AS n FROM events GROUP BY user_id, event_type),
s AS (SELECT user_id, event_type, k, n * 100.0 / sum(n) OVER (PARTITION BY user_id) AS p FROM n),
g AS (SELECT user_id, max(p) AS top, max(CASE WHEN k = user_id % 6 + 1 THEN p END) AS mine, max(CASE WHEN contains(lower('term ' || k || ' ' || event_type), 'view') THEN p END) AS fac, count(*) AS n_labels FROM s GROUP BY user_id),
r AS (SELECT user_id, n_labels, round(coalesce(fac, 0), 6) AS share, CAST(CASE WHEN coalesce(mine, 0) <= 0 THEN 15 ELSE least(100, floor(30 + mine * 1.8 + mine / top * 20 + 0.5)) END AS INTEGER) AS term_score,
             CAST(CASE WHEN coalesce(fac, 0) <= 0 THEN 25 ELSE least(100, floor(35 + fac * 1.2 + fac / top * 25 + 0.5)) END AS INTEGER) AS faculty_score FROM g)
SELECT user_id, term_score, faculty_score, n_labels, share,
 CASE WHEN term_score <= 25 THEN 'Extremely Competitive for Your Work Term' WHEN term_score <= 55 THEN 'Competitive but Possible' ELSE 'Strong Historical Alignment' END AS term_says,
 CASE WHEN faculty_score <= 35 THEN 'Weak Faculty Alignment' WHEN faculty_score <= 65 THEN 'Moderate Faculty Alignment' ELSE 'Strong Faculty Alignment' END AS faculty_says
FROM r
"""


def hiring_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each clerk's nation by quarter, read as hires by term."""
    o = _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    q = o.groupBy("c_nationkey", F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q")).agg(F.count("*").alias("hires"))
    season = F.element_at(F.array(*map(F.lit, ["Winter", "Spring", "Summer", "Fall"])), F.col("q"))
    w = W.partitionBy("c_nationkey").orderBy("y", "q")  # a nation has a row for each quarter
    rows = q.select("c_nationkey", F.concat(season, F.lit(" "), F.col("y").cast("string")).alias("term"), "hires", (F.row_number().over(w) - 1).alias("seq"))
    h = ratings.hiring(rows, ["c_nationkey"])
    return h.select("c_nationkey", "n_terms", F.round("avg_hires", 6).alias("avg_hires"), F.round("slope", 6).alias("slope"), "selectivity", "trend", "season")


HIRING_HISTORY = """
WITH q AS (SELECT c_nationkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, count(*) AS hires FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
r AS (SELECT c_nationkey, hires, ['Winter', 'Spring', 'Summer', 'Fall'][q] AS s, row_number() OVER (PARTITION BY c_nationkey ORDER BY y, q) - 1 AS seq FROM q),
g AS (SELECT c_nationkey, count(*) AS n_terms, avg(hires) AS a, regr_slope(hires, seq) AS b, avg(hires) FILTER (seq < 4) AS rec, avg(hires) FILTER (seq >= 4) AS old,
             avg(hires) FILTER (s = 'Fall') AS f, avg(hires) FILTER (s = 'Winter') AS w, avg(hires) FILTER (s = 'Spring') AS p FROM r GROUP BY c_nationkey),
t AS (SELECT *, CASE WHEN n_terms >= 3 THEN coalesce(b, 0) ELSE 0 END AS slope_, coalesce(old, rec) AS old_, CAST(f IS NOT NULL AS INTEGER) + CAST(w IS NOT NULL AS INTEGER) + CAST(p IS NOT NULL AS INTEGER) AS known, greatest(f, w, p) AS top FROM g)
SELECT c_nationkey, n_terms, round(a, 6) AS avg_hires, round(slope_, 6) AS slope,
 CAST(greatest(-20, least(20, CASE WHEN a >= 20 THEN 20 WHEN a >= 12 THEN 10 WHEN a >= 6 THEN 0 WHEN a >= 3 THEN -10 ELSE -20 END + CASE WHEN slope_ > 0.7 THEN 5 WHEN slope_ < -0.7 THEN -5 ELSE 0 END)) AS INTEGER) AS selectivity,
 CASE WHEN n_terms < 3 THEN 'Insufficient trend data' WHEN rec > old_ * 1.15 THEN 'Upward hiring trend' WHEN rec < old_ * 0.85 THEN 'Downward hiring trend' ELSE 'Stable hiring trend' END AS trend,
 CASE WHEN known < 2 THEN 'Seasonal pattern unavailable' ELSE CASE WHEN f = top THEN 'Fall' WHEN w = top THEN 'Winter' ELSE 'Spring' END || ' tends to peak (' || printf('%.1f', top) || ' avg hires)' END AS season
FROM t
"""


def viability_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    v = scoring.viability(F.pmod(k, F.lit(131)), F.pmod(k * 7, F.lit(101)), F.pmod(k * 3, F.lit(101)), F.pmod(k, F.lit(61)) - 30)
    r = scoring.recommend(v["score"], {"term_share_zero": F.pmod(k, F.lit(3)) == 0, "faculty_weak": F.pmod(k, F.lit(5)) == 0, "role_mismatch": F.pmod(k, F.lit(7)) == 0}, F.pmod(k, F.lit(13)) == 0)
    b = scoring.blended(F.pmod(k, F.lit(101)), F.pmod(k * 3, F.lit(101)), F.pmod(k, F.lit(6)), F.pmod(k, F.lit(4)), F.pmod(k, F.lit(5)))
    return p.select("p_partkey", v["score"].alias("viability"), v["weighted_base"].alias("base"), r["label"].alias("label"), F.array_join(r["reasons"], " ").alias("reasons"), b.cast("int").alias("blended"))


VIABILITY_GRID = f"""
WITH k AS (SELECT p_partkey, least(100, p_partkey % 131) AS s, p_partkey * 7 % 101 AS t, p_partkey * 3 % 101 AS f, greatest(-20, least(20, p_partkey % 61 - 30)) AS x, p_partkey % 101 AS b, p_partkey * 3 % 101 AS w,
                 p_partkey % 6 AS nr, p_partkey % 4 AS np, p_partkey % 5 AS nb FROM part),
v AS (SELECT *, s * 0.5::DOUBLE + t * 0.25::DOUBLE + f * 0.15::DOUBLE AS base_ FROM k),
u AS (SELECT *, CAST(greatest(0, least(100, floor(base_ + x + 0.5))) AS INTEGER) AS viability, p_partkey % 13 = 0 AS hard FROM v),
m AS (SELECT *, greatest(CASE WHEN nr + np >= 6 OR (nr >= 4 AND nb >= 3) THEN floor(b * 0.88::DOUBLE + w * 0.12::DOUBLE + 0.5) WHEN nr + np >= 3 THEN floor(b * 0.78::DOUBLE + w * 0.22::DOUBLE + 0.5) ELSE floor(b * 0.55::DOUBLE + w * 0.45::DOUBLE + 0.5) END,
             CASE WHEN b >= 75 THEN floor(b * 0.94::DOUBLE + 0.5) WHEN b >= 60 THEN floor(b * 0.88::DOUBLE + 0.5) WHEN b >= 45 THEN floor(b * 0.82::DOUBLE + 0.5) END, CASE WHEN b <= 6 AND w > 0 THEN floor(w * 0.8::DOUBLE + 0.5) END) AS mixed FROM u)
SELECT p_partkey, viability, CAST(floor(base_ + 0.5) AS INTEGER) AS base, CASE WHEN hard THEN 'Do not apply' ELSE {_LABEL.format("viability")} END AS label,
 CASE WHEN hard THEN {_q(scoring.BLOCKED_REASON)} ELSE array_to_string(list_slice(list_filter([CASE WHEN p_partkey % 3 = 0 THEN {_q(scoring.REASONS["term_share_zero"])} END, CASE WHEN p_partkey % 5 = 0 THEN {_q(scoring.REASONS["faculty_weak"])} END,
   CASE WHEN p_partkey % 7 = 0 THEN {_q(scoring.REASONS["role_mismatch"])} END, CASE WHEN viability >= 70 THEN {_q(scoring.FAVORABLE)} END, CASE WHEN viability < 50 THEN {_q(scoring.RISKY)} END], lambda z: z IS NOT NULL), 1, 2), ' ') END AS reasons,
 CAST(greatest(0, least(100, mixed)) AS INTEGER) AS blended
FROM m
"""


# --- pages, stores, tracking --------------------------------------------------------------------------------------


def page_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "pages").select("page_id", "url")
    path = F.coalesce(F.parse_url("url", F.lit("PATH")), F.lit(""))
    kind = eligibility.page_type(F.lit(""), path, F.coalesce(F.parse_url("url", F.lit("QUERY")), F.lit("")), F.lit(""), F.pmod(F.col("page_id"), F.lit(10)).cast("int"))
    return p.select("page_id", tracker.posting_url("url").alias("url"), tracker.job_key(F.when(F.pmod("page_id", F.lit(3)) == 0, F.col("page_id").cast("string")), "url", F.lit("")).alias("job_key"), kind.alias("kind"))


PAGE_KEYS = """
WITH p AS (SELECT page_id, regexp_replace(url, '#.*', '') AS u FROM pages),
k AS (SELECT page_id, split_part(u, '?', 1) AS head, CASE WHEN contains(u, '?') THEN split_part(u, '?', 2) END AS q FROM p),
s AS (SELECT page_id, head, q, array_to_string(list_filter(string_split(coalesce(q, ''), '&'), lambda x: x <> '' AND NOT split_part(x, '=', 1) IN ('sessionId', 'conversationId')), '&') AS w FROM k),
r AS (SELECT page_id, head, coalesce(q, '') AS q, head || CASE WHEN w <> '' THEN '?' || w ELSE '' END AS url FROM s)
SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN 'jid:' || page_id ELSE 'url:' || url END AS job_key,
 CASE WHEN regexp_matches(lower(head || ' ' || q), 'jobid=|postingid=|/posting/|/job/') THEN 'posting' WHEN regexp_matches(lower(head || ' ' || q), '/jobs|/postings|search|/co-op/') THEN 'listings' WHEN page_id % 10 >= 8 THEN 'listings' ELSE 'unknown' END AS kind
FROM r
"""


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as entries of a cache by user and type: the newest of each, those that are young enough, 200 at most."""
    e = _read(spark, sf_dir, "events")
    rows = e.select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("url"), F.when(F.pmod("event_id", F.lit(9)) == 0, 3).otherwise(4).alias("version"), (F.expr(MILLIS) * 100_000 + F.col("event_id")).alias("ts"), F.col("event_id").alias("data"), F.expr(MILLIS).alias("ms"))
    merged = stores.cache_put(rows.filter("data % 2 = 0"), rows.filter("data % 2 = 1"))
    # an event's number may exceed what the order leaves room for, so its time is kept beside it
    return stores.cached(merged.withColumn("ts", F.col("ms")), 1706745600000).select("url", "ts", "data")


CACHE = """
WITH r AS (SELECT user_id || '/' || event_type AS url, CASE WHEN event_id % 9 = 0 THEN 3 ELSE 4 END AS version, (epoch_us(ts) // 1000) AS ms, (epoch_us(ts) // 1000) * 100000 + event_id AS o, event_id AS data FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY o DESC) AS k FROM r),
m AS (SELECT * FROM n WHERE k = 1 ORDER BY o DESC, url LIMIT 200)
SELECT url, ms AS ts, data FROM m WHERE version = 4 AND 1706745600000 - ms <= 604800000
"""


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as applications; their last turns as rows that show a status."""
    c = _read(spark, sf_dir, "conversations")
    i = F.col("conv_id")
    known = c.groupBy("conv_id").agg(F.max("turn").alias("turns")).select(
        i.cast("string").alias("id"), F.concat(F.lit("url:https://h/"), i.cast("string")).alias("job_key"), F.element_at(F.array(*map(F.lit, ["applied", "interview", "strange"])), (F.pmod(i, F.lit(3)) + 1).cast("int")).alias("status"), (F.col("turns") * 10).alias("created_at"), F.lit(5).cast("bigint").alias("updated_at")
    )
    said = F.element_at(F.array(*map(F.lit, ["Offer – interview scheduled", "Not selected", "Viewed", "An OFFER was made"])), (F.pmod(i + F.col("turn"), F.lit(4)) + 1).cast("int"))
    rows = c.select(F.concat(F.lit("https://h/"), i.cast("string"), F.lit("#x")).alias("url"), said.alias("text"), F.col("turn").alias("pos"))
    return tracker.reconcile(rows, stores.application(known)).select("application_id", "was", "status")


APPLICATIONS = """
WITH k AS (SELECT DISTINCT conv_id, CASE conv_id % 3 WHEN 0 THEN 'applied' WHEN 1 THEN 'interview' ELSE 'unknown' END AS was FROM conversations),
f AS (SELECT conv_id, arg_min((conv_id + turn) % 4, turn) AS r FROM conversations GROUP BY conv_id),
s AS (SELECT conv_id, CASE r WHEN 0 THEN 'interview' WHEN 1 THEN 'rejected' WHEN 3 THEN 'offer' END AS status FROM f)
SELECT CAST(conv_id AS VARCHAR) AS application_id, was, status FROM s JOIN k USING (conv_id) WHERE status IS NOT NULL AND status <> was
"""


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("title"), F.lit("applied").alias("status"))
    k = F.col("id").cast("bigint")
    new = s.filter(k % 4 == 0).select("id", F.lit(None).cast("string").alias("title"), F.lit("offer").alias("status"))
    more = s.filter(k % 5 == 0).select(F.concat(F.lit("n"), "id").alias("id"), F.lit("new").alias("title"), F.lit("applied").alias("status"))
    return stores.upsert(s, new.union(more))


UPSERTED = """
SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS title, CASE WHEN s_suppkey % 4 = 0 THEN 'offer' ELSE 'applied' END AS status FROM supplier
UNION ALL SELECT 'n' || s_suppkey, 'new', 'applied' FROM supplier WHERE s_suppkey % 5 = 0
"""


def field_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = ["Company name", "E-mail", "Mobile phone", "Degree program", "Work term", "Cover letter", "Why are you interested", "Legally eligible to work", "Other"]
    c = _read(spark, sf_dir, "customer")
    d = c.select("c_custkey", _picked([labels], "c_custkey")[0].alias("label"))
    d = d.withColumn("intent", tracker.field_intent("label", F.lit(""), F.lit("")))
    v = tracker.field_value("intent", F.lit("Arts"), F.lit(""), F.lit(3), F.lit("my resume"))
    return d.select("c_custkey", "intent", v["value"].alias("value"), v["confidence"].alias("confidence"))


FIELD_INTENTS = """
WITH l AS (SELECT c_custkey, c_custkey % 9 AS r FROM customer)
SELECT c_custkey, ['name', 'email', 'phone', 'program', 'term', 'cover_letter_text', 'why_company', 'work_authorization', 'unknown'][r + 1] AS intent,
 ['', '', '', 'Arts — target: (set in app)', '3', '[Draft from resume — edit heavily]' || chr(10) || 'my resume', '[Draft from resume — edit heavily]' || chr(10) || 'my resume', 'Yes — edit if you need exceptions', ''][r + 1] AS value,
 CASE WHEN r IN (3, 4) THEN 'medium' ELSE 'low' END AS confidence FROM l
"""


def listing_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents").select(F.col("source").alias("url"), F.col("doc_id").cast("string").alias("job_key"), F.col("lang").alias("title"), F.lit("").alias("company"), F.lit("").alias("location"))
    return ranking.signature(d)


def resume_skill_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomrank.operators.resume import resume_skills

    return _read(spark, sf_dir, "documents").select("doc_id", F.array_join(resume_skills("text", WORDS), ",").alias("skills"))


def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomrank.operators.resume import is_resume, quality

    d = _read(spark, sf_dir, "documents")
    d = d.select("doc_id", "text", quality("text").alias("q"))
    q = F.col("q")
    return d.select("doc_id", *(q[n].cast("bigint").alias(n) for n in ("words", "letters", "digits", "slashed", "numeric", "alpha")), is_resume("text", q=q).alias("resume"))


TEXT_QUALITY = r"""
WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM documents),
q AS (SELECT doc_id, text, len(ws) AS words, len(regexp_extract_all(text, '[A-Za-z]')) AS letters, len(regexp_extract_all(text, '[0-9]')) AS digits, len(regexp_extract_all(text, '/[A-Za-z][A-Za-z0-9-]{1,}')) AS slashed,
             len(list_filter(ws, lambda x: regexp_matches(x, '^[0-9]+(?:[.-][0-9]+)*$'))) AS numeric, len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]{2,}'))) AS alpha,
             len(regexp_extract_all(text, '(?i)\b(?:education|experience|employment|skills|projects|work|intern|developer|engineer|university|bachelor|summary|linkedin|github|portfolio)\b')) AS signals,
             len(regexp_extract_all(text, '(?i)\b(?:obj|endobj|stream|endstream|xref|trailer|startxref)\b')) AS ops FROM w)
SELECT doc_id, words, letters, digits, slashed, numeric, alpha,
 text <> '' AND ops < 2 AND words >= 20 AND alpha / greatest(words, 1) >= 0.45 AND slashed / greatest(words, 1) <= 0.18 AND NOT (digits > letters * 0.92 AND alpha / greatest(words, 1) < 0.7)
 AND NOT (numeric / greatest(words, 1) > 0.45 AND alpha / greatest(words, 1) < 0.72) AND (regexp_matches(text, '(?i)@|linkedin\.com|github\.com') OR signals >= 1 OR words >= 120) AS resume
FROM q
"""


def semantic_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed vectors of all documents and their likeness to a role."""
    from loomrank.operators.semantic import constant, embedding

    d = _read(spark, sf_dir, "documents").select("doc_id", embedding("text", WORDS).alias("v"))
    like = scoring.cosine("v", constant(spark, "the article that was with them", WORDS))
    return d.select("doc_id", like.alias("c")).select("doc_id", F.round("c", 5).alias("cosine"), scoring.similarity_percent(F.col("c")).alias("percent"))


def described_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomrank.sources.pages import described

    p = described(_read(spark, sf_dir, "pages"))
    kind = eligibility.page_type("title", F.parse_url("url", F.lit("PATH")), F.coalesce(F.parse_url("url", F.lit("QUERY")), F.lit("")), "text", F.col("links"))
    return p.select("page_id", "title", F.length("text").alias("n_chars"), "links", kind.alias("kind"))


def page_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomrank.sources.pages import jobs

    return jobs(_read(spark, sf_dir, "pages"))


def event_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of each user's events: those with less than an hour between them."""
    from loomrank.streaming.listings import debounced

    return debounced(_read(spark, sf_dir, "events"), "user_id", quiet="1 hour").select("user_id", "began", "n_events")


EVENT_BURSTS = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS b FROM g)
SELECT user_id, min(ts) AS began, count(*) AS n_events FROM s GROUP BY user_id, b
"""


def event_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomrank.streaming.listings import activity

    return activity(_read(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


EVENT_ACTIVITY = "SELECT date_trunc('hour', ts) AS began, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select((F.expr(MILLIS) * 100_000 + F.col("event_id")).alias("at"), F.col("event_type").alias("type"))
    return stores.latest_events(e, 120)


LATEST = 'SELECT (epoch_us(ts) // 1000) * 100000 + event_id AS "at", event_type AS type FROM events ORDER BY 1 DESC LIMIT 120'


def job_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row of its page each hint means: orders are rows of their customer's page, and each order gives a hint."""
    o = _read(spark, sf_dir, "orders").withColumn("id", F.col("o_orderkey").cast("string"))
    even = F.col("o_orderkey") % 2 == 0
    jobs = o.select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("row_index"), F.when(even, F.col("id")).otherwise("").alias("job_id"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("No "), "id", F.lit(" "), "o_orderstatus").alias("row_text"))
    k, t = F.col("o_orderkey") % 4, F.col("o_orderkey") % 5
    hint_id = F.when(k < 2, F.col("id")).when(k == 2, "").otherwise((F.col("o_orderkey") + 1).cast("string"))
    title = F.when(t == 0, "").when(t == 1, "Low").when(t == 2, F.col("o_orderpriority")).when(t == 3, "medium").otherwise(F.concat("o_orderpriority", F.lit(" (urgent)")))
    hints = o.select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("hint"), hint_id.alias("hint_id"), title.alias("hint_title"))
    return eligibility.found_jobs(jobs, hints)


JOB_LOOKUP = r"""
WITH o AS (SELECT o_custkey AS page, o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS p, o_orderstatus AS s FROM orders),
j AS (SELECT page, k AS row_index, CASE WHEN k % 2 = 0 THEN id ELSE '' END AS job_id, trim(regexp_replace(lower(p), '[^a-z0-9]+', ' ', 'g')) AS key, 'No ' || id || ' ' || s AS row_text FROM o),
h AS (SELECT page, k AS hint, CASE k % 4 WHEN 2 THEN '' WHEN 3 THEN CAST(k + 1 AS VARCHAR) ELSE id END AS hint_id,
             trim(regexp_replace(lower(CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN 'Low' WHEN 2 THEN p WHEN 3 THEN 'medium' ELSE p || ' (urgent)' END), '[^a-z0-9]+', ' ', 'g')) AS title FROM o),
w AS (SELECT h.page, hint, row_index, CASE WHEN hint_id <> '' AND job_id = hint_id THEN 0 WHEN hint_id <> '' AND regexp_matches(row_text, '\b' || hint_id || '\b') THEN 1
             WHEN title <> '' AND contains(key, title) THEN 2 WHEN title <> '' AND contains(title, key) THEN 3 END AS way FROM h JOIN j ON h.page = j.page),
b AS (SELECT page, hint, row_index, way, row_number() OVER (PARTITION BY page, hint ORDER BY way NULLS LAST, row_index) AS n FROM w)
SELECT page, hint, CASE WHEN way IS NOT NULL THEN row_index END AS row_index, way FROM b WHERE n = 1
"""


# --- the posting behind a listed job ---------------------------------------------------------------------------------

_HOST = "https://jobs.example.org"


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs on pages of twenty: a document each, with a number, a number with letters, or none."""
    p = postings(spark, sf_dir).withColumnRenamed("row_index", "job_key")
    k = F.col("job_key")
    number = (k + 100_000).cast("string")
    job_id = F.when(k % 4 == 0, "").when(k % 8 == 5, F.concat(F.lit("J-"), number)).otherwise(number)
    return p.select(F.floor(k / 20).alias("page"), "job_key", job_id.alias("job_id"), "title", "company", "text", number.alias("number"))


def _scripts(listed: DataFrame) -> DataFrame:
    """A script for each document, which names its number, its neighbour's, or none."""
    k = F.col("job_key")
    text = F.when(k % 3 == 0, F.concat(F.lit("var postingId = J-"), "number", F.lit("; "), "title", F.lit(". "), "text"))
    text = text.when(k % 3 == 1, F.concat(F.lit("show(9"), (k + 100_001).cast("string"), F.lit("7); "), "text")).otherwise(F.concat("title", F.lit(" "), "text"))
    return listed.select("page", k.alias("script"), text.alias("text"))


def script_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scripts of a page say of each of its jobs."""
    listed = _listed(spark, sf_dir)
    return details.harvested(listed, _scripts(listed)).select("job_key", "n_chunks", F.length("text").alias("n_chars"), F.md5("text").alias("md5"))


_SQL_LISTED = f"""listed AS (SELECT doc_id // 20 AS page, doc_id AS k, CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 8 = 5 THEN 'J-' || (doc_id + 100000) ELSE (doc_id + 100000)::VARCHAR END AS job_id,
  {_sql_pick(TITLES)} AS title, source AS company, {SQL_BODY} AS body FROM documents),
script AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY k) AS n FROM (SELECT page, k, CASE k % 3 WHEN 0 THEN 'var postingId = J-' || (k + 100000) || '; ' || title || '. ' || body
  WHEN 1 THEN 'show(9' || (k + 100001) || '7); ' || body ELSE title || ' ' || body END AS text FROM listed) QUALIFY n <= 30),
pair AS (SELECT l.k, l.job_id, l.title, n, CASE WHEN l.job_id <> '' AND contains(text[:6000], l.job_id) THEN text[:6000] WHEN regexp_matches(text, '(?i)jobs\\.htm|postingid|jobid|positionid|opportunityid') THEN text[:2400] END AS c
  FROM listed l JOIN script s ON l.page = s.page),
words AS (SELECT *, lower(c) AS low, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: len(w) >= 4) AS ws FROM pair WHERE len(c) >= 220),
chunk AS (SELECT * FROM words WHERE contains(low, lower(job_id)) AND (regexp_matches(low, '(skills and experience|required|preferred|job summary|job responsibilities|job posting information|application information|work term duration)')
  OR regexp_matches(low, '(required skills|preferred skills)') OR len(list_filter(ws, lambda w: contains(low, w))) >= CASE WHEN len(ws) = 0 THEN 2 ELSE least(2, len(ws)) END)),
harvest AS (SELECT k, count(*) AS n_chunks, string_agg(c, chr(10) ORDER BY n) AS text FROM (SELECT k, c, min(n) AS n FROM chunk GROUP BY ALL) GROUP BY k)"""
SCRIPT_POSTINGS = f"WITH {_SQL_LISTED} SELECT k AS job_key, n_chunks::INTEGER AS n_chunks, len(text)::INTEGER AS n_chars, md5(text) AS md5 FROM harvest"


def job_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each listed job's posting was found: in the cache, a response, the page's scripts or the job's own page."""
    listed = _listed(spark, sf_dir)
    k = F.col("job_key")
    whole = F.concat(F.lit("Job Posting Information. "), F.when(k % 3 < 2, F.concat(F.lit("Job ID "), "number", F.lit(". "))).otherwise(""), "title", F.lit(". "), "text")
    anonymous = F.concat("title", F.lit(". "), "text")
    # ^ picks the other of two neighbours
    view, item = F.concat(F.lit(f"{_HOST}/posting/view.htm?id="), k.cast("string")), lambda name: F.concat(F.lit(f"{_HOST}/list.htm?{name}="), "number")
    other = F.concat(F.lit(f"{_HOST}/posting/view.htm?id="), k.bitwiseXOR(F.lit(1)).cast("string"))
    named = F.when(k % 3 > 0, item("postingId")).otherwise(item("page"))
    form, body = F.lit(f"{_HOST}/form"), F.concat(F.lit("id="), "number")
    row = lambda *x: F.struct(*(F.lit(v).alias(n) if not hasattr(v, "alias") else v.alias(n) for n, v in zip(("position", "method", "url", "body", "confidence"), x, strict=True)))
    requests = listed.select("job_key", F.inline(F.array(row(0, "get", other, "", ""), row(1, "GET", named, "", "low"), row(2, "POST", form, body, F.when(k % 2 == 0, "High").otherwise("")))))
    cache = listed.filter("job_key % 5 < 2").select(view.alias("url"), whole.alias("text")).unionByName(listed.filter("job_key % 7 = 0").select(item("postingId").alias("url"), whole.alias("text")))
    answers = [
        listed.filter("job_key % 2 = 0").select(F.lit("GET").alias("method"), view.alias("url"), F.lit(None).cast("string").alias("body"), whole.alias("text")),
        listed.filter("job_key % 9 < 3").select(F.lit("GET").alias("method"), named.alias("url"), F.lit("").alias("body"), whole.alias("text")),
        listed.filter("job_key % 4 = 2").select(F.lit("post").alias("method"), form.alias("url"), body.alias("body"), anonymous.alias("text")),
    ]
    responses = answers[0].unionByName(answers[1]).unionByName(answers[2])
    pages = listed.filter("job_key % 11 < 6").select("job_key", whole.alias("text"))
    contexts = lambda left: details.harvested(listed.join(left, "job_key", "left_semi"), _scripts(listed))
    found = details.details(listed, requests, cache, responses, contexts, pages, WORDS)
    return found.select("job_key", "found", "position", "url", F.length("full_text").alias("n_chars"), F.array_join("required_skills", "|").alias("required_skills"))


def _sql_same(high: str = "false") -> str:
    """The rule of a posting that is a listed job's, over columns of a parsed text and of a job."""
    words = lambda c: f"list_filter(string_split(trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: len(w) >= 4)"
    plain = "['intern', 'internship', 'co', 'coop', 'student', 'position', 'role', 'job', 'junior', 'senior', 'assistant', 'engineering', 'developer', 'software', 'analyst']"
    telling = f"list_filter({words('title')}, lambda w: NOT list_contains({plain}, w))"
    keys = f"(CASE WHEN len({telling}) > 0 THEN {telling} ELSE {words('title')} END)"
    titled = f"CASE WHEN len({keys}) = 0 THEN len(s) >= 900 ELSE len(list_filter({keys}, lambda w: contains(lower(s), w))) >= CASE WHEN len({keys}) >= 4 THEN 2 ELSE 1 END END"
    full = f"(len(s) >= 220 AND regexp_matches(lower(s), '(skills and experience|required|preferred|job summary|job responsibilities|job posting information|application information|work term duration)') AND (n_skills >= 3 OR stated OR len(s) >= 1400) AND {titled})"
    numbers = r"regexp_extract_all(lower(s), '\b[0-9]{5,8}\b')[:24]"
    firm = words("company")
    ok = f"(job_id <> '' AND contains(lower(s), lower(job_id))) OR NOT ((job_id <> '' AND len({numbers}) > 0 AND NOT list_contains({numbers}, lower(job_id))) OR (len({firm}) > 0 AND len(list_filter({firm}, lambda w: contains(lower(s), w))) = 0 AND job_id = '' AND n_skills < 8))"
    return f"{full} AND ({high} OR {ok})"


_COUNT = "CASE WHEN {0} = '' THEN 0 ELSE len(string_split({0}, '|')) END"
JOB_DETAILS = rf"""
WITH {_SQL_LISTED},
written AS (SELECT k, 'Job Posting Information. ' || CASE WHEN k % 3 < 2 THEN 'Job ID ' || (k + 100000) || '. ' ELSE '' END || title || '. ' || body AS whole, title || '. ' || body AS anonymous FROM listed),
tx AS (SELECT 'w' || k AS row_index, whole AS raw FROM written UNION ALL SELECT 'a' || k, anonymous FROM written UNION ALL SELECT 'h' || k, text FROM harvest),
p AS (SELECT row_index, {SQL_NORMAL.format("raw")} AS s FROM tx),
{_PARSE}, z AS ({_PARSED_ROWS}),
x AS (SELECT row_index AS id, s, required_skills, {_COUNT.format("required_skills")} + {_COUNT.format("preferred_skills")} AS n_skills,
      regexp_matches(low, 'work\s*term\s*duration\s*:\s*[^\s]') OR cover_required OR transcript OR restriction IS NOT NULL OR required_fields <> '' AS stated FROM z JOIN (SELECT row_index, s, low FROM q) USING (row_index)),
asked AS (SELECT k, job_id, title, company, unnest([0, 1, 2]) AS position FROM listed),
a AS (SELECT *, CASE position WHEN 0 THEN '{_HOST}/posting/view.htm?id=' || xor(k, 1) WHEN 1 THEN '{_HOST}/list.htm?' || CASE WHEN k % 3 > 0 THEN 'postingId=' ELSE 'page=' END || (k + 100000) ELSE '{_HOST}/form' END AS url,
      CASE position WHEN 0 THEN xor(k, 1) ELSE k END AS target FROM asked),
way AS (
  SELECT a.*, 0 AS kind, false AS sure, 'w' || target AS id FROM a WHERE position = 0 AND target % 5 < 2 OR position = 1 AND k % 3 > 0 AND target % 7 = 0
  UNION ALL SELECT a.*, 1, false, 'w' || target FROM a WHERE position = 0 AND target % 2 = 0 OR position = 1 AND target % 9 < 3
  UNION ALL SELECT a.*, 1, k % 2 = 0, 'a' || target FROM a WHERE position = 2 AND target % 4 = 2
  UNION ALL SELECT k, job_id, title, company, 1000, NULL, k, 2, false, 'h' || k FROM listed
  UNION ALL SELECT k, job_id, title, company, 1000, NULL, k, 3, false, 'w' || k FROM listed WHERE k % 11 < 6),
ok AS (SELECT way.k, kind, position, url, len(s) AS n_chars, required_skills FROM way JOIN x USING (id) WHERE {_sql_same("sure")}),
best AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY k ORDER BY position, kind) = 1)
SELECT listed.k AS job_key, ['cache', 'response', 'context', 'page'][kind + 1] AS found, CASE WHEN kind < 2 THEN position END::INTEGER AS position, url, n_chars::INTEGER AS n_chars, required_skills FROM listed LEFT JOIN best USING (k)
"""


def _rows_of_forms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Orders as jobs of their customer's page, which has up to three forms."""
    o = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("job_key"))
    k = F.col("job_key").cast("string")
    jobs = o.select("page", "job_key", F.when(F.col("job_key") % 7 == 0, "").otherwise(k).alias("job_id"))
    second = F.when(F.col("job_key") % 2 == 0, F.concat(F.lit("javascript:__doPostBack('grid$ctl"), k, F.lit("','')"))).otherwise(F.concat(F.lit("show('menu:item_"), k, F.lit("')")))
    first = F.concat(F.lit("PrimeFaces.ab({s:'list:row_"), k, F.lit("',f:'main'})"))
    actions = o.select("job_key", F.posexplode(F.array(first, second, first)).alias("seq", "text"))
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"), F.col("c_custkey").cast("string").alias("c"))
    form = lambda n, i, a: F.struct(F.lit(n).alias("form"), F.lit(i).alias("form_id"), F.lit(f"{_HOST}/{a}").alias("action"))
    p = F.col("page")
    forms = c.select("page", F.inline(F.array_compact(F.array(form(0, "main", "jobs.htm"), F.when(p % 2 == 0, form(1, None, "postings/list?page=2&job=1#top")), F.when(p % 5 == 0, form(2, "help", "help/ask"))))))
    field = lambda n, k, name, kind, value, on=None: F.struct(F.lit(n).alias("form"), F.lit(k).alias("position"), F.lit(name).alias("name"), F.lit(kind).alias("type"), value.alias("value"), F.lit(on).cast("boolean").alias("checked"))
    rows = [
        field(0, 0, "javax.faces.ViewState", "HIDDEN", F.concat(F.lit("v s:"), "c")), field(0, 1, "postingId", "hidden", F.lit("")), field(0, 2, "q", "text", F.lit("x")), field(0, 3, "go", "submit", F.lit("Go")),
        field(0, 4, "recordMark", "checkbox", F.lit("1")), field(1, 0, "__VIEWSTATE", "hidden", F.concat(F.lit("a&b"), "c")), field(1, 1, "__token", "text", F.lit(" t ")), field(1, 2, "page", "hidden", F.lit("1")),
        field(1, 3, "__VIEWSTATE", "hidden", F.concat(F.lit("a/"), "c")), field(2, 0, "id", "hidden", F.lit("3")),
    ]
    return jobs, actions, forms, c.select("page", F.inline(F.array(*rows)))


def form_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests that the forms of a page would send for each of its jobs."""
    return form_requests.form_requests(*_rows_of_forms(spark, sf_dir))


_FORM_IDS = ["jobId", "postingId", "positionId", "opportunityId", "jobPostingId", "selectedJobId", "selectedPostingId", "posting", "position", "job"]
FORM_POSTS = f"""
WITH j AS (SELECT o_custkey AS page, o_orderkey AS k, o_orderkey::VARCHAR AS id FROM orders WHERE o_orderkey % 7 <> 0),
s AS (SELECT *, unnest(CASE WHEN k % 2 = 0 THEN [0] ELSE [0, 1] END) AS i FROM j),
t AS (SELECT *, unnest([0, 1]) AS i FROM j),
source AS (SELECT *, CASE i WHEN 0 THEN 'list%3Arow_' ELSE 'menu%3Aitem_' END || id AS v FROM s),
target AS (SELECT *, CASE WHEN i = 0 THEN 'list%3Arow_' WHEN k % 2 = 0 THEN 'grid%24ctl' ELSE 'menu%3Aitem_' END || id AS v FROM t),
ajax AS (SELECT *, 'javax.faces.partial.ajax=true&javax.faces.source=' || v || '&javax.faces.partial.execute=' || v || '&javax.faces.partial.render=%40all&' || v || '=' || v AS b FROM source),
named AS (SELECT *, unnest({["postingId", "jobId", *_FORM_IDS[2:]]}) AS a, unnest({_FORM_IDS}) AS n, unnest(range(10)) AS i FROM j),
every AS (
  SELECT k, 0 AS form, 0 AS way, 2 * i AS i, 'POST' AS method, '{_HOST}/jobs.htm' AS url, 'javax.faces.ViewState=v+s%3A' || page || '&postingId=' || id || '&' || b || '&main=main' AS body FROM ajax
  UNION ALL SELECT k, 1, 0, 2 * i, 'POST', '{_HOST}/postings/list?page=2&job=1#top', '__VIEWSTATE=a%2F' || page || '&__token=+t+&page=1&' || b FROM ajax WHERE page % 2 = 0
  UNION ALL SELECT k, 1, 1, 2 * i, 'POST', '{_HOST}/postings/list?page=2&job=1#top', '__VIEWSTATE=a%2F' || page || '&__token=+t+&page=1&__EVENTTARGET=' || v || '&__EVENTARGUMENT=' FROM target WHERE page % 2 = 0
  UNION ALL SELECT k, 0, 2, 2 * i, 'POST', '{_HOST}/jobs.htm', 'javax.faces.ViewState=v+s%3A' || page || '&postingId=' || CASE WHEN a = 'postingId' THEN id ELSE '&' || a || '=' || id END FROM named
  UNION ALL SELECT k, 0, 2, 2 * i + 1, 'GET', '{_HOST}/jobs.htm?javax.faces.ViewState=v+s%3A' || page || '&postingId=' || CASE WHEN a = 'postingId' THEN id ELSE '&' || a || '=' || id END, '' FROM named
  UNION ALL SELECT k, 1, 2, 2 * i, 'POST', '{_HOST}/postings/list?page=2&job=1#top', '__VIEWSTATE=a%2F' || page || '&__token=t&' || n || '=' || id FROM named WHERE page % 2 = 0
  UNION ALL SELECT k, 1, 2, 2 * i + 1, 'GET', '{_HOST}/postings/list?page=2&job=' || CASE WHEN n = 'job' THEN id ELSE '1' END || '&__VIEWSTATE=a%2F' || page || '&__token=t' || CASE WHEN n = 'job' THEN '' ELSE '&' || n || '=' || id END, '' FROM named WHERE page % 2 = 0),
first AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY form, way, i) - 1 AS position FROM every WHERE k IN (SELECT k FROM j JOIN customer ON c_custkey = page))
SELECT k AS job_key, position::INTEGER AS position, method, url, body FROM first WHERE position < 24
"""


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {
    "text_primitives": (text_primitives, TEXT_PRIMITIVES), "hashes": (hashes, HASHES), "alias_hits": (alias_hits, ALIAS_HITS), "sentence_skills": (sentence_skills, SENTENCE_SKILLS),
    "skill_match": (skill_match, SKILL_MATCH), "profile_fields": (profile_fields, PROFILE_FIELDS), "term_signals": (term_signals, TERM_SIGNALS), "parsed_postings": (parsed, PARSED),
    "hard_eligibility": (hard_eligibility, HARD_ELIGIBILITY), "role_scores": (role_scores, ROLE_SCORES), "tiers": (tiers, TIERS), "overview": (overview, OVERVIEW),
    "key_insights": (insights, INSIGHTS), "flag_counts": (flags, FLAGS), "worth_reconsidering": (reconsidered, RECONSIDERED), "top_matches": (top_matches, TOP_MATCHES), "skill_gaps": (gaps, GAPS),
    "smart_search": (smart_search, _search_sql()), "vector_similarity": (vector_similarity, VECTOR_SIMILARITY), "share_scores": (share_scores, SHARE_SCORES), "hiring_history": (hiring_history, HIRING_HISTORY),
    "viability_grid": (viability_grid, VIABILITY_GRID), "page_keys": (page_keys, PAGE_KEYS), "job_cache": (cache, CACHE), "application_status": (applications, APPLICATIONS), "upserted_records": (upserted, UPSERTED),
    "field_intents": (field_intents, FIELD_INTENTS), "ranked_jobs": (ranked_jobs, None), "resume_skill_sets": (resume_skill_sets, None), "listing_signature": (listing_signature, None), "text_quality": (text_quality, TEXT_QUALITY),
    "semantic_vectors": (semantic_vectors, None), "described_pages": (described_pages, None), "page_jobs": (page_jobs, None), "event_bursts": (event_bursts, EVENT_BURSTS), "event_activity": (event_activity, EVENT_ACTIVITY),
    "latest_events": (latest, LATEST), "job_lookup": (job_lookup, JOB_LOOKUP), "script_postings": (script_postings, SCRIPT_POSTINGS), "job_details": (job_details, JOB_DETAILS), "form_posts": (form_posts, FORM_POSTS),
}


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in QUERIES.items() if s}


