"""From a posting's text to a record: required and preferred skills, term lengths, eligibility and degree fields.

Every function takes columns and gives columns, so that parsing is one projection over a table of texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrank.functions.js import SPACE, any_of, col, first_match, let, matches, unique
from loomrank.functions.lexicon import SKILLS, Skill
from loomrank.functions.text import normalize, sentences_of, word_to_number

from .dictionary import posting_fields, skills_in, skills_in_sentences

# Words and patterns that postings are read by.
REQUIRED_WORDS = ["required", "must", "minimum qualification", "qualification", "need to", "mandatory"]
PREFERRED_WORDS = ["preferred", "nice to have", "asset", "bonus", "would be an asset"]
SUMMARY_WORDS = ["must", "required", "preferred", "cover letter", "transcript", "gpa", "8-month", "term"]
SECTION_HEADING = r"\b(skills?\s*(?:and|&)?\s*experience|technical skills?|qualifications?|requirements?|what you(?:'|’)ll bring|what we(?:'|’)re looking for|must[- ]?have|minimum qualifications?)\b"
SOFT_CUE = r"\b(preferred|preferable|asset|nice to have|bonus|plus|would be an asset|considered an asset)\b"
HARD_CUE = r"\b(required|must|mandatory|minimum qualification|proficiency|strong proficiency|experience with|familiarity with|knowledge of|understanding of|ability to|hands[- ]on|competenc(?:y|ies)|expertise in)\b"
COVER_REQUIRED = r"cover letter\s*(is\s*)?(required|mandatory)"
COVER_RECOMMENDED = r"cover letter\s*(is\s*)?(recommended|preferred|encouraged)"
TRANSCRIPT = r"(unofficial\s*)?transcript\s*(is\s*)?(required|mandatory|must)"
GPA = r"(gpa\s*(of|>=|>|minimum)?\s*\d(?:\.\d{1,2})?|minimum\s*gpa\s*\d(?:\.\d{1,2})?)"
FIRST_YEAR = r"(first[- ]year\s*(completed|completion)|completed\s*first\s*year)"
MASTERS = r"(currently\s+enrolled\s+in\s+(a\s+)?master'?s|must\s+be\s+(currently\s+)?enrolled\s+in\s+(a\s+)?master'?s|master'?s\s+program\s+(required|only))"
PHD = r"(currently\s+enrolled\s+in\s+(a\s+)?ph\.?d|must\s+be\s+(currently\s+)?enrolled\s+in\s+(a\s+)?ph\.?d|ph\.?d\s+(students?\s+)?(required|only))"
GRADUATE = r"(graduate\s+students?\s+only|must\s+be\s+a\s+graduate\s+student|for\s+master'?s\s+or\s+ph\.?d|graduate[- ]level\s+students?\s+only)"
TERM_RESTRICTION = r"(work\s*term\s*(\d|one|two|three|four|five|six|seven|eight)|term\s*\d\s*only|for\s*students\s*in\s*term\s*\d)"
DURATION = r"work\s*term\s*duration\s*:\s*([^\n\r]+)"
SOFT_ELIGIBILITY = r"(preferred|preferable|ideally|asset|nice to have|considered an asset|would be an asset)"
HARD_ELIGIBILITY = r"(must|required|only|eligible|mandatory)"
RANGE_ELIGIBILITY = r"(minimum|at least|or above|or higher|and above|\+)"
WORK_TERM = r"(?:work\s*term|term)\s*(one|two|three|four|five|six|seven|eight|\d{1,2}(?:st|nd|rd|th)?|\d{1,2})"
YEAR = r"(first|second|third|fourth|fifth|1st|2nd|3rd|4th|5th|\d{1,2}(?:st|nd|rd|th)?|\d{1,2})\s*[- ]?year"
DEGREE = r"(degree|major|program|field|student|bachelor|college|university)"
DEGREE_PREFERRED = r"(preferably|preferred|ideally|asset|nice to have|would be an asset)"
DEGREE_REQUIRED = r"(must|required|mandatory|only|minimum|eligible)"
DEGREE_FOCUS = r"(focus area of the internship|degree or major in the focus area)"
DEGREE_WORDS = DEGREE.strip("()").split("|")
# Each match of a cue holds one of its words.
SOFT_WORDS = ["prefer", "asset", "nice to have", "bonus", "plus"]
HARD_WORDS = ["required", "must", "mandatory", "qualification", "proficiency", "experience with", "familiarity with", "knowledge of", "understanding of", "ability to", "hands", "competenc", "expertise in"]
TIME_WORDS = ["term", "year"]
#: A sentence without any of these tells nothing that parse() asks for.
TELLING = [*dict.fromkeys([*REQUIRED_WORDS, *PREFERRED_WORDS, *SUMMARY_WORDS, *SOFT_WORDS, *HARD_WORDS, *TIME_WORDS, *DEGREE_WORDS])]
TELLING = [w for w in TELLING if not any(v in w for v in TELLING if v != w)]
MOST_LINES, MOST_BULLETS, MOST_ELIGIBILITY, MOST_DEGREE, LEAST_BULLET = 40, 8, 6, 8, 12

MONTHS = {"four": (r"(?:4|four)", "4", "four", "1", "one"), "eight": (r"(?:8|eight)", "8", "eight", "2", "two")}
LENGTH = r"\s*[- ]?month(?:s)?"


#: Characters on either side of a word of time that can belong to what is said of it; every pattern takes fewer, as runs of spaces don't occur.
NEAR = 80


def _near_terms(text: Column) -> Column:
    """A text without what is far from any mention of months or terms."""
    cut = lambda p: F.when(F.length(p) > 2 * NEAR, F.concat(F.left(p, F.lit(NEAR)), F.lit("\x01"), F.right(p, F.lit(NEAR)))).otherwise(p)
    return F.array_join(F.transform(F.split(text, "(?=month|term)"), cut), "")


def term_signals(text: Column | str) -> Column:
    """What a text in lower case and with single spaces says about terms of four and eight months: a struct of flags,
    accepts_* true, false or null. Patterns run over the surroundings of months and terms only, each once."""
    return let(_near_terms(col(text)), lambda near: let(_term_flags(near), _term_signals))


def _term_flags(t: Column) -> Column:
    def side(name: str) -> list[Column]:
        either, digit, word, terms, terms_word = MONTHS[name]
        length = either + LENGTH
        out = {
            "mention": rf"(?:^|[^0-9]){digit}{LENGTH}\b|{word}{LENGTH}\b|(?:^|[^0-9]){terms}\s*work\s*terms?\b|{terms_word}\s*work\s*terms?\b",
            "preferred": rf"{length}\s*(?:preferred|preferable|ideally)|prefer(?:red)?\s*(?:an?\s*)?{length}",
            "required": rf"{length}\s*(?:required|mandatory|only)|must\s*(?:be|do)?\s*(?:an?\s*)?{length}|requires?\s*(?:an?\s*)?{length}",
            "accepted": rf"{length}\s*(?:accepted|considered|possible|available|option|okay|ok)|open\s+to\s+{length}",
        }
        if name == "eight":
            out["preferred"] += r"|two\s*work\s*terms?\s*preferred"
            out["required"] += r"|two\s*work\s*terms?\s*(?:required|mandatory)"
            out["accepted"] += r"|open\s+to\s+two\s*work\s*terms?"
        return [matches(t, v).alias(f"{name}_{k}") for k, v in out.items()]

    both = matches(t, rf"(?:4|four){LENGTH}\s*(?:or|/|and|&)\s*(?:8|eight){LENGTH}|(?:8|eight){LENGTH}\s*(?:or|/|and|&)\s*(?:4|four){LENGTH}")
    return F.struct(*side("four"), *side("eight"), both.alias("both"))


def _term_signals(f: Column) -> Column:
    four, eight = ({k: f[f"{n}_{k}"] for k in ("mention", "preferred", "required", "accepted")} for n in ("four", "eight"))
    both = f["both"]
    only_four = four["required"] & ~eight["accepted"]
    only_eight = eight["required"] & ~four["accepted"] & ~only_four
    said = lambda x: x["mention"] | x["accepted"] | x["preferred"]
    # an explicit word of acceptance counts whatever else is said
    accepts_four = F.when(both | four["accepted"] | only_four, True).when(only_eight, False).when(said(four), True)
    accepts_eight = F.when(both | eight["accepted"], True).when(only_four, False).when(only_eight | said(eight), True)
    return F.struct(
        four["mention"].alias("four_month_mention"), eight["mention"].alias("eight_month_mention"), four["preferred"].alias("four_month_preferred"),
        eight["preferred"].alias("eight_month_preferred"), four["required"].alias("four_month_required"), eight["required"].alias("eight_month_required"),
        accepts_four.alias("accepts_four"), accepts_eight.alias("accepts_eight"),
    )


def duration_value(raw: Column | str, text: Column | str) -> Column:
    """What follows "work term duration:", to the end of the line, in the raw or else the normalised text."""
    pattern = "(?i)" + DURATION.replace(r"\s", SPACE)
    of = lambda c: F.nullif(normalize(F.regexp_extract(F.coalesce(col(c), F.lit("")), pattern, 1)), F.lit(""))
    return F.coalesce(of(raw), of(text))


def lines_of(raw: Column, low: Column) -> Column:
    """A text as it is where parse() needs it beside its normalised form (low is that in lower case), else null."""
    return F.when(F.contains(low, F.lit("duration")), raw)


def with_duration(signals: Column, value: Column | str) -> Column:
    """Signals as a stated duration overrules them, and the length in months that they come to."""
    return let(term_signals(F.lower(col(value))), lambda said: _with_duration(signals, value, said))


def _with_duration(signals: Column, value: Column | str, said: Column) -> Column:
    four = col(value).isNotNull() & said["four_month_mention"] & ~said["eight_month_mention"]
    eight = col(value).isNotNull() & said["eight_month_mention"] & ~said["four_month_mention"]
    both = col(value).isNotNull() & said["four_month_mention"] & said["eight_month_mention"]
    accepts_four = F.when(four | both, True).when(eight, False).otherwise(signals["accepts_four"])
    accepts_eight = F.when(eight | both, True).when(four, False).otherwise(signals["accepts_eight"])
    need_four = F.when(four, True).when(eight, False).otherwise(signals["four_month_required"])
    need_eight = F.when(eight, True).when(four, False).otherwise(signals["eight_month_required"])
    yes = lambda c: F.coalesce(c, F.lit(False))
    length = (
        F.when(need_eight & ~yes(accepts_four), 8).when(need_four & ~yes(accepts_eight), 4)
        .when(yes(accepts_eight) & ~yes(accepts_four), 8).when(yes(accepts_four) & ~yes(accepts_eight), 4)
    )
    kept = [signals[n].alias(n) for n in ("four_month_mention", "eight_month_mention", "four_month_preferred", "eight_month_preferred")]
    return F.struct(
        length.cast("int").alias("work_term_length"), *kept, need_four.alias("four_month_required"), need_eight.alias("eight_month_required"),
        accepts_four.alias("accepts_four"), accepts_eight.alias("accepts_eight"), col(value).alias("work_term_duration_value"),
    )


def _numbers(sentence: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(sentence, F.lit(pattern.replace(r"\s", SPACE)), 1)
    return F.filter(F.transform(found, word_to_number), lambda n: n.isNotNull())


def _lines(sents: Column | str) -> Column:
    """Sentences (line) with their lower case (low), which is worked out once for each."""
    return F.transform(col(sents), lambda s: F.struct(s.alias("line"), F.lower(s).alias("low")))


def _having(lines: Column, words: Sequence[str]) -> Column:
    """The sentences of some lines that have any of the words anywhere."""
    return F.transform(F.filter(lines, lambda r: any_of(r["low"], words)), lambda r: r["line"])


def eligibility(sents: Column | str) -> Column:
    """The least work term and year and the terms allowed, from the sentences that demand them."""
    # what is hard counts, whatever else is said
    counts = lambda s: matches(s, HARD_ELIGIBILITY) | F.when(matches(s, RANGE_ELIGIBILITY), ~matches(s, SOFT_ELIGIBILITY)).otherwise(False)

    def read(row: Column) -> Column:
        line, s = row["line"], row["low"]
        terms, years = _numbers(s, WORK_TERM), _numbers(s, YEAR)
        upper = matches(s, r"\bupper[- ]?year\b")
        least, only = matches(s, RANGE_ELIGIBILITY), matches(s, r"\bonly\b") | matches(s, r"\beligible\b")
        some = F.size(terms) > 0
        year = F.greatest(F.array_max(years), F.when(upper, 3))
        none = F.array().cast("array<int>")
        noted = (some & (least | only)) | year.isNotNull()
        return F.struct(
            F.when(some & least, F.array_min(terms)).alias("term"), F.when(some & ~least & only, terms).otherwise(none).alias("allowed"), year.alias("year"), F.when(noted, line).alias("line")
        )

    # without these words a sentence says nothing of terms or years
    about = F.filter(_lines(sents), lambda r: any_of(r["low"], TIME_WORDS))
    return let(F.transform(F.filter(about, lambda r: counts(r["low"])), read), _eligibility)


def _eligibility(rows: Column) -> Column:
    return F.struct(
        F.array_max(rows["term"]).alias("min_work_term"),
        F.array_sort(F.array_distinct(F.flatten(rows["allowed"]))).alias("allowed_work_terms"),
        F.array_max(rows["year"]).alias("min_academic_year"),
        F.slice(unique(rows["line"]), 1, MOST_ELIGIBILITY).alias("eligibility_lines"),
    )


def degree_fields(sents: Column | str) -> Column:
    """Fields of study that sentences about degrees require or prefer."""

    def read(line: Column) -> Column:
        s = F.lower(line)
        fields = posting_fields(s)
        must = (matches(s, DEGREE_REQUIRED) | matches(s, DEGREE_FOCUS)) & ~matches(s, DEGREE_PREFERRED)
        return F.struct(fields.alias("fields"), must.alias("must"), line.alias("line"))

    # few sentences are about degrees
    about = F.transform(_having(_lines(sents), DEGREE_WORDS), read)
    return let(F.filter(about, lambda r: F.size(r["fields"]) > 0), _degree_fields)


def _degree_fields(rows: Column) -> Column:
    of = lambda must: F.array_distinct(F.flatten(F.filter(rows, lambda r: r["must"] == must)["fields"]))
    required = of(True)
    return F.struct(
        required.alias("required_degree_fields"), F.array_except(of(False), required).alias("preferred_degree_fields"), F.slice(unique(rows["line"]), 1, MOST_DEGREE).alias("degree_field_lines")
    )


def implicit(sents: Column | str, required: bool, skills: Sequence[Skill]) -> Column:
    """Sentences that name a skill beside a word of demand, or of preference."""
    pattern, words = (HARD_CUE, HARD_WORDS) if required else (SOFT_CUE, SOFT_WORDS)
    # plain words are looked for first, then cues: few sentences go on to the dictionary
    cue = F.filter(_having(_lines(sents), words), lambda s: matches(s, pattern, True))
    return F.filter(cue, lambda s: F.size(skills_in(s, skills, own_key=False)) > 0)


def parse(df: DataFrame, text: str = "text", bullets: str | None = None, skills: Sequence[Skill] = SKILLS, normal: str | None = None) -> DataFrame:
    """Adds the columns of a parsed posting: required_skills, preferred_skills, required_sentences,
    preferred_sentences, summary_bullets, meta, constraints and full_text. A null text is an empty posting. bullets: a
    column of list items under headings for skills, where the posting was HTML. normal: a column of normalised
    texts, where they are known; text is then what lines_of() keeps."""
    items = F.coalesce(F.col(bullets), F.array().cast("array<string>")) if bullets else F.array().cast("array<string>")
    soft_only = lambda s: matches(s, SOFT_CUE, True) & ~matches(s, HARD_CUE, True)
    items = unique(F.filter(items, lambda s: (F.length(s) >= LEAST_BULLET) & ~soft_only(s) & (F.size(skills_in(s, skills, own_key=False)) > 0)))
    df = df.withColumn("full_text", F.col(normal) if normal else normalize(text)).withColumn("_low", F.lower("full_text"))
    low = F.col("_low")
    # all that follows looks at the few sentences that hold a telling word; lower case has the same ends of sentences
    both = F.arrays_zip(sentences_of("full_text").alias("line"), sentences_of(low).alias("low"))
    df = df.withColumns({"_lines": F.filter(both, lambda r: any_of(r["low"], TELLING)), "_items": items})
    df = df.withColumn("sentences", F.col("_lines")["line"])
    keyword = lambda words: _having(F.col("_lines"), words)
    df = df.withColumn("required_sentences", unique(F.concat(keyword(REQUIRED_WORDS), implicit("sentences", True, skills), "_items")))
    # a preferred sentence that is also required stays required
    wanted = unique(F.concat(keyword(PREFERRED_WORDS), implicit("sentences", False, skills)))
    df = df.withColumn("preferred_sentences", F.array_except(wanted, "required_sentences"))
    df = df.withColumn("required_skills", skills_in_sentences("required_sentences", skills))
    df = df.withColumn("preferred_skills", F.array_except(skills_in_sentences("preferred_sentences", skills), "required_skills"))
    where = lambda words, found, other=None: F.when(any_of(low, words), found).otherwise(F.lit(other))
    df = df.withColumns({"_signals": term_signals(low), "_duration": where(["duration"], duration_value(text, "full_text")), "_who": eligibility("sentences"), "_fields": degree_fields("sentences")})
    terms = with_duration(F.col("_signals"), "_duration")
    flags = {
        "cover_letter_required": where(["cover letter"], matches(low, COVER_REQUIRED), False), "cover_letter_recommended": where(["cover letter"], matches(low, COVER_RECOMMENDED), False),
        "transcript_required": where(["transcript"], matches(low, TRANSCRIPT), False), "gpa_requirement": where(["gpa"], first_match("full_text", GPA)),
        "first_year_completion": where(["first"], matches(low, FIRST_YEAR), False), "term_restriction": where(["term"], first_match("full_text", TERM_RESTRICTION)),
        "masters_required": where(["master"], matches(low, MASTERS), False), "phd_required": where(["phd", "ph.d"], matches(low, PHD), False),
        "graduate_only": where(["graduate", "master"], matches(low, GRADUATE), False),
    }
    df = df.withColumn("_terms", terms)
    of = lambda c, names: [F.col(c)[n].alias(n) for n in names]
    names = ["work_term_length", "four_month_mention", "eight_month_mention", "four_month_preferred", "eight_month_preferred", "four_month_required", "eight_month_required", "accepts_four", "accepts_eight", "work_term_duration_value"]
    df = df.withColumn(
        "constraints",
        F.struct(
            *of("_terms", names), *(v.alias(k) for k, v in flags.items()), *of("_who", ["min_work_term", "allowed_work_terms", "min_academic_year", "eligibility_lines"]),
            *of("_fields", ["required_degree_fields", "preferred_degree_fields", "degree_field_lines"]),
        ),
    )
    meta = F.struct(F.size("required_sentences").alias("required"), F.size("preferred_sentences").alias("preferred"), F.size("_items").alias("section_bullets"))
    bullets_ = F.slice(unique(keyword(SUMMARY_WORDS)), 1, MOST_BULLETS)
    df = df.withColumns({"meta": meta, "summary_bullets": bullets_})
    cut = {c: F.slice(c, 1, MOST_LINES) for c in ("required_sentences", "preferred_sentences")}
    return df.withColumns(cut).drop("_items", "_low", "_lines", "_signals", "_duration", "_who", "_fields", "_terms", "sentences")
