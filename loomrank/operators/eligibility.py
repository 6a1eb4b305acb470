"""Who may apply, and which postings and pages are what they seem: filters and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrank.functions.js import any_of, blank, col, let, listed, matches
from loomrank.functions.text import normalize, title_key

from .posting import lines_of

# Reasons of the term filter.
EITHER, EIGHT_ROLE, FOUR_ROLE = "Either term length accepted by user preference.", "Posting is identified as an 8-month role.", "Posting is identified as a 4-month role."
UNKNOWN_FOUR, UNKNOWN_EIGHT, NO_PREFERENCE = "No explicit duration found; keeping posting in 4-month mode.", "Posting does not indicate 8-month eligibility.", "No strict term preference selected."


def _yes(c: Column, name: str) -> Column:
    return F.coalesce(c[name], F.lit(False))


def term_eligibility(c: Column, preferred: Column | str) -> Column:
    """(eligible, reason) of a posting's constraints under a strict preference for 4 or 8 months, or either. Any sign of
    the other length rules a posting out."""
    p = F.lit(preferred) if isinstance(preferred, str) else preferred

    def signal(own: str, length: int) -> Column:
        said = _yes(c, f"{own}_month_required") | _yes(c, f"accepts_{own}") | _yes(c, f"{own}_month_mention") | _yes(c, f"{own}_month_preferred")
        return said | F.coalesce(c["work_term_length"] == length, F.lit(False))

    four, eight = signal("four", 4), signal("eight", 8)
    of = lambda ok, why: F.struct(F.lit(ok).alias("eligible"), F.lit(why).alias("reason"))
    for_four = F.when(eight, of(False, EIGHT_ROLE)).when(four, of(True, FOUR_ROLE)).otherwise(of(True, UNKNOWN_FOUR))
    for_eight = F.when(four, of(False, FOUR_ROLE)).when(eight, of(True, EIGHT_ROLE)).otherwise(of(False, UNKNOWN_EIGHT))
    return F.when(p == "either", of(True, EITHER)).when(p == "4", for_four).when(p == "8", for_eight).otherwise(of(True, NO_PREFERENCE))


def term_filter(df: DataFrame, preferred: str, constraints: str = "constraints") -> DataFrame:
    """The rows whose term length suits a preference."""
    return df.filter(term_eligibility(F.col(constraints), preferred)["eligible"])


def hard_reasons(c: Column, work_term: Column | int, person: Column) -> Column:
    """Why a posting rules a person out, in order; empty where it doesn't. person: see scoring.academic."""
    term = F.greatest(F.lit(1), F.lit(work_term) if isinstance(work_term, int) else work_term)
    allowed, fields = c["allowed_work_terms"], c["required_degree_fields"]
    shown = lambda a: F.array_join(a.cast("array<string>"), ", ")
    return listed(
        [
            (_yes(c, "phd_required") & ~person["is_phd"], "Posting requires current PhD enrollment."),
            (_yes(c, "masters_required") & ~person["is_graduate"], "Posting requires current Master's enrollment."),
            (_yes(c, "graduate_only") & ~person["is_graduate"], "Posting is restricted to graduate students."),
            (c["min_work_term"] > term, F.concat(F.lit("Posting requires work term "), c["min_work_term"].cast("string"), F.lit("+."))),
            ((F.size(allowed) > 0) & ~F.array_contains(allowed, term), F.concat(F.lit("Posting is restricted to work term "), shown(allowed), F.lit("."))),
            (c["min_academic_year"] > F.ceil(term / 2), F.concat(F.lit("Posting requires year "), c["min_academic_year"].cast("string"), F.lit("+ standing."))),
            ((F.size(fields) > 0) & ~F.arrays_overlap(fields, person["fields"]), F.concat(F.lit("Posting targets degree fields: "), shown(fields), F.lit("."))),
        ]
    )


def constraint_labels(c: Column) -> Column:
    """What a posting's constraints are, in words."""
    shown = lambda name, a: F.concat(F.lit(name), F.array_join(a.cast("array<string>"), ", "))
    return listed(
        [
            (_yes(c, "eight_month_preferred"), "8-month preferred"),
            (_yes(c, "four_month_preferred"), "4-month preferred"),
            (_yes(c, "eight_month_required"), "8-month required"),
            (_yes(c, "four_month_required"), "4-month required"),
            (_yes(c, "cover_letter_required"), "Cover letter required"),
            (_yes(c, "cover_letter_recommended") & ~_yes(c, "cover_letter_required"), "Cover letter recommended"),
            (_yes(c, "transcript_required"), "Transcript required"),
            (c["gpa_requirement"].isNotNull(), F.concat(F.lit("GPA req: "), c["gpa_requirement"])),
            (_yes(c, "first_year_completion"), "First-year completion"),
            (c["term_restriction"].isNotNull(), "Term restriction"),
            (c["min_work_term"].isNotNull(), F.concat(F.lit("Min work term "), c["min_work_term"].cast("string"))),
            (F.size(c["allowed_work_terms"]) > 0, shown("Eligible terms: ", c["allowed_work_terms"])),
            (c["min_academic_year"].isNotNull(), F.concat(F.lit("Min year "), c["min_academic_year"].cast("string"))),
            (F.size(c["required_degree_fields"]) > 0, shown("Degree fields: ", c["required_degree_fields"])),
            (F.size(c["preferred_degree_fields"]) > 0, shown("Preferred fields: ", c["preferred_degree_fields"])),
            (_yes(c, "masters_required"), "Master's enrollment required"),
            (_yes(c, "phd_required"), "PhD enrollment required"),
            (_yes(c, "graduate_only"), "Graduate students only"),
        ]
    )


POSTING_WORDS = ["skills and experience", "required", "preferred", "job summary", "job responsibilities", "job posting information", "application information", "work term duration"]
POSTING_TEXT = f"({'|'.join(POSTING_WORDS)})"
#: A number that may be an id, in lower case. Tried at the first digit of a run only.
NUMBER = r"\d(?<![A-Za-z0-9_]\d)\d{4,7}+(?![A-Za-z0-9_])"


def looks_like_posting(text: Column | str) -> Column:
    return let(F.lower(blank(text, "")), lambda low: (F.length(low) >= 220) & any_of(low, POSTING_WORDS))


# Words that tell no title or company apart.
TITLE_WORDS = "intern internship co coop student position role job junior senior assistant engineering developer software analyst".split()
COMPANY_WORDS = "inc ltd corp corporation company division office solutions technologies technology services systems group university".split()


def _telling(text: Column | str, stop: list[str]) -> tuple[Column, Column]:
    words = F.filter(F.split(title_key(text), " "), lambda w: F.length(w) >= 4)
    return words, F.filter(words, lambda w: ~w.isin(stop))


def looks_like_full_posting(text: Column | str, title: Column | str, n_skills: Column, constraints: Column) -> Column:
    """Whether a text is the whole posting of that title."""
    return let(normalize(text), lambda t: let(F.lower(t), lambda low: _titled(t, low, _title_words(title)) & (_says_enough(n_skills, constraints) | ~_brief(t))))


def _title_words(title: Column | str) -> Column:
    words, telling = _telling(title, TITLE_WORDS)
    return F.when(F.size(telling) > 0, telling).otherwise(words)


def _named(low: Column, words: Column) -> Column:
    """Whether a text in lower case has enough of a title's words; if the title has any."""
    return let(words, lambda ws: F.size(F.filter(ws, lambda w: F.contains(low, w))) >= F.when(F.size(ws) >= 4, 2).when(F.size(ws) > 0, 1).otherwise(0))


def _titled(t: Column, low: Column, words: Column) -> Column:
    """Whether a normalised text and its lower case read like a posting of a title of those words."""
    return (F.length(low) >= 220) & ((F.size(words) > 0) | (F.length(t) >= 900)) & _named(low, words) & any_of(low, POSTING_WORDS)


def _brief(t: Column) -> Column:
    """Whether a normalised text is too short to be whole by its length alone."""
    return F.length(t) < 1400


def _says_enough(n_skills: Column, c: Column) -> Column:
    stated = c["work_term_duration_value"].isNotNull() | _yes(c, "cover_letter_required") | _yes(c, "transcript_required") | c["term_restriction"].isNotNull() | (F.size(c["required_degree_fields"]) > 0)
    return (n_skills >= 3) | stated


def _other(low: Column, i: Column) -> Column:
    """Whether a text in lower case has numbers, but not the job's id."""
    return (i != "") & ~F.contains(low, i) & low.rlike(NUMBER)


def _stranger(low: Column, i: Column, company: Column | str, stop: list[str]) -> Column:
    """Whether a text in lower case doesn't name the company of a job without an id."""
    _, firm = _telling(company, stop)
    return (i == "") & let(firm, lambda f: (F.size(f) > 0) & ~F.exists(f, lambda w: F.contains(low, w)))


#: A text with as many skills may be that of a job without an id whose company it doesn't name.
MANY_SKILLS = 8


def _id(job_id: Column | str) -> Column:
    return F.lower(F.trim(blank(job_id, "")))


def same_posting(text: Column | str, job_id: Column | str, title: Column | str, company: Column | str, n_skills: Column, constraints: Column, stop: list[str] = COMPANY_WORDS) -> Column:
    """Whether a parsed text is the posting of a listed job: the predicate of that join."""
    row = likely_posting(text, job_id, title, company, stop=stop)
    return let(row, lambda r: r.isNotNull() & likely_settled(r["brief"], r["strange"], n_skills, constraints))


def likely_posting(
    text: Column | str, job_id: Column | str, title: Column | str, company: Column | str, sure: Column | bool = False, most_skills: int = MANY_SKILLS, stop: list[str] = COMPANY_WORDS
) -> Column:
    """same_posting as far as it can be told before a text is parsed: null where it is false whatever the text says of skills
    and constraints, else a struct of normal (the normalised text), raw (the text itself, where parsing still needs its
    lines), brief and strange. It is true if neither of these two is; likely_settled gives what it comes to otherwise.

    sure: any whole posting of the title is the job's. most_skills: how many skills a text can have."""
    sure = F.lit(sure) if isinstance(sure, bool) else sure
    text = col(text)

    def of(i: Column, raw: Column, words: Column) -> Column:
        # most pairs end here: spaces don't matter to numbers, to words and to ids without any
        def possible(low: Column) -> Column:
            ok = _named(low, words) & (sure | ~i.rlike(r"^[!-~]+\z") | ~_other(low, i))
            return ok if most_skills >= MANY_SKILLS else ok & (sure | ~_stranger(low, i, company, stop))

        return F.when(let(F.lower(blank(raw, "")), possible), let(normalize(raw), lambda t: let(F.lower(t), lambda low: read(i, raw, words, t, low))))

    def read(i: Column, raw: Column, words: Column, t: Column, low: Column) -> Column:
        row = lambda strange: F.struct(t.alias("normal"), lines_of(raw, low).alias("raw"), _brief(t).alias("brief"), strange.alias("strange"))
        strange = ~sure & _stranger(low, i, company, stop) if most_skills >= MANY_SKILLS else F.lit(False)
        return F.when(_titled(t, low, words) & (sure | ~_other(low, i)), row(strange))

    return let(F.struct(_id(job_id).alias("i"), text.alias("text"), _title_words(title).alias("words")), lambda x: of(x["i"], x["text"], x["words"]))


def likely_settled(brief: Column, strange: Column, n_skills: Column, constraints: Column) -> Column:
    """Whether a likely posting is the job's, by what its text says."""
    return (~brief | _says_enough(n_skills, constraints)) & (~strange | (n_skills >= MANY_SKILLS))


def found_jobs(jobs: DataFrame, hints: DataFrame, page: str = "page") -> DataFrame:
    """For each hint (page, hint, hint_id, hint_title) the job (page, row_index, job_id, title, row_text) of its page that it
    means, and how it was found: 0 by the same id, 1 by the id as a word of the row, 2 by a title that has the hinted one,
    3 by one that the hinted one has. The best way counts, then the first row; a hint that means none has nulls.

    Rows are joined by page and meet in a minimum, so a page's rows are never brought together."""
    tidy = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    mine = jobs.select(page, "row_index", tidy("job_id").alias("_id"), normalize("row_text").alias("_text"), title_key("title").alias("_key"))
    asked = hints.select(page, "hint", tidy("hint_id").alias("_want"), title_key("hint_title").alias("_title"))
    asked = asked.withColumn("_word", F.concat(F.lit(r"\b"), F.regexp_replace("_want", r"([.*+?^${}()|\[\]\\])", r"\\$1"), F.lit(r"\b")))
    named, titled = F.col("_want") != "", F.col("_title") != ""
    way = (
        F.when(named & (F.col("_id") == F.col("_want")), 0).when(named & F.contains("_text", "_want") & F.regexp_like("_text", F.col("_word")), 1)
        .when(titled & F.contains("_key", "_title"), 2).when(titled & F.contains("_title", "_key"), 3)
    )
    # a minimum for each way rather than one of pairs, which would sort all pairs of a page's hints and rows
    pairs = asked.join(mine, page, "left").select(page, "hint", "row_index", way.alias("_way"))
    best = pairs.groupBy(page, "hint").agg(*(F.min(F.when(F.col("_way") == k, F.col("row_index"))).alias(f"_{k}") for k in range(4)))
    first = F.coalesce(*(F.when(F.col(f"_{k}").isNotNull(), k) for k in range(4)))
    return best.select(page, "hint", F.coalesce(*(F.col(f"_{k}") for k in range(4))).alias("row_index"), first.cast("int").alias("way"))


# Words that tell no company apart in a page's section, and what a title in it is worth in characters.
SECTION_WORDS = "inc ltd corp company division office group solutions technologies systems".split()
TITLE_BOOST = 4000


def section_matches(text: Column | str, job_id: Column | str, title: Column | str, company: Column | str) -> Column:
    """Whether a section of a page is about a listed job: it has the job's id; else, unless it has other ids only, words of
    the title and of the company that tell them apart."""

    def about(low: Column) -> Column:
        i = F.trim(blank(job_id, ""))
        numbers = F.slice(F.regexp_extract_all(low, F.lit(r"(?<![A-Za-z0-9_])\d{5,8}(?![A-Za-z0-9_])"), 0), 1, 36)
        other = (i != "") & (F.size(numbers) > 0) & ~F.array_contains(numbers, i)
        words, telling = _telling(title, TITLE_WORDS)
        keys = F.when(F.size(telling) > 0, telling).otherwise(words)
        titled = (F.size(keys) > 0) & (F.size(F.filter(keys, lambda w: F.contains(low, w))) >= F.when(F.size(keys) >= 4, 2).otherwise(1))
        _, firm = _telling(company, SECTION_WORDS)
        named = (F.size(firm) == 0) | F.exists(firm, lambda w: F.contains(low, w))
        return (low != "") & (((i != "") & F.contains(low, F.lower(i))) | (~other & titled & named))

    return let(F.lower(blank(text, "")), about)


def found_sections(jobs: DataFrame, sections: DataFrame, page: str = "page") -> DataFrame:
    """For each job (page, row_index, job_id, title, company) the section (page, section, text, visible) of its page that
    holds its posting: visible ones before others, then the longest, where the job's title counts as TITLE_BOOST
    characters, then the first; null where none does. Only numbers of sections reach the aggregate."""
    texts = sections.select(page, "section", F.coalesce("visible", F.lit(False)).alias("_seen"), normalize("text").alias("_text")).filter(looks_like_posting("_text"))
    both = jobs.select(page, "row_index", "job_id", "title", "company").join(texts, page, "left")
    named = F.lower(normalize("title"))
    length = F.length("_text") + F.when((named != "") & F.contains(F.lower("_text"), named), TITLE_BOOST).otherwise(0)
    rank = F.when(section_matches("_text", "job_id", "title", "company"), F.struct(F.col("_seen"), length.alias("n"), (-F.col("section")).alias("s")))
    return both.groupBy(page, "row_index").agg(F.max(rank).alias("_best")).select(page, "row_index", (-F.col("_best.s")).alias("section"))


def page_type(title: Column | str, path: Column | str, query: Column | str, body: Column | str, links: Column | int = 0, site: str = "") -> Column:
    """ratings, posting, listings or unknown. site: the host's own name in titles of listings, if it has one."""
    t, b, p = F.lower(blank(title, "")), F.lower(blank(body, "")), F.lower(blank(path, ""))
    url = F.concat_ws(" ", p, F.lower(blank(query, "")))
    ratings = t.rlike(r"work\s*term\s*ratings|ratings") | (F.contains(b, F.lit("students hired")) & F.contains(b, F.lit("work term"))) | F.contains(p, F.lit("worktermratings"))
    posting = t.rlike(r"job\s*posting|position\s*description") | url.rlike(r"jobid=|postingid=|/posting/") | p.rlike(r"/job/|/posting/")
    listed_title = t.rlike(r"job\s*list|my\s*applications" + (f"|{site}" if site else "")) & b.rlike("job|posting|co-op")
    listings = listed_title | p.rlike(r"/myaccount/co-op|/co-op/|/jobs") | url.rlike(r"/jobs|/postings|search") | ((F.lit(links) if isinstance(links, int) else links) >= 8)
    return F.when(ratings, "ratings").when(posting, "posting").when(listings, "listings").otherwise("unknown")


def supported_listing(path: Column | str, body: Column | str, has_table: Column) -> Column:
    p = F.lower(blank(path, ""))
    named = p.rlike(r"/myaccount/co-op/(direct|fullcycle|full-cycle)/jobs\.htm|/myaccount/co-op/.*jobs")
    return F.contains(p, F.lit("/myaccount/co-op/")) & (named | (has_table & F.lower(blank(body, "")).rlike("(job search|job title|organization|openings)")))


SUBMITTED = r"(successfully submitted|application submitted|thank you for applying|your application has been received|submission complete)"


def submitted(text: Column | str) -> Column:
    low = F.lower(blank(text, ""))
    return (F.length(low) >= 40) & low.rlike(SUBMITTED)


def feature_enabled(name: str, flags: Column) -> Column:
    """A switch: smartOverlay is on unless it is off, the others are off unless they are on."""
    v = F.get_json_object(flags, f"$.{name}")
    return F.coalesce(v != "false", F.lit(True)) if name == "smartOverlay" else F.coalesce(v == "true", F.lit(False))


def page_enabled(enabled: Column | str, disabled_paths: Column | str, path: Column | str, hide_unsupported: Column, supported: Column) -> Column:
    return F.coalesce(col(enabled), F.lit(True)) & ~F.coalesce(F.array_contains(col(disabled_paths), col(path)), F.lit(False)) & ~(hide_unsupported & ~supported)


def user_facing(url: Column | str, probe: str = "probe") -> Column:
    """Whether a page is one that a person sees, not one opened to be read."""
    return ~matches(F.coalesce(F.parse_url(col(url), F.lit("QUERY")), F.lit("")), rf"(^|&){probe}=1(&|$)")
