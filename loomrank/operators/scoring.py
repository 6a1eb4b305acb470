"""Scores of postings for a person: skills, role, degree, term, viability, and what to do about it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomrank.functions.js import blank, clamp, col, constant, js_round, let, listed, matches, number, score
from loomrank.functions.lexicon import SKILLS, Skill
from loomrank.functions.text import normalize_token

from .dictionary import canonical, factor, has_skill, hits, is_technical, mention_weights, profile_fields, resolve_all, skills_in

TEXTS = "array<string>"


@dataclass(frozen=True)
class Profile:
    """Who the scores are for."""

    skills: tuple[str, ...] = ()
    resume_text: str = ""
    work_term: int = 1
    faculty: str = "Engineering"
    target_role: str = ""
    industries: tuple[str, ...] = field(default=())
    term_length: str = "4"

    def owned(self, skills: Sequence[Skill] = SKILLS) -> Column:
        return canonical(F.array(*map(F.lit, self.skills)).cast(TEXTS), skills)


def _none() -> Column:
    return F.array().cast(TEXTS)


def _sum(a: Column, value) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda n, x: n + value(x))


def _count(a: Column, keep) -> Column:
    return F.size(F.filter(a, keep))


def line_coverage(lines: Column | str, owned: Column, required: bool, skills: Sequence[Skill] = SKILLS) -> Column:
    """How far the skills that lines name are owned, 0 to 100; null where no line names any. A line that offers a choice
    is satisfied by one of its skills."""

    def read(line: Column, named: Column) -> Column:
        n, have = F.size(named), _count(named, lambda k: has_skill(owned, k))
        choice = matches(F.lower(line), r"\bor\b|and/or|/") & (n > 1)
        part = F.when(n == 0, 0.0).when(choice, (have > 0).cast("double")).otherwise(have / n)
        weight = F.when(n > 0, (2.2 if required else 1.1) + F.least(F.lit(0.8), n * 0.14)).otherwise(0.0)
        return F.struct(weight.alias("weight"), part.alias("part"))

    def of(rows: Column) -> Column:
        total = _sum(rows, lambda r: r["weight"])
        return F.when(total > 0, _sum(rows, lambda r: r["weight"] * r["part"]) / total * 100)

    return let(F.transform(F.coalesce(col(lines), _none()), lambda line: let(skills_in(F.trim(line), skills), lambda named: read(line, named))), of)


def skill_weights(required: Column, preferred: Column, text: Column | str, skills: Sequence[Skill] = SKILLS) -> Column:
    """Array of (key, weight): what each skill of a posting counts. required, preferred: resolved keys."""
    known = constant([s.key for s in skills], TEXTS)
    return let(mention_weights(text, skills), lambda m: _weights(m, required, preferred, known, skills))


def _weights(mentions: Column, required: Column, preferred: Column, known: Column, skills: Sequence[Skill]) -> Column:
    def explicit(base: float):
        def of(k: Column) -> Column:
            m = F.get(F.filter(mentions, lambda x: x["key"] == k), F.lit(0))
            named = F.when(F.array_contains(known, k), F.least(F.lit(2.4), F.coalesce(m["hits"], F.lit(0)) * 0.28)).otherwise(0.0)
            return F.struct(k.alias("key"), (base * factor(k, skills) + named + F.least(F.lit(1.25), F.coalesce(m["weight"], F.lit(0.0)) * 0.3)).alias("weight"))

        return of

    # without explicit skills those of the text count, lightly
    inferred = F.transform(mentions, lambda x: F.struct(x["key"].alias("key"), F.least(F.lit(2.2), x["weight"]).alias("weight")))
    stated = F.concat(F.transform(required, explicit(5.2)), F.transform(preferred, explicit(1.65)))
    return F.when(F.size(required) + F.size(preferred) > 0, stated).otherwise(inferred)


def posting_weights(required: Column | str, preferred: Column | str, text: Column | str, skills: Sequence[Skill] = SKILLS) -> Column:
    """skill_weights of a posting's skills as they stand."""
    return let(resolve_all(required, skills), lambda need: skill_weights(need, F.array_except(resolve_all(preferred, skills), need), text, skills))


def skill_match(
    owned_skills: Column, required: Column | str, preferred: Column | str, text: Column | str, required_lines: Column | str | None = None,
    preferred_lines: Column | str | None = None, skills: Sequence[Skill] = SKILLS, weights: Column | None = None,
) -> Column:
    """How well owned skills (keys as typed) meet a posting, 0 to 100. weights: posting_weights, where a column has them;
    a column is worked out once, an expression at each of its uses."""
    weights = posting_weights(required, preferred, text, skills) if weights is None else weights

    def of(w: Column, owned: Column) -> Column:
        total = _sum(w, lambda x: x["weight"])
        base = _sum(F.filter(w, lambda x: has_skill(owned, x["key"])), lambda x: x["weight"]) / total * 100
        for lines, is_required, share in ((required_lines, True, 0.2), (preferred_lines, False, 0.1)):
            if lines is not None:
                # a null coverage leaves the base as it is
                covered = line_coverage(lines, owned, is_required, skills)
                base = let(F.struct(base.alias("base"), covered.alias("covered")), lambda x, s=share: F.coalesce(x["base"] * (1 - s) + x["covered"] * s, x["base"]))
        technical = F.filter(resolve_all(required, skills), lambda k: is_technical(k, skills))
        shared = let(technical, lambda t: F.when(F.size(t) >= 3, _count(t, lambda k: has_skill(owned, k)) / F.size(t)))
        floor = let(shared, lambda s: F.when(s >= 0.75, 44 + s * 50).when(s >= 0.55, 32 + s * 44))
        overlap = let(F.lower(blank(text, "")), lambda low: F.least(F.lit(100), 8 * _count(col(owned_skills), lambda s: F.contains(low, F.lower(s)))))
        return F.when(F.size(w) == 0, overlap).when(total <= 0, 0).otherwise(score(F.greatest(base, floor))).cast("int")

    return let(weights, lambda w: let(canonical(owned_skills, skills), lambda owned: of(w, owned)))


def coverage(owned: Column, wanted: Column) -> Column:
    """(matched, total, ratio) of wanted skills, null for none."""
    n = F.size(wanted)
    have = _count(wanted, lambda k: has_skill(owned, k))
    return F.when(n > 0, F.struct(have.alias("matched"), n.alias("total"), (have / n).alias("ratio")))


def similarity_percent(s: Column | str) -> Column:
    x = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), number(s)))
    return F.when(x <= 0, js_round((x + 1) * 18)).otherwise(js_round(18 + x * 82)).cast("int")


def cosine(a: Column | str, b: Column | str) -> Column:
    """The cosine of unit vectors, from -1 to 1; 0 where their lengths differ."""
    dot = F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda n, x: n + x)
    same = (F.size(col(a)) == F.size(col(b))) & (F.size(col(a)) > 0)
    return F.when(same, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))).otherwise(0.0)


def resume_text_match(owned_skills: Column, text: Column | str, role: Column | str, skills: Sequence[Skill] = SKILLS) -> Column:
    """The share of the first 120 owned skills that a text names; a named role or any common word of the trade lifts it."""
    own = F.slice(F.array_sort(F.filter(col(owned_skills), lambda s: s != "")), 1, 120)
    return let(F.lower(blank(text, "")), lambda low: let(own, lambda o: _text_match(low, o, F.lower(F.trim(blank(role, ""))), skills)))


def _text_match(low: Column, own: Column, r: Column, skills: Sequence[Skill]) -> Column:
    known = constant([s.key for s in skills], TEXTS)
    seen = F.struct(F.transform(hits(low, skills), lambda h: h["key"]).alias("named"), F.concat(F.lit(" "), F.regexp_replace(low, r"[^a-z0-9_#+.]+", " "), F.lit(" ")).alias("spaced"))
    lone = lambda x, s: ~F.array_contains(known, s) & F.contains(x["spaced"], F.concat(F.lit(" "), normalize_token(s), F.lit(" ")))
    have = let(seen, lambda x: _count(own, lambda s: F.array_contains(x["named"], s) | lone(x, s)))
    base = have / F.size(own) * 100
    base = F.greatest(base, F.when((r != "") & F.contains(low, r), 35.0), F.when(low.rlike("(software|developer|engineer|analyst|data|ml|qa|test|product)"), 22.0))
    return F.when((F.size(own) == 0) | (low == ""), 0).otherwise(score(base)).cast("int")


def blended(base: Column | str, keyword: Column | str, n_required: Column, n_preferred: Column, n_bullets: Column) -> Column:
    """Skill match and keyword match as one: the more structure a posting has, the more the first counts."""
    b, k = clamp(base, 0, 100), clamp(keyword, 0, 100)
    n = n_required + n_preferred
    rich = (n >= 6) | ((n_required >= 4) & (n_bullets >= 3))
    mixed = F.when(rich, js_round(b * 0.88 + k * 0.12)).when(n >= 3, js_round(b * 0.78 + k * 0.22)).otherwise(js_round(b * 0.55 + k * 0.45))
    floor = F.when(b >= 75, js_round(b * 0.94)).when(b >= 60, js_round(b * 0.88)).when(b >= 45, js_round(b * 0.82))
    return score(F.greatest(mixed, floor, F.when((b <= 6) & (k > 0), js_round(k * 0.8))))


TECH_ROLE = r"(software|developer|engineer|full[- ]?stack|frontend|backend|data|ml|ai|qa|test)"
BUSINESS_TITLE = r"(sales|marketing|communications?|business development|account manager|customer success|recruit|hr|human resources)"


def role_match(title: Column | str, text: Column | str, targets: Column | str) -> Column:
    """The best match of a posting with a comma-separated list of roles; 50 without any."""
    roles = F.filter(F.transform(F.split(F.lower(blank(targets, "")), ","), lambda x: F.trim(x)), lambda r: r != "")
    said = F.struct(F.lower(blank(title, "")).alias("title"), F.lower(blank(text, "")).alias("text"))
    return let(said, lambda x: let(roles, lambda r: _role_match(x["title"], x["text"], r)))


def _role_match(t: Column, body: Column, roles: Column) -> Column:
    def of(r: Column) -> Column:
        return let(F.filter(F.split(r, "[^a-z0-9]+"), lambda w: F.length(w) >= 3), lambda words: one(r, words))

    def one(r: Column, words: Column) -> Column:
        n = F.size(words)
        in_title, in_text = _count(words, lambda w: F.contains(t, w)), _count(words, lambda w: F.contains(body, w))
        got = (
            F.when(F.contains(t, r), 95).when((n > 0) & (in_title == n), 78).when(F.contains(body, r), 68)
            .when(n > 0, js_round(F.greatest(in_title, in_text) / n * 62)).otherwise(0)
        )
        return got - F.when(r.rlike(TECH_ROLE) & t.rlike(BUSINESS_TITLE), 38).otherwise(0)

    return F.when(F.size(roles) == 0, 50).otherwise(score(F.greatest(F.lit(0), F.array_max(F.transform(roles, of))))).cast("int")


# Words of advanced studies, and of faculties that name no field.
DOCTORAL, GRADUATE, GRADUATE_FACULTY = r"(ph\.?d|doctoral|doctorate)", r"(master'?s|msc|m\.?eng|masc|graduate student|grad student)", r"(master'?s|graduate)"
FACULTY_FIELDS = {"eng": "engineering", "math": "mathematics", "sci": "science", "art": "arts", "env": "environment", "health": "health"}


def academic(resume: Column | str, faculty: Column | str) -> Column:
    """(is_phd, is_graduate, fields) of a person."""
    r, f = F.lower(blank(resume, "")), F.lower(blank(faculty, ""))
    phd = r.rlike(DOCTORAL) | f.rlike(DOCTORAL)
    named = profile_fields(F.concat_ws(" ", f, r))
    fallback = listed([(F.contains(f, F.lit(k)), v) for k, v in FACULTY_FIELDS.items()])
    return F.struct(phd.alias("is_phd"), (phd | r.rlike(GRADUATE) | f.rlike(GRADUATE_FACULTY)).alias("is_graduate"), F.when(F.size(named) > 0, named).otherwise(fallback).alias("fields"))


def degree_alignment(required: Column | str, preferred: Column | str, fields: Column) -> Column:
    """(score, required_mismatch, preferred_mismatch)."""
    need, like = F.coalesce(col(required), _none()), F.coalesce(col(preferred), _none())
    meets = lambda a: F.coalesce(F.arrays_overlap(a, fields), F.lit(False))
    base = F.when(F.size(need) == 0, 50).when(meets(need), 85).otherwise(15) + F.when(F.size(like) == 0, 0).when(meets(like), 12).otherwise(-18)
    return F.struct(score(base).alias("score"), ((F.size(need) > 0) & ~meets(need)).alias("required_mismatch"), ((F.size(like) > 0) & ~meets(like)).alias("preferred_mismatch"))


def term_compatibility_of_constraints(c: Column, term: Column | int, posting_page: bool = False) -> Column:
    """Whether a work term suits a posting's restriction. On a posting's own page a named term counts for it."""
    t = F.lit(term) if isinstance(term, int) else term
    numbers = F.transform(F.regexp_extract_all(F.coalesce(c["term_restriction"], F.lit("")), F.lit(r"\d+"), 0), lambda x: x.cast("int"))
    out = F.when((F.size(numbers) > 0) & ~F.array_contains(numbers, t), 20)
    if posting_page:
        out = out.when(F.size(numbers) > 0, 85)
    return F.when(c.isNull(), 50).otherwise(F.coalesce(out, F.when(c["first_year_completion"], F.when(t <= 2, 90 if posting_page else 85).otherwise(45)).otherwise(60)))


def label_term(label: Column | str) -> Column:
    return F.nullif(F.regexp_extract(blank(label, ""), "([1-9])", 1), F.lit("")).cast("int")


def term_compatibility(term: Column, dist: Column | str) -> Column:
    """dist: array of (label, percent), in order."""
    d = F.filter(F.coalesce(col(dist), F.expr("cast(array() as array<struct<label:string,percent:double>>)")), lambda x: x.isNotNull())
    top = F.greatest(F.lit(0.0), F.array_max(F.transform(d, lambda x: number(x["percent"]))))
    share = number(F.get(F.filter(d, lambda x: label_term(x["label"]) == term), F.lit(0))["percent"])
    relative = F.when(top > 0, share / top).otherwise(0.0)
    return F.when(term.isNull() | (term < 1) | (F.size(d) == 0), 50).when(share <= 0, 15).otherwise(score(30 + share * 1.8 + relative * 20)).cast("int")


def faculty_alignment(faculty: Column | str, dist: Column | str) -> Column:
    f = F.lower(blank(faculty, ""))
    d = F.coalesce(col(dist), F.expr("cast(array() as array<struct<label:string,percent:double>>)"))
    top = F.greatest(F.lit(0.0), F.array_max(F.transform(d, lambda x: number(x["percent"]))))
    fits = lambda x: F.contains(F.lower(blank(x["label"], "")), f) | F.contains(f, F.lower(blank(x["label"], "")))
    share = F.greatest(F.lit(0.0), F.array_max(F.transform(F.filter(d, fits), lambda x: number(x["percent"]))))
    relative = F.when(top > 0, share / top).otherwise(0.0)
    return F.when((f == "") | (F.size(d) == 0), 50).when(share <= 0, 25).otherwise(score(35 + share * 1.2 + relative * 25)).cast("int")


def selectivity_of(average: Column, slope: Column) -> Column:
    """From the average of hires and their trend: -20 to 20; 0 without hires."""
    level = F.when(average >= 20, 20).when(average >= 12, 10).when(average >= 6, 0).when(average >= 3, -10).otherwise(-20)
    trend = F.when(slope > 0.7, 5).when(slope < -0.7, -5).otherwise(0)
    return F.when(average.isNull(), 0).otherwise(F.greatest(F.lit(-20), F.least(F.lit(20), level + trend))).cast("int")


def viability(skill: Column | str, term: Column | str, faculty: Column | str, selectivity: Column | str | int = 0) -> Column:
    """(score, skill_match, term_compatibility, faculty_alignment, selectivity, weighted_base)."""
    s, t, f = clamp(skill, 0, 100), clamp(term, 0, 100), clamp(faculty, 0, 100)
    x = clamp(F.lit(selectivity) if isinstance(selectivity, int) else selectivity, -20, 20)
    base = s * 0.5 + t * 0.25 + f * 0.15
    return F.struct(score(base + x).alias("score"), s.alias("skill_match"), t.alias("term_compatibility"), f.alias("faculty_alignment"), x.alias("selectivity"), js_round(base).cast("int").alias("weighted_base"))


# What a score advises, and the reasons given.
LABELS = [(80, "Apply aggressively"), (65, "Apply if you have exceptional projects"), (50, "Apply as a reach"), (35, "Better suited next term")]
LAST_LABEL, BLOCKED_LABEL = "Consider alternative divisions", "Do not apply"
BLOCKED_REASON = "Posting has a hard eligibility requirement that does not match your profile."
REASONS = {
    "term_share_zero": "Historical hires for your work-term level appear near zero.",
    "faculty_weak": "Faculty alignment is weak in available hiring history.",
    "role_mismatch": "Target role alignment is weak for this posting.",
    "field_mismatch_required": "Required degree field appears misaligned with your profile.",
    "field_mismatch_preferred": "Preferred degree field leans away from your profile.",
    "eight_month": "Posting appears to prefer an 8-month commitment.",
    "high_skill_match": "Your resume aligns strongly with listed technical requirements.",
    "low_skill_match": "Skill match is low relative to required qualifications.",
}
FAVORABLE, RISKY = "Composite overall match is favorable compared to baseline.", "Composite overall match indicates elevated mismatch risk."


def recommend(value: Column | str, flags: dict[str, Column] | None = None, hard: Column | None = None, hard_reasons: Column | None = None) -> Column:
    """(label, reasons): at most two reasons. flags: by the names of REASONS."""
    v, flags = clamp(value, 0, 100), dict(flags or {})
    if "field_mismatch_preferred" in flags and "field_mismatch_required" in flags:
        flags["field_mismatch_preferred"] = flags["field_mismatch_preferred"] & ~flags["field_mismatch_required"]
    label = F.lit(LAST_LABEL)
    for least, name in reversed(LABELS):
        label = F.when(v >= least, F.lit(name)).otherwise(label)
    given = listed([(flags[k], text) for k, text in REASONS.items() if k in flags]) if flags else _none()
    filler = F.when(F.size(given) < 2, listed([(v >= 70, FAVORABLE), (v < 50, RISKY)])).otherwise(_none())
    reasons = F.slice(F.concat(given, filler), 1, 2)
    if hard is None:
        return F.struct(label.alias("label"), reasons.alias("reasons"))
    why = F.coalesce(hard_reasons, _none()) if hard_reasons is not None else _none()
    why = F.slice(F.when(F.size(why) > 0, why).otherwise(F.array(F.lit(BLOCKED_REASON))), 1, 2)
    return F.struct(F.when(hard, F.lit(BLOCKED_LABEL)).otherwise(label).alias("label"), F.when(hard, why).otherwise(reasons).alias("reasons"))


def role_preference(text: Column | str, role: Column | str) -> Column:
    r = F.lower(blank(role, ""))
    return F.when((r != "") & F.contains(F.lower(blank(text, "")), r), 12).otherwise(0)


def industry_preference(text: Column | str, industries: Column) -> Column:
    names = F.transform(industries, lambda x: F.trim(F.lower(x)))
    return let(F.lower(blank(text, "")), lambda low: F.least(F.lit(16), 4 * _count(names, lambda x: (x != "") & F.contains(low, x))))


def term_length_preference(c: Column, preferred: Column | str) -> Column:
    """How a posting's term length suits a preference for 4 or 8 months, or either."""
    yes = lambda n: F.coalesce(c[n], F.lit(False))
    p = F.lit(preferred) if isinstance(preferred, str) else preferred
    four, eight = yes("accepts_four"), yes("accepts_eight")

    def side(own: str, other: str, accepts: Column, others: Column, length: int) -> Column:
        return (
            F.when(yes(f"{own}_month_required"), 12).when(yes(f"{own}_month_preferred") & accepts, 10).when(accepts & others, 7).when(accepts, 8)
            .when(yes(f"{other}_month_required") | (others & ~accepts) | F.coalesce(c["work_term_length"] == length, F.lit(False)), -14).otherwise(0)
        )

    return F.when(c.isNull(), 0).when(p == "either", 2).when(p == "8", side("eight", "four", eight, four, 4)).when(p == "4", side("four", "eight", four, eight, 8)).otherwise(0)


