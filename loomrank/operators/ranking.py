"""Analysing, ranking and summarising postings for a person."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomrank.functions.js import blank, col, score
from loomrank.functions.lexicon import SKILLS, Skill

from . import eligibility, scoring, semantic
from .posting import parse
from .scoring import Profile


def _text(c: str, most: int | None = None) -> Column:
    t = blank(c, "")
    return F.substring(t, 1, most) if most else t


def analyze(jobs: DataFrame, profile: Profile, text: str = "snippet", skills: Sequence[Skill] = SKILLS, use_semantic: bool = False, bullets: str | None = None) -> DataFrame:
    """Adds to jobs (title, company, location, snippet and the text column to parse) all scores and decisions."""
    df = parse(jobs, text, bullets, skills)
    own = F.array(*map(F.lit, profile.skills)).cast("array<string>")
    body = F.concat_ws(" ", _text("title"), _text("company"), _text("location"), _text("snippet"), _text("full_text", 2500))
    boost = F.concat_ws(" ", _text("title"), _text("company"), _text("location"), _text("snippet"), _text("full_text", 1200))
    df = df.withColumn("_weights", scoring.posting_weights("required_skills", "preferred_skills", "full_text", skills))
    df = df.withColumn("base_skill_match", scoring.skill_match(own, "required_skills", "preferred_skills", "full_text", "required_sentences", "preferred_sentences", skills, F.col("_weights"))).drop("_weights")
    if use_semantic:
        near = semantic.semantic_match(own, F.lit(profile.resume_text), "required_skills", "preferred_skills", "required_sentences", "preferred_sentences", "full_text", "title", F.lit(profile.target_role), skills)
        df = df.withColumn("_semantic", near).withColumn("semantic_skill_match", F.col("_semantic")["score"])
        df = df.withColumn("_skill", semantic.hybrid("base_skill_match", "_semantic")).drop("_semantic")
    else:
        df = df.withColumns({"semantic_skill_match": F.lit(None).cast("int"), "_skill": F.col("base_skill_match")})
    df = df.withColumns({"_body": body, "_boost": boost})
    df = df.withColumn("keyword_skill_match", scoring.resume_text_match(own, "_body", F.lit(profile.target_role), skills))
    sizes = [F.size("required_skills"), F.size("preferred_skills"), F.col("meta")["section_bullets"]]
    df = df.withColumns({"skill_match": scoring.blended("_skill", "keyword_skill_match", *sizes), "target_role_match": scoring.role_match("title", "_body", F.lit(profile.target_role))})
    c = F.col("constraints")
    person = scoring.academic(F.lit(profile.resume_text), F.lit(profile.faculty))
    df = df.withColumns({"_person": person, "_field": scoring.degree_alignment(c["required_degree_fields"], c["preferred_degree_fields"], person["fields"])})
    term = scoring.term_compatibility_of_constraints(c, profile.work_term)
    df = df.withColumn("viability", scoring.viability("skill_match", term, F.col("_field")["score"]))
    return _decided(df, profile, c, listing=True)


def _decided(df: DataFrame, profile: Profile, c: Column, listing: bool) -> DataFrame:
    field = F.col("_field")
    overall = F.col("skill_match") * 0.55 + F.col("target_role_match") * 0.3 + F.col("viability")["score"] * 0.15
    overall = overall - F.when(field["preferred_mismatch"], 8).otherwise(0) - F.when(field["required_mismatch"], 38).otherwise(0)
    if listing:
        overall = overall - F.when((F.col("target_role_match") < 30) & (F.col("skill_match") < 50), 12).otherwise(0)
    df = df.withColumns({"overall_match": score(overall), "hard_reasons": eligibility.hard_reasons(c, profile.work_term, F.col("_person")), "flags": eligibility.constraint_labels(c)})
    df = df.withColumn("hard", F.size("hard_reasons") > 0)
    if listing:
        boosts = scoring.role_preference("_boost", F.lit(profile.target_role)) + scoring.term_length_preference(c, profile.term_length)
        boosts = boosts + scoring.industry_preference("_boost", F.array(*map(F.lit, profile.industries)).cast("array<string>"))
        raw = F.col("overall_match") * 0.72 + F.col("viability")["score"] * 0.16 + boosts
        df = df.withColumn("ranking_score", F.when(F.col("hard"), F.greatest(F.lit(0.0), raw - 70)).otherwise(raw))
    flags = {
        "role_mismatch": F.col("target_role_match") < 45, "field_mismatch_required": field["required_mismatch"], "field_mismatch_preferred": field["preferred_mismatch"],
        "eight_month": F.coalesce(c["eight_month_preferred"], F.lit(False)) & F.lit(profile.term_length == "4"),
        "high_skill_match": F.col("skill_match") >= 70, "low_skill_match": F.col("skill_match") < 45,
    }
    df = df.withColumn("recommendation", scoring.recommend("overall_match", flags, F.col("hard"), F.col("hard_reasons")))
    fields = {"field_score": field["score"], "req_mismatch": field["required_mismatch"], "pref_mismatch": field["preferred_mismatch"]}
    return df.withColumns(fields).drop("_skill", "_body", "_boost", "_person", "_field")


def analyze_page(postings: DataFrame, profile: Profile, text: str = "text", skills: Sequence[Skill] = SKILLS) -> DataFrame:
    """Scores of single posting pages: as analyze, but a named term counts for the posting, nothing is blended in and
    there is no ranking."""
    df = parse(postings, text, None, skills)
    own = F.array(*map(F.lit, profile.skills)).cast("array<string>")
    c = F.col("constraints")
    person = scoring.academic(F.lit(profile.resume_text), F.lit(profile.faculty))
    df = df.withColumns({"skill_match": scoring.skill_match(own, "required_skills", "preferred_skills", "full_text", "required_sentences", "preferred_sentences", skills), "_person": person})
    df = df.withColumns({"target_role_match": scoring.role_match("title", "full_text", F.lit(profile.target_role)), "_field": scoring.degree_alignment(c["required_degree_fields"], c["preferred_degree_fields"], person["fields"])})
    term = scoring.term_compatibility_of_constraints(c, profile.work_term, posting_page=True)
    df = df.withColumn("viability", scoring.viability("skill_match", term, F.col("_field")["score"]))
    return _decided(df, profile, c, listing=False)


def eligible(analysis: DataFrame, profile: Profile) -> DataFrame:
    """The postings that suit the term preference and rule the person in."""
    return eligibility.term_filter(analysis, profile.term_length).filter(~F.col("hard"))


def hidden_counts(analysis: DataFrame, profile: Profile) -> DataFrame:
    """How many postings are hidden, and why."""
    term = eligibility.term_eligibility(F.col("constraints"), profile.term_length)
    why = F.when(~term["eligible"], term["reason"]).when(F.col("hard"), F.lit("Hard eligibility requirement"))
    return analysis.select(why.alias("reason")).filter("reason is not null").groupBy("reason").agg(F.count("*").alias("hidden"))


def ranked(df: DataFrame, most: int | None = None, by: str = "ranking_score", tie: str = "row_index") -> DataFrame:
    """By rank, ties in their first order. With a limit this is a top-k of each task and one of those; without, a global
    sort by ranges. Neither brings all rows to one task."""
    out = df.orderBy(F.desc(by), tie)
    return out.limit(most) if most else out


# Tiers, the least overall match of each and how many are shown.
TIERS = [("Apply Now", 68, 10), ("Worth Applying", 42, 10), ("Low Priority", 0, 5)]


def tier(overall: Column | str) -> Column:
    out = F.lit(TIERS[-1][0])
    for name, least, _ in reversed(TIERS[:-1]):
        out = F.when(col(overall) >= least, F.lit(name)).otherwise(out)
    return out


def top_of_tiers(df: DataFrame, tie: str = "row_index") -> DataFrame:
    """The best of each tier, numbered. Each tier is a top-k of its own, so no tier is sorted in one task."""
    parts = [ranked(df.filter(~F.col("hard")).withColumn("tier", tier("overall_match")).filter(F.col("tier") == name), most, tie=tie) for name, _, most in TIERS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # at most 25 rows are left to number
    return out.withColumn("place", F.row_number().over(W.partitionBy("tier").orderBy(F.desc("ranking_score"), tie)))


def histogram(df: DataFrame) -> DataFrame:
    m = F.col("overall_match")
    return df.agg(F.count_if(m >= 72).alias("strong"), F.count_if((m >= 45) & (m < 72)).alias("decent"), F.count_if(m < 45).alias("weak"))


def overview(df: DataFrame) -> DataFrame:
    """histogram and groups in one pass."""
    m, hard = F.col("overall_match"), F.col("hard")
    return df.agg(F.count_if(m >= 72).alias("strong"), F.count_if((m >= 45) & (m < 72)).alias("decent"), F.count_if(m < 45).alias("weak"), F.count_if(~hard & (m >= 68)).alias("strong_fit"), F.count_if(~hard & (m < 68)).alias("other"), F.count_if(hard).alias("blocked"))


def reconsider(df: DataFrame, most: int = 3, tie: str = "row_index") -> DataFrame:
    return ranked(df.filter("overall_match >= 30 and overall_match < 50 and target_role_match >= 50"), most, tie=tie)


def key_insights(df: DataFrame, owned: Sequence[str], most: int = 5, tie: str = "row_index") -> DataFrame:
    """The skills that postings ask for most, of those owned and of those not; ties by first appearance."""
    asked = df.select(F.posexplode("required_skills").alias("pos", "skill"), F.col(tie).alias("row"))
    counted = asked.groupBy("skill").agg(F.count("*").alias("n"), F.min(F.struct("row", "pos")).alias("first"))
    counted = counted.withColumn("owned", F.col("skill").isin(list(owned)) if owned else F.lit(False))
    # one row for each skill of the dictionary is left
    by = W.partitionBy("owned").orderBy(F.desc("n"), "first")
    return counted.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= most).select("owned", "place", "skill", "n")


def flag_counts(df: DataFrame, most: int = 8) -> DataFrame:
    return df.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "flag").limit(most)


def groups(df: DataFrame) -> DataFrame:
    m, hard = F.col("overall_match"), F.col("hard")
    return df.agg(F.count_if(~hard & (m >= 68)).alias("strong_fit"), F.count_if(~hard & (m < 68)).alias("other"), F.count_if(hard).alias("blocked"))


def skill_gap(df: DataFrame, owned: Sequence[str]) -> DataFrame:
    """What of the required and preferred skills is owned and missing."""
    own = F.array(*map(F.lit, owned)).cast("array<string>")
    missing = F.array_except("required_skills", own)
    return df.withColumns({"matched": F.array_intersect("required_skills", own), "missing": F.slice(missing, 1, 6), "preferred_shown": F.slice("preferred_skills", 1, 6)}).withColumn("matched_share", F.concat(F.size("matched").cast("string"), F.lit("/"), F.size("required_skills").cast("string")))


def insight(df: DataFrame, owned: Sequence[str]) -> DataFrame:
    """One line on each posting, and its tone."""
    own = F.array(*map(F.lit, owned)).cast("array<string>")
    missing, strong = F.array_except("required_skills", own), F.array_intersect("required_skills", own)
    m, n = F.col("overall_match"), F.size(missing)
    three = lambda a: F.array_join(F.slice(a, 1, 3), ", ")
    of = lambda text, tone: F.struct((F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(tone).alias("tone"))
    said = (
        F.when(F.col("hard"), of(F.coalesce(F.get("hard_reasons", F.lit(0)), F.lit("Hard eligibility block")), "danger"))
        .when((m >= 72) & (n == 0), of("Strong match — apply now", "good"))
        .when(m >= 72, of(F.concat(F.lit("Good fit, missing: "), three(missing)), "good"))
        .when((n > 0) & (n <= 3), of(F.concat(F.lit("Missing: "), F.array_join(missing, ", ")), "warn"))
        .when(n > 3, of(F.concat(F.lit("Missing "), n.cast("string"), F.lit(" skills: "), three(missing), F.lit("...")), "warn"))
        .when(F.size(strong) > 0, of(F.concat(F.lit("Strong in: "), three(strong)), "good"))
        .when(m >= 50, of("Decent match — worth exploring", ""))
        .otherwise(of("Weak match — consider as a reach", "danger"))
    )
    return df.withColumn("insight", said)


def overlay(df: DataFrame) -> DataFrame:
    """The summary that is shown beside a posting."""
    c = F.col("constraints")
    yes = lambda n: F.coalesce(c[n], F.lit(False))
    length = c["work_term_length"]
    label = (
        F.when((length == 8) | yes("eight_month_required"), "8 mo").when((length == 4) | yes("four_month_required"), "4 mo")
        .when(yes("eight_month_preferred"), "8 mo pref").when(yes("four_month_preferred"), "4 mo pref")
    )
    docs = F.filter(F.array(F.when(yes("cover_letter_required"), "cover letter").when(yes("cover_letter_recommended"), "cover letter?"), F.when(yes("transcript_required"), "transcript")), lambda x: x.isNotNull())
    chips = F.slice(F.array_distinct(F.concat(F.slice("required_skills", 1, 5), F.slice("preferred_skills", 1, 3))), 1, 6)
    return df.withColumn(
        "overlay",
        F.struct(
            F.lit(1).alias("version"), F.struct(*(blank(x, "").alias(x) for x in ("title", "company", "location"))).alias("summary"),
            F.struct("overall_match", "skill_match", "target_role_match").alias("scores"), F.col("recommendation")["label"].alias("recommendation"),
            F.struct(label.alias("term_label"), chips.alias("stack_chips"), F.slice("flags", 1, 6).alias("constraint_flags"), docs.alias("docs"), F.col("hard").alias("hard_block"), F.slice("hard_reasons", 1, 3).alias("hard_reasons")).alias("signals"),
        ),
    )


# How suggestions are worded.
FEW_GAPS, MANY_GAPS = ("Add a project featuring ", " to strengthen your match."), ("Focus on gaining experience in ", " — the most requested gaps.")
OTHER_ROLE = ('Tailor your resume title/objective to align with "', '".')


def card(df: DataFrame, owned: Sequence[str]) -> DataFrame:
    """What is shown of a selected posting: its heading, scores, strong and missing skills (8 of each), requirements (6, of
    120 characters at most), flags (5) and suggestions: on gaps, on the role, and the first reason unless said already."""
    own, none = F.array(*map(F.lit, owned)).cast("array<string>"), F.array().cast("array<string>")
    required, preferred = (F.coalesce(c, none) for c in ("required_skills", "preferred_skills"))
    missing, strong = F.array_except(required, own), F.array_intersect(F.array_distinct(F.concat(F.array_intersect(required, own), preferred)), own)
    between = lambda words, x: F.concat(F.lit(words[0]), x, F.lit(words[1]))
    n, title = F.size(missing), blank("title", "")
    gaps = F.when((n > 0) & (n <= 3), between(FEW_GAPS, F.array_join(missing, ", "))).when(n > 3, between(MANY_GAPS, F.array_join(F.slice(missing, 1, 2), " and ")))
    role = F.when((F.coalesce("target_role_match", F.lit(0)) < 40) & (title != ""), between(OTHER_ROLE, title))
    said = F.filter(F.array(gaps, role), lambda x: x.isNotNull())
    reason = F.filter(F.slice(F.coalesce(F.col("recommendation")["reasons"], none), 1, 1), lambda r: ~F.exists(F.col("_said"), lambda x: F.contains(x, F.substring(r, 1, 20))))
    short = lambda b: F.when(F.length(b) > 120, F.concat(F.substring(b, 1, 117), F.lit("…"))).otherwise(b)
    place = F.array_join(F.filter(F.array(blank("company", ""), blank("location", "")), lambda x: x != ""), " • ")
    shown = F.struct(
        blank("title", "Untitled").alias("title"), place.alias("place"), F.struct("skill_match", "target_role_match", "overall_match").alias("scores"),
        F.slice(strong, 1, 8).alias("strong"), F.slice(missing, 1, 8).alias("missing"), F.transform(F.slice(F.coalesce("summary_bullets", none), 1, 6), short).alias("requirements"),
        F.slice(F.coalesce("flags", none), 1, 5).alias("flags"), F.concat("_said", reason).alias("suggestions"),
    )
    return df.withColumn("_said", said).withColumn("card", shown).drop("_said")


def fit_class(overall: Column | str) -> Column:
    return F.when(col(overall) >= 72, "good").when(col(overall) >= 42, "warn").otherwise("bad")


def signature(jobs: DataFrame) -> DataFrame:
    """One value that changes where any listed job does: rows are hashed where they are, and hashes added up, so that
    order doesn't matter and nothing is collected."""
    row = F.xxhash64(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("url", "job_key", "title", "company", "location"))))
    return jobs.agg(F.count("*").alias("n_jobs"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("signature"))
