"""Following applications: keys of jobs, status from page texts, reconciliation; and what form fields ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrank.functions.js import blank, col, matches

# Parameters of an address that say nothing of the posting. Callers add the ones their pages use.
DROPPED = ("sessionId", "conversationId")


def posting_url(url: Column | str, dropped: tuple[str, ...] = DROPPED) -> Column:
    """An address without fragment and session parameters. What isn't an absolute address stays as it is, trimmed."""
    u = F.trim(blank(url, ""))
    bare = F.regexp_replace(u, r"#.*", "")
    head, query = F.substring_index(bare, "?", 1), F.when(F.contains(bare, F.lit("?")), F.regexp_replace(bare, r"^[^?]*\?", ""))
    name = lambda p: F.substring_index(p, "=", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~name(p).isin(*dropped))
    written = F.array_join(F.transform(kept, lambda p: F.replace(F.replace(p, F.lit("%20"), F.lit("+")), F.lit(" "), F.lit("+"))), "&")
    host = F.regexp_extract(head, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/]*)(.*)$", 1)
    path = F.regexp_extract(head, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/]*)(.*)$", 2)
    full = F.concat(F.lower(host), F.when(path == "", F.lit("/")).otherwise(path), F.when(query.isNotNull() & (written != ""), F.concat(F.lit("?"), written)).otherwise(""))
    return F.when(host != "", full).otherwise(u)


def job_key(job_id: Column | str, url: Column | str, fallback: Column | str) -> Column:
    """What a job is known by: its number, else its address, else a fallback."""
    i, f = F.trim(blank(job_id, "")), F.trim(blank(fallback, ""))
    u = posting_url(url)
    return F.when(i != "", F.concat(F.lit("jid:"), i)).when(u != "", F.concat(F.lit("url:"), u)).otherwise(F.concat(F.lit("fb:"), F.when(f != "", f).otherwise("unknown")))


def status_of(text: Column | str) -> Column:
    """interview, offer, rejected or null, from a row's text."""
    t = F.lower(blank(text, ""))
    return F.when(t.rlike("schedule|interview|screening"), "interview").when(matches(t, r"\boffer\b|extended an offer"), "offer").when(t.rlike("not selected|rejected|declined|cancelled|no longer|filled"), "rejected")


def reconcile(rows: DataFrame, applications: DataFrame) -> DataFrame:
    """Status changes that a page's rows (url, text, pos) show for known applications: application_id, status. Of several
    rows of a job the first counts."""
    first = rows.select(job_key(F.lit(""), "url", "url").alias("job_key"), "text", "pos").groupBy("job_key").agg(F.min_by("text", "pos").alias("text"))
    seen = first.select("job_key", status_of("text").alias("new_status")).filter("new_status is not null")
    # an application is found by its key: the first of equal ones
    known = applications.groupBy("job_key").agg(F.min_by(F.struct("id", "status"), F.struct("created_at", "id")).alias("a"))
    return seen.join(known, "job_key").filter("new_status <> a.status").select(F.col("a.id").alias("application_id"), "job_key", F.col("a.status").alias("was"), F.col("new_status").alias("status"))


def submissions(pages: DataFrame, now: Column | int) -> DataFrame:
    """A record for each page that confirms an application."""
    from .eligibility import submitted

    at = F.lit(now) if isinstance(now, int) else now
    key = job_key(F.lit(""), "url", "url")
    return pages.filter(submitted("text")).select(F.concat(F.lit("a-"), F.xxhash64("url", at).cast("string")).alias("id"), key.alias("job_key"), posting_url("url").alias("posting_url"), F.lit("applied").alias("status"), at.cast("bigint").alias("created_at"), at.cast("bigint").alias("updated_at"))


def tracker_page(body: Column | str) -> Column:
    return F.lower(blank(body, "")).rlike(r"my applications|application status|applied jobs")


# What form fields ask for, by patterns in their labels; the first that fits counts.
FIELDS = {
    "name": r"\bname\b|full\s*name",
    "email": r"e-?mail|@",
    "phone": r"\bphone\b|\bmobile\b|\btel\b",
    "program": r"program|\bdegree\b|academic\s*plan",
    "term": r"graduation|\bterm\b|work\s*term|sequence",
    "cover_letter_text": r"cover\s*letter|letter\s*of\s*interest",
    "why_company": r"why\s*.*(interested|company|role)|motivation",
    "work_authorization": r"authorized\s*to\s*work|legally\s*eligible|work\s*permit",
}
SKIPPED_TYPES = ("hidden", "submit", "button", "file")
RESUME_CHARS, MOST_FIELDS = 600, 40


def field_intent(*texts: Column | str) -> Column:
    """What a field asks for, from its label, name and placeholder."""
    t = F.concat_ws(" ", *(blank(x, "") for x in texts))
    out = F.lit("unknown")
    for intent, pattern in reversed(FIELDS.items()):
        out = F.when(matches(t, pattern, True), F.lit(intent)).otherwise(out)
    return out


def field_value(intent: Column | str, faculty: Column | str, role: Column | str, term: Column | str, resume: Column | str) -> Column:
    """(value, confidence, note): what a field may be filled with."""
    of = lambda value, confidence, note: F.struct((F.lit(value) if isinstance(value, str) else value).alias("value"), (F.lit(confidence) if isinstance(confidence, str) else confidence).alias("confidence"), F.lit(note).alias("note"))
    i, f = col(intent), blank(faculty, "")
    r = F.trim(blank(resume, ""))
    snippet = F.when(F.length(r) > RESUME_CHARS, F.concat(F.substring(r, 1, RESUME_CHARS), F.lit("…"))).otherwise(r)
    draft = F.when(r != "", F.concat(F.lit("[Draft from resume — edit heavily]\n"), snippet)).otherwise("")
    return (
        F.when(i == "unknown", of("", "low", "Unclassified field"))
        .when(i == "program", of(F.trim(F.concat(f, F.lit(" — target: "), blank(role, "(set in app)"))), F.when(f != "", "medium").otherwise("low"), "Check against your calendar program name"))
        .when(i == "term", of(F.coalesce(col(term).cast("string"), F.lit("")), "medium", "Verify sequence number"))
        .when(i.isin("cover_letter_text", "why_company"), of(draft, "low", "Requires human rewrite"))
        .when(i == "work_authorization", of("Yes — edit if you need exceptions", "low", "Legal wording is on you"))
        .otherwise(of("", "low", "No canned value"))
    )


def fill_plan(fields: DataFrame, faculty: Column | str, role: Column | str, term: Column | str, resume: Column | str) -> DataFrame:
    """Fields (label, name, id, placeholder, type) that can be filled, with what they ask for and a value."""
    shown = fields.filter(~F.lower(F.coalesce("type", F.lit("text"))).isin(*SKIPPED_TYPES))
    df = shown.withColumn("intent", field_intent("label", "name", "placeholder"))
    return df.withColumn("fill", field_value("intent", faculty, role, term, resume))


def previewed(plan: DataFrame, most: int = MOST_FIELDS) -> DataFrame:
    return plan.filter("intent <> 'unknown'").limit(most)
