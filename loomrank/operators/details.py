"""The posting behind each listed job: sources tried one after the other, each only for jobs that nothing before has settled.

jobs: job_key, job_id, title, company. requests: job_key, position, method, url, body, confidence (ways to ask for a job's
posting, in order). cache: url, text. responses: method, url, body, text. contexts: job_key, text (harvested() makes them from
scripts). pages: job_key, text (what a job's own page shows). Texts are whole postings as plain text; sources.payloads.responses
reads raw responses.

Every source is cut to what is still asked for by joins on equal keys; jobs meet texts by key only, and the predicate of the
join (eligibility.same_posting) is checked on those pairs: first what needs no parsing, and only for pairs that this leaves open the rest. Nulls: a job without
a key is returned unsettled; a null id, title, company or body is empty, a null method is GET; null urls and texts match nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomrank.functions.js import any_of, blank, let
from loomrank.functions.lexicon import SKILLS, Skill
from loomrank.functions.text import title_key
from loomrank.sources.pages import LISTING_PATH, LISTING_QUERY, NOT_JOB_PATH, POSTING_PATH, POSTING_QUERY
from loomrank.sources.tables import stored

from .eligibility import likely_posting, likely_settled, looks_like_posting
from .posting import parse

# How much of a page's scripts is looked at, and what tells that a script or a text is about postings.
SCRIPTS, NAMED_CHARS, TELLING_CHARS, STRINGS, LEAST_CHARS = 30, 6000, 2400, 80, 220
TELLING = ["jobs.htm", "postingid", "jobid", "positionid", "opportunityid"]

#: Digits of an id that scripts are looked up by, at most.
KEY_DIGITS = 16
PARSED = ["full_text", "required_skills", "preferred_skills", "constraints"]


def posting_like(url: Column | str) -> Column:
    """Whether an address looks like that of a posting."""
    u = F.col(url) if isinstance(url, str) else url
    path, query = F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("")), F.coalesce(F.try_parse_url(u, F.lit("QUERY")), F.lit(""))
    of = lambda c, p: c.rlike(("(?i)" if p.flags & 2 else "") + p.pattern)
    return u.isNotNull() & ~of(path, NOT_JOB_PATH) & (of(query, POSTING_QUERY) | of(path, POSTING_PATH) | (of(path, LISTING_PATH) & of(query, LISTING_QUERY)))


def _parts(runs: Column, size: int) -> Column:
    """All parts of a size that texts of an array have."""
    parts = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - size + 1), lambda i: F.substr(r, i, F.lit(size)))
    return F.flatten(F.transform(F.filter(runs, lambda r: F.length(r) >= size), parts))


def harvested(jobs: DataFrame, scripts: DataFrame, page: str = "page") -> DataFrame:
    """For each job the parts of its page's scripts that may hold its posting: job_key, text, n_chunks.

    jobs: page, job_key, job_id, title. scripts: page, script (their order), text. Of a page's first SCRIPTS scripts, one that
    has the job's id gives its beginning, another one that names postings a shorter beginning; such a part counts if it is
    long enough, has the id (of a job with one) and looks like a posting or has two words of the title.

    Ids meet scripts through an index of digits: each run of digits of a script gives its parts of the lengths that ids' digits
    have, and is joined by page and digits. Only jobs whose id has no digits, or that have none, meet all scripts of their page.
    """
    tidy = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    asked = jobs.select(page, "job_key", tidy("job_id").alias("job_id"), F.coalesce(F.col("title").cast("string"), F.lit("")).alias("title")).filter("job_key is not null").dropDuplicates(["job_key"])
    asked = asked.withColumn("key", F.substring(F.regexp_extract("job_id", "[0-9]+", 0), 1, KEY_DIGITS))
    first = F.row_number().over(W.partitionBy(page).orderBy("script", "text"))
    found = scripts.select(page, "script", F.col("text").cast("string").alias("text")).filter(F.length("text") >= 1).withColumn("n", first).filter(F.col("n") <= SCRIPTS)
    # an id beyond the beginning makes a script's beginning count, but then it isn't in there, and the part is of no use
    head = F.substring("text", 1, NAMED_CHARS)
    found = found.select(page, "n", let(F.struct(F.lower("text").alias("low"), head.alias("head")), lambda x: F.struct(x["head"].alias("head"), looks_like_posting(x["head"]).alias("sound"), any_of(x["low"], TELLING).alias("telling"))).alias("s"))
    begun = let(F.substring("s.head", 1, TELLING_CHARS), lambda t: F.struct(t.alias("part"), looks_like_posting(t).alias("sound")))
    # what a part is like is told once for each script, and stored: many jobs meet it
    found = stored(found.select(page, "n", "s.*", F.when(F.col("s.telling"), begun).alias("begun")), "scripts")
    lengths = sorted(r[0] for r in asked.select(F.length("key")).filter("key <> ''").distinct().collect())  # KEY_DIGITS at most
    digits = F.regexp_extract_all("head", F.lit("[0-9]+"), F.lit(0))
    keys = F.array_distinct(F.concat(F.array().cast("array<string>"), *(_parts(digits, k) for k in lengths)))
    index = found.select(page, "n", F.explode(keys).alias("key"))
    job, begun = [page, "job_key", "job_id", "title", "n"], ["begun.part", "begun.sound"]
    telling = found.filter("telling").select(page, "n", *begun)
    named = asked.filter("key <> ''").join(index, [page, "key"]).join(found, [page, "n"]).unionByName(asked.filter("key = '' and job_id <> ''").join(found, page).select(*asked.columns, *(c for c in found.columns if c != page)))
    has_id = F.contains("head", "job_id")
    named = named.filter(has_id).select(*job, F.col("head").alias("part"), "sound").unionByName(named.filter(~has_id & F.col("telling")).select(*job, *begun))
    both = named.unionByName(asked.filter("job_id = ''").join(telling, page).select(*job, "part", "sound"))
    hits = lambda low, words: F.size(F.filter(words, lambda w: F.contains(low, w)))
    enough = lambda low, words: hits(low, words) >= F.least(F.lit(2), F.when(F.size(words) > 0, F.size(words)).otherwise(2))
    words = F.filter(F.split(title_key("title"), " "), lambda w: F.length(w) >= 4)
    titled = lambda low: F.col("sound") | let(words, lambda w: enough(low, w))
    mine = (F.col("job_id") == "") & F.col("sound") | let(F.lower("part"), lambda low: F.contains(low, F.lower("job_id")) & titled(low))
    kept = both.filter((F.length("part") >= LEAST_CHARS) & mine)
    kept = kept.groupBy("job_key").agg(F.sort_array(F.collect_list(F.struct("n", "part")))["part"].alias("c"))  # SCRIPTS at most
    chunks = F.slice(F.array_distinct("c"), 1, STRINGS)
    return kept.select("job_key", F.array_join(chunks, "\n").alias("text"), F.size(chunks).alias("n_chunks"))


def _likely(pairs: DataFrame, source: str, skills: Sequence[Skill]) -> DataFrame:
    """Of the texts that each job meets (job_key, position, url, text, job_id, title, company, sure) those that may be its
    posting, in their order (n), up to the first that is, whatever it says of skills and constraints (certain)."""
    row = likely_posting("text", "job_id", "title", "company", F.col("sure"), len(skills))
    of_job = W.partitionBy("job_key").orderBy("position", "v.normal")
    rows = pairs.filter("text is not null").select("job_key", "position", "url", row.alias("v"))
    certain = F.coalesce(~F.col("v.brief") & ~F.col("v.strange"), F.lit(False))
    # filtered above the window: below it the rule would be worked out once more for the filter
    rows = rows.withColumns({"n": F.row_number().over(of_job), "_before": F.max(certain).over(of_job.rowsBetween(W.unboundedPreceding, -1))})
    rows = rows.filter("v is not null and not coalesce(_before, false)")
    return stored(rows.select("job_key", "position", "url", "n", "v.*", certain.alias("certain")), f"details-{source}")


def _first(likely: DataFrame, parsed: DataFrame, source: str) -> DataFrame:
    """Of the likely texts of each job the first that is its posting: job_key, position, n. Only uncertain ones are parsed
    for it; stored, as later rounds ask what is settled."""
    rule = likely_settled(F.col("brief"), F.col("strange"), F.size("required_skills") + F.size("preferred_skills"), F.col("constraints"))
    told = parsed.filter("not certain").select("job_key", "n", "position", rule.alias("ok"))
    rows = likely.filter("certain").select("job_key", "n", "position", F.lit(True).alias("ok")).unionByName(told)
    # a minimum rather than a filter, which would be pushed below the parser
    best = rows.groupBy("job_key").agg(F.min(F.when(F.col("ok"), F.struct("n", "position"))).alias("b")).filter("b is not null")
    return stored(best.select("job_key", "b.*"), f"details-{source}-first")


def details(
    jobs: DataFrame, requests: DataFrame, cache: DataFrame, responses: DataFrame, contexts: DataFrame | Callable[[DataFrame], DataFrame], pages: DataFrame, skills: Sequence[Skill] = SKILLS
) -> DataFrame:
    """Each job once: job_key, found (cache, response, context, page, or null), position and url of the request that brought
    it, full_text, required_skills, preferred_skills, constraints.

    Requests count in their order; one is looked up in the cache, if it has the address of a posting and no body, and then among
    the responses, so a job with a cached posting still reads the responses to requests before that. A response is taken for
    the job's if it is the same posting, or a whole posting of its title where the request is of high confidence. Then come
    the job's contexts, then its page. contexts may be a function that gives them for the keys of the jobs left (job_key).

    Most texts are told by their words and numbers alone (eligibility.likely_posting). Only those that aren't are parsed to
    settle a job; the postings found are parsed as the result is read, for the columns that are asked for."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    # the rows of a key differ in nothing that counts
    jobs = jobs.select("job_key", *(empty(c).alias(c) for c in ("job_id", "title", "company")))
    known = jobs.filter("job_key is not null").groupBy("job_key").agg(*(F.min(c).alias(c) for c in ("job_id", "title", "company")))
    asked = requests.select("job_key", "position", F.upper(blank("method", "GET")).alias("method"), "url", empty("body").alias("body"), (F.lower(empty("confidence")) == "high").alias("sure"))
    asked = asked.filter(blank("url", "") != "")
    found: dict[str, tuple[DataFrame, DataFrame]] = {}

    def settle(source: str, pairs: DataFrame) -> DataFrame:
        likely = _likely(pairs, source, skills)
        parsed = parse(likely, text="raw", skills=skills, normal="normal")
        first = _first(likely, parsed, source)
        found[source] = parsed, first
        return first

    cacheable = asked.filter((F.col("method") == "GET") & (F.col("body") == "") & posting_like("url"))
    # jobs are joined to requests before texts are, so that texts are dealt out once
    cacheable = cacheable.select("job_key", "position", "url", F.lit(False).alias("sure")).join(known, "job_key")
    by_cache = settle("cache", cache.select("url", "text").join(cacheable, "url"))

    still = asked.join(by_cache.select("job_key", F.col("position").alias("_settled")), "job_key", "left").filter(F.col("_settled").isNull() | (F.col("position") < F.col("_settled"))).drop("_settled")
    answers = responses.select(F.upper(blank("method", "GET")).alias("method"), "url", empty("body").alias("body"), "text")
    by_response = settle("response", answers.join(still.join(known, "job_key"), ["method", "url", "body"]))
    found["cache"] = found["cache"][0], by_cache.join(by_response, "job_key", "left_anti")

    settled = by_response.select("job_key").unionByName(found["cache"][1].select("job_key"))
    for source, texts in (("context", contexts), ("page", pages)):
        left = known.join(settled, "job_key", "left_anti")
        texts = texts if isinstance(texts, DataFrame) else texts(left.select("job_key"))
        pairs = texts.select("job_key", "text").join(left, "job_key").withColumns({"position": F.lit(None).cast("int"), "url": F.lit(None).cast("string"), "sure": F.lit(False)})
        settled = settled.unionByName(settle(source, pairs).select("job_key"))

    out = None
    for source, (parsed, first) in found.items():
        rows = parsed.join(first.select("job_key", "n"), ["job_key", "n"], "left_semi").select("job_key", F.lit(source).alias("found"), "position", "url", *PARSED)
        out = rows if out is None else out.unionByName(rows)
    return jobs.select("job_key").distinct().join(out, "job_key", "left")


def cache_rows(found: DataFrame, requests: DataFrame) -> DataFrame:
    """What the cache gains: url and text of the answers that were accepted and may be cached."""
    mine = requests.filter((F.upper(blank("method", "GET")) == "GET") & (blank("body", "") == "") & posting_like("url")).select("job_key", "position")
    return found.filter("found = 'response'").join(mine, ["job_key", "position"], "left_semi").select("url", F.col("full_text").alias("text")).dropDuplicates(["url"])
