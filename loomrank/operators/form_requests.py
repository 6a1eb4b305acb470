"""Requests that a page's forms would send for a listed job: what its row's handlers name, the forms' state, and bodies from both.

jobs: page, job_key, job_id. actions: job_key, seq, text (values of a row's attributes, in order). forms: page, form (order), form_id,
action (absolute, of the hosts that the caller trusts). fields: page, form, position, name, type, value, checked. Lists that keep the first few distinct values of a
job do so by a minimum for each value and a rank, never by a collected group; only a form's own fields and a page's first forms
come together; a job's requests are made from them in its own row. Nulls are empty texts; jobs without an id ask nothing; sending is left to the caller.
"""

from __future__ import annotations

import re
from urllib.parse import quote_plus

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomrank.functions.js import ascii_bounds, let
from loomrank.sources.pages import NOT_JOB_PATH

# Patterns of handlers, of parameters, and limits.
SOURCES = [
    r"""(?i)(?:\bs\b|source|javax\.faces\.source)\s*[:=]\s*['"]([^'"]{4,220})['"]""",
    r"""(?i)PrimeFaces\.ab\(\{[^}]*\bs\s*:\s*['"]([^'"]{4,220})['"]""",
    r"""(?i)myfaces\.ab\(\{[^}]*\bs\s*:\s*['"]([^'"]{4,220})['"]""",
    r"""(?i)A4J\.AJAX\.Submit\(\s*['"][^'"]*['"]\s*,\s*['"]([^'"]{4,220})['"]""",
]
HINTS = [r"""(?i)(?:\bf\b|form)\s*[:=]\s*['"]([^'"]{1,160})['"]""", r"""(?i)getElementById\(\s*['"]([^'"]{1,160})['"]\s*\)"""]
TARGETS = [r"""(?i)__doPostBack\(\s*['"]([^'"]{4,220})['"]\s*,""", r"""(?i)__EVENTTARGET\s*[:=]\s*['"]([^'"]{4,220})['"]"""]
IDS, NOT_IDS = "[A-Za-z0-9_$:-]{6,}", "(?i)javascript|return|function|false|true|undefined|null"
SUBMIT_LIKE = "(?i)(event|action|command|submit|method|op|operation|target|source|trigger|execute|update|ajax|faces|viewstate|state|token)"
ID_LIKE = "(?i)(job|post|position|opportun|record|detail|select|chosen|active|current|id)"
NOISE = "(?i)^(page|sort|order|filter|tab|viewed|new|deadline|offset|limit)$"
STATE = "(?i)viewstate|token|nonce|session|auth|csrf"
UNSENT, CHOICES = "(?i)(file|button|submit|reset)", ("checkbox", "radio")
FORM_ACTION = r"(?i)/myaccount/co-op/|jobs\.htm|posting|job"
MOST = {"source_ids": 20, "event_targets": 20, "form_hints": 12}
FORMS, EACH, NAMES, REQUESTS = 24, 10, 10, 24
STATE_NAME, FIELD_NAME, AJAX_BODY, POSTBACK_BODY, FORM_BODY, GET_VALUE = 180, 120, 14_000, 16_000, 9_000, 500
PARAMETERS = ["jobId", "postingId", "positionId", "opportunityId", "jobPostingId", "selectedJobId", "selectedPostingId", "posting", "position", "job", "id"]
AJAX = [("javax.faces.partial.ajax", "true"), ("javax.faces.source", None), ("javax.faces.partial.execute", None), ("javax.faces.partial.render", "@all")]

NO_TEXTS, PAIRS = "array<string>", "array<struct<name:string,value:string>>"
CODED = "array<struct<name:string,code:string,known:boolean,short:boolean>>"


def row_actions(actions: DataFrame) -> DataFrame:
    """For each job the first distinct sources, event targets and forms that its row's handlers name: job_key, source_ids,
    event_targets, form_hints."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    every = lambda p: F.regexp_extract_all(text, F.lit(ascii_bounds(p)), F.lit(1))
    tokens = F.filter(F.regexp_extract_all(text, F.lit(IDS), F.lit(0)), lambda t: F.contains(t, F.lit(":")) & ~F.regexp_like(t, F.lit(NOT_IDS)) & ~F.regexp_like(t, F.lit("^[0-9:._-]+$")))
    marked = lambda values, kind, way: F.transform(values, lambda v, i: F.struct(F.lit(kind).alias("kind"), F.lit(way).alias("way"), i.alias("i"), v.alias("value")))
    found = [marked(every(p), kind, way) for kind, ps in (("source_ids", SOURCES), ("event_targets", TARGETS), ("form_hints", HINTS)) for way, p in enumerate(ps)]
    found += [marked(tokens, kind, 9) for kind in ("source_ids", "event_targets")]
    rows = actions.filter("job_key is not null").select("job_key", "seq", F.inline(F.concat(*found)))
    first = rows.groupBy("job_key", "kind", "value").agg(F.min(F.struct("seq", "way", "i")).alias("at"))
    ranked = first.withColumn("n", F.row_number().over(W.partitionBy("job_key", "kind").orderBy("at", "value"))).filter(F.col("n") <= max(MOST.values()))
    of = lambda kind: F.sort_array(F.collect_list(F.when((F.col("kind") == kind) & (F.col("n") <= MOST[kind]), F.struct("n", "value"))))["value"].alias(kind)
    return ranked.groupBy("job_key").agg(*(of(k) for k in MOST))  # twenty of a kind at most


def _sent(f: DataFrame, longest: int) -> DataFrame:
    name, kind = F.trim(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("type", F.lit("")))
    rows = f.select("page", "form", "position", name.alias("name"), kind.alias("type"), F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value"), F.coalesce("checked", F.lit(False)).alias("checked"))
    return rows.filter((F.length("name") >= 1) & (F.length("name") <= longest) & ~F.regexp_like("type", F.lit(UNSENT)) & (~F.col("type").isin(*CHOICES) | F.col("checked")))


def _payload(rows: DataFrame, alias: str) -> DataFrame:
    """A form's pairs: a name stands where it came first, with the value that came last."""
    named = rows.groupBy("page", "form", "name").agg(F.min("position").alias("at"), F.max_by("value", "position").alias("value"))
    return named.groupBy("page", "form").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "name", "value"))), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"))).alias(alias))


def form_state(fields: DataFrame) -> DataFrame:
    """What a form sends beside what is typed: hidden fields, tokens and states (page, form, hidden)."""
    mine = (F.col("type") == "hidden") | F.regexp_like("name", F.lit(SUBMIT_LIKE)) | F.regexp_like("name", F.lit(STATE))
    return _payload(_sent(fields, STATE_NAME).filter(mine), "hidden")


def form_payload(fields: DataFrame) -> DataFrame:
    """The fields of a form that may pick a job (page, form, payload)."""
    rows = _sent(fields, FIELD_NAME).filter(~F.regexp_like("name", F.lit(NOISE))).withColumn("value", F.trim("value"))
    mine = (F.col("type") == "hidden") | (F.regexp_like("name", F.lit(SUBMIT_LIKE)) | F.regexp_like("name", F.lit(ID_LIKE))) & (F.col("value") != "")
    return _payload(rows.filter(mine), "payload")


def _coded(name: Column, value: Column) -> Column:
    """A pair as it is sent, and what is asked of it later: whether its name may hold a job's id, whether an address takes it."""
    sent = F.concat(F.url_encode(name), F.lit("="), F.url_encode(value))
    return F.struct(name.alias("name"), sent.alias("code"), F.regexp_like(name, F.lit(ID_LIKE)).alias("known"), (F.length(value) <= GET_VALUE).alias("short"))


def _fixed(name: str, value: str | None, code: Column | None = None) -> Column:
    """A pair with a known name, encoded here (letters and marks that Java and Python encode alike), and a known or encoded value."""
    head = f"{quote_plus(name)}="
    sent = F.lit(head + quote_plus(value)) if code is None else F.concat(F.lit(head), code)
    return F.struct(F.lit(name).alias("name"), sent.alias("code"), F.lit(re.search(ID_LIKE, name) is not None).alias("known"), F.lit(True).alias("short"))


def _put(pairs: Column, new: Column) -> Column:
    """Pairs with others for their names, one after the other: in its place if the name is there, else at the end. A loop
    rather than nested expressions, which take long to plan."""
    had = lambda p, x: F.exists(p, lambda y: y["name"] == x["name"])
    put = lambda p, x: F.when(had(p, x), F.transform(p, lambda y: F.when(y["name"] == x["name"], x).otherwise(y))).otherwise(F.concat(p, F.array(x)))
    return F.aggregate(new.cast(CODED), pairs.cast(CODED), lambda p, x: put(p, x).cast(CODED))


def _encoded(pairs: Column) -> Column:
    return F.array_join(pairs["code"], "&")


def _with_job(pairs: Column, job_id: Column) -> Column:
    """Pairs whose first name that may hold a job's id does."""
    put = lambda p, at: F.when(at > 0, F.transform(p, lambda x, i: F.when(i + 1 == at, _coded(x["name"], job_id)).otherwise(x))).otherwise(p)
    return let(pairs, lambda p: let(F.array_position(p["known"], F.lit(True)), lambda at: put(p, at)))


def _page_forms(forms: DataFrame, fields: DataFrame) -> DataFrame:
    """The first forms of each page that may send a job's request, in one row (page, forms; FORMS at most), with what all
    requests of a form share: its pairs, encoded, the pairs of its address, and the names that may take an id."""
    empty = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    first = F.row_number().over(W.partitionBy("page").orderBy("form"))
    own = forms.select("page", "form", empty("form_id").alias("form_id"), empty("action").alias("action")).withColumn("n", first).filter(F.col("n") <= FORMS).drop("n")
    path = F.coalesce(F.try_parse_url("action", F.lit("PATH")), F.lit(""))
    own = own.filter(F.regexp_like("action", F.lit(FORM_ACTION)) & ~F.regexp_like(path, F.lit(f"(?i){NOT_JOB_PATH.pattern}")))
    own = own.join(form_state(fields), ["page", "form"], "left").join(form_payload(fields), ["page", "form"], "left")
    coded = lambda c: F.transform(F.coalesce(c, F.array().cast(PAIRS)), lambda x: _coded(x["name"], x["value"])).cast(CODED).alias(c)
    query = F.filter(F.split(F.regexp_extract("action", r"\?([^#]*)", 1), "&"), lambda x: x != "")
    part = lambda x, k: F.coalesce(F.try_url_decode(F.regexp_extract(x, "^([^=]*)=?(.*)$", k)), F.lit(""))
    given = F.transform(query, lambda x: _coded(part(x, 1), part(x, 2))).cast(CODED)
    own = own.select("page", "form", "form_id", "action", coded("hidden"), coded("payload"), given.alias("given"), F.regexp_extract("action", r"^[^?#]*", 0).alias("base"))
    names = F.array_distinct(F.concat(F.filter("payload", lambda x: x["known"])["name"], F.array(*map(F.lit, PARAMETERS))))
    # a pair for each name, which lacks its value
    names = F.transform(F.slice(names, 1, NAMES), lambda x: _coded(x, F.lit(""))).cast(CODED)
    own = own.withColumns({"names": names, "state": F.exists("hidden", lambda x: F.regexp_like(x["name"], F.lit("(?i)__VIEWSTATE")))})
    return own.groupBy("page").agg(F.sort_array(F.collect_list(F.struct(*(c for c in own.columns if c != "page")))).alias("forms"))


def _requests(form: Column) -> list[Column]:
    """Three lists of a form's requests for a job, in their order, each a text of method, body and address by lines."""
    lit, hidden, job_id = F.lit, form["hidden"], F.col("job_id")
    post = lambda body, longest: F.when((F.length(body) >= 1) & (F.length(body) <= longest), F.concat(lit("POST\n"), body, lit("\n"), form["action"]))

    def ajax(source: Column) -> Column:
        fixed = [_fixed(name, value, None if value else F.url_encode(source)) for name, value in AJAX]
        own = F.when(form["form_id"] != "", F.array(_coded(form["form_id"], form["form_id"])).cast(CODED)).otherwise(F.array().cast(CODED))
        new = F.concat(F.array(*fixed, _coded(source, source)).cast(CODED), own)
        return _put(hidden, new)

    def postback(target: Column) -> Column:
        return _put(hidden, F.array(_fixed("__EVENTTARGET", None, F.url_encode(target)), _fixed("__EVENTARGUMENT", "")))

    def plain(name: Column) -> Column:
        asked = lambda pairs: _put(form["given"], F.filter(pairs, lambda x: x["short"]))
        get = lambda pairs: F.concat(lit("GET\n\n"), form["base"], lit("?"), _encoded(asked(pairs)))
        pair = F.struct(name["name"].alias("name"), F.concat(name["code"], F.col("job_code")).alias("code"), name["known"].alias("known"), F.col("job_short").alias("short"))
        return let(_put(form["payload"], F.array(pair)), lambda pairs: F.array(let(_encoded(pairs), lambda body: post(body, FORM_BODY - 1)), get(pairs)))

    def each(values: str, build, longest: int) -> Column:
        return F.transform(F.slice(values, 1, EACH), lambda v: let(_encoded(_with_job(build(v), job_id)), lambda body: post(body, longest)))

    return [each("source_ids", ajax, AJAX_BODY), F.when(form["state"], each("event_targets", postback, POSTBACK_BODY)), F.flatten(F.transform(form["names"], plain))]


def _job_requests(jobs: DataFrame, actions: DataFrame, forms: DataFrame, most: int) -> DataFrame:
    """The first distinct requests of each row of jobs, worked out within the row: bodies are never shuffled, and what comes
    after the first ones isn't made."""
    none = lambda c: F.coalesce(c, F.array().cast(NO_TEXTS)).alias(c)
    # a row takes long for its size, so rows are dealt to all tasks that a shuffle has
    parts = int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = jobs.join(actions, "job_key", "left").repartition(parts, "page").join(forms, "page")
    rows = rows.select("job_key", "job_id", F.url_encode("job_id").alias("job_code"), (F.length("job_id") <= GET_VALUE).alias("job_short"), "forms", none("source_ids"), none("event_targets"))

    def joined(new: Column):
        return lambda a: F.when(F.size(a) >= most, a).otherwise(F.array_distinct(F.concat(a, F.array_compact(new))))

    def more(found: Column, form: Column) -> Column:
        for new in _requests(form):
            found = let(found, joined(F.coalesce(new, F.array().cast(NO_TEXTS))))
        return found.cast(NO_TEXTS)

    found = F.slice(F.aggregate("forms", F.array().cast(NO_TEXTS), more), 1, most)
    rows = rows.select("job_key", F.posexplode(found).alias("position", "request"))
    part = lambda k, name: F.get(F.split("request", "\n", 3), F.lit(k)).alias(name)
    return rows.select("job_key", "position", part(0, "method"), part(2, "url"), part(1, "body"))


def form_requests(jobs: DataFrame, actions: DataFrame, forms: DataFrame, fields: DataFrame, most: int = REQUESTS) -> DataFrame:
    """The first distinct requests of each job: job_key, position, method, url, body. Of a job that is listed in several ways
    (pages or ids), those that come first in any of them."""
    empty = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    mine = jobs.select("page", "job_key", empty("job_id").alias("job_id")).filter("job_id <> '' AND job_key IS NOT NULL AND page IS NOT NULL")
    ways = F.struct("page", "job_id")
    several = mine.groupBy("job_key").agg(F.min(ways).alias("a"), F.max(ways).alias("b"))
    once, again = several.filter("a = b").select("job_key", "a.page", "a.job_id"), several.filter("a <> b").select("job_key")
    named, own = row_actions(actions), _page_forms(forms, fields)
    every = _job_requests(mine.join(again, "job_key", "left_semi").distinct(), named, own, most).groupBy("job_key", "method", "url", "body").agg(F.min("position").alias("at"))
    rank = F.row_number().over(W.partitionBy("job_key").orderBy("at", "method", "url", "body"))
    merged = every.withColumn("position", rank - 1).filter(F.col("position") < most).select("job_key", "position", "method", "url", "body")
    return _job_requests(once, named, own, most).unionByName(merged)
