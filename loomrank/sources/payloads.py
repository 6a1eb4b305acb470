"""Postings out of responses: partial XML updates, JSON of any shape, HTML or plain text; and requests that lead there."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrank.operators.eligibility import POSTING_TEXT

from .dom import normalized
from .pages import posting_like, posting_parts, url_candidates

# Keys and texts that belong to a posting, and limits of the search for them.
KEYS = re.compile(r"(description|summary|responsibil|qualif|require|prefer|skill|duties|work\s*term|duration|gpa|cover|transcript|posting|title|division|organization)")
TEXTS = re.compile(r"(required skills|preferred skills|job posting information|work term duration|application information)", re.I)
DEPTH, MOST, LONG, LEAST = 6, 240, 100, 180
ID_PARAMETERS = ["jobId", "postingId", "positionId", "opportunityId", "jobPostingId", "selectedJobId", "selectedPostingId", "posting", "position", "job", "id"]
NOISE = re.compile(r"^(page|sort|order|filter|tab|viewed|new|deadline|offset|limit)$", re.I)
ID_LIKE = re.compile(r"(job|post|position|opportun|record|detail|select|chosen|active|current|id)", re.I)
GETS, REQUESTS = 8, 28


def strings(value, depth: int = 0, key: str = "") -> list[str]:
    """Texts in a JSON value that look like parts of a posting."""
    out: list[str] = []

    def walk(v, d: int, k: str) -> None:
        if d > DEPTH or len(out) > MOST:
            return
        if isinstance(v, str):
            t = normalized(v)
            if t and (KEYS.search(k.lower()) or (len(t) >= 220 and re.search(POSTING_TEXT, t.lower())) or TEXTS.search(t) or len(t) >= LONG):
                out.append(t)
        elif isinstance(v, list):
            for x in v:
                walk(x, d + 1, k)
        elif isinstance(v, dict):
            for name, x in v.items():
                walk(x, d + 1, str(name))

    walk(value, depth, key)
    return out


def payload(raw: str | None) -> str:
    """What of a response is the posting: HTML or text."""
    text = (raw or "").strip()
    if text.lower().startswith("<?xml") or re.search(r"<partial-response[\s>]", text, re.I):
        try:
            updates = [normalized("".join(e.itertext())) for e in ElementTree.fromstring(text).iter("update")]
        except ElementTree.ParseError:
            updates = []
        joined = "\n".join(u for u in updates if u)
        if len(joined) >= LEAST:
            return joined
    if text[:1] + text[-1:] in ("{}", "[]"):
        try:
            joined = "\n".join(dict.fromkeys(strings(json.loads(text))))
        except ValueError:
            joined = ""
        if len(joined) >= LEAST:
            return joined
    return text


def _batch(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([posting_parts(payload(r)) for r in raw], columns=["text", "bullets"])


def responses(df: DataFrame, raw: str = "response") -> DataFrame:
    """Responses with the columns text and bullets of their posting, for posting.parse."""
    read = F.pandas_udf(_batch, "text string, bullets array<string>")
    return df.withColumn("_p", read(raw)).select(*[c for c in df.columns if c != raw], "_p.text", "_p.bullets")


def parameters(contexts: Sequence[str]) -> list[str]:
    """Names of parameters that may hold a job's number: those that scripts use, then the usual ones."""
    found: dict[str, str] = {}
    for c in contexts:
        for name in re.findall(r"[?&]([A-Za-z_][A-Za-z0-9_.\-]{1,40})=|[\"']([A-Za-z_][A-Za-z0-9_]{1,40})[\"']\s*:", c):
            n = name[0] or name[1]
            if ID_LIKE.search(n) and not NOISE.match(n):
                found.setdefault(n.lower(), n)
    for n in ID_PARAMETERS:
        found.setdefault(n.lower(), n)
    return list(found.values())


def base_urls(contexts: Sequence[str], page: str) -> list[str]:
    """Addresses on the page's own host that its scripts name."""
    host = urlsplit(page).netloc
    return list(dict.fromkeys(u for c in contexts for x in url_candidates(c) if urlsplit(u := urljoin(page, x)).netloc == host))


def posting_urls(job_id: str, page: str, known: Sequence[str] = (), contexts: Sequence[str] = (), most: int = GETS) -> list[str]:
    """Addresses that a job's posting may have."""
    out = dict.fromkeys(u for u in (urljoin(page, k) for k in known) if posting_like(u))
    if job_id:
        roots = [urljoin(page, "."), *(urlunsplit(urlsplit(u)._replace(query="", fragment="")) for u in base_urls(contexts, page))]
        bases = dict.fromkeys([*base_urls(contexts, page), *(urljoin(r, s) for r in roots for s in ("jobs.htm", "posting.htm"))])
        for b in bases:
            for p in parameters(contexts):
                u = urlsplit(b)
                query = [(k, v) for k, v in parse_qsl(u.query) if k.lower() != p.lower()] + [(p, job_id)]
                full = urlunsplit(u._replace(query=urlencode(query), fragment=""))
                if posting_like(full):
                    out.setdefault(full)
    return list(out)[:most]


def ajax_sources(contexts: Sequence[str]) -> list[dict]:
    """Sources and parameters of component calls (PrimeFaces.ab, mojarra.jsfcljs) that scripts hold, 20 at most of each."""
    out: dict[tuple, dict] = {}
    for c in contexts:
        for body in re.findall(r"PrimeFaces\.ab\(\s*\{(.*?)\}\s*\)", c, re.S):
            pairs = dict(re.findall(r"\b(s|source|f|formId|u|update|p|process)\s*:\s*[\"']([^\"']+)[\"']", body))
            source = pairs.get("s") or pairs.get("source")
            if source:
                out.setdefault(("ab", source), {"kind": "ab", "source": source, "form": pairs.get("f") or pairs.get("formId") or "", "update": pairs.get("u") or pairs.get("update") or "", "process": pairs.get("p") or pairs.get("process") or source, "parameters": {}})
        for form, body in re.findall(r"jsfcljs\(\s*document\.(?:getElementById\(\s*|forms\[\s*)[\"']([^\"']+)[\"']\s*[\)\]]\s*,\s*\{(.*?)\}", c, re.S):
            given = dict(re.findall(r"[\"']([^\"']+)[\"']\s*:\s*[\"']([^\"']*)[\"']", body))
            if given:
                source = next(iter(given))
                out.setdefault(("jsf", form, source), {"kind": "jsf", "source": source, "form": form, "update": "", "process": source, "parameters": given})
    return [x for kind in ("ab", "jsf") for x in [v for v in out.values() if v["kind"] == kind][:20]]


def requests(job_id: str, page: str, known: Sequence[str], contexts: Sequence[str], hidden: dict[str, str] | None = None, most: int = REQUESTS) -> list[dict]:
    """Requests (method, url, body) that may bring a posting: addresses first, then component calls. Sending them is left
    to the caller."""
    out = [{"method": "GET", "url": u, "body": ""} for u in posting_urls(job_id, page, known, contexts)]
    for a in ajax_sources(contexts):
        body = dict(hidden or {}) | a["parameters"]
        if a["kind"] == "ab":
            body |= {"javax.faces.partial.ajax": "true", "javax.faces.source": a["source"], "javax.faces.partial.execute": a["process"], "javax.faces.partial.render": a["update"], a["source"]: a["source"]}
        out.append({"method": "POST", "url": page, "body": urlencode(body)})
    seen: dict[tuple, dict] = {}
    for r in out:
        if len(r["body"]) < 22_000:
            seen.setdefault((r["method"], r["url"], r["body"]), r)
    return list(seen.values())[:most]
