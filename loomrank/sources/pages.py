"""Readers of HTML pages: listed jobs, postings with their lists, hiring history, form fields.

Pages come as a table with a text column, from Parquet or from files by spark.read.text(wholetext=True). The tree is
walked in an Arrow UDF; everything after that is a typed column. A null page gives what an empty one does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrank.operators import posting, ratings

from .dom import Element, body, normalized, parse

# Patterns that tell rows of jobs from the rest of a page.
NAVIGATION = re.compile(r"^(home|dashboard|profile|settings?|calendar|contact( us)?|faq|help|sign out|logout|my account|back|next|previous|jobs?|messages)$", re.I)
ACTION = re.compile(r"^(apply|view|print|shortlist|save|remove|not interested|open|edit|rank|more|details?|folder)\b", re.I)
PAGE_TALK = re.compile(r"sign out|logout|help|profile|setting|calendar|my account", re.I)
ROW_TALK = re.compile(r"sign out|logout|settings|profile|student help|about co-op", re.I)
HREF_SIGNAL = re.compile(r"jobid|postingid|/posting/|/job/|myaccount/co-op/direct/jobs|jobs\.htm", re.I)
TITLE_SIGNAL = re.compile(r"(intern|co-op|coop|developer|engineer|analyst|scientist|assistant|manager|design|software|data|qa|test|research|product)", re.I)
CONTEXT_SIGNAL = re.compile(r"(deadline|employer|location|work term|position|job title)", re.I)
NOT_TITLE = re.compile(r"home|dashboard|profile|setting|calendar|contact|faq", re.I)
NOT_COMPANY = re.compile(r"(new|viewed|deadline|junior|intermediate|senior|in-person|remote|hybrid)", re.I)
POSTING_QUERY = re.compile(r"jobid|postingid|positionid|opportunityid", re.I)
POSTING_PATH = re.compile(r"/posting/|/job/", re.I)
LISTING_PATH = re.compile(r"/myaccount/co-op/.*jobs\.htm", re.I)
LISTING_QUERY = re.compile(r"(?:^|&)[a-z0-9_-]*(job|post|position|opportun|id)[a-z0-9_-]*=", re.I)
NOT_JOB_PATH = re.compile(r"/(dashboard|profile|settings|calendar|logout|help|contact|faq)(/|\.|$)", re.I)
URLS = re.compile(r"https?://[^\s\"'`<>()]+|(?:/|\./)?[A-Za-z0-9/_\-.%]+(?:\.htm|\.html)(?:\?[^\s\"'`<>()]*)?", re.I)
ICONS = re.compile(r"\b(?:launch|open_in_new|more_vert|chevron_(?:left|right)|arrow_(?:back|forward))\b", re.I)
ROW_CLASSES = ("job-row", "posting-row", "job-listing-item", "row")
SIDE_CLASSES = ("sidebar", "left-nav", "menu", "navbar")
JOBS = "row_index int, job_key string, job_id string, url string, title string, company string, location string, snippet string"


def clean(text: str) -> str:
    return normalized(re.sub(r"[_|]+", " ", ICONS.sub(" ", text or "")))


def meaningful(text: str) -> bool:
    t = clean(text)
    return len(t) >= 4 and not NAVIGATION.match(t) and not re.fullmatch(r"[a-z_0-9-]{1,24}", t, re.I) and bool(re.search("[a-z]{3,}", t, re.I))


# Attributes that may hold an address, and parameters that name a posting.
URL_ATTRIBUTES = ("onclick", "ondblclick", "data-url", "data-href", "data-link")
ID_PARAMETER = "jobid=|postingid=|positionid=|opportunityid="


def title_like(text: str) -> bool:
    return meaningful(text) and not ACTION.match(text)


def posting_like(url: str) -> bool:
    u = urlsplit(url)
    if NOT_JOB_PATH.search(u.path):
        return False
    return bool(POSTING_QUERY.search(u.query) or POSTING_PATH.search(u.path) or (LISTING_PATH.search(u.path) and LISTING_QUERY.search(u.query)))


def url_candidates(text: str | None) -> list[str]:
    """Addresses that stand in a text."""
    return URLS.findall(text or "")


def _aside(e: Element) -> bool:
    return e.closest(lambda x: x.tag in ("nav", "aside") or x.attrs.get("role") == "navigation" or x.has_class(*SIDE_CLASSES)) is not None


def _row_of(anchor: Element) -> Element | None:
    return anchor.closest(lambda x: x.tag in ("tr", "li") or x.attrs.get("role") == "row" or x.has_class(*ROW_CLASSES)) or anchor.parent


def _key(text: str) -> str:
    return normalized(re.sub("[^a-z0-9 ]", " ", text.lower()))


def main_anchor(row: Element, title: str = "") -> Element | None:
    """The link of a row that names its job: the first of the greatest score."""
    best, top, needle = None, None, _key(title)
    for a in row.find_all("a"):
        text = clean(a.text())
        if not text:
            continue
        href, own = a.attrs.get("href", "").lower(), _key(text)
        points = 140 * title_like(text) + 60 * meaningful(text) + 30 * (not ACTION.match(text))
        points += 12 * bool(re.search(r"javascript:|#|job|posting|position", href)) - 60 * bool(re.search("folder|print|rank|apply|notinterested|shortlist", href))
        if needle and own:
            points += 90 * (own in needle) + 90 * (needle in own)
        points += min(25, len(text) // 8) if len(text) >= 8 else 0
        if top is None or points > top:
            best, top = a, points
    return best


def _cells(row: Element) -> list[str]:
    return [clean(c.text()) for c in row.find_all("td")]


def row_title(row: Element, anchor: Element | None) -> str:
    if anchor is not None and meaningful(anchor.text()):
        return clean(anchor.text())
    return max((t for t in _cells(row) if meaningful(t)), key=len, default="")


def row_id(row: Element) -> str:
    cell = next((t for t in _cells(row) if re.fullmatch(r"\d{5,8}", t)), None)
    found = re.search(r"\b\d{5,8}\b", clean(row.text()))
    return cell or (found[0] if found else "")


def row_url(row: Element, anchor: Element | None, base: str) -> str | None:
    """The address of a row's posting: the first of the best of those that its links and attributes hold."""
    number = row_id(row).lower()
    said = [anchor.attrs.get("href")] if anchor is not None else []
    said += [a.attrs.get("href") for a in row.find_all("a")]
    for e in (row, *row.elements()):
        for value in filter(None, map(e.attrs.get, URL_ATTRIBUTES)):
            said += [value, *url_candidates(value)]

    def points(url: str) -> int:
        low = url.lower()
        return 120 * bool(re.search(ID_PARAMETER, low)) + 90 * bool(number and number in low) + 40 * bool(re.search("/posting/|/job/", low)) - 80 * bool(re.search("folder|print|apply", low))

    full = [urljoin(base, u) for u in said if u]
    return max((u for u in full if u.startswith("http") and posting_like(u)), key=points, default=None)


def _named(row: Element, classes: tuple[str, ...], attribute: str | None) -> Iterator[str]:
    for e in row.elements():
        if e.has_class(*classes) or (attribute and attribute in e.attrs):
            yield clean(e.text())


def company(row: Element, title: str) -> str:
    for t in _named(row, ("company", "employer", "organization"), "data-company"):
        if t and len(t) < 80 and not re.fullmatch(r"\d{5,8}", t):
            return t
    for t in _cells(row):
        if t and len(t) <= 80 and not re.fullmatch(r"\d{5,8}", t) and t.lower() != title.lower() and not NOT_COMPANY.search(t) and re.search("[a-z]{3,}", t, re.I):
            return t
    return "Unknown company"


def location(row: Element) -> str:
    cells = _cells(row)
    return next((t for t in [*_named(row, ("location",), "data-location"), *cells[2:3]] if t and len(t) < 80), "")


def snippet(row: Element) -> str:
    cells = _cells(row)
    text = next((t for t in [*_named(row, ("description", "snippet"), None), *cells[3:4]] if len(t) > 15), None)
    return (text or clean(row.text()))[:300]


def _strict(anchor: Element, row: Element) -> bool:
    """Whether a row shows the signs of a job: of its address, its title and its surroundings."""
    if _aside(row) or _aside(anchor) or row.has_class("nav", "menu"):
        return False
    text, title = clean(row.text())[:600].lower(), clean(anchor.text()).lower()
    if len(text) < 20 or PAGE_TALK.search(text):
        return False
    cells = len(row.find_all("td"))
    href, named, context = bool(HREF_SIGNAL.search(anchor.attrs.get("href", ""))), bool(TITLE_SIGNAL.search(title)), bool(CONTEXT_SIGNAL.search(text))
    return (cells >= 3 and (href or named)) or (context and (href or named)) or (cells >= 3 and len(title) >= 4 and not NOT_TITLE.search(title))


def _relaxed(anchor: Element, row: Element, title: str) -> bool:
    text = clean(row.text())
    if _aside(row) or _aside(anchor) or len(text) < 18 or ROW_TALK.search(text):
        return False
    return len(row.find_all("td")) >= 2 or len(title.split()) >= 2 or bool(CONTEXT_SIGNAL.search(text))


def listed_jobs(page: str | None, base: str = "") -> list[dict]:
    """The jobs that a page lists, in its order."""
    root = parse(page)
    found: list[tuple[Element, Element | None, str]] = []
    loose: list[tuple[Element, Element | None, str]] = []
    for a in root.find_all("a"):
        title = clean(a.text())
        row = _row_of(a)
        if row is None or not (3 <= len(title) <= 220) or NAVIGATION.match(title) or not title_like(title):
            continue
        if not (a.attrs.get("href") or "onclick" in a.attrs or "ondblclick" in a.attrs):
            continue
        if _strict(a, row):
            found.append((row, a, title))
        if _relaxed(a, row, title):
            loose.append((row, main_anchor(row, title) or a, title))
    if len(found) < 4 and len(loose) > len(found):
        found = loose
    have = {id(r) for r, _, _ in found}
    for row in root.find_all("tr"):
        text = clean(row.text())
        if id(row) in have or _aside(row) or len(row.find_all("td")) < 3 or len(text) < 24 or ROW_TALK.search(text):
            continue
        guess = main_anchor(row)
        if title := row_title(row, guess):
            have.add(id(row))
            found.append((row, main_anchor(row, title) or guess, title))
    # the container with the most rows and signs, and what belongs to the same table
    groups: dict[int, list] = {}
    for item in found:
        if item[0].parent is not None and item[0].parent.tag not in ("body", "html", "#document"):
            groups.setdefault(id(item[0].parent), []).append(item)
    if groups:
        def points(items: list) -> int:
            text = " ".join(clean(r.text()).lower() for r, _, _ in items)
            return 10 * len(items) + min(30, len(re.findall("deadline|employer|location|work term|job title|position", text))) + 12 * bool(re.search("table|tbody|grid|list", items[0][0].parent.tag))

        best = max(groups.values(), key=points)

        def scope(e: Element) -> int:
            top = e.closest(lambda x: x.tag == "table" or x.attrs.get("role") == "grid" or x.has_class("ui-datatable", "p-datatable")) or e.parent or e
            return id(top)

        same = [i for g in groups.values() if scope(g[0][0].parent) == scope(best[0][0].parent) for i in g]
        found = same if len(same) >= len(best) else best
    out: dict[str, dict] = {}
    for k, (row, anchor, title) in enumerate(found):
        lead = main_anchor(row, title) or anchor
        url, number = row_url(row, lead, base), row_id(row)
        key = url or (f"id-{number}" if number else f"row-{k}")
        out.setdefault(key, {"row_index": len(out), "job_key": key, "job_id": number, "url": url, "title": title, "company": company(row, title), "location": location(row), "snippet": snippet(row)})
    return list(out.values())


def _series(of):
    return lambda pages, *more: pd.Series([of(p, *(m[k] for m in more)) for k, p in enumerate(pages)])


def jobs(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """A row for each job that each page lists, beside the page's other columns."""

    @F.pandas_udf(f"array<struct<{JOBS.replace(' ', ':').replace(',:', ',')}>>")
    def read(page: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([listed_jobs(p, b or "") for p, b in zip(page, base, strict=True)])

    rest = [c for c in pages.columns if c not in (html, url)]
    return pages.select(*rest, F.explode(read(html, url)).alias("j")).select(*rest, "j.*")


def posting_parts(page: str | None) -> dict:
    """A posting's text and the list items under headings for skills."""
    root = parse(page)
    whole = [e for e in root.elements() if e.has_class("jobPosting", "postingDetails") or e.attrs.get("data-testid") == "job-description" or e.tag == "main"]
    top = whole[0] if whole else body(root)
    heading = re.compile(posting.SECTION_HEADING, re.I)
    items: dict[str, None] = {}

    def direct(e: Element | None) -> list[str]:
        lists = [c for c in (e.children if e is not None else []) if isinstance(c, Element) and c.tag in ("ul", "ol")]
        return [t for ul in lists for li in ul.children if isinstance(li, Element) and li.tag == "li" and len(t := li.text()) >= posting.LEAST_BULLET]

    for e in top.find_all("h1", "h2", "h3", "h4", "h5", "strong", "b", "p", "div", "span", "td", "th", "label"):
        t = e.text()
        if not t or len(t) > 160 or not heading.search(t):
            continue
        items.update(dict.fromkeys(direct(e.parent)))
        for k, near in enumerate(e.following()[:6]):
            said = near.text()
            if k and len(said) <= 140 and heading.search(said):
                break
            items.update(dict.fromkeys(direct(near)))
            if near.tag == "li" and len(said) >= posting.LEAST_BULLET:
                items[said] = None
    return {"text": top.text(), "bullets": list(items)}


def postings(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with the columns text and bullets of their posting, for posting.parse."""
    read = F.pandas_udf(_posting_batch, "text string, bullets array<string>")
    return pages.withColumn("_p", read(html)).select(*[c for c in pages.columns if c != html], "_p.text", "_p.bullets")


def _posting_batch(page: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([posting_parts(p) for p in page], columns=["text", "bullets"])


HEADINGS = {"term": re.compile(r"(work\s*term|hires\s*by\s*term)"), "faculty": re.compile(r"(faculty|hires\s*by\s*faculty)")}
SECTION_CLASSES = ("panel", "card", "tab-pane", "content")


def rating_texts(page: str | None) -> list[dict]:
    """Texts of a page that may give shares by work term or faculty, and its charts' labels and values."""
    root = parse(page)
    top = body(root)
    out: list[dict] = []
    for kind, heading in HEADINGS.items():
        named = [e for e in root.elements() if (e.tag in ("h1", "h2", "h3", "h4", "h5", "strong") or e.has_class("title", "panel-title", "card-title")) and heading.search(e.text().lower())]
        sections = [e.closest(lambda x: x.tag in ("section", "div") or x.has_class(*SECTION_CLASSES)) or top for e in named]

        def texts(s: Element) -> list[str]:
            return [a for e in s.elements() if (a := e.attrs.get("aria-label"))] + [t for e in s.find_all("li", "span", "div", "p", "text") if "%" in (t := e.text()) and 3 <= len(t) <= 80]

        said = [t for s in sections for t in texts(s)] or texts(root)
        out += [{"kind": kind, "text": t, "labels": [], "values": []} for t in said]
        for s in root.find_all("script"):
            code = "".join(c for c in s.children if isinstance(c, str))
            labels, values = (re.search(rf"{n}\s*[:=]\s*\[([^\]]+)\]", code, re.I) for n in ("labels", "data"))
            if labels and values and ("work term" if kind == "term" else "faculty") in code.lower():
                numbers = [v for x in values[1].split(",") if (v := _number(x)) is not None]
                out.append({"kind": kind, "text": None, "labels": [t for x in labels[1].split(",") if (t := re.sub("[\"'`]", "", x).strip())], "values": numbers})
    return out


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def hires_rows(page: str | None) -> list[list[str]]:
    """The cells of the first table about hires."""
    for t in parse(page).find_all("table"):
        if "hired" in t.text().lower():
            rows = [[c.text() for c in r.find_all("th", "td")] for r in t.find_all("tr")]
            if sum(any(re.search(r"\d", c) for c in r) and not any(re.search(r"students\s*hired", c, re.I) for c in r) for r in rows if len(r) >= 2) >= 3:
                return rows
    return []


def rating_tables(pages: DataFrame, key: str = "page_id", html: str = "html", strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Shares (key, kind, dist) and hires by term (key, seq, term, hires) of pages of hiring history."""
    read = F.pandas_udf(_series(rating_texts), "array<struct<kind:string,text:string,labels:array<string>,values:array<double>>>")
    cells = F.pandas_udf(_series(hires_rows), "array<array<string>>")
    texts = pages.select(key, F.posexplode(read(html)).alias("pos", "t"))
    one = F.array(ratings.label_percent("t.text"))
    entries = F.when(F.col("t.text").isNotNull(), F.filter(one, lambda x: x.isNotNull())).otherwise(ratings.chart_shares("t.labels", "t.values"))
    rows = texts.select(key, F.col("t.kind").alias("kind"), "pos", F.posexplode(entries).alias("sub", "e"))
    rows = rows.select(key, "kind", (F.col("pos") * 1000 + F.col("sub")).alias("pos"), "e.label", "e.percent")
    keep = F.when(F.col("kind") == "term", ratings.keeps_term("label")).otherwise(ratings.keeps_faculty("label"))
    shares = ratings.distribution(rows.filter(keep), [key, "kind"])
    table = pages.select(key, cells(html).alias("rows"))
    found = F.slice(F.filter(F.transform("rows", lambda r: ratings.hires_row(r, strict)), lambda x: x.isNotNull()), 1, ratings.MOST_TERMS)
    hires = table.select(key, F.posexplode(found).alias("seq", "h")).select(key, "seq", "h.term", "h.hires")
    return shares, hires


def form_fields(page: str | None) -> list[dict]:
    """The input fields of a page, with the text that labels each."""
    root = parse(page)
    labels = {e.attrs["for"]: e.text() for e in root.find_all("label") if "for" in e.attrs}
    out = []
    for e in root.find_all("input", "textarea", "select"):
        around = e.closest(lambda x: x.tag == "label")
        text = labels.get(e.attrs.get("id", ""), "") or (around.text() if around is not None else "")
        if not text and e.parent is not None:
            before = []
            for c in e.parent.children:
                if c is e:
                    break
                before.append(c.text() if isinstance(c, Element) else normalized(c))
            text = next((t for t in reversed(before[-4:]) if t), "")
        out.append({"label": text, "name": e.attrs.get("name", ""), "id": e.attrs.get("id", ""), "placeholder": e.attrs.get("placeholder", ""), "type": e.attrs.get("type", "text" if e.tag == "input" else e.tag)})
    return out


def fields(pages: DataFrame, html: str = "html") -> DataFrame:
    read = F.pandas_udf(_series(form_fields), "array<struct<label:string,name:string,id:string,placeholder:string,type:string>>")
    rest = [c for c in pages.columns if c != html]
    return pages.select(*rest, F.explode(read(html)).alias("f")).select(*rest, "f.*")


def page_parts(page: str | None) -> dict:
    """Title, text and number of links to jobs of a page."""
    root = parse(page)
    title = next(iter(root.find_all("title")), None)
    links = root.find_all("a", where=lambda e: any(w in e.attrs.get("href", "") for w in ("job", "posting", "position")))
    return {"title": title.text() if title is not None else "", "text": body(root).text(), "links": len(links), "has_table": bool(root.find_all("td"))}


def _parts_batch(page: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([page_parts(p) for p in page], columns=["title", "text", "links", "has_table"])


def described(pages: DataFrame, html: str = "html") -> DataFrame:
    read = F.pandas_udf(_parts_batch, "title string, text string, links int, has_table boolean")
    return pages.withColumn("_p", read(html)).select(*[c for c in pages.columns if c != html], "_p.*")
