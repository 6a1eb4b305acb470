"""Keyword search over analysed postings, with phrases, synonyms and scores from 0 to 100 over the result."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrank.functions.js import blank, js_round
from loomrank.functions.lexicon import ROLE_SYNONYMS, SKILLS, Skill
from loomrank.functions.text import search_words
from loomrank.sources.tables import stored

_SPLIT, _ENDING, _DROP = re.compile(r"[^a-z0-9#+.\-/]+"), re.compile(r"(ing|edly|ed|ly|es|s)\Z"), re.compile(r"[^a-z0-9#+.\-/ ]")


def word(value: str) -> str:
    """A query's word as the index has it."""
    w = _DROP.sub("", value.lower()).strip()
    return w if len(w) <= 3 else _ENDING.sub("", w, count=1)


def words(text: str) -> list[str]:
    return [w for w in map(word, filter(None, _SPLIT.split(" ".join(text.lower().split())))) if len(w) >= 2]


def phrases(query: str) -> list[str]:
    """Quoted phrases of two characters or more, and the rest if it is two words or more."""
    raw = query.strip().lower()
    quoted = [q.strip() for q in re.findall(r'"([^"]{2,})"', raw)]
    rest = " ".join(re.sub(r'"[^"]{2,}"', " ", raw).split())
    return list(dict.fromkeys(p for p in [*quoted, *([rest] if len(rest.split(" ")) >= 2 else [])] if p))


@dataclass(frozen=True)
class Query:
    text: str
    tokens: tuple[str, ...]
    phrases: tuple[str, ...]


def expand(query: str, skills: Sequence[Skill] = SKILLS, synonyms: Mapping[str, Sequence[str]] = ROLE_SYNONYMS) -> Query:
    """A query with the names of the skills and roles that it names. It is one short text, so this is done at once."""
    text = query.strip().lower()
    said = phrases(text)
    tokens = dict.fromkeys(words(text))
    for w in list(dict.fromkeys([*tokens, *words(" ".join(said))])):
        found = next((s for s in skills if word(s.key) == w or any(word(a) == w for a in s.aliases)), None)
        if found:
            tokens.update(dict.fromkeys(t for name in (found.key, *found.aliases) for t in words(name)))
    for role, others in synonyms.items():
        if role in text:
            tokens.update(dict.fromkeys(t for name in (role, *others) for t in words(name)))
            said += [o for o in others if len(o.split()) >= 2 and o not in said]
    return Query(text, tuple(tokens), tuple(said))


def index(df: DataFrame, text: str = "full_text") -> DataFrame:
    """Adds what searching looks at: lower-case texts and sets of words."""
    c = df.columns
    part = lambda n: blank(n, "") if n in c else F.lit("")
    skills_ = [F.array_join(n, " ") if n in c else F.lit("") for n in ("required_skills", "preferred_skills")]
    combined = F.lower(F.concat_ws(" ", part("title"), part("company"), part("location"), part("snippet"), *skills_, F.substring(part(text), 1, 5000)))
    df = df.withColumns({"_combined": combined, "_title": F.lower(part("title"))})
    return df.withColumns(
        {"_title_words": F.array_distinct(search_words("_title")), "_words": F.array_distinct(search_words("_combined")), "_required_words": F.array_distinct(search_words(F.concat_ws(" ", *skills_)))}
    )


def signal(df: DataFrame, q: Query) -> DataFrame:
    """Adds raw, hits, title_hits and required_hits to indexed rows (with ranking_score, skill_match, viability)."""
    rank, skill, via = F.col("ranking_score"), F.col("skill_match"), F.col("viability")["score"]
    if not q.text:
        zero = F.lit(0)
        return df.withColumns({"raw": rank * 1.2 + skill * 0.45 + via * 0.25, "hits": zero, "title_hits": zero, "required_hits": zero})
    row = lambda *x: F.struct(*(v.cast("int").alias(k) for k, v in zip(("raw", "hits", "title", "required"), x, strict=True)))
    none = row(*[F.lit(0)] * 4)

    def phrase(p):
        in_title, in_text = F.contains("_title", p), F.contains("_combined", p)
        return F.when(in_title, row(F.lit(30), F.lit(2), F.lit(1), F.lit(0))).when(in_text, row(F.lit(14), F.lit(1), F.lit(0), F.lit(0))).otherwise(none)

    def token(w):
        t = (F.array_contains("_title_words", w) | F.contains("_title", w)).cast("int")
        r = F.array_contains("_required_words", w).cast("int")
        full = ((t + r == 0) & (F.array_contains("_words", w) | F.contains("_combined", w))).cast("int")
        return row(11 * t + 9 * r + 5 * full, t + r + full, t, r)

    texts = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    again = [w for w in map(word, q.tokens) if w]
    got = F.concat(F.transform(texts([p for p in q.phrases if p]), phrase), F.transform(texts(again), token))
    total = F.aggregate(got, none, lambda a, x: row(*(a[k] + x[k] for k in ("raw", "hits", "title", "required"))))
    df = df.withColumn("_got", total)
    base = skill * 0.42 + via * 0.28 + rank * 0.18
    raw = base + F.col("_got")["raw"] - F.when(F.col("_got")["hits"] == 0, 90).otherwise(0)
    return df.withColumns({"raw": raw, "hits": F.col("_got")["hits"], "title_hits": F.col("_got")["title"], "required_hits": F.col("_got")["required"]}).drop("_got")


def scored(df: DataFrame, query: str, skills: Sequence[Skill] = SKILLS, hide_unmatched: bool = False, tie: str = "row_index") -> DataFrame:
    """What a query gives each row: tie, ranking_score, raw, hits, title_hits, required_hits, smart_score. Scores are
    spread over the range of the whole result, which comes as one row of two numbers from an aggregate. Texts are read
    once: what they give, a few numbers a row, is stored before that."""
    q = expand(query, skills)
    rows = stored(signal(index(df), q).select(tie, "ranking_score", "raw", "hits", "title_hits", "required_hits"), "search")
    ends = rows.agg(F.min("raw").alias("_min"), F.max("raw").alias("_max"))
    rows = rows.join(F.broadcast(ends))  # one row
    flat = F.when(F.lit(bool(q.text)), F.when(F.col("hits") > 0, 70).otherwise(20)).otherwise(50)
    spread = js_round((F.col("raw") - F.col("_min")) / (F.col("_max") - F.col("_min")) * 100)
    rows = rows.withColumn("smart_score", F.when(F.col("_max") > F.col("_min"), spread).otherwise(flat).cast("int")).drop("_min", "_max")
    if hide_unmatched and q.text:
        good = (F.col("hits") > 0) & (F.col("smart_score") >= 15)
        # with nothing left, all rows stay
        some = rows.agg(F.count_if(good).alias("_some"))
        rows = rows.join(F.broadcast(some)).filter(good | (F.col("_some") == 0)).drop("_some")
    return rows


def search(df: DataFrame, query: str, skills: Sequence[Skill] = SKILLS, hide_unmatched: bool = False, most: int = 30, tie: str = "row_index") -> DataFrame:
    """The best rows by smart_score, hits, ranking_score."""
    return scored(df, query, skills, hide_unmatched, tie).orderBy(F.desc("smart_score"), F.desc("hits"), F.desc("ranking_score"), tie).limit(most)
