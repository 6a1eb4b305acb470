"""Matching texts and skills against a dictionary.

The dictionary is a literal array inside the expression, so matching is a narrow projection: no join, no explode and no
shuffle. Each alias is first looked for as plain text, which is cheap; only those found are confirmed by their pattern.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomrank.functions.js import blank, col, constant, js_round, let, listed, matches, unique, whole_word
from loomrank.functions.lexicon import CATEGORY_FACTORS, EQUIVALENTS, FACULTIES, FIELD_ALIASES, FIELD_PATTERNS, SKILLS, UNTECHNICAL, Skill
from loomrank.functions.text import normalize_token


def token(text: str) -> str:
    """normalize_token of a known text."""
    return "".join(c for c in text.lower() if c.isascii() and (c.isalnum() or c in "#+.-/ ")).strip()


def lookup(skills: Sequence[Skill] = SKILLS) -> dict[str, str]:
    """The key of each alias. A key is its own alias whatever came before; of aliases the first counts."""
    out: dict[str, str] = {}
    for s in skills:
        out[token(s.key)] = s.key
        for a in (s.key, *s.aliases):
            if token(a):
                out.setdefault(token(a), s.key)
    return out


def _map(pairs: Mapping[str, object], kind: str) -> Column:
    return constant(pairs, f"map<string,{kind}>")


def resolve(value: Column | str, skills: Sequence[Skill] = SKILLS) -> Column:
    """A skill's key: the value itself if it is one, else the key that has it as an alias, else the value."""
    keys, known = constant([s.key for s in skills], "array<string>"), _map(lookup(skills), "string")
    return let(F.trim(blank(value, "")), lambda raw: F.when(F.array_contains(keys, raw), raw).otherwise(F.coalesce(known[normalize_token(raw)], raw)))


def resolve_all(values: Column | str, skills: Sequence[Skill] = SKILLS) -> Column:
    return unique(F.transform(F.coalesce(col(values), F.array().cast("array<string>")), lambda v: resolve(v, skills)))


def canonical(values: Column | str, skills: Sequence[Skill] = SKILLS) -> Column:
    """The set of skills that some values stand for, by key and by alias."""
    known = _map(lookup(skills), "string")
    both = lambda v: unique(F.concat(resolve_all(v, skills), F.transform(v, lambda x: known[normalize_token(x)])))
    return let(F.coalesce(col(values), F.array().cast("array<string>")), both)


def has_skill(owned: Column | str, key: Column, equivalents: Mapping[str, Sequence[str]] = EQUIVALENTS) -> Column:
    """Whether a set has the skill or one that counts for it."""
    others = _map({k: list(v) for k, v in equivalents.items()}, "array<string>")
    return F.array_contains(col(owned), key) | F.coalesce(F.arrays_overlap(col(owned), others[key]), F.lit(False))


def aliases(s: Skill, own_key: bool = True) -> list[dict]:
    """The texts that a skill goes by, each with the pattern that finds it."""
    names = dict.fromkeys(token(a) for a in ((s.key, *s.aliases) if own_key else s.aliases) if token(a))
    return [{"text": a, "pattern": whole_word(a)} for a in names]


def _entries(skills: Sequence[Skill], own_key: bool) -> Column:
    return constant([{"key": s.key, "aliases": aliases(s, own_key)} for s in skills], "array<struct<key:string,aliases:array<struct<text:string,pattern:string>>>>")


def hits(text: Column | str, skills: Sequence[Skill] = SKILLS, own_key: bool = True) -> Column:
    """How often each skill that occurs is named: array of (key, hits) in the dictionary's order. Overlapping aliases
    count each."""


    def of(low: Column) -> Column:
        named = lambda e: F.filter(e["aliases"], lambda a: F.contains(low, a["text"]))
        count = lambda e: F.aggregate(named(e), F.lit(0), lambda n, a: n + F.regexp_count(low, a["pattern"]))
        counted = F.transform(_entries(skills, own_key), lambda e: F.struct(e["key"].alias("key"), count(e).alias("hits")))
        return F.filter(counted, lambda x: x["hits"] > 0)

    return let(F.lower(blank(text, "")), of)


#: A dictionary of no more aliases is written out.
FEW_ALIASES = 32


def skills_in(text: Column | str, skills: Sequence[Skill] = SKILLS, own_key: bool = True) -> Column:
    """Keys of the skills that a text names. Without own_key only aliases count, as in postings' sentences."""
    names = [(s.key, aliases(s, own_key)) for s in skills]

    def few(low: Column) -> Column:
        of = lambda a: F.when(F.contains(low, F.lit(a["text"])), low.rlike(a["pattern"])).otherwise(False)
        return listed([(reduce(Column.__or__, map(of, entry)), key) for key, entry in names if entry])

    def of(low: Column) -> Column:
        # when() rather than &: inside a UDF's argument the optimiser may put the sides of & in another order, and then lose the UDF
        named = lambda e: F.exists(e["aliases"], lambda a: F.when(F.contains(low, a["text"]), F.regexp_like(low, a["pattern"])).otherwise(False))
        return F.transform(F.filter(_entries(skills, own_key), named), lambda e: e["key"])

    # patterns as literals are compiled once, those of a table at each use; but many would make a large expression
    return let(F.lower(blank(text, "")), few if 0 < sum(len(entry) for _, entry in names) <= FEW_ALIASES else of)


def skills_in_sentences(sentences: Column | str, skills: Sequence[Skill] = SKILLS) -> Column:
    # no alias spans a line's end, so the sentences can be searched at once
    return skills_in(F.array_join(col(sentences), "\n"), skills, own_key=False)


def factor(key: Column, skills: Sequence[Skill] = SKILLS) -> Column:
    """The weight of a skill's category; 1 for others."""
    return F.coalesce(_map({s.key: CATEGORY_FACTORS[s.category] for s in skills if s.category in CATEGORY_FACTORS}, "double")[key], F.lit(1.0))


def is_technical(key: Column, skills: Sequence[Skill] = SKILLS) -> Column:
    soft = [s.key for s in skills if s.category in UNTECHNICAL]
    return ~key.isin(soft) if soft else F.lit(True)


def mention_weights(text: Column | str, skills: Sequence[Skill] = SKILLS) -> Column:
    """Array of (key, hits, weight): (0.75 + 0.42 a hit, 2.4 at most) times base weight and category, to 3 places."""
    weights = _map({s.key: s.weight for s in skills}, "double")
    w = lambda x: js_round((0.75 + F.least(F.lit(2.4), x["hits"] * 0.42)) * weights[x["key"]] * factor(x["key"], skills) * 1000) / 1000
    return F.transform(hits(text, skills), lambda x: F.struct(x["key"].alias("key"), x["hits"].alias("hits"), w(x).alias("weight")))


def profile_fields(text: Column | str, fields: Mapping[str, Sequence[str]] = FIELD_ALIASES) -> Column:
    """Fields of study that a profile names anywhere, also inside words."""
    table = constant([{"field": k, "aliases": list(v)} for k, v in fields.items()], "array<struct<field:string,aliases:array<string>>>")
    named = lambda low: F.filter(table, lambda e: F.exists(e["aliases"], lambda a: F.contains(low, a)))
    return let(F.lower(blank(text, "")), lambda low: F.transform(named(low), lambda e: e["field"]))


def _named(low: Column, pattern: str) -> Column:
    """Whether a lower-case text matches a pattern. Alternatives of plain words are looked for as text, bounded ones first so:
    patterns are slow on long texts."""
    if re.search(r"[()\[\]{}]", pattern):
        return matches(low, pattern)
    out = F.lit(False)
    for part in pattern.split("|"):
        plain = re.fullmatch(r"([a-z ]+?)(?:[a-z]\?)?", part)
        bounded = re.fullmatch(r"\\b([a-z]+)\\b", part)
        if plain:
            out = out | F.contains(low, F.lit(plain[1] if part.endswith("?") else part))
        elif bounded:
            out = out | F.when(F.contains(low, F.lit(bounded[1])), matches(low, part)).otherwise(False)
        else:
            out = out | matches(low, part)
    return out


def posting_fields(text: Column | str, fields: Mapping[str, str] = FIELD_PATTERNS) -> Column:
    """Fields of study that a posting's sentence names."""
    # patterns as literals are compiled once; as values of a table they would be for each row
    return let(F.lower(blank(text, "")), lambda low: listed([(_named(low, p), k) for k, p in fields.items()]))


def faculty(text: Column | str) -> Column:
    """One of the faculties; Engineering where nothing else is named."""
    low = F.lower(F.trim(blank(text, "")))
    out = F.lit(None).cast("string")
    for name in FACULTIES:
        out = F.coalesce(out, F.when(low == name.lower(), F.lit(name)))
    for name, pattern in FACULTIES.items():
        out = F.coalesce(out, F.when(low.rlike(pattern), F.lit(name)))
    return F.coalesce(out, F.lit("Engineering"))


def canonical_entry(value: Column | str, skills: Sequence[Skill] = SKILLS) -> Column:
    """What a skill typed by hand is kept as: the key of an alias, else its token of two letters or more, else ''."""
    t = normalize_token(value)
    return F.coalesce(_map(lookup(skills), "string")[t], F.when(F.length(t) >= 2, t).otherwise(""))


def suggestions(query: Column | str, skills: Sequence[Skill] = SKILLS, most: int = 12) -> Column:
    """Array of (key, alias) that complete a query: equal, then starting with it, then having it; per key its best and
    shortest alias; ties by key."""
    q = normalize_token(query)
    table = F.array(*(F.struct(F.lit(a).alias("alias"), F.lit(k).alias("key"), F.lit(token(k)).alias("own")) for a, k in lookup(skills).items()))

    def rank(e: Column) -> Column:
        return (
            F.when(e["alias"] == q, 0.0).when(e["own"] == q, 0.25).when(F.startswith(e["alias"], q), 1.0)
            .when(F.startswith(e["own"], q), 1.5).when(F.contains(e["alias"], q), 2.0)
        )

    scored = F.transform(table, lambda e: F.struct(rank(e).alias("rank"), F.length(e["alias"]).alias("n"), e["key"].alias("key"), e["alias"].alias("alias")))
    found = F.array_sort(F.filter(scored, lambda x: x["rank"].isNotNull() & (q != "")))
    # the first of each key stays, then the keys by rank and name
    firsts = F.filter(found, lambda x, i: F.get(F.filter(found, lambda y: y["key"] == x["key"]), F.lit(0)) == x)
    ordered = F.array_sort(F.transform(firsts, lambda x: F.struct(x["rank"], x["key"].alias("key"), x["alias"].alias("alias"))))
    return F.slice(F.transform(ordered, lambda x: F.struct(x["key"].alias("key"), x["alias"].alias("alias"))), 1, most)


# What each faculty is also called.
FACULTY_ALIASES = {
    "Engineering": ["eng", "engineering"],
    "Mathematics": ["math", "mathematics", "computer science", "cs"],
    "Science": ["science", "sci"],
    "Arts": ["arts", "humanities", "social sciences"],
    "Environment": ["environment", "env", "geography", "planning"],
    "Health": ["health", "kinesiology", "public health"],
}


def faculty_suggestions(query: Column | str, most: int = 6) -> Column:
    """Faculties that complete a query, best first."""
    q = F.lower(F.trim(blank(query, "")))

    def rank(name: str, low: float, begins: float, has: float) -> Column:
        return F.when(F.lit(name) == q, low).when(F.startswith(F.lit(name), q), begins).when(F.contains(F.lit(name), q), has)

    rows = [F.struct(F.array_min(F.array(rank(f.lower(), 0.0, 1.0, 2.0), *(rank(a, 0.5, 1.2, 2.2) for a in aliases))).alias("rank"), F.lit(f).alias("name")) for f, aliases in FACULTY_ALIASES.items()]
    found = F.array_sort(F.filter(F.array(*rows), lambda x: x["rank"].isNotNull() & (q != "")))
    return F.slice(F.transform(found, lambda x: x["name"]), 1, most)
