"""Spark expressions with the number, text and ordering rules that scores are defined by (those of ECMAScript)."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as white space.
SPACES = r"\s   -     　﻿"
SPACE = f"[{SPACES}]"
_WORD = "A-Za-z0-9_"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column | str, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often it is named, also inside functions of arrays."""
    return F.get(F.transform(F.array(col(value)), use), F.lit(0))


def constant(value, kind: str) -> Column:
    """A list or map as one literal: the optimiser sees two nodes, whatever its size, and works it out once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def js_round(x: Column | str) -> Column:
    """Rounds halves up, also below zero."""
    return F.floor(col(x) + 0.5)


def number(x: Column | str) -> Column:
    """A number, with null and NaN as 0."""
    return F.coalesce(F.nanvl(col(x).cast("double"), F.lit(0.0)), F.lit(0.0))


def clamp(x: Column | str, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), number(x)))


def score(x: Column) -> Column:
    """A rounded score from 0 to 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), js_round(x).cast("int")))


def blank(x: Column | str, default) -> Column:
    """The text, or the default where it is null or empty."""
    return F.coalesce(F.nullif(col(x), F.lit("")), F.lit(default) if not isinstance(default, Column) else default)


def unique(a: Column | str) -> Column:
    """Distinct values that aren't null or empty, the first of each kept in its place."""
    return F.array_distinct(F.filter(col(a), lambda x: x.isNotNull() & (x != "")))


def escape(text: str) -> str:
    """Text as a pattern that matches it."""
    return "".join("\\" + c if c in r".*+?^${}()|[]\/-" and c not in "/-" else c for c in text)


def whole_word(text: str) -> str:
    """A pattern for text between word boundaries, where only ASCII letters, digits and _ make words. At an edge that
    isn't such a character, a boundary needs one beside it: c++ matches in c++11, not in "c++ and"."""
    if not text:
        return ""
    inside = lambda c: c.isascii() and (c.isalnum() or c == "_")
    before = f"(?<![{_WORD}])" if inside(text[0]) else f"(?<=[{_WORD}])"
    after = f"(?![{_WORD}])" if inside(text[-1]) else f"(?=[{_WORD}])"
    return before + escape(text) + after


def ascii_bounds(pattern: str) -> str:
    r"""A pattern whose \b are boundaries of ASCII words, as lookarounds, with \s as SPACE."""
    bound = f"(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))"
    return pattern.replace(r"\b", bound).replace(r"\s", SPACE)


def matches(text: Column | str, pattern: str, ignore_case: bool = False) -> Column:
    return F.coalesce(col(text).rlike(("(?i)" if ignore_case else "") + ascii_bounds(pattern)), F.lit(False))


def first_match(text: Column | str, pattern: str, group: int = 0) -> Column:
    """The first match without white space around it, or null."""
    return F.nullif(F.trim(F.regexp_extract(col(text), "(?i)" + ascii_bounds(pattern), group)), F.lit(""))


def has_any(text: Column | str, words: Sequence[str]) -> Column:
    """Whether the text, in lower case, has any of the words anywhere."""
    return F.coalesce(any_of(F.lower(col(text)), words), F.lit(False))


def any_of(low: Column, words: Sequence[str]) -> Column:
    """Whether a text has any of the words anywhere, as they are."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def listed(pairs: Sequence[tuple[Column, Column | str]]) -> Column:
    """The values whose condition holds, in order."""
    made = [F.when(c, v if isinstance(v, Column) else F.lit(v)) for c, v in pairs]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def span(first: int, last: Column) -> Column:
    """first, first + 1, ... last; empty where last is less."""
    return F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))
