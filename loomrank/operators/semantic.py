"""Hashed feature vectors of texts, their likeness, and skill match blended with it.

Vectors are made in an Arrow UDF (numpy), batch by batch: features are hashed with FNV-1a into 192 places, signs from
the hash, lengths normalised in 32-bit floats.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomrank.functions.js import blank, col, js_round, score
from loomrank.functions.lexicon import SKILLS, Skill

from .dictionary import aliases, canonical, resolve_all, skills_in
from .scoring import cosine, coverage, similarity_percent

DIMS = 192
# How much of a text counts.
MOST_TOKENS, BIGRAM_TOKENS, MOST_BIGRAMS = 2400, 1600, 1400
RESUME_CHARS, REQUIRED_CHARS, PREFERRED_CHARS, FULL_CHARS = 20000, 2800, 2200, 6000
_ENDING = re.compile(r"(ing|edly|ed|ly|es|s)\Z")
_SPLIT = re.compile(r"[^a-z0-9#+.\-/]+")


def fnv(text: str, h: int = 2166136261) -> int:
    for unit in np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16).tolist():
        h = (h ^ unit) * 16777619 & 0xFFFFFFFF
    return h


#: Characters up to which features are hashed together.
SHORT = 64


def hashes(names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes of each feature, fnv(x) and fnv(x + "::2"); those of SHORT characters or fewer all at once, place by place."""
    one, two = np.empty(len(names), np.uint64), np.empty(len(names), np.uint64)
    size = np.fromiter(map(len, names), np.int64, len(names))
    # the longest first, so that those that go on are a head of the rows
    order = np.argsort(-size, kind="stable")
    long = int((size > SHORT).sum())
    for k in order[:long].tolist():
        one[k] = h = fnv(names[k])
        two[k] = fnv("::2", h)
    order = order[long:]
    units = np.frombuffer("".join(map(names.__getitem__, order.tolist())).encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(units) and units.max() > 0xFFFF:  # of two units in UTF-16
        for k in order.tolist():
            one[k] = h = fnv(names[k])
            two[k] = fnv("::2", h)
        return one, two
    n = size[order]
    start, h, mask = np.cumsum(n) - n, np.full(len(order), 2166136261, np.uint64), np.uint64(0xFFFFFFFF)
    going = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), "left")
    for i, k in enumerate(going.tolist()):
        h[:k] = (h[:k] ^ units[start[:k] + i]) * np.uint64(16777619) & mask
    one[order] = h
    for unit in b"::2":
        h = (h ^ np.uint64(unit)) * np.uint64(16777619) & mask
    two[order] = h
    return one, two


@lru_cache(maxsize=1 << 16)
def _of_token(t: str) -> tuple[str, ...]:
    """The features of a token alone; texts share most of theirs, so a worker keeps them."""
    return (f"tok:{t}", *(f"tri:{t[i : i + 3]}" for i in range(len(t) - 2))) if len(t) >= 4 else (f"tok:{t}",)


def _token_features(t: str) -> tuple[str, ...]:
    return _of_token(t) if len(t) <= SHORT else _of_token.__wrapped__(t)


def features(text: str, named: Sequence[str] = ()) -> Counter:
    """Counts of stemmed tokens, their trigrams and bigrams, and of skills that the text names."""
    tokens = [t for t in _SPLIT.split(" ".join((text or "").lower().split())) if t]
    tokens = [t for t in (t if len(t) <= 3 else _ENDING.sub("", t, count=1) for t in tokens) if len(t) >= 2][:MOST_TOKENS]
    out: Counter = Counter(chain.from_iterable(map(_token_features, tokens)))
    head = tokens[:BIGRAM_TOKENS]
    out.update(f"bg:{a} {b}" for a, b in list(zip(head, head[1:], strict=False))[:MOST_BIGRAMS])
    for s in named:
        out[f"skill:{s}"] += 2.4
    return out


def vector(counts: Counter) -> np.ndarray:
    out = np.zeros(DIMS, np.float32)
    h = np.stack(hashes(list(counts)), 1)
    w = np.array([n**0.5 for n in counts.values()], np.float64)[:, None] * np.array([1.0, 0.5])
    # added one after the other, as sums of 32-bit floats depend on the order
    np.add.at(out, (h % np.uint64(DIMS)).astype(np.int64).ravel(), np.where(h & np.uint64(1), w, -w).astype(np.float32).ravel())
    length = float(np.sqrt((out.astype(np.float64) ** 2).sum()))
    return (out / np.float32(length)) if length > 0 else out


@lru_cache(maxsize=8)
def _vectors(skills: tuple[Skill, ...]):
    """A UDF for vectors of texts. Skills are looked up in it: the optimiser loses a UDF whose argument has functions of arrays."""
    table = [(s.key, [(x["text"], x["pattern"]) for x in aliases(s)]) for s in skills]

    def of(texts: pd.Series) -> pd.Series:
        known = [(k, [(t, re.compile(p)) for t, p in names]) for k, names in table]

        def named(low: str) -> list[str]:
            return [k for k, names in known if any(t in low and p.search(low) for t, p in names)]

        return pd.Series([vector(features(t, named(t.lower()))) for t in texts])

    return F.pandas_udf(of, T.ArrayType(T.FloatType()))


def constant(spark: SparkSession, text: str, skills: Sequence[Skill] = SKILLS) -> Column:
    """The vector of one given text as a literal, so that no row works it out again."""
    named = spark.range(1).select(skills_in(F.lit(text), skills).alias("n")).first()["n"]
    return F.array(*(F.lit(float(x)).cast("float") for x in vector(features(text, named))))


def embedding(text: Column | str, skills: Sequence[Skill] = SKILLS) -> Column:
    """The unit vector of a text, 192 floats; zeros for an empty one."""
    return _vectors(tuple(skills))(blank(text, ""))


def semantic_match(
    owned_skills: Column, resume_text: Column | str, required: Column | str, preferred: Column | str, required_lines: Column | str,
    preferred_lines: Column | str, full_text: Column | str, title: Column | str, role: Column | str, skills: Sequence[Skill] = SKILLS,
) -> Column:
    """(score, required_coverage, role_similarity), null where there is nothing to compare."""
    lines = lambda c: F.array_join(F.coalesce(col(c), F.array().cast("array<string>")), " ")
    need, like = resolve_all(required, skills), resolve_all(preferred, skills)
    resume = F.substring(F.trim(F.concat_ws(" ", F.array_join(owned_skills, " "), blank(resume_text, ""))), 1, RESUME_CHARS)
    wanted = F.trim(F.concat_ws(" ", F.array_join(need, " "), lines(required_lines)))
    liked = F.trim(F.concat_ws(" ", F.array_join(like, " "), lines(preferred_lines)))
    full, head = blank(full_text, ""), blank(title, "")
    own = embedding(resume, skills)
    whole = embedding(F.substring(F.concat_ws(" ", head, full), 1, FULL_CHARS), skills)
    sim = lambda a, b: similarity_percent(cosine(a, b)).cast("double")
    required_sim = sim(own, embedding(F.when(wanted != "", wanted).otherwise(F.substring(full, 1, REQUIRED_CHARS)), skills))
    preferred_sim = sim(own, embedding(F.when(liked != "", liked).otherwise(F.substring(full, 1, PREFERRED_CHARS)), skills))
    full_sim = sim(own, whole)
    r = F.trim(blank(role, ""))
    role_sim = F.when(r != "", sim(embedding(r, skills), whole))
    owned = canonical(owned_skills, skills)
    need_cov = coverage(owned, F.when(F.size(need) > 0, need).otherwise(skills_in(wanted, skills)))
    like_cov = coverage(owned, F.when(F.size(like) > 0, like).otherwise(skills_in(liked, skills)))
    total = (
        F.when(need_cov.isNotNull(), need_cov["ratio"] * 58).otherwise(required_sim * 0.46)
        + F.when(like_cov.isNotNull(), like_cov["ratio"] * 14).otherwise(preferred_sim * 0.07)
        + required_sim * 0.14 + full_sim * 0.12 + F.coalesce(role_sim * 0.1, F.lit(0.0))
    )
    ratio = need_cov["ratio"]
    total += F.when(F.coalesce(need_cov["total"], F.lit(0)) >= 4, F.when(ratio >= 0.7, 9).when(ratio >= 0.5, 4).when(ratio < 0.3, -10).otherwise(0)).otherwise(0)
    total -= F.when(role_sim < 30, 6).otherwise(0)
    some = (resume != "") & ((wanted != "") | (liked != "") | (full != ""))
    return F.when(some, F.struct(score(total).alias("score"), need_cov.alias("required_coverage"), role_sim.alias("role_similarity")))


def hybrid(base: Column | str, semantic: Column | str) -> Column:
    """Skill match with the semantic score: base where there is none."""
    b, s = col(base), col(semantic)
    ratio, total = s["required_coverage"]["ratio"], F.coalesce(s["required_coverage"]["total"], F.lit(0))
    out = js_round(b * 0.64 + s["score"] * 0.36)
    out = F.when((total >= 3) & (ratio >= 0.65), F.greatest(out, js_round(b * 0.72 + s["score"] * 0.28 + 4))).otherwise(out)
    out = F.when((total >= 3) & (ratio < 0.28) & (b > 36), F.greatest(F.lit(0), out - 7)).otherwise(out)
    out = F.when(s["role_similarity"] < 28, F.greatest(F.lit(0), out - 5)).otherwise(out)
    return F.when(s.isNull(), b).otherwise(score(out)).cast("int")
