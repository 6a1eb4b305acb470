"""Licence scans by a positional rare-token index, in DataFrame functions only.

A template is a licence's wording with a key phrase that must stand in it. Its posting is its rarest word: the word of
the key phrase that the fewest documents have, counted over all of them. A document's licence words are those that any
template has; each place of a rare one is looked up in the postings, which gives the place where the template would
begin, by relative position. There the key phrase is verified word for word, and the share of the template's words that
stand at their relative positions is its score; with LEAST_SHARE or more it gives its label. The base phrases are
templates that are nothing but their key phrase.

One pass over the texts makes words and counts; only documents that have all words of some key phrase keep their words
for the second step. No row is shuffled but the counts of the licence words, a row for each word and task.

Defined cases: a null or wordless text has no words, no labels and score 0, first_word and last_word null; a phrase that
stands more than once counts each time; repeated rows each give their row; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored, texts

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEAST_SHARE = 0.6


@dataclass(frozen=True)
class Template:
    label: str
    body: str
    key: str = ""
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.body.split()

    @property
    def phrase(self) -> list[str]:
        return (self.key or self.body).split()

    @property
    def offset(self) -> int:
        """Where the key phrase stands in the body."""
        k = len(self.phrase)
        return next(i for i in range(len(self.words)) if self.words[i : i + k] == self.phrase)


# Phrases and labels that the results must have.
BASE = [
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
]

# The wording of well-known licences' notices.
NOTICES = [
    Template("agpl", "gnu affero general public license"),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "you may not use this file except in compliance"),
    Template("boost", "boost software license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("bsd", "bsd license"),
    Template("cc-by", "creative commons attribution"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-sa", "creative commons attribution sharealike"),
    Template("cc0", "cc0 1 0 universal"),
    Template("epl", "eclipse public license"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "you can redistribute it and or modify it under the terms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose with or without fee"),
    Template("lgpl", "gnu lesser general public license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    Template("mpl", "mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]
TEMPLATES = BASE + NOTICES


def _list(words: list[str]):
    return F.array(*map(F.lit, words))


def tokenised(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """The number of words of each document, its licence words, and all its words where some key phrase may stand."""
    vocabulary = sorted({w for t in templates for w in t.phrase})
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), 0)
    out = texts(docs).select("doc_id", words.alias("words")).withColumn("known", F.array_intersect("words", _list(vocabulary)))
    # a key phrase can only stand where all its words are
    may = F.lit(False)
    for t in templates:
        distinct = list(dict.fromkeys(t.phrase))
        may = may | ((F.size("known") >= len(distinct)) & (F.size(F.array_intersect("known", _list(distinct))) == len(distinct)))
    return out.select("doc_id", F.size("words").cast("long").alias("n_words"), "known", F.when((F.size("known") > 0) & may, F.col("words")).alias("words"))


def rarest(known: DataFrame, templates: list[Template]) -> list[str]:
    """The word of each template's key phrase with the highest IDF. Only counts of template words come to the driver."""
    counts = {r[0]: r[1] for r in known.select(F.explode("known").alias("w")).groupBy("w").count().collect()}
    return [min(t.phrase, key=lambda w: (counts.get(w, 0), t.phrase.index(w))) for t in templates]


def scanned(docs: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """The licences of each document, the places of base phrases and the score of the best template."""
    known = stored(tokenised(docs, templates), "licence-words")
    rare = rarest(known, templates)
    postings = F.array(
        *(
            F.struct(
                F.lit(w).alias("word"), F.lit(t.phrase.index(w)).alias("at"), _list(t.phrase).alias("key"), F.lit(t.offset).alias("off"),
                _list(t.words).alias("body"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base"),
            )
            for t, w in zip(templates, rare, strict=True)
        )
    )
    # each place of a rare word, and the templates it may belong to
    places = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(_list(sorted(set(rare))), x["w"]))
    looked_up = F.flatten(F.transform(places, lambda x: F.transform(F.filter(postings, lambda p: p["word"] == x["w"]), lambda p: F.struct((x["i"] - p["at"]).alias("s"), p.alias("p")))))
    verified = F.filter(looked_up, lambda m: (m["s"] >= 0) & (F.slice("words", F.greatest(m["s"], F.lit(0)) + 1, F.size(m["p"]["key"])) == m["p"]["key"]))

    def share(m):
        stand = F.filter(F.transform(m["p"]["body"], lambda w, j: F.get("words", m["s"] - m["p"]["off"] + j).eqNullSafe(w)), lambda same: same)
        return F.size(stand) / F.size(m["p"]["body"])

    found = F.transform(verified, lambda m: F.struct(m["s"].alias("s"), m["p"]["label"].alias("label"), m["p"]["base"].alias("base"), share(m).alias("share")))
    found = F.coalesce(F.when(F.col("words").isNotNull(), found), F.expr("cast(array() as array<struct<s:int,label:string,base:boolean,share:double>>)"))
    rows = known.select("doc_id", "n_words", found.alias("found"))
    base = F.filter("found", lambda m: m["base"])
    names = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["s"].cast("long"))
    return rows.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.filter("found", lambda m: m["share"] >= LEAST_SHARE)).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(read(spark, sf_dir, "documents"))


def oracle(templates: list[Template] = TEMPLATES) -> str:
    """Every template tried at every place."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = ",\n".join(f"({quoted(t.phrase)}, {quoted(t.words)}, {t.offset}, '{t.label}', {str(t.base).lower()})" for t in templates)
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
t(key, body, off, label, base) AS (VALUES {rows}),
p AS (SELECT doc_id, w, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
m AS (SELECT doc_id, i - 1 AS s, label, base,
             len(list_filter(range(1, len(body) + 1), lambda j: i - off + j - 1 >= 1 AND w[i - off + j - 1] = body[j])) / CAST(len(body) AS DOUBLE) AS share
      FROM p JOIN t ON w[i] = key[1] AND list_slice(w, i, i + len(key) - 1) = key),
g AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
             list_sort(list_distinct(list(label) FILTER (base))) AS bl, list_sort(list_distinct(list(label) FILTER (share >= {LEAST_SHARE}))) AS al, max(share) AS score
      FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(bl, ','), '') AS base_labels, coalesce(array_to_string(al, ','), '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN g USING (doc_id)
"""
