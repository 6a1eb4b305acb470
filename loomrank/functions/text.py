"""Text primitives: normalising, tokens, stems, n-grams, sentences and hashes, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .js import SPACE, blank, col, let, span

TEXTS = "array<string>"
#: A character of a token.
TOKEN = r"[a-z0-9#+.\-/]"


def normalize(text: Column | str) -> Column:
    """White space of any kind as one space, none at the ends; null as empty."""
    # a space before a plain character needs no replacing; plain characters are told by one range
    return F.trim(F.regexp_replace(blank(text, ""), f"[^!-~](?:(?<! )|(?![!-~]))(?<={SPACE}){SPACE}*", " "))


def normalize_token(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(blank(text, "")), r"[^a-z0-9#+.\-/ ]", ""))


def stem(word: Column | str) -> Column:
    """Drops a common ending from words of four letters or more."""
    w = col(word)
    return F.when(F.length(w) <= 3, w).otherwise(F.regexp_replace(w, r"(ing|edly|ed|ly|es|s)\z", ""))


def tokenize(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(blank(text, "")), F.lit(f"{TOKEN}+"), 0)


def ngrams(tokens: Column | str, least: int, most: int) -> Column:
    """All runs of least to most tokens, the short ones first, each size in the order of the text."""


    def of(t: Column, n: int) -> Column:
        heads = F.slice(t, F.lit(1), F.greatest(F.lit(0), F.size(t) - n + 1))
        return t if n == 1 else F.transform(heads, lambda x, i: F.concat_ws(" ", x, *(F.get(t, i + k) for k in range(1, n))))

    return let(tokens, lambda t: F.concat(*(of(t, n) for n in range(least, most + 1))))


def n_ngrams(tokens: Column | str, least: int, most: int) -> Column:
    """How many runs ngrams() gives, without making them."""
    return sum((F.greatest(F.lit(0), F.size(col(tokens)) - n + 1) for n in range(least, most + 1)), F.lit(0))


def last_ngram(tokens: Column | str, least: int, most: int) -> Column:
    """The last run that ngrams() gives: that of the last tokens alone."""
    return F.get(F.reverse(ngrams(F.slice(col(tokens), -F.least(F.greatest(F.size(col(tokens)), F.lit(1)), F.lit(most)), F.lit(most)), least, most)), F.lit(0))


def sentences(text: Column | str) -> Column:
    """Parts that end with . ! or ? before a space."""
    return sentences_of(normalize(text))


def sentences_of(normal: Column | str) -> Column:
    """The sentences of a normalised text: its spaces stand alone, so the parts need no trimming."""
    return F.filter(F.split(col(normal), " (?<=[.!?] )"), lambda x: x != "")


def first_number(text: Column | str) -> Column:
    return F.regexp_extract(F.regexp_replace(blank(text, ""), ",", ""), r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def first_percent(text: Column | str) -> Column:
    return F.regexp_extract(blank(text, ""), r"(-?\d+(?:\.\d+)?)\s*%", 1).try_cast("double")


def comma_list(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(blank(text, ""), ","), lambda x: F.trim(x)), lambda x: x != "")


def compact(text: Column | str) -> Column:
    return F.regexp_replace(F.lower(blank(text, "")), r"[^a-z0-9#+]+", "")


def title_key(text: Column | str) -> Column:
    # a space that stands alone needs no replacing
    return F.trim(F.regexp_replace(F.lower(blank(text, "")), "(?! [a-z0-9])[^a-z0-9]+", " "))


def clean_noise(text: Column | str) -> Column:
    """Without the names of icons that fonts leave in texts."""
    return normalize(F.regexp_replace(F.regexp_replace(blank(text, ""), r"(?i)(?<![A-Za-z0-9_])(?:launch|open_in_new|more_vert|chevron_(?:left|right)|arrow_(?:back|forward))(?![A-Za-z0-9_])", " "), r"[_|]+", " "))


#: An ending of a token of four characters or more, where tokens stand between spaces.
ENDING = r"(?:(?<=[^ ])ing|edly|(?<=[^ ]{2})(?:ed|ly|es)|(?<=[^ ]{3})s)(?![^ ])"


def search_words(text: Column | str) -> Column:
    """Stemmed tokens of two letters or more. Endings are cut from all tokens at once."""
    spaced = F.regexp_replace(F.lower(blank(text, "")), r"[^a-z0-9#+.\-/]+", " ")
    return F.regexp_extract_all(F.regexp_replace(spaced, ENDING, ""), F.lit("[^ ]{2,}"), 0)


# Number words.
NUMBERS = dict(zip("one two three four five six seven eight".split(), range(1, 9), strict=True)) | dict(zip("first second third fourth fifth sixth seventh eighth".split(), range(1, 9), strict=True))


def word_to_number(word: Column | str) -> Column:
    """A number word, ordinal or figure as an integer."""
    w = F.lower(F.trim(col(word)))
    table = F.create_map(*(F.lit(x) for pair in NUMBERS.items() for x in pair))
    return F.coalesce(table[w], F.regexp_replace(w, r"(st|nd|rd|th)\z", "").try_cast("int"))


def hash32(text: Column | str) -> Column:
    """FNV-1a of 32 bits over the UTF-16 code units of a text."""
    units = F.hex(F.encode(col(text), "UTF-16BE"))
    codes = F.transform(span(1, (F.length(units) / 4).cast("int")), lambda i: F.conv(F.substr(units, i * 4 - 3, F.lit(4)), 16, 10).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF)))


def fingerprint(text: Column | str) -> Column:
    """Hexadecimal hash of the first 12,000 normalised characters, as a key for caches."""
    return F.lower(F.hex(hash32(F.substring(normalize(text), 1, 12000))))


def unescape_js(text: Column | str) -> Column:
    """A quoted script literal's value."""
    out = col(text)
    for a, b in ((r"\n", "\n"), (r"\r", "\r"), (r"\t", "\t"), (r"\'", "'"), (r"\"", '"'), (r"\/", "/"), (r"&", "&"), (r"=", "="), (r"\x26", "&"), (r"\x3d", "="), ("\\\\", "\\")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def escape_html(text: Column | str) -> Column:
    out = blank(text, "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def function_names(snippet: Column | str) -> Column:
    """Names that are called in a script, the first 24."""
    names = F.regexp_extract_all(blank(snippet, ""), F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*)\s*\("), 1)
    return F.slice(F.array_distinct(names), 1, 24)
