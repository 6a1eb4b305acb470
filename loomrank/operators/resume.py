"""Skills of a resume, and which of them count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomrank.functions.js import blank, col, constant, let, unique, whole_word
from loomrank.functions.lexicon import SKILLS, Skill
from loomrank.functions.text import TOKEN, compact, normalize, normalize_token

from .dictionary import canonical_entry, token

HEADINGS = r"TECHNICAL SKILLS|SKILLS|EXPERIENCE|WORK EXPERIENCE|PROJECTS|EDUCATION|SUMMARY"
SECTION_CHARS = 2500
LISTS = r"(?i)\b(technical skills|languages|frameworks\s*&\s*libraries|frameworks|libraries|tools|technologies|platforms|databases)\s*:"

# Repairs of texts as PDF layouts leave them, in the order they are made. Runs are possessive where what
# follows is no part of them: a shorter run can't match then, so none is tried.
LAYOUT = [
    (" ", " "), ("\r\n?", "\n"), (r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"[ \t]{2,}", " "),
    (r"([A-Za-z]{2,}+)-\n([a-z]{2,})", "$1-$2"), (r"([A-Za-z]{2,}+)\n([a-z]{2,})", "$1 $2"), (r"\n{3,}", "\n\n"),
]
_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)"
ARTIFACTS = [
    (r"(?i)\bTECHNICALSKILLS\b", "TECHNICAL SKILLS"), (r"(?i)\bFRAMEWORKS\s*&\s*LIBRARIES\b", "Frameworks & Libraries"), (r"(?i)\bTailwin\s+d\b", "Tailwind"),
    (r"(?i)\bDocke\s+r\b", "Docker"), (r"(?i)\bSupabas\s+e\b", "Supabase"), (r"(?i)\bIntegrat\s+e\b", "Integrate"), (r"(?i)\bCollaborat\s+ed\b", "Collaborated"),
    (r"(?i)\biterati\s+ve\b", "iterative"), (r"(?i)\bpri\s+nter\b", "printer"), (r"(?i)\bPantry\s+Pa\s+l\b", "Pantry Pal"), (r"(?i)\bFide\s+x\b", "Fidex"), (r"(?i)\bun\s+available\b", "unavailable"),
    (r"\b([A-Za-z]{4,}+)\s++([b-hj-z])\b", "$1$2"), (r"(?i)\b([A-Za-z]{4,}+)\s++(ed|er|ers|ing|ive|ion|ions|al|ally|ment|ments|able|ably)\b", "$1$2"), (r"\bun\s+([a-z]{4,})\b", "un$1"),
    (r"(?i)linkedin\.com/in/([a-z0-9]+)\s*-\s*([a-z0-9]+)\s*-\s*([a-z0-9]+)", "linkedin.com/in/$1-$2-$3"), (r"((?:^|[\n.])\s*)[xX]\s+(?=[A-Z])", "$1 - "), (r"\s+[xX]\s+(?=[A-Za-z])", " - "),
    (rf"(?i)\b({_MONTH}[a-z]*\s+\d{{4}})\s+[tT]\s+({_MONTH}[a-z]*\s+\d{{4}}|Present|Current)\b", "$1 - $2"), (r"\b([A-Za-z]{3,}+)\s++t\s++(University|College|Institute|School)\b", "$1 - $2"),
    (r"(?i)\bPresen-\b", "Present "), (r"\b([A-Za-z]{2,}+)\s*+-\s*+([A-Za-z]{2,}+)\b", "$1-$2"), (r"\b([A-Za-z]++(?:-[A-Za-z]++)+)\s*+-\s*+([A-Za-z]{2,}+)\b", "$1-$2"),
]
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
#: Three single letters or more with spaces between them are one word.
SPACED = r"(?:\b(?=(?:[A-Za-z]\s+){2,}[A-Za-z]\b)|(?<!^)\G)([A-Za-z])\s+(?=[A-Za-z]\b)"
PDF_REPAIRS = [
    (CONTROLS, " "), (SPACED, "$1"), (r"[•·▪◦●]", " "), (r"\s+[|]\s+", " | "), (r"\b(\d{3})\s+(\d)\b", "$1$2"), (r"\b([B-HJ-Z])\s+([a-z]{4,})\b", "$1$2"),
    (r"\b(\d{4})\s+[tT]\s+(Present|Current)\b", "$1 - $2"), (r"\s+([,.;:!?])", "$1"), (r"\s{2,}", " "),
]


def _replaced(text: Column, table: list[tuple[str, str]]) -> Column:
    for pattern, new in table:
        text = F.regexp_replace(text, pattern, new)
    return text


def normalize_resume(text: Column | str) -> Column:
    """Lines that layout has broken joined again, and section headings on lines of their own."""
    out = F.trim(_replaced(blank(text, ""), LAYOUT))
    out = F.regexp_replace(out, rf"\b({HEADINGS})\b", "\n$1\n")
    return F.btrim(F.regexp_replace(out, r"\n{3,}", "\n\n"), F.lit(" \n\t"))


def repair(text: Column | str) -> Column:
    return _replaced(blank(text, ""), ARTIFACTS)


def sanitize_pdf(text: Column | str) -> Column:
    """A PDF's text without control characters and split words."""
    return normalize_resume(repair(_replaced(blank(text, ""), PDF_REPAIRS)))


def technical_section(text: Column | str) -> Column:
    """From "technical skills" to the next section, 2,500 characters at most."""
    t = col(text)
    at = F.regexp_instr(t, F.lit(r"(?i)\btechnical\s*skills\b"))
    window = F.substr(t, F.greatest(at, F.lit(1)), F.lit(SECTION_CHARS))
    end = F.regexp_instr(window, F.lit(r"(?i)\b(experience|work experience|projects|education)\b"))
    return F.when(at < 1, "").when(end > 1, F.substr(window, F.lit(1), end - 1)).otherwise(window)


def candidates(section: Column | str) -> Column:
    """Items of the lists in a section."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(col(section), "[•·▪◦●]", ", "), LISTS, "\n"), r"\s+[|]\s+", ", "), r"[ \t]{2,}", " ")
    parts = F.filter(F.transform(F.split(t, r"[\n,;]+"), lambda x: F.trim(x)), lambda p: (F.length(p) >= 2) & (F.length(p) <= 80))
    slashed = F.filter(parts, lambda p: p.rlike(r"\s/\s") & ~p.rlike(r"(?i)c/c\+\+|can/lin"))
    return F.concat(parts, F.filter(F.flatten(F.transform(slashed, lambda p: F.transform(F.split(p, r"\s/\s"), lambda x: F.trim(x)))), lambda p: F.length(p) >= 2))


def _compact(text: str) -> str:
    return "".join(c for c in text.lower() if c.isascii() and (c.isalnum() or c in "#+"))


def resume_skills(text: Column | str, skills: Sequence[Skill] = SKILLS, compat: bool = True) -> Column:
    """Keys of the skills that a resume gives any evidence of, sorted. compat: also where an alias with marks, or a long
    one, shows up in the text without separators, even inside other words."""
    rows = []
    for s in skills:
        names = {t: a for a in reversed(s.aliases) if (t := token(a))}
        shown = [{"text": t, "pattern": whole_word(t), "compact": _compact(t), "loose": compat and (any(x in "+#/.- " for x in a) or len(_compact(t)) >= 6)} for t, a in names.items()]
        rows.append({"key": s.key, "aliases": shown})
    table = constant(rows, "array<struct<key:string,aliases:array<struct<text:string,pattern:string,compact:string,loose:boolean>>>>")

    def views(clean: Column) -> Column:
        items = F.transform(candidates(technical_section(clean)), normalize_token)
        without_s = lambda i: F.when(F.endswith(i, F.lit("s")) & (F.length(i) > 4), F.regexp_replace(i, r"s\z", "")).otherwise(i)
        tight = lambda mark: lambda i: F.regexp_replace(i, rf"\s*{mark}\s*", mark)
        variants = let(items, lambda x: F.array_distinct(F.concat(x, F.transform(x, without_s), F.transform(x, tight("/")), F.transform(x, tight("-")))))
        # a text is long: it is normalised and lower-cased once, and its tokens are never taken apart
        spaced = lambda low: F.concat(F.lit(" "), F.trim(F.regexp_replace(low, f"(?! {TOKEN})[^{TOKEN[1:]}+", " ")), F.lit(" "))
        squeezed = lambda low: F.regexp_replace(low, "[^a-z0-9#+]+", "")
        return let(F.lower(normalize(clean)), lambda low: F.struct(low.alias("low"), squeezed(low).alias("squeezed"), spaced(low).alias("tokens"), variants.alias("variants")))

    def found(v: Column) -> Column:
        # a run of tokens is an n-gram of the text
        gram = lambda a: F.contains(v["tokens"], F.concat(F.lit(" "), a["text"], F.lit(" "))) & (F.length(F.regexp_replace(a["text"], "[^ ]+", "")) < 3)
        named = lambda a: F.contains(v["low"], a["text"]) & (F.regexp_like(v["low"], a["pattern"]) | gram(a))
        squeezed = F.transform(v["variants"], compact)
        listed = lambda a, sq: F.array_contains(v["variants"], a["text"]) | ((F.length(a["compact"]) >= 3) & F.array_contains(sq, a["compact"]))
        loose = lambda a: a["loose"] & (a["compact"] != "") & F.contains(v["squeezed"], a["compact"])
        return let(squeezed, lambda sq: F.transform(F.filter(table, lambda e: F.exists(e["aliases"], lambda a: named(a) | listed(a, sq) | loose(a))), lambda e: e["key"]))

    return F.array_sort(F.array_distinct(let(let(normalize_resume(repair(text)), views), found)))


def effective_skills(parsed: Column | str, excluded: Column | str, manual: Column | str) -> Column:
    """Parsed skills without excluded ones (whatever their case), and all manual ones."""
    none = F.array().cast("array<string>")
    out = F.transform(F.coalesce(col(excluded), none), lambda x: F.lower(F.trim(x)))
    kept = F.filter(F.coalesce(col(parsed), none), lambda s: ~F.array_contains(out, F.lower(F.trim(s))))
    return F.array_sort(unique(F.concat(kept, F.coalesce(col(manual), none))))


def _excluded(excluded: Column | str) -> Column:
    tidy = F.transform(F.coalesce(col(excluded), F.array().cast("array<string>")), lambda x: F.lower(F.trim(F.coalesce(x, F.lit("")))))
    return unique(F.filter(tidy, lambda x: x != ""))


def still_excluded(excluded: Column | str, parsed: Column | str) -> Column:
    """What stays excluded when a resume is parsed anew: skills that it still gives."""
    none = F.array().cast("array<string>")
    return let(F.transform(F.coalesce(col(parsed), none), lambda s: F.lower(s)), lambda now: F.filter(F.coalesce(col(excluded), none), lambda x: F.array_contains(now, F.lower(F.coalesce(x, F.lit(""))))))


def hidden(excluded: Column | str, skill: Column | str) -> Column:
    """The excluded skills with one more."""
    key = F.lower(F.trim(blank(skill, "")))
    return let(_excluded(excluded), lambda x: F.when((key == "") | F.array_contains(x, key), x).otherwise(F.array_append(x, key)))


def restored(excluded: Column | str, skill: Column | str) -> Column:
    """The excluded skills without one."""
    return F.array_remove(_excluded(excluded), F.lower(F.trim(blank(skill, ""))))


def manual_added(weights: Column | str, excluded: Column | str, typed: Column | str, skills: Sequence[Skill] = SKILLS) -> Column:
    """(weights, excluded, added): a typed skill with a weight of 1 in the map of manual ones and no longer excluded. What
    names no skill changes nothing."""
    own = F.coalesce(col(weights), F.create_map().cast("map<string,double>"))

    def put(key: Column) -> Column:
        more = F.map_concat(F.map_filter(own, lambda k, _: k != key), F.create_map(key, F.lit(1.0)))
        was = _excluded(excluded)
        after = F.when(F.array_contains(was, F.lower(key)), F.array_remove(was, F.lower(key))).otherwise(F.coalesce(col(excluded), F.array().cast("array<string>")))
        kept = F.coalesce(col(excluded), F.array().cast("array<string>"))
        return F.struct(F.when(key == "", own).otherwise(more).alias("weights"), F.when(key == "", kept).otherwise(after).alias("excluded"), (key != "").alias("added"))

    return let(canonical_entry(typed, skills), put)


def manual_removed(weights: Column | str, skill: Column | str) -> Column:
    key = F.trim(blank(skill, ""))
    return F.map_filter(col(weights), lambda k, _: k != key)


def positive_keys(weights: Column | str) -> Column:
    """Keys of a map of skills with positive weights."""
    return F.map_keys(F.map_filter(col(weights), lambda _, v: v > 0))


def inventory(parsed: Column | str, excluded: Column | str, manual: Column | str) -> Column:
    """(active, parsed_active, manual, hidden)."""
    none = F.array().cast("array<string>")
    p, m = F.coalesce(col(parsed), none), F.coalesce(col(manual), none)
    kept = effective_skills(p, excluded, none)
    return F.struct(F.size(effective_skills(p, excluded, m)).alias("active"), F.size(kept).alias("parsed_active"), F.size(m).alias("manual"), (F.size(p) - F.size(kept)).alias("hidden"))


# Text quality: is an extracted text a resume, and which of several is the best?
METADATA = r"(?i)\b(?:FontDescriptor|FontName|FontBBox|BaseFont|CapHeight|AvgWidth|MaxWidth|StemV|Ascent|Descent|ItalicAngle|FlateDecode|Type0|CIDFont)\b"
PDF_WORDS = r"(?i)\b(?:obj|endobj|stream|endstream|xref|trailer|startxref)\b"
RESUME_WORDS = r"(?i)\b(?:education|experience|employment|skills|projects|work|intern|developer|engineer|university|bachelor|summary|linkedin|github|portfolio)\b"


def quality(text: Column | str) -> Column:
    """Counts that tell prose from the inside of a file."""
    t = blank(text, "")
    n = lambda p: F.regexp_count(t, F.lit(p))
    # runs are cut out, which takes fewer matches than counting characters
    of = lambda p: F.length(t) - F.length(F.regexp_replace(t, p, ""))

    def counts(words: Column) -> Column:
        some = lambda p: F.size(F.filter(words, lambda w: w.rlike(p)))
        return F.struct(
            F.size(words).alias("words"), of("[A-Za-z]+").alias("letters"), of(r"\d+").alias("digits"), n("/[A-Za-z][A-Za-z0-9-]{1,}").alias("slashed"), n(METADATA).alias("metadata"),
            n(PDF_WORDS).alias("pdf_words"), some(r"^\d+(?:[.-]\d+)*\z").alias("numeric"), some("[A-Za-z]{2,}").alias("alpha"), some("[A-Za-z]{4,}").alias("long"), n(RESUME_WORDS).alias("signals"),
        )

    return let(F.filter(F.split(t, r"\s+"), lambda w: w != ""), counts)


def is_metadata(text: Column | str, q: Column | None = None) -> Column:
    t = blank(text, "")
    q = quality(t) if q is None else q
    dense = q["slashed"] / F.greatest(q["words"], F.lit(1)) > 0.2
    return (t == "") | (q["metadata"] >= 2) | (q["pdf_words"] >= 2) | (dense & (q["metadata"] > 0)) | t.rlike("(?i)/Type/FontDescriptor")


def is_resume(text: Column | str, strict: bool = False, q: Column | None = None) -> Column:
    """Whether a (sanitised) text reads like a resume. q: its quality, if that is known."""
    t = blank(text, "")
    if q is None:
        return let(quality(t), lambda known: is_resume(text, strict, known))
    n = F.greatest(q["words"], F.lit(1))
    alpha, contact = q["alpha"] / n, t.rlike(r"(?i)@|linkedin\.com|github\.com")
    bad = (alpha < 0.45) | (q["slashed"] / n > 0.18) | ((q["digits"] > q["letters"] * 0.92) & (alpha < 0.7)) | ((q["numeric"] / n > 0.45) & (alpha < 0.72))
    enough = contact | (q["signals"] >= 2) if strict else contact | (q["signals"] >= 1) | (q["words"] >= 120)
    return ~is_metadata(t, q) & (q["words"] >= (40 if strict else 20)) & ~bad & enough


def text_score(text: Column | str, signs_of: Sequence[str] = ("github", "linkedin", "university"), q: Column | None = None) -> Column:
    """How good an extracted text is; 0 for what isn't a resume. signs_of: words that speak for one; add a school's name
    to have it count."""
    t = blank(text, "")
    if q is None:
        return let(quality(t), lambda known: text_score(text, signs_of, known))
    signs = F.when(t.rlike(r"(?i)\b(education|experience|skills|projects|work|resume|developer|engineer|intern)\b"), 20).otherwise(0)
    signs = signs + F.when(t.contains("@"), 10).otherwise(0) + F.when(t.rlike(rf"(?i)\b({'|'.join(signs_of)})\b"), 12).otherwise(0)
    loss = q["metadata"] * 10 + q["pdf_words"] * 8 + F.greatest(F.lit(0.0), q["slashed"] - q["words"] * 0.08) * 3.5 + F.when(q["digits"] > q["letters"] * 0.75, 25).otherwise(0)
    return F.when(is_resume(t, q=q), F.greatest(F.lit(0.0), q["alpha"] + q["long"] * 0.5 + signs - loss)).otherwise(0.0)


def best_text(texts: Column | str) -> Column:
    """The best of several extracted (sanitised) texts, the first of equals; '' where none is good enough."""
    rows = F.transform(col(texts), lambda t: F.struct(F.when(F.length(t) >= 30, text_score(t)).otherwise(0.0).alias("score"), t.alias("text")))
    best = F.aggregate(rows, F.struct(F.lit(0.0).alias("score"), F.lit("").alias("text")), lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))
    n = F.length(best["text"])
    return F.when(((n >= 200) & (best["score"] >= 30)) | ((n >= 120) & (best["score"] >= 22)), best["text"]).otherwise("")
