"""Hiring history: shares by label, hires by term, their trend and season, and what they mean for a person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrank.functions.js import blank, clamp, col, matches, number
from loomrank.functions.text import first_number, normalize

from . import scoring

MOST_ENTRIES, MOST_TERMS, RECENT = 20, 18, 4
TERM_LABEL, FACULTY_LABEL = r"(work\s*term|\bterm\b|\bwt\b|\b[1-9]\b)", r"(engineering|math|arts|science|environment|health|faculty)"


def label_percent(text: Column | str) -> Column:
    """(label, percent) of "label: n%", "n% label" or "label n%"; null for other texts."""
    t = normalize(text)
    num = r"(\d+(?:\.\d+)?)"
    forms = [(rf"^(.+?)\s*[:\-]\s*{num}\s*%\z", 1, 2), (rf"^{num}\s*%\s*(.+)\z", 2, 1), (rf"^(.+?)\s+{num}\s*%\z", 1, 2)]
    out = F.lit(None).cast("struct<label:string,percent:double>")
    for pattern, label, percent in reversed(forms):
        found = F.struct(F.trim(F.regexp_extract(t, pattern, label)).alias("label"), F.regexp_extract(t, pattern, percent).try_cast("double").alias("percent"))
        out = F.when(t.rlike(pattern), found).otherwise(out)
    return out


def keeps_term(label: Column | str) -> Column:
    return matches(label, TERM_LABEL, True)


def keeps_faculty(label: Column | str) -> Column:
    return matches(label, FACULTY_LABEL, True) | (F.length(col(label)) <= 24)


def distribution(entries: DataFrame, keys: list[str], most: int = MOST_ENTRIES) -> DataFrame:
    """An array dist of (label, percent) for each key: labels once, whatever their case, with the greatest percent, from
    0 to 100, largest first; ties in the order of pos. entries: keys, label, percent, pos."""
    given = entries.filter("label is not null and label <> '' and percent is not null and not isnan(percent)")
    by_label = given.groupBy(*keys, F.lower("label").alias("_low")).agg(
        F.max_by(F.col("label"), F.struct(F.col("percent"), -F.col("pos"))).alias("label"), F.max("percent").alias("percent"), F.min("pos").alias("pos")
    )
    entry = F.struct((-clamp("percent", 0, 100)).alias("down"), F.col("pos"), F.col("label"))
    ordered = by_label.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("d"))
    return ordered.select(*keys, F.slice(F.transform("d", lambda x: F.struct(x["label"].alias("label"), (-x["down"]).alias("percent"))), 1, most).alias("dist"))


def chart_shares(labels: Column | str, values: Column | str) -> Column:
    """Labels with the share in percent of their values; none where the values come to nothing."""
    v = F.filter(col(values), lambda x: x.isNotNull() & ~F.isnan(x))
    total = F.aggregate(v, F.lit(0.0), lambda n, x: n + x)
    n = F.least(F.size(col(labels)), F.size(v))
    pairs = F.transform(F.arrays_zip(F.slice(col(labels), 1, F.greatest(n, F.lit(0))).alias("label"), F.slice(v, 1, F.greatest(n, F.lit(0))).alias("value")), lambda x: F.struct(x["label"].alias("label"), (x["value"] / total * 100).alias("percent")))
    return F.when(total > 0, pairs).otherwise(F.expr("cast(array() as array<struct<label:string,percent:double>>)"))


def hires_row(cells: Column | str, strict: bool = False) -> Column:
    """(term, hires) of a table row's cells; null for headings and rows without a number. The first cell that has a digit
    counts, so a term such as "Fall 2023" is read as hires; with strict only a cell that is a number does."""
    c = col(cells)
    heading = F.exists(c, lambda x: x.rlike(r"(?i)students\s*hired"))
    whole = lambda x: F.regexp_replace(x, ",", "").rlike(r"^\d+\z")
    cell = F.get(F.filter(c, whole if strict else (lambda x: x.rlike(r"\d"))), F.lit(0))
    n = first_number(cell)
    term = F.coalesce(F.nullif(F.get(c, F.lit(0)), F.lit("")), F.get(F.filter(c, lambda x: x.rlike("(?i)(fall|winter|spring|term)")), F.lit(0)), F.lit("Unknown"))
    return F.when(~heading & (F.size(c) >= 2) & n.isNotNull(), F.struct(term.alias("term"), F.greatest(F.lit(0), F.floor(n + 0.5)).cast("int").alias("hires")))


def hiring(hires: DataFrame, keys: list[str]) -> DataFrame:
    """For each key: selectivity, trend, season, from rows (keys, seq, term, hires) with seq from 0. Plain aggregates, so
    any number of terms is pre-aggregated where it is."""
    h = F.when((F.col("hires") >= 0) & ~F.isnan(F.col("hires").cast("double")), F.col("hires").cast("double"))
    rows = hires.withColumn("_h", h)
    season = lambda name: F.when(F.lower(F.coalesce("term", F.lit(""))).contains(name.lower()), F.col("_h"))
    seasons = ["Fall", "Winter", "Spring"]
    g = rows.groupBy(*keys).agg(
        F.avg("_h").alias("avg_hires"), F.count("_h").alias("n_terms"), F.regr_slope("_h", F.col("seq").cast("double")).alias("_slope"),
        F.avg(F.when(F.col("seq") < RECENT, F.col("_h"))).alias("_recent"), F.avg(F.when(F.col("seq") >= RECENT, F.col("_h"))).alias("_older"),
        *(F.avg(season(s)).alias(f"_{s}") for s in seasons),
    )
    slope = F.when(F.col("n_terms") >= 3, F.coalesce("_slope", F.lit(0.0))).otherwise(0.0)
    older = F.coalesce("_older", "_recent")
    trend = F.when(F.col("n_terms") < 3, "Insufficient trend data").when(F.col("_recent") > older * 1.15, "Upward hiring trend").when(F.col("_recent") < older * 0.85, "Downward hiring trend").otherwise("Stable hiring trend")
    # the largest average, the first of equal ones
    best = F.array_max(F.array(*(F.when(F.col(f"_{s}").isNotNull(), F.struct(F.col(f"_{s}").alias("avg"), F.lit(-k).alias("at"), F.lit(s).alias("season"))) for k, s in enumerate(seasons))))
    known = sum((F.col(f"_{s}").isNotNull().cast("int") for s in seasons), F.lit(0))
    peak = F.concat(best["season"], F.lit(" tends to peak ("), F.format_string("%.1f", best["avg"]), F.lit(" avg hires)"))
    return g.select(
        *keys, "n_terms", "avg_hires", slope.alias("slope"), scoring.selectivity_of(F.col("avg_hires"), slope).alias("selectivity"), trend.alias("trend"),
        F.when(known >= 2, peak).otherwise("Seasonal pattern unavailable").alias("season"),
    )


def term_share(term: Column, dist: Column | str) -> Column:
    return number(F.get(F.filter(col(dist), lambda x: scoring.label_term(x["label"]) == term), F.lit(0))["percent"])


def faculty_share(faculty: Column | str, dist: Column | str) -> Column:
    f = F.lower(blank(faculty, ""))
    fits = lambda x: F.contains(F.lower(x["label"]), f) | F.contains(f, F.lower(x["label"]))
    return F.greatest(F.lit(0.0), F.array_max(F.transform(F.filter(col(dist), fits), lambda x: number(x["percent"]))))


def describe_term(score: Column | str) -> Column:
    return F.when(col(score) <= 25, "Extremely Competitive for Your Work Term").when(col(score) <= 55, "Competitive but Possible").otherwise("Strong Historical Alignment")


def describe_faculty(score: Column | str) -> Column:
    return F.when(col(score) <= 35, "Weak Faculty Alignment").when(col(score) <= 65, "Moderate Faculty Alignment").otherwise("Strong Faculty Alignment")


def outlook(df: DataFrame, term: Column, faculty: Column, term_dist: str = "term_dist", faculty_dist: str = "faculty_dist", selectivity: str = "selectivity") -> DataFrame:
    """What a page of hiring history means for a person: scores, viability and advice."""
    df = df.withColumns({"term_score": scoring.term_compatibility(term, term_dist), "faculty_score": scoring.faculty_alignment(faculty, faculty_dist)})
    df = df.withColumn("viability", scoring.viability(F.lit(50), "term_score", "faculty_score", selectivity))
    share = F.coalesce(term_share(term, term_dist), F.lit(0.0))
    flags = {"term_share_zero": share <= 0.1, "faculty_weak": F.col("faculty_score") < 40}
    return df.withColumns({"recommendation": scoring.recommend(F.col("viability")["score"], flags), "term_says": describe_term("term_score"), "faculty_says": describe_faculty("faculty_score")})
