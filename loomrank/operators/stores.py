"""Small keyed stores as tables: settings, profiles, cached analyses, applications and events.

Each operation takes tables and gives the new one; upserts are aggregates over the union of old and new rows, so that
nothing depends on a store fitting one machine. Caps apply to what is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrank.functions.js import blank, clamp

# Versions, ages and caps of the stores.
CACHE_VERSION, CACHE_AGE_MS, CACHE_MOST = 4, 7 * 24 * 3600 * 1000, 200
EVENTS_MOST, EVENTS_SHOWN, APPLICATIONS_SHOWN = 400, 200, 80
STATUSES = ("applied", "interview", "offer", "rejected", "withdrawn", "unknown")
TERM_LENGTHS = ("4", "8", "either")
FLAGS = ("smartOverlay", "autofill", "applicationTracker", "localSemanticAI")


def settings(df: DataFrame, raw: str = "settings") -> DataFrame:
    """Stored settings (JSON texts) as typed columns with defaults; what isn't of the right type gets its default."""
    get = lambda path: F.get_json_object(F.col(raw), f"$.{path}")
    texts = lambda path: F.filter(F.coalesce(F.from_json(get(path), "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != ""))
    term = get("preferences.workTerm").try_cast("double")
    flags = [(F.coalesce(get(f"featureFlags.{f}") != "false", F.lit(True)) if f == "smartOverlay" else F.coalesce(get(f"featureFlags.{f}") == "true", F.lit(False))).alias(f) for f in FLAGS]
    length = get("preferences.preferredTermLength")
    prefs = F.struct(
        F.when(get("preferences.workTerm").isNull(), 1.0).otherwise(F.when(term.isNull(), 1.0).otherwise(clamp(term, 1, 6))).cast("int").alias("work_term"),
        F.coalesce(get("preferences.faculty"), F.lit("Engineering")).alias("faculty"), F.coalesce(get("preferences.targetRole"), F.lit("")).alias("target_role"),
        texts("preferences.industries").alias("industries"), F.when(length.isin(*TERM_LENGTHS), length).otherwise("4").alias("term_length"),
        F.coalesce(get("preferences.globalDisableOnUnsupportedPages") == "true", F.lit(False)).alias("only_supported"),
    )
    migrated = ~F.coalesce(get("_schemaVersion").try_cast("int") == 1, F.lit(False)) | get("featureFlags").isNull()
    return df.withColumns(
        {
            "enabled": F.coalesce(get("enabled") != "false", F.lit(True)), "feature_flags": F.struct(*flags), "disabled_paths": texts("disabledPaths"), "resume_text": F.coalesce(get("resumeRawText"), F.lit("")),
            "excluded": texts("excludedResumeSkills"), "preferences": prefs, "schema_version": F.lit(1), "needs_write": migrated,
        }
    )


def toggled(paths: Column | str, path: Column | str) -> Column:
    """A list of paths without the path if it has it, else with it."""
    p, x = (F.col(v) if isinstance(v, str) else v for v in (paths, path))
    return F.when(F.array_contains(p, x), F.array_remove(p, x)).otherwise(F.array_append(p, x))


def cached(cache: DataFrame, now: int) -> DataFrame:
    """Entries of the current version that are young enough."""
    return cache.filter((F.col("version") == CACHE_VERSION) & (F.lit(now) - F.col("ts") <= CACHE_AGE_MS))


def cache_put(cache: DataFrame, new: DataFrame, most: int = CACHE_MOST) -> DataFrame:
    """The newest entry of each URL, of those the newest ones."""
    rest = [c for c in cache.columns if c != "url"]
    newest = cache.unionByName(new).groupBy("url").agg(F.max_by(F.struct(*rest), F.struct("ts", "version")).alias("e"))
    return newest.select("url", *(F.col("e")[c].alias(c) for c in rest)).orderBy(F.desc("ts"), "url").limit(most)


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Old rows with the values that new rows give (nulls give none), and new rows of their own."""
    rest = [c for c in old.columns if c != key]
    both = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)), allowMissingColumns=True)
    value = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("_n"))).alias(c)
    return both.groupBy(key).agg(*(value(c) for c in rest)).select(old.columns)


def active_profile(profiles: DataFrame) -> DataFrame:
    """The active profile, else the one named default, else none."""
    rank = F.when(F.coalesce("active", F.lit(False)), 0).when(F.col("id") == "default", 1)
    return profiles.withColumn("_r", rank).filter("_r is not null").orderBy("_r", "id").limit(1).drop("_r")


def activate(profiles: DataFrame, profile: str) -> DataFrame:
    """The profile of that id active and no other; nothing changes where there is none."""
    known = profiles.agg(F.coalesce(F.bool_or(F.col("id") == profile), F.lit(False)).alias("_known"))
    return profiles.join(F.broadcast(known)).withColumn("active", F.when(F.col("_known"), F.col("id") == profile).otherwise(F.col("active"))).drop("_known")


def save_profile(profiles: DataFrame, new: DataFrame) -> DataFrame:
    named = new.withColumns({"id": blank(F.trim("id"), "default"), "name": F.substring(blank("name", "Default"), 1, 80)})
    return upsert(profiles, named)


def create_profile(profiles: DataFrame, name: str | None, now: int) -> DataFrame:
    """The profiles with an empty one, named after the time in milliseconds; it isn't made active."""
    new = profiles.sparkSession.range(1).select(F.lit(f"p-{now}").alias("id"), F.lit((name or "Untitled")[:80]).alias("name"))
    empty = {c: F.lit("") if kind == "string" else F.array().cast(kind) if kind.startswith("array") else F.create_map().cast(kind) if kind.startswith("map") else F.lit(None).cast(kind) for c, kind in profiles.dtypes if c not in new.columns}
    return profiles.filter(F.col("id") != f"p-{now}").unionByName(new.withColumns(empty))


#: What a profile and the settings both hold of a resume.
RESUME = ("resume_text", "resume_skills", "manual_skills", "excluded")


def _or_empty(df: DataFrame, c: str) -> Column:
    """A column, or the empty text, list or map."""
    kind = dict(df.dtypes)[c]
    return F.coalesce(F.col(c), F.lit("") if kind == "string" else F.array().cast(kind) if kind.startswith("array") else F.create_map().cast(kind))


def resume_saved(profiles: DataFrame, settings: DataFrame) -> DataFrame:
    """The profiles, the active one with the resume of the settings (one row)."""
    active = active_profile(profiles).select(F.col("id").alias("_id"))
    new = settings.select(*(F.col(c).alias(f"_{c}") for c in RESUME)).limit(1).join(active)
    out = profiles.join(F.broadcast(new), F.col("id") == F.col("_id"), "left")
    return out.withColumns({c: F.when(F.col("_id").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in RESUME}).select(profiles.columns)


def default_seeded(profiles: DataFrame, settings: DataFrame) -> DataFrame:
    """The profiles, the default one with the resume of the settings (one row) if it has none itself and they have one."""
    has = lambda text, skills: (F.trim(F.coalesce(F.col(text), F.lit(""))) != "") | (F.coalesce(F.size(skills), F.lit(0)) > 0)
    new = settings.filter(has("resume_text", "resume_skills")).select(*(_or_empty(settings, c).alias(f"_{c}") for c in RESUME), F.lit(True).alias("_new")).limit(1)
    out = profiles.join(F.broadcast(new), (F.col("id") == "default") & ~has("resume_text", "resume_skills"), "left")
    return out.withColumns({c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) for c in RESUME}).select(profiles.columns)


def settings_of_profile(settings: DataFrame, profiles: DataFrame) -> DataFrame:
    """The settings with the resume of the active profile, if there is one."""
    active = active_profile(profiles).select(*(_or_empty(profiles, c).alias(f"_{c}") for c in RESUME), F.lit(True).alias("_has"))
    out = settings.join(F.broadcast(active), F.lit(True), "left")
    return out.withColumns({c: F.when(F.col("_has"), F.col(f"_{c}")).otherwise(F.col(c)) for c in RESUME}).select(settings.columns)


def application(df: DataFrame) -> DataFrame:
    """Application records with every column of the right type."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    status = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("unknown")
    time = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint"))
    cols = {c: text(c) for c in ("id", "job_key", "posting_url", "title", "employer", "profile_id") if c in df.columns}
    return df.withColumns(cols | {"status": status, "created_at": time("created_at"), "updated_at": time("updated_at")})


def append_events(applications: DataFrame, events: DataFrame, new: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """New events (application_id, type, at, source, set_status) of known applications: the applications, updated now and
    with the last status set, and all events."""
    mine = new.join(applications.select(F.col("id").alias("application_id")), "application_id", "left_semi")
    typed = mine.select("application_id", blank("type", "note").alias("type"), F.coalesce("at", F.lit(now)).alias("at"), blank("source", "extension").alias("source"), "set_status")
    last = typed.groupBy(F.col("application_id").alias("id")).agg(F.max_by("set_status", F.when(F.col("set_status").isNotNull(), F.col("at"))).alias("_status"))
    changed = applications.join(last.withColumn("_hit", F.lit(True)), "id", "left")
    changed = changed.withColumns({"status": F.coalesce("_status", "status"), "updated_at": F.when(F.col("_hit"), F.lit(now).cast("bigint")).otherwise(F.col("updated_at"))}).drop("_status", "_hit")
    return application(changed), events.unionByName(typed.drop("set_status"))


def listed_applications(applications: DataFrame, most: int = APPLICATIONS_SHOWN) -> DataFrame:
    return applications.orderBy(F.desc("updated_at"), "id").limit(most)


def by_job(applications: DataFrame, job_key: str) -> DataFrame:
    return applications.filter(F.col("job_key") == job_key).orderBy("created_at", "id").limit(1)


def latest_events(log: DataFrame, limit: int | None = None, kept: int = EVENTS_MOST) -> DataFrame:
    """The newest events: 50 unless said, 200 at most, of those that the log keeps."""
    return log.orderBy(F.desc("at"), "type").limit(min(limit or 50, EVENTS_SHOWN, kept))
