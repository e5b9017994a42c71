"""Candidates to canonical events: titles, occurrences, identities, issues; and back to comparable content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions import temporal, text

IDENTITY_VERSION = 1
KEPT_OCCURRENCE = ("id", "kind", "start_date", "end_date", "start_at", "end_at", "source_timezone", "local_date", "local_time", "original_start", "original_end")
CONTENT = (
    "title", "description", "categories", "organization", "venue", "city", "region", "cost", "audience", "accessibility",
    "coordinates", "online_location_url", "public_source_url", "ticket_url", "source_category",
)


def with_identity_texts(df: DataFrame) -> DataFrame:
    """The normal forms that identities need, as columns: the UDF runs once per column and batch."""
    entries = F.array_sort(F.map_entries(F.coalesce(F.col("address"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))))
    joined = F.array_join(F.transform(entries, lambda e: F.concat_ws("\u0002", text.normalize_whitespace(e["key"]), text.normalize_whitespace(F.coalesce(e["value"], F.lit(""))))), "\u0001")
    return (
        df.withColumn("__title", text.identity_text(F.col("title")))
        .withColumn("__venue", text.identity_text(F.col("venue")))
        .withColumn("__city", text.identity_text(F.col("city")))
        .withColumn("__online", text.identity_text(F.col("online_location_url")))
        .withColumn("__address", F.lower(text.nfkc(joined)))
    )


def location_identity() -> Column:
    """Framed venue, city, address entries by key, and online URL."""
    pairs = F.when(F.col("__address") == "", F.array().cast("array<string>")).otherwise(F.flatten(F.transform(F.split("__address", "\u0001"), lambda e: F.split(e, "\u0002"))))
    return text.framed_array(F.concat(F.array("__venue", "__city"), pairs, F.array("__online")))


def canonical_identity(first: Column) -> Column:
    """Digest of version, source, title, first occurrence and location; columns of with_identity_texts are needed."""
    when = F.concat(first["kind"], F.lit(":"), temporal.occurrence_start(first))
    return F.sha2(text.framed(F.lit(str(IDENTITY_VERSION)), F.col("source_record_id"), F.col("__title"), when, location_identity()), 256)


def content_fingerprint(occurrences: str = "occurrences") -> Column:
    """Digest of an event's content: occurrence ids and the order of address keys don't count."""
    occ = F.transform(occurrences, lambda o: F.struct(*[o[c].alias(c) for c in KEPT_OCCURRENCE if c != "id"]))
    address = F.array_sort(F.map_entries("address"))
    issues = F.transform("validation_issues", lambda i: F.struct(i["path"], i["code"]))
    return F.sha2(F.to_json(F.struct(*CONTENT, address.alias("address"), occ.alias("occurrences"), issues.alias("issues")), {"ignoreNullFields": "false"}), 256)


def normalize_events(candidates: DataFrame) -> DataFrame:
    """Candidates with their outcome: ``errors`` (array of path and code) is empty for the valid ones, whose event
    columns are set. An end that isn't after its start is cleared and becomes a review issue."""
    parsed = candidates.withColumn("parsed", F.transform("occurrences", temporal.parse_occurrence))
    numbered = F.transform("parsed", lambda o, i: F.struct(F.concat_ws(".", F.lit("occurrences"), i.cast("string"), o["error_path"]).alias("path"), o["error_code"].alias("code")))
    occ_errors = F.filter(numbered, lambda e: e["code"].isNotNull())
    one = lambda p, c: F.array(F.struct(F.lit(p).alias("path"), c.alias("code")))
    bad_title = text.title_error(F.col("title"))
    none = F.array().cast("array<struct<path:string,code:string>>")
    errors = (
        F.when(bad_title.isNotNull(), one("title", bad_title))
        .when(F.coalesce(F.size("occurrences"), F.lit(0)) < 1, one("occurrences", F.lit("missing_occurrence")))
        .otherwise(F.coalesce(occ_errors, none))
    )
    not_after = lambda o: (o["kind"] == "instant") & o["end_at"].isNotNull() & (o["end_at"] <= o["start_at"])
    issues = F.filter(
        F.transform("parsed", lambda o, i: F.when(not_after(o), F.struct(F.concat(F.lit("occurrences."), i.cast("string"), F.lit(".end")).alias("path"), F.lit("end_not_after_start").alias("code"), F.concat_ws("|", o["original_start"], o["original_end"]).alias("rejected_value")))),
        lambda x: x.isNotNull(),
    )
    cleaned = F.transform("parsed", lambda o: F.struct(*[(F.when(not_after(o), None).otherwise(o[c]) if c == "end_at" else o[c]).alias(c) for c in KEPT_OCCURRENCE]))
    out = parsed.withColumn("errors", errors).withColumn("validation_issues", issues).withColumn("occurrences", cleaned).drop("parsed")
    out = with_identity_texts(out).withColumn("title", text.normalize_whitespace(F.col("title")))
    ok = F.size("errors") == 0
    provenance = F.array(F.struct("source_record_id", "source_url", "source_supplied_id", "retrieved_at"))
    return (
        out.withColumn("canonical_identity", F.when(ok, canonical_identity(F.get(F.col("occurrences"), F.lit(0)))))
        .withColumn("identity_version", F.lit(IDENTITY_VERSION))
        .withColumn("publication_status", F.lit("pending"))
        .withColumn("record_version", F.lit(1))
        .withColumn("provenance", provenance)
        .drop("__title", "__venue", "__city", "__online", "__address")
    )


def valid(normalized: DataFrame) -> DataFrame:
    return normalized.where(F.size("errors") == 0).drop("errors")


def rejected(normalized: DataFrame) -> DataFrame:
    """(id, path, code) per error of the candidates that failed."""
    return normalized.where(F.size("errors") > 0).select("id", F.inline("errors"))


def keep_upcoming(candidates: DataFrame, opened_at: str) -> DataFrame:
    """Candidates cut down to their upcoming occurrences, those without any left out. The cut comes before identities
    are derived, since an identity rests on the first occurrence kept."""
    keep = F.filter("occurrences", lambda o: temporal.is_upcoming(temporal.parse_occurrence(o), opened_at))
    return candidates.withColumn("occurrences", keep).where(F.size("occurrences") > 0)


def constraint_failures(events: DataFrame) -> DataFrame:
    """(id, failed): rows that break a row constraint of the event table."""
    url = lambda c: F.when(F.col(c).isNotNull() & ~F.col(c).rlike("^https?://"), F.lit(f"{c}_scheme"))
    lat, lon = F.col("coordinates")["latitude"], F.col("coordinates")["longitude"]
    checks = F.array(
        F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "id_blank"), F.when(~F.coalesce(F.col("canonical_identity").rlike("^[0-9a-f]{64}$"), F.lit(False)), "identity_digest"),
        F.when(F.coalesce(F.col("identity_version"), F.lit(0)) != IDENTITY_VERSION, "identity_version"), text.title_error(F.col("title")), url("public_source_url"), url("ticket_url"), url("online_location_url"),
        F.when(lat.isNull() != lon.isNull(), "coordinates_half"), F.when(~lat.between(-90, 90) | ~lon.between(-180, 180), "coordinates_range"), F.when(F.coalesce(F.col("record_version"), F.lit(0)) < 1, "version"),
    )
    return events.select("id", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("failed"))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias("__p")), F.col(key) == F.col("__p"), "left_anti")
