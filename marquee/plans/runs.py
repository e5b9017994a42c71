"""Whole runs: catalogs in, pages in, observations in. Each validates everything before it writes anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import text
from marquee.operators import merge, normalize
from marquee.session import checkpointed
from marquee.sources import catalog, pages, state

EVENT_COLUMNS = (
    "id", "canonical_identity", "identity_version", "title", "description", "categories", "organization", "venue", "city", "region", "cost", "audience", "accessibility", "address", "coordinates",
    "online_location_url", "public_source_url", "ticket_url", "source_category", "publication_status", "occurrences", "validation_issues", "provenance", "record_version",
)


def from_partner(provenance: Column, prefix: str) -> Column:
    """True if any provenance entry's page lies under prefix; false for null."""
    return F.coalesce(F.exists(provenance, lambda p: F.coalesce(F.startswith(p["source_url"], F.lit(prefix)), F.lit(False))), F.lit(False))


def scrape_run(fetched: DataFrame, sources: DataFrame, previous: DataFrame, listing_host: str, partner_prefix: str, opened_at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, report, rejected) of one run over fetched pages (source_id, url, content_type, body, organization, blocked):
    extract, normalise, keep what is upcoming, retain the partner's events of the previous state, merge.

    A page that was not fetched has a null body. Pages of unknown sources give nothing; events that fail are rejected
    with their errors; an empty set of pages leaves the retained events alone."""
    stored = fetched.where(F.col("body").isNotNull())
    at = stored.select(F.col("url").alias("source_url"), "source_id").distinct()
    found = checkpointed(pages.extract_all(stored.select("url", "content_type", "body", "organization"), listing_host, opened_at[:10]))
    raw = pages.to_candidates(found.join(at, "source_url"), sources, opened_at)
    judged = checkpointed(normalize.normalize_events(normalize.keep_upcoming(raw, opened_at)))
    # issues in the stored shape; the rest agrees by name
    issue = lambda i: F.struct(i["path"].alias("path"), i["code"].alias("code"), *[F.lit(None).cast(t).alias(n) for n, t in (("message", "string"), ("file_name", "string"), ("physical_row", "int"))], i["rejected_value"].alias("rejected_value"))
    fresh = judged.where(F.size("errors") == 0).withColumn("validation_issues", F.transform("validation_issues", issue)).select(*EVENT_COLUMNS)
    kept = previous.where(from_partner(F.col("provenance"), partner_prefix)).select(*EVENT_COLUMNS)
    events = merge.merge_events(kept.unionByName(fresh))
    accepted = fresh.select(F.explode("provenance.source_record_id").alias("source_id")).groupBy("source_id").agg(F.count("*").alias("accepted"))
    tries = fetched.groupBy("source_id").agg(F.count("body").alias("fetched"), F.sum(F.col("blocked").cast("int")).alias("blocked"), F.count("*").alias("attempts"))
    sums = tries.join(accepted, "source_id", "left").withColumn("accepted", F.coalesce("accepted", F.lit(0)))
    status = F.when(F.col("accepted") > 0, "completed").when(F.col("fetched") > 0, "completed-no-events").when(F.col("blocked") == F.col("attempts"), "blocked").otherwise("failed")
    return events, sums.withColumn("status", status), normalize.rejected(judged)


def publish(events: DataFrame, state_path: str, export_path: str) -> None:
    """State and export of a run; the state is put in place in one step, after it was written whole."""
    kept = checkpointed(events)
    state.write_state(kept, state_path)
    state.write_master(kept, export_path)


def import_catalogs(spark: SparkSession, files_path: str, categories: dict[str, str], target: str) -> DataFrame:
    """The errors of an import over all catalog files; with any error nothing is written, else each category's rows
    replace those of the last import and sources seen before keep their collection state."""
    records, errors = catalog.scan_catalog(catalog.read_files(spark, files_path), categories)
    errors = checkpointed(errors)
    if not errors.isEmpty():
        return errors.orderBy("file_name", *catalog.error_order())
    hadoop = spark._jvm.org.apache.hadoop.fs
    if hadoop.Path(target).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop.Path(target)):
        records = catalog.preserve_state(records, spark.read.parquet(target))
    catalog.write_categories(checkpointed(records), target)
    return errors


def upsert_run(observations: DataFrame, path: str, run_id: str) -> dict[str, int]:
    """Applies observations (in the shape of schemas.OBSERVATION) and writes the retained events, their children with
    ordinals, one revision per change and one audit row per observation.

    Events and children are replaced; revisions and audit rows are append-only: each run has a folder of its own, and a
    run that is repeated replaces its own rows only, never those of another."""
    observed = checkpointed(merge.observe(observations))
    acts = checkpointed(merge.ingest(observed))
    kept = checkpointed(merge.apply_ingest(observed).select("identity", "id", "record_version", "event", "provenance"))
    kept.write.mode("overwrite").parquet(f"{path}/events")
    for child in ("occurrences", "validation_issues"):
        kept.select(F.col("id").alias("event_id"), F.posexplode(f"event.{child}").alias("ordinal", "value")).write.mode("overwrite").parquet(f"{path}/{child}")
    kept.select(F.col("id").alias("event_id"), F.posexplode("provenance").alias("ordinal", "value")).write.mode("overwrite").parquet(f"{path}/provenance")
    changes = acts.where("action in ('created', 'updated')").join(observed.select("identity", "seq", "event"), ["identity", "seq"])
    snapshot = F.to_json("event", {"ignoreNullFields": "false"})
    changes.select("identity", "seq", "version", snapshot.alias("snapshot")).write.mode("overwrite").parquet(f"{path}/revisions/run={run_id}")
    acts.select("identity", "seq", "action", "version", "new_keys").write.mode("overwrite").parquet(f"{path}/audit/run={run_id}")
    return {r["action"]: r["n"] for r in acts.groupBy("action").agg(F.count("*").alias("n")).collect()}


def catalog_fingerprint(records: DataFrame) -> DataFrame:
    """(id, fingerprint): a digest of what a catalog record says; equal for equal records only."""
    said = F.struct("source_category", "organization_name", "organization_urls", "sitemap_urls", "event_urls")
    return records.select("id", F.sha2(F.to_json(said, {"ignoreNullFields": "false"}), 256).alias("fingerprint"))


def moderation_list(events: DataFrame) -> DataFrame:
    """All events whatever their status, by first start, title and id."""
    return events.orderBy(*merge.merge_order())


def clean_addresses(events: DataFrame) -> DataFrame:
    """Blank entries of addresses are dropped; an address without entries is null."""
    full = F.map_filter("address", lambda k, v: F.coalesce(F.length(v) > 0, F.lit(False)))
    return events.withColumn("address", F.when(F.size(full) > 0, full))


def discovery_days(spark: SparkSession, today: str, days: int = 366) -> DataFrame:
    """(day) today and the next ``days`` days, for calendars that are listed by day."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(today).cast("date"), F.date_add(F.lit(today).cast("date"), days))).alias("day"))


def category_ids(inputs: DataFrame, col: str = "categories") -> DataFrame:
    """(category_id) the distinct numeric ids of a packed field, in order of number."""
    ids = inputs.select(F.explode(F.split(col, r"[^0-9]+")).alias("category_id")).where("category_id != ''").distinct()
    return ids.orderBy(F.col("category_id").cast("long"))


def occurrence_label(o: Column, venue: Column, city: Column) -> Column:
    """A line for people: the day, the time of an instant, venue and town."""
    when = F.when(o["kind"] == "date", o["start_date"]).otherwise(F.concat_ws(" ", o["local_date"], F.substring(o["local_time"], 1, 5)))
    place = F.concat_ws(" · ", F.nullif(text.normalize_whitespace(venue), F.lit("")), F.nullif(text.normalize_whitespace(city), F.lit("")))
    return F.concat_ws(", ", when, F.nullif(place, F.lit("")))
