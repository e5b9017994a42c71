"""The stored tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import temporal
from marquee.session import read_table

OPENED_AT = "2026-08-18T12:00:00Z"


PUBLISHED = "publication_status = 'published'"


def events(spark: SparkSession, sf_dir: str, where: str | None = None) -> DataFrame:
    """event_records, each id once (its earliest copy), with flat occurrences (local day and time derived in the
    occurrence's own zone). Copies of an id are equal, so ``where`` may run first and reach the scan; every column is an
    aggregate of its own, so those not asked for are neither read nor shuffled."""
    stored = read_table(spark, sf_dir, "event_records")
    stored = stored.where(where) if where else stored
    e = stored.groupBy("id").agg(*[F.min_by(c, F.struct("created_at")).alias(c) for c in stored.columns if c != "id"])

    def flat(o):
        zone = F.when(temporal.valid_zone(o["source_timezone"]), o["source_timezone"]).otherwise("UTC")
        day, clock = temporal.local_parts(o["start_instant"], zone)
        instant = o["kind"] == "instant"
        none = F.lit(None).cast("string")
        return F.struct(
            o["id"].alias("id"), o["kind"].alias("kind"), F.when(~instant, o["start_date"]).alias("start_date"), none.alias("end_date"),
            F.when(instant, o["start_instant"]).alias("start_at"), F.lit(None).cast("timestamp").alias("end_at"), o["source_timezone"].alias("source_timezone"),
            F.when(instant, day).alias("local_date"), F.when(instant, clock).alias("local_time"), o["original_start"].alias("original_start"), none.alias("original_end"),
        )

    issue = lambda i: F.struct(i["path"].alias("path"), i["code"].alias("code"), i["message"].alias("message"))
    return (
        e.withColumnRenamed("cost_text", "cost").withColumn("occurrences", F.transform("occurrences", flat)).withColumn("validation_issues", F.transform("validation_issues", issue))
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extracted_events as candidates, each id once."""
    stored = read_table(spark, sf_dir, "extracted_events")
    x = stored.groupBy("extracted_id").agg(*[F.min_by(c, F.struct("extracted_at")).alias(c) for c in stored.columns if c != "extracted_id"])
    none = F.lit(None).cast("string")
    occ = F.transform("occurrences", lambda o, i: F.struct(F.concat_ws("-", F.lit("o"), "extracted_id", i).alias("id"), F.regexp_replace(F.trim(o["start_text"]), r"^(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2})", "$1T$2").alias("start"), o["end_text"].alias("end"), F.nullif(o["timezone_text"], F.lit("")).alias("zone")))
    return x.select(
        F.col("extracted_id").cast("string").alias("id"), "source_record_id", "source_url", F.col("supplied_id").alias("source_supplied_id"), F.col("extracted_at").alias("retrieved_at"), F.coalesce("title", F.lit("")).alias("title"),
        "description", "categories", "organization", "venue", "city", "region", F.col("cost_text").alias("cost"), none.alias("audience"), none.alias("accessibility"), "address", F.lit(None).cast("struct<latitude:double,longitude:double>").alias("coordinates"),
        "online_location_url", "public_source_url", "ticket_url", F.lit("non-grantee").alias("source_category"), occ.alias("occurrences"),
    )


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_inputs with their occurrence rows and start days."""
    from marquee.sources import partner

    titled = read_table(spark, sf_dir, "scene_inputs")
    occ = read_table(spark, sf_dir, "scene_occurrences").select("input_id", "physical_row", "start_date", "start_time", "end_date")
    f = partner.inputs(titled, occ)
    days = F.filter(F.array_distinct(F.transform("rows", lambda r: temporal.us_date(r["start_date"]).cast("string"))), lambda d: d.isNotNull())
    return f.withColumn("days", days).withColumn("occurrences", partner.raw_occurrences(F.col("rows")))
