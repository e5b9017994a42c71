"""State documents and the master export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee import schemas
from marquee.functions import temporal, text

VERSION = 1
MASTER = (
    "id", "title", "description", "categories", "organization", "venue", "city", "region", "cost", "address", "starts", "ends", "timezones",
    "online_location_url", "public_source_url", "ticket_url", "source_category", "source_ids", "source_urls", "retrieved_at",
)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Events of one state document; no file is an empty state, another version an error."""
    if not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        return spark.createDataFrame([], schemas.EVENT)
    doc = spark.read.schema(schemas.STATE_DOCUMENT).option("multiLine", True).json(path)
    checked = F.when(F.col("schemaVersion") == VERSION, F.col("events")).otherwise(F.raise_error(F.lit("unsupported state version")).cast(doc.schema["events"].dataType))
    return doc.select(F.inline(checked))


def write_state(events: DataFrame, path: str) -> None:
    """The retained events as parquet: written beside the old state, then put in its place."""
    spark, staged = events.sparkSession, f"{path}.staged"
    events.write.mode("overwrite").parquet(staged)
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old = hadoop.Path(f"{path}.old")
    fs.delete(old, True)
    if fs.exists(hadoop.Path(path)):
        fs.rename(hadoop.Path(path), old)
    if not fs.rename(hadoop.Path(staged), hadoop.Path(path)):
        raise OSError(f"cannot put {staged} in place")
    fs.delete(old, True)


def joined(values: Column) -> Column:
    return F.array_join(F.filter(values, lambda v: v.isNotNull()), "; ")


def master_rows(events: DataFrame) -> DataFrame:
    """The 20 columns of the master export, one row per event, multiple values joined by "; "."""
    occ = lambda f: joined(F.transform("occurrences", f))
    prov = lambda f: joined(F.array_sort(F.array_distinct(F.transform("provenance", lambda p: p[f].cast("string")))))
    address = joined(F.transform(F.array_sort(F.map_entries("address")), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    starts, ends = occ(temporal.occurrence_start), occ(lambda o: F.when(o["kind"] == "date", o["end_date"]).otherwise(temporal.iso_instant(o["end_at"])))
    zones = occ(lambda o: F.when(o["kind"] == "date", F.lit("date-only")).otherwise(o["source_timezone"]))
    return events.select(
        "id", "title", "description", joined(F.col("categories")).alias("categories"), "organization", "venue", "city", "region", "cost", address.alias("address"), starts.alias("starts"), ends.alias("ends"), zones.alias("timezones"),
        "online_location_url", "public_source_url", "ticket_url", "source_category", prov("source_record_id").alias("source_ids"), prov("source_url").alias("source_urls"), prov("retrieved_at").alias("retrieved_at"),
    )


def write_master(events: DataFrame, path: str) -> None:
    """The export as text lines, in order of start, title and id; sorted ranges are separate files under path."""
    rows = master_rows(events).select(text.csv_line(*[F.col(c) for c in MASTER]).alias("line"), "starts", "title", "id")
    rows.orderBy("starts", "title", "id").select("line").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, bytes, sha256) of the files under path."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


