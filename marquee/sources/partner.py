"""Partner feed import: continuation rows, source and venue matching, skip rules and the run's report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions import temporal, text, urls

CANCELLED = r"(?i)\b(?:cancelled|canceled)\b"


def attach_continuations(rows: DataFrame, file: str = "file_name", line: str = "physical_row") -> tuple[DataFrame, DataFrame]:
    """(rows with event_row, failures): a row without a title continues the last titled one of its file. A leading
    continuation and an event without any start date are failures. Order is by physical line."""
    titled = F.coalesce(F.trim("title"), F.lit("")) != ""
    w = Window.partitionBy(file).orderBy(line)
    filled = rows.withColumn("event_row", F.last(F.when(titled, F.col(line)), ignorenulls=True).over(w))
    leading = filled.where("event_row is null").select(file, F.col(line).alias("physical_row"), F.lit("continuation_without_event").alias("code"))
    dated = filled.where("event_row is not null").groupBy(file, "event_row").agg(F.count_if(F.coalesce(F.trim("start_date"), F.lit("")) != "").alias("n"))
    bare = dated.where("n = 0").select(file, F.col("event_row").alias("physical_row"), F.lit("event_without_occurrence").alias("code"))
    return filled.where("event_row is not null"), leading.unionByName(bare)


def category_names(ids: Column, names: DataFrame | dict, unknown: str = "Category ") -> Column:
    """Ordered distinct names of a comma separated id list; unknown ids keep their number."""
    table = names if isinstance(names, dict) else {r[0]: r[1] for r in names.collect()}
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    parts = F.filter(F.transform(F.split(ids, ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.array_distinct(F.transform(parts, lambda x: F.coalesce(F.try_element_at(lookup, x), F.concat(F.lit(unknown), x))))


def raw_occurrences(rows: Column) -> Column:
    """Occurrences of one event from its dated rows (array of start_date, start_time, end_date): a range where the end
    is later, a local instant where a time is given, else a date; distinct and in order, ids by position."""
    def one(r: Column) -> Column:
        s, e = temporal.us_date(r["start_date"]).cast("string"), temporal.us_date(r["end_date"]).cast("string")
        t = temporal.clock12(F.trim(r["start_time"]))
        ranged = F.coalesce(e > s, F.lit(False))
        start = F.when(~ranged & t.isNotNull(), F.concat(s, F.lit("T"), t)).otherwise(s)
        end = F.when(ranged | t.isNull(), e)
        return F.struct(start.alias("start"), end.alias("end"), F.when(~ranged & t.isNotNull(), F.lit(temporal.ZONE)).alias("zone"))

    return F.array_sort(F.array_distinct(F.transform(rows, one)))


def inputs(titled: DataFrame, occurrences: DataFrame, key: str = "input_id") -> DataFrame:
    """Logical events: the titled rows with their occurrences, equal rows once."""
    occ = occurrences.dropDuplicates().groupBy(key).agg(F.array_sort(F.collect_list(F.struct("physical_row", "start_date", "start_time", "end_date"))).alias("rows"))
    return titled.dropDuplicates([key]).join(occ, key)


def match_source(events: DataFrame, sources: DataFrame, fallback_id: str, key: str = "input_id") -> DataFrame:
    """events with source_id: the source that shares a host, 1000 points plus the length of its path where the event's
    path starts with it; ties to the smaller id; nothing found gives the fallback. The join is on the host."""
    mine = events.select(key, F.explode(F.array("url", "ticket_url")).alias("u")).select(key, urls.canonical_url(F.col("u")).alias("u")).where("u is not null")
    mine = mine.select(key, urls.host(F.col("u")).alias("h"), urls.path(F.col("u")).alias("p")).distinct()
    theirs = sources.select("id", F.explode("urls").alias("c")).select("id", urls.canonical_url(F.col("c")).alias("c")).where("c is not null")
    theirs = theirs.select("id", urls.host(F.col("c")).alias("h"), F.regexp_replace(urls.path(F.col("c")), "/+$", "").alias("cp")).distinct()
    score = 1000 + F.when((F.length("cp") > 1) & F.startswith(F.col("p"), F.col("cp")), F.length("cp")).otherwise(0)
    best = mine.join(theirs, "h").groupBy(key).agg(F.min_by("id", F.struct((-score).alias("s"), "id")).alias("source_id"))
    return events.join(best, key, "left").withColumn("source_id", F.coalesce("source_id", F.lit(fallback_id)))


def fallback_source(sources: DataFrame, pattern: str) -> DataFrame:
    return sources.where(F.col("organization_name").rlike(pattern)).orderBy("id").limit(1)


def title_dates(events: DataFrame) -> DataFrame:
    """(key, day, event_id): an index of titles and start days."""
    return events.select(F.col("id").alias("event_id"), text.dedupe_text(F.col("title")).alias("key"), F.explode(F.array_distinct(F.transform("occurrences", temporal.occurrence_day))).alias("day"))


def existing_urls(events: DataFrame) -> DataFrame:
    """(u): canonical forms of public, ticket and provenance URLs."""
    all_urls = F.concat(F.array("public_source_url", "ticket_url"), F.transform("provenance", lambda p: p["source_url"]))
    return events.select(F.explode(all_urls).alias("u")).select(urls.canonical_url(F.col("u")).alias("u")).where("u is not null").distinct()


def url_counts(inputs_df: DataFrame, key: str = "input_id") -> DataFrame:
    """(u, n): how often a canonical URL occurs in the feed, each field of each event once."""
    return inputs_df.select(key, F.explode(F.array("url", "ticket_url")).alias("u")).select(key, urls.canonical_url(F.col("u")).alias("u")).where("u is not null").groupBy("u").agg(F.count("*").alias("n"))


def split_existing(candidates: DataFrame, existing: DataFrame, feed: DataFrame, key: str = "input_id") -> tuple[DataFrame, DataFrame]:
    """(new, skipped): skipped share title and day with an existing event, or a URL that the feed has once."""
    idx = title_dates(existing).select("key", "day").distinct()
    mine = candidates.select(key, text.dedupe_text(F.col("title")).alias("key"), F.explode("days").alias("day"))
    by_title = mine.join(idx, ["key", "day"], "left_semi").select(key)
    once = url_counts(feed, key).where("n = 1").join(existing_urls(existing), "u", "left_semi")
    by_url = candidates.select(key, F.explode(F.array("url", "ticket_url")).alias("u")).select(key, urls.canonical_url(F.col("u")).alias("u")).join(once, "u", "left_semi").select(key)
    skip = by_title.unionByName(by_url).distinct()
    return candidates.join(skip, key, "left_anti"), candidates.join(skip, key, "left_semi")


def venue_hints(feed: DataFrame, existing: DataFrame, key: str = "input_id") -> DataFrame:
    """(venue_id, hint): the mode of the places of events that match title and day (ties to the smaller hint), else
    the one place that the venue's URL host stands for."""
    place = F.to_json(F.struct("venue", "city", "region", F.array_sort(F.map_entries("address")).alias("address")), {"ignoreNullFields": "false"})
    known = existing.where(F.coalesce("venue", "city").isNotNull() | F.col("address").isNotNull()).withColumn("hint", place)
    dates = feed.where(F.coalesce("venue_id", F.lit("")) != "").select("venue_id", key, text.dedupe_text(F.col("title")).alias("key"), F.explode("days").alias("day"))
    idx = title_dates(known).join(known.select(F.col("id").alias("event_id"), "hint"), "event_id")
    votes = dates.join(idx, ["key", "day"]).select("venue_id", key, "event_id", "hint").distinct().groupBy("venue_id", "hint").agg(F.count("*").alias("n"))
    by_mode = votes.groupBy("venue_id").agg(F.min_by("hint", F.struct((-F.col("n")).alias("n"), "hint")).alias("hint"))
    hosts = known.select("hint", F.explode(F.concat(F.array("public_source_url"), F.transform("provenance", lambda p: p["source_url"]))).alias("u")).select("hint", urls.host(urls.canonical_url(F.col("u"))).alias("h")).where("h is not null")
    single = hosts.groupBy("h").agg(F.min("hint").alias("hint"), F.max("hint").alias("most")).where("hint = most").select("h", "hint")
    rest = feed.where(F.coalesce("venue_id", F.lit("")) != "").select("venue_id", urls.host(urls.canonical_url(F.col("url"))).alias("h")).join(by_mode, "venue_id", "left_anti")
    by_host = rest.join(single, "h").groupBy("venue_id").agg(F.min("hint").alias("hint"))
    return by_mode.unionByName(by_host)


def supplied_ids(prefix: str) -> Column:
    first = F.get(F.col("occurrences"), F.lit(0))
    return text.supplied_id(prefix, F.col("venue_id"), F.col("presenter_id"), text.dedupe_text(F.col("title")), urls.canonical_url(F.col("url")), urls.canonical_url(F.col("ticket_url")), F.coalesce(first["start"], F.lit("")), first["end"])


def report(feed: DataFrame, skipped: DataFrame, imported: DataFrame) -> DataFrame:
    """One row: what a run read, left out and took."""
    cancelled = F.count_if(F.col("title").rlike(CANCELLED))
    read = feed.agg(F.count("*").alias("events"), F.sum(F.size("rows")).alias("occurrences"), cancelled.alias("cancelled"), F.count_if(text.parse_price(F.col("low_price")).isNotNull() | text.parse_price(F.col("high_price")).isNotNull()).alias("priced"))
    return read.crossJoin(skipped.agg(F.count("*").alias("skipped_existing"))).crossJoin(imported.agg(F.count("*").alias("imported")))


def collisions(events: DataFrame, key: Column) -> DataFrame:
    """Keys that several events share."""
    return events.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("id")).alias("ids")).where("n > 1")
