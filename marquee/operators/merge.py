"""Cross-source merge and exactly-once upsert, as windows instead of folds.

A hot dedupe key costs one window partition of slim rows: windows run over keys, scores and digests only, wide columns
join back by row id. Provenance is united by distinct aggregation, which combines before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions import temporal, text
from marquee.operators.normalize import content_fingerprint


def dedupe_key(first: Column) -> Column:
    """Title, first start and town (or else venue), in base letters and digits."""
    city, venue = text.dedupe_text(F.col("city")), text.dedupe_text(F.col("venue"))
    place = F.when(city != "", F.concat(F.lit("city:"), city)).otherwise(F.concat(F.lit("venue:"), venue))
    return F.concat_ws("|", text.dedupe_text(F.col("title")), F.coalesce(temporal.occurrence_start(first), F.lit("")), place)


def completeness() -> Column:
    """0 to 15: up to 3 for the description's length (UTF-16 units), the rest for useful fields."""
    venue = text.dedupe_text(F.col("venue"))
    points = F.floor(F.octet_length(F.encode(F.coalesce("description", F.lit("")), "UTF-16BE")) / 2 / 250)
    flag = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return (
        F.least(F.lit(3), points).cast("int") + flag(~venue.isin("", "event location"), 3) + flag(filled("city"), 2) + flag(F.col("address").isNotNull(), 3)
        + flag(filled("ticket_url"), 2) + flag(F.size("categories") > 0, 1) + flag(filled("organization"), 1)
    )


def merge_events(events: DataFrame) -> DataFrame:
    """One event per dedupe key: the most complete, then the smallest id; provenance of all, distinct and in order of
    first appearance. An id keeps the key it came with first, whatever its later versions say; rows are taken by id,
    then by ``record_version``."""
    first = F.get(F.col("occurrences"), F.lit(0))
    rid = F.xxhash64("id", "record_version", F.to_json(F.struct("title", "description", "provenance")))
    keyed = events.withColumn("__rid", rid).dropDuplicates(["__rid"]).withColumn("__key", dedupe_key(first)).withColumn("__score", completeness())
    slim = keyed.select("__rid", "id", "record_version", "__key", "__score")
    by_id = Window.partitionBy("id").orderBy("record_version", "__rid")
    slim = slim.withColumn("__g", F.first("__key").over(by_id))
    winner = slim.groupBy("__g").agg(F.min_by("__rid", F.struct((-F.col("__score")).alias("s"), "id", "record_version", "__rid")).alias("__rid"))
    rows = keyed.join(slim.select("__rid", "__g"), "__rid").select("__g", "id", "record_version", F.posexplode("provenance").alias("pos", "p"))
    seen = rows.groupBy("__g", "p").agg(F.min(F.struct("id", "record_version", "pos")).alias("at"))
    united = seen.groupBy("__g").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "p"))), lambda x: x["p"]).alias("__prov"))
    out = keyed.join(winner, "__rid").join(united, "__g", "left")
    return out.withColumn("provenance", F.coalesce("__prov", "provenance")).drop("__rid", "__g", "__key", "__score", "__prov")


def merge_order() -> list[Column]:
    return [temporal.occurrence_start(F.get(F.col("occurrences"), F.lit(0))), F.collate("title", "UNICODE"), F.col("id")]


def invalid_observations(obs: DataFrame) -> DataFrame:
    """obs with errors: why an observation may not be ingested."""
    e = F.col("event")
    blank = lambda c, n: F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(n))
    digest = lambda c, n: F.when(~F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False)), F.lit(n))
    checks = F.array(
        blank(e["id"], "event.id"), F.when(F.coalesce(e["identity_version"], F.lit(0)) != 1, "identity_version"), digest(e["canonical_identity"], "canonical_identity"),
        digest(F.col("payload_digest"), "payload_digest"), blank(F.col("adapter_key"), "adapter_key"), blank(F.col("adapter_version"), "adapter_version"), blank(F.col("extraction_format"), "extraction_format"),
        F.when(F.coalesce(F.size(e["provenance"]), F.lit(0)) < 1, "provenance"), F.when(F.coalesce(F.size(e["occurrences"]), F.lit(0)) < 1, "occurrences"),
        F.when(F.exists(e["provenance"], lambda p: ~F.coalesce(p["source_url"].rlike("^https?://[^/]"), F.lit(False)) | p["retrieved_at"].isNull() | (F.coalesce(F.trim(p["source_record_id"]), F.lit("")) == "")), "provenance.value"),
    )
    return obs.withColumn("errors", F.filter(checks, lambda x: x.isNotNull()))


def ingest(rows: DataFrame, identity: str = "identity", seq: str = "seq", content: str = "content", keys: str = "keys") -> DataFrame:
    """What each observation does, in order of seq within its identity: (identity, seq, action, version, new_keys).

    keys is the array of its provenance keys. An observation without a key that is new is a replay (duplicate, nothing
    written); the first of an identity is created; then content equal to that retained is a duplicate, other content
    an update with the next version. First sightings of keys are a plain aggregate; the windows see slim rows."""
    slim = rows.select(F.col(identity).alias("identity"), F.col(seq).alias("seq"), F.col(content).alias("content"), F.col(keys).alias("keys"))
    sightings = slim.select("identity", "seq", F.explode(F.array_distinct("keys")).alias("k")).groupBy("identity", "k").agg(F.min("seq").alias("seq"))
    fresh = sightings.groupBy("identity", "seq").agg(F.count("*").alias("new_keys"))
    known = slim.join(fresh, ["identity", "seq"], "left").withColumn("new_keys", F.coalesce("new_keys", F.lit(0)))
    by = Window.partitionBy("identity").orderBy("seq")
    live = known.where("new_keys > 0").withColumn("before", F.lag("content").over(by)).withColumn("nth", F.row_number().over(by))
    action = F.when(F.col("nth") == 1, "created").when(F.col("before").eqNullSafe(F.col("content")), "duplicate").otherwise("updated")
    live = live.withColumn("action", action)
    live = live.withColumn("version", F.lit(1) + F.sum((F.col("action") == "updated").cast("int")).over(by)).select("identity", "seq", "action", "version", "new_keys")
    replays = known.where("new_keys = 0").select("identity", "seq", F.lit("duplicate").alias("action"), F.lit(None).cast("int").alias("version"), "new_keys")
    return live.withColumn("version", F.col("version").cast("int")).unionByName(replays)


def provenance_keys(event: Column, digest: Column) -> Column:
    """Keys of an observation: provenance values and payload digest."""
    return F.transform(event["provenance"], lambda p: F.to_json(F.array(p["source_record_id"], p["source_url"], p["source_supplied_id"], temporal.iso_instant(p["retrieved_at"]), digest), {"ignoreNullFields": "false"}))


def observe(obs: DataFrame) -> DataFrame:
    """Observations in the shape that ingest takes, after validation."""
    good = invalid_observations(obs).where(F.size("errors") == 0)
    flat = good.select("*", *[F.col("event")[c].alias(c) for c in ("title", "description", "categories", "organization", "venue", "city", "region", "cost", "audience", "accessibility", "coordinates", "online_location_url", "public_source_url", "ticket_url", "source_category", "address", "occurrences", "validation_issues")])
    return flat.select(F.col("event")["canonical_identity"].alias("identity"), "seq", content_fingerprint().alias("content"), provenance_keys(F.col("event"), F.col("payload_digest")).alias("keys"), "event", "payload_digest")


def apply_ingest(observed: DataFrame) -> DataFrame:
    """The retained event per identity: content of the last live change, id of the first, provenance of all."""
    acts = ingest(observed)
    j = observed.join(acts.select("identity", "seq", "action", "version", "new_keys"), ["identity", "seq"])
    live = j.where("new_keys > 0")
    changed = live.where("action != 'duplicate'")
    base = changed.groupBy("identity").agg(F.max_by("event", "seq").alias("event"), F.min_by(F.col("event")["id"], "seq").alias("id"), F.max("version").alias("record_version"))
    prov = live.select("identity", F.explode("event.provenance").alias("p")).distinct().groupBy("identity").agg(F.array_sort(F.collect_list("p")).alias("provenance"))
    return base.join(prov, "identity")


def union_provenance(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(a, b)))
