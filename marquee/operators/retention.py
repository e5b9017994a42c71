"""Retention: which events may be archived, settings and the archival job."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions import temporal

MAX_DAYS = 3650


def is_retention_days(value: object) -> bool:
    return not isinstance(value, bool) and isinstance(value, (int, float)) and float(value).is_integer() and 0 <= value <= MAX_DAYS


def update_retention_days(current: int, proposed: object) -> dict:
    """A rejected proposal keeps the current value."""
    if not is_retention_days(current):
        raise ValueError("the current retention period is a whole number from 0 through 3650")
    ok = is_retention_days(proposed)
    return {"accepted": ok, "value": int(proposed) if ok else current, "errors": [] if ok else [{"path": "retentionDays", "code": "out_of_range"}]}


def bounded_integer(value: Column, low: int, high: int) -> Column:
    """A number or its text as a whole number within bounds, else null."""
    n = F.trim(value.cast("string")).try_cast("double")
    return F.when((n == F.floor(n)) & n.between(low, high), n.cast("long"))


def eligible_events(events: DataFrame, opened_at: str, days: int) -> DataFrame:
    """Published events all of whose occurrences (one at least) ended long enough ago."""
    done = (F.size("occurrences") > 0) & F.forall("occurrences", lambda o: temporal.is_archive_eligible(o, opened_at, days))
    return events.where((F.col("publication_status") == "published") & F.coalesce(done, F.lit(False)))


def eligible_by_joins(events: DataFrame, occurrences: DataFrame, opened_at: str, days: int) -> DataFrame:
    """The same over a child table: an occurrence exists (semi join) and none is not eligible (anti join)."""
    ok = temporal.is_archive_eligible(F.col("o"), opened_at, days)
    blocking = occurrences.where(~ok).select(F.col("event_id").alias("blocked"))
    published = events.where(F.col("publication_status") == "published")
    with_any = published.join(occurrences.select(F.col("event_id").alias("has")).distinct(), F.col("id") == F.col("has"), "left_semi")
    return with_any.join(blocking, F.col("id") == F.col("blocked"), "left_anti").orderBy("id")


def archival_job(opened_at: str, days: int) -> dict:
    """The job's definition; its key is the same for the same captured instant and period."""
    payload = {"version": 1, "openedAt": opened_at, "retentionDays": days}
    key = hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()
    return {"job_type": "archival-eligibility", "payload": json.dumps(payload, sort_keys=True), "idempotency_key": f"archival:{key}"}


def run_archival_job(events: DataFrame, payload: str) -> DataFrame:
    """The ids that the job's payload finds eligible, in order; nothing is archived by it."""
    p = json.loads(payload)
    if p.get("version") != 1:
        raise ValueError("unsupported archival payload")
    return eligible_events(events, p["openedAt"], p["retentionDays"]).select("id").orderBy("id")
