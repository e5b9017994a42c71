"""Schemas of the canonical entities as DDL; nothing is inferred at read time."""

from __future__ import annotations


def struct(fields: str) -> str:
    """A column list as a struct type."""
    return "struct<" + ", ".join(f.strip().replace(" ", ":", 1) for f in fields.split(",\n")) + ">"


OCCURRENCE = """id string,
kind string,
start_date string,
end_date string,
start_at timestamp,
end_at timestamp,
source_timezone string,
local_date string,
local_time string,
original_start string,
original_end string"""
RAW_OCCURRENCE = "id string,\nstart string,\nend string,\nzone string"
PROVENANCE = "source_record_id string,\nsource_url string,\nsource_supplied_id string,\nretrieved_at timestamp"
ISSUE = "path string,\ncode string,\nmessage string,\nfile_name string,\nphysical_row int,\nrejected_value string"
COORDINATES = "latitude double,\nlongitude double"
URL_FIELD = "kind string,\nvalues array<string>,\nerrors array<string>"
_DESCRIBED = f"""title string,
description string,
categories array<string>,
organization string,
venue string,
city string,
region string,
cost string,
audience string,
accessibility string,
address map<string,string>,
coordinates {struct(COORDINATES)},
online_location_url string,
public_source_url string,
ticket_url string,
source_category string"""
CANDIDATE = f"""id string,
source_record_id string,
source_url string,
source_supplied_id string,
retrieved_at timestamp,
{_DESCRIBED},
occurrences array<{struct(RAW_OCCURRENCE)}>"""
EVENT = f"""id string,
canonical_identity string,
identity_version int,
{_DESCRIBED},
publication_status string,
occurrences array<{struct(OCCURRENCE)}>,
validation_issues array<{struct(ISSUE)}>,
provenance array<{struct(PROVENANCE)}>,
record_version int"""
OBSERVATION = f"event {struct(EVENT)},\npayload_digest string,\nadapter_key string,\nadapter_version string,\nextraction_format string,\nrun_id string,\nseq bigint"
JOB = """id string,
job_type string,
payload string,
state string,
available_at timestamp,
created_at timestamp,
lease_owner string,
lease_expires_at timestamp,
attempts int,
max_attempts int,
idempotency_key string"""
STATE_DOCUMENT = f"schemaVersion int,\nevents array<{struct(EVENT)}>,\nupdatedAt string"
SOURCE_CATEGORIES = ("ddoa-grantee", "non-grantee", "government", "library")
PUBLICATION_STATUSES = ("pending", "published", "rejected", "archived")
