"""Queries of the read API, retention and event model on the stored tables, with their SQL oracles."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import temporal, text, urls
from marquee.operators import event_query as eq
from marquee.operators import merge, normalize, retention
from marquee.plans import views
from marquee.plans.views import OPENED_AT
from marquee.session import read_table
from marquee.streaming import ingestion

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Events once per id, and their occurrences with local day and time.
EV = "ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at) AS rn FROM event_records) WHERE rn = 1)"
OCC = """occ AS (SELECT e.*, o.id AS occ_id, o.kind AS kind, o.start_date AS sd, o.start_instant AS si,
  CASE WHEN o.kind = 'date' THEN o.start_date ELSE strftime(timezone(o.source_timezone, o.start_instant), '%Y-%m-%d') END AS day,
  CASE WHEN o.kind = 'instant' THEN strftime(timezone(o.source_timezone, o.start_instant), '%H:%M:%S') ELSE '' END AS clock
  FROM (SELECT *, unnest(occurrences) AS o FROM ev) e)"""
UPCOMING = "((kind = 'date' AND sd >= '2026-08-18') OR (kind = 'instant' AND si >= TIMESTAMPTZ '2026-08-18 12:00:00+00'))"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


PAGE = eq.ListQuery(OPENED_AT, None, categories=("Gardens", "Strings", "Exhibits"), regions=("Mid County", "Inland Bays"), page=2, page_size=50)


_PAGE_SQL = f"""WITH {EV}, {OCC} SELECT id, occ_id AS occurrence_id, day, clock, title, city FROM occ
    WHERE publication_status = 'published' AND region IN ('Mid County', 'Inland Bays') AND list_has_any(categories, ['Gardens', 'Strings', 'Exhibits']) AND {UPCOMING}
    ORDER BY day, CASE WHEN kind = 'date' THEN 0 ELSE 1 END, clock, id, occ_id LIMIT 50"""


def _page(spark: SparkSession, d: str, q: eq.ListQuery) -> DataFrame:
    o = F.col("occurrence")
    return eq.list_events(views.events(spark, d, views.PUBLISHED), q).select("id", o["id"].alias("occurrence_id"), temporal.occurrence_day(o).alias("day"), F.coalesce(o["local_time"], F.lit("")).alias("clock"), "title", "city")


@query(f"{_PAGE_SQL} OFFSET 50")
def list_upcoming_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of upcoming published occurrences under facet filters."""
    return _page(spark, d, PAGE)


@query(_PAGE_SQL)
def list_first_page(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: the first page."""
    return _page(spark, d, replace(PAGE, page=1))


@query(
    f"""WITH {EV}, {OCC} SELECT count(*) AS total_count, CAST(ceil(count(*) / 50.0) AS BIGINT) AS total_pages FROM occ
    WHERE publication_status = 'published' AND region IN ('Mid County', 'Inland Bays') AND list_has_any(categories, ['Gardens', 'Strings', 'Exhibits']) AND {UPCOMING}"""
)
def list_totals(spark: SparkSession, d: str) -> DataFrame:
    return eq.totals(eq.matches(views.events(spark, d, views.PUBLISHED), PAGE), PAGE.page_size)


@query(
    f"""WITH {EV} SELECT id FROM ev WHERE publication_status = 'published' AND (contains(lower(coalesce(title, '')), 'harbor songs') OR contains(lower(coalesce(description, '')), 'harbor songs')
    OR contains(lower(replace(coalesce(organization, ''), chr(160), ' ')), 'harbor songs') OR contains(lower(coalesce(venue, '')), 'harbor songs') OR contains(lower(coalesce(city, '')), 'harbor songs') OR contains(lower(array_to_string(coalesce(categories, []), chr(1))), 'harbor songs'))"""
)
def search_events(spark: SparkSession, d: str) -> DataFrame:
    return eq.search(views.events(spark, d, views.PUBLISHED), " Harbor Songs ").select("id")


@query(
    f"""WITH {EV}, p AS (SELECT * FROM ev WHERE publication_status = 'published') SELECT DISTINCT facet, value FROM (
    SELECT 'region' AS facet, region AS value FROM p UNION ALL SELECT 'organization', organization FROM p UNION ALL SELECT 'source_category', source_category FROM p
    UNION ALL SELECT 'cost', cost_text FROM p UNION ALL SELECT 'audience', audience FROM p UNION ALL SELECT 'accessibility', accessibility FROM p UNION ALL SELECT 'category', unnest(categories) FROM p) WHERE coalesce(value, '') <> ''"""
)
def facets(spark: SparkSession, d: str) -> DataFrame:
    return eq.facets(views.events(spark, d, views.PUBLISHED))


@query(
    f"""WITH {EV}, {OCC} SELECT id, title, occ_id AS occurrence_id, day, public_source_url AS source_url FROM occ WHERE id = 'event-000000010' AND publication_status = 'published' AND {UPCOMING}"""
)
def detail_lookup(spark: SparkSession, d: str) -> DataFrame:
    out = eq.detail(views.events(spark, d, f"{views.PUBLISHED} AND id = 'event-000000010'"), "event-000000010", OPENED_AT)
    return out.select("id", "title", "source.url", F.explode("occurrences").alias("o")).select("id", "title", F.col("o.id").alias("occurrence_id"), temporal.occurrence_day(F.col("o")).alias("day"), F.col("url").alias("source_url"))


_ELIGIBLE = "(CASE WHEN kind = 'date' THEN DATE '2026-08-18' >= CAST(sd AS DATE) + 31 ELSE TIMESTAMPTZ '2026-08-18 12:00:00+00' >= si + INTERVAL 720 HOUR END)"


@query(f"WITH {EV}, {OCC} SELECT id FROM occ WHERE publication_status = 'published' GROUP BY id HAVING bool_and({_ELIGIBLE})")
def archival_forall(spark: SparkSession, d: str) -> DataFrame:
    return retention.eligible_events(views.events(spark, d, views.PUBLISHED), OPENED_AT, 30).select("id")


@query(f"WITH {EV}, {OCC} SELECT id FROM ev WHERE publication_status = 'published' AND EXISTS (SELECT 1 FROM occ WHERE occ.id = ev.id) AND NOT EXISTS (SELECT 1 FROM occ WHERE occ.id = ev.id AND NOT {_ELIGIBLE}) ORDER BY id")
def archival_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    e = views.events(spark, d, views.PUBLISHED)
    child = e.select(F.col("id").alias("event_id"), F.explode("occurrences").alias("o"))
    return retention.eligible_by_joins(e, child, OPENED_AT, 30).select("id")


@query(
    f"""WITH {EV}, {OCC} SELECT id, kind, CASE WHEN {UPCOMING} THEN 1 ELSE 0 END AS upcoming FROM occ"""
)
def upcoming_flags(spark: SparkSession, d: str) -> DataFrame:
    e = views.events(spark, d).select("id", F.explode("occurrences").alias("o"))
    return e.select("id", F.col("o.kind").alias("kind"), temporal.is_upcoming(F.col("o"), OPENED_AT).cast("int").alias("upcoming"))


@query("SELECT publication_status, source_category, count(*) AS n FROM (SELECT DISTINCT id, publication_status, source_category FROM event_records) GROUP BY 1, 2")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return views.events(spark, d).groupBy("publication_status", "source_category").agg(F.count("*").alias("n"))


@query(
    f"""WITH {EV}, h AS (SELECT id AS event_id, unnest(provenance) AS p FROM ev) SELECT h.event_id, s.organization_name, p.source_url AS source_url, epoch_us(p.retrieved_at) AS retrieved_us
    FROM h JOIN source_records s ON s.id = p.source_record_id"""
)
def history_join(spark: SparkSession, d: str) -> DataFrame:
    h = views.events(spark, d).select(F.col("id").alias("event_id"), F.inline("provenance")).withColumnRenamed("source_record_id", "provenance_id")
    s = read_table(spark, d, "source_records").select(F.col("id").alias("provenance_id"), "organization_name")
    return eq.history(h, s).select("event_id", "organization_name", "source_url", F.unix_micros("retrieved_at").alias("retrieved_us"))


@query(
    """SELECT o_orderkey, o_orderstatus, count(l_linenumber) AS n_lines, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS lines
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2"""
)
def hydrate_children(spark: SparkSession, d: str) -> DataFrame:
    o, li = read_table(spark, d, "orders"), read_table(spark, d, "lineitem")
    h = eq.hydrate(o.select(F.col("o_orderkey").alias("k"), "o_orderstatus"), li.select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey"), "k", ["l_linenumber", "l_partkey"], "lines", [])
    lines = F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",")
    return h.select(F.col("k").alias("o_orderkey"), "o_orderstatus", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(lines, F.lit("")).alias("lines"))


@query("SELECT o_orderkey, count(*) OVER () AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 20")
def page_with_total(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    n = o.agg(F.count("*").alias("total"))
    return eq.page(o.select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 2, 20).select("o_orderkey").crossJoin(F.broadcast(n))


def normalized_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with outcome, identity and error codes (the identity needs NFKC, which SQL lacks)."""
    n = normalize.normalize_events(views.candidates(spark, d))
    return n.select("id", "canonical_identity", F.size("errors").alias("n_errors"), F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["path"], e["code"])), ",").alias("errors"), F.size("validation_issues").alias("n_issues"))


QUERIES["normalized_candidates"] = normalized_candidates


@query(
    """WITH r AS (SELECT DISTINCT occ_key, start_text FROM raw_occurrences) SELECT occ_key, CASE WHEN regexp_full_match(start_text, '\\d{4}-\\d{2}-\\d{2}') AND try_cast(start_text AS DATE) IS NOT NULL THEN 1 ELSE 0 END AS is_date FROM r"""
)
def strict_dates(spark: SparkSession, d: str) -> DataFrame:
    r = read_table(spark, d, "raw_occurrences").select("occ_key", "start_text").distinct()
    return r.select("occ_key", F.coalesce(temporal.strict_date(F.col("start_text")).isNotNull(), F.lit(False)).cast("int").alias("is_date"))


def parsed_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """raw_occurrences as tagged unions with error codes."""
    r = read_table(spark, d, "raw_occurrences").dropDuplicates(["occ_key"])
    raw = F.struct(F.col("occ_key").alias("id"), F.col("start_text").alias("start"), F.col("end_text").alias("end"), F.col("source_timezone").alias("zone"))
    o = F.col("o")
    return r.select(temporal.parse_occurrence(raw).alias("o")).select(o["id"].alias("occ_key"), o["kind"].alias("kind"), F.unix_micros(o["start_at"]).alias("start_us"), o["local_date"].alias("local_date"), o["local_time"].alias("local_time"), o["error_code"].alias("error_code"))


QUERIES["parsed_occurrences"] = parsed_occurrences

_KEY = r"trim(regexp_replace(replace(lower(strip_accents(trim(regexp_replace({0}, '\s+', ' ', 'g')))), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
_DEDUPE = f"""{_KEY.format("coalesce(title, '')")} || '|' || CASE WHEN kind = 'date' THEN sd ELSE strftime(timezone('UTC', si), '%Y-%m-%dT%H:%M:%S') || 'Z' END || '|' ||
  CASE WHEN {_KEY.format("coalesce(city, '')")} <> '' THEN 'city:' || {_KEY.format("coalesce(city, '')")} ELSE 'venue:' || {_KEY.format("coalesce(venue, '')")} END"""


@query(f"WITH {EV}, {OCC} SELECT {_DEDUPE} AS key, count(*) AS n, min(id) AS first_id FROM occ GROUP BY 1 HAVING count(*) > 1")
def collision_groups(spark: SparkSession, d: str) -> DataFrame:
    e = views.events(spark, d)
    return e.groupBy(merge.dedupe_key(F.get("occurrences", F.lit(0))).alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


_SCORE = f"""least(3, length(coalesce(description, '')) // 250) + CASE WHEN {_KEY.format("coalesce(venue, '')")} NOT IN ('', 'event location') THEN 3 ELSE 0 END + CASE WHEN coalesce(city, '') <> '' THEN 2 ELSE 0 END
  + CASE WHEN address IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN coalesce(ticket_url, '') <> '' THEN 2 ELSE 0 END + CASE WHEN len(categories) > 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(organization, '') <> '' THEN 1 ELSE 0 END"""


@query(f"WITH {EV} SELECT id, CAST({_SCORE} AS INTEGER) AS score FROM ev")
def completeness_score(spark: SparkSession, d: str) -> DataFrame:
    return views.events(spark, d).select("id", merge.completeness().cast("int").alias("score"))


@query(
    f"""WITH {EV}, {OCC}, k AS (SELECT id, {_DEDUPE} AS key, {_SCORE} AS score, provenance FROM occ), w AS (SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY score DESC, id) AS rn FROM k),
    p AS (SELECT key, unnest(provenance) AS x FROM k), n AS (SELECT key, count(DISTINCT (x.source_record_id, x.source_url, coalesce(x.source_supplied_id, '~'), x.retrieved_at)) AS n_provenance FROM p GROUP BY 1)
    SELECT w.id, n_provenance FROM w JOIN n USING (key) WHERE rn = 1"""
)
def merge_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_events(views.events(spark, d)).select("id", F.size("provenance").cast("long").alias("n_provenance"))


@query(f"""WITH {EV}, p AS (SELECT id, unnest(provenance) AS x FROM ev) SELECT id, count(DISTINCT (x.source_record_id, x.source_url, coalesce(x.source_supplied_id, '~'), x.retrieved_at)) AS n FROM p GROUP BY 1""")
def provenance_union(spark: SparkSession, d: str) -> DataFrame:
    """The union of an event's provenance with the same in other order holds every entry once."""
    e = views.events(spark, d).where(F.size("provenance") > 0)
    return e.select("id", F.size(merge.union_provenance(F.col("provenance"), F.reverse("provenance"))).cast("long").alias("n"))


@query(
    """WITH b AS (SELECT user_id AS identity, event_id AS seq, event_type AS content, CAST(epoch_us(ts) // 3600000000 AS VARCHAR) || event_type AS k FROM events),
    f AS (SELECT *, min(seq) OVER (PARTITION BY identity, k) AS first_seen FROM b), live AS (SELECT *, lag(content) OVER (PARTITION BY identity ORDER BY seq) AS before, row_number() OVER (PARTITION BY identity ORDER BY seq) AS nth FROM f WHERE first_seen = seq),
    a AS (SELECT *, CASE WHEN nth = 1 THEN 'created' WHEN before = content THEN 'duplicate' ELSE 'updated' END AS action FROM live)
    SELECT identity, seq, action, CAST(1 + sum(CASE WHEN action = 'updated' THEN 1 ELSE 0 END) OVER (PARTITION BY identity ORDER BY seq) AS INTEGER) AS version FROM a
    UNION ALL SELECT identity, seq, 'duplicate', NULL FROM f WHERE first_seen <> seq"""
)
def upsert_actions(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    key = F.concat(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).cast("string"), "event_type")
    rows = e.select(F.col("user_id").alias("identity"), F.col("event_id").alias("seq"), F.col("event_type").alias("content"), F.array(key).alias("keys"))
    return merge.ingest(rows).select("identity", "seq", "action", "version")


@query(
    """WITH g AS (SELECT title, description, organization, venue, city, count(DISTINCT id) AS n FROM event_records GROUP BY 1, 2, 3, 4, 5) SELECT n, count(*) AS n_groups FROM g GROUP BY 1"""
)
def content_groups(spark: SparkSession, d: str) -> DataFrame:
    e = views.events(spark, d)
    digest = F.sha2(F.to_json(F.struct("title", "description", "organization", "venue", "city"), {"ignoreNullFields": "false"}), 256)
    return e.groupBy(digest.alias("h")).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("n_groups"))


def content_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprint of every event's content (bytes are this engine's own; only equality matters)."""
    return views.events(spark, d).select("id", normalize.content_fingerprint().alias("fingerprint"))


QUERIES["content_fingerprints"] = content_fingerprints


@query("SELECT c_custkey, sha256(strlen(c_name) || ':' || c_name || strlen(c_mktsegment) || ':' || c_mktsegment || strlen(CAST(c_nationkey AS VARCHAR)) || ':' || c_nationkey) AS identity FROM customer")
def framed_identity(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer")
    return c.select("c_custkey", F.sha2(text.framed(F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string")), 256).alias("identity"))


_U = "sha256(catalog_file_name || chr(0) || physical_row || chr(0) || organization_name)"


@query(
    f"""WITH s AS (SELECT id, {_U} AS h FROM source_records WHERE organization_name IS NOT NULL) SELECT id, substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' ||
    substr('89ab', 1 + (CAST(('0x' || substr(h,17,1)) AS INTEGER) & 3), 1) || substr(h,18,3) || '-' || substr(h,21,12) AS stable_id FROM s"""
)
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "source_records").where("organization_name is not null")
    return s.select("id", text.source_id(F.col("catalog_file_name"), F.col("physical_row"), F.col("organization_name")).alias("stable_id"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g')) AS t FROM documents")
def whitespace(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", text.normalize_whitespace(F.col("text")).alias("t"))


@query(
    r"""WITH """ + EV + r""" SELECT id, regexp_replace(regexp_replace(lower(regexp_extract(public_source_url, '^https?://[^/?#]*')) || regexp_extract(public_source_url, '^https?://[^/?#]*([^#]*)', 1), '/+$', ''), '^(https?://[^/?#]+)$', '\1/') AS canonical FROM ev WHERE public_source_url IS NOT NULL"""
)
def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    return views.events(spark, d).where("public_source_url is not null").select("id", urls.canonical_url(F.col("public_source_url")).alias("canonical"))


@query(
    r"""SELECT id, CASE WHEN trim(coalesce(events_page, '')) = 'NKS' THEN 'known-absence' WHEN regexp_full_match(coalesce(events_page, ''), '[\s;]*') THEN 'unspecified' ELSE 'values' END AS kind FROM source_records"""
)
def url_field_kinds(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "source_records").select("id", urls.url_field(F.col("events_page"))["kind"].alias("kind"))


@query(
    f"""WITH {EV}, u AS (SELECT DISTINCT coalesce(online_location_url, public_source_url) AS url FROM ev WHERE coalesce(online_location_url, public_source_url) IS NOT NULL)
    SELECT url, CASE WHEN regexp_matches(url, '^https?://(localhost|[^/]*\\.local|[^/]*\\.internal|10\\.|127\\.|192\\.168\\.)') THEN 0 ELSE 1 END AS safe FROM u"""
)
def safe_urls(spark: SparkSession, d: str) -> DataFrame:
    u = views.events(spark, d).select(F.coalesce("online_location_url", "public_source_url").alias("url")).where("url is not null").distinct()
    return u.select("url", urls.is_safe_public_url(F.col("url")).cast("int").alias("safe"))


@query(
    """SELECT event_id, strftime(timezone(CASE WHEN user_id % 3 = 0 THEN 'America/New_York' WHEN user_id % 3 = 1 THEN 'Europe/London' ELSE 'Asia/Tokyo' END, timezone('UTC', ts)), '%Y-%m-%d %H:%M') AS local FROM events"""
)
def local_by_zone(spark: SparkSession, d: str) -> DataFrame:
    zone = F.when(F.col("user_id") % 3 == 0, "America/New_York").when(F.col("user_id") % 3 == 1, "Europe/London").otherwise("Asia/Tokyo")
    day, clock = temporal.local_parts(F.col("ts").cast("timestamp"), zone)
    return read_table(spark, d, "events").select("event_id", F.concat(day, F.lit(" "), F.substring(clock, 1, 5)).alias("local"))


@query(
    """SELECT o_orderkey, epoch_us(timezone('America/New_York', CAST(strftime(o_orderdate, '%Y-%m-%d') || ' 12:30:00' AS TIMESTAMP))) AS us FROM orders"""
)
def local_to_instant(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    t = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T12:30:00"))
    return o.select("o_orderkey", F.unix_micros(temporal.parse_instant(t, F.lit("America/New_York"))).alias("us"))


@query(
    f"""WITH {EV}, {OCC} SELECT id, title, array_to_string(categories, '; ') AS categories, CASE WHEN kind = 'date' THEN 'date-only' ELSE occurrences[1].source_timezone END AS timezones,
    CASE WHEN kind = 'date' THEN sd ELSE strftime(timezone('UTC', si), '%Y-%m-%dT%H:%M:%S') || 'Z' END AS starts FROM occ"""
)
def master_export(spark: SparkSession, d: str) -> DataFrame:
    from marquee.sources import state

    return state.master_rows(views.events(spark, d)).select("id", "title", "categories", "timezones", "starts")


def constraint_failures(spark: SparkSession, d: str) -> DataFrame:
    """Rows that break a row constraint."""
    return normalize.constraint_failures(views.events(spark, d))


QUERIES["constraint_failures"] = constraint_failures


@query("SELECT canonical_identity, count(DISTINCT id) AS n FROM event_records GROUP BY 1 HAVING count(DISTINCT id) > 1")
def duplicate_identities(spark: SparkSession, d: str) -> DataFrame:
    return normalize.duplicate_keys(views.events(spark, d), "canonical_identity")


@query("SELECT DISTINCT source_record_id FROM event_records e WHERE source_record_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM source_records s WHERE s.id = e.source_record_id)")
def orphan_sources(spark: SparkSession, d: str) -> DataFrame:
    return normalize.orphans(views.events(spark, d).select("source_record_id").where("source_record_id is not null").distinct(), read_table(spark, d, "source_records"), "source_record_id", "id")


@query(
    """SELECT date_trunc('hour', ts) AS w, event_type, count(*) AS n FROM events GROUP BY 1, 2"""
)
def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return ingestion.windowed_counts(e, "at", "event_type").select(F.col("window_start").cast("timestamp_ntz").alias("w"), "event_type", "n")
