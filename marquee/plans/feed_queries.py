"""Queries of catalogs, pages, the partner feed and the state machines, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import temporal, text, urls
from marquee.operators import jobs as jobs_ops
from marquee.operators.row_loading import PARTNER, load_rows, typed_records
from marquee.plans import views
from marquee.plans.read_queries import EV, OCC
from marquee.plans.views import OPENED_AT
from marquee.session import read_table
from marquee.sources import catalog, pages, partner

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
AGENT = "marqueebot"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# ---- catalogs ---------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN o IS NULL THEN 'enabled' ELSE o END AS state FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderstatus) AS o FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def preserve_state(spark: SparkSession, d: str) -> DataFrame:
    incoming = read_table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("enabled").alias("collection_state"))
    previous = read_table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderstatus").alias("collection_state"))
    return catalog.preserve_state(incoming, previous).select(F.col("id").alias("c_custkey"), F.col("collection_state").alias("state"))


@query("SELECT id, source_category, collection_state FROM source_records WHERE source_category <> 'government' UNION ALL SELECT 'new-' || id, source_category, 'enabled' FROM source_records WHERE source_category = 'government'")
def replace_category(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "source_records").select("id", "source_category", "collection_state")
    incoming = s.where("source_category = 'government'").withColumn("id", F.concat(F.lit("new-"), "id"))
    return catalog.replace_category(s, incoming.select("id", "source_category"), "government").select("id", "source_category", "collection_state")


@query(
    """WITH l AS (SELECT user_id, event_type || '-' || (CAST(floor(value) AS BIGINT) % 200) AS u, min(event_id) AS first_at FROM events GROUP BY 1, 2)
    SELECT user_id, least(count(*), 100) AS n_urls, greatest(count(*) - 100, 0) AS omitted, arg_min(u, first_at) AS first_url FROM l GROUP BY 1"""
)
def discovery_cap(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").select("user_id", "event_id", F.concat("event_type", F.lit("-"), F.floor("value").cast("long") % 200).alias("u"))
    arr = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "u"))), lambda x: x["u"]).alias("urls"))
    s = arr.select("user_id", catalog.select_discovery(F.col("urls"), F.lit(True)).alias("s"))
    return s.select("user_id", F.size("s.urls").cast("long").alias("n_urls"), F.col("s.omitted").cast("long").alias("omitted"), F.get("s.urls", F.lit(0)).alias("first_url"))


@query(
    f"""WITH {EV} SELECT id, CASE (CASE WHEN online_location_url IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN ticket_url IS NOT NULL THEN 1 ELSE 0 END) WHEN 0 THEN 'unsupported' WHEN 1 THEN 'selected' ELSE 'conflict' END AS status,
    concat_ws(',', CASE WHEN online_location_url IS NOT NULL THEN 'online' END, CASE WHEN ticket_url IS NOT NULL THEN 'ticketed' END) AS keys FROM ev"""
)
def adapter_resolution(spark: SparkSession, d: str) -> DataFrame:
    reg = catalog.AdapterRegistry([("online", lambda df: df["online_location_url"].isNotNull()), ("ticketed", lambda df: df["ticket_url"].isNotNull())])
    out = reg.resolve(views.events(spark, d))
    return out.select("id", F.col("adapter_status").alias("status"), F.array_join("adapter_keys", ",").alias("keys"))


def catalog_records(spark: SparkSession, d: str) -> DataFrame:
    """The catalog part of csv_rows put together as files and scanned strictly, file by file."""
    rows = read_table(spark, d, "csv_rows").where(F.col("file_name").startswith("catalog_"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("physical_row", "raw_text"))), lambda x: x["raw_text"]), "\n")
    files = rows.groupBy("file_name").agg(body.alias("body")).withColumn("valid_utf8", F.lit(True))
    names = {r[0]: "non-grantee" for r in files.select("file_name").collect()}
    records, errors = catalog.scan_catalog(files, names)
    good = records.groupBy("catalog_file_name").agg(F.count("*").alias("n_records"))
    bad = errors.groupBy(F.col("file_name").alias("catalog_file_name")).agg(F.count("*").alias("n_errors"))
    return good.join(bad, "catalog_file_name", "full")


QUERIES["catalog_records"] = catalog_records


# ---- pages ------------------------------------------------------------------------------------------------------


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """A page of JSON-LD per event, made from its own fields."""
    e = views.events(spark, d)
    o = F.get("occurrences", F.lit(0))
    start = F.when(o["kind"] == "date", o["start_date"]).otherwise(temporal.iso_instant(o["start_at"]))
    node = F.to_json(F.struct(F.lit("Event").alias("@type"), F.col("title").alias("name"), start.alias("startDate"), F.struct(F.lit("Place").alias("@type"), F.col("venue").alias("name"), F.struct(F.col("city").alias("addressLocality")).alias("address")).alias("location")))
    escaped = F.replace(node, F.lit("&"), F.lit("&amp;"))
    links = F.concat(F.lit('<a href="/events/'), "id", F.lit('">more</a> <a href="/about">about</a> <a href="'), F.coalesce("ticket_url", F.lit("/pic.png")), F.lit('">tickets</a>'))
    body = F.concat(F.lit("<html><title>"), F.coalesce("title", F.lit("")), F.lit("</title>"), links, F.lit('<script type="application/ld+json">{"@graph": ['), escaped, F.lit("]}</script></html>"))
    return e.select(F.concat("public_source_url", F.lit("?e="), "id").alias("url"), F.lit("text/html").alias("content_type"), body.alias("body"), F.coalesce("organization", F.lit("Unknown")).alias("organization"), "id").where("url is not null")


@query(
    f"""WITH {EV}, {OCC} SELECT public_source_url || '?e=' || id AS source_url, trim(regexp_replace(replace(title, chr(160), ' '), '\\s+', ' ', 'g')) AS title, city_clean AS city,
    CASE WHEN kind = 'date' THEN sd ELSE strftime(timezone('UTC', si), '%Y-%m-%dT%H:%M:%S') || 'Z' END AS start FROM (SELECT *, nullif(trim(regexp_replace(replace(city, chr(160), ' '), '\\s+', ' ', 'g')), '') AS city_clean FROM occ)
    WHERE public_source_url IS NOT NULL AND coalesce(trim(title), '') <> ''"""
)
def extract_jsonld(spark: SparkSession, d: str) -> DataFrame:
    x = pages.extract_schema(_pages(spark, d))
    return x.select("source_url", "title", "city", F.get("occurrences", F.lit(0))["start"].alias("start"))


@query(
    f"""WITH {EV} SELECT public_source_url || '?e=' || id AS page_url, regexp_extract(public_source_url, '^https?://[^/]+') || '/events/' || id AS link, 0 AS priority FROM ev WHERE public_source_url IS NOT NULL
    UNION ALL SELECT public_source_url || '?e=' || id, ticket_url, 0 FROM ev WHERE public_source_url IS NOT NULL AND regexp_extract(ticket_url, '^https?://[^/]+') = regexp_extract(public_source_url, '^https?://[^/]+') AND regexp_matches(regexp_extract(ticket_url, '^https?://[^/]+([^?#]*)', 1), 'event|ticket|show')"""
)
def extract_links(spark: SparkSession, d: str) -> DataFrame:
    return pages.links(_pages(spark, d)).select("page_url", "link", "priority")


@query(f"WITH {EV} SELECT DISTINCT public_source_url AS location FROM ev WHERE public_source_url IS NOT NULL")
def sitemap_locations(spark: SparkSession, d: str) -> DataFrame:
    e = views.events(spark, d).where("public_source_url is not null").select("public_source_url", F.pmod(F.xxhash64("public_source_url"), F.lit(64)).alias("part")).distinct()
    maps = e.groupBy("part").agg(F.concat(F.lit("<urlset>"), F.array_join(F.transform(F.collect_list("public_source_url"), lambda u: F.concat(F.lit("<url><loc> "), u, F.lit(" </loc></url>"))), ""), F.lit("</urlset>")).alias("body"))
    return pages.sitemap_locations(maps.withColumn("url", F.concat(F.lit("https://maps.example/sitemap-"), "part", F.lit(".xml")))).select("location")


@query(
    f"""WITH {EV}, u AS (SELECT DISTINCT public_source_url AS url FROM ev WHERE public_source_url IS NOT NULL), p AS (SELECT url, regexp_extract(url, '^https?://[^/]+(/.*)?$', 1) AS path FROM u)
    SELECT url, CASE WHEN starts_with(path, '/e/1') AND NOT starts_with(path, '/e/11') THEN 0 ELSE 1 END AS allowed FROM p"""
)
def robots_decisions(spark: SparkSession, d: str) -> DataFrame:
    u = views.events(spark, d).select(F.col("public_source_url").alias("url")).where("url is not null").distinct()
    body = f"User-agent: other\nDisallow: /\n\nUser-agent: {AGENT} # us\nDisallow: /e/1\nAllow: /e/11\nDisallow:\n"
    robots = u.select(urls.origin(F.col("url")).alias("origin")).distinct().withColumn("body", F.lit(body))
    return pages.allowed(u, pages.robots_rules(robots, AGENT)).select("url", F.col("allowed").cast("int").alias("allowed"))


def extract_calendars(spark: SparkSession, d: str) -> DataFrame:
    """Every event written as an ICS block and read back."""
    e = views.events(spark, d).withColumn("o", F.get("occurrences", F.lit(0)))
    stamp = F.when(F.col("o.kind") == "date", F.regexp_replace("o.start_date", "-", "")).otherwise(F.date_format("o.start_at", "yyyyMMdd'T'HHmmss'Z'"))
    title = F.replace(F.coalesce("title", F.lit("")), F.lit(","), F.lit("\\,"))
    body = F.concat(F.lit("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:"), "id", F.lit("\r\nSUMMARY:"), title, F.lit("\r\nDTSTART:"), stamp, F.lit("\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"))
    cal = e.select(F.concat(F.lit("https://cal.example/"), "id", F.lit(".ics")).alias("url"), body.alias("body"), F.lit("Org").alias("organization"))
    return pages.extract_ics(cal).select("supplied_id", "title", F.get("occurrences", F.lit(0))["start"].alias("start"))


QUERIES["extract_calendars"] = extract_calendars


@query("SELECT status, count(*) AS n FROM (SELECT o_custkey, CASE WHEN sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) > 3 THEN 'completed' WHEN sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) > 0 THEN 'completed-no-events' WHEN sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) = count(*) THEN 'blocked' ELSE 'failed' END AS status FROM orders GROUP BY 1) GROUP BY 1")
def scrape_report(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    flag = lambda s: (F.col("o_orderstatus") == s).cast("int")
    sums = o.groupBy(F.col("o_custkey").alias("source_id")).agg((F.sum(flag("F")) > 3).cast("int").alias("accepted"), F.sum(flag("O")).alias("fetched"), F.sum(flag("P")).alias("p"), F.count("*").alias("k"))
    attempts = sums.select("source_id", "accepted", "fetched", (F.col("p") == F.col("k")).cast("int").alias("blocked"))
    return pages.source_report(attempts).groupBy("status").agg(F.count("*").alias("n"))


@query(r"""SELECT DISTINCT city, CASE WHEN regexp_matches(lower(city), 'wilmington|newark|new castle|middletown|claymont|hockessin|arden') THEN 'Northern Delaware' WHEN regexp_matches(lower(city), 'dover|milford|smyrna|clayton|harrington|felton') THEN 'Central Delaware' WHEN regexp_matches(lower(city), 'rehoboth|lewes|georgetown|seaford|bethany|fenwick|milton|delmar|laurel') THEN 'Southern Delaware' END AS region FROM event_records WHERE city IS NOT NULL""")
def regions(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "event_records").select("city").where("city is not null").distinct().select("city", text.region_for_city(F.col("city")).alias("region"))


# ---- partner feed -----------------------------------------------------------------------------------------------


def continuation_rows(spark: SparkSession, d: str) -> DataFrame:
    """Partner records of csv_rows with the row of the event that each belongs to."""
    loaded = load_rows(read_table(spark, d, "csv_rows"))
    rows = typed_records(loaded, PARTNER, "partner_").withColumnRenamed("title_of_program", "title")
    return partner.attach_continuations(rows)[0].select("file_name", "physical_row", "event_row")


QUERIES["continuation_rows"] = continuation_rows

_LO = "CASE WHEN try_cast(nullif(trim(regexp_replace(low_price, '[$,]', '', 'g')), '') AS DOUBLE) >= 0 THEN try_cast(trim(regexp_replace(low_price, '[$,]', '', 'g')) AS DOUBLE) END"
_HI = _LO.replace("low_price", "high_price")
_FMT = "CASE WHEN {0} = floor({0}) THEN '$' || CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE printf('$%.2f', {0}) END"


@query(
    f"""WITH p AS (SELECT DISTINCT input_id, {_LO} AS lo, {_HI} AS hi FROM scene_inputs) SELECT input_id, CASE WHEN lo IS NULL AND hi IS NULL THEN NULL WHEN coalesce(lo, hi) = 0 AND coalesce(hi, lo) = 0 THEN 'Free'
    WHEN hi IS NULL THEN 'From ' || {_FMT.format('lo')} WHEN lo IS NULL THEN 'Up to ' || {_FMT.format('hi')} WHEN lo = hi THEN {_FMT.format('lo')} ELSE {_FMT.format('lo')} || '–' || {_FMT.format('hi')} END AS cost FROM p"""
)
def cost_texts(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "scene_inputs").select("input_id", "low_price", "high_price").distinct()
    lo, hi = text.parse_price(F.col("low_price")), text.parse_price(F.col("high_price"))
    return s.select("input_id", lo.alias("lo"), hi.alias("hi")).select("input_id", text.cost_text(F.col("lo"), F.col("hi")).alias("cost")).distinct()


@query(
    """WITH s AS (SELECT DISTINCT occ_key, start_date, start_time FROM scene_occurrences) SELECT occ_key, CASE WHEN regexp_full_match(start_date, '\\d{2}/\\d{2}/\\d{4}') THEN strftime(try_strptime(start_date, '%m/%d/%Y'), '%Y-%m-%d') END AS day,
    CASE WHEN regexp_full_match(start_time, '(?i)(0?[1-9]|1[0-2]):[0-5]\\d\\s*[ap]\\.?m\\.?') THEN printf('%02d:%s:00', CAST(regexp_extract(start_time, '^(\\d+)', 1) AS INTEGER) % 12 + CASE WHEN regexp_matches(start_time, '(?i)p\\.?m') THEN 12 ELSE 0 END, regexp_extract(start_time, ':(\\d\\d)', 1)) END AS clock FROM s"""
)
def typed_dates(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "scene_occurrences").select("occ_key", "start_date", "start_time").distinct()
    return s.select("occ_key", temporal.us_date(F.col("start_date")).cast("string").alias("day"), temporal.clock12(F.col("start_time")).alias("clock"))


@query(
    """WITH s AS (SELECT DISTINCT input_id, categories FROM scene_inputs WHERE categories IS NOT NULL), x AS (SELECT input_id, regexp_replace(unnest(string_split(categories, ',')), '^\\s+|\\s+$', '', 'g') AS c, generate_subscripts(string_split(categories, ','), 1) AS i FROM s),
    n AS (SELECT x.input_id, coalesce(k.category_name, 'Category ' || c) AS name, min(i) AS i FROM x LEFT JOIN category_items k ON k.category_id = c WHERE c <> '' GROUP BY 1, 2) SELECT s.input_id, coalesce(string_agg(name, '|' ORDER BY i), '') AS names FROM s LEFT JOIN n ON n.input_id = s.input_id GROUP BY s.input_id"""
)
def category_labels(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "scene_inputs").select("input_id", "categories").where("categories is not null").distinct()
    names = read_table(spark, d, "category_items").select("category_id", "category_name")
    return s.select("input_id", F.array_join(partner.category_names(F.col("categories"), names), "|").alias("names"))


_HOST = r"regexp_extract({0}, '^(?:https?://)?([^/?#]+)', 1)"


@query(
    rf"""WITH s AS (SELECT DISTINCT id, CASE WHEN regexp_matches(u, '^https?://') THEN regexp_replace(u, '^https?://', 'https://') ELSE 'https://' || u END AS u FROM (SELECT id, trim(unnest(string_split(organization_url, ';'))) AS u FROM source_records) WHERE NOT regexp_matches(trim(u), '\s') AND trim(u) <> ''),
    t AS (SELECT id, regexp_extract(trim(u), '^https://([^/?#]+)', 1) AS h, regexp_replace(regexp_extract(trim(u), '^https://[^/?#]+([^?#]*)', 1), '/+$', '') AS cp FROM s),
    f AS (SELECT DISTINCT input_id, x AS u FROM (SELECT input_id, unnest([url, ticket_url]) AS x FROM scene_inputs) WHERE regexp_matches(x, '^https?://')), m AS (SELECT input_id, regexp_extract(u, '^https?://([^/?#]+)', 1) AS h, regexp_extract(u, '^https?://[^/?#]+([^?#]*)', 1) AS p FROM f),
    b AS (SELECT input_id, id, max(1000 + CASE WHEN length(cp) > 1 AND starts_with(p, cp) THEN length(cp) ELSE 0 END) AS score FROM m JOIN t USING (h) GROUP BY 1, 2), r AS (SELECT input_id, id, row_number() OVER (PARTITION BY input_id ORDER BY score DESC, id) AS rn FROM b)
    SELECT i.input_id, coalesce(r.id, 'fallback') AS source_id FROM (SELECT DISTINCT input_id FROM scene_inputs) i LEFT JOIN r ON r.input_id = i.input_id AND rn = 1"""
)
def source_match(spark: SparkSession, d: str) -> DataFrame:
    feed = read_table(spark, d, "scene_inputs").select("input_id", "url", "ticket_url").distinct()
    u = F.filter(F.transform(F.split("organization_url", ";"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"\s"))
    sources = read_table(spark, d, "source_records").select("id", F.transform(u, lambda x: F.when(x.rlike("^https?://"), x).otherwise(F.concat(F.lit("https://"), x))).alias("urls"))
    return partner.match_source(feed, sources, "fallback").select("input_id", "source_id").distinct()


@query(
    """WITH f AS (SELECT DISTINCT input_id, url, ticket_url FROM scene_inputs), u AS (SELECT input_id, unnest([url, ticket_url]) AS x FROM f)
    SELECT regexp_replace(x, '/+$', '') AS u, count(*) AS n FROM u WHERE regexp_matches(x, '^https?://[^/]+/.') GROUP BY 1"""
)
def url_counts(spark: SparkSession, d: str) -> DataFrame:
    f = read_table(spark, d, "scene_inputs").select("input_id", "url", "ticket_url").distinct()
    return partner.url_counts(f)


def skip_existing(spark: SparkSession, d: str) -> DataFrame:
    """Feed events that match an existing event by title and day, or by a URL of their own."""
    f, e = views.feed(spark, d), views.events(spark, d)
    return partner.split_existing(f, e, f)[1].select("input_id")


def venue_hints(spark: SparkSession, d: str) -> DataFrame:
    return partner.venue_hints(views.feed(spark, d), views.events(spark, d))


def import_report(spark: SparkSession, d: str) -> DataFrame:
    f, e = views.feed(spark, d), views.events(spark, d)
    new, skipped = partner.split_existing(f, e, f)
    return partner.report(f, skipped, new.where(~F.col("title").rlike(partner.CANCELLED)))


QUERIES |= {"skip_existing": skip_existing, "venue_hints": venue_hints, "import_report": import_report}


# ---- state machines ---------------------------------------------------------------------------------------------


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    at = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id").cast("string").alias("id"), F.lit("scan").alias("job_type"), F.lit("{}").alias("payload"), F.when(F.col("event_id") % 3 == 0, "running").otherwise("queued").alias("state"), at.alias("available_at"), at.alias("created_at"),
        F.when(F.col("event_id") % 3 == 0, "w1").alias("lease_owner"), F.when(F.col("event_id") % 3 == 0, at).alias("lease_expires_at"), (F.col("event_id") % 4).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"), F.col("event_id").cast("string").alias("idempotency_key"),
    )


@query(
    """SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 3 = 0 AND ts <= TIMESTAMP '2024-01-15' THEN CASE WHEN event_id % 4 >= 3 THEN 'failed' ELSE 'queued' END WHEN event_id % 3 = 0 THEN 'running' ELSE 'queued' END AS state,
    CASE WHEN event_id % 3 = 0 AND ts > TIMESTAMP '2024-01-15' THEN 'w1' END AS lease_owner FROM events"""
)
def job_recovery(spark: SparkSession, d: str) -> DataFrame:
    return jobs_ops.recover_leases(_jobs(spark, d), "2024-01-15T00:00:00Z").select("id", "state", "lease_owner")


@query("SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE event_id % 3 <> 0 AND event_id % 4 < 3 AND ts <= TIMESTAMP '2024-01-15' ORDER BY ts, event_id LIMIT 1")
def job_claim(spark: SparkSession, d: str) -> DataFrame:
    return jobs_ops.claim(_jobs(spark, d), "w9", "2024-01-15T00:00:00Z", 60).where("lease_owner = 'w9'").select("id")


@query(
    f"""WITH {EV}, c AS (SELECT id, record_version, publication_status, CASE WHEN publication_status = 'pending' THEN 'rejected' ELSE 'archived' END AS target, CASE WHEN city IS NULL THEN 0 ELSE 1 END AS shift, coalesce(organization, '') AS reason FROM ev)
    SELECT id AS event_id, CASE WHEN publication_status || '>' || target NOT IN ('pending>published', 'pending>rejected', 'published>archived') THEN 'invalid_transition' WHEN shift = 0 THEN 'version_conflict' WHEN target = 'rejected' AND length(trim(reason)) = 0 THEN 'reason_required' ELSE 'applied' END AS outcome FROM c"""
)
def transitions(spark: SparkSession, d: str) -> DataFrame:
    e = views.events(spark, d)
    c = e.select(F.col("id").alias("event_id"), F.when(F.col("publication_status") == "pending", "rejected").otherwise("archived").alias("target"), (F.col("record_version") + F.when(F.col("city").isNull(), 1).otherwise(0)).alias("expected_version"), F.coalesce("organization", F.lit("")).alias("reason"), F.lit("m").alias("actor"))
    return jobs_ops.transition(e, c)[1].select("event_id", "outcome")


@query(
    """WITH d AS (SELECT l_orderkey AS id, count(*) AS c FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), r AS (SELECT o_orderkey AS id FROM orders)
    SELECT id, 'not_exactly_one_completed' AS code FROM r LEFT JOIN d USING (id) WHERE coalesce(c, 0) <> 1"""
)
def ledger_errors(spark: SparkSession, d: str) -> DataFrame:
    req = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    rec = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("requirement_id"), F.when(F.col("l_returnflag") == "R", "completed").otherwise("open").alias("status"))
    return jobs_ops.ledger_errors(req, rec)


@query(
    """WITH a AS (SELECT o_orderkey, o_orderstatus FROM orders), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 1000 = 3 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders)
    SELECT 'reordered' AS which, (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM (SELECT * FROM a ORDER BY o_orderkey DESC))) = 0 AS equal
    UNION ALL SELECT 'changed', (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) = 0"""
)
def same_outcomes(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    changed = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 1000 == 3, "X").otherwise(F.col("o_orderstatus")))
    reordered = jobs_ops.same_outcomes(o, o.orderBy(F.col("o_orderkey").desc()))
    return reordered.select(F.lit("reordered").alias("which"), "equal").unionByName(jobs_ops.same_outcomes(o, changed).select(F.lit("changed").alias("which"), "equal"))


def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """Requests accepted under 3 per 6 hours and client; each decision depends on those before it, so there is no SQL."""
    e = read_table(spark, d, "events").select(F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"))
    return jobs_ops.sliding_window(e, 3, 21_600).select("client", "seq", "accepted")


QUERIES["rate_limit"] = rate_limit
