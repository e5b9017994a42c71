"""Queries of the page extractors on pages written from the stored tables, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.plans import runs
from marquee.session import read_table
from marquee.sources import catalog, pages

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TODAY = "2020-01-01"


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


def _orders(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.date_format(day, "yyyy-MM-dd").alias("day"), F.date_format(day, "MMMM d, yyyy").alias("spoken"), F.lit("text/html").alias("content_type"), F.lit("Org").alias("organization"))


def _listing(o: DataFrame) -> DataFrame:
    body = F.format_string('<div class="content"><h2>Order %d &amp; more</h2><i class="icon-calendar">%s at 7:30 p.m.</i><p class="intro">Presented by Desk %s.</p><h3>Venue</h3><div class="info"><a>Hall</a><br>%d Main St<br>Dover, DE 19901</div></div>', "o_orderkey", "spoken", "o_orderstatus", "o_orderkey")
    return o.select(F.format_string("https://list.example/event/%d/x", "o_orderkey").alias("url"), body.alias("body"), "content_type", "organization")


def _microdata(o: DataFrame) -> DataFrame:
    body = F.format_string('<h1 id="x_eventTitle">Order %d</h1><span itemprop="startDate">%sT19:30:00</span><div itemprop="location"><div itemprop="name">Hall %s</div></div><span itemprop="addressLocality">Lewes</span>', "o_orderkey", "day", "o_orderstatus")
    return o.select(F.format_string("https://town.example/calendar.aspx?EID=%d", "o_orderkey").alias("url"), body.alias("body"), "content_type", "organization")


def _plain(o: DataFrame) -> DataFrame:
    body = F.format_string('<title>t</title><h1>Order <b>%d</b></h1><time datetime="%s">x</time>', "o_orderkey", "day")
    return o.select(F.format_string("https://page.example/events/%d", "o_orderkey").alias("url"), body.alias("body"), "content_type", "organization")


_DAY = "strftime(o_orderdate, '%Y-%m-%d')"


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS supplied_id, 'Order ' || o_orderkey || ' & more' AS title, {_DAY} || 'T19:30:00' AS start, 'Desk ' || o_orderstatus AS organization, o_orderkey || ' Main St' AS street, 'Dover' AS city, 'Central Delaware' AS region FROM orders")
def listing_pages(spark: SparkSession, d: str) -> DataFrame:
    found = pages.extract_listing(_listing(_orders(spark, d)), "list.example", TODAY)
    return found.select("supplied_id", "title", F.col("occurrences")[0]["start"].alias("start"), "organization", F.col("address")["street"].alias("street"), "city", "region")


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS supplied_id, 'Order ' || o_orderkey AS title, {_DAY} || 'T19:30:00' AS start, 'Hall ' || o_orderstatus AS venue, 'Southern Delaware' AS region FROM orders")
def microdata_pages(spark: SparkSession, d: str) -> DataFrame:
    found = pages.extract_microdata(_microdata(_orders(spark, d)))
    return found.select("supplied_id", "title", F.col("occurrences")[0]["start"].alias("start"), "venue", "region")


@query(f"SELECT 'https://page.example/events/' || o_orderkey AS supplied_id, 'Order ' || o_orderkey AS title, {_DAY} AS start FROM orders")
def plain_pages(spark: SparkSession, d: str) -> DataFrame:
    found = pages.extract_fallback(_plain(_orders(spark, d)))
    return found.select("supplied_id", "title", F.col("occurrences")[0]["start"].alias("start"))


@query(
    f"""SELECT CASE o_orderkey % 3 WHEN 0 THEN 'https://list.example/event/' || o_orderkey || '/x' WHEN 1 THEN 'https://town.example/calendar.aspx?EID=' || o_orderkey ELSE 'https://page.example/events/' || o_orderkey END AS url,
    'Order ' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN ' & more' ELSE '' END AS title, {_DAY} || CASE WHEN o_orderkey % 3 = 2 THEN '' ELSE 'T19:30:00' END AS start FROM orders"""
)
def page_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Pages of three kinds at once: each is read by the extractor that understands it, the fallback by none else."""
    o = _orders(spark, d)
    mixed = _listing(o.where("o_orderkey % 3 = 0")).unionByName(_microdata(o.where("o_orderkey % 3 = 1"))).unionByName(_plain(o.where("o_orderkey % 3 = 2")))
    return pages.extract_all(mixed, "list.example", TODAY).select(F.col("source_url").alias("url"), "title", F.col("occurrences")[0]["start"].alias("start"))


@query("SELECT 'https://site.example/events/' || s_suppkey AS url, CAST(floor(log2(s_suppkey)) AS INTEGER) AS round FROM supplier WHERE s_suppkey > 0")
def crawl_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Breadth-first order over pages that link to two others each, however deep."""
    s = read_table(spark, d, "supplier").select("s_suppkey")
    body = F.format_string('<a href="/events/%d">event</a> <a href="/events/%d">event</a>', F.col("s_suppkey") * 2, F.col("s_suppkey") * 2 + 1)
    site = s.select(F.format_string("https://site.example/events/%d", "s_suppkey").alias("url"), F.lit("text/html").alias("content_type"), body.alias("body"), F.lit("Org").alias("organization"))
    entry = spark.createDataFrame([("s", "https://site.example/events/1")], "source_id string, url string")
    return pages.crawl(site, entry, 1_000_000).select("url", "round")


@query("SELECT n_nationkey, 'https://n' || n_nationkey || '.example/' AS url FROM nation ORDER BY 1")
def canonical_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Catalog records written as a canonical catalog and read again."""
    n = read_table(spark, d, "nation")
    line = F.format_string('library,"Nation ""%d""",https://n%d.example,NKS,', "n_nationkey", "n_nationkey")
    lines = n.orderBy("n_nationkey").agg(F.array_join(F.array_sort(F.collect_list(line)), "\r\n").alias("b"))
    files = lines.select(F.lit("canonical.csv").alias("file_name"), F.concat(F.lit(",".join(catalog.CANONICAL_HEADER) + "\r\n"), "b", F.lit("\r\n")).alias("body"))
    records = catalog.scan_canonical(files, {"library": "Library.csv"})[0]
    return records.select(F.regexp_extract("organization_name", r"(\d+)", 1).cast("int").alias("n_nationkey"), F.col("organization_urls")["values"][0].alias("url"))


@query("SELECT DISTINCT id FROM (SELECT id, unnest(map_values(address)) AS v FROM event_records WHERE address IS NOT NULL) WHERE length(v) > 0")
def addresses_on_read(spark: SparkSession, d: str) -> DataFrame:
    return runs.clean_addresses(read_table(spark, d, "event_records").select("id", "address")).where("address is not null").select("id").distinct()


@query("SELECT DISTINCT CAST(x AS BIGINT) AS category_id FROM (SELECT unnest(regexp_extract_all(categories, '[0-9]+')) AS x FROM scene_inputs)")
def packed_category_ids(spark: SparkSession, d: str) -> DataFrame:
    return runs.category_ids(read_table(spark, d, "scene_inputs")).select(F.col("category_id").cast("long").alias("category_id")).distinct()


@query("SELECT strftime(DATE '2026-08-18' + CAST(i AS INTEGER), '%Y-%m-%d') AS day FROM range(0, 367) t(i)")
def discovery_calendar(spark: SparkSession, d: str) -> DataFrame:
    return runs.discovery_days(spark, "2026-08-18").select(F.col("day").cast("string").alias("day"))
