"""Whole runs on small fixtures: pages to state, catalogs round trip, upserts, live streams."""

from pyspark.sql import functions as F

from marquee import schemas
from marquee.operators.merge import ingest
from marquee.plans import runs
from marquee.sources import catalog, state
from marquee.streaming import ingestion

NOW = "2026-11-26T12:00:00Z"
PAGES = [
    ("s1", "https://a.example/events/p", '<h1>Open House</h1><time datetime="2027-06-01">x</time>', False), ("s1", "https://a.example/events/q", '<h1>Open House</h1><time datetime="2027-06-01">x</time>', False),
    ("s1", "https://a.example/events/old", '<h1>Long Gone</h1><time datetime="2020-06-01">x</time>', False), ("s2", "https://b.example/events/r", None, True), ("s3", "https://c.example/", "<p>nothing</p>", False), ("s4", "https://d.example/", None, False),
]


def test_scrape_run(spark, tmp_path):
    fetched = spark.createDataFrame([(s, u, "text/html", b, "Org", x) for s, u, b, x in PAGES], "source_id string, url string, content_type string, body string, organization string, blocked boolean")
    sources = spark.createDataFrame([(s, "library", f"Org {s}") for s in ("s1", "s2", "s3", "s4")], "id string, source_category string, organization_name string")
    none = spark.createDataFrame([], schemas.EVENT)
    events, report, rejected = runs.scrape_run(fetched, sources, none, "list.example", "https://partner.example/", NOW)
    got = events.collect()
    assert [r.title for r in got] == ["Open House"] and {p.source_url for p in got[0].provenance} == {"https://a.example/events/p", "https://a.example/events/q"}
    assert {r.source_id: r.status for r in report.collect()} == {"s1": "completed", "s2": "blocked", "s3": "completed-no-events", "s4": "failed"} and rejected.count() == 0
    runs.publish(events, str(tmp_path / "state"), str(tmp_path / "export"))
    before = spark.read.parquet(str(tmp_path / "state"))
    assert before.count() == 1 and spark.read.text(str(tmp_path / "export")).count() == 1
    # what the partner published is told by the pages of its provenance
    page = F.array(F.struct(F.col("u").alias("source_url")))
    told = spark.createDataFrame([("https://partner.example/e/1",), ("https://a.example/e",), (None,)], "u string").select("u", runs.from_partner(F.when(F.col("u").isNotNull(), page), "https://partner.example/").alias("x"))
    assert {r.u: r.x for r in told.collect()} == {"https://partner.example/e/1": True, "https://a.example/e": False, None: False}


def test_catalogs_are_imported_whole_or_not_at_all(spark, tmp_path):
    files, target = tmp_path / "in", str(tmp_path / "out")
    files.mkdir()
    (files / "Lib.csv").write_text('Organization Name,Organization URL,Sitemap,Event Page\n"The ""Old"" Library",a.example; b.example,NKS,\n')
    names = {"Lib.csv": "library", "Gov.csv": "government"}
    assert runs.import_catalogs(spark, str(files), names, target).count() == 0
    first = spark.read.parquet(target)
    assert [r.organization_name for r in first.collect()] == ['The "Old" Library']
    (files / "Gov.csv").write_text("Organization Name,Organization URL,Sitemap,Event Page\n,c.example,,\n")
    assert [(e.file_name, e.code) for e in runs.import_catalogs(spark, str(files), names, target).collect()] == [("Gov.csv", "missing_required_field")] and spark.read.parquet(target).count() == 1
    records = catalog.scan_catalog(catalog.read_files(spark, str(files / "Lib.csv")), names)[0]
    catalog.write_canonical(records, str(tmp_path / "canonical"))
    written = catalog.read_files(spark, str(tmp_path / "canonical" / "part-*"))
    back, errors = catalog.scan_canonical(written, {"library": "Lib.csv"})
    assert errors.count() == 0 and [(r.organization_name, r.organization_urls["values"], r.sitemap_urls.kind, r.id) for r in back.collect()] == [(r.organization_name, r.organization_urls["values"], r.sitemap_urls.kind, r.id) for r in records.collect()]
    assert {r.id: r.fingerprint for r in runs.catalog_fingerprint(back).collect()} == {r.id: r.fingerprint for r in runs.catalog_fingerprint(records).collect()}
    bad = spark.createDataFrame([("x", "a,b\r\n"), ("y", ",".join(catalog.CANONICAL_HEADER) + "\r\nmoon,N,n.example,,\r\nlibrary,N\r\n")], "file_name string, body string")
    assert {(e.file_name, e.code) for e in catalog.scan_canonical(bad, {"library": "Lib.csv"})[1].collect()} == {("x", "missing_header"), ("y", "unknown_category"), ("y", "invalid_csv")}


def test_small_operators(spark):
    df = spark.createDataFrame([({"a": "", "b": "x"},), ({"a": ""},), (None,)], "address map<string,string>")
    assert [r.address for r in runs.clean_addresses(df).collect()] == [{"b": "x"}, None, None]
    assert runs.discovery_days(spark, "2026-12-31").count() == 367
    assert [r.category_id for r in runs.category_ids(spark.createDataFrame([("10, 2",), (None,), ("2;x",)], "categories string")).collect()] == ["2", "10"]
    o = spark.sql("select named_struct('kind', 'instant', 'start_date', cast(null as string), 'local_date', '2027-01-02', 'local_time', '19:30:00') as o, ' Hall ' as v, 'Lewes' as c")
    assert o.select(runs.occurrence_label(F.col("o"), F.col("v"), F.col("c")).alias("l")).first().l == "2027-01-02 19:30, Hall · Lewes"


def test_live_ingestion_equals_batch(spark, tmp_path):
    rows = [("i", 1, "a", ["k1"]), ("i", 2, "a", ["k1"]), ("i", 3, "b", ["k2"]), ("j", 4, "x", ["k1"]), ("i", 5, "b", ["k1", "k3"]), ("i", 6, "c", ["k3"])]
    cols = "identity string, seq long, content string, keys array<string>"
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, cols).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(cols).parquet(str(tmp_path / "in"))
        ingestion.start_ingestion(stream, str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {(r.identity, r.seq): (r.action, r.version) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.identity, r.seq): (r.action, r.version) for r in ingest(spark.createDataFrame(rows, cols)).collect()}


def test_live_rate_limit(spark, tmp_path):
    rows = [("c", i, f"2026-01-01 00:00:{s:02d}") for i, s in enumerate((0, 1, 2, 3, 59))] + [("d", 9, "2026-01-01 00:00:00")]
    spark.createDataFrame(rows, "client string, seq long, at string").selectExpr("client", "seq", "cast(at as timestamp) as at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("client string, seq long, at timestamp").parquet(str(tmp_path / "in"))
    ingestion.limited(stream, 2, 30).writeStream.format("memory").queryName("limited_requests").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    got = {(r.client, r.seq): r.accepted for r in spark.table("limited_requests").collect()}
    assert got == {("c", 0): True, ("c", 1): True, ("c", 2): False, ("c", 3): False, ("c", 4): True, ("d", 9): True}
