"""Catalogs, pages, partner feed and streams on small fixtures."""

from pyspark.sql import functions as F

from marquee.functions import schedules
from marquee.operators.merge import ingest
from marquee.sources import catalog, pages, partner
from marquee.streaming import ingestion

LD = '<script type="application/ld+json">{"@graph":[{"@type":"Event","name":"Jazz &amp; Blues","startDate":"2027-05-01T19:00:00","location":{"name":"Hall","address":{"addressLocality":"Dover"}},"offers":[{"price":"0"}]},{"@type":"Event","name":"Gone","startDate":"2027-05-01","eventStatus":"https://schema.org/EventCancelled"}]}</script>'
ICS = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:u1\r\nSUMMARY:Art\\, Night\r\nDTSTART;TZID=America/Chicago:20270501T190000\r\nLOCATION:Main\r\n  Hall\r\nEND:VEVENT\r\nEND:VCALENDAR"
HTML = '<h1>Open House</h1><time datetime="2027-06-01">x</time><a href="/events/1">a</a><a href="/x.png">b</a><a href="https://other.example/events/2">c</a><a href="/cal.ics">e</a>'


def frame(spark):
    rows = [("https://a.example/e", "text/html", LD, "Org"), ("https://a.example/c.ics", "text/calendar", ICS, "Org"), ("https://a.example/events/p", "text/html", HTML, "Org"), ("https://a.example/sitemap.xml", "application/xml", "<urlset><loc> https://a.example/1 </loc></urlset>", "Org")]
    return spark.createDataFrame(rows, "url string, content_type string, body string, organization string")


def test_extraction_cascade(spark):
    got = {r.title: r for r in pages.extract_all(frame(spark), "list.example", "2026-11-26").collect()}
    assert set(got) == {"Jazz & Blues", "Art, Night", "Open House"}
    assert got["Jazz & Blues"].cost == "Free" and got["Jazz & Blues"].region == "Central Delaware" and got["Art, Night"].venue == "Main Hall" and got["Art, Night"].occurrences[0].zone == "America/Chicago"
    assert [(r.link, r.priority) for r in pages.links(frame(spark)).orderBy("rank").collect()] == [("https://a.example/cal.ics", 0), ("https://a.example/events/1", 0)]


PAGE = """<h2>Elsewhere</h2><div class="main content"><h2>Harbor &amp; Songs</h2><i class="icon-calendar x">Saturday, May 1, 2027 at 7:30 p.m.</i><span class="icon-price">$5</span>
<p class="intro">Presented by The Choir.</p><p class="intro">Songs of the sea.</p><p class="intro lead">Bring a chair.</p><p class="tags"><a href="/t">Music</a> <a href="/r">Southern Delaware</a></p>
<h3>Venue</h3> <div class="info"><a href="/v">Town Hall</a><br>1 Main St<br/>Floor 2<br>Lewes, DE 19958</div><a href="/buy?a=1&amp;b=2">Get Tickets</a><a id="moar"></a><h2>After</h2></div>"""


def test_listing_pages(spark):
    rows = [("https://list.example/event/17/harbor", PAGE, "Org"), ("https://list.example/event/18/x", PAGE.replace("Saturday, May 1, 2027 at 7:30 p.m.", "soon"), "Org"), ("https://other.example/event/17/x", PAGE, "Org"), ("https://list.example/event/19/bare", '<h2>Bare</h2><i class="icon-calendar">May 2, 2027</i>', "Org")]
    got = {r.supplied_id: r for r in pages.extract_listing(spark.createDataFrame(rows, "url string, body string, organization string"), "list.example", "2026-11-26").collect()}
    r = got["17"]
    assert set(got) == {"17", "19"} and (r.title, r.cost, r.organization, r.description) == ("Harbor & Songs", "$5", "The Choir", "Songs of the sea.\n\nBring a chair.")
    assert (r.venue, r.city, r.region, r.categories, r.ticket_url) == ("Town Hall", "Lewes", "Southern Delaware", ["Music"], "https://list.example/buy?a=1&b=2")
    assert r.address == {"street": "1 Main St, Floor 2", "city": "Lewes", "state": "DE", "postalCode": "19958"} and tuple(r.occurrences[0]) == ("2027-05-01T19:30:00", None, "America/New_York")
    assert got["19"].address is None and got["19"].venue is None and got["19"].organization == "Org" and got["19"].occurrences[0].start == "2027-05-02"


SCHEDULES = {
    "May 1, 2027 at 7:30 p.m.": ("2027-05-01T19:30:00", None), "November 5 through December 2": ("2026-11-05", "2026-12-02"), "December 20 - January 3": ("2026-12-20", "2027-01-03"), "Now through March 3": ("2026-08-18", "2027-03-03"),
    "May 1 – 5, 2027": ("2027-05-01", "2027-05-05"), "May 1 at 12 midnight": ("2027-05-01T00:00:00", None), "05/12": ("2027-05-12", None), "May 1 - 9 pm": ("2027-05-01", None), "August 17": ("2027-08-17", None), "August 18": ("2026-08-18", None),
    "June 31": None, "May 1 at 13 pm": None, "hello": None, "": None, None: None, "12": None, "now through June 31": None,
}


def test_schedules(spark):
    df = spark.createDataFrame([(t,) for t in SCHEDULES], "t string")
    got = {r.t: r.s and (r.s.start, r.s.end) for r in df.select("t", schedules.schedule(F.col("t"), F.lit("2026-08-18")).alias("s")).collect()}
    assert got == SCHEDULES


def test_robots(spark):
    rules = pages.robots_rules(spark.createDataFrame([("https://a.example", "User-agent: *\nDisallow: /e\nAllow: /events # ok\nUser-agent: x\nDisallow: /")], "origin string, body string"), "bot")
    got = {r.url: r.allowed for r in pages.allowed(frame(spark).select("url"), rules).collect()}
    assert got == {"https://a.example/e": False, "https://a.example/c.ics": True, "https://a.example/events/p": True, "https://a.example/sitemap.xml": True}


def test_catalog_files(spark, tmp_path):
    (tmp_path / "Gov.csv").write_text('Organization Name,Organization URL,Site Map,Events\r\n"Del ""M""\r\nC"," example.org ; https://second.example.com/path ",NKS," ; http://e.net/list ; "\r\n,,,\r\n', newline="")
    (tmp_path / "Bad.csv").write_text("Organization Name,Organization URL,Sitemap,Event Page\nOk,a.example,,\n,ftp://x,,\n")
    (tmp_path / "Odd.csv").write_text("x")
    (tmp_path / "Enc.csv").write_bytes(b"Organization Name\xff")
    records, errors = catalog.scan_catalog(catalog.read_files(spark, str(tmp_path)), {"Gov.csv": "government", "Bad.csv": "library", "Enc.csv": "library"})
    r = records.collect()
    assert len(r) == 1 and r[0].organization_name == 'Del "M"\nC' and r[0].organization_urls["values"] == ["https://example.org/", "https://second.example.com/path"] and r[0].sitemap_urls.kind == "known-absence" and r[0].physical_row == 2
    assert {(e.file_name, e.code) for e in errors.collect()} == {("Bad.csv", "missing_required_field"), ("Bad.csv", "invalid_url"), ("Odd.csv", "unknown_catalog_file"), ("Enc.csv", "invalid_encoding")}
    assert [x.line for x in catalog.canonical_lines(records).collect()][1] == 'government,"Del ""M""\nC",https://example.org/; https://second.example.com/path,NKS,http://e.net/list'


def test_discovery(spark):
    df = spark.createDataFrame([(["b", "a", "b"], True), ([str(i) for i in range(103)] * 2, True), (["a"], False)], "u array<string>, on boolean")
    got = [r.s for r in df.select(catalog.select_discovery(F.col("u"), F.col("on")).alias("s")).collect()]
    assert [(len(s.urls), s.omitted) for s in got] == [(2, 0), (100, 3), (0, 0)] and got[0].urls == ["b", "a"]


def test_partner(spark):
    rows = spark.createDataFrame([("f", 1, "", "01/02/2027"), ("f", 2, "Show", ""), ("f", 3, None, "01/03/2027"), ("f", 4, "Bare", "")], "file_name string, physical_row int, title string, start_date string")
    good, bad = partner.attach_continuations(rows)
    assert {(r.physical_row, r.event_row) for r in good.collect()} == {(2, 2), (3, 2), (4, 4)} and {(r.physical_row, r.code) for r in bad.collect()} == {(1, "continuation_without_event"), (4, "event_without_occurrence")}
    dated = [("01/02/2027", "7:30 p.m.", ""), ("01/02/2027", "", "01/05/2027"), ("01/02/2027", "7:30 p.m.", "")]
    occ = spark.createDataFrame([(dated,)], "rows array<struct<start_date:string,start_time:string,end_date:string>>")
    assert [(o.start, o.end) for o in occ.select(partner.raw_occurrences(F.col("rows")).alias("o")).first().o] == [("2027-01-02", "2027-01-05"), ("2027-01-02T19:30:00", None)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [("i", 1, "a", ["k1"]), ("i", 2, "a", ["k1"]), ("i", 3, "b", ["k2"]), ("j", 4, "x", ["k1"]), ("i", 5, "b", ["k1", "k3"]), ("i", 6, "c", ["k3"])]
    cols = "identity string, seq long, content string, keys array<string>"
    write = ingestion.batch_writer(str(tmp_path / "log"), str(tmp_path / "out"))
    for n, part in enumerate((rows[:2], rows[2:4], rows[4:])):
        write(spark.createDataFrame(part, cols), n)
    write(spark.createDataFrame(rows[4:], cols), 2)
    got = {(r.identity, r.seq): (r.action, r.version) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.identity, r.seq): (r.action, r.version) for r in ingest(spark.createDataFrame(rows, cols)).collect()}
