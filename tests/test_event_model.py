"""Behaviour of the event model: identities, occurrences, retention, merge and upsert."""

import random

import pytest
from pyspark.sql import functions as F

from marquee import schemas
from marquee.functions import temporal, text, urls
from marquee.operators import event_query as eq
from marquee.operators import jobs, merge, normalize, retention
from marquee.plans import registry

OCC = [("o1", "2026-09-01", None, None)]


def candidate(**kw):
    base = dict(id="event-first", source_record_id="source-stable", source_url="https://events.example.org/art-night", source_supplied_id="source-event-1", retrieved_at=None, title="Art Night", venue="Main Hall", city="Dover", address={"street": "100 Arts Way", "postalCode": "19901"}, source_category="government", occurrences=OCC) | kw
    names = [f.strip().split(" ")[0] for f in schemas.CANDIDATE.split(",\n")]
    return tuple(base.get(n) for n in names)


def normal(spark, *rows):
    return {r.id: r for r in normalize.normalize_events(spark.createDataFrame([candidate(**r) for r in rows], schemas.CANDIDATE)).collect()}


def test_identity_is_stable_under_form_and_differs_by_content(spark):
    got = normal(
        spark, {"id": "a", "title": "  CAFÉ\tNight  "}, {"id": "b", "title": "café night", "address": {"postalCode": "19901", "street": "100 Arts Way"}}, {"id": "c", "title": "café night", "source_record_id": "other"},
        {"id": "d", "title": "café night", "occurrences": [("o", "2026-09-02", None, None)]}, {"id": "e", "title": "café night", "venue": "Other Hall"},
    )
    ids = {k: v.canonical_identity for k, v in got.items()}
    assert ids["a"] == ids["b"] and len(set(ids.values())) == 4 and got["a"].title == "CAFÉ Night"


def test_normalize_errors_and_issues(spark):
    got = normal(
        spark, {"id": "blank", "title": " "}, {"id": "long", "title": "x" * 301}, {"id": "none", "occurrences": []}, {"id": "bad", "occurrences": [*OCC, ("o2", "not-a-temporal-value-1", None, None)]},
        {"id": "zone", "occurrences": [("o", "2026-09-01T10:00:00", None, "Mars/Base")]}, {"id": "offset", "occurrences": [("o", "2026-09-01T19:00:00Z", None, None)]},
        {"id": "end", "occurrences": [("o", "2026-09-01T19:00:00", "2026-09-01T18:00:00", "America/New_York")]},
    )
    code = {k: [(e.path, e.code) for e in v.errors] for k, v in got.items()}
    assert code["blank"] == code["long"] == [("title", "invalid_length")] and code["none"] == [("occurrences", "missing_occurrence")]
    assert code["bad"] == [("occurrences.1.start", "invalid_timestamp")] and code["zone"] == [("occurrences.0.sourceTimezone", "invalid_timezone")] and code["offset"] == [("occurrences.0.start", "invalid_timestamp")]
    assert [(i.path, i.code) for i in got["end"].validation_issues] == [("occurrences.0.end", "end_not_after_start")] and got["end"].occurrences[0].end_at is None


@pytest.mark.parametrize(("o", "days", "want"), [(("date", "2026-08-17", None), 0, True), (("date", "2026-08-18", None), 0, False), (("instant", None, "2026-08-17 12:00:00"), 1, True), (("instant", None, "2026-08-17 12:00:01"), 1, False)])
def test_archival_boundaries(spark, o, days, want):
    df = spark.createDataFrame([o], "kind string, d string, t string").select(F.struct("kind", F.col("d").alias("start_date"), F.lit(None).cast("string").alias("end_date"), F.col("t").cast("timestamp").alias("start_at"), F.col("t").cast("timestamp").alias("end_at")).alias("o"))
    assert df.select(temporal.is_archive_eligible(F.col("o"), "2026-08-18T12:00:00Z", days)).first()[0] is want


def test_retention_settings():
    assert retention.update_retention_days(30, 3650)["value"] == 3650 and retention.update_retention_days(30, 0)["accepted"]
    assert all(retention.update_retention_days(30, bad)["value"] == 30 for bad in (-1, 3651, 1.5, float("nan"), "30", None, True))
    assert retention.archival_job("2026-08-18T12:00:00Z", 30)["idempotency_key"] == retention.archival_job("2026-08-18T12:00:00Z", 30)["idempotency_key"]


def fold(rows):
    """A plain fold: the definition that the windows must equal."""
    state, seen, out = {}, {}, {}
    for identity, seq, content, keys in sorted(rows, key=lambda r: r[1]):
        known = seen.setdefault(identity, set())
        new = set(keys) - known
        if identity in state and not new:
            out[identity, seq] = ("duplicate", None)
            continue
        known |= new
        if identity not in state:
            state[identity] = (content, 1)
            out[identity, seq] = ("created", 1)
        elif state[identity][0] == content:
            out[identity, seq] = ("duplicate", state[identity][1])
        else:
            state[identity] = (content, state[identity][1] + 1)
            out[identity, seq] = ("updated", state[identity][1])
    return out


def test_upsert_windows_equal_the_fold(spark):
    rng = random.Random(7)
    rows = [(f"i{c}", s, rng.choice("abc"), [f"k{rng.randrange(6)}" for _ in range(rng.randrange(1, 3))]) for c in range(60) for s in range(c * 100, c * 100 + rng.randrange(1, 8))]
    got = {(r.identity, r.seq): (r.action, r.version) for r in merge.ingest(spark.createDataFrame(rows, "identity string, seq long, content string, keys array<string>")).collect()}
    assert got == fold(rows)


def test_search_and_filters(spark):
    cols = "id string, title string, description string, organization string, venue string, city string, categories array<string>, region string, cost string, audience string, accessibility string"
    e = spark.createDataFrame([("1", "Jazz Night", None, None, None, None, ["Music"], "N", None, None, None), ("2", "x", "ＪＡＺＺ club", None, None, None, [], None, None, None, None), ("3", "other", None, None, None, None, None, "N", None, None, None)], cols)
    assert {r.id for r in eq.search(e, " jazz ").collect()} == {"1", "2"} and eq.search(e, "  ").count() == 3
    q = eq.ListQuery("2026-01-01T00:00:00Z", regions=["N"], categories=["Music", "Art"])
    assert [r.id for r in e.where(eq.matches_filters(q)).collect()] == ["1"]
    with pytest.raises(ValueError):
        eq.ListQuery("2026-01-01T00:00:00Z", page=0)
    assert eq.neighbours("/e?page=2&q=x", 2, 10, 35) == ("/e?q=x&page=1&pageSize=10", "/e?q=x&page=3&pageSize=10")


def test_urls(spark):
    rows = [("EXAMPLE.org:443/a/", "https://example.org/a/"), ("ftp://a.b", None), ("localhost", None), ("https://u@a.b", None), ("http://a.b?q#f", "http://a.b/?q#f")]
    df = spark.createDataFrame([(a,) for a, _ in rows], "u string")
    assert [r[0] for r in df.select(urls.normalize_http_url(F.col("u"))).collect()][1:] == [b for _, b in rows][1:]
    safe = spark.createDataFrame([("http://10.0.0.1/",), ("http://172.20.1.1",), ("http://8.8.8.8",), ("http://a.local",), ("http://[::1]/",), ("https://a.example",), (None,)], "u string")
    assert [r[0] for r in safe.select(urls.is_safe_public_url(F.col("u"))).collect()] == [False, False, True, False, False, True, False]


def test_text(spark):
    df = spark.createDataFrame([("&lt;b&gt; Caf&#233; &amp; Bar&nbsp;&unknown;<script>x</script>",)], "t string")
    assert df.select(text.clean_text(F.col("t"))).first()[0] == "<b> Café & Bar &unknown;"
    assert spark.range(1).select(text.cost_text(F.lit(5.0), F.lit(7.5))).first()[0] == "$5–$7.50"


def test_job_cycle(spark):
    cols = schemas.JOB
    j = spark.createDataFrame([("a", "t", "{}", "queued", None, None, None, None, 0, 2, "k1")], cols).withColumn("available_at", F.lit("2026-01-01").cast("timestamp")).withColumn("created_at", F.col("available_at"))
    queue, ids = jobs.enqueue(j, j.withColumn("id", F.lit("b")))
    assert queue.count() == 1 and ids.first().queued_id == "a"
    run = jobs.claim(j, "w", "2026-01-02T00:00:00Z", 60)
    assert (run.first().state, run.first().attempts) == ("running", 1)
    assert jobs.complete(run, "a", "other").first().state == "running" and jobs.complete(run, "a", "w").first().state == "completed"
    assert jobs.next_job(jobs.complete(run, "a", "w"), "2026-01-03T00:00:00Z").count() == 0
    assert jobs.recover_leases(run, "2026-01-02T00:02:00Z").first().state == "queued"
    assert jobs.fail(run, "a", "w", "2026-01-05T00:00:00Z").first().state == "queued"


def test_settings_and_audits(spark):
    s = spark.createDataFrame([("k", "1", 3)], "key string, value string, version int")
    assert tuple(jobs.compare_and_set(s, "k", 3, "2").first()) == ("k", "2", 4) and tuple(jobs.compare_and_set(s, "k", 2, "2").first()) == ("k", "1", 3)
    a = spark.createDataFrame([("1", "x")], "id string, action string")
    table, out = jobs.append_audits(a, spark.createDataFrame([("1", "x"), ("2", "y")], "id string, action string"))
    assert table.count() == 2 and {(r.id, r.outcome) for r in out.collect()} == {("1", "replayed"), ("2", "created")}
    _, out = jobs.append_audits(a, spark.createDataFrame([("1", "z")], "id string, action string"))
    assert out.first().outcome == "conflict"


def test_sliding_window(spark):
    df = spark.createDataFrame([("c", i, t) for i, t in enumerate([0, 10, 20, 30, 61, 62])], "client string, seq long, t long").withColumn("at", F.timestamp_seconds("t"))
    got = {r.seq: (r.accepted, r.retry_after) for r in jobs.sliding_window(df, 2, 60).collect()}
    assert got == {0: (True, None), 1: (True, None), 2: (False, 40), 3: (False, 30), 4: (True, None), 5: (False, 8)}


def test_registry_is_consistent():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
