import itertools

import pytest

from marquee.llm import addresses as ad
from marquee.session import checkpointed


@pytest.mark.parametrize(
    ("address", "city", "want"),
    [
        ({"street": "106 W. Church Rd.", "postalCode": "11090-1106"}, None, ("106", "church", "road", "w", None, "11090")),
        ({"text": "235 1st Hgwy, Port Cala, Del. 11097"}, None, ("235", "first", "highway", None, "port cala", "11097")),
        ({"address1": "No. 26, Church Lane, Unit B", "addressLocality": "Loro (downtown)"}, None, ("26", "church", "lane", None, "loro", None)),
        ({"street": "King Road So. 580, #110"}, "N. Pero", ("580", "king", "road", "s", "new pero", None)),
        ({"full": "Cale Armory; 139 EAST BRAMO HWY; Raleb"}, None, ("139", "bramo", "highway", "e", "raleb", None)),
        ({"street": "12 St. Calla St E, 2nd Fl"}, None, ("12", "saint calla", "street", "e", None, None)),
        ({"street": "Balun Dr. No. 22"}, None, ("22", "balun", "drive", "n", None, None)),
        ({"street": "TBA", "city": "-"}, "Dover", (None, None, None, None, "dover", None)), (None, None, (None,) * 6), ({}, "", (None,) * 6),
    ],
)
def test_parse(address, city, want):
    p = ad.parse_place(address, None, city)
    assert (p.number, p.street, p.kind, p.direction, p.town, p.zip5) == want


def test_em_separates_matches():
    counts = {"000000": 300, "000001": 200, "010000": 60, "000022": 400, "000020": 50, "000222": 300, "002000": 20}
    q = ad.posteriors(counts)
    assert q["000000"] > 0.9 and q["000001"] > 0.5 and q["000022"] < 0.5 and q["000222"] < 0.1


def test_em_estimates_missing_levels():
    """Venues are missing far more often among matches here; the estimates follow."""
    counts = {"000000": 300, "000001": 600, "002222": 500, "000222": 300, "002221": 20}
    w = ad.expectation_maximisation(counts)
    assert w.m[5][1] > 0.5 > 0.1 > w.u[5][1] and all(abs(p.sum() - 1) < 1e-9 for p in (*w.m, *w.u))
    assert ad.posteriors({}) == {} and ad.posteriors({"000002": 1})["000002"] == 1.0


ROWS = [
    (1, {"street": "106 W. Church Rd.", "city": "Alphaville", "postalCode": "11090"}, "Old Hall", "Alphaville"), (2, {"address1": "106 West Chruch Road, Suite 2; Alphaville"}, None, None), (3, {"street": "106 E Church Rd", "city": "Alphaville"}, "Barn", None),
    (4, {"street": "106 W Church Ave", "city": "Alphaville"}, "Gym", None), (5, None, "The Old Hall", "Alphaville"), (6, None, None, None), (1, {"street": "106 W. Church Rd.", "city": "Alphaville", "postalCode": "11090"}, "Old Hall", "Alphaville"),
    (7, {"street": "8 N Main St", "city": "Betatown"}, "Gallery", None), (8, {"street": "8 North Main Street", "city": "Betatown"}, "Gallery", None),
]


def test_same_place(spark):
    df = spark.createDataFrame(ROWS * 1, "hint_id long, address map<string,string>, venue string, city string")
    got = {tuple(r) for r in ad.same_place(df, "hint_id").collect()}
    assert {(1, 2), (1, 5), (2, 5), (7, 8)} <= got
    assert not got & {(1, 3), (2, 3), (1, 4), (3, 4), (1, 7)} and all(a < b for a, b in got) and not any(6 in p for p in got)
    assert ad.same_place(df.limit(0), "hint_id").count() == 0
    place = {r.hint_id: r.place for r in ad.place_classes(df, "hint_id").collect()}
    assert set(place) == {1, 2, 3, 4, 5, 7, 8} and place[1] == place[2] == place[5] and place[7] == place[8] and len(set(place.values())) == 4
    assert ad.place_classes(df.limit(0), "hint_id").count() == 0


def test_blocks_hold_all_near_pairs(spark):
    """Blocking against brute force: every pair that comparison would call equal shares a block."""
    forms = [("106", "church", "road", "w", "alphaville", None, None), ("106", "chruch", "road", "w", "alphavile", None, None), ("9", "fort pell", "lane", None, None, "11090", "old hall"), ("9", "fort pel", None, None, "x town", None, "old hall")]
    df = spark.createDataFrame([(i, *f) for i, f in enumerate(forms)], "fid long, " + ", ".join(f"{n} string" for n in ad.FIELDS))
    got = {tuple(r) for r in ad.candidates(df).collect()}
    near = {(i, j) for i, j in itertools.combinations(range(len(forms)), 2) if ad.compare(forms[i], forms[j])[0] == "0" and ad.compare(forms[i], forms[j])[1] in "01"}
    assert near <= got


def test_growing_sides_are_not_broadcast(spark):
    """Spark takes these sides for small at any size; none may pass through the driver."""
    df = spark.createDataFrame(ROWS, "hint_id long, address map<string,string>, venue string, city string")
    rows = checkpointed(ad.forms(ad.parsed(df, "hint_id", "address", "venue", "city"))[0])
    linked = spark.createDataFrame([(1, 2, 0.9)], "a long, b long, posterior double")
    for found in (ad.candidates(rows), ad.inherited(rows, linked), ad.same_place(df, "hint_id"), ad.place_classes(df, "hint_id")):
        found.collect()
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
