from datetime import UTC, datetime

import pytest

from marquee.functions.moments import Policy, readings, scene_text
from marquee.operators.timestamps import Chain, normalise


def us(*a):
    return int(datetime(*a, tzinfo=UTC).timestamp()) * 1_000_000


@pytest.mark.parametrize(
    ("text", "zone", "want"),
    [
        ("2028-04-17T14:00:00-0400", None, us(2028, 4, 17, 18)), ("2029-03-26T19:00[America/Chicago]", None, us(2029, 3, 27)), ("20250819T220000Z", "Asia/Tokyo", us(2025, 8, 19, 22)),
        ("Feb 26, 2026 at 11:00pm EST", None, us(2026, 2, 27, 4)), ("TZID=America/Denver:20270527T200000", None, us(2027, 5, 28, 2)), ("27 July 2025, 18:30 EDT", None, us(2025, 7, 27, 22, 30)),
        ("Sun, 05 Nov 2028 00:10:00 -0400", None, us(2028, 11, 5, 4, 10)), ("11/17/29 14:30", None, us(2029, 11, 17, 19, 30)), ("24.01.2028 20:00", "UTC", us(2028, 1, 24, 20)), ("1793214000000", None, 1793214000000000),
        ("1761088500", "America/New_York", 1761088500000000), ("2024-03-10T02:30", None, us(2024, 3, 10, 7, 30)), ("2024-11-03 01:30", "", us(2024, 11, 3, 5, 30)), ("Wed Apr 15 2026 12:05 Eastern", None, us(2026, 4, 15, 16, 5)),
        ("July 6, 2029 7 p.m. ET", None, us(2029, 7, 6, 23)), ("2025-07-25T14:00", "Central", us(2025, 7, 25, 19)), ("45505 0.520833", None, us(2024, 8, 1, 16, 30)), ("20250613 1900", None, us(2025, 6, 13, 23)), ("12/06/2029 12 noon", None, us(2029, 12, 6, 17)),
    ],
)
def test_readings(text, zone, want):
    got = [r for r in readings(text, zone) if r[2] == 0]
    assert [r[1] for r in got] == [want]


@pytest.mark.parametrize("text", [None, "", "TBD", "2026-03-31", "20260830", "05/27/2027", "11/31/2026 7:00 PM", "0000-00-00 00:00:00", "13/13/2026 7:00 pm", "2027-04-31T10:00", "10/10/2027 TBA", "10/10/2027 25:00"])
def test_no_readings(text):
    assert [r for r in readings(text) if r[2] == 0] == []


def test_both_passings_of_a_repeated_hour():
    assert [(r[1], r[2]) for r in readings("2024-11-03T01:30")] == [(us(2024, 11, 3, 5, 30), 0), (us(2024, 11, 3, 6, 30), 1)]
    assert [r[1] for r in readings("2024-11-03T01:30 EST")] == [us(2024, 11, 3, 6, 30)]


def test_scene_text():
    assert scene_text("1/2/2027", " 7 pm ") == "1/2/2027 7 pm" and scene_text("1/2/2027", "") is None


def brute(values, rank=10.0, switch=1.0, backward=2.0):
    best = None
    def go(i, path, cost):
        nonlocal best
        if i == len(values):
            if best is None or cost < best[0] - 1e-9:
                best = (cost, path)
            return
        for o in values[i]:
            c = cost + rank * o[2]
            if path:
                c += switch * (path[-1][0] != o[0]) + backward * (path[-1][1] > o[1])
            go(i + 1, [*path, o], c)
    go(0, [], 0.0)
    return best[0]


def test_viterbi_equals_brute_force():
    import random

    rng = random.Random(3)
    for _ in range(150):
        values = [[(rng.choice("ab"), rng.randrange(5), rng.randrange(2)) for _ in range(rng.randrange(1, 4))] for _ in range(rng.randrange(1, 6))]
        chain, got = Chain(), []
        for i, v in enumerate(values):
            got += list(chain.push(i, v))
        got += list(chain.flush())
        assert [t for t, _ in got] == list(range(len(values)))
        path = [next(o for o in sorted(values[t], key=lambda o: o[2]) if o[:2] == s) for t, s in got]
        cost = sum(10.0 * o[2] for o in path) + sum((a[0] != b[0]) + 2.0 * (a[1] > b[1]) for a, b in zip(path, path[1:], strict=False))
        assert abs(cost - brute(values)) < 1e-6


def test_order_decides_between_day_and_month(spark):
    rows = [("s", i, f"k{i}", t) for i, t in enumerate(["25/03/2027 10:00", "04/05/2027 10:00", "28/05/2027 10:00"])] + [(None, 1, None, None)]
    df = spark.createDataFrame(rows, "src string, n int, k string, t string")
    got = {r.k: r.start_us for r in normalise(df, "src", ["n"], "k", "t", policy=Policy(slashed="either", default_zone="UTC")).collect()}
    assert got == {"k0": us(2027, 3, 25, 10), "k1": us(2027, 5, 4, 10), "k2": us(2027, 5, 28, 10), None: None}
    assert normalise(df.limit(0), "src", ["n"], "k", "t").count() == 0
