import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marquee.operators import row_loading as rl
from marquee.sources.csv_grammar import parse_file, parse_one

GOOD = '7,,Show,9,https://a.example/e/1,,5,10.50,01/02/2027,7:30 p.m.,,,"Text, with ""quotes"""'


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        (GOOD, None), (GOOD + "\r", None), ("﻿" + GOOD, None), ("", None), (",,,,,,,,,,,,", None), (",,", None),
        (GOOD.replace("Show", 'Sh"ow'), rl.BROKEN), (GOOD.replace("Show", '"Show'), rl.BROKEN), (GOOD.replace("Show", '"Show" x'), rl.BROKEN), (GOOD.replace("Show", "Sh\now"), rl.BROKEN),
        (GOOD + ",x", rl.WIDTH), ("7;;Show", rl.WIDTH), (GOOD.replace("10.50", "-5"), rl.VALUE), (GOOD.replace("01/02/2027", "02/30/2027"), rl.VALUE),
        (GOOD.replace("7:30 p.m.", "13:30 pm"), rl.VALUE), (GOOD.replace("7,,", ",,", 1), rl.VALUE), (GOOD.replace("https://a.example/e/1", "ftp://a.example"), rl.VALUE), (None, rl.MISSING),
    ],
)
def test_partner_reasons(text, reason):
    assert rl.judge(text, rl.PARTNER)[0] == reason


@pytest.mark.parametrize(("url", "ok"), [("a.example", True), ("http://localhost", False), ("https://u:p@a.example", False), ("https://a.example; b.example/x", True), ("NKS", False), ("http://-bad-.example", False), ("mailto:x@y.example", False)])
def test_catalog_urls(url, ok):
    assert (rl.judge(f"Name,{url},,NKS", rl.CATALOG)[0] is None) == ok


def test_located_error_and_recovery():
    text = 'a,b\n1,"x\n2,y\n3,z "q\n4,w\n'
    got = parse_file(text, width=2)
    assert [r.fields for r in got if not r.issues] == [["a", "b"], ["2", "y"], ["4", "w"]]
    broken = [r for r in got if r.issues]
    assert [(r.issues[0].code, r.line) for r in broken] == [("text_after_closing_quote", 2), ("quote_in_plain_field", 4)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='ab,"\n\r é', max_size=6), min_size=2, max_size=4), min_size=1, max_size=5))
def test_round_trip(rows):
    rows = [r for r in rows if any(r)]
    text = "".join(",".join('"' + f.replace('"', '""') + '"' for f in r) + "\r\n" for r in rows)
    assert [r.fields for r in parse_file(text)] == rows
    assert all(parse_one(",".join('"' + f.replace('"', '""') + '"' for f in r)).issues == [] for r in rows)


def test_table_cases(spark):
    rows = [(1, "partner_x.csv", 2, GOOD, "keep"), (1, "partner_x.csv", 2, GOOD, "keep"), (2, None, None, GOOD, None), (3, "catalog_x.csv", 5, "N,a.example,,\r", "z"), (4, "catalog_x.csv", 6, '"' + "x" * 200_000, None)]
    df = spark.createDataFrame(rows, "row_id long, file_name string, physical_row int, raw_text string, parsed_reason string")
    got = {(r.row_id, r.parsed_reason) for r in rl.load_rows(df).collect()}
    assert got == {(1, None), (2, rl.UNKNOWN), (3, None), (4, rl.BROKEN)}
    assert rl.load_rows(df.limit(0)).count() == 0
    typed = rl.typed_records(rl.load_rows(df), rl.PARTNER, "partner_").collect()
    assert len(typed) == 2 and typed[0].title_of_program == "Show" and typed[0].description == 'Text, with "quotes"'
    assert random.Random(1)
