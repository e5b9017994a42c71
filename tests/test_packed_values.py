import math

import pytest
from pyspark.sql import functions as F

from marquee.operators.packed_values import ValueCodes, learn_codes, parse_packed, split_packed

NAMES = ["1", "14", "22", "Dance", "Readings; Open Mic", "Talks, Walks & Tours", "Clay and Glass", "Puppetry / Masks"]
CATS = ValueCodes("category", frozenset(NAMES))
URLS = ValueCodes("url")


@pytest.mark.parametrize(
    ("text", "items"),
    [
        ("1;14", ["1", "14"]), ("1, 14,", ["1", "14"]), ("22 and 14 and '1'", ["22", "14", "1"]), ("1; ; 14", ["1", "14"]), ("14 14", ["14", "14"]), ("1\n14 & 22", ["1", "14", "22"]),
        ("Readings; Open Mic; Dance", ["Readings; Open Mic", "Dance"]), ("Clay and Glass and Dance", ["Clay and Glass", "Dance"]), ('"Talks, Walks & Tours", Dance', ["Talks, Walks & Tours", "Dance"]),
        ("Puppetry / Masks/Dance", ["Puppetry / Masks", "Dance"]), ("Dance", ["Dance"]), ("", []), ("  ", []), ("Unknown Thing", ["Unknown Thing"]),
    ],
)
def test_categories(text, items):
    assert parse_packed(text, CATS) == items


@pytest.mark.parametrize(
    ("text", "items"),
    [
        ("https://a.example/x;https://b.example", ["https://a.example/x", "https://b.example"]), ("https://a.example/whats-on?tag=a;b", ["https://a.example/whats-on?tag=a;b"]),
        ("https://a.example/t?x=1&y=2 & www.b.example/en/agenda,list", ["https://a.example/t?x=1&y=2", "www.b.example/en/agenda,list"]), ('"https://a.example/en/agenda,list", a.example', ["https://a.example/en/agenda,list", "a.example"]),
        ("https://a.example and https://a.example and", ["https://a.example", "https://a.example"]),
    ],
)
def test_urls(text, items):
    assert parse_packed(text, URLS) == items


def test_long_text_is_whole():
    assert parse_packed(";".join(["14"] * 5000), CATS) == ["14"] * 5000


def test_table_cases(spark):
    rows = [("a", "1;14", 7), ("a", "1;14", 7), ("b", None, 8), ("c", "Dance", 9)]
    df = spark.createDataFrame(rows, "id string, t string, pos int")
    names = spark.createDataFrame([(n,) for n in NAMES], "n string")
    codes = learn_codes(df, F.col("t"), "category", names)
    got = sorted((r.id, r.pos, r.item) for r in split_packed(df, "t", codes).collect())
    assert got == [("a", 0, "1"), ("a", 0, "1"), ("a", 1, "14"), ("a", 1, "14"), ("c", 0, "Dance")]
    assert split_packed(df.limit(0), "t", learn_codes(df.limit(0), F.col("t"), "url")).count() == 0


def test_long_values_and_large_vocabularies(spark):
    """No length and no number of names is cut off."""
    long = "http://harbor.example/" + "a,b" * 2000
    codes = ValueCodes("url")
    assert parse_packed(f"{long}; http://second.example", codes) == [long, "http://second.example"]
    names = spark.range(10_500).selectExpr("cast(id as string) as k", "concat('Arts, Crafts ', id) as v")
    learned = learn_codes(spark.createDataFrame([("Jazz",), (None,), ("",)], "v string"), F.col("v"), "category", names)
    assert not learned.vocabulary and learned.bits("Arts, Crafts 77") < 40 and learned.bits("Arts, Crafts x") > 100


@pytest.mark.parametrize("n", [50, 10_500])
def test_codes_do_not_turn_on_the_size(spark, n):
    """A known name costs the same by one method however many names and uses there are."""
    names = spark.range(n).selectExpr("cast(id as string) as k", "concat('Arts, Crafts ', id) as v")
    packed = spark.createDataFrame([("a", "Arts, Crafts 7, Jazz, 3"), ("b", "'Arts, Crafts 8' Jazz"), ("b", "Jazz")], "id string, t string")
    df = packed.unionByName(spark.range(20_000 * (n > 50) + 3).selectExpr("'c' as id", "'Jazz' as t"))
    codes = learn_codes(df, F.col("t"), "category", names)
    assert codes.bits("Arts, Crafts 7") == 1 + math.log2(2 * n) and codes.bits("Arts, Crafts x") > 100
    got = sorted((r.id, r.pos, r.item) for r in split_packed(df.where("id != 'c'"), "t", codes).collect())
    assert got == [("a", 0, "Arts, Crafts 7"), ("a", 1, "Jazz"), ("a", 2, "3"), ("b", 0, "Arts, Crafts 8"), ("b", 0, "Jazz"), ("b", 1, "Jazz")]
