"""Schedule texts of listing pages: one tokeniser for a side of the text, one resolver for the years.

A text has one side (a day, perhaps with a time) or two (a range). A side is cut into tokens, each of one kind (a
letter below); the string of kinds says whether the side is a date at all, and the tokens' values make it one.

    "Saturday, May 1, 2027 at 7:30 p.m."  ->  w m d y c  ->  month 5, day 1, year 2027, minute 1170

Defined cases: null or blank text, sides of another shape and impossible days give null; a year that is not said is
that of the next such day from ``today`` on; a range that starts in a later month than it ends began the year before;
a time counts for single days only; a second side that is no date is passed over.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions.temporal import ZONE, let

#: Names of months and weekdays.
MONTHS = "january february march april may june july august september october november december".split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
_TIME = r"(?:12\s+)?(?:noon|midnight)|\d{1,2}(?::\d{2})?\s*[ap]\.?m\.?"
_TOKEN = rf"(?i)((?:\bat\b|@)\s*(?:{_TIME})|\d{{2}}/\d{{2}}|\d+|\p{{L}}+|[^\s,])"
_BETWEEN = r"(?i)\s+(?:through|to|-)\s+|(?<=\d)\s*[–—]\s*(?=[A-Za-z\d])"


def clock_minutes(c: Column) -> Column:
    """Minutes of the day of noon, midnight, 7 pm, 7:30 p.m.; null otherwise."""
    t = F.upper(F.regexp_replace(c, r"[.\s]", ""))
    t = F.when(t.rlike("^(?:12)?NOON$"), "12:00PM").when(t.rlike("^(?:12)?MIDNIGHT$"), "12:00AM").otherwise(F.regexp_replace(t, r"^(\d{1,2})([AP]M)$", "$1:00$2"))
    at = F.try_to_timestamp(t, F.lit("h:mma"))
    return F.hour(at) * 60 + F.minute(at)


def _kind(token: Column) -> Column:
    return (
        F.when(token.rlike(r"^(?:@|at\b)."), "c").when(token.isin(MONTHS), "m").when(token.isin(WEEKDAYS), "w")
        .when(token.rlike(r"^\d{4}$"), "y").when(token.rlike(r"^\d{1,2}$"), "d").when(token.rlike(r"^\d\d/\d\d$"), "n").otherwise("?")
    )


def side(c: Column) -> Column:
    """struct(month, day, year, minute) of one side; null if its tokens make no date. The month may be left out."""
    tokens = F.transform(F.regexp_extract_all(F.lower(c), F.lit(_TOKEN), F.lit(1)), lambda t: F.struct(_kind(t).alias("k"), t.alias("t")))

    def value(x: Column, kind: str) -> Column:
        return F.get(F.filter(x, lambda t: t["k"] == kind), F.lit(0))["t"]

    def built(x: Column) -> Column:
        shape = F.array_join(F.transform(F.filter(x, lambda t: t["k"] != "w"), lambda t: t["k"]), "")
        named = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), value(x, "m")).cast("int")
        numeric = value(x, "n")
        month = F.coalesce(named, F.substring(numeric, 1, 2).try_cast("int"))
        day = F.coalesce(value(x, "d"), F.substring(numeric, 4, 2)).try_cast("int")
        minute = clock_minutes(F.regexp_replace(value(x, "c"), r"^(?:@|at)\s*", ""))
        sound = shape.rlike("^(?:m?dy?c?|n)$") & (~shape.contains("c") | minute.isNotNull())
        return F.when(sound, F.struct(month.alias("month"), day.alias("day"), value(x, "y").try_cast("int").alias("year"), minute.alias("minute")))

    return let(tokens, built)


def _iso(year: Column, of: Column) -> Column:
    d = F.format_string("%04d-%02d-%02d", year, of["month"], of["day"])
    return F.when(d.try_cast("date").isNotNull(), d)


def schedule(c: Column, today: Column) -> Column:
    """struct(start, end, zone) of a schedule text; today is an ISO day. "Now through ..." starts today."""
    text = F.trim(F.regexp_replace(c, r"\s+", " "))
    text = F.regexp_replace(text, r"(?i)^now(?= (?:through|to) )", F.concat(F.substring(today, 6, 2), F.lit("/"), F.substring(today, 9, 2)))
    this_year, this_day = F.substring(today, 1, 4).cast("int"), F.substring(today, 6, 2).cast("int") * 100 + F.substring(today, 9, 2).cast("int")
    coming = lambda x: this_year + (x["month"] * 100 + x["day"] < this_day).cast("int")

    def resolved(x: Column) -> Column:
        a, b = x["a"], x["b"]
        until = F.coalesce(b["year"], coming(b))
        since = F.coalesce(a["year"], until - (a["month"] > b["month"]).cast("int"), coming(a))
        first, last = _iso(since, a), _iso(until, b)
        timed = b.isNull() & a["minute"].isNotNull()
        clock = F.format_string("T%02d:%02d:00", F.floor(a["minute"] / 60).cast("int"), a["minute"] % 60)
        whole = a["month"].isNotNull() & first.isNotNull() & (b.isNull() | last.isNotNull())
        return F.when(whole, F.struct(F.when(timed, F.concat(first, clock)).otherwise(first).alias("start"), last.alias("end"), F.when(timed, F.lit(ZONE)).alias("zone")))

    def sides(p: Column) -> Column:
        return let(F.struct(side(F.get(p, F.lit(0))).alias("a"), side(F.get(p, F.lit(1))).alias("b")), with_month)

    def with_month(x: Column) -> Column:
        # the end may leave its month to the start
        end = F.when(x["b"].isNotNull(), x["b"].withField("month", F.coalesce(x["b"]["month"], x["a"]["month"])))
        return let(F.struct(x["a"].alias("a"), end.alias("b")), resolved)

    return let(F.split(text, _BETWEEN), sides)
