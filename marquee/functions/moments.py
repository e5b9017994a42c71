"""All valid readings of one written moment (pure Python; run in Arrow batches by operators.timestamps).

A reading is (format label, UTC microseconds, rank); rank 0 is the reading that the policy prefers among equals.
Fixed conventions: a zone or offset in the text wins over the given zone, that over ``DEFAULT_ZONE``; skipped local
times move forward by the gap, repeated ones mean the first passing (rank 0) or the second (rank 1); bare five-digit
dates are spreadsheet day numbers, bare decimals fractions of a day rounded to the minute.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

DEFAULT_ZONE = "America/New_York"
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
SPREADSHEET_DAY_0 = date(1899, 12, 30)
DAY_US = 86_400_000_000

#: Zone words and their zones, or their fixed offsets in minutes.
ZONE_WORDS = {
    "et": "America/New_York", "eastern": "America/New_York", "eastern time": "America/New_York",
    "ct": "America/Chicago", "central": "America/Chicago", "central time": "America/Chicago",
    "mt": "America/Denver", "mountain": "America/Denver", "mountain time": "America/Denver",
    "pt": "America/Los_Angeles", "pacific": "America/Los_Angeles", "pacific time": "America/Los_Angeles",
    "utc": "UTC", "gmt": "UTC", "z": "UTC", "jst": "Asia/Tokyo",
}
ZONE_OFFSETS = {"est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "bst": 60, "cet": 60, "cest": 120}
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}

_MON = r"(?P<mon>jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
_DOW = r"(?:(?:mon|tue|tues|wed|wednes|thu|thur|thurs|fri|sat|satur|sun)(?:day)?\.?,?\s+)?"
_Y = r"(?P<y>\d{4})"
DATES = {
    "iso": re.compile(rf"{_Y}-(?P<m>\d{{2}})-(?P<d>\d{{2}})"),
    "compact": re.compile(rf"{_Y}(?P<m>\d{{2}})(?P<d>\d{{2}})(?!\d)"),
    "slashed": re.compile(r"(?P<a>\d{1,2})/(?P<b>\d{1,2})/(?P<yy>\d{4}|\d{2})(?!\d)"),
    "dotted": re.compile(r"(?P<a>\d{1,2})\.(?P<b>\d{1,2})\.(?P<yy>\d{4}|\d{2})(?!\d)"),
    "month_day": re.compile(rf"{_DOW}{_MON}\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+{_Y}(?!\d)", re.I),
    "day_month": re.compile(rf"{_DOW}(?P<d>\d{{1,2}})(?:st|nd|rd|th)?[\s-]+{_MON}[\s,-]+{_Y}(?!\d)", re.I),
    "serial": re.compile(r"(?P<serial>\d{5})(?:(?P<frac>\.\d+))?(?!\d)"),
}
_AP = r"\s*(?P<ap>[ap])\.?\s?m\.?(?![a-z])"
TIMES = {
    "clock12": re.compile(rf"(?P<h>\d{{1,2}})(?:[:.](?P<mi>\d{{2}})(?::(?P<s>\d{{2}}))?)?{_AP}", re.I),
    "clock24": re.compile(r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?"),
    "compact_time": re.compile(r"(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?(?!\d)"),
    "word": re.compile(r"(?:12\s*)?(?P<word>noon|midnight)", re.I),
    "day_fraction": re.compile(r"(?P<fraction>0?\.\d+|0)(?!\d)"),
}
_OFFSET = re.compile(r"(?P<sign>[+-])(?P<oh>\d{2})(?::?(?P<om>\d{2}))?")
_BRACKET = re.compile(r"\[(?P<zone>[^\]]+)\]$")
_TZID = re.compile(r"(?:DTSTART;)?TZID=(?P<zone>[^:]+):(?P<rest>.*)", re.S)


@dataclass(frozen=True)
class Policy:
    """How ambiguous written forms are read; the defaults are this project's rules. first: month, day or either."""

    slashed: str = "month"
    dotted: str = "day"
    centuries: tuple[int, ...] = (2000, 1900)
    default_zone: str = DEFAULT_ZONE


@lru_cache(maxsize=1024)
def zone_of(name: str) -> ZoneInfo | timezone | None:
    word = name.strip().lower()
    if word in ZONE_OFFSETS:
        return timezone(timedelta(minutes=ZONE_OFFSETS[word]))
    try:
        return ZoneInfo(ZONE_WORDS.get(word, name.strip()))
    except Exception:
        return None


def _dates(label: str, m: re.Match, policy: Policy) -> list[tuple[str, date, int]]:
    g = m.groupdict()
    out: list[tuple[str, tuple[int, int, int], int]] = []
    if "serial" in g:
        return [(label, SPREADSHEET_DAY_0 + timedelta(days=int(g["serial"])), 0)]
    if "mon" in g:
        out.append((label, (int(g["y"]), MONTHS[g["mon"][:3].lower()], int(g["d"])), 0))
    elif "a" in g:
        a, b, yy = int(g["a"]), int(g["b"]), g["yy"]
        first = getattr(policy, label)
        orders = [("month", a, b), ("day", b, a)] if first != "day" else [("day", b, a), ("month", a, b)]
        years = [(int(yy), 0)] if len(yy) == 4 else [(c + int(yy), i) for i, c in enumerate(policy.centuries)]
        for y, rank in years:
            for k, (order, mo, d) in enumerate(orders):
                if first == "either" or k == 0:
                    out.append((f"{label}_{order}{'' if len(yy) == 4 else '_yy'}", (y, mo, d), rank))
    else:
        out.append((label, (int(g["y"]), int(g["m"]), int(g["d"])), 0))
    found = []
    for name, ymd, rank in out:
        try:
            found.append((name, date(*ymd), rank))
        except ValueError:
            continue
    return found


def _time_us(m: re.Match) -> int | None:
    """Microseconds since the day's start."""
    g = m.groupdict()
    if g.get("word"):
        return DAY_US // 2 if g["word"].lower() == "noon" else 0
    if g.get("fraction"):
        minutes = round(float(g["fraction"]) * 1440)
        return minutes * 60_000_000 if minutes < 1440 else None
    h, mi, s = int(g["h"]), int(g.get("mi") or 0), int(g.get("s") or 0)
    if g.get("ap"):
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if g["ap"].lower() == "p" else 0)
    if h > 23 or mi > 59 or s > 59:
        return None
    fraction = int((g.get("f") or "0").ljust(6, "0")[:6])
    return ((h * 60 + mi) * 60 + s) * 1_000_000 + fraction


def _instants(day: date, us: int, zone: object) -> list[tuple[int, int]]:
    """(UTC microseconds, rank) of a local time: one, or both passings of a repeated hour."""
    try:
        local = datetime(day.year, day.month, day.day) + timedelta(microseconds=us)
        found = []
        for fold in (0, 1):
            there = local.replace(tzinfo=zone, fold=fold).astimezone(UTC)
            found.append((there - EPOCH) // timedelta(microseconds=1))
    except (OverflowError, ValueError):
        return []
    if found[1] > found[0]:  # repeated; in a gap fold=1 gives the earlier instant, which is no reading
        return [(found[0], 0), (found[1], 1)]
    return [(found[0], 0)]


def _zone_tail(tail: str) -> tuple[bool, object | None]:
    """(understood, zone) of what follows the time; zone None: nothing said. An offset wins over a bracketed name."""
    tail = tail.strip().strip(",").strip()
    if not tail:
        return True, None
    named = None
    if b := _BRACKET.search(tail):
        named = zone_of(b["zone"])
        if named is None:
            return False, None
        tail = tail[: b.start()].strip()
        if not tail:
            return True, named
    if o := _OFFSET.fullmatch(tail):
        minutes = int(o["oh"]) * 60 + int(o["om"] or 0)
        if minutes > 18 * 60:
            return False, None
        return True, timezone(timedelta(minutes=-minutes if o["sign"] == "-" else minutes))
    found = zone_of(tail.strip("()"))
    return found is not None, found


def readings(text: str | None, zone: str | None = None, policy: Policy = Policy()) -> list[tuple[str, int, int]]:
    """Every valid (label, UTC microseconds, rank) of text; [] for pure dates and unusable values."""
    text = (text or "").strip()
    if not text:
        return []
    if re.fullmatch(r"-?\d{9,10}", text):
        return [("epoch_s", int(text) * 1_000_000, 0)]
    if re.fullmatch(r"-?\d{12,13}", text):
        return [("epoch_ms", int(text) * 1000, 0)]
    if re.fullmatch(r"-?\d{15,16}", text):
        return [("epoch_us", int(text), 0)]
    given = zone_of(zone) if zone and zone.strip() else None
    said = None
    if t := _TZID.fullmatch(text):
        said, text = zone_of(t["zone"]), t["rest"].strip()
        if said is None:
            return []
    out = []
    for label, pattern in DATES.items():
        m = pattern.match(text)
        if not m:
            continue
        rest = text[m.end() :]
        frac = m.groupdict().get("frac")
        times = [(f"{label}+fraction", round(float(frac) * 1440) * 60_000_000, rest)] if frac else []
        sep = re.match(r"\s*(?:,\s*|T(?=\d)|t(?=\d)|\s+at\s+|@\s*|\s+)", rest)
        if sep and not frac:
            body = rest[sep.end() :]
            for kind, tp in TIMES.items():
                tm = tp.match(body)
                if tm and (us := _time_us(tm)) is not None:
                    times.append((kind, us, body[tm.end() :]))
                    break
        for name, day, rank in _dates(label, m, policy):
            for kind, us, tail in times:
                ok, in_text = _zone_tail(tail)
                if not ok:
                    continue
                where = in_text or said or given or zone_of(policy.default_zone)
                out += [(f"{name}/{kind}", at, rank + r) for at, r in _instants(day, us, where)]
    return out


def scene_text(day: str | None, clock: str | None) -> str | None:
    """A date and a time of day from two fields as one text; None where either is missing."""
    day, clock = (day or "").strip(), (clock or "").strip()
    return f"{day} {clock}" if day and clock else None
