"""Marks of damaged or missing text as Spark regular expressions, shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole values that stand for "nothing here".
PLACEHOLDER = (
    r"(?i)^[\s\-_.?*/#]*$|^(?:n/?a|none|null|tb[acd]|unknown|undefined|pending|various(?: locations?)?|"
    r"(?:venue|location|address|details?|time|date|place|description|information|info)?\s*(?:is |are )?(?:to be|tb) (?:announced|confirmed|determined|decided)|"
    r"(?:please )?(?:see|visit|check)(?: out)? (?:our |the )?(?:web ?site|site|web ?page|page)(?: for .{0,40})?|"
    r"(?:more|further|full)? ?(?:info(?:rmation)?|details?)(?: (?:is|are))? (?:coming )?(?:soon|to (?:come|follow))|coming soon|same as above)[.!]?$"
)
#: Ends of teasers: the rest was left behind a link.
TEASER_END = r"(?i)(?:\.\.+|…|\[(?:click|read|see|view|continue)[^\]]*\]|(?:read|see|show|view|learn) more|continue reading)\s*[»>→…]*\s*$"
#: A sentence's end, possibly quoted or bracketed.
SENTENCE_END = r"[.!?。][\"”’'»)\]]*\s*$"
#: Phrases that only error pages, script notices or unedited templates hold at the start of a sentence.
SYSTEM_SENTENCE = (
    r"(?i)(?:^|[.!?)\]\d]\s+|\n\s*|[a-z]\s)(?:"
    r"\d{3} (?:not found|internal server error|- forbidden|bad gateway|service unavailable)|service unavailable|gateway timed out after|"
    r"error \d+: the page|erreur \d+ ?: cette page|seite nicht gefunden|página no encontrada|"
    r"(?:please enable|bitte) javascript|veuillez activer javascript|active el javascript|javascript is required to|this page needs scripts|"
    r"loading\.\.\. if this message|noscript:|your browser does not support|you need to allow cookies|we have detected that script|"
    r"checking your browser before|your session has expired|access denied\. incident|too many requests\. slow|"
    r"could not connect to the data|oops! something went wrong|sorry, this calendar entry|fatal error: call to|warning: undefined index|"
    r"traceback: |the server is temporarily unable)"
)


def is_blankish(c: Column) -> Column:
    """Null, blank or a whole-value placeholder."""
    return c.isNull() | F.trim(c).rlike(PLACEHOLDER)


def is_whole_prose(c: Column) -> Column:
    """Prose that ends as prose does and holds no system sentence; false for null."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.coalesce(~is_blankish(c) & t.rlike(SENTENCE_END) & ~t.rlike(TEASER_END) & ~t.rlike(SYSTEM_SENTENCE) & t.rlike(r"\S\s+\S+\s+\S"), F.lit(False))


def real_part(address: Column, key: str, shape: str) -> Column:
    """True where address[key] is no placeholder and has the given shape."""
    v = F.trim(address[key])
    return F.coalesce(~is_blankish(v) & v.rlike(shape), F.lit(False))


def is_whole_address(address: Column) -> Column:
    """Real values for street, city, state and postalCode."""
    return (
        real_part(address, "street", r"\d.*\p{L}{2}|\p{L}{2}.*\d")
        & real_part(address, "city", r"\p{L}{2}")
        & real_part(address, "state", r"^\p{L}[\p{L}.\s]+$")
        & real_part(address, "postalCode", r"^\d{5}(?:-?\d{4})?$")
    )
