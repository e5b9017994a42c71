"""Text functions as Spark columns. Unicode normal forms are the only ones that need Python (Arrow batches)."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as ECMAScript's \\s sees it: Java's own classes miss U+00A0 and U+FEFF or add U+0085.
SPACE = r"[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
MAX_TITLE = 300


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition; null stays null."""
    return s.map(lambda v: unicodedata.normalize("NFKC", v) if isinstance(v, str) else None)


@F.pandas_udf(T.StringType())
def nfkd_base(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks U+0300 to U+036F."""
    return s.map(lambda v: "".join(c for c in unicodedata.normalize("NFKD", v) if not "̀" <= c <= "ͯ") if isinstance(v, str) else None)


def normalize_whitespace(c: Column) -> Column:
    """Trimmed, runs of white space as one blank."""
    return F.regexp_replace(F.regexp_replace(c, f"{SPACE}+", " "), r"^ | $", "")


def title_error(c: Column) -> Column:
    """invalid_length unless 1 to 300 code points remain after normalisation, else null."""
    return F.when(F.coalesce(F.char_length(normalize_whitespace(c)), F.lit(0)).between(1, MAX_TITLE), None).otherwise("invalid_length")


def identity_text(c: Column) -> Column:
    """White space normalised, NFKC, lower case; null counts as empty."""
    return F.lower(nfkc(normalize_whitespace(F.coalesce(c, F.lit("")))))


def search_text(c: Column) -> Column:
    return F.lower(nfkc(F.coalesce(c, F.lit(""))))


def search_needle(query: str) -> str:
    return unicodedata.normalize("NFKC", query.strip()).lower()


def dedupe_text(c: Column) -> Column:
    """Letters and digits of the base alphabet in lower case, one blank between runs."""
    base = F.lower(nfkd_base(normalize_whitespace(F.coalesce(c, F.lit("")))))
    return F.trim(F.regexp_replace(F.replace(base, F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def framed(*values: Column) -> Column:
    """Byte length, colon and value of each, in a row: no two lists give one string."""
    parts = [F.concat(F.octet_length(v).cast("string"), F.lit(":"), v) for v in values]
    return F.concat(*parts)


def framed_array(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)), "")


#: The named entities that are decoded.
ENTITIES = {"amp": "&", "apos": "'", "gt": ">", "lt": "<", "mdash": "—", "nbsp": " ", "ndash": "–", "quot": '"'}


@F.pandas_udf(T.StringType())
def _numeric_entities(s: pd.Series) -> pd.Series:
    import re

    def point(m: re.Match) -> str:
        n = int(m[1]) if m[1] else int(m[2], 16)
        return chr(n) if n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else m[0]

    pattern = re.compile(r"&#(?:(\d+)|[xX]([0-9a-fA-F]+));")
    return s.map(lambda v: pattern.sub(point, v) if isinstance(v, str) and "&#" in v else v)


def decode_html(c: Column, numeric: bool = True) -> Column:
    """Decimal, hexadecimal and eight named references; unknown names stay. ``numeric=False`` keeps the whole
    expression in the JVM for texts known to hold named references only."""
    out = _numeric_entities(c) if numeric else c
    named = [(f"(?i)&{k};", v) for k, v in ENTITIES.items() if k != "amp"] + [("(?i)&amp;", "&")]
    return reduce(lambda acc, kv: F.regexp_replace(acc, kv[0], kv[1].replace("$", r"\$")), named, out)


def clean_text(c: Column, numeric: bool = True) -> Column:
    """Without scripts, styles and tags, decoded, white space normalised; null if nothing is left."""
    bare = F.regexp_replace(c, r"(?is)<script\b[^>]*>.*?</script>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?is)<style\b[^>]*>.*?</style>", " "), r"<[^>]+>", " ")
    return F.nullif(normalize_whitespace(decode_html(bare, numeric)), F.lit(""))


def html_lines(c: Column, numeric: bool = True) -> Column:
    """Non-blank lines of a fragment; <br> breaks lines."""
    t = F.regexp_replace(F.regexp_replace(decode_html(c, numeric), r"(?i)<br\s*/?\s*>", "\n"), r"<[^>]+>", " ")
    return F.filter(F.transform(F.split(t, "\n"), normalize_whitespace), lambda x: x != "")


def group1(c: Column, pattern: str) -> Column:
    """The first group of the first match, null without one."""
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def meta_content(html: Column, key: str, numeric: bool = True) -> Column:
    """content of the meta tag named key, whichever attribute comes first."""
    import re

    k = re.escape(key)
    one = group1(html, rf"(?is)<meta\b[^>]*(?:property|name)=[\"']{k}[\"'][^>]*content=[\"']([^\"']+)[\"'][^>]*>")
    two = group1(html, rf"(?is)<meta\b[^>]*content=[\"']([^\"']+)[\"'][^>]*(?:property|name)=[\"']{k}[\"'][^>]*>")
    return clean_text(F.coalesce(one, two), numeric)


def decode_ics(c: Column) -> Column:
    r"""\n, \, and \; then the escaped backslash, in this order."""
    return F.replace(F.replace(F.replace(F.regexp_replace(c, r"(?i)\\n", "\n"), F.lit("\\,"), F.lit(",")), F.lit("\\;"), F.lit(";")), F.lit("\\\\"), F.lit("\\"))


#: Parts of town names by region, in order of precedence.
REGIONS = (
    ("Northern Delaware", "wilmington|newark|new castle|middletown|claymont|hockessin|arden"),
    ("Central Delaware", "dover|milford|smyrna|clayton|harrington|felton"),
    ("Southern Delaware", "rehoboth|lewes|georgetown|seaford|bethany|fenwick|milton|delmar|laurel"),
)


def region_for_city(city: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, towns in reversed(REGIONS):
        out = F.when(F.lower(city).rlike(towns), F.lit(name)).otherwise(out)
    return out


def parse_price(c: Column) -> Column:
    """Without $ and commas, a finite number of 0 or more, else null (blank too)."""
    n = F.nullif(F.trim(F.regexp_replace(c, r"[$,]", "")), F.lit("")).try_cast("double")
    return F.when((n >= 0) & (n < F.lit(float("inf"))), n)


def format_price(n: Column) -> Column:
    """Whole amounts without cents."""
    return F.when(n == F.floor(n), F.concat(F.lit("$"), n.cast("long").cast("string"))).otherwise(F.format_string("$%.2f", n))


def cost_text(low: Column, high: Column) -> Column:
    """Free, one price, a range, "From" or "Up to"; null without prices."""
    lo, hi = F.coalesce(low, high), F.coalesce(high, low)
    return (
        F.when(lo.isNull(), None)
        .when((lo == 0) & (hi == 0), "Free")
        .when(high.isNull(), F.concat(F.lit("From "), format_price(low)))
        .when(low.isNull(), F.concat(F.lit("Up to "), format_price(high)))
        .when(low == high, format_price(low))
        .otherwise(F.concat(format_price(low), F.lit("–"), format_price(high)))
    )


def offers_cost(price: Column, currency: Column) -> Column:
    """The text of a first offer: '0' is Free, US dollars get their sign, other currencies their code."""
    sign = F.when(currency == "USD", "$").when(currency.isNotNull(), F.concat(currency, F.lit(" "))).otherwise("")
    return F.when(price == "0", "Free").when(price.isNotNull() & (price != ""), F.concat(sign, price))


def quote_csv(c: Column) -> Column:
    """Quoted only where a quote, comma or line break asks for it; null is empty."""
    v = F.coalesce(c, F.lit(""))
    return F.when(v.rlike("[\",\r\n]"), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def csv_line(*cols: Column) -> Column:
    return F.concat_ws(",", *[quote_csv(c) for c in cols])


def uuid5_layout(hex32: Column) -> Column:
    """A name-based UUID's layout from 32 hex digits: version nibble 5, variant bits 10."""
    nibble = F.conv(F.substring(hex32, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex((nibble.bitwiseAND(F.lit(3))).bitwiseOR(F.lit(8)).cast("long")))
    part = lambda a, n: F.substring(hex32, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def stable_uuid(value: Column) -> Column:
    return uuid5_layout(F.substring(F.sha2(value, 256), 1, 32))


def source_id(file_name: Column, row: Column, name: Column) -> Column:
    """Stable id of a catalog row: digest of file, row and name joined by NUL."""
    return stable_uuid(F.concat_ws("\u0000", file_name, row.cast("string"), name))


def supplied_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.to_json(F.array(*parts), {"ignoreNullFields": "false"}), 256), 1, 32))


#: Keys whose values are never logged.
SENSITIVE = r"(?i)authorization|cookie|credential|csrf|password|secret|session|token"


def redact(m: Column) -> Column:
    """A map with the values of sensitive keys replaced."""
    return F.transform_values(m, lambda k, v: F.when(k.rlike(SENSITIVE), F.lit("[REDACTED]")).otherwise(v))
