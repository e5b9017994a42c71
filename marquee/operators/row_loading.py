"""Rows that fail to parse: separates them with the reason and loads the rest as typed records.

Layouts are data: width, column names and a rule per column. ``load_rows`` keeps every input column beside its
own (prefix ``parsed_``), so clashing names never collide.

Defined cases: null text gives reason ``missing_text``; an empty text is a record of one blank field, and a record
whose fields are all blank is valid whatever its width; a file of no known layout gives ``unknown_layout``; repeated
rows are judged each for itself; an empty table gives an empty table; texts of any length are parsed whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.sources.csv_grammar import parse_one

BROKEN, WIDTH, VALUE = "broken_quoting", "column_count", "invalid_value"
UNKNOWN, MISSING = "unknown_layout", "missing_text"

_DIGITS = re.compile(r"[0-9]+")
_PRICE = re.compile(r"[0-9]+(?:\.[0-9]+)?")
_US_DATE = re.compile(r"([0-9]{2})/([0-9]{2})/([0-9]{4})")
_CLOCK = re.compile(r"(1[0-2]|0?[1-9]):[0-5][0-9]\s*[ap]\.?m\.?", re.I)
_WEB = re.compile(r"https?://([^\s/?#]+)(?:[/?#]\S*)?", re.I)
_SCHEME = re.compile(r"[a-z][a-z0-9+.-]*:", re.I)
_HOST = re.compile(r"(?:(?!-)[a-z0-9¡-￿-]{1,63}(?<!-)\.)+(?!-)[a-z0-9¡-￿-]{1,63}(?<!-)(?::[0-9]{1,5})?", re.I)


def blank(v: str) -> bool:
    return not v.strip()


def digits(v: str) -> bool:
    return bool(_DIGITS.fullmatch(v.strip()))


def price(v: str) -> bool:
    return bool(_PRICE.fullmatch(v.strip()))


def us_date(v: str) -> bool:
    m = _US_DATE.fullmatch(v.strip())
    if not m:
        return False
    try:
        date(int(m[3]), int(m[1]), int(m[2]))
    except ValueError:
        return False
    return True


def clock(v: str) -> bool:
    return bool(_CLOCK.fullmatch(v.strip()))


def web_url(v: str) -> bool:
    """http(s) with a dotted, well formed host and no user part."""
    m = _WEB.fullmatch(v.strip())
    return bool(m and _HOST.fullmatch(m[1]))


def loose_url(v: str) -> bool:
    """web_url, where the scheme may be missing."""
    v = v.strip()
    return web_url(v if re.match(r"https?://", v, re.I) else v if _SCHEME.match(v) and not re.match(r"[^:/?#]+:[0-9]+(?:[/?#]|$)", v) else f"https://{v}")


def url_list(v: str) -> bool:
    """One or more loose URLs, split at semicolons; empty pieces count for nothing."""
    pieces = [p for p in v.split(";") if p.strip()]
    return bool(pieces) and all(map(loose_url, pieces))


def optional(rule: Callable[[str], bool]) -> Callable[[str], bool]:
    return lambda v: blank(v) or rule(v)


def tri_state(v: str) -> bool:
    return blank(v) or v.strip() == "NKS" or url_list(v)


@dataclass(frozen=True)
class Layout:
    """names of the columns, a rule by column name, and a rule on the whole record (fields by name)."""

    names: tuple[str, ...]
    rules: dict[str, Callable[[str], bool]]
    record_rule: Callable[[dict[str, str]], bool] = lambda r: True


#: The headers of the two feeds.
PARTNER_HEADER = (
    "venue ID", "presenter ID (if different)", "title of program", "categories", "URL", "box office phone",
    "low price", "high price", "start date", "start time", "end date", "ticket URL", "description",
)
CATALOG_HEADER = ("Organization Name", "Organization URL", "Sitemap", "Event Page")

PARTNER = Layout(
    PARTNER_HEADER,
    {
        "presenter ID (if different)": optional(digits),
        "URL": optional(web_url),
        "low price": optional(price),
        "high price": optional(price),
        "start date": us_date,
        "start time": optional(clock),
        "end date": optional(us_date),
        "ticket URL": optional(web_url),
    },
    lambda r: digits(r["venue ID"]) or (blank(r["venue ID"]) and blank(r["title of program"])),
)
CATALOG = Layout(
    CATALOG_HEADER,
    {
        "Organization Name": lambda v: not blank(v),
        "Organization URL": url_list,
        "Sitemap": tri_state,
        "Event Page": tri_state,
    },
)
LAYOUTS = {"partner_": PARTNER, "catalog_": CATALOG}

PARSED = T.StructType(
    [
        T.StructField("parsed_reason", T.StringType()),
        T.StructField("parsed_column", T.StringType()),
        T.StructField("parsed_error", T.StringType()),
        T.StructField("parsed_error_line", T.IntegerType()),
        T.StructField("parsed_error_offset", T.IntegerType()),
        T.StructField("parsed_kind", T.StringType()),
        T.StructField("parsed_fields", T.ArrayType(T.StringType())),
    ]
)


def judge(text: str | None, layout: Layout | None, line: int = 1) -> tuple:
    """(reason, offending column, syntax code, its line, its offset, kind, fields) of one record's text; reason is
    None for a loaded row. kind: header, blank, record or rejected."""
    if layout is None:
        return UNKNOWN, None, None, None, None, "rejected", None
    if text is None:
        return MISSING, None, None, None, None, "rejected", None
    rec = parse_one(text, len(layout.names))
    if rec.issues:
        i = rec.issues[0]
        return BROKEN, None, i.code, line + i.line - 1, i.offset, "rejected", rec.fields
    if all(map(blank, rec.fields)):
        return None, None, None, None, None, "blank", rec.fields
    if len(rec.fields) != len(layout.names):
        return WIDTH, None, None, None, None, "rejected", rec.fields
    if tuple(f.strip() for f in rec.fields) == layout.names:
        return None, None, None, None, None, "header", rec.fields
    by_name = dict(zip(layout.names, rec.fields, strict=True))
    for name, rule in layout.rules.items():
        if not rule(by_name[name]):
            return VALUE, name, None, None, None, "rejected", rec.fields
    if not layout.record_rule(by_name):
        return VALUE, layout.names[0], None, None, None, "rejected", rec.fields
    return None, None, None, None, None, "record", rec.fields


def load_rows(
    df: DataFrame,
    text_col: str = "raw_text",
    file_col: str = "file_name",
    line_col: str = "physical_row",
    layouts: dict[str, Layout] | None = None,
) -> DataFrame:
    """df with the columns of PARSED: one narrow pass in Arrow batches, no shuffle."""
    layouts = layouts or LAYOUTS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, name, line in zip(pdf["t"], pdf["f"], pdf["l"], strict=True):
                name = name if isinstance(name, str) else ""
                layout = next((v for k, v in layouts.items() if name.startswith(k)), None)
                out.append(judge(text if isinstance(text, str) else None, layout, 1 if pd.isna(line) else int(line)))
            yield pd.DataFrame(out, columns=PARSED.names, index=pdf.index)

    @F.pandas_udf(PARSED)
    def parse(it: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        return run(pd.DataFrame({"t": t, "f": f, "l": n}) for t, f, n in it)

    struct = parse(F.col(text_col), F.col(file_col), F.col(line_col).cast("int"))
    return df.withColumn("parsed", struct).select(*[c for c in df.columns if c not in PARSED.names], "parsed.*")


def rejected(loaded: DataFrame) -> DataFrame:
    return loaded.where(F.col("parsed_reason").isNotNull())


def typed_records(loaded: DataFrame, layout: Layout, prefix: str, file_col: str = "file_name") -> DataFrame:
    """The loaded records of one layout with a column per field (header names in snake case)."""
    names = [re.sub(r"[^a-z0-9]+", "_", n.lower()).strip("_") for n in layout.names]
    keep = [c for c in loaded.columns if c not in PARSED.names and c not in names]
    return loaded.where((F.col("parsed_kind") == "record") & F.col(file_col).startswith(prefix)).select(
        *keep, *[F.col("parsed_fields")[i].alias(n) for i, n in enumerate(names)]
    )
