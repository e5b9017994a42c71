"""The read API: search, filter, explode, upcoming, sort, page; detail, facets, histories.

Events have the columns of ``marquee.schemas.EVENT``; occurrences are the flat structs of functions.temporal. Every
function takes and returns DataFrames; ``opened_at`` is a parameter, so a query is a pure function of its input.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions import temporal, text, urls

SUMMARY = ("id", "title", "description", "categories", "organization", "venue", "city", "region", "cost", "audience", "accessibility")
SEARCHED = ("title", "description", "organization", "venue", "city")
ASCII = r"^[\x00-\x7F]*$"


@dataclass(frozen=True)
class ListQuery:
    """Parameters of the list query; values are checked before a plan is built."""

    opened_at: str
    query: str | None = None
    categories: Sequence[str] = ()
    regions: Sequence[str] = ()
    organizations: Sequence[str] = ()
    costs: Sequence[str] = ()
    audiences: Sequence[str] = ()
    accessibility: Sequence[str] = ()
    page: int = 1
    page_size: int = 12
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not isinstance(self.page, int) or self.page < 1:
            raise ValueError("page must be a positive integer")
        if not isinstance(self.page_size, int) or not 1 <= self.page_size <= 100:
            raise ValueError("page_size must be a whole number from 1 through 100")
        if self.query is not None and len(self.query) > 200:
            raise ValueError("query has at most 200 characters")


def in_group(c: Column, selected: Sequence[str]) -> Column:
    """No selection is no constraint; null never matches a selection."""
    return F.lit(True) if not selected else F.coalesce(c.isin(*selected), F.lit(False))


def matches_filters(q: ListQuery) -> Column:
    """AND between groups, OR within one."""
    cats = F.lit(True) if not q.categories else F.coalesce(F.exists("categories", lambda x: F.coalesce(x.isin(*q.categories), F.lit(False))), F.lit(False))
    out = cats
    for col, sel in (("region", q.regions), ("organization", q.organizations), ("cost", q.costs), ("audience", q.audiences), ("accessibility", q.accessibility)):
        out = out & in_group(F.col(col), sel)
    return out


def search(events: DataFrame, query: str | None) -> DataFrame:
    """Events with the query as a contiguous part of one field, without case and compatibility forms. Rows of pure
    ASCII stay in the JVM (NFKC leaves ASCII as it is); only the others pass through the normalising UDF."""
    needle = text.search_needle(query or "")
    if not needle:
        return events
    parts = [F.coalesce(F.col(c), F.lit("")) for c in SEARCHED] + [F.coalesce(F.array_join("categories", "\u0001"), F.lit(""))]
    hay = F.concat_ws("\u0001", *parts)
    plain = events.where(hay.rlike(ASCII)).where(F.contains(F.lower(hay), F.lit(needle)))
    other = events.where(~hay.rlike(ASCII)).withColumn("__h", text.search_text(hay)).where(F.contains("__h", F.lit(needle))).drop("__h")
    return plain.unionByName(other)


def occurrences_of(events: DataFrame) -> DataFrame:
    return events.withColumn("occurrence", F.explode("occurrences"))


def occurrence_order(event_id: Column, o: Column) -> list[Column]:
    """Local date, dates before instants, local time, event, occurrence."""
    return [temporal.occurrence_day(o), (o["kind"] != "date").cast("int"), F.when(o["kind"] == "instant", o["local_time"]).otherwise(""), event_id, o["id"]]


def matches(events: DataFrame, q: ListQuery) -> DataFrame:
    """Every (event, occurrence) that the list query matches, unordered."""
    published = events.where(F.col("publication_status") == "published")
    found = search(published, q.query).where(matches_filters(q))
    up = found.withColumn("occurrences", F.filter("occurrences", lambda o: temporal.is_upcoming(o, q.opened_at)))
    return occurrences_of(up).select(*SUMMARY, "occurrence")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page by a total order: a top-k with offset, never a full sort kept."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def list_events(events: DataFrame, q: ListQuery) -> DataFrame:
    return page(matches(events, q), occurrence_order(F.col("id"), F.col("occurrence")), q.page, q.page_size)


def totals(df: DataFrame, size: int) -> DataFrame:
    """(total_count, total_pages) of a result; an empty one has 0 pages."""
    n = F.count("*")
    return df.agg(n.alias("total_count"), F.ceil(n / F.lit(size)).cast("long").alias("total_pages"))


def page_reference(path: str, number: int, size: int) -> str:
    import re

    bare = re.sub(r"([?&])page=\d+(&?)", lambda m: m[1] if m[1] == "?" and m[2] else m[1] if m[2] else "", path)
    bare = re.sub(r"[?&]$", "", bare)
    return f"{bare}{'&' if '?' in path else '?'}page={number}&pageSize={size}"


def neighbours(path: str, number: int, size: int, total: int) -> tuple[str | None, str | None]:
    pages = math.ceil(total / size)
    return (page_reference(path, number - 1, size) if number > 1 else None, page_reference(path, number + 1, size) if number < pages else None)


def detail(events: DataFrame, event_id: str, opened_at: str) -> DataFrame:
    """The published event with its upcoming occurrences in order (perhaps none) and labelled links."""
    link = lambda c, label: F.when(F.coalesce(c, F.lit("")) != "", F.struct(c.alias("url"), F.lit(True).alias("isExternal"), F.lit(label).alias("label")))
    up = F.filter("occurrences", lambda o: temporal.is_upcoming(o, opened_at))
    keyed = F.transform(up, lambda o: F.struct(*[c.alias(f"k{i}") for i, c in enumerate(occurrence_order(F.col("id"), o))], o.alias("o")))
    ordered = F.transform(F.array_sort(keyed), lambda k: k["o"])
    return events.where((F.col("id") == event_id) & (F.col("publication_status") == "published")).select(
        *SUMMARY, ordered.alias("occurrences"), "address", "coordinates",
        link(F.col("public_source_url"), "Original source (external website)").alias("source"), link(F.col("ticket_url"), "Tickets (external website)").alias("ticket"),
    )


FACETS = ("region", "organization", "source_category", "cost", "audience", "accessibility")


def facets(events: DataFrame, columns: Sequence[str] = FACETS) -> DataFrame:
    """(facet, value): distinct non-empty values of published events. One scan: every row gives its facet pairs, and
    distinct aggregates them before the shuffle, so no set of values is gathered in one place."""
    pairs = F.concat(
        F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns]),
        F.coalesce(F.transform("categories", lambda x: F.struct(F.lit("category").alias("facet"), x.alias("value"))), F.array().cast("array<struct<facet:string,value:string>>")),
    )
    rows = events.where(F.col("publication_status") == "published").select(F.inline(pairs))
    return rows.where(F.coalesce(F.col("value"), F.lit("")) != "").distinct()


def point_lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def hydrate(parents: DataFrame, children: DataFrame, on: str, order: Sequence[str], name: str, fields: Sequence[str]) -> DataFrame:
    """parents with an ordered array of their children: children are gathered once per key, not queried per parent."""
    packed = children.groupBy(on).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias(name))
    return parents.join(packed, on, "left")


def history(history_df: DataFrame, provenance: DataFrame, event_id: str | None = None) -> DataFrame:
    """Ingestion history joined with its provenance, by retrieval time and key."""
    h = history_df if event_id is None else history_df.where(F.col("event_id") == event_id)
    return h.join(provenance, "provenance_id").orderBy("retrieved_at", "provenance_id")


def discovery_urls(sources: DataFrame) -> DataFrame:
    """Sources with the URLs of their three fields in a row: organisation, sitemap, events."""
    none = F.array().cast("array<string>")
    cols = [F.coalesce(F.col(f"{c}_urls")["values"], none) for c in ("organization", "sitemap", "event")]
    return sources.withColumn("discovery_urls", F.concat(*cols))


def entry_urls(sources: DataFrame) -> DataFrame:
    """Distinct safe URLs in the order event, sitemap, organisation."""
    none = F.array().cast("array<string>")
    cols = [F.coalesce(F.col(f"{c}_urls")["values"], none) for c in ("event", "sitemap", "organization")]
    return sources.withColumn("entry_urls", F.array_distinct(F.filter(F.concat(*cols), urls.is_safe_public_url)))


#: The audit actions that are listed.
AUDIT_ACTIONS = ("published", "rejected", "archived")


def audits(df: DataFrame) -> DataFrame:
    """Audit rows of known actions with the reason of their metadata, by time."""
    return df.where(F.col("action").isin(*AUDIT_ACTIONS)).withColumn("reason", F.get_json_object("metadata", "$.reason")).orderBy("at", "id")
