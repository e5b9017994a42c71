"""Queries of this subpackage and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import addresses, leakage, mixing, names, residue, survivorship, textmarks, truncation
from marquee.session import read_table


def _duplicate_cells(spark: SparkSession, sf_dir: str, with_values: bool) -> DataFrame:
    """Cells of the identities of event_records, with flags for description and address."""
    events = read_table(spark, sf_dir, "event_records")
    latest = F.array_max(F.transform("provenance", lambda p: p["retrieved_at"]))
    slim = events.where(F.col("canonical_identity").isNotNull()).select(
        "canonical_identity", "id", "description", "address", latest.alias("retrieved"), textmarks.is_whole_prose(F.col("description")).alias("whole"),
        F.when(F.col("source_category") == "government", 1).otherwise(0).alias("trust"),
    )
    slim = survivorship.mark_prefix_cuts(slim, "canonical_identity", "description", "whole")
    good = {"description": F.col("whole"), "address": textmarks.is_whole_address(F.col("address"))}
    carry = {"description": F.col("description"), "address": F.col("address")} if with_values else None
    return survivorship.cells(slim, "canonical_identity", "id", good, F.col("retrieved"), F.col("trust"), carry)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(canonical_identity, description_event_id, address_event_id) of every identity with two ids or more, by the
    skyline of each field under a policy that puts recency before trust."""
    won = survivorship.field_winners(_duplicate_cells(spark, sf_dir, False), "canonical_identity", ["description", "address"])
    return won.select("canonical_identity", F.col("description_id").alias("description_event_id"), F.col("address_id").alias("address_event_id"))


def p6_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One surviving record per identity, its fields filled through the dominance layers."""
    out = survivorship.survivors(_duplicate_cells(spark, sf_dir, True), "canonical_identity", ["description", "address"])
    return out.withColumn("address", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("address")))))


def p9_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, tokens, repeats) of the mix that meets mix_targets."""
    return mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every source."""
    return mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id) of every document whose text was cut."""
    return truncation.judge(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")).where("cut").select("doc_id")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source truncates."""
    return truncation.rates(truncation.judge(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hint_id_a, hint_id_b) of every two hints that stand for one building."""
    hints = read_table(spark, sf_dir, "location_hints").select("hint_id", "address", "venue", "city")
    return addresses.same_place(hints, "hint_id").select(F.col("id_a").alias("hint_id_a"), F.col("id_b").alias("hint_id_b"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hint_id, place): every hint that names a place with the class of its building."""
    return addresses.place_classes(read_table(spark, sf_dir, "location_hints").select("hint_id", "address", "venue", "city"), "hint_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(extracted_id) of every record that holds residue, filler or error text in place of event content."""
    return residue.records(read_table(spark, sf_dir, "extracted_events"), "extracted_id", ["title", "description"]).select("extracted_id")


def _name_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "event_records").select(F.col("organization").alias("name"))
    sources = read_table(spark, sf_dir, "source_records").select(F.col("organization_name").alias("name"))
    return names.classes(events.unionByName(sources), "name")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name_a, name_b) of every two spellings that name the same organisation or person."""
    return names.pairs_of(_name_classes(spark, sf_dir))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with its uses and the spelling that its class goes by."""
    return _name_classes(spark, sf_dir)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of every document that carries half of an item or more."""
    return leakage.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


QUERIES = {"p9_chosen": p9_chosen, "p9_shares": p9_shares, "p1_found": p1_found, "p1_classes": p1_classes, "p5_found": p5_found, "p5_classes": p5_classes, "p2_found": p2_found, "p8_found": p8_found, "p10_found": p10_found, "p10_rates": p10_rates, "p6_found": p6_found, "p6_survivors": p6_survivors}


def _sql(pattern: str) -> str:
    """A pattern of textmarks inside a SQL string."""
    return pattern.replace("'", "''")


def _real(key: str, shape: str) -> str:
    v = f"trim(address['{key}'])"
    return f"(coalesce({v}, '') <> '' AND NOT regexp_matches({v}, '{_sql(textmarks.PLACEHOLDER)}') AND regexp_matches({v}, '{_sql(shape)}'))"


_WHOLE = rf"""(d IS NOT NULL AND NOT regexp_matches(trim(d), '{_sql(textmarks.PLACEHOLDER)}') AND regexp_matches(t, '{_sql(textmarks.SENTENCE_END)}') AND NOT regexp_matches(t, '{_sql(textmarks.TEASER_END)}')
  AND NOT regexp_matches(t, '{_sql(textmarks.SYSTEM_SENTENCE)}') AND regexp_matches(t, '\S\s+\S+\s+\S'))"""
_ADDRESS = " AND ".join([_real("street", r"\d.*\p{L}{2}|\p{L}{2}.*\d"), _real("city", r"\p{L}{2}"), _real("state", r"^\p{L}[\p{L}.\s]+$"), _real("postalCode", r"^\d{5}(?:-?\d{4})?$")])

ORACLES: dict[str, str] = {
    "p6_found": rf"""WITH e AS (SELECT DISTINCT canonical_identity AS k, id, description AS d, trim(regexp_replace(description, '\s+', ' ', 'g')) AS t, list_max(list_transform(provenance, lambda p: p.retrieved_at)) AS seen, CASE WHEN source_category = 'government' THEN 1 ELSE 0 END AS trust,
      CASE WHEN address IS NOT NULL AND {_ADDRESS} THEN 1 ELSE 0 END AS good_address FROM event_records WHERE canonical_identity IS NOT NULL),
    w AS (SELECT *, {_WHOLE} AS whole FROM e),
    g AS (SELECT *, whole AND NOT EXISTS (SELECT 1 FROM w o WHERE o.k = w.k AND o.whole AND length(o.d) > length(w.d) AND starts_with(o.d, w.d)) AS good FROM w),
    n AS (SELECT k FROM g GROUP BY k HAVING count(DISTINCT id) > 1),
    de AS (SELECT k, id, row_number() OVER (PARTITION BY k ORDER BY seen DESC, trust DESC, id) AS rn FROM g WHERE good), ad AS (SELECT k, id, row_number() OVER (PARTITION BY k ORDER BY seen DESC, trust DESC, id) AS rn FROM g WHERE good_address = 1)
    SELECT n.k AS canonical_identity, de.id AS description_event_id, ad.id AS address_event_id FROM n LEFT JOIN de ON de.k = n.k AND de.rn = 1 LEFT JOIN ad ON ad.k = n.k AND ad.rn = 1""",
}
