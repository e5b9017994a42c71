"""Queries of the core data problems: rows that fail to parse (3), packed values (4), mixed timestamps (7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions.moments import Policy
from marquee.operators.packed_values import learn_codes, split_packed
from marquee.operators.row_loading import CATALOG_HEADER, PARTNER_HEADER, load_rows
from marquee.operators.timestamps import normalise
from marquee.session import read_table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, reason) of every record that cannot become a CsvRow."""
    return load_rows(read_table(spark, sf_dir, "csv_rows")).where(F.col("parsed_reason").isNotNull()).select("row_id", F.col("parsed_reason").alias("reason"))


def p3_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loaded records of both layouts, fields in order, headers and blank records left out."""
    loaded = load_rows(read_table(spark, sf_dir, "csv_rows")).where("parsed_kind = 'record'")
    return loaded.select("row_id", "file_name", "physical_row", F.size("parsed_fields").alias("n_fields"), F.to_json("parsed_fields").alias("fields_json"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field_name, record_id, pos, item) of every field that holds more than one value."""
    sources = read_table(spark, sf_dir, "source_records")
    pairs = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("packed")) for c in ("organization_url", "events_page")])
    urls = sources.select(F.col("id").alias("record_id"), F.inline(pairs)).select("field_name", "record_id", "packed").distinct()
    cats = read_table(spark, sf_dir, "scene_inputs").select(F.lit("categories").alias("field_name"), F.col("input_id").alias("record_id"), F.col("categories").alias("packed")).distinct()
    names = read_table(spark, sf_dir, "category_items").select("category_id", "category_name")
    url_codes = learn_codes(urls, F.col("packed"), "url")
    cat_codes = learn_codes(cats, F.col("packed"), "category", names)
    both = split_packed(urls, "packed", url_codes).unionByName(split_packed(cats, "packed", cat_codes))
    return both.where("n_values > 1").select("field_name", "record_id", "pos", "item")


def _feeds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both occurrence tables with the feed that wrote them: the event's source, the partner file."""
    events = read_table(spark, sf_dir, "event_records").select(F.col("id").alias("event_id"), F.col("source_record_id").alias("feed")).groupBy("event_id").agg(F.min("feed").alias("feed"))
    files = read_table(spark, sf_dir, "scene_inputs").select("input_id", F.col("file_name").alias("feed")).groupBy("input_id").agg(F.min("feed").alias("feed"))
    raw = read_table(spark, sf_dir, "raw_occurrences").select("event_id", "received_at", "occ_key", "start_text", "source_timezone").join(events, "event_id", "left")
    day, clock = F.trim("start_date"), F.trim("start_time")
    text = F.when((day != "") & (clock != ""), F.concat(day, F.lit(" "), clock)).alias("start_text")
    scene = read_table(spark, sf_dir, "scene_occurrences").select("input_id", "physical_row", "occ_key", text).join(files, "input_id", "left")
    return raw, scene


def _decoded(spark: SparkSession, sf_dir: str, policy: Policy) -> DataFrame:
    """(occ_key, label, start_us): both tables, decoded along each feed in the order of its records."""
    raw, scene = _feeds(spark, sf_dir)
    found = normalise(raw, "feed", ["received_at"], "occ_key", "start_text", "source_timezone", policy).unionByName(normalise(scene, "feed", ["physical_row"], "occ_key", "start_text", None, policy))
    return found.where(F.col("start_us").isNotNull()).groupBy("occ_key").agg(F.min(F.struct("start_us", "label")).alias("r")).select("occ_key", "r.label", "r.start_us")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(occ_key, start_us) of every occurrence that gives an instant. The project's rules are the emission costs."""
    return _decoded(spark, sf_dir, Policy()).select("occ_key", "start_us")


def p7_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(occ_key, label, start_us) where day-first and month-first are left to the feed's run of formats and times."""
    return _decoded(spark, sf_dir, Policy("either", "either"))


QUERIES = {"p3_found": p3_found, "p3_loaded": p3_loaded, "p4_found": p4_found, "p7_found": p7_found, "p7_open": p7_open}

_HOST = r"(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?::\d{1,5})?(?:[/?#]\S*)?"
_FIELD = r'"(?:[^"]|"")*"|[^",\r\n]*'
_PARTNER_HEADER = ", ".join(f"'{n}'" for n in PARTNER_HEADER)
_CATALOG_HEADER = ", ".join(f"'{n}'" for n in CATALOG_HEADER)


def _full(i: int, pattern: str, blank: bool) -> str:
    return f"({f'f[{i}] = {chr(39)*2} OR ' if blank else ''}regexp_full_match(f[{i}], '{pattern}'))"


def _us(i: int, blank: bool) -> str:
    return f"({f'f[{i}] = {chr(39)*2} OR ' if blank else ''}(regexp_full_match(f[{i}], '\\d{{2}}/\\d{{2}}/\\d{{4}}') AND try_strptime(f[{i}], '%m/%d/%Y') IS NOT NULL))"


def _urls(i: int) -> str:
    pieces = f"list_filter(list_transform(string_split(f[{i}], ';'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '')"
    return f"(len({pieces}) > 0 AND len(list_filter({pieces}, lambda p: NOT regexp_full_match(p, '(?i)(?:https?://)?{_HOST}'))) = 0)"


_CLOCK = r"(?i)(?:1[0-2]|0?[1-9]):[0-5][0-9]\s*[ap]\.?m\.?"
_PARTNER_OK = " AND ".join(
    [
        "(regexp_full_match(f[1], '[0-9]+') OR (f[1] = '' AND f[3] = ''))", _full(2, "[0-9]+", True), _full(5, f"(?i)https?://{_HOST}", True), _full(7, r"[0-9]+(?:\.[0-9]+)?", True), _full(8, r"[0-9]+(?:\.[0-9]+)?", True),
        _us(9, False), _full(10, _CLOCK, True), _us(11, True), _full(12, f"(?i)https?://{_HOST}", True),
    ]
)
_CATALOG_OK = f"f[1] <> '' AND {_urls(2)} AND (f[3] IN ('', 'NKS') OR {_urls(3)}) AND (f[4] IN ('', 'NKS') OR {_urls(4)})"

ORACLES = {
    "p3_found": rf"""WITH t AS (SELECT row_id, file_name, regexp_replace(regexp_replace(raw_text, '^\x{{FEFF}}', ''), '\r?\n?$', '') AS t FROM csv_rows),
    w AS (SELECT *, regexp_full_match(t, '(?s)(?:{_FIELD})(?:,(?:{_FIELD}))*') AS well, list_transform(regexp_extract_all(',' || t, '(?s),({_FIELD})', 1),
      lambda x: regexp_replace(CASE WHEN starts_with(x, '"') THEN replace(x[2:len(x) - 1], '""', '"') ELSE x END, '^\s+|\s+$', '', 'g')) AS f FROM t),
    j AS (SELECT row_id, CASE WHEN NOT well THEN 'broken_quoting' WHEN len(list_filter(f, lambda x: x <> '')) = 0 THEN NULL
      WHEN len(f) <> CASE WHEN starts_with(file_name, 'partner_') THEN 13 ELSE 4 END THEN 'column_count'
      WHEN f = [{_PARTNER_HEADER}] OR f = [{_CATALOG_HEADER}] THEN NULL
      WHEN starts_with(file_name, 'partner_') THEN CASE WHEN {_PARTNER_OK} THEN NULL ELSE 'invalid_value' END
      ELSE CASE WHEN {_CATALOG_OK} THEN NULL ELSE 'invalid_value' END END AS reason FROM w)
    SELECT row_id, reason FROM j WHERE reason IS NOT NULL""",
}
