"""Catalog files of event sources: strict scan, canonical form, replacement by category, discovery and adapters."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import text, urls
from marquee.sources.csv_grammar import parse_file

#: Accepted header names per column, and categories whose file may be empty.
HEADERS = (("Organization Name",), ("Organization URL",), ("Site Map", "Sitemap"), ("Events", "Event Page"))
CANONICAL_HEADER = ("Category", "Organization Name", "Organization URL", "Sitemap", "Event Page")
MAY_BE_EMPTY = ("library", "government")
MAX_DISCOVERED = 100
PARSED = "file_name string, physical_row int, fields array<string>, code string"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, bytes, sha256, valid_utf8, body) of the files under path; a leading byte-order mark is dropped."""
    raw = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ok = F.is_valid_utf8(F.col("content"))
    body = F.when(ok, F.regexp_replace(F.decode("content", "UTF-8"), r"^\x{FEFF}", ""))
    return raw.select(name.alias("file_name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), ok.alias("valid_utf8"), body.alias("body"))


def file_rows(files: DataFrame) -> DataFrame:
    """Records of whole files (file_name, physical_row, fields, code): the strict grammar with located errors. Line
    ends inside quoted fields become LF."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, body in zip(pdf["file_name"], pdf["body"], strict=True):
                for r in parse_file(body or ""):
                    fields = [f.replace("\r\n", "\n").replace("\r", "\n") for f in r.fields]
                    out.append((name, r.issues[0].line if r.issues else r.line, fields, r.issues[0].code if r.issues else None))
            yield pd.DataFrame(out, columns=["file_name", "physical_row", "fields", "code"])

    return files.select("file_name", "body").mapInPandas(run, PARSED)


def scan_catalog(files: DataFrame, categories: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of catalog files whose names are the keys of categories. A file with any error gives no
    records; errors are (file_name, physical_row, path, code) and ordered so by the caller."""
    known = F.create_map(*[F.lit(x) for kv in categories.items() for x in kv])
    files = files.withColumn("category", F.get(F.transform(F.array(F.col("file_name")), lambda n: F.try_element_at(known, n)), F.lit(0)))
    err = lambda df, path, code: df.select("file_name", F.lit(1).alias("physical_row"), F.lit(path).alias("path"), F.lit(code).alias("code"))
    unknown = err(files.where("category is null"), "file", "unknown_catalog_file")
    bad_bytes = err(files.where("category is not null and not valid_utf8"), "file", "invalid_encoding")
    good = files.where("category is not null and valid_utf8")
    empty = err(good.where((F.col("body") == "") & ~F.col("category").isin(*MAY_BE_EMPTY)), "header", "missing_header")
    rows = file_rows(good.where("body != ''")).join(good.select("file_name", "category"), "file_name")
    broken = rows.where("code is not null").select("file_name", "physical_row", F.lit("csv").alias("path"), F.lit("invalid_csv").alias("code"))
    heads = rows.where("code is null").groupBy("file_name").agg(F.min_by("fields", "physical_row").alias("h"), F.min("physical_row").alias("head_row"))
    heads = heads.withColumn("h", F.transform("h", lambda x: F.trim(x)))
    index = lambda names: F.coalesce(*[F.nullif(F.array_position("h", F.lit(n)), F.lit(0)) for n in names]).cast("int")
    heads = heads.select("file_name", "head_row", F.size("h").alias("width"), *[index(n).alias(f"i{k}") for k, n in enumerate(HEADERS)])
    missing = heads.select("file_name", F.lit(1).alias("physical_row"), F.explode(F.filter(F.array(*[F.when(F.col(f"i{k}").isNull(), n[-1]) for k, n in enumerate(HEADERS)]), lambda x: x.isNotNull())).alias("path"), F.lit("missing_column").alias("code"))
    data = rows.where("code is null").join(heads, "file_name").where("physical_row > head_row").where(F.exists("fields", lambda f: F.trim(f) != ""))
    width = data.where(F.size("fields") != F.col("width")).select("file_name", "physical_row", F.lit("csv").alias("path"), F.lit("invalid_csv").alias("code"))
    cell = lambda k: F.coalesce(F.get(F.col("fields"), F.col(f"i{k}") - 1), F.lit(""))
    typed = data.where(F.size("fields") == F.col("width")).select(
        "file_name", "physical_row", "category", F.trim(cell(0)).alias("organization_name"),
        urls.url_field(cell(1), True).alias("organization_urls"), urls.url_field(cell(2)).alias("sitemap_urls"), urls.url_field(cell(3)).alias("event_urls"),
    )
    tagged = lambda c, path: F.transform(F.col(c)["errors"], lambda e: F.struct(F.lit(path).alias("path"), F.substring_index(e, ":", 1).alias("code")))
    no_name = F.when(F.col("organization_name") == "", F.array(F.struct(F.lit("Organization Name").alias("path"), F.lit("missing_required_field").alias("code")))).otherwise(F.array().cast("array<struct<path:string,code:string>>"))
    values = typed.select("file_name", "physical_row", F.inline(F.concat(no_name, tagged("organization_urls", "Organization URL"), tagged("sitemap_urls", "Sitemap"), tagged("event_urls", "Event Page"))))
    errors = unknown.unionByName(bad_bytes).unionByName(empty).unionByName(broken).unionByName(missing).unionByName(width).unionByName(values)
    records = typed.join(errors.select("file_name").distinct(), "file_name", "left_anti")
    sid = text.source_id(F.col("file_name"), F.col("physical_row"), F.col("organization_name"))
    return records.select(sid.alias("id"), F.col("file_name").alias("catalog_file_name"), "physical_row", F.col("category").alias("source_category"), "organization_name", "organization_urls", "sitemap_urls", "event_urls", F.lit("enabled").alias("collection_state")), errors


def error_order() -> list[Column]:
    return [F.col("physical_row"), F.col("path"), F.col("code")]


def canonical_lines(records: DataFrame) -> DataFrame:
    """(position, line) of the canonical catalog, header first; lines end with CRLF when written."""
    field = lambda c: urls.url_field_text(F.col(c)["kind"], F.col(c)["values"])
    line = text.csv_line(F.col("source_category"), F.col("organization_name"), field("organization_urls"), field("sitemap_urls"), field("event_urls"))
    body = records.select(F.struct("catalog_file_name", "physical_row", "organization_name").alias("position"), line.alias("line"))
    head = records.sparkSession.range(1).select(F.struct(F.lit("").alias("catalog_file_name"), F.lit(0).alias("physical_row"), F.lit("").alias("organization_name")).alias("position"), F.lit(",".join(CANONICAL_HEADER)).alias("line"))
    return head.unionByName(body).orderBy("position")


def scan_canonical(files: DataFrame, file_names: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of canonical catalogs (category in the first column). A record's id is that of the catalog file
    its category belongs to (file_names: category to file), so a catalog that was written and read keeps its ids."""
    rows = file_rows(files.select("file_name", "body"))
    name = F.get(F.transform(F.array(F.get("fields", F.lit(0))), lambda c: F.try_element_at(F.create_map(*[F.lit(x) for kv in file_names.items() for x in kv]), F.trim(c))), F.lit(0))
    head = F.array(*[F.lit(h) for h in CANONICAL_HEADER])
    rows = rows.withColumn("heading", (F.col("physical_row") == 1) & (F.col("fields") == head)).withColumn("catalog", name)
    first = rows.where("physical_row = 1 and not heading").select("file_name", "physical_row", F.lit("header").alias("path"), F.lit("missing_header").alias("code"))
    body = rows.where("not heading and physical_row > 1").where(F.col("code").isNotNull() | F.exists("fields", lambda f: F.trim(f) != ""))
    shape = F.when(F.col("code").isNotNull() | (F.size("fields") != len(CANONICAL_HEADER)), F.struct(F.lit("csv").alias("path"), F.lit("invalid_csv").alias("code"))).when(F.col("catalog").isNull(), F.struct(F.lit("Category").alias("path"), F.lit("unknown_category").alias("code")))
    cell = lambda k: F.coalesce(F.get(F.col("fields"), F.lit(k)), F.lit(""))
    typed = body.select("file_name", "physical_row", shape.alias("shape"), "catalog", F.trim(cell(0)).alias("source_category"), F.trim(cell(1)).alias("organization_name"), urls.url_field(cell(2), True).alias("organization_urls"), urls.url_field(cell(3)).alias("sitemap_urls"), urls.url_field(cell(4)).alias("event_urls"))
    none = F.array().cast("array<struct<path:string,code:string>>")
    tagged = lambda c, path: F.transform(F.col(c)["errors"], lambda e: F.struct(F.lit(path).alias("path"), F.substring_index(e, ":", 1).alias("code")))
    unnamed = F.when(F.col("organization_name") == "", F.array(F.struct(F.lit("Organization Name").alias("path"), F.lit("missing_required_field").alias("code")))).otherwise(none)
    faults = F.when(F.col("shape").isNotNull(), F.array("shape")).otherwise(F.concat(unnamed, tagged("organization_urls", "Organization URL"), tagged("sitemap_urls", "Sitemap"), tagged("event_urls", "Event Page")))
    errors = first.unionByName(typed.select("file_name", "physical_row", F.inline(faults)))
    good = typed.join(errors.select("file_name").distinct(), "file_name", "left_anti")
    sid = text.source_id(F.col("catalog"), F.col("physical_row"), F.col("organization_name"))
    return good.select(sid.alias("id"), F.col("catalog").alias("catalog_file_name"), "physical_row", "source_category", "organization_name", "organization_urls", "sitemap_urls", "event_urls", F.lit("enabled").alias("collection_state")), errors


def write_canonical(records: DataFrame, path: str) -> None:
    """One text file with CRLF line ends, by Spark's commit protocol. A catalog is small: one row per source."""
    canonical_lines(records).select("line").coalesce(1).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def preserve_state(incoming: DataFrame, previous: DataFrame) -> DataFrame:
    """incoming with the collection state that the same id had before; new ids are enabled."""
    old = previous.select("id", F.col("collection_state").alias("__old"))
    return incoming.join(old, "id", "left").withColumn("collection_state", F.coalesce("__old", F.lit("enabled"))).drop("__old")


def replace_category(current: DataFrame, incoming: DataFrame, category: str) -> DataFrame:
    """current with one category's rows replaced; other categories stay."""
    kept = current.where(F.col("source_category") != category)
    return kept.unionByName(preserve_state(incoming, current))


def write_categories(records: DataFrame, path: str) -> None:
    """Only the categories at hand are overwritten (dynamic partition overwrite)."""
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_category").parquet(path)


def list_sources(sources: DataFrame, url_rows: DataFrame) -> DataFrame:
    """Sources with URL fields put together from child rows (source_id, field, kind, ordinal, url), in order."""
    packed = url_rows.groupBy("source_id", "field").agg(F.first("kind").alias("kind"), F.transform(F.array_sort(F.collect_list(F.when(F.col("url").isNotNull(), F.struct("ordinal", "url")))), lambda x: x["url"]).alias("values"))
    by_source = packed.groupBy(F.col("source_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("kind", "values")))).alias("fields"))
    return sources.join(by_source, "id", "left").orderBy("catalog_file_name", "physical_row")


def select_discovery(url_array: Column, enabled: Column, most: int = MAX_DISCOVERED) -> Column:
    """struct(urls, omitted): distinct URLs in order of appearance, the first ``most``; nothing of a disabled source."""
    d = F.array_distinct(url_array)
    none = F.array().cast("array<string>")
    return F.when(enabled, F.struct(F.slice(d, 1, most).alias("urls"), F.greatest(F.size(d) - most, F.lit(0)).alias("omitted"))).otherwise(F.struct(none.alias("urls"), F.lit(0).alias("omitted")))


class AdapterRegistry:
    """Adapters by key, in order; each is a predicate over the columns of a row, given as a Spark column."""

    def __init__(self, adapters: Sequence[tuple[str, Callable[[DataFrame], Column]]]):
        keys = [k for k, _ in adapters]
        if len(set(keys)) != len(keys):
            raise ValueError("adapter keys must be unique")
        self.adapters = tuple(adapters)

    def resolve(self, df: DataFrame) -> DataFrame:
        """df with adapter_status (unsupported, selected, conflict) and the keys that apply, in registry order."""
        hits = F.filter(F.array(*[F.when(F.coalesce(p(df), F.lit(False)), F.lit(k)) for k, p in self.adapters]), lambda x: x.isNotNull())
        status = F.when(F.size(hits) == 0, "unsupported").when(F.size(hits) == 1, "selected").otherwise("conflict")
        return df.withColumn("adapter_keys", hits).withColumn("adapter_status", status)


def traverse(pages: DataFrame, order: Sequence[str], most: int) -> tuple[DataFrame, DataFrame]:
    """(the first ``most`` pages, one row telling whether the limit was reached)."""
    if not 1 <= most <= 1000:
        raise ValueError("a traversal takes 1 to 1000 pages")
    return pages.orderBy(*order).limit(most), pages.limit(most + 1).agg((F.count("*") > most).alias("limit_reached"))
