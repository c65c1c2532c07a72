"""Reading and writing page snapshots, site results and reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftaudit.functions import urls

PAGES_RAW = "page_id bigint, site string, url string, html string, status_code bigint, depth bigint, load_time double, error string"

REPORT_PAGE = (
    "url string, status_code bigint, depth bigint, load_time double, title string, word_count bigint, h1_count bigint, "
    "image_count bigint, missing_alt_count bigint, error string"
)
REPORT = (
    "metadata struct<base_url:string,domain:string,analysis_date:string,pages_crawled:bigint>, "
    "summary struct<total_pages_analyzed:bigint,total_images:bigint,images_without_alt:bigint,total_internal_links:bigint,"
    "total_external_links:bigint,broken_links_found:bigint,avg_word_count:bigint>, "
    "insights struct<critical:array<string>,warnings:array<string>,recommendations:array<string>,positive:array<string>>, "
    "pages array<struct<url:string,status_code:bigint,error:string,text_length:bigint>>"
)


def page_snapshots(pages: DataFrame) -> DataFrame:
    """Any table with url and html (or content) as page snapshots with defaults filled in."""
    have = set(pages.columns)
    body = F.col("html") if "html" in have else F.col("content")
    failed = F.coalesce(body, F.lit("")) == ""

    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in have else default

    return pages.select(
        (F.col("page_id") if "page_id" in have else F.xxhash64("url")).cast("bigint").alias("page_id"),
        given("site", urls.netloc(F.col("url"))).alias("site"),
        "url",
        F.coalesce(body, F.lit("")).alias("html"),
        given("status_code", F.when(failed, 0).otherwise(200)).cast("bigint").alias("status_code"),
        given("depth", F.lit(0)).cast("bigint").alias("depth"),
        (F.col("load_time") if "load_time" in have else F.lit(None)).cast("double").alias("load_time"),
        F.coalesce(
            F.col("error") if "error" in have else F.lit(None).cast("string"), F.when(failed, F.lit("Failed to fetch"))
        ).alias("error"),
    )


def read_snapshots(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Stored snapshots in parquet, JSON or ORC with the declared schema."""
    return page_snapshots(spark.read.schema(PAGES_RAW).format(file_format).load(path))


def read_html_files(spark: SparkSession, path: str, base_url: str) -> DataFrame:
    """A folder of HTML files at any depth, one page per file; the path below the folder becomes the address."""
    root = re.sub(r"^[a-z][a-z0-9+.-]*:/+(?=/|$)", "", path.rstrip("/")) or path
    root = "/" + root.lstrip("/") + "/"
    name = F.input_file_name()
    below = F.when(name.contains(root), F.substring_index(name, root, -1)).otherwise(F.element_at(F.split(name, "/"), -1))
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(
        F.col("value").alias("html"), F.concat(F.lit(base_url), below).alias("url")
    )
    return page_snapshots(files)


# Fixed values of the dump format: what ends a page, and how this and the escape sign are written inside one.
_END, _ESCAPE = "\x1e", "\x1b"
_ESCAPED = [(_ESCAPE, _ESCAPE + "0"), (_END, _ESCAPE + "1")]
_HEAD = "page_id bigint, site string, url string, status_code bigint, depth bigint, load_time double, error string, no_html boolean"


def write_page_dumps(pages: DataFrame, path: str, pages_per_file: int = 10_000) -> None:
    """Add page snapshots to a folder of dump files with many pages each: a line of JSON facts, the raw page, an end sign."""
    body = F.coalesce("html", F.lit(""))
    for plain, escaped in _ESCAPED:
        body = F.replace(body, F.lit(plain), F.lit(escaped))
    facts = [c for c in page_snapshots(pages).columns if c != "html"]
    given = [F.col(c) for c in facts if c in pages.columns]
    head = F.to_json(F.struct(*given, F.col("html").isNull().alias("no_html")))
    rows = pages.select(F.concat(head, F.lit("\n"), body).alias("value"))
    rows.write.mode("append").option("lineSep", _END).option("maxRecordsPerFile", pages_per_file).text(path)


def read_page_dumps(spark: SparkSession, path: str, urls_wanted: list[str] | None = None, stream: bool = False, files_per_batch: int = 100) -> DataFrame:
    """Pages of dump files as they were written, in batch or as a stream of the files that land.

    Files are split between tasks at any place, as each page ends with a sign that no page holds.
    With ``urls_wanted`` only the heads of other pages are looked at.
    """
    source = spark.readStream.option("maxFilesPerTrigger", files_per_batch) if stream else spark.read
    pages = source.option("lineSep", _END).text(path).withColumn("_cut", F.locate("\n", "value"))
    head = F.from_json(F.expr("substring(value, 1, _cut - 1)"), _HEAD).alias("_head")
    rows = pages.select(head, "value", "_cut")
    if urls_wanted is not None:
        rows = rows.where(F.col("_head.url").isin(urls_wanted))
    body = F.expr("substring(value, _cut + 1)")
    for plain, escaped in reversed(_ESCAPED):
        body = F.replace(body, F.lit(escaped), F.lit(plain))
    return rows.select("_head.*", body.alias("_body")).select(
        "page_id", "site", "url", F.when(~F.col("no_html"), F.col("_body")).alias("html"), "status_code", "depth", "load_time", "error"
    )


def page_payload(rows: DataFrame, payload: str, columns: list[str]) -> DataFrame:
    """Stored JSON over row columns: the payload wins, the row fills what is missing.

    ``columns`` lists names present both as row columns and as payload keys.
    """
    schema = T.StructType([rows.schema[c] for c in columns])
    parsed = rows.withColumn("_p", F.from_json(payload, schema))
    others = [c for c in rows.columns if c not in columns and c != payload]
    return parsed.select(*others, *[F.coalesce(F.col("_p")[c], F.col(c)).alias(c) for c in columns])


#: Folders into which the sites of a store are hashed, however many sites there are.
SITE_BUCKETS = 64


def site_bucket(site: Column) -> Column:
    return F.pmod(F.xxhash64(site), F.lit(SITE_BUCKETS)).cast("int")


def _by_bucket(rows: DataFrame) -> DataFrame:
    """Rows with their folder, brought together so that each folder gets few files; large folders are split by size."""
    return rows.withColumn("site_bucket", site_bucket(F.col("site"))).hint("rebalance", "site_bucket")


def write_results(facts: DataFrame, path: str) -> None:
    """Page results in folders of hashed sites, nested values kept typed."""
    _by_bucket(facts).write.mode("append").partitionBy("site_bucket").parquet(path)


def read_results(spark: SparkSession, path: str, site: str | None = None) -> DataFrame:
    """Stored results; a site reads its folder only."""
    stored = spark.read.parquet(path)
    if site is not None:
        bucket = spark.range(1).select(site_bucket(F.lit(site))).first()[0]
        stored = stored.where((F.col("site_bucket") == bucket) & (F.col("site") == site))
    return stored.drop("site_bucket")


def report_pages(facts: DataFrame) -> DataFrame:
    """One JSON line per page."""
    fields = [
        "url", "status_code", "depth", "load_time", "title", "word_count", "h1_count", "image_count",
        "missing_alt_count", "error",
    ]
    return facts.select("site", "page_id", F.to_json(F.struct(*fields)).alias("page"))


def report_heads(assembled: DataFrame) -> DataFrame:
    """One JSON line per site with metadata, summary and insights."""
    meta = F.struct("base_url", "domain", "pages_crawled")
    summary = F.struct(
        "total_pages_analyzed", "total_images", "images_without_alt", "total_internal_links", "total_external_links",
        "broken_links_found", "avg_word_count",
    )
    insights = F.struct("critical", "warnings", "recommendations", "positive")
    return assembled.select(
        "site",
        F.to_json(F.struct(meta.alias("metadata"), summary.alias("summary"), insights.alias("insights"))).alias("head"),
    )


def write_report(heads: DataFrame, pages: DataFrame, path: str) -> None:
    """JSON report of many sites: ``heads`` has one line per site, ``pages`` one per page.

    Both are JSON lines in folders of hashed sites, so a site of any size is written by many tasks.
    """
    for rows, name in ((heads.select("site", "head"), "heads"), (pages.select("site", "page"), "pages")):
        _by_bucket(rows).write.mode("overwrite").partitionBy("site_bucket").json(f"{path}/{name}")


SITE_META = (
    "site string, base_url string, homepage_url string, site_name string, location string, primary_keyword string, call_to_action string, "
    "https boolean, has_robots boolean, has_sitemap boolean, load_time double, n_pages bigint"
)
LINK_STATUS = "url string, status_code bigint"
AUTHORITY_METRICS = "domain string, provider string, priority bigint, metric string, value double"


def _name(column: str) -> Column:
    return F.lower(F.trim(column))


def read_site_meta(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Facts of sites, one row per site: names are trimmed and in lower case, rows without a name are left out.

    Of several rows of a site each fact is the greatest one given.
    """
    rows = spark.read.schema(SITE_META).format(file_format).load(path).withColumn("site", _name("site"))
    others = [c for c in rows.columns if c != "site"]
    return rows.where(F.coalesce("site", F.lit("")) != "").groupBy("site").agg(*[F.max(c).alias(c) for c in others])


def read_link_status(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Checked links, one row per address: a check without status counts as unreachable (0), of several the greatest stays."""
    rows = spark.read.schema(LINK_STATUS).format(file_format).load(path)
    checked = rows.select(F.trim("url").alias("url"), F.coalesce("status_code", F.lit(0)).alias("status_code"))
    return checked.where(F.coalesce("url", F.lit("")) != "").groupBy("url").agg(F.max("status_code").alias("status_code"))


def read_authority_metrics(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Authority figures by domain, provider and metric; domains are trimmed and in lower case, rows without one are left out."""
    rows = spark.read.schema(AUTHORITY_METRICS).format(file_format).load(path).withColumn("domain", _name("domain"))
    return rows.where((F.coalesce("domain", F.lit("")) != "") & F.col("metric").isNotNull())


def load_report(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Saved report documents, one row per page with the head columns; ``lines``: one document per line."""
    report = spark.read.schema(REPORT).option("multiLine", not lines).json(path)
    return report.select("metadata", "summary", "insights", F.explode_outer("pages").alias("page"))


def append_log(rows: DataFrame, path: str, at: str) -> None:
    """Append to a job or audit table, split by day."""
    rows.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").parquet(path)
