"""Registered queries that run streams: files land in several parts, and the stream is started again after each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftaudit.operators import authority
from weftaudit.sources import shared
from weftaudit.sources.tables import derived
from weftaudit.streaming import jobs
from weftaudit.streaming.sinks import batch_folders, read_batches, run_available


def _landed(rows: DataFrame, parts: list, run: Callable[[str], None]) -> None:
    """Write the rows of each part (a value of the column ``landing``) into one folder, and run after each."""
    spark = rows.sparkSession
    folder = shared.fresh_path(spark, "landing")
    stored = shared.materialised(rows)
    for part in parts:
        stored.where(F.col("landing") == part).drop("landing").write.mode("append").parquet(folder)
        run(folder)


def str_page_audit(spark, sf):
    """Scores of all pages from the running audit, stopped and started again between two halves of them."""
    meta, status = derived(spark, sf, "site_meta"), derived(spark, sf, "link_status")
    store = shared.fresh_path(spark, "audit")
    rows = derived(spark, sf, "pages_raw").withColumn("landing", F.pmod(F.xxhash64("page_id"), F.lit(2)))
    audits: list[jobs.PageAudit] = []

    def run(folder: str) -> None:
        audits.append(jobs.PageAudit(spark, folder, store))
        audits[-1].run(meta, status)

    _landed(rows, [0, 1], run)
    sites = derived(spark, sf, "site_meta").select(F.col("site").alias("domain"))
    return audits[-1].scores(authority.authority_scores(sites, derived(spark, sf, "authority_metrics")))


def str_job_progress(spark, sf):
    """The last update of each job after the progress stream has seen all rows, some of them late within the delay."""
    store = shared.fresh_path(spark, "progress")
    schema = "job_id bigint, status string, progress double, ts timestamp"

    def run(folder: str) -> None:
        log = jobs.stream_files(spark, folder, schema)
        run_available(jobs.job_progress(log, keep_ms=None), batch_folders(f"{store}/rows"), f"{store}/checkpoint", "update")

    rows = derived(spark, sf, "job_log_landings").withColumn("ts", F.col("ts").cast("timestamp"))
    _landed(rows, [0, 1, 2], run)
    return jobs.newest_progress(read_batches(spark, f"{store}/rows", "job_id long, at long, status string, progress double, terminal boolean"))


def str_audit_alerts(spark, sf):
    """All alerts that the stream gives out; one last audit of another site moves the watermark past the others."""
    store = shared.fresh_path(spark, "alerts")
    schema = "site string, ts timestamp, seo_score bigint, broken_links bigint"

    def run(folder: str) -> None:
        audits = jobs.stream_files(spark, folder, schema)
        run_available(jobs.audit_alerts(audits), batch_folders(f"{store}/rows"), f"{store}/checkpoint")

    audits = derived(spark, sf, "audit_landings").select(F.col("site").cast("string"), F.col("ts").cast("timestamp"), "seo_score", "broken_links", "landing")
    end = audits.agg(F.max("ts").alias("ts")).select(
        F.lit("").alias("site"), (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"),
        F.lit(0).cast("long").alias("seo_score"), F.lit(0).cast("long").alias("broken_links"), F.lit(3).cast("long").alias("landing"),
    )
    _landed(audits.unionByName(end), [0, 1, 2, 3], run)
    found = read_batches(spark, f"{store}/rows", "site string, ts timestamp, alert string, amount long")
    return found.select(F.col("site").cast("long").alias("site"), F.col("ts").cast("timestamp_ntz").alias("ts"), "alert", "amount")


def str_event_windows(spark, sf):
    """Days given out by the windowed stream: closed by the watermark, without the rows that came after their day was closed."""
    store = shared.fresh_path(spark, "windows")

    def run(folder: str) -> None:
        windows = jobs.event_windows(jobs.read_events(spark, folder))
        run_available(windows, batch_folders(f"{store}/rows"), f"{store}/checkpoint")

    _landed(derived(spark, sf, "event_landings"), [0, 1, 2], run)
    found = read_batches(spark, f"{store}/rows", "window_start timestamp, event_type string, entries long")
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "entries")


QUERIES = {name: fn for name, fn in list(globals().items()) if name.startswith("str_")}
