"""Streaming forms of the page audit, job progress, alerts and event counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftaudit.functions.grades import PILLAR_WEIGHTS
from weftaudit.operators import links, scoring
from weftaudit.operators.facts import page_facts
from weftaudit.operators.ops import events_per_window
from weftaudit.sources.pages import PAGES_RAW, page_snapshots
from weftaudit.sources.shared import materialised
from weftaudit.streaming.processors import Alerts, Progress, SharedOpenings
from weftaudit.streaming.sinks import batch_folders, read_batches, run_available

FILES_PER_BATCH = 1000


def stream_files(spark: SparkSession, path: str, schema: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """New parquet files of a folder as they land."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_snapshots(spark: SparkSession, path: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """New snapshot files of a folder as they land."""
    return page_snapshots(stream_files(spark, path, PAGES_RAW, files_per_batch))


def audit_stream(snapshots: DataFrame) -> DataFrame:
    """Facts of each new page. All of it is row-local, so append mode needs no state."""
    return page_facts(snapshots)


# Pages


def shared_openings(pages: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """(site, page_id) of pages whose opening another page of the site has, each as soon as that is known.

    ``pages`` has site, page_id and opening; a page that comes again is no other page. With
    ``keep_ms`` an opening is forgotten when no page had it for so long.
    """
    marked = pages.select("site", "opening", "page_id").where(F.col("opening") != "")
    mode = "None" if keep_ms is None else "ProcessingTime"
    return marked.groupBy("site", "opening").transformWithStateInPandas(SharedOpenings(keep_ms), SharedOpenings.SCHEMA, "Append", mode)


def page_results(facts: DataFrame, site_meta: DataFrame, link_status: DataFrame) -> DataFrame:
    """Pillars of pages as they stand alone, ``content_if_shared``, the content pillar of a page with a shared opening, and the opening."""
    counted = links.with_broken_count(facts, links.broken_links(facts, link_status))
    return scoring.page_pillars_either_way(scoring.scoring_input(counted, site_meta, whole_site=False))


class PageAudit:
    """A continuous audit of the snapshot files of a folder, with its results under ``store``.

    A first stream scores each page alone and stores that with its opening in batch folders,
    which a replayed batch overwrites. A second one reads these folders and keeps one page per
    opening as state; it tells which pages share theirs, pages of earlier batches included.
    ``scores`` reads both sinks. Running again goes on where the last run ended. The second
    stream starts when the first has ended, so it never reads a folder that is being replaced.
    A page that lands again counts with its last snapshot; the openings of its earlier ones stay known.
    """

    def __init__(self, spark: SparkSession, folder: str, store: str, files_per_batch: int = FILES_PER_BATCH) -> None:
        self.spark, self.folder, self.store, self.files_per_batch = spark, folder, store, files_per_batch

    def run(self, site_meta: DataFrame, link_status: DataFrame) -> None:
        facts = lambda rows: page_facts(rows).select(*scoring.SCORE_FACTS)
        self.schema = page_results(facts(self.spark.createDataFrame([], PAGES_RAW)), site_meta, link_status).schema
        pages = stream_snapshots(self.spark, self.folder, self.files_per_batch)
        sink = batch_folders(f"{self.store}/pages", lambda rows: page_results(materialised(facts(rows)), site_meta, link_status))
        run_available(pages, sink, f"{self.store}/checkpoint-pages")
        stored = stream_files(self.spark, f"{self.store}/pages", "site string, page_id long, opening string", self.files_per_batch)
        run_available(shared_openings(stored), batch_folders(f"{self.store}/shared"), f"{self.store}/checkpoint-shared")

    def pillars(self) -> DataFrame:
        """The last pillars of every page, right for the openings seen so far."""
        rows = read_batches(self.spark, f"{self.store}/pages", self.schema)
        last = rows.groupBy("page_id").agg(F.max("batch").alias("batch"))
        shared = read_batches(self.spark, f"{self.store}/shared", SharedOpenings.SCHEMA).select("page_id").distinct()
        known = rows.join(last, ["page_id", "batch"]).join(shared.withColumn("is_shared", F.lit(True)), "page_id", "left")
        content = F.when(F.col("is_shared"), F.col("content_if_shared")).otherwise(F.col("content_quality"))
        return known.withColumn("content_quality", content).drop("is_shared", "content_if_shared", "opening", "batch")

    def scores(self, authority: DataFrame) -> DataFrame:
        found = scoring.page_scores(self.pillars(), authority)
        return found.select("page_id", "overall", "grade", "label", *[F.col(f"{n}.score").alias(n) for n in PILLAR_WEIGHTS])


# Jobs, audits and events


def job_progress(log: DataFrame, delay: str = "1 day", keep_ms: int | None = 86_400_000) -> DataFrame:
    """Newest state per job in update mode; ``log`` has job_id, status, progress and ts.

    A finished job stays finished: its state is kept until no row of before its end can come
    any more (the watermark passes it by ``keep_ms``), so late rows do not reopen it. Jobs
    that just fall silent are dropped after the same time; with None nothing is dropped. A row
    is given out when the state of its job changes.
    """
    rows = log.withWatermark("ts", delay).withColumn("at", F.unix_micros("ts"))
    return rows.groupBy("job_id").transformWithStateInPandas(Progress(keep_ms), Progress.SCHEMA, "Update", "EventTime")


def newest_progress(updates: DataFrame) -> DataFrame:
    """The last state of each job among stored updates of ``job_progress``."""
    newest = F.max_by(F.struct("status", "progress", "terminal"), F.struct("batch", "terminal", "at", "status", "progress"))
    return updates.groupBy("job_id").agg(newest.alias("s")).select("job_id", "s.*")


def audit_alerts(audits: DataFrame, delay: str = "1 day") -> DataFrame:
    """Alerts on a score drop or new broken links against the audit before, as ``ops.audit_alerts`` gives them.

    ``audits`` has site (string), ts, seo_score and broken_links. An audit waits until the
    watermark has passed it; by then every earlier one of its site is there, so audits that
    arrive out of order within ``delay`` are compared in the order of their times.
    """
    rows = audits.withColumn("site", F.col("site").cast("string")).withWatermark("ts", delay).withColumn("at", F.unix_micros("ts"))
    found = rows.groupBy("site").transformWithStateInPandas(Alerts(), Alerts.SCHEMA, "Append", "EventTime")
    return found.select("site", F.timestamp_micros("at").alias("ts"), "alert", "amount")


def event_windows(log: DataFrame, at: str = "ts", action: str = "event_type", width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Events per tumbling window and action.

    In append mode a window is given out once, when the watermark (the latest time of earlier
    batches less ``delay``) has reached its end. Rows whose window has ended by then are dropped.
    """
    return events_per_window(log.withWatermark(at, delay), at, action, width)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event files as a stream with a time-zone timestamp, which watermarks need."""
    rows = stream_files(spark, path, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))
